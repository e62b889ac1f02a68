import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from creditledger.llm import quality
from creditledger.llm.quality import judge, perplexities, recency
from tests.llm.conftest import EDGES

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def good(i):
    return " ".join(WORDS[(i * 7 + k * k) % len(WORDS)] for k in range(80))


def brute(trusted, texts, order=5):
    """A plain interpolated modified Kneser-Ney model over dictionaries."""
    grams = lambda t: [(" " * (order - 1) + t)[i : i + order] for i in range(len(t))]
    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    about = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            d = [min(max(x, 0.05), j - 0.05) for j, x in enumerate(d, 1)]
        else:
            d = [0.5, 0.75, 0.9]
        total, freed = defaultdict(float), defaultdict(float)
        for g, m in c.items():
            total[g[:-1]] += m
            freed[g[:-1]] += d[min(m, 3) - 1]
        about[k] = (d, total, freed)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 256
        d, total, freed = about[len(g)]
        if not total[g[:-1]]:
            return below
        m = counts[len(g)][g]
        return ((m - d[min(m, 3) - 1] if m else 0) + freed[g[:-1]] * below) / total[g[:-1]]

    assert abs(sum(p("the " + chr(b)) for b in range(256)) - 1) < 1e-9
    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t)) for t in texts]


@pytest.mark.parametrize("most", [10**6, 0])
def test_equals_a_plain_model(spark, table, monkeypatch, most):
    monkeypatch.setattr(quality, "CHUNK_ROWS", 4)
    rows = [(i, good(i)) for i in range(30)] + [(100, "zqx zqx!"), (101, "THE OF")]
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    found = {r.doc_id: r for r in perplexities(table(rows), trusted, most).collect()}
    learned = [t for i, t in rows if i < 20 and not found[i].held_out]
    want = brute(learned, [t for _, t in rows])
    for (i, _), w in zip(rows, want, strict=True):
        assert found[i].perplexity == pytest.approx(w, rel=1e-4)


def test_junk_goes_and_clean_stays(spark, table):
    rows = [(i, good(i)) for i in range(120)] + [(200 + i, f"Q{i}## ZZ%% {i * 7919} XXJ!! " * 5) for i in range(10)]
    trusted = spark.createDataFrame([(i,) for i in range(90)], "doc_id long")
    kept = {r.doc_id for r in judge(table(rows), trusted).collect() if r.kept}
    assert kept == set(range(120))


def test_edges(spark, edges, nothing):
    trusted = spark.createDataFrame([(1,), (1,), (4,), (None,)], "doc_id long")
    rows = judge(edges, trusted).collect()
    assert len(rows) == len(EDGES)
    assert all(r.perplexity is None and not r.kept for r in rows if r.doc_id in (2, 3))
    none = judge(edges, trusted.filter("false")).collect()
    assert {(r.perplexity, r.kept) for r in none if r.doc_id == 1} == {(None, True)}
    assert judge(nothing, trusted).count() == 0


def test_recency_counts_back_in_words():
    texts = pa.array([b"Der der, der und der", None, b"a b c a", b"...", " é x é".encode()])
    assert recency(texts).to_pylist() == [b"ABBAC", b"", b"AAAD", b"", b"AAC"]


def test_repeated_ordinary_words_go(spark, table):
    rows = [(i, good(i)) for i in range(120)]
    rows += [(200 + i, " ".join(w for k in range(4) for w in [WORDS[(i + k) % len(WORDS)]] * 15)) for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(90)], "doc_id long")
    kept = {r.doc_id for r in judge(table(rows), trusted).collect() if r.kept}
    assert kept == set(range(120))

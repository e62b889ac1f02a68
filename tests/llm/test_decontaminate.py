import random
import re

import pytest

from creditledger.llm.decontaminate import benchmark_hits, cut_hits, drop_contaminated, is_contaminated
from tests.llm.conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window):
    known = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in known:
                    hit.update(range(s, s + n))
                    found |= known[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def got(docs, items, window, **settings):
    rows = benchmark_hits(docs, items, window, **settings).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    vocabulary = [*"abcdefgh", "É", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(1 if i > 25 else 4, 14))) for i in range(30)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            parts += [" ".join(w[rng.randrange(0, 3) :]).upper(), f"q{i}", text(rng.randrange(0, 6))]
        rows.append((i, ", ".join(parts)))
    return rows, items


@pytest.mark.parametrize(("window", "block"), [(5, 10**6), (5, 25), (13, 40), (1, 10**6)])
def test_equals_brute_force(spark, table, mixed, window, block):
    rows, items = mixed
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert got(table(rows), frame, window, block_words=block) == brute(rows, items, window)


def test_edges(spark, edges, nothing):
    items = [(1, None), (None, "one two three"), (2, "..."), (3, "two three four"), (3, "four five six"), (4, "größe")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert got(edges, frame, 3) == brute([(r[0], r[1]) for r in EDGES], items, 3)
    assert benchmark_hits(nothing, frame).count() == 0
    assert {r.n_hit for r in benchmark_hits(edges, frame.filter("false")).collect()} == {0}


def test_contaminated_documents_go_and_others_are_left_alone(spark, table):
    item = " ".join(f"w{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, item), (2, f"{filler} {item}"), (3, filler), (4, None), (5, f"{item} " + " ".join(["g"] * 246))]
    frame = spark.createDataFrame([(9, item)], "item_id long, text string")
    left = drop_contaminated(table(rows), frame)
    assert left.columns == table(rows).columns
    assert {r.doc_id: r.text for r in left.collect()} == {2: rows[1][1], 3: filler, 4: None}
    assert benchmark_hits(table(rows), frame).filter(is_contaminated()).count() == 2
    cut = {r.doc_id: r.text for r in cut_hits(table(rows), frame).collect()}
    assert cut == {1: "", 2: filler + " ", 3: filler, 4: None, 5: " " + " ".join(["g"] * 246)}


def test_ids_that_are_text(spark):
    words = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([("b-9", words), ("a", words), ("10", "x y z"), (None, words)], "item_id string, text string")
    docs = spark.createDataFrame([("d", f"so {words} it"), ("e", "x y z"), ("f", "no")], "doc_id string, text string")
    got = {r.doc_id: sorted(r["items"]) for r in benchmark_hits(docs, items).collect()}
    assert got == {"d": ["a", "b-9"], "e": ["10"], "f": []}

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from creditledger.llm import variants
from creditledger.llm.variants import edits, near_pairs, roots, spelling_variants
from tests.llm.conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w in n:
        others = [v for d in (-1, 0, 1) for v in by_size.get(len(w) + d, []) if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


WORDS = "banana bananna banane bananas ananas aaaaa aaaaaa aabaa Ünicode ünicode Àèìòù àèìòù straße strasse größe grösse".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        some = rng.choice(WORDS, 20, p=(p := 1 / np.arange(1, len(WORDS) + 1)) / p.sum())
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in some) + f" x{i}y don't{i % 7}"))
    return rows + [(1, rows[0][1]), (None, rows[1][1]), (900, None), (901, ""), (902, "×÷ ×÷×÷× ×÷×÷× ×÷×÷× 12 34")]


@pytest.mark.parametrize("filter_bytes", [1 << 24, 64])
def test_equals_brute_force(table, texts, filter_bytes):
    want = brute(texts)
    assert any(r[2] != r[1] and r[1] for r in want) and any(r[5] for r in want)
    assert result(spelling_variants(table(texts), filter_bytes)) == want


def test_edges(edges, nothing):
    assert result(spelling_variants(edges)) == brute([(r[0], r[1]) for r in EDGES])
    assert spelling_variants(nothing).count() == 0


def test_words_beyond_the_longest_shard(table):
    long = "abcdefghij" * 30
    words = [long, long[:70] + long[71:], long[:64], long[:63], "z" + long[1:], "é" + long[1:], "x" * 5000, "x" * 4999]
    rows = [(i, " ".join(words)) for i in range(8)]
    assert result(spelling_variants(table(rows))) == brute(rows)


def test_each_edit_comes_once_and_keys_tell_edits_apart():
    letters = np.frombuffer(b"abcn", np.uint8)
    words = np.array([list(b"aabba"), list(b"nabna")], np.uint8)
    key_of = {}
    for size, word, at, put, key in edits(words, letters):
        for w, p, c, k in zip(word, at, put, key, strict=True):
            text = words[w].tobytes()
            edit = text[:p] + (bytes([c]) if c else b"") + text[p + 1 :]
            assert len(edit) == size and key_of.setdefault((w, edit), k) == k
        assert len(set(zip(word, at, put, strict=True))) == len(word)
    whole = [(w, e) for w, e in key_of]
    assert len(whole) == len(set(whole))
    by_edit = {}
    for (_, edit), k in key_of.items():
        assert by_edit.setdefault(edit, k) == k
    assert len(set(by_edit.values())) == len(by_edit)


def test_pairs_come_up_once(spark, texts, monkeypatch):
    # With a filter that lets most through, the join alone decides.
    monkeypatch.setattr(variants, "BITS", 1)
    words = sorted({w.translate(LOWER) for w in WORDS if len(w) >= 5})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(map(tuple, near_pairs(df, 64).collect()))
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_roots_of_long_paths(spark):
    forms = [(f"w{i:02}", f"w{i + 1:02}") for i in range(40)] + [("v", "w07"), ("u", "t")]
    got = dict(map(tuple, roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {**{f"w{i:02}": "w40" for i in range(40)}, "v": "w40", "u": "t"}

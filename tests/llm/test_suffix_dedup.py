import hashlib
import random

import pytest

from creditledger.llm.suffix_dedup import cut_repeats
from tests.llm.conftest import EDGES


def brute(rows, depth=50):
    out = []
    known: dict[bytes, int] = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - depth + 1):
            w = data[s : s + depth]
            if i is not None:
                known[w] = min(i, known.get(w, i))
    for i, text in rows:
        data = (text or "").encode()
        hit = [False] * len(data)
        for s in range(len(data) - depth + 1):
            if i is not None and known[data[s : s + depth]] < i:
                hit[s : s + depth] = [True] * depth
        kept = bytes(b for b, h in zip(data, hit, strict=True) if not h)
        runs = sum(h and not (j and hit[j - 1]) for j, h in enumerate(hit))
        out.append((i, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, **settings):
    return sorted((tuple(r)[:5] for r in cut_repeats(df, **settings).collect()), key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(3)
    letters = "abcdefgh é😀"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            piece = rng.choice(shared)
            low = rng.randrange(0, max(1, len(piece) - 45))
            parts += [piece[low:], text(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 500), (101, "a" * 120), (102, "ab" * 100), (103, rows[5][1]), (104, rows[5][1])]
    return rows


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "buckets": 3}, {"gram": 8}, {"gram": 50}])
def test_equals_brute_force(table, passages, settings):
    assert got(table(passages), **settings) == brute(passages)


def test_edges(edges, nothing):
    rows = [(r[0], r[1]) for r in EDGES]
    assert got(edges) == brute(rows)
    assert cut_repeats(nothing).count() == 0


def test_rows_that_share_an_id(table):
    a, b = "the first passage, which is certainly longer than fifty bytes", "another passage, also longer than the fifty bytes"
    rows = [(1, a + b), (1, b + b + "!"), (2, b + b + "x"), (2, a), (-5, "tail " + a)]
    assert got(table(rows)) == brute(rows)

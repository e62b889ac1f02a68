import random
import re

import numpy as np
import pyarrow as pa
import pytest

from creditledger.llm.minhash import SLOTS, chunk_keys, components, drop_near_copies, near_groups, radius, shingle_sets, signatures
from tests.llm.conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (ids[a], ids[b]):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    part[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        group = [ids[b] for b in range(len(rows)) if find(b) == find(a)]
        least = min((g for g in group if g is not None), default=None)
        out.append((i, len(sets[a]), least, least == i))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(500)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.3 else "  ".join(text)))
    return rows


@pytest.mark.parametrize(("percent", "settings"), [(85, {}), (80, {"bucket_block": 2, "family_block": 150})])
def test_equals_brute_force(table, copies, percent, settings):
    got = sorted(map(tuple, near_groups(table(copies), percent, **settings).collect()), key=repr)
    assert got == brute(copies, percent)


def test_edges(edges, nothing):
    rows = [(r[0], r[1]) for r in EDGES]
    assert sorted(map(tuple, near_groups(edges).collect()), key=repr) == brute(rows, 85)
    assert near_groups(nothing).count() == 0
    left = drop_near_copies(edges)
    assert left.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(4)
    for distance in (0, 3, 10, 23):
        a = rng.integers(0, 256, (200, SLOTS), dtype=np.uint8)
        b = a.copy()
        for row in b:
            at = rng.choice(SLOTS, distance, replace=False)
            row[at] ^= rng.integers(1, 256, distance, dtype=np.uint8)
        assert (chunk_keys(a, distance) == chunk_keys(b, distance)).any(axis=1).all()


def test_linked_pairs_are_within_the_radius():
    rng = random.Random(2)
    far, distance = 0, radius(85)
    for _ in range(200):
        base = [str(rng.random()) for _ in range(120)]
        # 9 words are 45 of 231 shingles apart at most.
        other = base[:100] + [str(rng.random()) for _ in range(9)] + base[109:]
        s, places = shingle_sets(pa.array([" ".join(base).encode(), " ".join(other).encode()], pa.binary()))
        sig = signatures(s, places)
        both = len(shingles(" ".join(base)) & shingles(" ".join(other)))
        if 100 * both >= 85 * (232 - both):
            far += int((sig[0] != sig[1]).sum() > distance)
    assert far == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(149, 200), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 150), 200]}}


def test_repeated_ids_lose_no_text_and_keep_no_copy(table):
    base = " ".join(f"w{i}" for i in range(80))
    near, other = base.replace("w40 ", "x "), " ".join(f"v{i}" for i in range(80))
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in drop_near_copies(table(rows)).collect()), key=repr)
    assert kept([(1, base), (5, other), (5, near)]) == sorted([(1, base), (5, other)])
    assert kept([(1, base), (1, base), (2, near), (3, ""), (3, ""), (4, None)]) == [(1, base), (3, ""), (3, ""), (4, None)]
    assert len(kept([(1, base), (1, near), (1, other)])) == 2
    assert kept([(None, base), (6, base), (7, near)]) == sorted([(6, base), (None, base)], key=repr)

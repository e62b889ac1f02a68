import math
from fractions import Fraction

import numpy as np
import pytest

from creditledger.llm.queries import QUERIES
from creditledger.llm.whitening import whiten


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=8, repeats=True):
    """Whole-number sums in Python, eigenvectors by numpy; signs as the operator has them."""
    x = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if usable(v)]
    lengths = [len(v) for _, v in x]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    x = [(i, v) for i, v in x if len(v) == d and d]
    if not x:
        return []
    fit = [v for _, v in x] if repeats else [list(v) for v in {tuple(v) for _, v in x}]
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda v: [float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums, strict=True)]
    c = np.array([centre(v) for v in fit])
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = np.trace(cov)
    out = []
    for i, v in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for j, e in enumerate(values):
            flat = e <= values[0] * d * np.finfo(float).eps
            z = None if flat else float(np.dot(centre(v), vectors[:, j]) / math.sqrt(e))
            out.append((i, j + 1, n, deviation, z, (0 if flat else e) / trace if trace > 0 else None))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4] or 0))
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert (a[4] is None) == (b[4] is None)
        if a[4] is not None:
            assert abs(abs(a[4]) - abs(b[4])) < 1e-6
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-12) if b[5] is not None else a[5] is None
        assert a[6] is None or a[6] <= 1e-4


def frame(spark, rows, kind="float"):
    full = [(i, v, 7, "x", "y", "z") for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, w long, h1 string, x string, z string").repartition(5)


def test_query_equals_brute_force(spark, small_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    got = QUERIES["op13_whitening"](spark, small_dir)
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    got = got.collect()
    assert len(got) == 8 * len(rows) and len({r.identity_error for r in got}) == 1
    same(got, brute(rows))
    # One sign a component for all rows.
    want = {(r[0], r[1]): r[4] for r in brute(rows)}
    for k in range(1, 9):
        assert len({math.copysign(1, r.whitened) * math.copysign(1, want[r.vec_id, k]) for r in got if r.component == k and abs(r.whitened) > 1e-3}) == 1


@pytest.mark.parametrize("repeats", [True, False])
def test_copies_nulls_and_other_lengths(spark, repeats):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]
    rows += [(7, rows[4][1]), (None, rows[5][1]), (200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, []), (203, [1.0])]
    rows += [(204, [float("nan")] * 5), (205, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    same(whiten(frame(spark, rows, "double"), repeats=repeats).collect(), brute(rows, repeats=repeats))


def test_flat_and_few(spark):
    same(whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect(), brute([(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    rows = [(1, [0.5, 0.25, 1.0]), (2, [0.25, 0.75, 0.0]), (3, [0.25, 0.75, 0.0])]
    got = whiten(frame(spark, rows)).collect()
    same(got, brute(rows))
    assert sum(r.whitened is None for r in got) == 6
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_entries_of_any_size(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.0, 2.0])]
    got = {r.vec_id: r for r in whiten(frame(spark, rows, "double")).collect() if r.component == 1}
    top = 2**53
    x = {1: (top, 100000), 2: (2 * 100000 - top, 101024), 3: (103072, 102048)}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    for i, v in x.items():
        assert int(got[i].deviation) == sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True))

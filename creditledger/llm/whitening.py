"""Whitening of embeddings from counted distinct vectors.

Entries are made whole numbers first, x = floor(1024 * c) + 100000, so that equal
vectors are recognised exactly and sums have no rounding.

1. Rows of the same x are counted (combined before the shuffle): one row per distinct
   vector with its multiplicity, known from then on by 128 bits of hash.
2. Sums per dimension are exact, of multiplicity times x.
3. The covariance is a weighted product of centred vectors: each partition multiplies
   its own, and the partial matrices meet by matrix row in rounds of FAN_IN.
4. Its eigenvectors, a matrix of d x d at the driver, whiten every distinct vector once.
5. The rows get their vector's values by a join on the 128 bits; a vector that a third
   of the rows share is one row of the other side.

`repeats=False` fits with weight one for every distinct vector instead of its count.

Defined cases: null vectors, and vectors with a null or non-finite entry, are dropped;
so are vectors whose length is not the commonest one (ties: the longest), the empty
vector among them, as they have no covariance with the rest. Empty table: no rows. x is held within
+-2**53. A component whose eigenvalue is zero up to rounding (one distinct vector, more
dimensions than vectors) has `whitened` null; `explained` is null if nothing varies;
`identity_error` is over the other components, null if there are none. Repeated ids and
null ids are rows like others. Eigenvectors have their largest entry (ties: the first)
positive. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries x beyond this are held there: up to it every whole number is a double.
LARGEST = 1 << 53
#: Partial matrices that meet in one task.
FAN_IN = 64
_KEY = ["h1", "h2"]


def quantised(vector: Column) -> Column:
    """The whole numbers of a vector, or null where it has a null or non-finite entry."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(LARGEST - SHIFT)

    def whole(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-top)), F.lit(top))
        return F.floor(scaled).cast("long") + F.lit(SHIFT)

    return F.when(usable, F.transform(vector, whole))


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, x, h1, h2 of the rows that are not dropped."""
    whole = vectors.select("vec_id", quantised(F.col("embedding")).alias("x")).filter(F.col("x").isNotNull())
    sizes = whole.groupBy(F.size("x").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    d = common[0] if common else 0
    return whole.filter((F.size("x") == d) & (F.size("x") > 0)).select(
        "vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64("x", F.lit(1)).alias("h2")
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("w").to_numpy(zero_copy_only=False)


def _exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Sums of w * x by column, as Python's integers where 64 bits are too few."""
    if float(np.abs(x).max(initial=0)) * float(w.sum()) < 2.0**62:
        return (x * w[:, None]).sum(axis=0).tolist()
    return (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()


def _totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """The sum of weights and the weighted sums of each dimension, all exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part, w = _exact_sums(_matrix(batch), _weights(batch)), _weights(batch)
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                n += int(w.sum())
        if total is not None:
            values = [str(v) for v in [n, *total]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    parts = distinct.select("x", "w").mapInArrow(sums, "place int, value string")
    found = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("place").collect()
    values = [int(row.value) for row in found]
    return (values[0], values[1:]) if values else (0, [])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _summed(parts: DataFrame) -> DataFrame:
    """One row (i, values) per matrix row from rows (part, i, values)."""

    def add(table: pa.Table) -> pa.Table:
        values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(table.column("part").to_numpy())
        total = values.reshape(table.num_rows, -1)[order].sum(axis=0)
        return pa.table(
            {
                "part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()),
                "i": table.column("i").slice(0, 1),
                "values": pa.array([total], pa.list_(pa.float64())),
            }
        )

    last = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = stored(
            parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group"), "i").applyInArrow(add, "part int, i int, values array<double>"),
            "matrix",
        )
        last //= FAN_IN
        if last == 0:
            return parts


def covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of rows x with weight w, divisor n, centred before multiplying."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                c = _centred(_matrix(batch), n, sums)
                part = (c * _weights(batch)[:, None]).T @ c
                total = part if total is None else total + part
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(d, TaskContext.get().partitionId(), np.int32)),
                    pa.array(np.arange(d, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * d), pa.array(total.ravel())),
                ],
                ["part", "i", "values"],
            )

    parts = stored(distinct.select("x", "w").mapInArrow(products, "part int, i int, values array<double>"), "products")
    rows = _summed(parts).orderBy("i").collect()
    matrix = np.array([row["values"] for row in rows]) / n
    return (matrix + matrix.T) / 2


def components(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and the eigenvectors as columns, k at most."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy()
    largest = np.abs(vectors).argmax(axis=0)
    vectors *= np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    values[values <= max(values[0], 0) * len(matrix) * np.finfo(float).eps] = 0
    return values, vectors


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)**2, exact."""
    reach = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
    kind = np.int64 if reach**2 * x.shape[1] < 1 << 62 else object
    return ((x.astype(kind) * n - np.array(sums, kind)) ** 2).sum(axis=1).tolist()


def _transformed(distinct: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """h1, h2, w, deviation (decimal text), z (null entries where the eigenvalue is zero)."""
    scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1)), np.nan)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                z = (_centred(x, n, sums) @ vectors) * scale
                places = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("h1"),
                        batch.column("h2"),
                        batch.column("w"),
                        pa.array([str(v) for v in _deviations(x, n, sums)]),
                        pa.ListArray.from_arrays(places, pa.array(z.ravel(), from_pandas=True)),
                    ],
                    ["h1", "h2", "w", "deviation", "z"],
                )

    return distinct.mapInArrow(whiten, "h1 long, h2 long, w long, deviation string, z array<double>")


def identity_error(whitened: DataFrame, alive: list[int], n: int) -> float | None:
    """The largest absolute entry of the covariance of z minus the identity."""
    if not alive:
        return None
    entry = {k: F.col("z")[k] for k in alive}
    mean = whitened.agg(*(F.sum(F.col("w") * entry[k]) for k in alive)).first()
    centred = {k: entry[k] - F.lit(total / n) for k, total in zip(alive, mean, strict=True)}
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    sums = whitened.agg(*(F.sum(F.col("w") * centred[i] * centred[j]).alias(f"{i}_{j}") for i, j in pairs)).first()
    return max(abs(total / n - (i == j)) for total, (i, j) in zip(sums, pairs, strict=True))


def whiten(vectors: DataFrame, k: int = COMPONENTS, repeats: bool = True) -> DataFrame:
    """Per row that is not dropped and component (1 to k): vec_id, component, n (rows
    in the fit list), deviation (decimal), whitened, explained, identity_error."""
    rows = _rows(vectors)
    counted = rows.groupBy("h1", "h2", "x").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.col("copies") if repeats else F.lit(1).cast("long")
    distinct = stored(counted.select(*_KEY, "x", weight.alias("w")), "distinct")
    n, sums = _totals(distinct)
    if not n:
        spark = vectors.sparkSession
        return spark.createDataFrame(
            [],
            "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double",
        )
    matrix = covariance(distinct, n, sums)
    values, directions = components(matrix, k)
    whitened = stored(_transformed(distinct, n, sums, values, directions), "whitened")
    trace = float(np.trace(matrix))
    error = identity_error(whitened, [int(i) for i in np.flatnonzero(values)], n)
    shares = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values))
    known = whitened.select(*_KEY, F.col("deviation").cast("decimal(38,0)").alias("deviation"), "z")
    return (
        rows.select("vec_id", *_KEY)
        .join(known, _KEY)
        .select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
        .select(
            "vec_id",
            (F.col("place") + 1).alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("place")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )

"""What the operators share: a table in the shared folder, texts as flat bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below
    `spark.checkpoint.dir`, or a temporary one where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="creditledger-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Rows of texts handed to Python at a time, where the session has Spark's default.
BATCH_ROWS, DEFAULT_BATCH_ROWS = 500, "10000"


def importable(spark: SparkSession) -> None:
    """Lets Python workers look for this package where the driver found it; on a
    cluster that does not have it there, it is installed or sent with --py-files.
    Batches of rows are made smaller than Spark's default, as a row is a whole text."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, DEFAULT_BATCH_ROWS) == DEFAULT_BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, root]))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: its lineage ends there, so that an executor lost
    later costs a read and not the work before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key() -> list[Column]:
    """Columns t1, t2: 128 bits that tell the text of a row; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _can_be_ordered(kind: str) -> bool:
    return not any(word in kind for word in ("map<", "variant", "interval"))


def keep_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame, key: list[Column] | None = None) -> DataFrame:
    """`docs` without the rows whose doc_id and `key` (named columns, t1 and t2 unless
    given) are in `gone`, and with one row for each that is in `repeated`: the smallest by
    its columns. Ids alone decide nothing, as several texts may share one. Null ids
    equal null ids."""
    names = gone.columns
    there = docs.select(F.struct("*").alias("row"), F.col("doc_id"), *(text_key() if key is None else key))

    def met(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = others.toDF(*(f"_{n}" for n in names))
        on = F.lit(True)
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
        return rows.join(others, on, how)

    left = met(there, gone, "left_anti")
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return left.select("row.*")
    order = F.struct(*(F.col("row")[c] for c, kind in docs.dtypes if _can_be_ordered(kind)))
    one = met(left, repeated, "left_semi").groupBy(*names).agg(F.min_by("row", order).alias("row"))
    return met(left, repeated, "left_anti").select("row.*").union(one.select("row.*"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices whose `column` (binary) holds about `limit` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        slot = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // limit
        edges = np.flatnonzero(np.diff(slot)) + 1
        for low, high in zip([0, *edges], [*edges, len(sizes)], strict=True):
            yield batch.slice(low, high - low)


def flat(column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, each followed by `end`, and where each begins
    (one more than there are values). Null is empty."""
    column = pc.fill_null(column, b"")
    if end:
        column = pc.binary_join_element_wise(column, pa.scalar(end), pa.scalar(b""))
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)])
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), places
    first = int(offsets[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + places[-1]], places


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit word for every byte, and an odd base with its inverse modulo 2**64.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hashes of byte ranges of one text buffer, each in constant time."""

    _power = _inverse = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Ranges._power) <= len(data):
            n = max(len(data) + 1, SLICE_BYTES + (1 << 16))
            Ranges._power, Ranges._inverse = _powers(BASE, n), _powers(INVERSE, n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_WORDS[data] * Ranges._power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Ranges._inverse[start] + (end - start).astype(np.uint64))


def word_edges(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of True begin and end. The last value must be False."""
    change = np.flatnonzero(np.diff(is_word, prepend=False))
    return change[::2], change[1::2]


_WORD_BYTES = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def alnum_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`data` with A-Z in lower case, and where its words begin and end: runs of ASCII
    letters and digits and of anything beyond ASCII. The last byte must be no word's."""
    data = LOWER[data]
    return (data, *word_edges(_WORD_BYTES[data]))

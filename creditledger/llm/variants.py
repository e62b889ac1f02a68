"""Spelling variants grouped through Bloom-guided edit neighbourhoods.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z in lower case). One run in
SLIP is misspelt on purpose: if SLIP divides the crc32 of `<doc_id>:<run>`, the code
point at that crc modulo the run's length is deleted. The vocabulary is the results of
MIN_LETTERS code points and MIN_COUNT occurrences over all documents.

1. Counting combines before its shuffle; a common word sends a row per task.
2. A blocked Bloom filter (blocks of 512 bits, eight words of 64 with a bit of the key
   in each) is built in Spark, its blocks dealt to shards by word length.
3. Every word generates its edits as hashes: each deletion, and each replacement by a
   greater letter of the vocabulary. (An insertion is another word's deletion, a
   replacement by a smaller letter another word's by a greater.) They probe the
   broadcast shard of their length. A round broadcasts FILTER_BYTES of blocks at most;
   larger vocabularies take more rounds, and an edit is probed in one of them.
4. Only positives are spelt out and shuffled, to an exact join with the vocabulary that
   removes what the filter let through. Each near pair comes up once.
5. A word's form is its near word of largest count (ties: the smallest), if that count
   is at least twice its own. Roots follow forms by pointer doubling; counts double
   along them, so there are no circles and few rounds.

Defined cases: null or empty text, no runs; null doc_id, the empty text in the crc; empty table, no
rows; repeated rows count as often as they come. doc_id may be of any type that can be
cast to text. A word may be of any length: edits are hashed in time that does not grow
with it, LONGEST code points and more share a shard. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import BASE, BYTE_WORDS, INVERSE, flat, mix, stored

SLIP = 97
MIN_LETTERS = 5
MIN_COUNT = 3
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Bits of the filter for each word of the vocabulary, and bytes broadcast in a round.
BITS = 24
FILTER_BYTES = 16 << 20
LONGEST = 64
#: Edits hashed at a time, and words whose edits are one task.
EDITS = 1 << 20
TASK_WORDS = 1 << 14

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LANES = mix(np.arange(1, 9, dtype=np.uint64)) & np.uint64(0xFFFFFFFF) | np.uint64(1)
_32 = np.uint64(32)


def runs(docs: DataFrame) -> DataFrame:
    """id, run: the runs of all texts, with repeats."""
    lower = F.translate("text", _UPPER, _LOWER)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"),
    )


def slipped(id_: Column, run: Column) -> Column:
    """The run, or what is left of it where a code point is deleted."""
    h = F.crc32(F.concat(id_, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n."""
    counted = runs(docs).groupBy(slipped(F.col("id"), F.col("run")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= MIN_LETTERS) & (F.col("n") >= MIN_COUNT))


def _letters(words: DataFrame) -> DataFrame:
    """word, letters: one byte per code point, and its length."""
    return words.select("word", F.encode("word", "ISO-8859-1").alias("letters"), F.length("word").alias("size"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shards:
    """Where the blocks of each length lie: shard `s` has `blocks[s]` from `first[s]` on."""

    def __init__(self, counts: dict[int, int]):
        self.blocks = np.zeros(LONGEST + 1, np.uint64)
        for size, n in counts.items():
            self.blocks[size] = -(-n * BITS // 512)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)]).astype(np.uint64)

    def block(self, key: np.ndarray, size: int) -> np.ndarray:
        shard = min(size, LONGEST)
        return self.first[shard] + ((key >> _32) * self.blocks[shard] >> _32)

    def sizes(self, low: int, high: int) -> list[int]:
        """Lengths with blocks between `low` and `high`."""
        return [s for s in range(LONGEST + 1) if self.blocks[s] and self.first[s] < high and self.first[s + 1] > low]


def lane_bits(key: np.ndarray, lane: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) * _LANES[lane] & np.uint64(0xFFFFFFFF)) >> np.uint64(26)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: their places in the batch, and a matrix of their letters."""
    data, places = flat(batch.column("letters"))
    sizes = np.diff(places)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for low in range(0, len(rows), step := max(1, EDITS // int(size))):
            some = rows[low : low + step]
            yield some, data[places[some][:, None] + np.arange(size)]


def _keys(total: np.ndarray, size: int) -> np.ndarray:
    return mix(total ^ mix(np.array([size], np.uint64)))


def _filter_rows(shards: Shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _by_size(batch):
                size = words.shape[1]
                key = _keys((BYTE_WORDS[words] * _powers(BASE, size)).sum(axis=1, dtype=np.uint64), size)
                masks = [(np.uint64(1) << lane_bits(key, k)).view(np.int64) for k in range(8)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards.block(key, size).view(np.int64)), *map(pa.array, masks)], ["block", *(f"m{k}" for k in range(8))]
                )

    return run


def edits(words: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of words of one length: (length of the edit, word, position, letter put there or 0,
    key). No edit of a word comes twice."""
    n, size = words.shape
    power = _powers(BASE, size)
    terms = BYTE_WORDS[words]
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(terms * power, axis=1, out=sums[:, 1:])
    head = np.ones(words.shape, bool)
    head[:, 1:] = words[:, 1:] != words[:, :-1]
    word, at = np.nonzero(head)
    left = sums[word, at] + (sums[word, -1] - sums[word, at + 1]) * np.uint64(INVERSE)
    yield size - 1, word, at, np.zeros(len(word), np.uint8), _keys(left, size - 1)
    step = max(1, EDITS // max(1, n * len(letters)))
    for low in range(0, size, step):
        part = words[:, low : low + step]
        word, at, put = np.nonzero(letters[None, None, :] > part[:, :, None])
        at += low
        changed = sums[word, -1] + (BYTE_WORDS[letters][put] - terms[word, at]) * power[at]
        yield size, word, at, letters[put], _keys(changed, size)


def _positives(shards: Shards, letters: np.ndarray, low: int, filter_: object):
    """Words with the edits that the filter's blocks from `low` on let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_.value
        for batch in batches:
            words = batch.column("word")
            for rows, matrix in _by_size(batch):
                step = max(1, EDITS // max(1, matrix.shape[1] * len(letters)))
                for first in range(0, len(rows), step):
                    some = matrix[first : first + step]
                    for size, word, at, put, key in edits(some, letters):
                        block = shards.block(key, size) - np.uint64(low)
                        here = np.flatnonzero(block < np.uint64(len(table))) if shards.blocks[min(size, LONGEST)] else np.zeros(0, int)
                        for lane in range(8):
                            bit = table[block[here], lane] >> lane_bits(key[here], lane) & np.uint64(1)
                            here = here[bit == 1]
                        if not len(here):
                            continue
                        found = []
                        for w, p, c in zip(word[here], at[here], put[here], strict=True):
                            letters_of = some[w].tobytes()
                            found.append((letters_of[:p] + (bytes([c]) if c else b"") + letters_of[p + 1 :]).decode("latin-1"))
                        yield pa.RecordBatch.from_arrays(
                            [words.take(pa.array(rows[first + word[here]])), pa.array(found, pa.string())], ["word", "edit"]
                        )

    return run


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, near: words (stored, distinct) one inserted, deleted or replaced code point
    apart, each pair in both directions."""
    spark = words.sparkSession
    spelt = _letters(words)
    counts = spelt.groupBy(F.least("size", F.lit(LONGEST)).alias("shard")).count().collect()
    shards = Shards({r["shard"]: r["count"] for r in counts})
    used = spelt.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()
    letters = np.array(sorted(ord(r.letter) for r in used if r.letter), np.uint8)
    masks = [f"m{k}" for k in range(8)]
    rows = spelt.select("letters").mapInArrow(_filter_rows(shards), "block long, " + ", ".join(f"{m} long" for m in masks))
    blocks = stored(rows.groupBy("block").agg(*(F.bit_or(m).alias(m) for m in masks)), "filter")
    total, step = int(shards.first[-1]), max(1, filter_bytes // 64)
    found = None
    for low in range(0, total, step):
        high = min(low + step, total)
        part = blocks.filter(F.col("block").between(low, high - 1)).toArrow()
        table = np.zeros((high - low, 8), np.uint64)
        at = part.column("block").to_numpy() - low
        for k, m in enumerate(masks):
            table[at, k] = part.column(m).to_numpy().view(np.uint64)
        sizes = shards.sizes(low, high)
        sizes = sorted({s + d for s in sizes for d in (0, 1)})
        reached = F.least("size", F.lit(LONGEST)).isin(sizes)
        sent = spark.sparkContext.broadcast(table)
        tasks = -(-sum(r["count"] for r in counts) // TASK_WORDS)
        spread = spelt.filter(reached).select("word", "letters").repartition(tasks, "word")
        positive = spread.mapInArrow(_positives(shards, letters, low, sent), "word string, edit string")
        positive = stored(positive, "positives")
        sent.destroy()
        found = positive if found is None else found.union(positive)
    if found is None:
        return words.select("word", F.col("word").alias("near")).filter("false")
    exact = stored(found.join(words.select(F.col("word").alias("edit")), "edit").select("word", F.col("edit").alias("near")), "near")
    return exact.union(exact.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of (word, form), a forest, lead in the end."""
    table = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = table.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stored(step, "roots")
        table = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return table


def spelling_variants(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words, filter_bytes)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        pairs.join(counts, "near")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    )
    formed = F.col("near_n") >= 2 * F.col("n")
    known = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("near")).alias("form"),
            F.when(formed, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    rooted = roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

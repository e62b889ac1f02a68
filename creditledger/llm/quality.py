"""Quality by perplexity under interpolated modified Kneser-Ney models of bytes and words.

1. Every task counts the byte ORDER-grams of its texts (white space is one byte, and
   a text begins after spaces); equal grams are summed per task before the shuffle.
   All trusted texts are counted, and every gram of any text takes part. The bytes see
   about one short word; for what is said again and again, WORD_ORDER-grams of words are
   counted in the same way, a word standing as how long ago the text had it before (see
   `recency`), which reaches over the whole text and has no unknown words.
2. Counts of the shorter grams are continuation counts. Three discounts per order
   follow from the counts of counts. The probability of every gram that occurs in the
   corpus is a chain of joins, sharded by gram, context and suffix: count, total and
   types of its context, and the probability of the gram without its first byte.
3. A text has a perplexity of its bytes and one of its words. Tables of up to
   BROADCAST_GRAMS grams (12 bytes each) go to every task; larger ones are joined per
   chunk of texts, each chunk asking for each of its grams once. The table of words is
   bounded by its alphabet and always sent.
4. One trusted text in HELD_OUT is not trained on. A text is kept where neither
   perplexity exceeds the `quantile` of those texts in its language; where a language
   has none, that of all.

Defined cases: empty table, no rows; null or empty text, no perplexity, not kept; text
without words, no perplexity of words, judged by its bytes; no trusted text, no perplexity, everything with text is kept; null language, a language
of its own; null doc_id, never trusted; repeated rows, each its own row. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import Ranges, alnum_words, flat, slices, stored

ORDER, WORD_ORDER = 5, 3
QUANTILE = 0.99
#: Equal texts differ by less than this share, as their sums are taken in other places.
ROUNDING = 1e-9
HELD_OUT = 8
BROADCAST_GRAMS = 4_000_000
#: Ids of trusted texts that are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Texts whose grams are summed before they are sent; texts of a chunk, in rows.
PART_BYTES = 16 << 20
CHUNK_ROWS = 4096

_PLAIN = np.array([32 if b == 32 or 9 <= b <= 13 else b for b in range(256)], np.uint8)


def recency(column: pa.Array) -> pa.Array:
    """Per text one letter a word (in lower case): A where it is new in the text, else B
    if it is the word before, C the second before, D the third or fourth, E up to the
    eighth, and so on in powers of two."""
    data, places = flat(column, b"\n")
    data, begin, end = alnum_words(data)
    text = np.searchsorted(places, begin, "right") - 1
    word = Ranges(data)(begin, end)
    order = np.lexsort((word, text))
    same = (np.diff(text[order]) == 0) & (np.diff(word[order]) == 0)
    letter = np.full(len(begin), ord("A"), np.uint8)
    letter[order[1:][same]] += (1 + np.frexp(np.diff(order)[same] - 1.0)[1]).astype(np.uint8)
    offsets = np.searchsorted(text, np.arange(len(column) + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(letter)])


def grams(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of the texts, and where each text's begin."""
    data, places = flat(column)
    size = np.diff(places)
    padded = np.full(len(data) + (order - 1) * len(size), 32, np.uint64)
    at = np.arange(len(data)) + (order - 1) * (np.repeat(np.arange(len(size)), size) + 1)
    padded[at] = _PLAIN[data]
    code = np.zeros(len(data), np.uint64)
    for k in range(order):
        code |= padded[at - k] << np.uint64(8 * k)
    return code.view(np.int64), places


def count_grams(rows: DataFrame) -> DataFrame:
    """(order, gram, n) of rows (text, trusted): n counts the trusted texts' grams, bytes
    of ORDER and words of WORD_ORDER; grams of other texts are there with 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(order: int) -> Iterator[pa.RecordBatch]:
            gram, n = (np.concatenate(x) for x in zip(*parts[order], strict=True))
            gram, back = np.unique(gram, return_inverse=True)
            n = np.bincount(back, n, len(gram)).astype(np.int64)
            for low in range(0, len(gram), 200_000):
                s = slice(low, low + 200_000)
                orders = pa.array(np.full(len(gram[s]), order, np.int32))
                yield pa.RecordBatch.from_arrays([orders, pa.array(gram[s]), pa.array(n[s])], ["order", "gram", "n"])

        parts, held = {ORDER: [], WORD_ORDER: []}, 0
        for batch in slices(batches, "text"):
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(np.int64)
            for order, column in ((ORDER, batch.column("text")), (WORD_ORDER, recency(batch.column("text")))):
                code, places = grams(column, order)
                gram, back = np.unique(code, return_inverse=True)
                parts[order].append((gram, np.bincount(back, np.repeat(trusted, np.diff(places)), len(gram))))
                held += len(code)
            if held >= PART_BYTES:
                for order in parts:
                    yield from settle(order)
                parts, held = {ORDER: [], WORD_ORDER: []}, 0
        if held:
            for order in parts:
                yield from settle(order)

    counted = rows.mapInArrow(count, "order int, gram long, n long")
    return counted.groupBy("order", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """What is taken off counts of 1, 2 and 3 or more."""
    n = {r["n"]: r["types"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("types")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) for every gram of `counts` (gram, n)."""
    seen = {order: counts.filter("n > 0")}
    for k in range(order - 1, 0, -1):
        longer = seen[k + 1]
        seen[k] = longer.groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    lower = None
    for k in range(1, order + 1):
        table = stored(seen[k], f"counts{k}") if k < order else seen[k]
        d1, d2, d3 = _discounts(table)
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        # Bytes of the context; order 1 has the empty one.
        context = F.shiftright("gram", 8)
        about = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(taken).alias("freed"))
        asked = counts.select(_suffix(F.col("gram"), k).alias("gram")).distinct() if k < order else counts.select("gram")
        joined = asked.join(table.select("gram", "n", taken.alias("off")), "gram", "left")
        joined = joined.withColumn("context", F.shiftright("gram", 8)).join(about, "context", "left")
        if lower is None:
            joined = joined.withColumn("below", F.lit(1 / 256))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(below, "suffix")
        own = F.coalesce(F.col("n") - F.col("off"), F.lit(0.0))
        p = F.when(F.col("total") > 0, (own + F.col("freed") * F.col("below")) / F.col("total")).otherwise(F.col("below"))
        lower = stored(joined.select("gram", p.alias("p")), f"p{k}")
    return lower.select("gram", F.log("p").alias("logp"))


def _perplexity(column: pa.Array, order: int, gram: np.ndarray, logp: np.ndarray) -> pa.Array:
    """Per text; null where it is empty. `gram` sorted."""
    code, places = grams(column, order)
    got = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(gram, code)], dtype=np.float64)])
    total, size = got[places[1:]] - got[places[:-1]], np.diff(places)
    return pa.array(np.exp(-total / np.maximum(size, 1)), mask=size == 0)


def _scored(docs: DataFrame, table: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """doc_id, lang, perplexity, word_perplexity of rows (text, doc_id, lang)."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}
    schema = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, perplexity double, word_perplexity double"
    names = ["doc_id", "lang", "perplexity", "word_perplexity"]

    def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        gram = rows.column("gram").to_numpy()
        order = np.argsort(gram)
        return gram[order], rows.column("logp").to_numpy()[order]

    def share(rows: DataFrame):
        known = ordered(rows.select("gram", F.col("logp").cast("float").alias("logp")).toArrow())
        return docs.sparkSession.sparkContext.broadcast(known)

    shared_words = share(words)

    def score(batch: pa.RecordBatch, gram: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
        text = batch.column("text")
        found = [_perplexity(text, ORDER, gram, logp), _perplexity(recency(text), WORD_ORDER, *shared_words.value)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *found], names)

    if table.count() <= most:
        shared = share(table)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                yield score(batch, *shared.value)

        return docs.select("text", "doc_id", "lang").mapInArrow(scan, schema)

    chunk = (F.monotonically_increasing_id() / CHUNK_ROWS).cast("long")
    chunks = stored(docs.select("text", "doc_id", "lang", chunk.alias("chunk")), "chunks")

    def ask(rows: pa.Table) -> pa.Table:
        gram = [np.unique(grams(b.column("text"))[0]) for b in slices(iter(rows.select(["text"]).to_batches()), "text", 1 << 20)]
        gram = np.unique(np.concatenate([np.zeros(0, np.int64), *gram]))
        return pa.table({"chunk": pa.array(np.full(len(gram), rows.column("chunk")[0].as_py(), np.int64)), "gram": gram})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "chunk long, gram long").join(table, "gram").select("chunk", "gram", "logp")

    def answer(texts: pa.Table, rows: pa.Table) -> pa.Table:
        known = ordered(rows)
        parts = [score(b, *known) for b in slices(iter(texts.to_batches()), "text", 1 << 20)]
        return pa.Table.from_batches(parts)

    return chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(answer, schema)


def perplexities(docs: DataFrame, trusted: DataFrame, most: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, lang, perplexity, word_perplexity, has_text, held_out (trusted, but not
    trained on) of every row of `docs` (doc_id, text, lang); `trusted` has the doc_ids to learn from."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    ids = trusted.filter("doc_id IS NOT NULL").select("doc_id", (~held).alias("_known")).distinct()
    ids = stored(ids, "trusted")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    is_trusted = F.coalesce("_known", F.lit(False)).alias("trusted")
    texts = docs.select(F.col("text").cast("binary").alias("text"), "doc_id", F.col("lang").cast("string").alias("lang"))
    counts = stored(count_grams(texts.join(few, "doc_id", "left").select("text", is_trusted)), "counts")
    if counts.filter("n > 0").isEmpty():
        nothing = F.lit(None).cast("double").alias("perplexity")
        scored = texts.select("doc_id", "lang", nothing, nothing.alias("word_perplexity"), (F.length("text") > 0).alias("_full"))
    else:
        table, words = (probabilities(counts.filter(F.col("order") == k).drop("order"), k) for k in (ORDER, WORD_ORDER))
        scored = _scored(texts, table, words, most).withColumn("_full", F.col("perplexity").isNotNull())
    return scored.join(few, "doc_id", "left").select(
        "doc_id",
        "lang",
        "perplexity",
        "word_perplexity",
        F.coalesce("_full", F.lit(False)).alias("has_text"),
        F.coalesce(~F.col("_known"), F.lit(False)).alias("held_out"),
    )


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, most: int = BROADCAST_GRAMS) -> DataFrame:
    """Per row of `docs`: doc_id, lang, perplexity, threshold, kept, word_perplexity,
    word_threshold."""
    found = stored(perplexities(docs, trusted, most), "perplexities")
    good = found.filter("held_out AND perplexity IS NOT NULL")
    limits = {"perplexity": "threshold", "word_perplexity": "word_threshold"}
    limit = [F.percentile_approx(c, quantile, 10_000).alias(t) for c, t in limits.items()]
    own = good.groupBy("lang").agg(*limit).withColumnRenamed("lang", "_lang")
    every = good.agg(*limit).first()
    rows = found.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    kept = F.col("has_text")
    for column, name in limits.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(every[name]).cast("double")))
        kept &= F.coalesce(F.col(column) <= F.col(name) * (1 + ROUNDING), F.lit(True))
    return rows.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"), "word_perplexity", "word_threshold")

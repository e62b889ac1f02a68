"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams (lower case,
everything that is no letter one space), hashed into BUCKETS rows; a softmax on
that mean gives the language. Both are trained by stochastic gradient descent in
numpy on a bounded sample: about `per_language` labelled texts of each language,
picked by a hash of their id. A quarter of the sample is not trained on; it sets
the temperature that calibrates the probabilities and the score below which a
prediction is rejected: the `reject_share` quantile there, and 0.5 at most.

As the mean is linear, embedding and softmax multiply into one table of a score
per bucket and language. It has BUCKETS x languages numbers, is made on the
driver, and goes to the tasks; texts are scored where they lie, without a shuffle.

Defined cases: empty table, no rows; null text or text without a letter, `und`
with score 0, rejected; no labelled row at all, `und` everywhere; null doc_id,
held out; repeated rows, each its own row; ties between languages go to the name
that sorts first. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import flat, slices

BUCKETS = 1 << 16
GRAMS = ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35))
DIM = 16
PER_LANGUAGE = 400
REJECT_SHARE = 0.001
BLOCK = 1 << 18
UNKNOWN = "und"
#: Labels are names of languages; so many at most are learned.
MOST_LANGUAGES = 1000

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length, the bucket of the gram that begins at each place of the
    texts (BUCKETS where none does), and the places where the texts begin."""
    data, places = flat(column, b" ")
    data = _LETTERS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    if len(data):
        keep[0] = data[0] != 32
    data = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    places = np.concatenate([[0], np.cumsum(keep)])[places]
    n, code, out = len(data) - 4, data[:-4], []
    for size, factor in GRAMS:
        for k in range(1, size):
            if k + 1 == size or size == 2:
                code = code | data[k : n + k] << np.uint32(8 * k)
        bucket = (code * np.uint32(factor) >> np.uint32(16)).astype(np.int32)
        for k in range(1, size):
            last = places[1:] - k
            bucket[last[last >= places[:-1]]] = BUCKETS
        out.append(bucket)
    return out, places


def _sums(table: np.ndarray, bucket: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places) - 1, table.shape[1]))
    for low in range(0, len(bucket), BLOCK):
        part = table[bucket[low : low + BLOCK]]
        first, last = np.searchsorted(places, low, "right") - 1, np.searchsorted(places, low + len(part))
        edges = (places[first : last + 1] - low).clip(0, len(part))
        full = np.flatnonzero(np.diff(edges))
        out[first + full] += np.add.reduceat(part, edges[full])
    return out


class Model:
    """languages, the table of scores by bucket, bias, temperature, least score."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.languages, self.bias, self.temperature, self.least = languages, bias, temperature, least
        self.table = np.vstack([table, np.zeros(len(languages), np.float32)]).astype(np.float32)

    def logits(self, column: pa.Array) -> np.ndarray:
        buckets, places = grams(column)
        size = np.diff(places)
        total = sum(np.maximum(size - n + 1, 0) for n, _ in GRAMS)
        sums = sum(_sums(self.table, b, places) for b in buckets)
        return sums / np.maximum(total, 1)[:, None] + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return softmax(self.logits(column) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(
    texts: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    languages: list[str],
    reject_share: float = REJECT_SHARE,
    epochs: int = 8,
    seed: int = 7,
) -> Model:
    """`texts` as (bucket, share of the text's grams), `labels` as places in `languages`."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    truth = np.eye(len(languages), dtype=np.float32)
    step, steps = 0, epochs * max(len(used), 1)
    for _ in range(epochs):
        for i in rng.permutation(used):
            rate = 1 - step / steps
            step += 1
            bucket, share = texts[i]
            rows = embedding[bucket]
            mean = share @ rows
            wrong = softmax((mean @ weights + bias)[None])[0] - truth[labels[i]]
            back = weights @ wrong
            # The step of a row is in proportion to its share; the mean of many rows moves slowly.
            embedding[bucket] = rows - (20 * rate) * share[:, None] * back
            weights -= (2 * rate) * np.outer(mean, wrong)
            bias -= (0.02 * rate) * wrong
    table = embedding @ weights
    if not len(held):
        return Model(languages, table, bias, 1.0, 0.0)
    logits = np.array([texts[i][1] @ table[texts[i][0]] + bias for i in held])
    grid = np.geomspace(0.2, 8, 40)
    right = [softmax(logits / t)[np.arange(len(held)), labels[held]] for t in grid]
    temperature = float(grid[int(np.argmin([-np.log(p + 1e-12).mean() for p in right]))])
    best = softmax(logits / temperature).max(axis=1)
    return Model(languages, table, bias, temperature, float(min(0.5, np.quantile(best, reject_share))))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        found, places = grams(batch.column("text"))
        bucket, share = [], []
        for low, high in zip(places[:-1], places[1:], strict=True):
            count = np.bincount(np.concatenate([b[low:high] for b in found]), minlength=BUCKETS + 1)[:BUCKETS]
            at = np.flatnonzero(count)
            bucket.append(at.astype(np.int32))
            share.append((count[at] / max(count.sum(), 1)).astype(np.float32))
        lists = [pa.array(bucket, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], ["doc_id", "lang", "bucket", "share"])


def _lower(text: Column) -> Column:
    return F.lower(text).cast("binary")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, reject_share: float = REJECT_SHARE) -> Model | None:
    """A model from rows (doc_id, text, lang); null when no row has text and lang."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    per_label = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in per_label.limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: not a column of languages")
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    # Which texts are taken depends on their ids alone; the bound is met in expectation.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(place < share).select(_lower(F.col("text")).alias("text"), F.col("doc_id").cast("long"), "lang")
    rows = sample.mapInArrow(_shares, "doc_id long, lang string, bucket array<int>, share array<float>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    languages = sorted(set(rows.column("lang").to_pylist()))
    labels = np.array([languages.index(x) for x in rows.column("lang").to_pylist()])
    # Views of the table's buffers, which are given back once the model is fitted.
    views = [[x.values.to_numpy() for x in rows.column(c)] for c in ("bucket", "share")]
    model = fit(list(zip(*views, strict=True)), labels, languages, reject_share)
    del rows, views
    pa.default_memory_pool().release_unused()
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score, rejected for every row of `docs`."""
    kept = [F.col(c) for c in keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in slices(batches, "_text", 1 << 20):
            known = batch.column("_lettered").to_numpy(zero_copy_only=False)
            found = model.scores(batch.column("_text"))
            best = found.argmax(axis=1)
            score = np.where(known, found.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[2:],
                    pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                    pa.array(score),
                    pa.array(~known | (score < model.least)),
                ],
                [*batch.schema.names[2:], "lang_pred", "score", "rejected"],
            )

    rows = docs.select(_lower(F.col("text")).alias("_text"), lettered.alias("_lettered"), *kept)
    return rows.mapInArrow(scored, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo `parts`, is `part`."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of `docs`."""
    model = train(docs.filter(~held_out(F.col("doc_id"), 4, 2)), per_language)
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """`docs` without the rows whose language is rejected; all columns stay."""
    model = train(docs.filter(~held_out(F.col("doc_id"), 4, 2)), per_language)
    columns = docs.columns
    aside = docs.select("text", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)))
    found = predict(aside, model, tuple(f"_c{i}" for i in range(len(columns)))).filter(~F.col("rejected"))
    return found.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)))

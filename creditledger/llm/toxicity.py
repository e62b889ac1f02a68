"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are which words, pairs of neighbours and pairs with one or
two words between occur in it, hashed into 2**BITS places. FTRL-proximal keeps a
learning rate per place and, by its L1 term, a weight of zero wherever the evidence
stays small, so the model that goes to the tasks is the short list of places with a
weight: MOST_WEIGHTS at most, which is checked. It is fitted in numpy on a bounded
sample, about `per_label` labelled texts of each label, picked by a hash of their
id. The score is calibrated to the labels' own proportions on texts that a fold left
out. Texts are scored where they lie, whole and without a shuffle.

Defined cases: empty table, no rows; null or empty text, no features: the score of
the bias; no labelled row, score 0 everywhere; null label, not learned from; null
doc_id, held out; a doc_id with several labels, one row for each; repeated rows,
each its own row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import Ranges, alnum_words, flat, mix, slices

BITS = 20
PER_LABEL = 3000
#: From here on a document is called toxic.
THRESHOLD = 0.7
MOST_WEIGHTS = 1 << 18
_STEP = np.uint64(0xD1342543DE82EF95)


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of feature, its place for every word (-1 where the text ends
    before), and where the words of each text begin."""
    data, places = flat(column, b" ")
    data, start, end = alnum_words(data)
    word = Ranges(data)(start, end)
    bounds = np.searchsorted(start, places)
    out = [(word >> np.uint64(64 - BITS)).astype(np.int64)]
    last = np.repeat(bounds[1:], np.diff(bounds))
    for gap in (1, 2, 3):
        both = np.full(len(word), -1)
        fits = np.flatnonzero(np.arange(len(word)) + gap < last)
        pair = mix(word[fits] * _STEP + word[fits + gap] + np.uint64(gap))
        both[fits] = (pair >> np.uint64(64 - BITS)).astype(np.int64)
        out.append(both)
    return out, bounds


class Ftrl:
    """Follow the regularised leader with a proximal term, one example at a time."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last place is the bias, which is not made sparse.
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        before = self.n[at]
        self.n[at] = before + gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at]) - np.sqrt(before)) / self.alpha * w


class Model:
    """The places with a weight, the bias, and slope and shift of the calibration."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        if len(places) > MOST_WEIGHTS:
            raise ValueError(f"{len(places)} weights: raise l1")
        self.places, self.weights, self.bias, self.slope, self.shift = places, weights, bias, slope, shift

    def table(self) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1, np.float32)
        out[self.places] = self.weights
        return out

    def scores(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        kinds, bounds = features(column)
        found_text, found_place = [], []
        for place in kinds:
            at = np.flatnonzero(table[place])
            found_place.append(place[at])
            found_text.append(np.searchsorted(bounds, at, "right") - 1)
        pair = np.unique(np.concatenate(found_text) << (BITS + 1) | np.concatenate(found_place))
        total = np.bincount(pair >> (BITS + 1), table[pair & ((2 << BITS) - 1)], minlength=len(bounds) - 1) + self.bias
        return _logistic(self.slope * total + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit_once(texts: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, settings: dict[str, float]) -> np.ndarray:
    rng, ftrl = np.random.default_rng(seed), Ftrl(**settings)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ftrl.learn(np.append(texts[i], 1 << BITS), int(labels[i]))
    return ftrl.weights(np.arange((1 << BITS) + 1))


def calibrate(total: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through `total`, by Newton's method, with
    Platt's softened labels."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([total, np.ones(len(total))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = _logistic(x @ at)
        gradient = x.T @ (weight * (p - target))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        at -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit(
    texts: list[np.ndarray],
    labels: np.ndarray,
    shares: dict[int, float] | None = None,
    epochs: int = 4,
    seed: int = 11,
    folds: int = 3,
    **settings: float,
) -> Model:
    """`texts` as distinct places, `shares` of each label's texts that were taken.
    Totals of texts that a fold left out set the calibration, in which a text stands
    for as many as its label's share says."""
    labels = np.asarray(labels)
    total = np.zeros(len(texts))
    if len(set(labels.tolist())) == 2 and len(texts) >= 10 * folds:
        for f in range(folds):
            used = [i for i in range(len(texts)) if i % folds != f]
            weights = _fit_once([texts[i] for i in used], labels[used], epochs, seed, settings)
            for i in range(f, len(texts), folds):
                total[i] = weights[texts[i]].sum() + weights[-1]
        weight = np.array([1 / (shares or {}).get(int(y), 1.0) for y in labels])
        slope, shift = calibrate(total, labels, weight / weight.mean())
    else:
        slope, shift = 1.0, 0.0
    weights = _fit_once(texts, labels, epochs, seed, settings)
    places = np.flatnonzero(weights[:-1])
    return Model(places, weights[places].astype(np.float32), float(weights[-1]), slope, shift)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        kinds, bounds = features(batch.column("text"))
        rows = [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lists = pa.array([r[r >= 0].astype(np.int32) for r in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], ["doc_id", "label", "places"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label 0 or 1)."""
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    shares = {int(label): min(1.0, per_label / n) for label, n in counts.items()}
    share = F.when(F.col("label") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0))
    # Which texts are taken depends on their ids alone; the bound is met in expectation,
    # so what is broadcast is about 2 * per_label ids.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.select("doc_id", "text").join(F.broadcast(usable.filter(place < share)), "doc_id")
    rows = sample.select(
        F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long"), F.col("label").cast("int")
    )
    rows = rows.mapInArrow(_distinct, "doc_id long, label int, places array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return fit([np.array(p.values) for p in rows.column("places")], rows.column("label").to_numpy(), shares)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every row of `docs`."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in slices(batches, "text"):
            score = pa.array(model.scores(batch.column("text"), table))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")

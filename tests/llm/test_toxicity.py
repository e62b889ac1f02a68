import random

import numpy as np
import pyarrow as pa

from creditledger.llm import toxicity
from tests.llm.conftest import EDGES


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumble", "Snarl", "hiss"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out(spark, table):
    rows = made(900, 1)
    docs = table([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600], "doc_id long, label int")
    truth = {i: y for i, _, y in rows if i >= 600}
    got = {r.doc_id: r.score for r in toxicity.predict(docs, toxicity.train(docs, labels)).collect() if r.doc_id >= 600}
    called = {i for i, s in got.items() if s >= toxicity.THRESHOLD}
    toxic = {i for i, y in truth.items() if y}
    assert len(called & toxic) >= 0.9 * len(toxic) and len(called - toxic) <= 0.01 * len(truth)


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (5, 0), (5, 1), (None, 1)], "doc_id long, label int")
    model = toxicity.train(edges, labels)
    rows = toxicity.predict(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.predict(nothing, model).count() == 0
    none = toxicity.train(edges, labels.filter("label > 1"))
    assert {r.score for r in toxicity.predict(edges, none).collect()} == {0.0}


def test_features_are_the_pairs_within_reach():
    kinds, bounds = toxicity.features(pa.array([b"a b c d e", b"", b"A b", None], pa.binary()))
    assert bounds.tolist() == [0, 5, 5, 7, 7]
    assert [(k >= 0).sum() for k in kinds] == [7, 5, 3, 2]
    assert kinds[1][0] == kinds[1][5] and kinds[0][0] == kinds[0][5]


def test_l1_makes_weights_sparse():
    rng = np.random.default_rng(0)
    texts = [np.unique(rng.integers(10, 5000, 50)) for _ in range(400)]
    labels = np.arange(400) % 2
    texts = [np.unique(np.append(t, 3)) if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.fit(texts, labels, folds=2)
    assert 3 in model.places and len(model.places) < 100

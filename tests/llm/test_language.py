import zlib

import numpy as np

from creditledger.llm import language
from creditledger.llm.language import drop_rejected, identify
from tests.llm.conftest import EDGES


def test_held_out_accuracy(spark, small_dir):
    docs = spark.read.parquet(small_dir.replace("0.001", "0.01") + "/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) <= 0.01


def test_edges(table, nothing):
    rows = [(r[0], r[1], "en") for r in EDGES] + [(20 + i, "der die das und ist " * 5, "de") for i in range(12)]
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in identify(table(rows)).collect()]
    assert len(got) == len(rows)
    assert all((p, s, x) == ("und", 0.0, True) for i, p, s, x in got if i in (2, 3, 6))
    assert all(p in ("en", "de") for i, p, _, _ in got if i in (1, 4, 5, 8))
    assert identify(nothing).count() == 0
    assert {r.lang_pred for r in identify(table([(1, "some text", None)])).collect()} == {"und"}


def test_rejected_documents_go(table):
    rows = [(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(60)]
    docs = table([*rows, (90, None), (91, "12 34"), (92, "")])
    left = drop_rejected(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(range(60))


def test_scores_do_not_depend_on_slices():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.normal(size=(language.BUCKETS, 2)), np.zeros(2), 1.0, 0.0)
    texts = [b"", b"a", b"ab cd", bytes(rng.integers(97, 123, 3000, dtype=np.uint8)), b"  x  ", b"\xc3\xa9t\xc3\xa9"]
    whole = model.logits(pa.array(texts, pa.binary()))
    single = np.vstack([model.logits(pa.array([t], pa.binary())) for t in texts])
    assert np.allclose(whole, single, atol=1e-5)

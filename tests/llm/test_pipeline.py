import corpus_pipeline
from creditledger.llm.queries import tokenizer_file
from tests.llm.test_packing import check


def test_stages_and_their_decisions(spark, table, tmp_path):
    text = lambda seed, n=60: " ".join(f"word{(seed * 7919 + k * k * 31) % 9973}" for k in range(n))
    item = text(5000, 20)
    near = text(1).split()
    near[30] = "changed"
    rows = [(i, text(i)) for i in range(1, 40)]
    rows += [(50, text(1).replace(" ", "\n  ")), (51, " ".join(near)), (52, None), (53, "12 !"), (54, item), (55, text(8000, 600) + " " + item)]
    docs = table([(i, t, "en") for i, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near dedup", "decontamination", "packing"]
    gone = [{52, 53}, {50}, {51}, {54}]
    current, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i for i, _ in rows}
    for k, ((_, stage), drop) in enumerate(zip(corpus_pipeline.STAGES, gone, strict=False)):
        current = stage(spark, current, str(tmp_path))
        assert sorted(current.columns) == sorted(docs.columns)
        current.write.parquet(f"{tmp_path}/stage{k}")
        current = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids -= drop
        assert {r.doc_id for r in current.collect()} == ids
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == ids
    from creditledger.llm.packing import pack

    check([(i, t, 0) for i, t in rows if i in ids], pack(current, tokenizer_file()).collect(), 1024, 256, 1024)


def test_empty(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import random

import pytest
from pyspark.sql import functions as F

from creditledger.functions.lines import countable_lines_in_text
from creditledger.operators.reuse import counted_files
from creditledger.sources.files import list_trees, with_content


@pytest.fixture
def tree(spark, tmp_path):
    rng = random.Random(1)
    folder = tmp_path / "tree"
    folder.mkdir()
    texts = {f"f{n:03}.py": "\n".join(rng.choice(["x = 1", "", "/* open", "*/ y", "// c"]) for _ in range(rng.randrange(20))) for n in range(200)}
    texts["f199.py"] = texts["f000.py"]
    for name, text in texts.items():
        (folder / name).write_text(text)
    return folder, texts


def manifest(spark, folder, texts):
    ids = spark.createDataFrame([(n, str(hash(t))) for n, t in texts.items()], "path string, content_id string")
    return list_trees(spark, [str(folder)]).join(ids, "path").select("root", "path", "content_id")


def load(wanted):
    return with_content(wanted).join(wanted, ["root", "path"])


def test_only_changed_content_is_read(spark, tree, tmp_path):
    folder, texts = tree
    store = str(tmp_path / "store")
    first = counted_files(manifest(spark, folder, texts), store, ["root", "path"], load)
    assert {r.reused for r in first.collect()} == {False}
    assert spark.read.parquet(f"{store}/run-*").count() == len(set(texts.values()))
    # One file in a hundred changes; the others could not be read even if they were asked for.
    changed = {"f007.py": "a\n/* b\nc */", "f123.py": ""}
    files = manifest(spark, folder, texts | changed)
    files = files.select(F.when(F.col("path").isin(*changed), F.col("root")).otherwise("/nowhere").alias("root"), "path", "content_id")
    for name, text in changed.items():
        (folder / name).write_text(text)
    second = counted_files(files, store, ["root", "path"], load).collect()
    assert {r.path for r in second if not r.reused} <= set(changed) and len(second) == len(texts)
    whole = with_content(list_trees(spark, [str(folder)]))
    want = {r.path: r.n for r in whole.withColumn("kind", F.lit("main_code")).select("path", countable_lines_in_text("content", "kind").alias("n")).collect()}
    assert {r.path: r.n_code for r in second} == want
    # A run that died is not read.
    (tmp_path / "store" / "run-dead").mkdir()
    (tmp_path / "store" / "run-dead" / "part-0.parquet").write_text("half")
    third = counted_files(files, store, ["root", "path"], load).collect()
    assert {r.reused for r in third} == {True} and {r.path: r.n_code for r in third} == want

"""Exact duplicates by a tree merge of sorted digest runs.

Texts are equal when they are identical after every run of ASCII white space has
become one space; null counts as empty. Every partition of the digest table is a
run: one row per digest, with the smallest doc_id and the number of rows. In each
round, `fan_in` neighbouring runs become one (two of them: binomial rounds): their rows
are brought into digest order and merged there, so that the first of equal digests goes
on with the smallest doc_id and the sum of the numbers. A digest meets as many rows as
runs are merged, so a group of copies of any size sends one row per run and round, and
no task ever gathers the rows of a group while merging; the last join, which gives every
row its group, splits the rows of a busy digest at run time. The lengths and a second
hash are compared at every level; a digest that stands for two texts ends the job
instead of dropping a row. Rounds cost a shuffle of the digests each: a table of very many
partitions takes fewer with a larger `fan_in`, to the same result.

Defined cases: empty table, no rows; null text, equal to the empty text; null
doc_id, never chosen as long as the group has another, and kept where it has
none; rows that repeat a doc_id are rows of their own (all rows with the smallest
doc_id are kept). Further columns are ignored, whatever their names.

DataFrame functions only, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditledger.llm.common import keep_rows, stored

FAN_IN = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha (hex), size and second hash of the normalised text."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    return text.select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("second")
    )


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per digest from rows (run, sha, size, second, keep_id, n): runs are
    merged `fan_in` at a time, in digest order, until one is left."""
    runs = runs.select("run", "sha", "size", "second", "keep_id", "n")
    first = F.asc_nulls_last("keep_id")
    equal = Window.partitionBy("run", "sha").orderBy(first)
    every = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        n_runs = -(-n_runs // fan_in)
        met = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition("run", "sha")
            .sortWithinPartitions("run", "sha", first)
        )
        same = (F.min("size").over(every) == F.max("size").over(every)) & (
            F.min("second").over(every) == F.max("second").over(every)
        )
        merged = met.select(
            "run",
            "sha",
            "size",
            "second",
            "keep_id",
            F.sum("n").over(every).alias("n"),
            same.alias("_same"),
            F.row_number().over(equal).alias("_place"),
        )
        checked = F.when(F.col("_same"), F.col("n")).otherwise(F.raise_error(F.lit("one digest stands for two texts")).cast("long"))
        runs = merged.filter("_place = 1").withColumn("n", checked).drop("_same", "_place")
        if n_runs <= 1:
            return runs.drop("run")


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    table = stored(digests(docs), "digests")
    last = table.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0]
    first = (
        table.withColumn("run", F.spark_partition_id())
        .groupBy("run", "sha", "size", "second")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    groups = merge_runs(first, (last or 0) + 1, fan_in)
    return table.join(groups.select("sha", "keep_id", "n"), "sha").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """`docs` with one row of each group of equal texts: the one with the smallest doc_id,
    and of rows with that doc_id the smallest by its columns. The decision is by text and
    doc_id: another text under the same doc_id is not touched by it. Rows without a
    doc_id cannot be named, and all stay."""
    rows = stored(exact_groups(docs, fan_in), "groups")
    key = ["doc_id", "sha"]
    named = rows.withColumnRenamed("text_sha256", "sha").filter("doc_id IS NOT NULL")
    gone = named.filter("NOT kept").select(key).distinct()
    repeated = named.filter("kept AND group_size > 1").groupBy(key).count().filter("count > 1").select(key)
    return keep_rows(docs, gone, repeated, [F.sha2(normalised(F.col("text")), 256).alias("sha")])

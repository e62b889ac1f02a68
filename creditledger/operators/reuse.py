"""Line counts kept by content, so that a file whose content is known is not read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.operators.joins import null_safe_join
from creditledger.operators.line_state import count_lines
from creditledger.sources.files import explode_lines

CONTENT, COUNTS = "content_id", ("n_lines", "n_filled", "n_code")
KNOWN = f"{CONTENT} string, " + ", ".join(f"{c} long" for c in COUNTS)


def unknown_contents(files: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """content_id, keys: one file for each content that `known` does not have. Files are
    made one per content before the shuffle, so copies of a file cost nothing."""
    first = files.groupBy(CONTENT).agg(F.min(F.struct(*keys)).alias("_first"))
    return null_safe_join(first, known.select(CONTENT), [CONTENT], "left_anti").select(CONTENT, "_first.*")


def content_counts(files: DataFrame, known: DataFrame, keys: Sequence[str], load: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """content_id and COUNTS of the contents of `files` that are not `known`. `load` gives
    the `content` of the rows it gets (content_id, keys), and is given those only."""
    wanted = unknown_contents(files, known, keys)
    lines = explode_lines(load(wanted), [CONTENT])
    return count_lines(lines, [CONTENT]).select(CONTENT, *COUNTS)


def with_counts(files: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """`files` with COUNTS and whether they were known before (`reused`)."""
    every = known.select(CONTENT, *COUNTS, F.lit(True).alias("reused")).unionByName(
        fresh.select(CONTENT, *COUNTS, F.lit(False).alias("reused"))
    )
    return null_safe_join(files, every, [CONTENT])


def _finished_runs(spark: SparkSession, store: str) -> list[str]:
    """Parts that were written to their end; what a run that died has left is not read."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/run-*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(str(f.getPath().getParent()) for f in files.globStatus(pattern) or [])


def counted_files(files: DataFrame, store: str, keys: Sequence[str], load: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`files` (keys, content_id) with COUNTS and `reused`; what had to be counted is added
    to the table at `store`, as a part of its own that counts once it is whole."""
    spark = files.sparkSession
    runs = _finished_runs(spark, store)
    known = spark.read.schema(KNOWN).parquet(*runs) if runs else spark.createDataFrame([], KNOWN)
    part = f"{store}/run-{uuid.uuid4().hex}"
    content_counts(files, known, keys, load).write.parquet(part)
    # Runs side by side may have counted the same content; any of its rows will do.
    return with_counts(files, known.dropDuplicates([CONTENT]), spark.read.schema(KNOWN).parquet(part))

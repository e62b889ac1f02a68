"""Attributed-line dumps (`git blame --line-porcelain`) as a table.

A block of a dump is a header (commit, author, ...) and one content line that
starts with a tab. Reading with the separator newline-tab gives records that
begin with the content line of one block and go on with the header of the next,
so a dump splits at any block and a file of any size is read by many tasks. A
record then only needs its successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditledger.functions.paths import unquoted_path
from creditledger.sources.files import read_records

# The layout of a block.
SEPARATOR = "\n\t"
_HASH_LINE = r"[0-9a-f]{40}[ \t]+\S+[ \t]+\S+(?:[ \t]+\S+)?[ \t]*"
_LAST_HEADER = rf"(?s)^(?:.*\n)?({_HASH_LINE}\n.*)$"


def read_dump_records(spark: SparkSession, path: str) -> DataFrame:
    """file, split, seq, value of all dumps below `path`, at any depth and of any
    name. `split` is the byte offset of the input split and `seq` counts on inside
    it, so (split, seq) is the order within a file."""
    return read_records(spark, path, SEPARATOR)


def _header(value: Column) -> Column:
    """The header lines that end the record, from the last commit line on."""
    return F.regexp_extract(F.concat(value, F.lit("\n")), _LAST_HEADER, 1)


def parse_dump_records(records: DataFrame) -> DataFrame:
    """file, commit_id, path, line_no, author, boundary, content: one row per block.

    Only records of one split are sorted together. The last header of a split
    takes the first content of the next split of the file that has records;
    that branch reads the same columns as the other, hence the same exchange.
    """
    header = F.col("_header")
    parsed = records.select(
        "file", "split", "seq", "value", _header(F.col("value")).alias("_header")
    ).select(
        "file",
        "split",
        "seq",
        F.regexp_extract(header, r"^(\S+)", 1).alias("commit_id"),
        F.regexp_extract(header, r"^\S+[ \t]+\S+[ \t]+(\d+)", 1).try_cast("bigint").alias("line_no"),
        unquoted_path(F.regexp_extract(header, r"\nfilename ([^\n]*)", 1)).alias("path"),
        F.regexp_extract(header, r"\nauthor ([^\n]*)", 1).alias("author"),
        header.contains("\nboundary\n").alias("boundary"),
        F.substring_index("value", "\n", 1).alias("_text"),
    )
    head = ["commit_id", "path", "line_no", "author", "boundary"]
    ordered = Window.partitionBy("file", "split").orderBy("seq")
    paired = parsed.select(
        "*",
        F.lead("_text").over(ordered).alias("content"),
        F.first("_text").over(ordered).alias("_first"),
    )
    inside = paired.filter(F.col("content").isNotNull()).select("file", *head, "content")
    following = F.lead("_first").over(Window.partitionBy("file").orderBy("split"))
    across = (
        paired.filter(F.col("content").isNull())
        .select("file", *head, following.alias("content"))
        .filter(F.col("content").isNotNull())
    )
    return inside.unionByName(across)


def read_blame_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_dump_records(read_dump_records(spark, path))

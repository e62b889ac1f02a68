"""Deleted line ranges joined with the lines they removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.operators.joins import null_safe_join

BIN_LINES = 256
#: A bin of one level holds so many of the level below; a hunk that touches more than
#: twice as many bins uses the next level.
BRANCH = 32
LEVELS = 5


def _level_bins(first: Column, last: Column, bin_lines: int, top: int) -> Column:
    """Bins (level, bin) that together hold lines first to last: whole bins of high levels
    in the middle, ever finer ones towards the ends. Ranges are in bins, ends excluded."""
    at = F.struct(F.floor((first - 1) / bin_lines).cast("bigint").alias("a"), F.floor((last - 1) / bin_lines + 1).cast("bigint").alias("b"))
    none = F.array().cast("array<struct<level:int,bin:bigint>>")

    def some(level: int, a: Column, b: Column) -> Column:
        numbers = F.when(a < b, F.sequence(a, b - 1))
        return F.coalesce(F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("bin"))), none)

    def cover(level: int, r: Column) -> Column:
        if level == top:
            return some(level, r["a"], r["b"])
        inner = F.struct(F.ceil(r["a"] / BRANCH).cast("bigint").alias("a"), F.floor(r["b"] / BRANCH).cast("bigint").alias("b"))
        # One binding per level, so that the expression grows with the levels only.
        def split(i: Column) -> Column:
            return F.concat(some(level, r["a"], i["a"] * BRANCH), some(level, i["b"] * BRANCH, r["b"]), cover(level + 1, i))

        narrow = r["b"] - r["a"] <= 2 * BRANCH
        return F.when(narrow, some(level, r["a"], r["b"])).otherwise(F.flatten(F.transform(F.array(inner), split)))

    return F.flatten(F.transform(F.array(at), lambda r: cover(0, r)))


def _top_level(hunks: DataFrame, count: str, bin_lines: int) -> Column:
    """The highest level any hunk uses: a number found first, from the hunks alone."""
    widest = F.coalesce(F.max(F.col(count)), F.lit(0)) / bin_lines + 2
    level = F.lit(0)
    for k in range(1, LEVELS):
        level = level + (widest > 2 * BRANCH**k).cast("int")
    return hunks.agg(level.alias("top")).scalar()


def hunk_lines(
    hunks: DataFrame,
    parent_lines: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    count: str = "cnt",
    line_no: str = "line_no",
    bin_lines: int = BIN_LINES,
) -> DataFrame:
    """Interval join: the parent lines numbered start .. start + count - 1.

    Both sides meet on (keys, level, bin). Bins of level 0 hold `bin_lines` line numbers,
    those of each further level BRANCH times as many. A hunk takes the few bins that
    cover it, so that its rows grow with the logarithm of its length; a line has one key
    for each level that any hunk reaches, mostly one. A file of any length is spread
    over its bins. Hunks without lines in the parent drop out, as do hunks that delete
    nothing.
    """
    first, last = F.col(start), F.col(start) + F.col(count) - 1
    line = F.col(line_no)
    cut = (
        hunks.filter(F.col(count) > 0)
        .withColumn("_at", F.explode(_level_bins(first, last, bin_lines, LEVELS - 1)))
        .withColumns({"_level": F.col("_at.level"), "_bin": F.col("_at.bin")})
        .drop("_at")
    )
    levels = F.sequence(F.lit(0), _top_level(hunks, count, bin_lines))
    width = F.element_at(F.array(*(F.lit(bin_lines * BRANCH**k).cast("bigint") for k in range(LEVELS))), F.col("_level") + 1)
    binned = parent_lines.withColumn("_level", F.explode(levels)).withColumn("_bin", F.floor((line - 1) / width).cast("bigint"))
    return null_safe_join(cut, binned, [*keys, "_level", "_bin"]).filter(line.between(first, last)).drop("_level", "_bin")


def hunks_without_parent(
    hunks: DataFrame, parent_lines: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The hunks `hunk_lines` drops because their file has no parent lines, as
    after a rename. The files are made distinct before the shuffle."""
    return null_safe_join(hunks, parent_lines.select(*keys).distinct(), keys, "left_anti")

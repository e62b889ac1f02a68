"""Countable lines of ordered line tables.

The comment bit runs through a file from its first line to its last, and one
file may hold a large part of the table. Files are therefore cut into runs of
`run_lines` consecutive lines. Inside a run, window functions give the bit
before every line as a function of the bit the run starts with; a run as a whole
is one such function as well, and composing those per file needs one small row
per run. No task ever sorts more than one run of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditledger.operators.joins import null_safe_join
from creditledger.functions.lines import bit, with_line_code

RUN_LINES = 65_536
BLOCK_RUNS = 1_024

_FIRST = Window.unboundedPreceding


def _odd(count: Column) -> Column:
    return count.bitwiseAND(F.lit(1)).cast("int")


def _within_runs(
    lines: DataFrame,
    keys: Sequence[str],
    kept: Sequence[str],
    line_no: str,
    content: str,
    run_lines: int,
) -> DataFrame:
    """Adds per line: `_if0`/`_if1` (counts when the run starts outside/inside a
    comment), `_filled`, and on the last line of a run what the run does to the
    bit: `_sets` (0/1, NULL if it depends on the start) or `_flips`."""
    coded = with_line_code(
        lines.select(
            *keys,
            *kept,
            F.col(line_no).alias("_line"),
            F.floor((F.col(line_no) - 1) / F.lit(run_lines)).cast("bigint").alias("_run"),
            F.col(content).alias("_content"),
        ),
        "_content",
        "_code",
    ).drop("_content")
    ordered = Window.partitionBy(*keys, "_run").orderBy("_line")
    opens, stays = bit(F.col("_code"), 2), bit(F.col("_code"), 3)
    flip = (opens == 1) & (stays == 0)
    # With `_turns` the flips so far, a line that sets the bit to v leaves
    # v XOR odd(_turns) behind, from which any later bit follows by XOR.
    turns = F.sum(flip.cast("int")).over(ordered.rowsBetween(_FIRST, 0))
    marked = (
        coded.select("*", turns.alias("_turns"), F.lead("_line").over(ordered).isNull().alias("_end"))
        .select("*", F.when(opens == stays, opens.bitwiseXOR(_odd(F.col("_turns")))).alias("_mark"))
        .select(
            "*",
            F.last("_mark", ignorenulls=True)
            .over(ordered.rowsBetween(_FIRST, -1))
            .alias("_mark_before"),
        )
    )
    turned = _odd(F.col("_turns") - flip.cast("int"))
    outside, inside = bit(F.col("_code"), 0), bit(F.col("_code"), 1)

    def counts_if(start: int) -> Column:
        before = F.coalesce(F.col("_mark_before"), F.lit(start)).bitwiseXOR(turned)
        return F.when(before == 1, inside).otherwise(outside)

    mark_after = F.coalesce(F.col("_mark"), F.col("_mark_before"))
    turns_after = _odd(F.col("_turns"))
    return marked.select(
        *keys,
        *kept,
        "_line",
        "_run",
        "_end",
        counts_if(0).alias("_if0"),
        counts_if(1).alias("_if1"),
        bit(F.col("_code"), 4).alias("_filled"),
        F.when(F.col("_end"), mark_after.bitwiseXOR(turns_after)).alias("_sets"),
        F.when(F.col("_end") & mark_after.isNull(), turns_after).alias("_flips"),
    )


def _with_run_start(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `_start`, the bit each run starts with, to one row per run, from what
    the earlier runs of the file do to the bit."""
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(_FIRST, -1)
    upto = Window.partitionBy(*keys).orderBy("_run").rowsBetween(_FIRST, 0)
    flips = F.coalesce(F.col("_flips"), F.lit(0))
    turned = runs.withColumn("_turns", F.sum(flips).over(upto)).withColumn(
        "_mark", F.col("_sets").bitwiseXOR(_odd(F.col("_turns")))
    )
    mark = F.coalesce(F.last("_mark", ignorenulls=True).over(earlier), F.lit(0))
    return turned.withColumn("_mark_before", mark).withColumn(
        "_start", F.col("_mark_before").bitwiseXOR(_odd(F.col("_turns") - flips))
    )


def _composed(
    units: DataFrame, keys: Sequence[str], by: Sequence[str], unit: str, group: str, size: int | None
) -> DataFrame:
    """Merge `size` consecutive units (runs, blocks) into one row per (group, by),
    or all units of a file if `size` is None.

    In and out: both possible counts, `_if0` and `_if1`, and on one row of each
    unit what it does to the bit. The frames are ranges over the unit number, so
    rows of the same unit never see each other.
    """
    number = F.lit(0) if size is None else F.floor(F.col(unit) / F.lit(size))
    ordered = Window.partitionBy(*keys, group).orderBy(unit)
    upto, earlier = ordered.rangeBetween(_FIRST, 0), ordered.rangeBetween(_FIRST, -1)
    everything = ordered.rangeBetween(_FIRST, Window.unboundedFollowing)
    flips = F.coalesce(F.col("_flips"), F.lit(0))
    marked = (
        units.withColumn(group, number.cast("bigint"))
        .select(
            "*",
            F.sum(flips).over(upto).alias("_turns"),
            F.coalesce(F.sum(flips).over(earlier), F.lit(0)).alias("_turns_before"),
            F.max(unit).over(everything).alias("_last"),
        )
        .select("*", F.col("_sets").bitwiseXOR(_odd(F.col("_turns"))).alias("_mark"))
        .select("*", F.last("_mark", ignorenulls=True).over(earlier).alias("_mark_before"))
    )

    def count_if(start: int) -> Column:
        bit_before = F.coalesce(F.col("_mark_before"), F.lit(start)).bitwiseXOR(
            _odd(F.col("_turns_before"))
        )
        return F.sum(F.when(bit_before == 1, F.col("_if1")).otherwise(F.col("_if0")))

    carries = F.col("_sets").isNotNull() | F.col("_flips").isNotNull()
    tail = carries & (F.col(unit) == F.col("_last"))
    mark_after = F.coalesce(F.col("_mark"), F.col("_mark_before"))
    turns_after = _odd(F.col("_turns"))
    return marked.groupBy(*keys, group, *by).agg(
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_filled").alias("n_filled"),
        count_if(0).alias("_if0"),
        count_if(1).alias("_if1"),
        F.max(F.when(tail, mark_after.bitwiseXOR(turns_after))).alias("_sets"),
        F.max(F.when(tail & mark_after.isNull(), turns_after)).alias("_flips"),
    )


def count_lines(
    lines: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    line_no: str = "line_no",
    content: str = "content",
    run_lines: int = RUN_LINES,
    block_runs: int | None = BLOCK_RUNS,
) -> DataFrame:
    """Lines per (keys, by): all, not blank, and code lines by the comment rules.

    Columns: keys, by, `n_lines`, `n_filled`, `n_code`. Both possible counts of a
    run are kept until its start is known, so the table is read and shuffled
    once; after that only totals move, per (run, by), then per (block, by). The
    two levels keep the rows of one file that meet in one task few even when
    it has a large part of all lines and many authors. `block_runs=None` leaves
    out the first of them where no file has more than some thousand runs.
    """
    runs = (
        _within_runs(lines, keys, by, line_no, content, run_lines)
        .groupBy(*keys, "_run", *by)
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("_filled").alias("n_filled"),
            F.sum("_if0").alias("_if0"),
            F.sum("_if1").alias("_if1"),
            F.max("_sets").alias("_sets"),
            F.max("_flips").alias("_flips"),
        )
    )
    units, unit = runs, "_run"
    if block_runs is not None:
        units, unit = _composed(runs, keys, by, "_run", "_block", block_runs), "_block"
    # A file starts outside a comment.
    return _composed(units, keys, by, unit, "_file", None).select(
        *keys, *by, "n_lines", "n_filled", F.col("_if0").alias("n_code")
    )


def countable(type_: Column) -> Column:
    """Pick the count that holds for a file type from the result of `count_lines`."""
    return F.when(type_ == "documentation", F.col("n_filled")).otherwise(F.col("n_code"))


def classify_lines(
    lines: DataFrame,
    keys: Sequence[str],
    keep: Sequence[str] = (),
    type_: str | None = None,
    line_no: str = "line_no",
    content: str = "content",
    run_lines: int = RUN_LINES,
) -> DataFrame:
    """One row per line: keys, `line_no`, `keep` and the flag `countable`.

    The join that brings the start of a run back to its lines has one row per
    run that starts inside a comment, usually none, and falls on the keys the
    lines are already partitioned by.
    """
    kept = [*keep, *([type_] if type_ and type_ not in keep else [])]
    marked = _within_runs(lines, keys, kept, line_no, content, run_lines)
    starts = (
        _with_run_start(marked.filter("_end").select(*keys, "_run", "_sets", "_flips"), keys)
        .filter(F.col("_start") == 1)
        .select(*keys, "_run", "_start")
    )
    flag = F.when(F.col("_start") == 1, F.col("_if1")).otherwise(F.col("_if0")) == 1
    if type_ is not None:
        flag = F.when(F.col(type_) == "documentation", F.col("_filled") == 1).otherwise(flag)
    return null_safe_join(marked, starts, [*keys, "_run"], "left").select(
        *keys, F.col("_line").alias(line_no), *keep, flag.alias("countable")
    )

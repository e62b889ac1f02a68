"""Owners of files, surviving lines of a window, lines lost in a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.functions.paths import RULES, PathRules, file_language, file_type
from creditledger.operators.dropped import Dropped
from creditledger.operators.hunks import hunk_lines
from creditledger.operators.identity import resolve_identity
from creditledger.operators.joins import null_safe_join
from creditledger.operators.line_state import RUN_LINES, count_lines, countable


def author_histogram(lines: DataFrame, keys: Sequence[str], author: str = "raw_author") -> DataFrame:
    """Lines per file and author, blank and comment lines included."""
    return lines.groupBy(*keys, author).agg(F.count(F.lit(1)).alias("n_lines"))


def _top(author: str, n: Column) -> Column:
    return F.min_by(F.col(author), F.struct(-n, F.col(author)))


def dominant_author(
    histogram: DataFrame, keys: Sequence[str], author: str = "raw_author"
) -> DataFrame:
    """The author of most lines per file; the smaller name wins a tie."""
    return histogram.groupBy(*keys).agg(_top(author, F.col("n_lines")).alias(author))


def snapshot_facts(
    lines: DataFrame,
    aliases: DataFrame,
    keys: Sequence[str] = ("path",),
    path: str = "path",
    author: str = "raw_author",
    resolve_before_argmax: bool = False,
    run_lines: int = RUN_LINES,
    dropped: Dropped | None = None,
    rules: PathRules = RULES,
) -> DataFrame:
    """keys, type, lines, author, language: each file's countable lines, credited
    to the author of most of its lines.

    The histogram and the count come from the same pass over the lines, and a
    path is classified once per file, after counting. Files without countable
    lines or with an unknown owner are left out; `dropped` counts them as no_lines and
    unknown_owner.
    """
    counted = count_lines(lines, keys, by=[author], run_lines=run_lines)
    if resolve_before_argmax:
        counted = (
            resolve_identity(counted, author, aliases)
            .groupBy(*keys, author)
            .agg(*(F.sum(n).alias(n) for n in ("n_lines", "n_filled", "n_code")))
        )
    owned = (
        counted.groupBy(*keys)
        .agg(
            _top(author, F.col("n_lines")).alias("author"),
            F.sum("n_filled").alias("n_filled"),
            F.sum("n_code").alias("n_code"),
        )
        .withColumn("type", file_type(F.col(path), rules))
        .withColumn("lines", countable(F.col("type")))
    )
    empty, unknown = F.col("lines") <= 0, F.col("author") == "unknown"
    if dropped is not None:
        owned = dropped.watch(owned, no_lines=empty, unknown_owner=~empty & unknown)
    owned = owned.filter(~empty & ~unknown)
    if not resolve_before_argmax:
        owned = resolve_identity(owned, "author", aliases)
    return owned.select(
        *keys, "type", "lines", "author", file_language(F.col(path), rules).alias("language")
    )


def window_facts(
    lines: DataFrame,
    aliases: DataFrame,
    after: int | None = None,
    keys: Sequence[str] = ("path",),
    path: str = "path",
    author: str = "raw_author",
    touch: str = "touch_seq",
    touched: DataFrame | None = None,
    run_lines: int = RUN_LINES,
    boundary: str | None = None,
    dropped: Dropped | None = None,
    rules: PathRules = RULES,
) -> DataFrame:
    """keys, type, lines, author, language: surviving countable lines by the
    author of their last touch, where that touch is later than `after`.

    `lines` is the text at the end of the window. Older lines cannot be dropped
    before counting, because they open and close comments, so "in the window"
    is one of the grouping columns and selects afterwards. Where lines carry no
    position but a flag `boundary`, true for those last touched at or before the
    window's beginning, it takes the place of `touch` and `after`. `touched` limits the
    work to files that changed at all. `dropped` counts the rows of counts (per file
    and author) left out as before_window and no_lines.
    """
    if touched is not None:
        lines = null_safe_join(lines, touched.select(*keys), keys, "left_semi")
    if boundary is not None:
        recent = ~F.coalesce(F.col(boundary), F.lit(False))
    else:
        recent = F.lit(True) if after is None else F.col(touch) > after
    counted = count_lines(lines.withColumn("_recent", recent), keys, by=[author, "_recent"], run_lines=run_lines)
    if dropped is not None:
        counted = dropped.watch(counted, before_window=~F.coalesce("_recent", F.lit(False)))
    typed = (
        resolve_identity(counted.filter("_recent"), author, aliases, into="author")
        .withColumn("type", file_type(F.col(path), rules))
        .withColumn("lines", countable(F.col("type")))
    )
    if dropped is not None:
        typed = dropped.watch(typed, no_lines=F.col("lines") <= 0)
    return (
        typed.filter(F.col("lines") > 0)
        .groupBy(*keys, "type", "author")
        .agg(F.sum("lines").alias("lines"))
        .withColumn("language", file_language(F.col(path), rules))
        .select(*keys, "type", "lines", "author", "language")
    )


def window_losses(
    hunks: DataFrame,
    parent_lines: DataFrame,
    aliases: DataFrame,
    keys: Sequence[str] = ("commit_id", "path"),
    path: str = "path",
    author: str = "raw_author",
    run_lines: int = RUN_LINES,
    dropped: Dropped | None = None,
    rules: PathRules = RULES,
) -> DataFrame:
    """type, author, deleted: countable lines removed by somebody other than
    their author.

    The comment state starts afresh in every hunk. Both names are resolved on
    counts per (hunk, author), and only then compared. `dropped` counts hunks whose
    first line the parent lines do not have (no_parent_lines).
    """
    if dropped is not None:
        hunks = dropped.watch(hunks, no_parent_lines=F.col("cnt") > 0)
    removed = hunk_lines(hunks, parent_lines, keys)
    if dropped is not None:
        removed = dropped.watch(removed, {"no_parent_lines": -1}, no_parent_lines=F.col("line_no") == F.col("start"))
    hunk_keys = list(dict.fromkeys([*keys, path, "commit_id", "start"]))
    counted = count_lines(removed, hunk_keys, by=[author, "deleting_author"], run_lines=run_lines)
    named = resolve_identity(
        resolve_identity(counted, author, aliases), "deleting_author", aliases
    ).filter(F.col(author) != F.col("deleting_author"))
    return (
        named.withColumn("type", file_type(F.col(path), rules))
        .withColumn("deleted", countable(F.col("type")))
        .filter(F.col("deleted") > 0)
        .groupBy("type", F.col(author).alias("author"))
        .agg(F.sum("deleted").alias("deleted"))
    )

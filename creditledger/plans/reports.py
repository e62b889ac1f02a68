"""The two reports, from tables to report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.functions.ignore import IgnoreRule
from creditledger.functions.paths import RULES, PathRules, is_code_file
from creditledger.operators.attribution import displacements, last_and_displaced
from creditledger.operators.facts import snapshot_facts, window_facts, window_losses
from creditledger.operators.files import inventory
from creditledger.operators.rollup import ledger_entries
from creditledger.sources.blame_dump import read_blame_dump
from creditledger.sources.files import read_author_config
from creditledger.sources.patch_log import read_patch_log


def snapshot_entries(
    lines: DataFrame,
    aliases: DataFrame,
    keys: Sequence[str] = ("path",),
    path: str = "path",
    tracked: DataFrame | None = None,
    tracked_keys: Sequence[str] | None = None,
    ignore_rules: Sequence[IgnoreRule] = (),
    rules: PathRules = RULES,
) -> DataFrame:
    """Who owns what: entries for `report(entries, with_losses=False)`.

    Only files of the inventory count: code files outside skipped directories, not
    ignored and, where `tracked` is given, in it. Lines of others go before the shuffle.
    """
    counted = inventory(lines, tracked, tracked_keys or keys, ignore_rules, path, rules=rules)
    return ledger_entries(snapshot_facts(counted, aliases, keys, path, rules=rules))


def range_entries(
    lines: DataFrame,
    hunks: DataFrame,
    parent_lines: DataFrame,
    aliases: DataFrame,
    after: int | None,
    keys: Sequence[str] = ("path",),
    hunk_keys: Sequence[str] = ("commit_id", "path"),
    touched: DataFrame | None = None,
    path: str = "path",
    rules: PathRules = RULES,
) -> DataFrame:
    """Who changed what in the window and whose lines went: entries for
    `report(entries, with_losses=True)`. Only code files count, on either side."""
    code = is_code_file(F.col(path), rules)
    facts = window_facts(lines.filter(code), aliases, after, keys, path, touched=touched, rules=rules)
    removed = hunks.filter(code)
    return ledger_entries(facts, window_losses(removed, parent_lines, aliases, hunk_keys, path, rules=rules))


def dump_lines(dump: DataFrame) -> DataFrame:
    """The lines that the operators take, from rows of `sources.blame_dump`."""
    return dump.select("file", "path", "line_no", "content", F.col("author").alias("raw_author"), "boundary")


def snapshot_entries_from_dumps(spark: SparkSession, blame: str, authors: str | None = None) -> DataFrame:
    """Who owns what, from a folder of attributed-line dumps of all files."""
    return snapshot_entries(dump_lines(read_blame_dump(spark, blame)), read_author_config(spark, authors))


def range_entries_from_dumps(
    spark: SparkSession,
    blame: str,
    patch_log: str,
    parent_blame: str,
    authors: str | None = None,
    commit_of: str = r"([0-9a-f]{7,64})[^/]*/[^/]*$",
    from_start: bool = False,
) -> DataFrame:
    """Who changed what in a window and whose lines went, from folders of dumps.

    `blame` holds a dump of each file at the end of the window, limited to the window so
    that older lines are flagged as boundary (`from_start=True`: the window has no
    beginning, and no line is too old); `patch_log` the window's patches;
    `parent_blame` the lines each commit deleted, as they were attributed ahead of it,
    in a folder per commit: the first group of `commit_of` in a dump's path names it.
    """
    aliases = read_author_config(spark, authors)
    lines = dump_lines(read_blame_dump(spark, blame)).filter(is_code_file(F.col("path")))
    facts = window_facts(lines, aliases, boundary=None if from_start else "boundary")
    parents = dump_lines(read_blame_dump(spark, parent_blame)).select(
        F.regexp_extract("file", commit_of, 1).alias("commit_id"), "path", "line_no", "content", "raw_author"
    )
    hunks = read_patch_log(spark, patch_log)
    return ledger_entries(facts, window_losses(hunks, parents.distinct(), aliases))


def touch_losses(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    actor: str,
    type_: str,
    after: Column | None,
    until: Column | None,
    slices: Sequence[Column] | None = None,
    op: str | None = None,
) -> DataFrame:
    """type, author, deleted: displacements counted for whom they displaced."""
    return _lost(displacements(touches, keys, order, actor, after, until, slices, op, keep=[type_]), type_)


def _lost(displaced: DataFrame, type_: str) -> DataFrame:
    return displaced.groupBy(F.col(type_).alias("type"), F.col("displaced").alias("author")).agg(
        F.count(F.lit(1)).alias("deleted")
    )


def touch_entries(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    actor: str,
    type_: str,
    after: Column | None,
    until: Column | None,
    slices: Sequence[Column] | None = None,
    op: str | None = None,
) -> DataFrame:
    """The range report on any touch log: last touches are credited, displaced
    predecessors are debited."""
    last, displaced = last_and_displaced(touches, keys, order, actor, after, until, slices, op, keep=[type_])
    facts = last.select(
        F.col(type_).alias("type"), F.col(actor).alias("author"), F.lit(1).cast("bigint").alias("lines")
    )
    return ledger_entries(facts, _lost(displaced, type_))

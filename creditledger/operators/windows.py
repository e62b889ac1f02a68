"""Many windows or revisions of one log in a single pass.

The bounds of all windows cut the log into elementary intervals. Every row is reduced
within its interval first; a window is a range of intervals, and only what is left per
interval is combined per window. So the log is read and shuffled once, however many
windows overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditledger.functions.paths import file_language, file_type
from creditledger.operators.attribution import displacements
from creditledger.operators.identity import resolve_identity
from creditledger.operators.intervals import Intervals
from creditledger.operators.line_state import RUN_LINES, count_lines, countable
from creditledger.operators.rollup import DELETED, LINES

INTERVAL = "_interval"


class Span(NamedTuple):
    """A window (after, until] by name; None is open."""

    window: Any
    after: Any = None
    until: Any = None


def _intervals(spans: Sequence[Span], lit: Callable[[Any], Column]) -> Intervals:
    return Intervals([b for s in spans for b in (s.after, s.until) if b is not None], lit)


def _cover(spark: SparkSession, spans: Sequence[Span], intervals: Intervals) -> DataFrame:
    """window, interval: what each window is made of."""
    rows = [
        F.struct(F.lit(s.window).alias("window"), F.lit(first).alias("first"), F.lit(last).alias("last"))
        for s in spans
        for first, last in [intervals.span(s.after, s.until)]
        if first <= last
    ]
    if not rows:
        raise ValueError("no window holds anything")
    held = spark.range(1).select(F.explode(F.array(*rows)).alias("w")).select("w.*")
    return held.select("window", F.explode(F.sequence("first", "last")).alias(INTERVAL))


def _outer(spans: Sequence[Span], position: Column, lit: Callable[[Any], Column]) -> tuple[Column | None, Column | None]:
    """The bounds of all windows together, for the scan."""
    after = None if any(s.after is None for s in spans) else lit(min(s.after for s in spans))
    until = None if any(s.until is None for s in spans) else lit(max(s.until for s in spans))
    return after, until


def _within(position: Column, after: Column | None, until: Column | None) -> Column:
    held = F.lit(True)
    if after is not None:
        held = held & (position > after)
    return held if until is None else held & (position <= until)


def last_touch_by_window(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    spans: Sequence[Span],
    lit: Callable[[Any], Column] = F.lit,
    op: str | None = None,
) -> DataFrame:
    """window, keys, order, payload: `attribution.last_touch` of every window."""
    intervals = _intervals(spans, lit)
    position = F.col(order[0])
    ops = [op] if op and op not in payload else []
    latest = F.struct(*order, *payload, *ops)
    reduced = (
        touches.filter(_within(position, *_outer(spans, position, lit)))
        .withColumn(INTERVAL, intervals.of(position))
        .groupBy(*keys, INTERVAL)
        .agg(F.max(latest).alias("_latest"))
    )
    found = (
        reduced.join(_cover(touches.sparkSession, spans, intervals), INTERVAL)
        .groupBy("window", *keys)
        .agg(F.max("_latest").alias("_latest"))
    )
    alive = found if op is None else found.filter(F.col(f"_latest.{op}") != "delete")
    return alive.select("window", *keys, *(F.col(f"_latest.{name}").alias(name) for name in (*order, *payload)))


def touch_entries_by_window(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    actor: str,
    type_: str,
    spans: Sequence[Span],
    lit: Callable[[Any], Column] = F.lit,
    slices: Sequence[Column] | None = None,
    op: str | None = None,
) -> DataFrame:
    """window, type, author, entry, n: the ledger entries of every window. Who displaced
    whom does not depend on the window, so displacements are found once."""
    intervals = _intervals(spans, lit)
    position = F.col(order[0])
    after, until = _outer(spans, position, lit)
    facts = last_touch_by_window(touches, keys, order, [type_, actor], spans, lit, op)
    lost = (
        displacements(touches, keys, order, actor, after, until, slices, op, keep=[type_])
        .groupBy(F.col(type_).alias("type"), F.col("displaced").alias("author"), intervals.of(position).alias(INTERVAL))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(_cover(touches.sparkSession, spans, intervals), INTERVAL)
        .groupBy("window", "type", "author")
        .agg(F.sum("n").alias("n"))
        .select("window", "type", "author", F.lit(DELETED).alias("entry"), "n")
    )
    kept = (
        facts.groupBy("window", F.col(type_).alias("type"), F.col(actor).alias("author"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("window", "type", "author", F.lit(LINES).alias("entry"), "n")
    )
    return kept.unionByName(lost)


def net_by_window(entries: DataFrame) -> DataFrame:
    """window, type, author, lines, deleted, net."""
    booked = lambda entry: F.sum(F.when(F.col("entry") == entry, F.col("n")).otherwise(0))
    return (
        entries.groupBy("window", "type", "author")
        .agg(booked(LINES).alias("lines"), booked(DELETED).alias("deleted"))
        .withColumn("net", F.col("lines") - F.col("deleted"))
    )


def line_facts_by_window(
    lines: DataFrame,
    aliases: DataFrame,
    spans: Sequence[Span],
    keys: Sequence[str] = ("path",),
    path: str = "path",
    author: str = "raw_author",
    touch: str = "touch_seq",
    run_lines: int = RUN_LINES,
) -> DataFrame:
    """window, keys, type, lines, author, language: `facts.window_facts` of windows that
    end with the text as it is in `lines` (`until` is None) and begin anywhere."""
    if any(s.until is not None for s in spans):
        raise ValueError("the text is that of one revision, so windows differ in their beginning only")
    intervals = _intervals(spans, F.lit)
    counted = count_lines(
        lines.withColumn(INTERVAL, intervals.of(F.col(touch))), keys, by=[author, INTERVAL], run_lines=run_lines
    )
    return (
        resolve_identity(counted, author, aliases, into="author")
        .withColumn("type", file_type(F.col(path)))
        .withColumn("lines", countable(F.col("type")))
        .filter(F.col("lines") > 0)
        .groupBy(*keys, "type", "author", INTERVAL)
        .agg(F.sum("lines").alias("lines"))
        .join(_cover(lines.sparkSession, spans, intervals), INTERVAL)
        .groupBy("window", *keys, "type", "author")
        .agg(F.sum("lines").alias("lines"))
        .select("window", *keys, "type", "lines", "author", file_language(F.col(path)).alias("language"))
    )


def manifests_at(
    changes: DataFrame,
    revisions: Sequence[tuple[Any, Any]],
    keys: Sequence[str] = ("path",),
    order: Sequence[str] = ("seq",),
    content_id: str = "content_id",
    lit: Callable[[Any], Column] = F.lit,
) -> DataFrame:
    """revision, keys, content_id: what exists at every revision (name, position), from a
    log of changes; a null content_id removes.

    Changes between two revisions are reduced to the last before the shuffle. What is
    left is valid from its revision until the key's next change: at most one row per
    key and revision is ever sorted.
    """
    intervals = Intervals([at for _, at in revisions], lit)
    n = len(intervals.bounds)
    position = F.col(order[0])
    last = (
        changes.filter(position <= lit(intervals.bounds[-1]))
        .withColumn(INTERVAL, intervals.of(position))
        .groupBy(*keys, INTERVAL)
        .agg(F.max(F.struct(*order, content_id)).getField(content_id).alias(content_id))
    )
    until = F.coalesce(F.lead(INTERVAL).over(Window.partitionBy(*keys).orderBy(INTERVAL)), F.lit(n))
    valid = last.withColumn("_until", until).filter(F.col(content_id).isNotNull())
    names = [F.struct(F.lit(name).alias("revision"), F.lit(intervals.bounds.index(at)).alias(INTERVAL)) for name, at in revisions]
    named = changes.sparkSession.range(1).select(F.explode(F.array(*names)).alias("r")).select("r.*")
    return (
        valid.select(*keys, content_id, F.explode(F.sequence(F.col(INTERVAL), F.col("_until") - 1)).alias(INTERVAL))
        .join(named, INTERVAL)
        .select("revision", *keys, content_id)
    )


def touched_between(
    changes: DataFrame,
    first: Any,
    last: Any,
    keys: Sequence[str] = ("path",),
    order: Sequence[str] = ("seq",),
    content_id: str = "content_id",
    lit: Callable[[Any], Column] = F.lit,
) -> DataFrame:
    """keys: what was added, removed or changed between two positions of the log; what
    was changed back is not among them. `first=None` gives all that exists at `last`."""
    if first is None:
        return manifests_at(changes, [(1, last)], keys, order, content_id, lit).select(*keys)
    both = manifests_at(changes, [(0, first), (1, last)], keys, order, content_id, lit)
    at = lambda revision: F.max(F.when(F.col("revision") == revision, F.col(content_id)))
    return both.groupBy(*keys).agg(at(0).alias("_old"), at(1).alias("_new")).filter("NOT (_old <=> _new)").select(*keys)

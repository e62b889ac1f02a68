"""Last touch and displacement on any log of touches.

A touch is one row: something (`keys`) was changed by an `actor` at a position
given by the `order` columns, of which the first is the one windows refer to.
Windows are half open, (after, until]; `after=None` means from the beginning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditledger.operators.intervals import Intervals
from creditledger.operators.joins import null_safe_join


def _bounds(position: str, after: Column | None, until: Column | None) -> Column:
    bound = F.lit(True)
    if after is not None:
        bound = bound & (F.col(position) > after)
    if until is not None:
        bound = bound & (F.col(position) <= until)
    return bound


def last_touch(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    after: Column | None = None,
    until: Column | None = None,
    op: str | None = None,
) -> DataFrame:
    """One row per key that still exists at `until` and was last touched in the
    window: keys, order, payload.

    A touch in the window is later than every touch before it, so the lower
    bound can go to the scan together with the upper one. The maximum is an
    aggregate, not a ranking: every task reduces a hot key to one row before
    the shuffle.
    """
    ops = [op] if op and op not in payload else []
    latest = (
        touches.filter(_bounds(order[0], after, until))
        .groupBy(*keys)
        .agg(F.max(F.struct(*order, *payload, *ops)).alias("_latest"))
    )
    alive = latest if op is None else latest.filter(F.col(f"_latest.{op}") != "delete")
    return alive.select(*keys, *(F.col(f"_latest.{name}").alias(name) for name in (*order, *payload)))


def _slice_chain(
    rows: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    slices: Sequence[str],
    ends: DataFrame | None = None,
) -> DataFrame:
    """Adds `_prev` to `rows`: `value` of the row before, by key and order.

    With slices (columns that never decrease along `order`, finest first) only
    rows of one slice are sorted together. The first row of a slice takes the
    last value of the slice before it, found the same way one level up from
    `history`. There the slices may be NULL, which sorts before all others:
    that is how rows ahead of `rows` hand over their last value. `ends`, if known, is
    the last value of each slice of `history`.
    """
    if not slices:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_prev", F.lag(value).over(ordered))
    fine, coarser = slices[0], slices[1:]
    ordered = Window.partitionBy(*keys, fine).orderBy(*order)
    if ends is None:
        ends = history.groupBy(*keys, *slices).agg(
            F.max(F.struct(*order, value)).getField(value).alias(value)
        )
    carried = _slice_chain(ends, ends, keys, [fine], value, coarser).select(
        *keys, fine, F.col("_prev").alias("_carried")
    )
    return (
        null_safe_join(rows.withColumn("_prev", F.lag(value).over(ordered)), carried, [*keys, fine], "left")
        .withColumn("_prev", F.coalesce("_prev", "_carried"))
        .drop("_carried")
    )


#: Ranges that positions without a natural unit are cut into, how many of them make a
#: coarser slice, and positions drawn to find their bounds.
QUANTILES, COARSER, DRAWN = 256, 32, 16_384


def quantile_slices(touches: DataFrame, position: str) -> list[Column]:
    """Slices between quantiles of the positions, for those that can only be compared
    (texts, decimals, floats). The quantiles are those of DRAWN positions drawn at
    random; they only decide how even the slices are, not what comes out."""
    drawn = touches.select(F.col(position).alias("p")).filter("p IS NOT NULL").orderBy(F.rand(1)).limit(DRAWN)
    values = sorted(v for (v,) in drawn.collect() if v == v)
    bounds = values[:: max(1, len(values) // QUANTILES)]
    if not bounds:
        return []
    kind = touches.schema[position].dataType
    fine = Intervals(bounds, lambda v: F.lit(v).cast(kind)).of(F.col(position))
    return [fine, F.floor(fine / COARSER)]


def default_slices(touches: DataFrame, position: str) -> list[Column]:
    """Slices of a time (hours, days), a date (days, 32 days) or a whole number (4096,
    about a million); by quantiles for other types, which draws from `touches`."""
    at, kind = F.col(position), touches.schema[position].dataType
    if isinstance(kind, T.TimestampType):
        seconds = F.unix_micros(at) / 1_000_000
        return [F.floor(seconds / 3600), F.floor(seconds / 86400)]
    if isinstance(kind, T.TimestampNTZType):
        day = F.datediff(at, F.lit("1970-01-01").cast("date"))
        return [day * 24 + F.hour(at), day]
    if isinstance(kind, T.DateType):
        day = F.datediff(at, F.lit("1970-01-01").cast("date"))
        return [day, F.floor(day / 32)]
    if isinstance(kind, T.IntegralType):
        return [F.floor(at / (1 << 12)), F.floor(at / (1 << 20))]
    if isinstance(kind, T.StringType | T.DecimalType | T.FractionalType):
        return quantile_slices(touches, position)
    return []


def displacements(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    actor: str,
    after: Column | None = None,
    until: Column | None = None,
    slices: Sequence[Column] | None = None,
    op: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each touch in the window that replaced somebody else's: keys, order,
    `keep`, `actor` and `displaced`, who made the touch before it.

    `slices` are expressions that never decrease along the order, finest first,
    such as the hour and the day of a time stamp; choose the finest so that one
    slice of the busiest key fits into a task. Without any, `default_slices` are
    taken; an empty list sorts the whole window of a key in one task. Touches ahead of the window are
    reduced to the last one per key before any shuffle; only the window itself
    is sorted.
    """
    history, names = _history(touches, keys, order, actor, after, until, slices, op, keep)
    in_window = _bounds(order[0], after, None)
    chained = _slice_chain(history.filter(in_window), history, keys, order, "_state", names)
    return _replaced(chained, keys, order, actor, keep)


def _history(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    actor: str,
    after: Column | None,
    until: Column | None,
    slices: Sequence[Column] | None,
    op: str | None,
    keep: Sequence[str],
) -> tuple[DataFrame, list[str]]:
    """Touches up to the window's end with `_state` and slices (NULL ahead of the window)."""
    if slices is None:
        slices = default_slices(touches, order[0])
    names = [f"_slice{i}" for i in range(max(len(slices), 1))]
    in_window = _bounds(order[0], after, None)
    state = F.struct(F.col(actor).alias("who"), (F.col(op) if op else F.lit("change")).alias("what"))
    history = touches.filter(_bounds(order[0], None, until)).select(
        *keys,
        *order,
        *keep,
        actor,
        state.alias("_state"),
        *(F.when(in_window, s).alias(n) for s, n in zip(slices or [F.lit(0)], names)),
    )
    return history, names


def _replaced(chained: DataFrame, keys: Sequence[str], order: Sequence[str], actor: str, keep: Sequence[str]) -> DataFrame:
    return chained.filter(
        (F.col("_prev.what") != "delete") & (F.col("_prev.who") != F.col(actor))
    ).select(*keys, *order, *keep, actor, F.col("_prev.who").alias("displaced"))


def last_and_displaced(
    touches: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    actor: str,
    after: Column | None = None,
    until: Column | None = None,
    slices: Sequence[Column] | None = None,
    op: str | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """`last_touch` (keys, order, `keep`, `actor`) and `displacements` of one window.

    The last touch of a window is the latest of its slices' ends, which displacements
    need anyway: both come from one aggregation, and the log is scanned twice, not three
    times.
    """
    history, names = _history(touches, keys, order, actor, after, until, slices, op, keep)
    ends = history.groupBy(*keys, *names).agg(F.max(F.struct(*order, "_state", *keep)).alias("_end"))
    # Not a filter on the slices: it would go below the aggregation and part the two uses of it.
    inside = F.col("_end") if after is None else F.when(F.col(names[0]).isNotNull(), F.col("_end"))
    latest = ends.groupBy(*keys).agg(F.max(inside).alias("_end")).filter(F.col("_end").isNotNull())
    alive = latest.filter(F.col("_end._state.what") != "delete") if op else latest
    last = alive.select(*keys, *(F.col(f"_end.{c}").alias(c) for c in (*order, *keep)), F.col("_end._state.who").alias(actor))
    states = ends.select(*keys, *names, F.col("_end._state").alias("_state"))
    rows = history.filter(_bounds(order[0], after, None))
    chained = _slice_chain(rows, history, keys, order, "_state", names, states)
    return last, _replaced(chained, keys, order, actor, keep)

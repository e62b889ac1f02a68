"""Where a position lies between given bounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Intervals:
    """The elementary intervals between `bounds`, values that Python can sort; `lit`
    makes them columns. Interval i holds what is beyond bound i - 1, up to bound i."""

    def __init__(self, bounds: Sequence[Any], lit: Callable[[Any], Column] = F.lit):
        self.bounds = sorted(set(bounds))
        self.lit = lit

    def of(self, position: Column) -> Column:
        """Found by halving, as one nested CASE."""

        def within(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(position <= self.lit(self.bounds[middle]), within(low, middle)).otherwise(within(middle + 1, high))

        return within(0, len(self.bounds))

    def span(self, after: Any, until: Any) -> tuple[int, int]:
        """The first and last interval of (after, until]; none if first > last."""
        first = 0 if after is None else self.bounds.index(after) + 1
        last = len(self.bounds) if until is None else self.bounds.index(until)
        return first, last

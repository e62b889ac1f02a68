"""How many rows were left out, and why, counted while they pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Dropped:
    """Counts by cause. Operators that take one hang counters on the rows they read
    anyway; `counts()` is there once an action on their result has run, and waits for it.
    No table is read again for them."""

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, dict[str, int]]] = []

    def watch(self, rows: DataFrame, signs: dict[str, int] | None = None, **causes: Column) -> DataFrame:
        """`rows`, counting those for which each of `causes` holds. A cause counted at
        several places adds up, with a sign of its own at each: what came in less what
        went on."""
        observation = Observation()
        self._seen.append((observation, {c: (signs or {}).get(c, 1) for c in causes}))
        return rows.observe(observation, *(F.count_if(F.coalesce(hit, F.lit(False))).alias(c) for c, hit in causes.items()))

    def counts(self) -> dict[str, int]:
        total: dict[str, int] = {}
        for observation, signs in self._seen:
            for cause, n in observation.get.items():
                total[cause] = total.get(cause, 0) + signs[cause] * n
        return total

"""Order as data: the number of every row in a total order."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.session import stored


def numbered(rows: DataFrame, order: Sequence[Column], into: str = "row_no") -> DataFrame:
    """Adds `into`, from 1, to `rows` by `order`.

    Rows are dealt into ranges and sorted there, so that no task has more than a range,
    and written out, as ranges are found by sampling and must not change any more. A
    row's number is its place in its range after all rows of the ranges ahead. The
    driver adds up one count per range. Rows that `order` does not tell apart share a
    range and are numbered in any order.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the id are the partition, the lower ones count its rows.
    settled = stored(dealt.withColumns({"_part": part, "_at": at - F.shiftleft(part.cast("bigint"), 33)}))
    counts = dict(settled.groupBy("_part").count().collect())
    if not counts:
        return settled.withColumn(into, F.lit(0).cast("bigint")).drop("_part", "_at")
    sizes = [counts.get(p, 0) for p in range(max(counts) + 1)]
    ahead = F.array(*(F.lit(n).cast("bigint") for n in accumulate([0, *sizes[:-1]])))
    return settled.withColumn(into, F.get(ahead, F.col("_part")) + F.col("_at") + 1).drop("_part", "_at")

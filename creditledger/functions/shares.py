"""Shares and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Percent of a whole as double; 0 when there is no whole to share."""
    scaled = part.cast("double") * F.lit(100.0)
    return F.coalesce(scaled / F.nullif(whole, F.lit(0)).cast("double"), F.lit(0.0))


def share_text(value: Column) -> Column:
    """Two decimals, ties to even on the exact double: '12.34%'."""
    return F.concat(F.format_string("%s", F.call_function("format_number", value, F.lit("0.00"))), F.lit("%"))

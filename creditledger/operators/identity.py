"""Many spellings, one person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.functions.fixed_values import WHITE_SPACE


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(kind, alias_lower, canonical): a repeated alias means its last entry."""
    return aliases.groupBy("kind", "alias_lower").agg(
        F.max_by("canonical", "ord").alias("canonical")
    )


def resolve_identity(
    df: DataFrame, actor: str, aliases: DataFrame, into: str | None = None
) -> DataFrame:
    """Replace `actor` by its canonical name (or write it to `into`).

    The whole text as a name, then the address in angle brackets, then the name
    before the bracket; otherwise the text itself. '' and 'unknown' stay.

    Alias tables are unique per key, so the three left joins add no rows. They
    carry no hint: Spark broadcasts an alias table whose measured size is under
    its threshold and shuffles otherwise, where AQE splits hot actors. Callers
    in this package aggregate by actor first.
    """
    unique = unique_aliases(aliases)
    names = unique.filter(F.col("kind") == "name")
    emails = unique.filter(F.col("kind") == "email")
    who = F.col(actor)
    usable = ~who.isin("", "unknown")
    address = F.regexp_extract(who, r"<([^>]+)>", 1)
    short = F.trim(F.substring_index(who, "<", 1), F.lit(WHITE_SPACE))
    looked_up = (
        df.withColumn("_full", F.when(usable, F.lower(who)))
        .withColumn("_mail", F.when(usable & (address != ""), F.lower(address)))
        .withColumn("_short", F.when(usable & who.contains("<"), F.lower(short)))
    )
    for key, table in (("_full", names), ("_mail", emails), ("_short", names)):
        side = table.select(F.col("alias_lower").alias(key), F.col("canonical").alias(key + "_hit"))
        looked_up = looked_up.join(side, key, "left")
    canonical = F.coalesce("_full_hit", "_mail_hit", "_short_hit", who)
    return looked_up.withColumn(into or actor, canonical).drop(
        *(key + end for key in ("_full", "_mail", "_short") for end in ("", "_hit"))
    )

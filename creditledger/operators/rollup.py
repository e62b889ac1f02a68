"""Ledger entries and the report rolled up from them.

Entries are kept in long form, (type, author, entry, n) with entry 'lines' or
'deleted'. Every level of the report reads all four columns, so the aggregation
of the source, the only large step, is planned as one exchange that all levels
reuse; nothing above it is larger than the number of (type, author) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.operators.joins import null_safe_join
from creditledger.functions.shares import share, share_text

LINES, DELETED = "lines", "deleted"

_PAIR, _TYPE, _AUTHOR, _TOTAL = 0, 1, 2, 3


def _booked(entry: str) -> Column:
    return F.sum(F.when(F.col("entry") == entry, F.col("n")).otherwise(F.lit(0)))


def ledger_entries(facts: DataFrame, losses: DataFrame | None = None) -> DataFrame:
    """Totals per (type, author, entry) of facts(type, author, lines) and
    losses(type, author, deleted).

    Whoever appears on one side only is simply missing the other entry, which
    is what a full outer join of two aggregates gives, for one shuffle.
    """
    booked = facts.select("type", "author", F.lit(LINES).alias("entry"), F.col("lines").alias("n"))
    if losses is not None:
        booked = booked.unionByName(
            losses.select("type", "author", F.lit(DELETED).alias("entry"), F.col("deleted").alias("n"))
        )
    return booked.groupBy("type", "author", "entry").agg(F.sum("n").cast("bigint").alias("n"))


def contributions(entries: DataFrame) -> DataFrame:
    """type, author, lines, deleted, net: one row per pair."""
    return (
        entries.groupBy("type", "author")
        .agg(_booked(LINES).alias("lines"), _booked(DELETED).alias("deleted"))
        .withColumn("net", F.col("lines") - F.col("deleted"))
    )


def rollup(entries: DataFrame) -> DataFrame:
    """All four levels in one pass: level 0 (type, author), 1 type, 2 author, 3 total."""
    return (
        entries.groupingSets(
            [
                [F.col("type"), F.col("author")],
                [F.col("type")],
                [F.col("author")],
                [],
            ],
            F.col("type"),
            F.col("author"),
        )
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.coalesce(_booked(LINES), F.lit(0)).alias("lines"),
            F.coalesce(_booked(DELETED), F.lit(0)).alias("deleted"),
        )
        .withColumn("net", F.col("lines") - F.col("deleted"))
    )


def share_in_group(entries: DataFrame) -> DataFrame:
    """Each pair with its share of its type: joined to the type totals rather
    than windowed, so a type with most of the authors is no single task."""
    totals = entries.groupBy("type").agg(_booked(LINES).alias("group_lines"))
    return (
        null_safe_join(contributions(entries), totals, ["type"])
        .select(
            "type",
            "author",
            "lines",
            "group_lines",
            share(F.col("lines"), F.col("group_lines")).alias("share"),
        )
    )


def report(entries: DataFrame, with_losses: bool) -> DataFrame:
    """The report in long form, one row per line of it.

    section, type, author, lines, share, percent, deleted, net, and the sort
    columns of `in_report_order`. Without losses `deleted` and `net` are NULL.
    """
    # What a row is a share of: its type for a pair, otherwise the grand total.
    wholes = (
        entries.groupingSets([[F.col("type")], []], F.col("type"))
        .agg(F.grouping_id().cast("int").alias("_over_all"), _booked(LINES).alias("whole"))
        .withColumnRenamed("type", "_whole_type")
    )
    level = F.col("level")
    sections = (
        F.when(level == _PAIR, F.array(F.lit("by_author_and_type")))
        .when(level == _TYPE, F.array(F.lit("by_author_and_type_total"), F.lit("by_type")))
        .when(level == _AUTHOR, F.array(F.lit("by_author")))
        .otherwise(F.array(F.lit("total")))
    )
    section = F.col("section")
    grouped = section.isin("by_author_and_type_total", "by_author_and_type")
    value = F.when(section.isin("by_author_and_type_total", "total"), F.lit(100.0)).otherwise(
        share(F.col("lines"), F.col("whole"))
    )
    rows = (
        rollup(entries)
        .withColumn("_of", F.when(level == _PAIR, 0).otherwise(1))
        .join(
            wholes,
            (F.col("_of") == F.col("_over_all"))
            & F.when(level == _PAIR, F.col("type")).eqNullSafe(F.col("_whole_type")),
            "left",
        )
        .withColumn("section", F.explode(sections))
        .withColumn("share", value)
    )
    order_value = F.col("net") if with_losses else F.col("lines")
    return rows.select(
        "section",
        "type",
        "author",
        "lines",
        "share",
        share_text(F.col("share")).alias("percent"),
        (F.col("deleted") if with_losses else F.lit(None).cast("bigint")).alias("deleted"),
        (F.col("net") if with_losses else F.lit(None).cast("bigint")).alias("net"),
        F.when(grouped, 0)
        .when(section == "by_type", 1)
        .when(section == "by_author", 2)
        .otherwise(3)
        .alias("_block"),
        F.when(section == "by_author_and_type", F.col("whole"))
        .when(grouped | (section == "by_type"), F.col("lines"))
        .alias("_group"),
        (section == "by_author_and_type").cast("int").alias("_member"),
        F.when(section == "by_author", order_value).otherwise(F.col("lines")).alias("_value"),
    )


SORT_COLUMNS = ("_block", "_group", "_member", "_value")


def report_order() -> list[Column]:
    """Groups by their lines, largest first, each total row ahead of its authors;
    then types by lines, authors by lines (by net with losses), and the total."""
    return [F.asc("_block"), F.desc("_group"), F.asc("type"), F.asc("_member"), F.desc("_value"), F.asc("author")]


def in_report_order(rows: DataFrame, *first: Column) -> DataFrame:
    """Rows as `report_order` has them, by a range-partitioned sort: large reports come
    out as several ordered parts."""
    return rows.orderBy(*first, *report_order())


def flat_rows(rows: DataFrame, with_losses: bool) -> DataFrame:
    """The flat table: category, type, author, lines, percent (, deleted, sum)."""
    extra = [F.col("deleted"), F.col("net").alias("sum")] if with_losses else []
    return rows.select(
        F.col("section").alias("category"), "type", "author", "lines", "percent", *extra, *SORT_COLUMNS
    )


def table_rows(rows: DataFrame, with_losses: bool) -> DataFrame:
    """The same rows for display: group totals are authored '(total)' and empty
    cells are text."""
    shown = F.when(F.col("section") == "by_author_and_type_total", F.lit("(total)")).otherwise(
        F.coalesce(F.col("author").cast("string"), F.lit(""))
    )
    cells = ["lines", *(["deleted", "net"] if with_losses else [])]
    return rows.select(
        "section",
        F.coalesce(F.col("type"), F.lit("")).alias("type"),
        shown.alias("author"),
        "percent",
        *(cell_text(F.col(name)).alias(name) for name in cells),
        *SORT_COLUMNS,
    )


def cell_text(value: Column) -> Column:
    """A number as text, '' where it does not apply; 0 stays '0'."""
    return F.coalesce(value.cast("string"), F.lit(""))

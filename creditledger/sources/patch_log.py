"""Patch logs (`git log -p --unified=0`) as a table of deleted hunks.

The log is written with a marker line per commit, `<marker><hash><tab><author>`.
`read_patch_log` reads it line by line, so that a log splits anywhere, inside a commit
and inside a file: what a line needs from the lines before it (the commit, the path)
is carried within its input split, and from split to split by a scan of one summary
row per split. Only header lines are shuffled, never the text. `parse_patch_records`
is for tables that hold one commit per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditledger.functions.paths import is_code_file, unquoted_path
from creditledger.sources.files import read_records

COMMIT_MARKER = "@@COMMIT@@:"

# The layout of a patch.
_FILE_START = "\ndiff --git "
_HUNK = r"\n@@ -(\d+(?:,\d+)?) \+\d+(?:,\d+)? @@"
_FILE_LINE, _OLD_LINE, _HUNK_LINE = "diff --git ", "--- ", "@@ "


def read_patch_records(spark: SparkSession, path: str, marker: str = COMMIT_MARKER) -> DataFrame:
    """value: `<hash><tab><author>` and the patch of one commit."""
    first = F.when(F.col("value").startswith(marker), F.substring("value", len(marker) + 1, 2**31 - 1))
    return (
        read_records(spark, path, "\n" + marker)
        .select(first.otherwise(F.col("value")).alias("value"))
        .filter(F.col("value") != "")
    )


def parse_patch_records(records: DataFrame) -> DataFrame:
    """commit_id, deleting_author, path, start, cnt: hunks that delete lines of
    code files. A header is only looked for ahead of the first hunk of a file,
    where no text of the file can pass for one."""
    first_line = F.substring_index("value", "\n", 1)
    patch = F.col("_patch")
    head = F.concat(F.lit("\n"), F.split(patch, r"\n@@ ", 2)[0], F.lit("\n"))
    old = F.regexp_extract(head, r"\n--- ([^\n]*)\n", 1)
    old = _old_path(old)
    ranges = F.split(F.col("_range"), ",")
    return (
        records.select(
            F.substring_index(first_line, "\t", 1).alias("commit_id"),
            F.when(first_line.contains("\t"), F.regexp_replace(first_line, r"^[^\t]*\t", ""))
            .otherwise(F.lit(""))
            .alias("deleting_author"),
            F.explode(F.slice(F.split("value", _FILE_START), 2, 2**31 - 1)).alias("_patch"),
        )
        .select("commit_id", "deleting_author", old.alias("path"), "_patch")
        .filter((F.col("path") != "") & (F.col("path") != "/dev/null") & is_code_file(F.col("path")))
        .select(
            "commit_id",
            "deleting_author",
            "path",
            F.explode(F.regexp_extract_all(patch, F.lit(_HUNK), F.lit(1))).alias("_range"),
        )
        .select(
            "commit_id",
            "deleting_author",
            "path",
            ranges[0].cast("bigint").alias("start"),
            F.coalesce(F.try_element_at(ranges, F.lit(2)).cast("bigint"), F.lit(1)).alias("cnt"),
        )
        .filter(F.col("cnt") > 0)
    )


def _old_path(header: Column) -> Column:
    """The path of a `--- ` header, without quotes, prefix and the tab behind it."""
    return F.regexp_replace(unquoted_path(F.regexp_replace(header, r"\t+$", "")), "^a/", "")


def _in_force(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds `path`, `stopped` and `started` as they stand after each row: `path` is the
    first `_path` since the last `_start` that no `_stop` came before, `stopped` whether
    a `_stop` came since then, `started` whether there was a `_start` at all."""
    past = Window.partitionBy(*keys).orderBy(order)
    here, before = past.rowsBetween(Window.unboundedPreceding, 0), past.rowsBetween(Window.unboundedPreceding, -1)
    place = F.col(order)

    def latest(flag: Column, window) -> Column:
        return F.last(F.when(flag, place), ignorenulls=True).over(window)

    def since(at: Column) -> Column:
        return at.isNotNull() & (F.col("_from").isNull() | (at >= F.col("_from")))

    rows = rows.select("*", latest(F.col("_start"), here).alias("_from"), latest(F.col("_stop"), before).alias("_stopped"))
    fresh = F.col("_path").isNotNull() & (F.col("_start") | ~since(F.col("_stopped")))
    rows = rows.withColumn("_fresh", fresh)
    rows = rows.withColumn("_first", F.col("_fresh") & (F.col("_start") | ~since(latest(F.col("_fresh"), before))))
    chosen = F.last(F.when(F.col("_first"), F.struct(place.alias("at"), F.col("_path").alias("path"))), ignorenulls=True).over(here)
    return (
        rows.withColumns({"_chosen": chosen, "_halt": latest(F.col("_stop"), here)})
        .withColumns(
            {
                "path": F.when(since(F.col("_chosen.at")), F.col("_chosen.path")),
                "stopped": since(F.col("_halt")),
                "started": F.col("_from").isNotNull(),
            }
        )
        .drop("_from", "_stopped", "_fresh", "_first", "_chosen", "_halt", "_start", "_stop", "_path")
    )


def parse_patch_lines(lines: DataFrame, marker: str = COMMIT_MARKER) -> DataFrame:
    """commit_id, deleting_author, path, start, cnt: hunks that delete lines of code
    files, from rows (file, split, seq, value) of one line each.

    A path is the first `--- ` header since the last `diff` or commit line, ahead of the
    first hunk: no text of a file can pass for one. Hunks ahead of the first commit line
    of a log have no commit (null). Lines of one split are sorted together, and the
    summaries of one log's splits.
    """
    value = F.col("value")
    commit_line, hunk_line = value.startswith(marker), value.startswith(_HUNK_LINE)
    start, old = commit_line | value.startswith(_FILE_LINE), value.startswith(_OLD_LINE)
    # Said here, as the join below would say it of one of its sides only, and part them.
    placed = F.col("file").isNotNull() & F.col("split").isNotNull()
    heads = lines.filter(placed & (start | hunk_line | old)).select(
        "file",
        "split",
        "seq",
        F.when(commit_line, F.substring(value, len(marker) + 1, 2**31 - 1)).alias("_commit"),
        start.alias("_start"),
        F.when(old & ~commit_line, F.substring(value, len(_OLD_LINE) + 1, 2**31 - 1)).alias("_path"),
        (hunk_line & ~commit_line).alias("_stop"),
        F.regexp_extract(value, r"^@@ -(\d+(?:,\d+)?) \+\d+(?:,\d+)? @@", 1).alias("range"),
    )
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.withColumn("commit", F.last("_commit", ignorenulls=True).over(inside))
    known = _in_force(heads.drop("_commit"), ["file", "split"], "seq")
    # With `range`, both uses of `known` read the same columns, hence one exchange.
    end = F.max_by(F.struct("commit", "path", "stopped", "started", "range"), "seq")
    ends = known.groupBy("file", "split").agg(end.alias("end")).select(
        "file", "split", "end.commit", F.col("end.started").alias("_start"), F.col("end.path").alias("_path"), F.col("end.stopped").alias("_stop")
    )
    along = Window.partitionBy("file").orderBy("split")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = _in_force(ends.withColumn("carried_commit", F.last("commit", ignorenulls=True).over(before)), ["file"], "split").select(
        "file",
        "split",
        "carried_commit",
        F.lag("path").over(along).alias("carried_path"),
        F.coalesce(F.lag("stopped").over(along), F.lit(False)).alias("carried_stopped"),
    )
    path = F.when(F.col("started"), F.col("path")).otherwise(
        F.coalesce("carried_path", F.when(~F.col("carried_stopped"), F.col("path")))
    )
    commit = F.coalesce("commit", "carried_commit")
    ranges = F.split("range", ",")
    return (
        known.filter("range <> ''")
        .join(carried, ["file", "split"])
        .select(
            F.substring_index(commit, "\t", 1).alias("commit_id"),
            F.when(commit.contains("\t"), F.regexp_replace(commit, r"^[^\t]*\t", ""))
            .when(commit.isNotNull(), F.lit(""))
            .alias("deleting_author"),
            _old_path(path).alias("path"),
            ranges[0].cast("bigint").alias("start"),
            F.coalesce(F.try_element_at(ranges, F.lit(2)).cast("bigint"), F.lit(1)).alias("cnt"),
        )
        .filter((F.col("cnt") > 0) & (F.col("path") != "") & (F.col("path") != "/dev/null") & is_code_file(F.col("path")))
    )


def read_patch_log(spark: SparkSession, path: str, marker: str = COMMIT_MARKER) -> DataFrame:
    return parse_patch_lines(read_records(spark, path, "\n"), marker)

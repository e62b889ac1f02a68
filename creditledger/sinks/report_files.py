"""Writing a report: flat CSV and one nested JSON document.

Both are range-sorted and written by as many tasks as the report needs; a small
report comes out as a single part, a large one as parts. The concatenation of the
JSON parts in name order is the document; CSV parts each repeat the header, as Spark's
own reader expects of the files of one table. No group of rows is ever gathered into one
value.

Both outputs appear or neither: they are written to a folder aside and renamed when both
are whole. Between the two renames a note lies beside them; a run that finds it knows
that the outputs there are half of a run that died, and takes them away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.operators.rollup import LINES, flat_rows, in_report_order, report
from creditledger.session import ensure_checkpoint_dir
from creditledger.sources.files import path_exists

CSV_NAME, JSON_NAME = "report_csv", "report_json"
#: Where outputs are written first, and the note that they are being renamed.
STAGED_NAME, NOTE_NAME = "_report_staged", "_report_renaming"


def check_outputs_absent(spark, folder: str) -> None:
    """Fail before any work if one of the outputs exists."""
    for name in (CSV_NAME, JSON_NAME):
        if path_exists(spark, f"{folder}/{name}"):
            raise FileExistsError(f"{folder}/{name} already exists")


def _fields(*pairs: tuple[str, str], with_losses: bool) -> Column:
    losses = [("deleted", "deleted"), ("net", "sum")] if with_losses else []
    return F.to_json(F.struct(*(F.col(c).alias(name) for c, name in (*pairs, *losses))))


def _line(place: int, text: Column, member: int = 0) -> Column:
    return F.struct(
        F.lit(place).alias("_place"), F.lit(member).alias("_member"), text.alias("line")
    )


def json_document(rows: DataFrame, with_losses: bool) -> DataFrame:
    """The nested document as ordered text lines: `line` and its sort columns.

    {"by_author_and_type": [{type, total_lines, authors: [...]}], "by_type",
    "by_author", "total"}. Every element is a line of its own; the group total
    row also opens and closes its group. Elements are separated by a comma in
    front of all but the first of their list, which is the minimum of its sort
    columns.
    """
    section = F.col("section")
    # First of each list: by list for groups, types and authors, by type inside a group.
    listed = rows.filter(~section.isin("total")).withColumn(
        "_list", F.when(section == "by_author_and_type", F.col("type"))
    )
    rank = F.struct(
        (-F.coalesce(F.col("_group"), F.lit(0))).alias("g"),
        F.col("type").alias("t"),
        (-F.col("_value")).alias("v"),
        F.col("author").alias("a"),
    )
    firsts = listed.groupBy("section", "_list").agg(F.min(rank).alias("_first"))
    keyed = rows.withColumn("_list", F.when(section == "by_author_and_type", F.col("type")))
    joined = keyed.join(
        firsts.select(F.col("section").alias("_s"), F.col("_list").alias("_l"), "_first"),
        (F.col("section") == F.col("_s")) & F.col("_list").eqNullSafe(F.col("_l")),
        "left",
    )
    comma = F.when(rank.eqNullSafe(F.col("_first")), F.lit("")).otherwise(F.lit(","))
    total_names = {"lines": "total_lines", "deleted": "total_deleted", "net": "total_sum"}
    total = F.to_json(
        F.struct(
            *(
                F.col(c).alias(name)
                for c, name in total_names.items()
                if with_losses or c == "lines"
            )
        )
    )
    group_open = F.concat(
        comma,
        F.expr("regexp_replace(to_json(struct(type, lines AS total_lines)), '[}]$', ',\"authors\":[')"),
    )
    pair = F.concat(comma, _fields(("author", "author"), ("lines", "lines"), ("percent", "percent"), with_losses=with_losses))
    type_ = F.concat(comma, _fields(("type", "type"), ("lines", "lines"), ("percent", "percent"), with_losses=with_losses))
    return (
        joined.withColumn(
            "_out",
            F.when(section == "by_author_and_type_total", F.array(_line(1, group_open, 0), _line(1, F.lit("]}"), 2)))
            .when(section == "by_author_and_type", F.array(_line(1, pair, 1)))
            .when(section == "by_type", F.array(_line(3, type_)))
            .when(section == "by_author", F.array(_line(5, pair)))
            .otherwise(
                F.array(
                    _line(0, F.lit('{"by_author_and_type":[')),
                    _line(2, F.lit('],"by_type":[')),
                    _line(4, F.lit('],"by_author":[')),
                    _line(6, F.concat(F.lit('],"total":'), total, F.lit("}"))),
                )
            ),
        )
        .drop("_member")
        .select("*", F.explode("_out").alias("_piece"))
        .select("type", "author", "_block", "_group", "_value", "_piece.*")
    )


def write_csv(rows: DataFrame, path: str, with_losses: bool) -> None:
    flat = in_report_order(flat_rows(rows, with_losses))
    columns = [c for c in flat.columns if not c.startswith("_")]
    flat.select(*columns).write.mode("errorifexists").csv(
        path,
        header=True,
        nullValue="",
        emptyValue="",
        escape='"',
        # Blanks at the ends of a name are part of it.
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(rows: DataFrame, path: str, with_losses: bool) -> None:
    document = in_report_order(json_document(rows, with_losses), F.col("_place"))
    document.select("line").write.mode("errorifexists").text(path)


def _store(spark, folder: str):
    """The file system of `folder` and a function from names in it to paths."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    store = new(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store, lambda name: new(f"{folder}/{name}")


def clear_unfinished(spark, folder: str) -> None:
    """Take away what a run that died in `write_report` has left in `folder`."""
    store, path = _store(spark, folder)
    if store.exists(path(NOTE_NAME)):
        # The note is only there between the renames of a run that found neither output.
        for name in (CSV_NAME, JSON_NAME):
            store.delete(path(name), True)
        store.delete(path(NOTE_NAME), False)
    store.delete(path(STAGED_NAME), True)


def _publish(spark, folder: str) -> None:
    store, path = _store(spark, folder)
    store.create(path(NOTE_NAME), False).close()
    for name in (CSV_NAME, JSON_NAME):
        if not store.rename(path(f"{STAGED_NAME}/{name}"), path(name)):
            raise OSError(f"could not rename {STAGED_NAME}/{name} in {folder}")
    store.delete(path(NOTE_NAME), False)
    store.delete(path(STAGED_NAME), True)


def write_report(entries: DataFrame, folder: str, with_losses: bool) -> None:
    """Write both forms of the report on `entries` (see `ledger_entries`), or none.

    The entries, at most two rows per (type, author), are checkpointed to the
    shared folder first: the guard and both outputs read them from there, and a
    lost executor does not bring the source scan back. One run at a time may write to
    a folder.
    """
    spark = entries.sparkSession
    clear_unfinished(spark, folder)
    check_outputs_absent(spark, folder)
    ensure_checkpoint_dir(spark)
    settled = entries.checkpoint()
    booked = settled if with_losses else settled.filter(F.col("entry") == LINES)
    if booked.isEmpty():
        raise ValueError("nothing to report: no lines and no losses")
    rows = report(booked, with_losses)
    write_csv(rows, f"{folder}/{STAGED_NAME}/{CSV_NAME}", with_losses)
    write_json(rows, f"{folder}/{STAGED_NAME}/{JSON_NAME}", with_losses)
    _publish(spark, folder)

"""The queries registered with the driver: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.functions import lines as line_functions
from creditledger.functions import paths as path_functions
from creditledger.functions.ignore import is_ignored
from creditledger.operators import files as file_operators
from creditledger.operators.attribution import displacements, last_touch
from creditledger.operators.facts import (
    author_histogram,
    dominant_author,
    snapshot_facts,
    window_facts,
    window_losses,
)
from creditledger.operators.hunks import hunk_lines, hunks_without_parent
from creditledger.operators.identity import resolve_identity, unique_aliases
from creditledger.operators.ignore_rules import compile_rules, rule_lines, without_ignored
from creditledger.operators.line_state import classify_lines, count_lines, countable
from creditledger.operators.order import numbered
from creditledger.operators.reuse import KNOWN, content_counts, with_counts
from creditledger.operators.rollup import (
    contributions,
    flat_rows,
    in_report_order,
    ledger_entries,
    report,
    report_order,
    rollup,
    share_in_group,
    table_rows,
)
from creditledger.operators.windows import (
    Span,
    line_facts_by_window,
    manifests_at,
    net_by_window,
    touch_entries_by_window,
    touched_between,
)
from creditledger.plans import driver_views as views
from creditledger.plans.reports import range_entries, snapshot_entries, touch_entries, touch_losses
from creditledger.sinks.report_files import json_document
from creditledger.sources.blame_dump import parse_dump_records
from creditledger.sources.files import alias_table, explode_lines
from creditledger.sources.patch_log import parse_patch_lines, parse_patch_records

Query = Callable[[SparkSession, str], DataFrame]

DOC = ["doc_id"]
FILE = ["doc_id", "path"]
KEY, ORDER = ["k"], ["ts", "event_id"]


def _visible(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in rows.columns if not c.startswith("_")))


# --- events -------------------------------------------------------------------


def _event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_entries(
        views.read(spark, sf_dir, "events").select(
            F.col("event_type").alias("type"),
            (F.col("user_id") % 25).alias("author"),
            F.lit(1).cast("bigint").alias("lines"),
        )
    )


def share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_in_group(_event_entries(spark, sf_dir))


def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(_event_entries(spark, sf_dir)).select("type", "author", "level", "lines")


def share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_event_entries(spark, sf_dir), with_losses=False).select(
        "section", "type", "author", "share", "percent"
    )


def ordered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_report_order(report(_event_entries(spark, sf_dir), with_losses=False))
    return rows.select("section", "type", "author", "lines", "share")


def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the report as a column."""
    rows = numbered(report(_event_entries(spark, sf_dir), with_losses=False), report_order())
    return rows.select("row_no", "section", "type", "author", "lines")


def last_touch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, until = views.window_bounds()
    return last_touch(views.touches(spark, sf_dir), KEY, ORDER, ["type", "actor"], after, until)


def last_touch_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_touch(views.touches(spark, sf_dir), KEY, ORDER, ["type", "actor"])


def _slices() -> list[Column]:
    """Hours: a key holding a third of the events is sorted in as many pieces."""
    return [F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01', ts)")]


def displaced_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, until = views.window_bounds()
    return displacements(views.touches(spark, sf_dir), KEY, ORDER, "actor", after, until, _slices())


def displacement_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, until = views.window_bounds()
    return touch_losses(
        views.touches(spark, sf_dir), KEY, ORDER, "actor", "type", after, until, _slices()
    )


def _net_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, until = views.window_bounds()
    return touch_entries(
        views.touches(spark, sf_dir), KEY, ORDER, "actor", "type", after, until, _slices()
    )


def net_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(_net_entries(spark, sf_dir))


def net_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(in_report_order(report(_net_entries(spark, sf_dir), with_losses=True)))


# --- paths --------------------------------------------------------------------


def _path_query(**columns: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = F.col("path")
        return views.paths(spark, sf_dir).select(
            "doc_id", "path", *(make(path).alias(name) for name, make in columns.items())
        )

    return query


def _path_type_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return ledger_entries(
        views.paths(spark, sf_dir).select(
            path_functions.file_type(path).alias("type"),
            path_functions.file_language(path).alias("author"),
            F.lit(1).cast("bigint").alias("lines"),
        )
    )


def path_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(_path_type_entries(spark, sf_dir)).select(
        "type", F.col("author").alias("language"), "level", F.col("lines").alias("files")
    )


# --- files --------------------------------------------------------------------


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = is_ignored(F.col("path"), list(views.IGNORE_RULES))
    return views.paths(spark, sf_dir).filter(~ignored)


def tracked_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_operators.tracked_only(views.paths(spark, sf_dir), views.tracked(spark, sf_dir), DOC)


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_operators.inventory(
        views.paths(spark, sf_dir), views.tracked(spark, sf_dir), DOC, views.IGNORE_RULES
    )


def touched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = views.manifests(spark, sf_dir)
    return file_operators.touched_paths(after, before, ["item_id"])


def touched_paths_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_operators.touched_paths(views.manifests(spark, sf_dir)[1], None, ["item_id"])


def revision_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of the documents is taken for one revision of a tree."""
    documents = views.read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return file_operators.at_revision(documents, "src1", "source")


# --- lines --------------------------------------------------------------------


def split_into_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(views.read(spark, sf_dir, "documents"), DOC, "text")


def line_prefix_and_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = views.lines(spark, sf_dir).select(
        "doc_id", "line_no", line_functions.left_trimmed("content").alias("trimmed")
    )
    return trimmed.select(
        "doc_id",
        "line_no",
        (F.col("trimmed") == "").alias("blank"),
        line_functions.is_line_comment("trimmed").alias("comment"),
    )


def line_countable(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = views.lines(spark, sf_dir).withColumn("type", path_functions.file_type(F.col("path")))
    return classify_lines(typed, DOC, keep=["type"], type_="type")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_lines(views.lines(spark, sf_dir), FILE)
    type_ = path_functions.file_type(F.col("path"))
    return counted.select(
        "doc_id", "n_lines", "n_filled", "n_code", countable(type_).alias("countable")
    )


#: Few enough for most documents to have several runs, and several blocks of runs.
RUN_LINES, BLOCK_RUNS, BIN_LINES = 4, 2, 8


def line_countable_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = views.lines(spark, sf_dir).withColumn("type", path_functions.file_type(F.col("path")))
    return classify_lines(typed, DOC, keep=["type"], type_="type", run_lines=RUN_LINES)


def line_counts_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_lines(
        views.lines(spark, sf_dir), FILE, run_lines=RUN_LINES, block_runs=BLOCK_RUNS
    )
    type_ = path_functions.file_type(F.col("path"))
    return counted.select(
        "doc_id", "n_lines", "n_filled", "n_code", countable(type_).alias("countable")
    )


def file_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = views.marked_texts(spark, sf_dir).select(
        "doc_id", "content", path_functions.file_type(F.col("path")).alias("type")
    )
    return typed.select(
        "doc_id", line_functions.countable_lines_in_text("content", "type").alias("countable")
    )


def line_counts_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of one source is counted first; of all documents then only those whose
    text it does not have."""
    text = F.coalesce("text", F.lit(""))
    documents = views.read(spark, sf_dir, "documents").select("doc_id", "source", text.alias("content"))
    files = documents.select("doc_id", "source", F.sha2("content", 256).alias("content_id"))

    def load(wanted: DataFrame) -> DataFrame:
        return wanted.join(documents.select("doc_id", "content"), "doc_id")

    known = content_counts(file_operators.at_revision(files, "src1", "source"), spark.createDataFrame([], KNOWN), DOC, load)
    fresh = content_counts(files, known, DOC, load)
    return with_counts(files, known, fresh).select("doc_id", "n_lines", "n_filled", "n_code", "reused")


# --- people -------------------------------------------------------------------


def alias_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_aliases(alias_table(views.author_mappings(spark, sf_dir)))


def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.lines(spark, sf_dir).select("doc_id", "line_no", "raw_author")
    return resolve_identity(lines, "raw_author", views.aliases(spark), into="author")


def author_histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_histogram(views.lines(spark, sf_dir), DOC)


def dominant_author_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_author(author_histogram(views.lines(spark, sf_dir), DOC), DOC)


# --- reports from lines -------------------------------------------------------


def snapshot_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_facts(views.lines(spark, sf_dir), views.aliases(spark), FILE)


def snapshot_facts_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_facts(
        views.lines(spark, sf_dir), views.aliases(spark), FILE, resolve_before_argmax=True
    )


def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = snapshot_entries(views.lines(spark, sf_dir), views.aliases(spark), FILE)
    rows = report(entries, with_losses=False)
    return in_report_order(rows).select("section", "type", "author", "lines", "share", "percent")


def snapshot_inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From inventory to report: tracked files that no rule ignores."""
    entries = snapshot_entries(
        views.lines(spark, sf_dir),
        views.aliases(spark),
        FILE,
        tracked=views.tracked(spark, sf_dir),
        tracked_keys=DOC,
        ignore_rules=views.IGNORE_RULES,
    )
    rows = report(entries, with_losses=False)
    return in_report_order(rows).select("section", "type", "author", "lines", "share", "percent")


def _code_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_end = views.lines_at_end(spark, sf_dir)
    return at_end.filter(path_functions.is_code_file(F.col("path")))


def window_line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_facts(
        _code_at_end(spark, sf_dir),
        views.aliases(spark),
        views.FROM_SEQ,
        FILE,
    )


def window_line_facts_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the beginning of history, and only in the files listed as touched: here,
    paths of which a labelled document exists."""
    touched = file_operators.tracked_only(
        views.paths(spark, sf_dir), views.tracked(spark, sf_dir), DOC
    )
    return window_facts(_code_at_end(spark, sf_dir), views.aliases(spark), None, FILE, touched=touched)


def window_line_facts_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only in files whose content differs between the ends of the window."""
    touched = file_operators.touched_paths(
        views.content_manifest(spark, sf_dir, views.TO_SEQ), views.content_manifest(spark, sf_dir, views.FROM_SEQ), FILE
    )
    return window_facts(
        _code_at_end(spark, sf_dir), views.aliases(spark), views.FROM_SEQ, FILE, touched=touched
    )


def _parent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("doc_id", "line_no", "content", "raw_author")


def _code_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hunks(spark, sf_dir).filter(path_functions.is_code_file(F.col("path")))


def hunk_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = hunk_lines(
        views.hunks(spark, sf_dir), _parent_lines(spark, sf_dir), DOC, bin_lines=BIN_LINES
    )
    return joined.select(
        "doc_id", "commit_id", "start", "cnt", "line_no", "content", "raw_author", "deleting_author"
    )


def hunks_without_parent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of files that were renamed meanwhile, against the lines of all files."""
    parents = views.lines(spark, sf_dir).select("doc_id", "path", "line_no")
    return hunks_without_parent(views.renamed_hunks(spark, sf_dir), parents, FILE)


def hunk_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_losses(
        _code_hunks(spark, sf_dir), _parent_lines(spark, sf_dir), views.aliases(spark), DOC
    )


def _range_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = range_entries(
        views.lines_at_end(spark, sf_dir),
        views.hunks(spark, sf_dir),
        _parent_lines(spark, sf_dir),
        views.aliases(spark),
        views.FROM_SEQ,
        FILE,
        DOC,
    )
    return report(entries, with_losses=True)


def range_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(in_report_order(_range_report(spark, sf_dir)))


def numbered_range_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(numbered(_range_report(spark, sf_dir), report_order()))


# --- report forms -------------------------------------------------------------


def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_rows(report(_net_entries(spark, sf_dir), with_losses=True), with_losses=True)
    return _visible(in_report_order(rows))


def display_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_rows(report(_net_entries(spark, sf_dir), with_losses=True), with_losses=True)
    return _visible(in_report_order(rows))


def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = json_document(_range_report(spark, sf_dir), with_losses=True)
    return in_report_order(document, F.col("_place")).select(
        F.col("_place").alias("place"), F.col("_member").alias("member"), "type", "author", "line"
    )


# --- dumps --------------------------------------------------------------------


def blame_dump_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_dump_records(views.dump_records(spark, sf_dir))
    return parsed.select(
        F.col("file").cast("bigint").alias("doc_id"), "commit_id", "line_no", "author", "boundary", "content"
    )


def patch_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_patch_records(views.patch_records(spark, sf_dir))


def patch_log_lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_patch_lines(views.patch_lines(spark, sf_dir))


# --- many rules, windows, revisions -------------------------------------------


def _without_ignored(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    rules = compile_rules(rule_lines(views.ignore_files(spark, sf_dir, nested=strict), strict), strict)
    return without_ignored(views.repository_paths(spark, sf_dir), rules, strict)


def ignore_rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_ignored(spark, sf_dir, strict=False)


def ignore_rules_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_ignored(spark, sf_dir, strict=True)


def net_by_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = [Span(name, views.day(first), views.day(last)) for name, first, last in views.WINDOWS]
    return net_by_window(
        touch_entries_by_window(
            views.touches(spark, sf_dir), KEY, ORDER, "actor", "type", spans, views.as_time, _slices()
        )
    )


def line_facts_by_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = [Span(name, after) for name, after in views.LINE_WINDOWS]
    return line_facts_by_window(_code_at_end(spark, sf_dir), views.aliases(spark), spans, FILE)


def tree_at_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = [(n, views.day(n)) for n in views.REVISION_DAYS]
    return manifests_at(views.content_changes(spark, sf_dir), revisions, KEY, ORDER, lit=views.as_time)


def touched_between_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = views.day(views.REVISION_DAYS[0]), views.day(views.REVISION_DAYS[-2])
    return touched_between(views.content_changes(spark, sf_dir), first, last, KEY, ORDER, lit=views.as_time)


QUERIES: dict[str, Query] = {
    "net_report": net_report,
    "net_by_pair": net_by_pair,
    "last_touch_window": last_touch_window,
    "last_touch_from_start": last_touch_from_start,
    "displacements": displaced_touches,
    "displacement_losses": displacement_losses,
    "share_by_group": share_by_group,
    "rollup_report": rollup_report,
    "share_text": share_text,
    "ordered_sections": ordered_sections,
    "path_parts": _path_query(
        base=path_functions.base_name,
        ext=path_functions.extension,
        n_segments=lambda p: F.size(path_functions.segments(p)).cast("bigint"),
    ),
    "path_language": _path_query(language=path_functions.language),
    "path_is_code": _path_query(is_code=path_functions.is_code_file),
    "path_skip_dir": _path_query(skipped=path_functions.in_skipped_directory),
    "path_build": _path_query(is_build=path_functions.is_build_file),
    "path_test": _path_query(
        test_name=path_functions.is_test_filename, is_test=path_functions.is_test_path
    ),
    "path_resource": _path_query(is_resource=path_functions.is_resource_path),
    "path_type": _path_query(type=path_functions.file_type, language=path_functions.file_language),
    "path_type_rollup": path_type_rollup,
    "ignore_filter": ignore_filter,
    "tracked_semi": tracked_semi,
    "file_inventory": file_inventory,
    "touched_paths": touched_paths,
    "touched_paths_from_start": touched_paths_from_start,
    "revision_filter": revision_filter,
    "split_into_lines": split_into_lines,
    "line_prefix_and_blank": line_prefix_and_blank,
    "line_countable": line_countable,
    "line_counts": line_counts,
    "line_countable_in_runs": line_countable_in_runs,
    "line_counts_in_runs": line_counts_in_runs,
    "file_line_counts": file_line_counts,
    "alias_dimension": alias_dimension,
    "identity_resolve": identity_resolve,
    "author_histogram": author_histogram_query,
    "dominant_author": dominant_author_query,
    "snapshot_facts": snapshot_file_facts,
    "snapshot_facts_by_person": snapshot_facts_by_person,
    "snapshot_report": snapshot_report,
    "snapshot_inventory_report": snapshot_inventory_report,
    "window_line_facts": window_line_facts,
    "window_line_facts_touched": window_line_facts_touched,
    "hunk_interval_join": hunk_interval_join,
    "hunks_without_parent": hunks_without_parent_query,
    "hunk_losses": hunk_losses,
    "range_report": range_report,
    "flat_report": flat_report,
    "display_report": display_report,
    "nested_report": nested_report,
    "blame_dump_parse": blame_dump_parse,
    "patch_log_parse": patch_log_parse,
    "patch_log_lines_parse": patch_log_lines_parse,
    "line_counts_reused": line_counts_reused,
    "numbered_sections": numbered_sections,
    "numbered_range_report": numbered_range_report,
    "window_line_facts_changed": window_line_facts_changed,
    "ignore_rules_table": ignore_rules_table,
    "ignore_rules_nested": ignore_rules_nested,
    "net_by_windows": net_by_windows,
    "line_facts_by_windows": line_facts_by_windows,
    "tree_at_revisions": tree_at_revisions,
    "touched_between_revisions": touched_between_revisions,
}

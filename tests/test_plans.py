"""What the plans must and must not contain."""

import re

import pytest

from creditledger.plans.catalog import QUERIES


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_products(spark, small_dir, name):
    plan = planned(QUERIES[name](spark, small_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_counting_lines_takes_one_wide_exchange(spark, small_dir):
    plan = executed(QUERIES["line_counts"](spark, small_dir))
    assert plan.count("FileScan") == 1
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    # Lines once by run, then totals by block and by file.
    assert [("_run" in e, "_block" in e) for e in exchanges] == [(False, False), (False, True), (True, False)]


def test_counting_whole_files_takes_no_exchange(spark, small_dir):
    assert "Exchange" not in planned(QUERIES["file_line_counts"](spark, small_dir))
    assert "Exchange" not in planned(QUERIES["patch_log_parse"](spark, small_dir))


def test_windows_reach_the_scan(spark, small_dir):
    plan = planned(QUERIES["last_touch_window"](spark, small_dir))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThan(ts" in pushed and "LessThanOrEqual(ts" in pushed
    assert "value" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_last_touch_is_reduced_before_the_shuffle(spark, small_dir):
    plan = planned(QUERIES["last_touch_window"](spark, small_dir))
    assert "partial_max" in plan and "Window" not in plan


def test_report_reads_its_source_once(spark, small_dir):
    plan = executed(QUERIES["ordered_sections"](spark, small_dir))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_dump_parser_shares_its_exchange(spark, small_dir):
    plan = executed(QUERIES["blame_dump_parse"](spark, small_dir))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_alias_tables_are_broadcast(spark, small_dir):
    plan = executed(QUERIES["identity_resolve"](spark, small_dir))
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_net_report_scans_its_log_twice(spark, small_dir):
    for name in ("net_by_pair", "net_report"):
        assert executed(QUERIES[name](spark, small_dir)).count("FileScan") == 2


def test_many_windows_take_one_pass(spark, small_dir):
    assert executed(QUERIES["line_facts_by_windows"](spark, small_dir)).count("FileScan parquet") == 1
    assert executed(QUERIES["tree_at_revisions"](spark, small_dir)).count("FileScan parquet") == 1

import random

import pytest
from pyspark.sql import functions as F

from creditledger.operators.attribution import last_touch
from creditledger.operators.facts import window_facts
from creditledger.operators.files import touched_paths, tracked_only
from creditledger.operators.hunks import BRANCH, _level_bins, hunk_lines, hunks_without_parent
from creditledger.operators.rollup import contributions
from creditledger.operators.intervals import Intervals
from creditledger.operators.windows import (
    Span,
    last_touch_by_window,
    line_facts_by_window,
    manifests_at,
    net_by_window,
    touch_entries_by_window,
    touched_between,
)
from creditledger.plans.reports import touch_entries
from creditledger.sources.files import read_author_config


@pytest.fixture(scope="module")
def touches(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice(["a", "b", None, *map(str, range(8))]), rng.randrange(400), n, rng.choice("xyz"), rng.choice(["t", "u"]),
         rng.choice(["change", "change", "delete"]))
        for n in range(3000)
    ]
    return spark.createDataFrame(rows, "k string, at long, n long, actor string, type string, op string").repartition(6)


def spans(n=50):
    rng = random.Random(9)
    out = [Span("all"), Span("from", 100), Span("to", None, 250), Span("empty", 300, 300), Span("late", 399, 500)]
    while len(out) < n:
        a, b = sorted(rng.sample(range(-5, 420), 2))
        out.append(Span(f"w{len(out)}", a, b))
    return out


def bounds(span):
    lit = lambda v: None if v is None else F.lit(v)
    return lit(span.after), lit(span.until)


def test_intervals():
    cut = Intervals([5, 1, 5, 9])
    assert cut.bounds == [1, 5, 9]
    assert [cut.span(*w) for w in ((None, None), (1, 9), (5, None), (None, 1), (9, 9))] == [(0, 3), (1, 2), (2, 3), (0, 0), (3, 2)]


@pytest.mark.parametrize("op", [None, "op"])
def test_fifty_windows_equal_fifty_runs(spark, touches, op):
    many = last_touch_by_window(touches, ["k"], ["at", "n"], ["type", "actor"], spans(), op=op)
    got = {}
    for r in many.collect():
        got.setdefault(r["window"], []).append(tuple(r)[1:])
    entries = touch_entries_by_window(touches, ["k"], ["at", "n"], "actor", "type", spans(), op=op)
    net = {}
    for r in net_by_window(entries).collect():
        net.setdefault(r["window"], []).append(tuple(r)[1:])
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    for span in spans()[:: 1 if op is None else 7]:
        single = last_touch(touches, ["k"], ["at", "n"], ["type", "actor"], *bounds(span), op=op)
        assert order(got.get(span.window, [])) == order(single.collect())
    for span in spans()[::6]:
        single = contributions(touch_entries(touches, ["k"], ["at", "n"], "actor", "type", *bounds(span), op=op))
        assert order(net.get(span.window, [])) == order(single.collect())


def test_line_facts_of_many_windows(spark):
    rng = random.Random(2)
    rows = [(f"f{n % 9}.{'py' if n % 2 else 'md'}", n // 9, rng.choice(["x", "/* y", "*/ z", "", "// c"]), rng.choice(["ann", "bob"]), rng.randrange(100))
            for n in range(900)]
    lines = spark.createDataFrame(rows, "path string, line_no long, content string, raw_author string, touch_seq long").repartition(4)
    aliases = read_author_config(spark, None)
    windows = [Span("all")] + [Span(f"after {n}", n) for n in (-1, 0, 33, 50, 98, 99, 200)]
    many = line_facts_by_window(lines, aliases, windows)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {}
    for r in many.collect():
        got.setdefault(r["window"], []).append(tuple(r)[1:])
    for span in windows:
        single = window_facts(lines, aliases, span.after)
        assert sorted(got.get(span.window, [])) == sorted(map(tuple, single.collect()))
    with pytest.raises(ValueError):
        line_facts_by_window(lines, aliases, [Span("x", 1, 2)])


def test_trees_of_revisions_equal_full_manifests(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["p", "q", "r", None, *map(str, range(20))]), n, rng.choice([None, "c1", "c2", "c3"])) for n in range(200)]
    changes = spark.createDataFrame(rows, "path string, seq long, content_id string").repartition(5)
    revisions = [("r0", -1), ("r1", 0), ("r2", 57), ("r2 again", 57), ("r3", 120), ("r4", 1000)]
    want = {}
    for name, at in revisions:
        tree = {}
        for path, seq, content in rows:
            if seq <= at:
                tree[path] = content
        want[name] = {p: c for p, c in tree.items() if c is not None}
    got = {name: {} for name, _ in revisions}
    for r in manifests_at(changes, revisions).collect():
        assert r.path not in got[r.revision]
        got[r.revision][r.path] = r.content_id
    assert got == want
    touched = sorted((r.path for r in touched_between(changes, 57, 120).collect()), key=repr)
    assert touched == sorted((p for p in {*want["r2"], *want["r3"]} if want["r2"].get(p) != want["r3"].get(p)), key=repr)
    as_tables = [manifests_at(changes, [("x", at)]).drop("revision") for at in (120, 57)]
    assert sorted((r.path for r in touched_paths(*as_tables).collect()), key=repr) == touched
    assert {r.path for r in touched_between(changes, None, 120).collect()} == set(want["r3"])


def test_null_keys_meet_in_file_operators(spark):
    files = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "path string, n int")
    tracked = spark.createDataFrame([(None,), ("b",), ("b",)], "path string")
    assert sorted(r.n for r in tracked_only(files, tracked, ["path"]).collect()) == [1, 3]
    old = spark.createDataFrame([(None, "x"), ("a", "x"), ("b", "x")], "path string, content_id string")
    new = spark.createDataFrame([(None, "y"), ("a", "x"), ("c", "x")], "path string, content_id string")
    assert sorted((r.path for r in touched_paths(new, old).collect()), key=repr) == ["b", "c", None]
    hunks = spark.createDataFrame([(None, 1, 2), ("a", 1, 1), ("z", 1, 1)], "path string, start long, cnt long")
    lines = spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), ("a", 1, "z")], "path string, line_no long, content string")
    assert sorted(r.content for r in hunk_lines(hunks, lines, ["path"]).collect()) == ["x", "y", "z"]
    assert [r.path for r in hunks_without_parent(hunks, lines, ["path"]).collect()] == ["z"]


@pytest.mark.parametrize("bin_lines", [1, 3, 256])
def test_hunks_of_every_width(spark, bin_lines):
    rng = random.Random(bin_lines)
    hunks = [(n, rng.randrange(1, 3000), rng.choice([0, 1, 2, 70, 500, 2900])) for n in range(40)]
    lines = spark.range(1, 3001).select(F.lit("f").alias("path"), F.col("id").alias("line_no"))
    df = spark.createDataFrame([("f", *h) for h in hunks], "path string, h long, start long, cnt long")
    got = {}
    for r in hunk_lines(df, lines, ["path"], bin_lines=bin_lines).collect():
        got.setdefault(r.h, []).append(r.line_no)
    want = {h: list(range(a, min(a + n, 3001))) for h, a, n in hunks if n}
    assert {h: sorted(v) for h, v in got.items()} == want


def test_rows_of_a_hunk_grow_with_the_logarithm_of_its_length(spark):
    one = lambda first, last: spark.range(1).select(_level_bins(F.lit(first), F.lit(last), 256, 4).alias("b")).first().b
    for first, last in ((1, 1), (1, 16_000), (777, 10_000_777), (123_456_789, 923_456_789)):
        bins = one(first, last)
        covered = sorted((b["bin"] * 256 * BRANCH ** b["level"], (b["bin"] + 1) * 256 * BRANCH ** b["level"]) for b in bins)
        assert covered[0][0] <= first - 1 and covered[-1][1] >= last
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        assert len(bins) <= 2 * BRANCH + 1 + 2 * BRANCH * max(b["level"] for b in bins)

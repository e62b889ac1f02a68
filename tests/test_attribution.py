import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from creditledger.operators.attribution import default_slices, displacements, last_touch
from creditledger.operators.rollup import contributions, ledger_entries
from creditledger.plans.reports import touch_entries, touch_losses

SCHEMA = "key string, type string, actor string, ord long, op string"
ARGS = (["key"], ["ord"])


def touches(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def losses(df, after, until, **kw):
    rows = touch_losses(df, *ARGS, "actor", "type", after, until, op="op", **kw).collect()
    return {(r.type, r.author): r.deleted for r in rows}


def test_deleted_line_is_charged_to_its_writer(spark):
    df = touches(spark, [
        ("A", "documentation", "Alice", 1, "add"), ("B", "documentation", "Alice", 1, "add"),
        ("C", "documentation", "Bob", 2, "add"), ("A", "documentation", "Carol", 3, "delete"),
    ])
    assert losses(df, F.lit(1), F.lit(3)) == {("documentation", "Alice"): 1}
    kept = last_touch(df, *ARGS, ["type", "actor"], F.lit(1), F.lit(3), op="op").collect()
    assert [(r.key, r.actor) for r in kept] == [("C", "Bob")]
    entries = touch_entries(df, *ARGS, "actor", "type", F.lit(1), F.lit(3), op="op")
    assert {(r.author, r.lines, r.deleted, r.net) for r in contributions(entries).collect()} == {
        ("Bob", 1, 0, 1), ("Alice", 0, 1, -1)}


def test_rewriting_own_line_costs_nothing(spark):
    rows = [("v", "build", "bot", i, "change") for i in range(1, 5)] + [("v", "build", "Bob", 5, "delete")]
    assert losses(touches(spark, rows), None, F.lit(5)) == {("build", "bot"): 1}


def brute(rows, after, until):
    prev, charged, last = {}, Counter(), {}
    for key, type_, actor, ord_, op in sorted(rows, key=lambda r: r[3]):
        if ord_ > until:
            continue
        before = prev.get(key)
        if (after is None or ord_ > after) and before and before[1] != "delete" and before[0] != actor:
            charged[(type_, before[0])] += 1
        prev[key] = (actor, op)
        last[key] = (actor, ord_, op)
    kept = {k: (a, o) for k, (a, o, op) in last.items() if op != "delete" and (after is None or o > after)}
    return dict(charged), kept


@pytest.mark.parametrize("after", [None, 300])
@pytest.mark.parametrize("widths", [(), (10,), (5, 50), (1, 20, 200)])
def test_equal_to_a_walk_through_the_log(spark, after, widths):
    rng = random.Random(11)
    rows = []
    for i in range(1000):
        # A third of the touches fall on one key.
        key = "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 60)}"
        rows.append((key, "t" + key[-1], f"a{rng.randint(0, 3)}", i, rng.choice(["change"] * 4 + ["delete"])))
    df = touches(spark, rows)
    bound = None if after is None else F.lit(after)
    charged, kept = brute(rows, after, 800)
    slices = [F.floor(F.col("ord") / w) for w in widths]
    assert losses(df, bound, F.lit(800), slices=slices) == charged
    got = last_touch(df, *ARGS, ["actor"], bound, F.lit(800), op="op").collect()
    assert {r.key: (r.actor, r.ord) for r in got} == kept


def test_displacement_rows(spark):
    df = touches(spark, [("k", "t", "x", 1, "add"), ("k", "t", "y", 2, "change"), ("k", "t", "y", 3, "change")])
    rows = displacements(df, *ARGS, "actor").collect()
    assert [(r.ord, r.actor, r.displaced) for r in rows] == [(2, "y", "x")]


def test_entries_keep_one_sided_people(spark):
    facts = spark.createDataFrame([("t", "Bob", 1)], "type string, author string, lines long")
    lost = spark.createDataFrame([("t", "Alice", 1)], "type string, author string, deleted long")
    rows = contributions(ledger_entries(facts, lost)).collect()
    assert {(r.author, r.lines, r.deleted, r.net) for r in rows} == {("Bob", 1, 0, 1), ("Alice", 0, 1, -1)}


def test_null_keys_keep_their_chain_across_slices(spark):
    rows = [(k, n, who) for k in (None, "x") for n, who in enumerate(["a", "b", "b", "c", "a", "d"])]
    touches = spark.createDataFrame(rows, "k string, n int, who string")
    got = displacements(touches, ["k"], ["n"], "who", slices=[F.floor(F.col("n") / 2)]).collect()
    for k in (None, "x"):
        assert sorted((r.n, r.displaced) for r in got if r.k == k) == [(1, "a"), (3, "b"), (4, "c"), (5, "a")]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "long", "double"])
def test_default_slices_change_no_row(spark, kind):
    rng = random.Random(9)
    rows = [(i % 3, i, rng.choice("abc")) for i in range(90)]
    at = {
        "long": F.col("i") * 1700,
        "double": F.col("i") / 2,
        "date": F.date_add(F.lit("2024-02-01").cast("date"), F.col("i").cast("int")),
    }.get(kind, F.timestamp_seconds(F.col("i") * 2500 - 40_000))
    touches = spark.createDataFrame(rows, "k int, i long, who string").withColumn("at", at.cast(kind))

    def run(**settings):
        return sorted(map(tuple, displacements(touches, ["k"], ["at", "i"], "who", keep=["i"], **settings).select("k", "i", "displaced").collect()))

    assert run() == run(slices=[])


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "double", "binary"])
def test_positions_that_can_only_be_compared_are_cut_by_quantiles(spark, kind):
    rng = random.Random(kind)
    rows = [(rng.choice("kl"), n, rng.choice("xyz")) for n in rng.sample(range(10**6), 4000)]
    touches = spark.createDataFrame(rows, "k string, n long, actor string").repartition(5)
    at = F.lpad(F.col("n").cast("string"), 9, "0") if kind in ("string", "binary") else F.col("n") / 7
    touches = touches.withColumn("at", at.cast(kind))
    slices = default_slices(touches, "at")
    assert len(slices) == (0 if kind == "binary" else 2)
    if slices:
        sizes = [r["count"] for r in touches.groupBy(slices[0]).count().collect()]
        assert len(sizes) > 200 and max(sizes) < 100
    want, last = [], {}
    for k, n, actor in sorted(rows, key=lambda r: r[1]):
        if k in last and last[k] != actor:
            want.append((k, actor, last[k]))
        last[k] = actor
    got = displacements(touches, ["k"], ["at", "n"], "actor")
    assert sorted((r.k, r.actor, r.displaced) for r in got.collect()) == sorted(want)

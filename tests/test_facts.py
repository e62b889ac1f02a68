import random

import pytest
from pyspark.sql import functions as F

from creditledger.operators.facts import dominant_author, author_histogram, snapshot_facts, window_facts, window_losses
from creditledger.operators.files import at_revision, inventory, touched_paths, tracked_only
from creditledger.operators.hunks import hunk_lines, hunks_without_parent
from creditledger.operators.identity import resolve_identity, unique_aliases

ALIASES = "kind string, alias_lower string, canonical string, ord int"


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([
        ("name", "alice", "A. Anno", 0), ("name", "alice anno", "A. Anno", 0),
        ("email", "bob@x.org", "Bob Developer", 1), ("name", "robert", "Bob R.", 2),
        ("name", "dup", "first", 3), ("name", "dup", "second", 4),
        ("name", "odd <odd@x.org>", "Whole", 5), ("email", "odd@x.org", "Mail", 5),
    ], ALIASES)


WANT = {
    "alice": "A. Anno", "ALICE": "A. Anno", "Alice Anno <a@x.org>": "A. Anno",
    "Bob <BOB@x.org>": "Bob Developer", "Robert <bob@x.org>": "Bob Developer", "Robert <r@x.org>": "Bob R.",
    "Robert <": "Bob R.", "robert": "Bob R.", "carol": "carol", "Carol <c@x.org>": "Carol <c@x.org>",
    "unknown": "unknown", "": "", "dup": "second", "Odd <odd@x.org>": "Whole", "O <odd@x.org>": "Mail",
}


def test_identity(spark, aliases):
    df = spark.createDataFrame([(a,) for a in WANT], "actor string")
    got = resolve_identity(df, "actor", aliases, into="who").collect()
    assert {r.actor: r.who for r in got} == WANT
    assert resolve_identity(df, "actor", aliases).columns == ["actor"]


def test_no_aliases(spark, aliases):
    df = spark.createDataFrame([(a,) for a in WANT], "actor string")
    rows = resolve_identity(df, "actor", aliases.limit(0), into="who").collect()
    assert all(r.actor == r.who for r in rows)
    assert unique_aliases(aliases).count() == 7


@pytest.mark.parametrize("bin_lines", [1, 3, 256])
def test_interval_join(spark, bin_lines):
    rng = random.Random(5)
    files = {f"f{i}": rng.randint(1, 60) for i in range(6)}
    lines = [(f, n) for f, size in files.items() for n in range(1, size + 1)]
    hunks = [(f"c{i}", f"f{rng.randint(0, 7)}", rng.randint(1, 50), rng.randint(0, 40)) for i in range(60)]
    h = spark.createDataFrame(hunks, "commit string, path string, start long, cnt long")
    p = spark.createDataFrame(lines, "path string, line_no long")
    got = sorted((r.commit, r.path, r.line_no) for r in hunk_lines(h, p, ["path"], bin_lines=bin_lines).collect())
    want = sorted((c, f, n) for c, f, s, k in hunks for g, n in lines if f == g and s <= n < s + k)
    assert got == want


def _lines(spark, rows):
    return spark.createDataFrame(rows, "path string, line_no long, content string, raw_author string, touch_seq long")


def test_snapshot_owner_and_count(spark, aliases):
    lines = _lines(spark, [
        ("a.py", 1, "x", "bob", 1), ("a.py", 2, "", "alice", 1), ("a.py", 3, "# c", "alice", 1),
        ("tie.go", 1, "x", "zoe", 1), ("tie.go", 2, "y", "amy", 1),
        ("empty.go", 1, "// c", "amy", 1), ("lost.go", 1, "x", "unknown", 1),
        ("ali.md", 1, "# x", "alice", 1), ("ali.md", 2, "y", "Alice Anno", 1),
        ("ali.md", 3, "z", "kim", 1), ("ali.md", 4, "z", "kim", 1), ("ali.md", 5, "w", "alice", 1), ("ali.md", 6, "w", "kim", 1),
    ])
    rows = snapshot_facts(lines, aliases).collect()
    assert {(r.path, r.type, r.lines, r.author, r.language) for r in rows} == {
        ("a.py", "main_code", 1, "A. Anno", "python"),
        ("tie.go", "main_code", 2, "amy", "go"),
        ("ali.md", "documentation", 6, "kim", "text"),
    }
    merged = snapshot_facts(lines, aliases, resolve_before_argmax=True).filter("path = 'ali.md'").first()
    assert merged.author == "A. Anno"
    top = dominant_author(author_histogram(lines, ["path"]), ["path"]).collect()
    assert {r.path: r.raw_author for r in top}["tie.go"] == "amy"


def test_window_counts_before_it_filters(spark, aliases):
    """The old line opens a comment: the new line below it does not count."""
    lines = _lines(spark, [
        ("a.py", 1, "x /*", "alice", 5), ("a.py", 2, "inside", "alice", 20), ("a.py", 3, "*/ y", "Bob <bob@x.org>", 20),
        ("a.py", 4, "z", "alice", 10), ("a.py", 5, "z", "ALICE", 11), ("b.py", 1, "old", "alice", 1),
    ])
    rows = window_facts(lines, aliases, after=10).collect()
    assert {(r.path, r.author, r.lines) for r in rows} == {("a.py", "Bob Developer", 1), ("a.py", "A. Anno", 1)}
    everything = window_facts(lines, aliases).collect()
    assert sum(r.lines for r in everything) == 5
    touched = spark.createDataFrame([("b.py",)], "path string")
    assert [r.path for r in window_facts(lines, aliases, touched=touched).collect()] == ["b.py"]


def test_losses(spark, aliases):
    parent = spark.createDataFrame([
        ("c1", "a.py", 1, "x /*", "alice"), ("c1", "a.py", 2, "y", "alice"), ("c1", "a.py", 3, "z", "robert"),
        ("c2", "n.md", 1, "# t", "Alice Anno"), ("c2", "n.md", 2, " ", "alice"),
    ], "commit_id string, path string, line_no long, content string, raw_author string")
    hunks = spark.createDataFrame([
        ("c1", "a.py", 2, 2, "Alice Anno <q@x.org>"), ("c2", "n.md", 1, 2, "Bob <bob@x.org>"), ("c9", "gone.py", 1, 3, "x"),
    ], "commit_id string, path string, start long, cnt long, deleting_author string")
    assert [r.path for r in hunks_without_parent(hunks, parent, ["commit_id", "path"]).collect()] == ["gone.py"]
    rows = window_losses(hunks, parent, aliases).collect()
    # The comment opened on line 1 is outside the first hunk; Alice deleting her own line is no loss.
    assert {(r.type, r.author, r.deleted) for r in rows} == {("main_code", "Bob R.", 1), ("documentation", "A. Anno", 1)}


def test_files(spark):
    files = spark.createDataFrame([("r", "c", x) for x in ["a.py", "build/b.py", "x.svg", "t/c.go"]], "repo string, commit_id string, path string")
    tracked = spark.createDataFrame([("r", "c", "a.py"), ("r", "c", "build/b.py"), ("r", "d", "t/c.go")], "repo string, commit_id string, path string")
    keys = ["repo", "commit_id", "path"]
    assert [r.path for r in inventory(files, tracked, keys).collect()] == ["a.py"]
    assert sorted(r.path for r in inventory(files).collect()) == ["a.py", "t/c.go"]
    assert tracked_only(files, tracked, keys).count() == 2
    assert at_revision(tracked, "d").first().path == "t/c.go"


def test_touched(spark):
    old = spark.createDataFrame([("same", "1"), ("changed", "1"), ("removed", "1")], "path string, content_id string")
    new = spark.createDataFrame([("same", "1"), ("changed", "2"), ("added", "1")], "path string, content_id string")
    assert sorted(r.path for r in touched_paths(new, old).collect()) == ["added", "changed", "removed"]
    assert touched_paths(new).count() == 3

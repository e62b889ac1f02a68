import json
import os
import random

import pytest
from pyspark.sql import functions as F

from creditledger.functions.paths import unquoted_path
from creditledger.operators.facts import window_facts
from creditledger.sources.blame_dump import read_blame_dump
from creditledger.operators.files import inventory
from creditledger.sources.files import explode_lines, list_trees, read_author_config, read_ignore_rules, read_records, with_content
from creditledger.sources import schemas
from creditledger.sources.patch_log import parse_patch_lines, parse_patch_records, read_patch_log


def block(rng, n, author, content, boundary=False):
    sha = "".join(rng.choices("0123456789abcdef", k=40))
    group = f" {rng.randint(1, 9)}" if rng.random() < 0.3 else ""
    lines = [f"{sha} {rng.randint(1, 99)} {n}{group}", f"author {author}", "author-mail <a@x.org>",
             "author-time 1", "summary boundary", *(["boundary"] if boundary else []), "filename a.py"]
    return sha, "\n".join(lines) + f"\n\t{content}\n"


CONTENTS = ["author Mallory", "boundary", "", "\tindented", "plain", "x\ry", "ä" * 30, "0" * 40 + " 1 1", "summary"]


def dump(seed, blocks):
    rng = random.Random(seed)
    text, rows = "", []
    for n in range(1, blocks + 1):
        author = rng.choice(["Ann", "", "Bob <b@x.org>", "boundary", "Zoë Q"])
        content, old = rng.choice(CONTENTS), rng.random() < 0.3
        sha, piece = block(rng, n, author, content, old)
        text += piece
        rows.append((sha, n, author, old, content))
    return text, rows


@pytest.mark.parametrize("split_bytes", [97, 1000, 128 * 1024 * 1024])
def test_blame_dump_splits_anywhere(spark, tmp_path, split_bytes):
    want = []
    for name, size in (("a", 60), ("b", 1), ("c", 25)):
        text, rows = dump(name, size)
        (tmp_path / name).write_bytes(text.encode())
        want += [(name, *r) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = read_blame_dump(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = [(r.file.rsplit("/", 1)[-1], r.commit_id, r.line_no, r.author, r.boundary, r.content) for r in got]
    assert sorted(rows) == sorted(want)


def test_block_without_content_is_dropped(spark, tmp_path):
    rng = random.Random(1)
    sha, first = block(rng, 1, "Ann", "one")
    broken = first.split("\n\t")[0] + "\n"
    sha2, second = block(rng, 2, "Bob", "two")
    no_author = "c" * 40 + " 3 3\nfilename x\n\tthree\n"
    (tmp_path / "d").write_text(broken + second + no_author)
    got = read_blame_dump(spark, str(tmp_path)).collect()
    assert sorted((r.author, r.content, r.line_no) for r in got) == [("", "three", 3), ("Bob", "two", 2)]


LOG = """@@COMMIT@@:c1\tAnn

diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -3 +3 @@ def f():
--- old/path.go
+new
@@ -10,4 +9,0 @@
-a
-b
-@@COMMIT@@:fake\tEve
-d
@@ -20,0 +19,2 @@
+x
+y
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+x
+y
diff --git a/logo.svg b/logo.svg
--- a/logo.svg
+++ b/logo.svg
@@ -1,2 +1 @@
-x
@@COMMIT@@:c2\tBob\tB.

diff --git a/gone.md b/gone.md
--- a/gone.md
+++ /dev/null
@@ -1,7 +0,0 @@
-x
diff --git "a/\\303\\244.md" "b/\\303\\244.md"
--- "a/\\303\\244.md"
+++ "b/\\303\\244.md"
@@ -5,2 +4,0 @@
-x
-y
diff --git a/with space.py b/with space.py
--- a/with space.py\t
+++ b/with space.py\t
@@ -1 +1 @@
-x
+y
@@COMMIT@@:c3\tCarl

@@COMMIT@@:c4\t
diff --git a/b.go b/b.go
--- a/b.go
+++ b/b.go
@@ -2,3 +1,0 @@
-x
"""
HUNKS = [
    ("c1", "Ann", "a.py", 3, 1), ("c1", "Ann", "a.py", 10, 4), ("c2", "Bob\tB.", "gone.md", 1, 7),
    ("c2", "Bob\tB.", "ä.md", 5, 2), ("c2", "Bob\tB.", "with space.py", 1, 1), ("c4", "", "b.go", 2, 3),
]


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 501, 128 * 1024 * 1024])
def test_patch_log(spark, tmp_path, split_bytes):
    (tmp_path / "log").write_text(LOG)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = [tuple(r) for r in read_patch_log(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(HUNKS)


def test_patch_record_without_author(spark):
    record = "c9\n\ndiff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -1 +0,0 @@\n-x"
    df = spark.createDataFrame([(record,)], "value string")
    assert [tuple(r) for r in parse_patch_records(df).collect()] == [("c9", "", "a.go", 1, 1)]


def test_dump_feeds_the_range_report(spark, tmp_path):
    text, rows = dump("z", 40)
    (tmp_path / "z.md").write_bytes(text.encode())
    lines = read_blame_dump(spark, str(tmp_path)).select(
        F.replace("path", F.lit(".py"), F.lit(".md")).alias("path"), "line_no", "content", F.col("author").alias("raw_author"),
        F.when(F.col("boundary"), 0).otherwise(1).alias("touch_seq"))
    facts = window_facts(lines, read_author_config(spark, None), after=0).collect()
    want = {}
    for _, _, author, old, content in rows:
        if not old and content.strip():
            want[author] = want.get(author, 0) + 1
    assert {r.author: r.lines for r in facts} == want


@pytest.mark.parametrize("split", ["64b", "128m"])
def test_dumps_of_any_depth_and_name(spark, tmp_path, split):
    names = ["top", "sub/inner", "_init", "sub/.hid", ".github/ci", "a/_b/c=1"]
    want = []
    for n, name in enumerate(names):
        text, rows = dump(n, 5)
        want += [(r[2], r[4]) for r in rows]
        (tmp_path / "dumps" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "dumps" / name).write_text(text)
        log = f"@@COMMIT@@:h{n}\tAnn\n\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -{n + 1} +0,0 @@\n-gone\n"
        (tmp_path / "logs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "logs" / name).write_text(log)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = read_blame_dump(spark, str(tmp_path / "dumps")).collect()
        hunks = read_patch_log(spark, str(tmp_path / "logs")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.author, r.content) for r in got) == sorted(want)
    assert sorted((r.commit_id, r.start) for r in hunks) == [(f"h{n}", n + 1) for n in range(len(names))]


@pytest.mark.parametrize(
    ("quoted", "want"),
    [
        ("plain.md", "plain.md"),
        (r'"a/\303\244.md"', "a/\u00e4.md"),
        (r'"a\\303.md"', r"a\303.md"),
        (r'"x\377.md"', "x\ufffd.md"),
        (r'"a\tb\"c.md"', 'a\tb"c.md'),
        ('""', ""),
    ],
)
def test_quoted_paths(spark, quoted, want):
    row = spark.createDataFrame([(quoted,)], "p string").select(unquoted_path(F.col("p"))).first()
    assert row[0] == want


def test_author_config(spark, tmp_path):
    path = tmp_path / "authors.json"
    path.write_text(json.dumps({"authors": [
        {"canonical": "A", "emails": ["A@x.org"], "names": ["Ann", "ann b"]},
        {"canonical": "B", "names": ["ANN"]}]}, indent=1))
    rows = {tuple(r) for r in read_author_config(spark, str(path)).collect()}
    assert rows == {("email", "a@x.org", "A", 0), ("name", "ann", "A", 0), ("name", "ann b", "A", 0), ("name", "ann", "B", 1)}
    path.write_text("not json")
    with pytest.raises(ValueError, match="no author configuration"):
        read_author_config(spark, str(path))
    assert read_author_config(spark, str(path), broken_is_empty=True).count() == 0
    assert read_author_config(spark, str(tmp_path / "missing.json")).count() == 0


def test_ignore_file(tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    assert [r.negate for r in read_ignore_rules(str(tmp_path / ".gitignore"))] == [False, True]
    assert read_ignore_rules(str(tmp_path / "none")) == []


def test_file_tree_and_lines(spark, tmp_path):
    texts = {
        "one/src/a b.py": "x\r\ny\n", "one/top.md": "one", "one/pkg/__init__.py": "", "one/.github/ci.yml": "on:",
        "one/node_modules/m/i.js": "x", "one/e.egg-info/t.txt": "x", "one/logo.svg": "<svg/>", "two/_x.go": "é",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    roots = [str(tmp_path / "one"), str(tmp_path / "two") + "/"]
    listing = list_trees(spark, roots)
    assert {r.path for r in listing.collect()} == {
        "src/a b.py", "top.md", "pkg/__init__.py", ".github/ci.yml", "logo.svg", "_x.go"}
    assert list_trees(spark, roots, prune=False).count() == len(texts)
    files = with_content(inventory(listing), partitions=3)
    got = {(r.root.rstrip("/")[-3:] + "/" + r.path): r.content for r in files.collect()}
    kept = ["one/src/a b.py", "one/top.md", "one/pkg/__init__.py", "one/.github/ci.yml", "two/_x.go"]
    assert got == {name: texts[name] for name in kept}
    lines = sorted(tuple(r) for r in explode_lines(files, ["path"]).collect() if r.path in ("src/a b.py", "top.md"))
    assert lines == [("src/a b.py", 1, "x\r"), ("src/a b.py", 2, "y"), ("src/a b.py", 3, ""), ("top.md", 1, "one")]


@pytest.mark.parametrize("seed", range(3))
def test_one_commit_over_many_splits(spark, seed):
    """Every cut of a log into splits gives the hunks of a sequential reading."""
    rng = random.Random(seed)
    log, want, commit, path, stopped = [], [], None, None, False
    for _ in range(900):
        line = rng.choice(
            ["@@COMMIT@@:h%d\tAnn %d" % (rng.randrange(99), rng.randrange(9))] * (rng.random() < 0.1)
            + ["diff --git a/x b/x", "--- a/f%d.py" % rng.randrange(99), "--- /dev/null", "@@ -%d,%d +1 @@" % (rng.randrange(1, 99), rng.randrange(3)),
               "@@ -7 +7 @@ def", "-x", "+y", "--- a/\"q.py", "index 1..2"])
        log.append(line)
        if line.startswith(("@@COMMIT@@:", "diff")):
            commit, path, stopped = (line[11:] if line[0] == "@" else commit), None, False
        elif line.startswith("--- ") and path is None and not stopped:
            path = line[4:].removeprefix("a/")
        elif line.startswith("@@ -"):
            stopped = True
            start, _, cnt = line[4:].split(" ")[0].partition(",")
            if path and path.endswith(".py") and int(cnt or 1):
                hash_, _, author = (commit or "").partition("\t")
                want.append((hash_ if commit else None, author if commit else None, path, int(start), int(cnt or 1)))
    assert len(want) > 20
    for size in (1, 2, 5, 17, 1000):
        rows = [("log", n - n % size, n, line) for n, line in enumerate(log)]
        lines = spark.createDataFrame(rows, "file string, split long, seq long, value string").repartition(5)
        got = [tuple(r) for r in parse_patch_lines(lines).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trees_deep_wide_and_linked(spark, tmp_path):
    deep = tmp_path / "/".join(["d"] * 50)
    deep.mkdir(parents=True)
    (deep / "end.py").write_text("x")
    wide = tmp_path / "wide"
    wide.mkdir()
    for n in range(100_000):
        os.mknod(wide / f"{n}.txt")
    for n in range(300):
        (tmp_path / "many" / f"{n % 20}" / f"{n}").mkdir(parents=True)
        (tmp_path / "many" / f"{n % 20}" / f"{n}" / "_f.go").write_text("y" * n)
    (tmp_path / "many" / "up").symlink_to(tmp_path)
    listing = list_trees(spark, [str(tmp_path), str(tmp_path / "none")], budget=8)
    assert listing.count() == listing.distinct().count() == 100_301
    assert {r.path for r in listing.filter("path LIKE 'd/%'").collect()} == {"d/" * 50 + "end.py"}
    assert listing.filter("path LIKE 'many/%'").agg(F.sum("size")).first()[0] == sum(range(300))
    # One root is walked by many tasks: after the first rounds, files lie in many parts.
    assert listing.filter("path LIKE 'many/%'").select(F.input_file_name()).distinct().count() > 8
    assert list_trees(spark, []).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 10, 1000])
def test_hidden_files_in_pieces(spark, tmp_path, piece):
    rng = random.Random(piece)
    texts = {f"_{n}": "".join(rng.choice("ab\n\t\u00e9") for _ in range(rng.randrange(60))) for n in range(12)} | {"_end": "a\n\tb\n\t", "_none": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for separator in ("\n", "\n\t"):
        got = {}
        for r in read_records(spark, str(tmp_path), separator, piece).orderBy("file", "split", "seq").collect():
            got.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.value)
        want = {name: text.split(separator) for name, text in texts.items()}
        want = {name: parts[:-1] if parts[-1] == "" else parts for name, parts in want.items()}
        assert got == {name: parts for name, parts in want.items() if parts}


def test_readers_give_what_their_schemas_say(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    shape = lambda schema: [(f.name, f.dataType) for f in schema]
    assert shape(read_patch_log(spark, str(tmp_path)).schema) == shape(schemas.HUNKS)
    assert shape(read_blame_dump(spark, str(tmp_path)).schema) == shape(schemas.DUMP_LINES)
    assert shape(read_records(spark, str(tmp_path), "\n").schema) == shape(schemas.RECORDS)

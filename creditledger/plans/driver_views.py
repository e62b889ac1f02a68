"""Views that turn the driver's tables into touches, files, lines, hunks, aliases
and manifests. Every view covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.functions.ignore import IgnoreRule
from creditledger.sources.schemas import DRIVER_TABLES

WINDOW_AFTER, WINDOW_UNTIL = "2024-01-10", "2024-01-20"
FROM_SEQ, TO_SEQ = 30, 80

DIRECTORIES = (
    "src/main/java/", "src/test/java/", "cmd/server/", "tests/", "src/assets/",
    "playbooks/templates/", "node_modules/x/", ".github/workflows/", "docs/", "src/app/",
    "build/out/", "roles/a/tests/", "public/themes/", "", "scripts/", "pkg.egg-info/",
)
BASE_NAMES = (
    "Foo.java", "FooTest.java", "Latest.java", "main.go", "main_test.go", "test_app.py",
    "conftest.py", "app.component.spec.ts", "logo.svg", "pom.xml", "Dockerfile",
    "compose.yaml", "deploy.sh", "README.md", "config.j2", "Cargo.toml", ".ansible-lint",
    "tsconfig.build.json", "app.container", "theme.CSS", "requirements.txt", "Makefile",
    "build.gradle.kts",
)
IGNORE_RULES = (
    IgnoreRule(r"^[^/]*\.py\z"),
    IgnoreRule(r"^keep.*\z", negate=True),
    IgnoreRule(r"^src/[^/]*\z"),
    IgnoreRule(r"^main_test\.go\z", negate=True),
    IgnoreRule(r"^docs/.*\z"),
    IgnoreRule(r"^test_app\.py\z", negate=True),
)
#: Globs of root ignore files, and (directory, glob) of nested ones.
GLOBS = (
    "*.py", "!main_test.go", "src/*", "docs/", "!test_app.py", "**/README.md", "F*.java",
    "scripts/deploy.sh", "b?ild/out/*", "!conftest.py", "app.*", "cmd/server/*.go", "!*.spec.ts",
)
NESTED_RULES = (
    ("", "*.py"), ("", "!test_app.py"), ("src", "main/"), ("src", "/app/*"), ("", "docs/**"),
    ("docs", "!README.md"), ("", "**/templates/"), ("playbooks", "!templates"), ("", "[Dd]ockerfile"),
    ("", "main?test.go"), ("tests", "*"), ("tests", "!conftest.py"), ("", "build/"),
    ("build", "!pom.xml"), ("roles/a", "tests/logo.svg"),
)
REPOSITORIES = 25
LOG_DOCUMENTS, COMMIT_DOCUMENTS, SPLIT_LINES = 200, 40, 12
#: Fifty overlapping windows over the events: (days after the first of January, length).
WINDOWS = tuple((f"w{n:02}", n % 20, n % 20 + 1 + n // 3) for n in range(50))
LINE_WINDOWS = (("all", None), *((f"after {n}", n) for n in range(5, 80, 15)))
REVISION_DAYS = (3, 8, 9, 15, 40)
ALIAS_ROWS = (
    ("name", "alice", "A. Anno", 0),
    ("name", "alice anno", "A. Anno", 0),
    ("email", "bob@x.org", "Bob Developer", 1),
    ("email", "bob2@x.org", "Bob Developer", 1),
    ("name", "robert", "Bob R.", 2),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(DRIVER_TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def window_bounds() -> tuple[Column, Column]:
    return F.lit(WINDOW_AFTER).cast("timestamp_ntz"), F.lit(WINDOW_UNTIL).cast("timestamp_ntz")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(":"), number).alias("k"),
        F.col("event_type").alias("type"),
        (F.col("user_id") % 25).alias("actor"),
        "ts",
        "event_id",
    )


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def path_of(doc_id: Column) -> Column:
    return F.concat(
        _pick(DIRECTORIES, doc_id % 16 + 1),
        _pick(BASE_NAMES, F.floor(doc_id / 16) % 23 + 1),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", path_of(F.col("doc_id")).alias("path"))


def _marked(doc_id: Column, n: Column, line: Column) -> Column:
    case = (doc_id * 31 + n * 7) % 13
    return (
        F.when(case == 0, F.concat(F.lit("/* "), line))
        .when(case == 1, F.concat(line, F.lit(" */ x")))
        .when(case == 2, F.concat(F.lit("// "), line))
        .when(case == 3, F.concat(line, F.lit(" */ b /*")))
        .when(case == 4, F.lit(""))
        .when(case == 5, F.concat(F.lit("a /* b */ "), line))
        .otherwise(line)
    )


def _author_of(doc_id: Column, n: Column) -> Column:
    case = (doc_id + n * 3) % 6
    return (
        F.when(case == 0, "alice")
        .when(case == 1, "Alice Anno <alice@x.org>")
        .when(case == 2, "Bob <bob@x.org>")
        .when(case == 3, "Robert <bob2@x.org>")
        .when(case == 4, "carol")
        .otherwise("unknown")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, n = F.col("doc_id"), F.col("n")
    return (
        read(spark, sf_dir, "documents")
        .select("doc_id", path_of(doc_id).alias("path"), "text")
        .select("doc_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("n", "l"))
        .select(
            "doc_id",
            "path",
            (n + 1).cast("bigint").alias("line_no"),
            _marked(doc_id, n, F.col("l")).alias("content"),
            _author_of(doc_id, n).alias("raw_author"),
            ((doc_id * 7 + n * 13) % 100).alias("touch_seq"),
        )
    )


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same marked lines as `lines`, one whole text per file."""
    doc_id = F.col("doc_id")
    marked = F.transform(F.split("text", "\n", -1), lambda l, n: _marked(doc_id, n, l))
    return read(spark, sf_dir, "documents").select(
        "doc_id", path_of(doc_id).alias("path"), F.array_join(marked, "\n").alias("content")
    )


def lines_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as they are at the end of the window."""
    return lines(spark, sf_dir).filter(F.col("touch_seq") <= TO_SEQ)


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hunk per document, anywhere in it and of any length up to all of it."""
    doc_id = F.col("doc_id")
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        path_of(doc_id).alias("path"),
        (doc_id % 40).alias("commit_id"),
        (1 + doc_id * 7 % n_lines).alias("start"),
        (1 + doc_id * 11 % n_lines).alias("cnt"),
        F.when(doc_id % 3 == 0, "alice")
        .when(doc_id % 3 == 1, "Bob <bob@x.org>")
        .otherwise("dave")
        .alias("deleting_author"),
    )


def renamed_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hunks of `hunks`; those of commits from the tenth on name their file as the
    document after theirs is named."""
    doc_id = F.col("doc_id")
    renamed = F.when(F.col("commit_id") < 10, F.col("path")).otherwise(path_of(doc_id + 1))
    return hunks(spark, sf_dir).withColumn("path", renamed)


def content_manifest(spark: SparkSession, sf_dir: str, until: int) -> DataFrame:
    """Every file as far as it was written up to a position: what its lines hash to."""
    kept = lines(spark, sf_dir).filter(F.col("touch_seq") <= until)
    return kept.groupBy("doc_id", "path").agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(F.crc32(F.concat_ws(":", "line_no", "content")))).alias("content_id")
    )


def aliases(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', '{a}', '{c}', {o})" for k, a, c, o in ALIAS_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(kind, alias_lower, canonical, ord)")


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a manifest: the status of every order as booked, and as its
    line items have it. Some keys are in one version only, some differ."""
    before = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("content_id")
    )
    first, last = F.min("l_linestatus"), F.max("l_linestatus")
    after = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("item_id"))
        .agg(F.when(first == last, first).otherwise(F.lit("P")).alias("content_id"))
    )
    return before, after


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents stand for the tracked files."""
    return read(spark, sf_dir, "labels").select("doc_id")


def author_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as people with several names and addresses, some of them shared."""
    shared = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"))
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("canonical"),
        F.array(F.concat("c_name", F.lit("@x.org")), F.concat(shared, F.lit("@x.org"))).alias("emails"),
        F.array("c_name", shared).alias("names"),
    )


def dump_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an attributed-line dump, cut at newline-tab."""
    doc_id = F.col("doc_id")

    def block(line: Column, n: Column) -> Column:
        number = (n + 1).cast("string")
        old = (doc_id * 7 + n * 13) % 100 <= FROM_SEQ
        return F.concat(
            F.sha1(F.concat_ws(":", doc_id.cast("string"), number)),
            F.lit(" "), number, F.lit(" "), number,
            F.lit("\nauthor "), _author_of(doc_id, n),
            F.lit("\nauthor-mail <x@x.org>\nsummary boundary"),
            F.when(old, F.lit("\nboundary")).otherwise(F.lit("")),
            F.lit("\nfilename f\n\t"), line, F.lit("\n"),
        )

    dump = F.array_join(F.transform(F.split("text", "\n", -1), block), "")
    return (
        read(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split(dump, "\n\t", -1)).alias("seq", "value"))
        .select(
            doc_id.cast("string").alias("file"),
            F.floor(F.col("seq") / 50).alias("split"),
            "seq",
            "value",
        )
    )


def patch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a commit that edits its path: one deletion, one edit of a
    single line without a count, and one insertion."""
    doc_id = F.col("doc_id")
    path = path_of(doc_id)
    value = F.concat(
        F.lpad(doc_id.cast("string"), 40, "0"), F.lit("\tAuthor "), (doc_id % 7).cast("string"),
        F.lit("\n\ndiff --git a/"), path, F.lit(" b/"), path,
        F.lit("\nindex 1..2 100644\n--- a/"), path, F.lit("\n+++ b/"), path,
        F.lit("\n@@ -"), (1 + doc_id % 5).cast("string"), F.lit(","), (2 + doc_id % 4).cast("string"),
        F.lit(" +1,0 @@ context\n--- old text\n-"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n-")),
        F.lit("\n@@ -40 +38 @@\n-x\n+y\n@@ -50,0 +49,2 @@\n+z"),
        F.lit("\ndiff --git a/new.py b/new.py\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+n\n"),
    )
    return read(spark, sf_dir, "documents").select(value.alias("value"))


def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches of `patch_records`, 200 documents a log and 40 of them a commit, line by
    line; the splits of a log are twelve lines long, so that commits and files span many."""
    doc_id = F.col("doc_id")
    path = path_of(doc_id)
    first = F.concat(F.lit("@@COMMIT@@:"), F.lpad(doc_id.cast("string"), 40, "0"), F.lit("\tAuthor "), (doc_id % 7).cast("string"))
    head = F.array(
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.lit("index 1..2 100644"),
        F.concat(F.lit("--- a/"), path),
        F.concat(F.lit("+++ b/"), path),
        F.concat(F.lit("@@ -"), (1 + doc_id % 5).cast("string"), F.lit(","), (2 + doc_id % 4).cast("string"), F.lit(" +1,0 @@ context")),
        F.lit("--- old text"),
    )
    body = F.transform(F.split("text", "\n", -1), lambda line: F.concat(F.lit("-"), line))
    tail = F.array(*map(F.lit, (
        "@@ -40 +38 @@", "-x", "+y", "@@ -50,0 +49,2 @@", "+z",
        "diff --git a/new.py b/new.py", "--- /dev/null", "+++ b/new.py", "@@ -0,0 +1 @@", "+n",
    )))
    commit = F.when(doc_id % COMMIT_DOCUMENTS == 0, F.array(first, F.lit(""))).otherwise(F.array().cast("array<string>"))
    return (
        read(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.concat(commit, head, body, tail)).alias("seq", "value"))
        .select(
            F.floor(doc_id / LOG_DOCUMENTS).cast("string").alias("file"),
            (doc_id * (1 << 32) + F.floor(F.col("seq") / SPLIT_LINES)).alias("split"),
            F.col("seq").cast("long").alias("seq"),
            "value",
        )
    )


def repository_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select((F.col("doc_id") % REPOSITORIES).cast("int").alias("repo"), "path", "doc_id")


def ignore_files(spark: SparkSession, sf_dir: str, nested: bool) -> DataFrame:
    """Every customer has put three lines into an ignore file of the repository of
    their nation."""
    key = F.col("c_custkey")
    number = key * 7 + F.col("c_nationkey")
    if nested:
        directory = _pick(tuple(d for d, _ in NESTED_RULES), number % len(NESTED_RULES) + 1)
        glob = _pick(tuple(g for _, g in NESTED_RULES), number % len(NESTED_RULES) + 1)
    else:
        directory, glob = F.lit(""), _pick(GLOBS, number % len(GLOBS) + 1)
    blank = "" if nested else "  "
    return read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("repo"),
        directory.alias("dir"),
        key.alias("file"),
        F.concat(F.lit("# "), "c_name", F.lit(f"\n\n{blank}"), glob, F.lit("  \n")).alias("text"),
    )


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a log of changes of what it touches; every seventh user removes."""
    number = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(":"), number).alias("k"),
        "ts",
        "event_id",
        F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 50).alias("content_id"),
    )


def day(n: int) -> str:
    """So many days after the first of January, as text that sorts."""
    return f"2024-{1 + n // 31:02}-{1 + n % 31:02}"


def as_time(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")

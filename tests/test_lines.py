import random

import pytest
from pyspark.sql import functions as F

from creditledger.functions.fixed_values import WHITE_SPACE
from creditledger.functions.lines import countable_lines_in_text
from creditledger.operators.line_state import classify_lines, count_lines


def fold(lines):
    """Brute force: walk the lines with one bit of state."""
    def comment(s):
        return s.startswith(("//", "#", "--", "*"))

    inside, flags = False, []
    for line in lines:
        t = line.strip(WHITE_SPACE)
        flag = False
        if t and inside:
            head, mark, tail = t.partition("*/")
            if mark:
                inside = False
                tail = tail.strip(WHITE_SPACE)
                flag = bool(tail) and not comment(tail)
        elif t and not comment(t):
            head, mark, tail = t.partition("/*")
            if not mark:
                flag = True
            else:
                _, closed, after = tail.partition("*/")
                after = after.strip(WHITE_SPACE)
                flag = bool(head.strip(WHITE_SPACE)) or bool(closed and after and not comment(after))
                inside = not closed
        flags.append(flag)
    return flags


PIECES = ["/*", "*/", "//", "#", "--", "*", "x", "foo()", " ", "\t", " ", "　", "", "/", "ä", "\r"]


def random_files(seed, n, longest):
    rng = random.Random(seed)
    return {
        i: ["".join(rng.choices(PIECES, k=rng.randint(0, 5))) for _ in range(rng.randint(1, longest))]
        for i in range(n)
    }


@pytest.fixture(scope="module")
def files():
    return random_files(3, 150, 40)


@pytest.fixture(scope="module")
def table(spark, files):
    rows = [
        (i, n + 1, line, f"a{n % 3}", "documentation" if i % 7 == 0 else "main_code")
        for i, lines in files.items()
        for n, line in enumerate(lines)
    ]
    return spark.createDataFrame(rows, "file int, line_no long, content string, author string, type string").cache()


def expected(files, i):
    if i % 7 == 0:
        return [bool(x.strip(WHITE_SPACE)) for x in files[i]]
    return fold(files[i])


@pytest.mark.parametrize("run_lines", [1, 2, 5, 65536])
def test_flags_equal_the_fold_for_any_run_length(table, files, run_lines):
    got = classify_lines(table, ["file"], keep=["author"], type_="type", run_lines=run_lines).collect()
    want = {(i, n + 1): f for i in files for n, f in enumerate(expected(files, i))}
    assert len(got) == len(want)
    assert {(r.file, r.line_no): r.countable for r in got} == want


@pytest.mark.parametrize("run_lines, block_runs", [(1, 1), (1, 4), (3, 2), (2, None), (65536, 1024)])
def test_counts_by_author_equal_the_fold(table, files, run_lines, block_runs):
    got = count_lines(table, ["file"], by=["author"], run_lines=run_lines, block_runs=block_runs).collect()
    want = {}
    for i, lines in files.items():
        for n, (line, flag) in enumerate(zip(lines, fold(lines))):
            cell = want.setdefault((i, f"a{n % 3}"), [0, 0, 0])
            cell[0] += 1
            cell[1] += bool(line.strip(WHITE_SPACE))
            cell[2] += flag
    assert {(r.file, r.author): [r.n_lines, r.n_filled, r.n_code] for r in got} == want


def test_whole_text_fold(spark, files):
    rows = [(i, "\n".join(lines), "documentation" if i % 7 == 0 else "build") for i, lines in files.items()]
    df = spark.createDataFrame(rows, "file int, content string, type string")
    got = df.select("file", countable_lines_in_text("content", "type").alias("n")).collect()
    assert {r.file: r.n for r in got} == {i: sum(expected(files, i)) for i in files}


def test_mixed_source_and_documentation(spark):
    source = "use x\n\n// all comment\nrun(); /*\nhidden\n*/ stop();\n/* alone */\nend()\n"
    notes = "# Title\n\n- one\n* two\nText.\n"
    df = spark.createDataFrame([("a", source, "main_code"), ("b", notes, "documentation")], "f string, c string, type string")
    got = {r[0]: r[1] for r in df.select("f", countable_lines_in_text("c", "type")).collect()}
    assert got == {"a": 4, "b": 4}


def test_one_file_with_most_of_the_rows(spark):
    """A comment opened on the first line and closed on the last spans many runs."""
    n = 5000
    line = F.when(F.col("id") == 0, "x /*").when(F.col("id") == n - 1, "*/ y").otherwise("z")
    df = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"), line.alias("content"))
    assert count_lines(df, ["file"], run_lines=64).first().n_code == 2
    assert classify_lines(df, ["file"], run_lines=64).filter("countable").count() == 2

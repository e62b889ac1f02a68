import random
import subprocess

import pytest
from pyspark.sql import functions as F

from creditledger.functions.ignore import is_ignored, parse_ignore_rules
from creditledger.operators.ignore_rules import CROWD, compile_rules, rule_lines, without_ignored
from creditledger.plans.catalog import QUERIES

NAMES = ["a", "b", "ab", "foo", "foo.py", "x.py", "Makefile", "build", "a.b", "c+d", "ü.md", "long_name_of_a_file_with_34_letters"]
GLOBS = ["*.py", "foo", "build", "a*", "*b", "?", "a?b", "**/foo", "foo/**", "a/**/b", "src/*", "*", "long_name*letters", "*name_of_a_file*",
         "c+d", "*.md", "x.p?", "a/b", "**", "b/*.py", "[ab]", "a.b"]


def a_path(rng):
    return "/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5)))


def test_table_equals_the_fold(spark):
    """10,000 rules of 100 repositories."""
    rng = random.Random(3)
    texts = {}
    for repo in range(100):
        lines = []
        for _ in range(100):
            glob = rng.choice(GLOBS) if rng.random() < 0.3 else a_path(rng) + rng.choice(["", "*", "?", "/**", "x"])
            lines.append(rng.choice(["", "", "", "!", " ", "# "]) + glob + rng.choice(["", "", "", "/", "  ", "\t"]))
        texts[repo] = "\n".join(lines)
    texts[100] = "*.py\n\n#x\n!foo.py\n"
    paths = [(repo, a_path(rng)) for repo in range(101) for _ in range(25)]
    files = spark.createDataFrame(paths + [(None, "foo.py"), (555, "foo.py")], "repo long, path string")
    ignore_files = spark.createDataFrame([(r, "", t) for r, t in texts.items()] + [(None, "", "foo*")], "repo long, dir string, text string")
    rules = compile_rules(rule_lines(ignore_files))
    got = without_ignored(files, rules)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(555, "foo.py")]
    for repo, text in texts.items():
        mine = spark.createDataFrame([p for p in paths if p[0] == repo], "repo long, path string") if repo % 25 == 0 else None
        if mine is not None:
            want += [tuple(r) for r in mine.filter(~is_ignored(F.col("path"), parse_ignore_rules(text))).collect()]
    rows = sorted(map(tuple, got.collect()))
    checked = {0, 25, 50, 75, 100, 555}
    assert [r for r in rows if r[0] in checked] == sorted(want)
    # All rows, by the fold's regular expressions.
    import re

    for repo, text in texts.items():
        folded = [(re.compile(r.regex.replace(r"\z", r"\Z"), re.S), r.negate) for r in parse_ignore_rules(text) if not r.dir_only]
        kept = []
        for _, path in (p for p in paths if p[0] == repo):
            last = [n for e, n in folded if e.match(path) or e.match(path.rsplit("/", 1)[-1])]
            if not last or last[-1]:
                kept.append((repo, path))
        assert [r for r in rows if r[0] == repo] == sorted(kept)


def test_a_hot_repository_is_not_one_task(spark):
    files = spark.range(1000).select(F.lit(1).alias("repo"), F.concat(F.lit("d/"), "id", F.lit(".py")).alias("path"))
    rules = compile_rules(rule_lines(spark.createDataFrame([(1, "", "*7.py\n!*77.py")], "repo int, dir string, text string")))
    want = [n for n in range(1000) if n % 10 != 7 or n % 100 == 77]
    assert sorted(int(r.path[2:-3]) for r in without_ignored(files, rules).collect()) == want


STRICT_GLOBS = GLOBS + ["/foo", "foo/", "/a/", "a/", "build/", "/*", "!foo", "!a/", "!*.py", "**/a/b", "a/**", "[a-c]", "[!a]*", "[^f]oo", "*.[mp][dy]",
                        r"\!x", r"\#x", "#no", "foo/*", "!foo/x.py", "a/**/", "/**/b", "b/?", "ab ", r"ab\ ", "a[]b]", "*[", "!/a/b", "**/*.py", "[a&&b]*"]


def as_git(root, repos):
    """What version control itself says of every path."""
    out = []
    for repo, (files, paths) in repos.items():
        folder = root / str(repo)
        folder.mkdir(parents=True)
        subprocess.run(["git", "init", "-q", str(folder)], check=True)
        for directory, text in files:
            (folder / directory).mkdir(parents=True, exist_ok=True)
            (folder / directory / ".gitignore").write_text(text)
        for path in paths:
            (folder / path).parent.mkdir(parents=True, exist_ok=True)
            (folder / path).touch()
        asked = subprocess.run(["git", "-C", str(folder), "-c", "core.excludesFile=/dev/null", "check-ignore", "-z", "--stdin", "--no-index"],
                               input="\0".join(paths).encode(), capture_output=True, check=False)
        out += [(repo, p.decode()) for p in asked.stdout.split(b"\0") if p]
    return out


def test_strict_rules_equal_version_control(spark, tmp_path):
    rng = random.Random(8)
    repos = {}
    for repo in range(40):
        paths, folders = [], set()
        while len(paths) < 25:
            path = a_path(rng)
            parents = {"/".join(path.split("/")[:n]) for n in range(1, path.count("/") + 1)}
            if path not in folders and path not in paths and not parents & set(paths):
                paths.append(path)
                folders |= parents
        places = ["", *rng.sample(sorted(folders), min(3, len(folders)))]
        files = [(d, "\n".join(rng.choice(["", "!"] if rng.random() < 0.3 else [""]) + rng.choice(STRICT_GLOBS) for _ in range(rng.randrange(1, 5)))) for d in places]
        repos[repo] = (files, paths)
    try:
        gone = as_git(tmp_path, repos)
    except FileNotFoundError:
        pytest.skip("no git")
    ignore_files = spark.createDataFrame([(r, d, t) for r, (files, _) in repos.items() for d, t in files], "repo int, dir string, text string")
    files = spark.createDataFrame([(r, p) for r, (_, paths) in repos.items() for p in paths], "repo int, path string")
    rules = compile_rules(rule_lines(ignore_files, strict=True), strict=True)
    kept = sorted(map(tuple, without_ignored(files, rules, strict=True).collect()))
    want = sorted({(r, p) for r, (_, paths) in repos.items() for p in paths} - set(gone))
    assert gone and kept == want


def test_of_a_rule_said_again_only_the_last_counts(spark):
    """A thousand files that say the same leave as many rules as one."""
    texts = [(1, "", n, "*.py\n!a*.py\nb/\n" if n % 2 else "!*.py\na*.py\n") for n in range(1000)]
    ignore_files = spark.createDataFrame(texts, "repo int, dir string, file long, text string")
    files = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (1, "a.py"), (1, None), (None, "a.py")], "repo int, path string")
    for strict, n_rules in ((False, 3), (True, 3)):
        rules = compile_rules(rule_lines(ignore_files, strict), strict)
        assert rules.count() == n_rules
        kept = [tuple(r) for r in without_ignored(files, rules, strict).collect()]
        assert sorted(kept, key=str) == sorted([(1, "a.py"), (1, "a.py"), (1, None), (None, "a.py")], key=str)


def test_many_different_rules_share_no_key(spark):
    """Rules of one repository with the same beginning and end are told apart by a piece in between."""
    names = [f"src/main/java/org/example/m{n % 10}/*Name_{n:04}*Test.java" for n in range(2000)]
    lines = [("!" if n % 3 == 0 else "") + glob for n, glob in enumerate(names)] + [f"*x{n:03}y?" for n in range(200)] + ["*.md", "a.md", "??.md"]
    ignore_files = spark.createDataFrame([(1, "", "\n".join(lines))], "repo int, dir string, text string")
    paths = [name.replace("*", "q", 1).replace("*", "r") for name in names[:50]] + ["d/ax017yz", "ax017y", "ü/b.md", "aax199y"]
    files = spark.createDataFrame([(1, p) for p in paths], "repo int, path string")
    for strict in (False, True):
        rules = compile_rules(rule_lines(ignore_files, strict), strict)
        assert rules.groupBy("repo", "kind", "size", "literal").count().agg(F.max("count")).first()[0] <= CROWD
        kept = sorted(r.path for r in without_ignored(files, rules, strict).collect())
        assert kept == sorted([p for n, p in enumerate(paths[:50]) if n % 3 == 0] + ["ax017y", "aax199y"])


def test_pieces_anywhere_find_what_the_fold_finds(spark, monkeypatch):
    """Every rule goes by its rarest key."""
    monkeypatch.setattr("creditledger.operators.ignore_rules.CROWD", 0)
    test_table_equals_the_fold(spark)


def test_pieces_anywhere_find_what_version_control_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("creditledger.operators.ignore_rules.CROWD", 0)
    test_strict_rules_equal_version_control(spark, tmp_path)


def test_rules_are_cut_before_their_keys_are_made(spark, small_dir):
    """Neither keys nor expressions are made for lines that are said again."""
    plan = QUERIES["ignore_rules_table"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]

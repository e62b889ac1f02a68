from pyspark.sql import functions as F

from creditledger.functions import paths as p
from creditledger.functions.ignore import IgnoreRule, glob_to_regex, is_ignored, parse_ignore_rules
from creditledger.operators.rollup import contributions
from creditledger.plans.reports import snapshot_entries
from creditledger.sources.files import read_author_config

TYPED = {
    ("main_code", "java"): ["shop/src/main/java/Cart.java", "src/Latest.java", "a/Contest.java"],
    ("test_code", "java"): ["shop/src/main/java/CartTest.java", "x/CartTests.java", "src/test/java/Util.java"],
    ("main_resources", "yaml"): ["shop/src/main/resources/app.yml", "a/STATIC/b.yaml"],
    ("test_resources", "yaml"): ["shop/src/test/resources/app.yml", "e2e/assets/x.yml"],
    ("test_code", "go"): ["cmd/run_test.go", "tests/run.go"],
    ("main_code", "go"): ["cmd/run.go", "contest/run.go"],
    ("test_code", "python"): ["pkg/test_cart.py", "pkg/cart_test.py", "pkg/conftest.py", "spec/a.py"],
    ("main_code", "python"): ["pkg/testing.py", "Conftest.py"],
    ("test_code", "typescript"): ["a/cart.spec.ts", "a/cart.test.tsx", "__tests__/x.ts"],
    ("main_code", "typescript"): ["a/cart.specs.ts", "a/cart.ts"],
    ("test_code", "javascript"): ["a/cart.test.mjs", "cypress/x.cjs"],
    ("main_resources", "jinja2"): ["roles/web/templates/site.j2"],
    ("build", "xml"): ["pom.xml", "svc/pom.xml", "tests/pom.xml"],
    ("build", "kotlin"): ["settings.gradle.kts"],
    ("build", "json"): ["tsconfig.app.json", "web/package.json", "TSConfig.json"],
    ("build", "other"): ["Dockerfile", "Dockerfile.dev", "svc/api.dockerfile", ".ansible-lint"],
    ("build", "yaml"): ["compose.yaml", "docker-compose.prod.yml", ".github/workflows/x.yml", "a/.github/x.yml", ".gitlab-ci.yml"],
    ("build", "quadlet"): ["units/web.container", "units/db.volume"],
    ("build", "toml"): ["Cargo.toml"],
    ("build", "text"): ["requirements.txt"],
    ("build", "markdown"): [".github/CONTRIBUTING.md"],
    ("scripts", "shell"): ["src/main/resources/run.sh", "tests/a.bash", "b.ZSH"],
    ("documentation", "text"): ["README.md", "tests/plan.rst", "CMakeLists.txt"],
    ("other", "other"): ["src/assets/logo.svg", "Makefile", "a.b/noext", "x.sql", "trailing."],
    ("main_code", "yaml"): ["x.github/a.yml", "play/site.yml"],
}
CODE = {
    True: ["a.tsx", "a.J2", "x/Dockerfile.dev", "docker-compose", "podman-compose.x", "a.dockerfile", ".ansible-lint", "u.network"],
    False: ["logo.svg", "font.woff2", "Makefile", "a.md/b", "ansible-lint", "compose", "a.dockerfile.bak"],
}
SKIPPED = {
    True: ["node_modules/a.js", "a/build/x.py", "p.egg-info/top.txt", "x/.git/config", "a/test-results/b.ts"],
    False: ["build", "a/building/x.py", "Build/x.py", "x.egg-info", "a/egg-info/x.py", "target.py"],
}


def _map(spark, paths, column):
    df = spark.createDataFrame([(x,) for x in paths], "path string")
    return {r[0]: r[1] for r in df.select("path", column.alias("v")).collect()}


def test_types_and_languages(spark):
    want = {path: list(key) for key, paths in TYPED.items() for path in paths}
    got = _map(spark, want, F.array(p.file_type(F.col("path")), p.file_language(F.col("path"))))
    assert got == want


def test_code_gate(spark):
    want = {path: flag for flag, paths in CODE.items() for path in paths}
    assert _map(spark, want, p.is_code_file(F.col("path"))) == want


def test_skipped_directories(spark):
    want = {path: flag for flag, paths in SKIPPED.items() for path in paths}
    assert _map(spark, want, p.in_skipped_directory(F.col("path"))) == want


def test_glob_conversion():
    assert glob_to_regex("*.py") == r"^[^/]*\.py\z"
    assert glob_to_regex("a?b") == r"^a.b\z"
    assert glob_to_regex("**/x") == r"^.[^/]*/x\z"
    assert glob_to_regex("a+(b)|{c}^$[d]") == r"^a\+\(b\)\|\{c\}\^\$\[d\]\z"


def test_rules_are_read_in_order():
    text = "# note\n\n *.log \n!keep.log\nout/\n/abs\n"
    assert parse_ignore_rules(text) == [
        IgnoreRule(r"^[^/]*\.log\z"),
        IgnoreRule(r"^keep\.log\z", negate=True),
        IgnoreRule(r"^out\z", dir_only=True),
        IgnoreRule(r"^/abs\z"),
    ]


def test_last_matching_rule_wins(spark):
    import random
    import re

    rng = random.Random(7)
    names = ["a", "keep", "src", "x.py", "b.log", "keep.log"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 3))) for _ in range(80)})
    text = "*.py\n!keep*\nsrc/*\nb.log\n*.log\n!a/**\n!x.py\nsrc/x.py\nkeep/\n"
    rules = parse_ignore_rules(text)

    def loop(path):
        verdict = False
        for rule in rules:
            regex = rule.regex.replace(r"\z", r"\Z")
            if not rule.dir_only and (re.search(regex, path) or re.search(regex, path.rsplit("/", 1)[-1])):
                verdict = not rule.negate
        return verdict

    assert _map(spark, paths, is_ignored(F.col("path"), rules)) == {x: loop(x) for x in paths}
    assert not any(_map(spark, paths, is_ignored(F.col("path"), [])).values())


def test_other_word_lists(spark):
    """A measure of one's own: the lists are parameters, down to the reports."""
    ours = p.PathRules(
        languages={".sql": "sql", ".c": "c", ".it's": "odd", ".txt": "text"},
        build_basenames=("cmakelists.txt",), build_extensions=(), test_segments=("check",), skipped_directories=("vendor",),
        code_basenames=(), code_prefixes=(), code_suffixes=(), skipped_suffix="",
    )
    want = {
        "a.sql": ("main_code", "sql", True, False), "check/a.c": ("test_code", "c", True, False),
        "x/CMakeLists.txt": ("build", "text", True, False), "tests/a.py": ("other", "other", False, False),
        "a.it's": ("main_code", "odd", True, False), "vendor/a.c": ("main_code", "c", True, True),
        "node_modules/a.c": ("main_code", "c", True, False), "Dockerfile": ("other", "other", False, False),
        "x.egg-info/a.txt": ("documentation", "text", True, False),
    }
    path = F.col("path")
    got = spark.createDataFrame([(k,) for k in want], "path string").select(
        "path", p.file_type(path, ours), p.file_language(path, ours), p.is_code_file(path, ours), p.in_skipped_directory(path, ours)
    )
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    lines = spark.createDataFrame([(k, 1, "x", "ann") for k in want], "path string, line_no long, content string, raw_author string")
    booked = contributions(snapshot_entries(lines, read_author_config(spark, None), rules=ours)).collect()
    assert {(r.type, r.lines) for r in booked} == {("main_code", 3), ("test_code", 1), ("build", 1), ("documentation", 1)}

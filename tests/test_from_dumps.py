"""From a repository's own history to a report, by one way."""

import random
import subprocess

import pytest

from creditledger.operators.dropped import Dropped
from creditledger.operators.facts import snapshot_facts, window_facts, window_losses
from creditledger.operators.files import inventory
from creditledger.operators.rollup import contributions
from creditledger.plans.reports import range_entries_from_dumps, snapshot_entries_from_dumps
from creditledger.sources.files import read_author_config


class History:
    """A real repository, and its dumps as the readers expect them."""

    def __init__(self, folder):
        self.folder, self.dumps = folder / "repo", folder / "dumps"
        self.folder.mkdir()
        self.git("init", "-q", "-b", "main")

    def git(self, *args):
        out = subprocess.run(["git", "-C", str(self.folder), *args], capture_output=True, check=True)
        return out.stdout

    def commit(self, author, files):
        for name, text in files.items():
            path = self.folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            if text is None:
                path.unlink()
            else:
                path.write_text(text)
        self.git("add", "-A")
        self.git("-c", f"user.name={author}", "-c", "user.email=x@x.org", "commit", "-q", "--allow-empty", "-m", "m")
        return self.git("rev-parse", "HEAD").decode().strip()

    def dump(self, first, last):
        names = [n for n in self.git("ls-tree", "-r", "-z", "--name-only", last).decode().split("\0") if n]
        (self.dumps / "blame").mkdir(parents=True)
        for i, name in enumerate(names):
            (self.dumps / "blame" / f"{i}").write_bytes(self.git("blame", "--line-porcelain", "--first-parent", f"{first}..{last}", "--", name))
        (self.dumps / "log").mkdir()
        log = self.git("log", "-p", "--unified=0", "--first-parent", "--no-renames", "--format=@@COMMIT@@:%H%x09%an", f"{first}..{last}")
        (self.dumps / "log" / "log").write_bytes(log)
        for commit in self.git("rev-list", f"{first}..{last}").decode().split():
            folder = self.dumps / "parents" / commit
            folder.mkdir(parents=True)
            changed = self.git("diff", "--name-only", "-z", "--no-renames", "--diff-filter=MD", f"{commit}^", commit).decode().split("\0")
            for i, name in enumerate(n for n in changed if n):
                (folder / f"{i}").write_bytes(self.git("blame", "--line-porcelain", f"{commit}^", "--", name))
        return str(self.dumps / "blame"), str(self.dumps / "log"), str(self.dumps / "parents")


@pytest.fixture
def history(tmp_path):
    try:
        return History(tmp_path)
    except FileNotFoundError:
        pytest.skip("no git")


def net(entries):
    return {(r.type, r.author): (r.lines, r.deleted) for r in contributions(entries).collect()}


def test_losses_are_charged_to_the_writer(spark, history):
    """Own lines cost nothing, other people's do; a new file's lines are its author's."""
    history.commit("Bob", {"README.md": "base\n"})
    first = history.commit("Alice", {"docs/notes.md": "one\ntwo\nthree\n", "app.py": "x = 1\n"})
    history.commit("Bob", {"docs/notes.md": "one\nthree\n"})
    history.commit("Alice", {"app.py": "x = 2\n"})
    last = history.commit("Bob", {"new.py": "# no\ny = 1\nz = 2\n"})
    got = net(range_entries_from_dumps(spark, *history.dump(first, last)))
    assert got == {("documentation", "Alice"): (0, 1), ("main_code", "Alice"): (1, 0), ("main_code", "Bob"): (2, 0)}


def test_a_random_history(spark, history):
    """Against line-by-line bookkeeping: every line is written once and never moves."""
    rng = random.Random(5)
    people, files = ["Ann", "Ben", "Zoë Q"], {f"src/f{n}.py": [] for n in range(4)} | {"ä/b c.md": []}
    text = lambda: {n: "".join(f"{line}\n" for _, _, line in rows) for n, rows in files.items()}
    lost, commits, serial = {}, [], 0
    for step in range(14):
        who = rng.choice(people)
        for rows in files.values():
            kept = []
            for row in rows:
                if rng.random() < 0.2:
                    if step > 4 and row[0] != who:
                        lost[row[0]] = lost.get(row[0], 0) + 1
                else:
                    kept.append(row)
            for _ in range(rng.randrange(1, 4)):
                serial += 1
                kept.insert(rng.randrange(len(kept) + 1), (who, step, f"line_{serial} = {serial}"))
            rows[:] = kept
        commits.append(history.commit(who, text()))
    entries = range_entries_from_dumps(spark, *history.dump(commits[4], commits[-1]))
    got = {}
    for (_, author), (lines, deleted) in net(entries).items():
        have = got.setdefault(author, [0, 0])
        have[0] += lines
        have[1] += deleted
    want = {p: [sum(w == p and s > 4 for rows in files.values() for w, s, _ in rows), lost.get(p, 0)] for p in people}
    assert got == {p: v for p, v in want.items() if v != [0, 0]}
    owners = net(snapshot_entries_from_dumps(spark, str(history.dumps / "blame")))
    assert sum(lines for lines, _ in owners.values()) == sum(map(len, files.values()))


def test_what_was_left_out_is_counted_on_the_way(spark):
    rows = [(p, n, c, a, n) for p, author_lines in {
        "a.py": [("x", "ann"), ("y", "ann")], "b.py": [("// c", "ann")], "c.py": [("z", "unknown")], "d.svg": [("q", "ann")],
        "node_modules/e.py": [("q", "ann")], "f.py": [("q", "ben"), ("", "ben")]}.items() for n, (c, a) in enumerate(author_lines, 1)]
    lines = spark.createDataFrame(rows, "path string, line_no long, content string, raw_author string, touch_seq long")
    tracked = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",), ("c.py",)], "path string")
    aliases, dropped = read_author_config(spark, None), Dropped()
    plain = snapshot_facts(inventory(lines, tracked), aliases)
    counted = snapshot_facts(inventory(lines, tracked, dropped=dropped), aliases, dropped=dropped)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans(plain) == scans(counted)
    assert counted.collect() == plain.collect()
    assert dropped.counts() == {"not_code": 1, "skipped_directory": 1, "ignored": 0, "untracked": 2, "no_lines": 1, "unknown_owner": 1}
    dropped = Dropped()
    assert {r.path for r in window_facts(lines, aliases, 1, dropped=dropped).collect()} == {"a.py"}
    assert dropped.counts() == {"before_window": 6, "no_lines": 1}
    hunks = spark.createDataFrame([("a.py", "c", 1, 2, "ben"), ("gone.py", "c", 1, 2, "ben"), ("a.py", "c", 9, 1, "ben"), ("a.py", "c", 1, 0, "x")],
                                  "path string, commit_id string, start long, cnt long, deleting_author string")
    dropped = Dropped()
    lost = window_losses(hunks, lines.withColumnRenamed("touch_seq", "_t"), aliases, ["path"], dropped=dropped)
    assert [tuple(r) for r in lost.collect()] == [("main_code", "ann", 2)] and dropped.counts() == {"no_parent_lines": 2}


def test_boundary_flag_is_the_window(spark):
    rows = [("a.py", n, "x", "ann", n, n <= 3) for n in range(1, 8)] + [("a.py", 8, "x", "ann", 9, None)]
    lines = spark.createDataFrame(rows, "path string, line_no long, content string, raw_author string, touch_seq long, boundary boolean")
    aliases = read_author_config(spark, None)
    by_flag = window_facts(lines.drop("touch_seq"), aliases, boundary="boundary").collect()
    assert by_flag == window_facts(lines, aliases, 3).collect() and by_flag[0].lines == 5

import csv
import glob
import json
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from creditledger.functions.shares import share_text
from creditledger.operators.order import numbered
from creditledger.operators.rollup import (
    DELETED,
    LINES,
    in_report_order,
    ledger_entries,
    report,
    report_order,
    share_in_group,
    table_rows,
)
from creditledger.session import ensure_checkpoint_dir
from creditledger.sinks import report_files
from creditledger.sinks.report_files import check_outputs_absent, write_report


@pytest.fixture(scope="module")
def books(spark):
    rng = random.Random(2)
    facts = [(f"t{rng.randint(0, 3)}", f'a"{rng.randint(0, 9)}', rng.randint(1, 50)) for _ in range(60)]
    facts += [("only_lines", "solo", 7)]
    lost = [(f"t{rng.randint(0, 3)}", f'a"{rng.randint(5, 14)}', rng.randint(1, 30)) for _ in range(40)]
    lost += [("only_losses", "ghost", 3)]
    f = spark.createDataFrame(facts, "type string, author string, lines long")
    d = spark.createDataFrame(lost, "type string, author string, deleted long")
    return facts, lost, f, d


def total(rows, i, key):
    out = {}
    for r in rows:
        out[key(r)] = out.get(key(r), 0) + r[i]
    return out


def test_levels_agree(books):
    facts, lost, f, d = books
    rows = report(ledger_entries(f, d), with_losses=True).collect()
    by = lambda s: [r for r in rows if r.section == s]
    lines_all, lost_all = sum(x[2] for x in facts), sum(x[2] for x in lost)
    for section in ("by_author_and_type", "by_author_and_type_total", "by_type", "by_author", "total"):
        assert sum(r.lines for r in by(section)) == lines_all
        assert sum(r.deleted for r in by(section)) == lost_all
        assert all(r.net == r.lines - r.deleted for r in by(section))
    assert {r.type: r.lines for r in by("by_type")} == {**total(facts, 2, lambda x: x[0]), "only_losses": 0}
    assert {r.author: r.deleted for r in by("by_author") if r.deleted} == total(lost, 2, lambda x: x[1])
    for section, whole in (("by_type", 100), ("by_author", 100)):
        assert sum(r.share for r in by(section)) == pytest.approx(whole)
    groups = total([(r.type, r.share) for r in by("by_author_and_type")], 1, lambda x: x[0])
    assert all(v == pytest.approx(100) for t, v in groups.items() if t != "only_losses")
    ghost = [r for r in by("by_author_and_type") if r.author == "ghost"][0]
    assert (ghost.lines, ghost.deleted, ghost.net, ghost.percent) == (0, 3, -3, "0.00%")
    assert [r.percent for r in by("by_author_and_type_total") if r.type == "only_losses"] == ["100.00%"]


def reference_order(rows, with_losses):
    t_lines = {r.type: r.lines for r in rows if r.section == "by_type"}
    key = {
        "by_author_and_type_total": lambda r: (0, -t_lines[r.type], r.type, 0, 0, ""),
        "by_author_and_type": lambda r: (0, -t_lines[r.type], r.type, 1, -r.lines, r.author),
        "by_type": lambda r: (1, -r.lines, r.type, 0, 0, ""),
        "by_author": lambda r: (2, 0, "", 0, -(r.net if with_losses else r.lines), r.author),
        "total": lambda r: (3, 0, "", 0, 0, ""),
    }
    return sorted(rows, key=lambda r: key[r.section](r))


@pytest.mark.parametrize("with_losses", [False, True])
def test_order(books, with_losses):
    _, _, f, d = books
    rows = in_report_order(report(ledger_entries(f, d if with_losses else None), with_losses)).collect()
    assert rows == reference_order(rows, with_losses)
    assert all((r.deleted is None) != with_losses for r in rows)


def test_display_rows(books):
    _, _, f, _ = books
    rows = table_rows(report(ledger_entries(f), False), False).collect()
    assert {r.author for r in rows if r.section == "by_author_and_type_total"} == {"(total)"}
    assert all(isinstance(r.lines, str) for r in rows)


def test_share_text_rounds_the_exact_double(spark):
    values = [i / 8 for i in range(1, 800, 2)] + [0.005, 2.675, 1.005, 0.125, 99.995, 100.0, 0.0, 33.333333]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r[0]: r[1] for r in df.select("v", share_text(F.col("v"))).collect()}
    want = {v: f"{Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_EVEN)}%" for v in values}
    assert got == want


@pytest.mark.parametrize("with_losses", [False, True])
@pytest.mark.parametrize("parts", [1, 4])
def test_written_files(spark, books, tmp_path, with_losses, parts):
    _, _, f, d = books
    folder = str(tmp_path / "out")
    entries = ledger_entries(f, d if with_losses else None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        write_report(entries, folder, with_losses)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = in_report_order(report(entries, with_losses)).collect()

    got = []
    for part in sorted(glob.glob(folder + "/report_csv/part-*")):
        with open(part, newline="") as handle:
            got += list(csv.DictReader(handle))
    names = ["category", "type", "author", "lines", "percent"] + (["deleted", "sum"] if with_losses else [])
    assert list(got[0]) == names
    cells = lambda r: [r.section, r.type, r.author, r.lines, r.percent] + ([r.deleted, r.net] if with_losses else [])
    assert [list(r.values()) for r in got] == [["" if v is None else str(v) for v in cells(r)] for r in want]

    text = "".join(open(p).read() for p in sorted(glob.glob(folder + "/report_json/part-*")))
    document = json.loads(text)
    extra = lambda r: {"deleted": r.deleted, "sum": r.net} if with_losses else {}
    pick = lambda s: [r for r in want if r.section == s]
    assert list(document) == ["by_author_and_type", "by_type", "by_author", "total"]
    assert document["by_type"] == [{"type": r.type, "lines": r.lines, "percent": r.percent, **extra(r)} for r in pick("by_type")]
    assert document["by_author"] == [{"author": r.author, "lines": r.lines, "percent": r.percent, **extra(r)} for r in pick("by_author")]
    assert document["by_author_and_type"] == [
        {"type": g.type, "total_lines": g.lines, "authors": [
            {"author": r.author, "lines": r.lines, "percent": r.percent, **extra(r)}
            for r in pick("by_author_and_type") if r.type == g.type]}
        for g in pick("by_author_and_type_total")]
    t = pick("total")[0]
    assert document["total"] == {"total_lines": t.lines, **({"total_deleted": t.deleted, "total_sum": t.net} if with_losses else {})}

    with pytest.raises(FileExistsError):
        check_outputs_absent(spark, folder)
    with pytest.raises(FileExistsError):
        write_report(entries, folder, with_losses)


def test_nothing_to_report(spark, books, tmp_path):
    _, _, f, d = books
    with pytest.raises(ValueError):
        write_report(ledger_entries(f.limit(0)), str(tmp_path / "none"), False)
    write_report(ledger_entries(f.limit(0), d), str(tmp_path / "losses"), True)
    document = json.loads("".join(open(p).read() for p in sorted(glob.glob(str(tmp_path) + "/losses/report_json/part-*"))))
    assert document["total"]["total_lines"] == 0 and document["total"]["total_deleted"] > 0


def test_checkpoint_folder_in_use_stays(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert folder and spark.sparkContext.getCheckpointDir() == folder


def test_csv_keeps_blanks_at_the_ends_of_names(spark, tmp_path):
    names = [" Bob", "Bob", "Bob ", "\tBob"]
    entries = spark.createDataFrame([("code", n, LINES, 1) for n in names], "type string, author string, entry string, n long")
    write_report(entries, str(tmp_path / "out"), with_losses=False)
    rows = spark.read.csv(
        str(tmp_path / "out" / "report_csv"), header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    assert sorted({r.author for r in rows.collect() if r.author}) == sorted(names)


def test_numeric_authors_have_a_document(spark, tmp_path):
    entries = spark.createDataFrame(
        [("code", 7, LINES, 2), ("code", 8, DELETED, 1)], "type string, author long, entry string, n long"
    )
    write_report(entries, str(tmp_path / "out"), with_losses=True)
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "out" / "report_json")).collect())
    assert {x["author"] for x in json.loads(text)["by_author"]} == {7, 8}


def test_null_type_keeps_its_share(spark):
    entries = spark.createDataFrame(
        [(None, "a", LINES, 1), (None, "b", LINES, 3), ("code", "a", LINES, 2)], "type string, author string, entry string, n long"
    )
    got = {(r.type, r.author): (r.lines, r.group_lines) for r in share_in_group(entries).collect()}
    assert got == {(None, "a"): (1, 4), (None, "b"): (3, 4), ("code", "a"): (2, 2)}


def _died(*args, **kwargs):
    raise RuntimeError("died")


def test_both_outputs_or_neither(spark, books, tmp_path, monkeypatch):
    _, _, f, d = books
    entries, folder = ledger_entries(f, d), str(tmp_path / "out")
    seen = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(report_files, "write_json", _died)
        write_report(entries, folder, True)
    assert seen() == [report_files.STAGED_NAME]
    # A run that dies between the renames leaves its note, and the next one clears up.
    store = report_files._store

    def once(spark, folder):
        inner, path = store(spark, folder)
        renames = iter([inner.rename, _died])

        class Store:
            def __getattr__(self, name):
                return next(renames) if name == "rename" else getattr(inner, name)

        return Store(), path

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(report_files, "_store", lambda spark, folder: (patch.setattr(report_files, "_store", once), store(spark, folder))[1])
        write_report(entries, folder, True)
    assert report_files.NOTE_NAME in seen() and "report_json" not in seen()
    write_report(entries, folder, True)
    assert seen() == ["report_csv", "report_json"]
    with pytest.raises(FileExistsError):
        write_report(entries, folder, True)
    assert seen() == ["report_csv", "report_json"]


@pytest.mark.parametrize("with_losses", [False, True])
def test_numbered_rows(spark, books, with_losses):
    _, _, f, d = books
    rows = report(ledger_entries(f, d), with_losses)
    want = [tuple(r)[:6] for r in in_report_order(rows).collect()]
    got = sorted(numbered(rows, report_order()).collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in got] == list(range(1, len(want) + 1)) and [tuple(r)[:6] for r in got] == want
    many = spark.range(20_000).select(F.hash("id").alias("v"), "id").repartition(7)
    got = {r.id: r.n for r in numbered(many, [F.desc("v"), F.col("id")], "n").collect()}
    by_value = sorted(many.collect(), key=lambda r: (-r.v, r.id))
    assert [got[r.id] for r in by_value] == list(range(1, 20_001))
    assert numbered(many.filter("false"), [F.col("v")]).collect() == []

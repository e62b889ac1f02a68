import hashlib
import re

import pytest

from creditledger.llm.exact import drop_exact_copies, exact_groups, merge_runs
from tests.llm.conftest import EDGES


def brute(rows):
    text = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, t in zip(rows, text, strict=True):
        groups.setdefault(t, []).append(r[0])
    out = []
    for r, t in zip(rows, text, strict=True):
        keep = min((i for i in groups[t] if i is not None), default=None)
        out.append((r[0], keep, len(groups[t]), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_edges(edges, fan_in):
    assert sorted(map(tuple, exact_groups(edges, fan_in).collect()), key=repr) == brute(EDGES)


def test_group_of_many_and_many_runs(table):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(400)]
    assert sorted(map(tuple, exact_groups(table(rows, 9), 2).collect()), key=repr) == brute(rows)


def test_empty(nothing):
    assert exact_groups(nothing).count() == 0


def test_drop_keeps_columns(edges):
    left = drop_exact_copies(edges)
    assert left.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 4, 6, 7, 8]


def test_a_digest_of_two_texts_ends_the_job(spark):
    runs = spark.createDataFrame(
        [(0, "ab", "abc", 1, 1, 1, 1), (1, "ab", "abc", 2, 2, 2, 1)],
        "run int, range string, sha string, size int, second long, keep_id long, n long",
    )
    with pytest.raises(Exception, match="two texts"):
        merge_runs(runs, 2).collect()


def test_repeated_ids_lose_no_text_and_keep_no_copy(spark, table):
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in drop_exact_copies(table(rows)).collect()), key=repr)
    assert kept([(1, "aaa"), (5, "unique text"), (5, "aaa")]) == [(1, "aaa"), (5, "unique text")]
    assert kept([(1, "aaa"), (1, "aaa"), (1, "aaa"), (2, "b")]) == [(1, "aaa"), (2, "b")]
    assert kept([(1, "a  b"), (1, "a b"), (3, "a\tb")]) == [(1, "a  b")]
    assert kept([(None, "aaa"), (7, "aaa"), (8, "aaa"), (8, "bbb")]) == [(7, "aaa"), (8, "bbb"), (None, "aaa")]
    rows = [(1, "aaa", lang) for lang in ("fr", "de", "en", "de")]
    assert [r.lang for r in drop_exact_copies(table(rows)).collect()] == ["de"]


def test_runs_are_merged_in_order_two_at_a_time(spark):
    runs = spark.createDataFrame(
        [(r, f"{d:02x}", d, d, None if r == 2 else 100 * d + r, 1) for r in range(7) for d in range(40) if (d + r) % 3],
        "run int, sha string, size int, second long, keep_id long, n long",
    )
    merged = merge_runs(runs, 7)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 3 and "HashAggregate" not in plan and "Python" not in plan
    got = {r.sha: (r.keep_id, r.n) for r in merged.collect()}
    want = {}
    for d in range(40):
        have = [r for r in range(7) if (d + r) % 3]
        want[f"{d:02x}"] = (min(100 * d + r for r in have if r != 2), len(have))
    assert got == want

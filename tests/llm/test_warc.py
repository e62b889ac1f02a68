import glob
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from creditledger.llm.warc import read_archive, shard_edges, write_archive

LONG = "<p>" + "x" * 1000
PAGES = [
    (1, "http://a/1", LONG),
    (2, "http://a/2?q=ä\r\nX: y", LONG),
    (3, None, "short"),
    (4, "http://a/4", "short"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "é😀\r\n\r\n" + "WARC/1.1\r\n" * 300),
    (9, "http://a/9", LONG),
    (9, "http://a/9b", LONG),
    (None, "http://a/none", LONG),
    (10**15, "http://a/far", "z" * 200_000),
]


@pytest.fixture
def pages(spark):
    rows = [(*r, "x", "y") for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard string, payload string")


def archive(pages, tmp_path, name, **settings):
    folder = f"file://{tmp_path}/{name}"
    return folder, write_archive(pages, folder, **settings)


def test_round_trip(pages, tmp_path):
    folder, manifest = archive(pages, tmp_path, "a", shard_bytes=2000, roll_bytes=1500)
    rows = read_archive(manifest, folder).collect()
    assert len(rows) == len(PAGES) and manifest.count() > 2
    want = sorted((p[0] or 0, (p[2] or "").encode()) for p in PAGES)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in rows) == sorted(
        (i, len(b), hashlib.sha1(b).hexdigest()) for i, b in want
    )
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows if r.payload_bytes == 1003)
    nine = [(9, "response", None), (9, "revisit", 9)]
    assert kinds == [(0, "response", None), (1, "revisit", 9), (2, "revisit", 9), *nine]
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 1000)
    whole = {(r.page_id, bytes(r.payload)) for r in rows if r.payload is not None}
    assert whole <= {(p[0], (p[2] or "").encode()) for p in PAGES}


def test_files_do_not_depend_on_the_cluster(pages, tmp_path):
    def sums(name, df):
        folder, manifest = archive(df, tmp_path, name, shard_bytes=3000, roll_bytes=2000)
        files = {os.path.basename(p): open(p, "rb").read() for p in glob.glob(f"{tmp_path}/{name}/*.gz")}
        assert {r.name: r.sha256 for r in manifest.collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}
        assert not os.path.exists(f"{tmp_path}/{name}/_temporary")
        return files

    assert sums("b", pages.repartition(1)) == sums("c", pages.orderBy(F.desc("url")).repartition(5))


def test_plain_readers_can_read_it(pages, tmp_path):
    archive(pages, tmp_path, "d")
    data = b"".join(gzip.open(p).read() for p in sorted(glob.glob(f"{tmp_path}/d/*.gz")))
    assert data.count(b"\r\nWARC-Type: response\r\n") == 8 and b"\r\nX: y" not in data


def test_damage_is_noticed(pages, tmp_path):
    folder, manifest = archive(pages, tmp_path, "e")
    path = sorted(glob.glob(f"{tmp_path}/e/*.gz"))[0]
    data = bytearray(open(path, "rb").read())
    data[-60] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        read_archive(manifest, folder).collect()


def test_empty(pages, tmp_path):
    folder, manifest = archive(pages.filter("false"), tmp_path, "f")
    assert manifest.count() == 0 and read_archive(manifest, folder).count() == 0


def test_shards_follow_crowded_ids(spark):
    ids = [*range(500), *range(10**12, 10**12 + 500)]
    rows = spark.createDataFrame([(i, bytearray(1000)) for i in ids], "page_id long, payload binary")
    edges = shard_edges(rows, 100_000)
    sizes = [sum(a <= i < b for i in ids) for a, b in zip([-1, *edges], [*edges, 10**13], strict=True)]
    assert edges == sorted(edges) and sum(sizes) == 1000 and max(sizes) <= 70


@pytest.mark.parametrize("lost", ["members", "file", "all"])
def test_lost_records_are_noticed(pages, tmp_path, lost):
    """A file cut off between two records is whole gzip, but not what the manifest says."""
    folder, manifest = archive(pages, tmp_path, "g" + lost)
    path = max(glob.glob(f"{tmp_path}/g{lost}/*.gz"), key=os.path.getsize)
    data = open(path, "rb").read()
    starts = [i for i in range(len(data)) if data[i : i + 4] == b"\x1f\x8b\x08\x00"]
    assert len(starts) > 2
    if lost == "file":
        os.remove(path)
    else:
        open(path, "wb").write(data[: starts[-1]] if lost == "members" else b"")
    with pytest.raises(Exception, match="manifest|No such file|not found"):
        read_archive(manifest, folder).collect()


def test_every_shard_is_a_task(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", "x" * 900) for i in range(400)], "page_id long, url string, html string")
    manifest = write_archive(rows, f"file://{tmp_path}/many", shard_bytes=20_000)
    assert manifest.select("shard").distinct().count() > 10
    # The temporary names end in the attempt that wrote them.
    written = manifest.select("shard", F.substring_index("temporary", ".", -1).alias("attempt")).distinct()
    assert written.groupBy("attempt").count().agg(F.max("count")).first()[0] == 1

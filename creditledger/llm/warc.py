"""A deterministic, sharded WARC writer, and the reader that checks it.

1. Of records with equal payloads of REVISIT_BYTES or more, the one with the largest
   page_id is the response; the others are revisits. Payloads are compared by SHA-256;
   a group is reduced to one row per task before the shuffle.
2. Records are dealt into shards by ranges of page_id. The ranges follow from the
   sizes alone: a histogram over equal parts of the ids, refined where a part is too
   large, is cut where a shard is full. Only that histogram comes to the driver,
   about PARTS numbers per shard.
3. A task sorts its shards by page_id and writes each record as a gzip member of its
   own, with fixed dates and regenerated headers and digests, into a file under a
   temporary name; at `roll_bytes` it goes on in the next file. Equal input gives
   equal files, whatever the cluster.
4. The files of the tasks that ended are the rows of the manifest. Each is renamed to
   its final name, which can be repeated, and files of lost attempts are removed.

The payload is shuffled once; which records are revisits arrives as small rows that
sort next to theirs. Files are reached with pyarrow.fs, at any URI it knows.

Defined cases: empty table, a manifest without files; null html, an empty payload;
null page_id, always a response, in the first shard; rows that repeat a page_id are
records of their own, and of those with equal long payloads one is the response;
null url, `urn:page:<id>`. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import stored

REVISIT_BYTES = 1000
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
PARTS = 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, temporary string, name string, bytes long, records long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, refers_to) of the records whose payload a larger page_id has too."""
    long = pages.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    sums = long.select("page_id", F.sha2("payload", 256).alias("sum"))
    groups = sums.groupBy("sum").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"))
    groups = groups.filter("first <> refers_to").drop("first")
    return sums.join(groups, "sum").filter("page_id <> refers_to").select("page_id", "sum", "refers_to")


def shard_edges(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """The first page_id of every shard but the first."""
    sizes = pages.filter("page_id IS NOT NULL").select("page_id", (F.octet_length("payload") + 512).alias("size"))
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:
        return []
    n = PARTS * -(-total // shard_bytes)
    # A power of two, so that parts of the next round nest in those of this one.
    step = 1 << (-(-(high - low + 1) // n) - 1).bit_length()
    parts, measured = None, []
    while True:
        part = F.floor((F.col("page_id") - low) / step).cast("long")
        counted = sizes if parts is None else sizes.join(parts, F.floor((F.col("page_id") - low) / wide).cast("long") == F.col("big"))
        heavy = []
        for p, size in counted.groupBy(part.alias("part")).agg(F.sum("size")).collect():
            if size > shard_bytes and step > 1:
                heavy.append((p,))
            else:
                measured.append((low + p * step, size))
        if not heavy:
            break
        parts, wide = pages.sparkSession.createDataFrame(heavy, "big long"), step
        step = max(1, step // PARTS)
    edges, held = [], 0
    for first, size in sorted(measured):
        if held and held + size > shard_bytes:
            edges.append(first)
            held = 0
        held += size
    return edges


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit where `refers_to` is set, as a gzip member."""
    digest = _base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    # Everything that is no printable ASCII letter is written in percent form.
    target = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _base32(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Refers-To", _name(refers_to, digest)),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
            ("WARC-Profile", PROFILE),
        ]
    return _record(fields, block)


class _Roller:
    """Writes the files of one shard under temporary names."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, roll_bytes: int, attempt: str):
        self.store, self.root, self.shard, self.roll, self.attempt = store, root, shard, roll_bytes, attempt
        self.part, self.out, self.rows = 0, None, []

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.part:04d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{self.attempt}"
        self.out = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.size, self.records, self.sum = 0, 0, hashlib.sha256()
        info = f"format: WARC File Format 1.1\r\nshard: {self.shard}\r\npart: {self.part}\r\n".encode()
        self._put(
            _record(
                [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", _name(None, self.name)),
                    ("WARC-Date", DATE),
                    ("WARC-Filename", self.name),
                    ("Content-Type", "application/warc-fields"),
                ],
                info,
            )
        )

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def write(self, record: bytes) -> None:
        if self.out is not None and self.records and self.size + len(record) > self.roll:
            self.close()
        if self.out is None:
            self._open()
        self._put(record)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.temporary, self.name, self.size, self.records, self.sum.hexdigest()))
            self.part, self.out = self.part + 1, None


def write_archive(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = REVISIT_BYTES
) -> DataFrame:
    """Writes page_id, url, html of `pages` to WARC files in `folder`, a URI that all
    executors see; returns the manifest, one row per file."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    )
    edges = np.array(shard_edges(rows, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        known = page_id.notna().to_numpy()
        found = np.searchsorted(edges, page_id.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(known, found, 0).astype(np.int32))

    # A revisit's row sorts just ahead of the records of its page_id.
    marks = revisits(rows, least).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sum", "refers_to"
    )
    every = rows.withColumns({"sum": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long")}).union(marks)
    placed = (
        every.withColumn("shard", shard_of("page_id"))
        .repartitionById(len(edges) + 1, "shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), F.col("refers_to").isNull(), "sum", "url", "payload")
        .select("shard", "page_id", "url", "payload", "sum", "refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        roller, done, at, marks, seen = None, [], object(), {}, set()
        for batch in batches:
            for shard, page, url, payload, total, refers in zip(*(batch.column(c) for c in range(6)), strict=True):
                shard, page, payload, refers = shard.as_py(), page.as_py(), payload.as_py(), refers.as_py()
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.rows
                    roller, at = _Roller(store, root, shard, roll_bytes, attempt), object()
                if page != at:
                    at, marks, seen = page, {}, set()
                if refers is not None:
                    marks[total.as_py()] = refers
                    continue
                to = None
                if len(payload) >= least and page is not None:
                    digest = hashlib.sha256(payload).hexdigest()
                    to = marks.get(digest, page if digest in seen else None)
                    seen.add(digest)
                roller.write(page_record(page, url.as_py(), payload, to))
        if roller is not None:
            roller.close()
            done += roller.rows
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            columns = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                made = store.get_file_info(f"{root}/{temporary}").type == fs.FileType.File
                if made:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} is not what the manifest says")
            yield batch

    manifest = stored(placed.mapInArrow(write, MANIFEST), "manifest")
    committed = stored(manifest.mapInArrow(rename, MANIFEST), "committed")
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary")
    return committed


class _Total:
    """Size and digest of what has been read."""

    def __init__(self):
        self.size, self.sum = 0, hashlib.sha256()

    def update(self, data: bytes) -> None:
        self.size += len(data)
        self.sum.update(data)


def _members(stream: pa.NativeFile, total: _Total) -> Iterator[bytes]:
    """The gzip members of a file, one after another; all its bytes go into `total`."""
    inflate, out = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        total.update(chunk)
        while chunk:
            out.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(out)
                inflate, out = zlib.decompressobj(31), []
    if out and any(out):
        raise OSError("the file ends within a record")


def parse_record(data: bytes) -> tuple | None:
    """The row of a response or revisit record, checked against its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise OSError("not a WARC record")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b": ")[2])
    digest = fields["WARC-Payload-Digest"]
    response = fields["WARC-Type"] == "response"
    if _base32(block) != fields["WARC-Block-Digest"] or response and (_base32(payload) != digest or len(payload) != length):
        raise OSError(f"{fields['WARC-Record-ID']} is damaged")
    page, refers = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
    return (
        int(page) if page else None,
        fields["WARC-Target-URI"],
        fields["WARC-Type"],
        int(refers) if refers else None,
        length,
        base64.b32decode(digest[5:]).hex(),
        payload if response else None,
    )


_CHECKED = ("name", "bytes", "records", "sha256")


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's files: page_id, url, record_type, refers_to,
    payload_bytes and payload_digest (of the full payload), payload (of responses). A file
    that is missing, or has not the bytes, records or digest that the manifest gives,
    ends the job."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, records, digest in zip(*(batch.column(c).to_pylist() for c in _CHECKED), strict=True):
                rows, held, found, total = [], 0, 0, _Total()
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream, total):
                        if (row := parse_record(member)) is not None:
                            rows.append(row)
                            held += len(member)
                            found += 1
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if (total.size, found, total.sum.hexdigest()) != (size, records, digest):
                    raise OSError(f"{name} is not what the manifest says: {found} of {records} records, {total.size} of {size} bytes")
                if rows:
                    yield batch_of(rows)

    # A number of its own keeps adaptive execution from reading all files in one task.
    files = manifest.select(*_CHECKED).repartition(max(1, manifest.count()), "name")
    return files.mapInArrow(read, RECORDS)


"""Passages repeated across documents: a depth-limited radix sort of suffixes.

Every byte covered by a string of `depth` bytes that also starts in a document
with a smaller doc_id is cut. Suffixes are told apart through `depth` bytes only,
by digits, and most significant first; a group of one document leaves at once.

The suffixes that are sorted are a content-defined sample: of every string of
`depth` bytes, the place in it where the GRAM bytes ahead have the smallest hash
(its anchor). Equal strings have equal anchors, so comparing the strings of equal
anchors compares all. About one place in (depth - GRAM) / 2 is an anchor.

1. First digit, the GRAM bytes at the anchor; second digit, the whole run of bytes
   whose strings share the anchor. Suffixes are dealt into buckets by the first.
   Equal in both: all but the smallest document are cut. Equal in the first alone:
   left for the next pass. A task settles equal runs among its own documents before
   it sends them, so a group of copies of any size sends one row per part.
2. What is left is compared string by string: the bytes of a run are fetched, rows
   of equal first digits meet, and equal strings keep the smallest document. A first
   digit with more than HOT rows is not brought together: its strings are dealt by
   their own hash and reduced before the shuffle.

Between the passes only rows of places are written; the text is shuffled once, and
that exchange serves both the fetching and the final cut.

Defined cases: empty table, no rows; null text, 0 bytes; null doc_id, left alone and
no source for others; rows that repeat a doc_id are judged one by one, and are no
source for each other; texts shorter than `depth` are left alone. Further columns
are ignored. Equality is by hashes of 88 bits and more, in the last pass of 64 bits
within one first digit of 48.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import Ranges, flat, slices, stored

DEPTH = 50
GRAM = 20
#: Text whose runs are settled together before they are sent; text for each bucket.
PART_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
HOT = 50_000
KEY_BITS, RUN_BITS = 48, 40
_PLACE = np.uint64(0xFFFFFF)


def anchors(data: np.ndarray, places: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with the same anchor: first and last start, text, hash of the
    gram at the anchor, hash of the run's bytes."""
    empty = np.zeros(0, np.int64)
    if len(data) < depth:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    ranges = Ranges(data)
    at = np.arange(len(data) - gram + 1)
    order = ranges(at, at + gram)
    # The place in the low bits makes the first of equal grams the smallest.
    least = (order & ~_PLACE) | (at.astype(np.uint64) & _PLACE)
    width, size = depth - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    start = np.arange(len(least))
    anchor = (least & _PLACE).astype(np.int64)
    anchor += start & ~int(_PLACE)
    anchor[anchor < start] += int(_PLACE) + 1
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(start)]
    whole = start + depth <= places[text + 1]
    begins = np.ones(len(start), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(begins & whole)
    last = np.flatnonzero(whole & np.append(begins[1:] | ~whole[1:], True))
    return first, last, text[first], order[anchor[first]], ranges(first, last + depth)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _unpack(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, : data.shape[1]] = data
    return wide.view("<u8").ravel()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _smallest(group: np.ndarray, doc: np.ndarray, shift: int) -> np.ndarray:
    """For sorted rows, whether a row's document comes after the group's smallest. `group`: begins."""
    if not len(doc):
        return group
    real = doc >> shift
    least = np.minimum.reduceat(real, np.flatnonzero(group))
    return real > least[np.cumsum(group) - 1]


_RUNS = "bucket int, base long, wide int, runs binary, cuts binary"


def _deal(buckets: int, depth: int, gram: int, shift: int):
    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, run, doc, at, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, run = key >> np.uint64(64 - KEY_BITS), run >> np.uint64(64 - RUN_BITS)
        order = np.lexsort((at, doc, run, key))
        key, run, doc, at, more = key[order], run[order], doc[order], at[order], more[order]
        cut = _smallest(_starts(key, run), doc, shift)
        # Of one document's equal runs all stay: each may have to be cut.
        cuts = np.stack([doc[cut], at[cut], at[cut] + more[cut] + depth]).astype("<i8")
        key, run, doc, at, more = (x[~cut] for x in (key, run, doc, at, more))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        base = int(doc.min()) if len(doc) else 0
        width = max(1, (int(doc.max()) - base).bit_length() + 7 >> 3) if len(doc) else 1
        packed = np.hstack(
            [_pack(x[order], w) for x, w in ((key, 6), (run, 5), (doc - base, width), (at, 4), (more, 1))]
        )
        rows, own = [], int(key[0] % np.uint64(buckets)) if len(key) else 0
        for b in range(buckets):
            if edges[b] < edges[b + 1] or b == own:
                part = packed[edges[b] : edges[b + 1]].tobytes()
                rows.append((b, base, width, part, cuts.tobytes() if b == own else b""))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for low in range(0, len(rows), 256):
            columns = zip(*rows[low : low + 256], strict=True)
            names = ["bucket", "base", "wide", "runs", "cuts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, "text", 1 << 20):
            data, places = flat(batch.column("text"))
            first, last, text, key, run = anchors(data, places, depth, gram)
            doc = batch.column("doc").to_numpy()[text] if len(text) else text
            parts.append((key, run, doc, first - places[text], last - first))
            held += len(data)
            if held >= PART_BYTES:
                yield from settle(parts)
                parts, held = [], 0
        if parts:
            yield from settle(parts)

    return deal


_FOUND = "doc long, low long, high long, key long, hot boolean"


def _found(*parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, bool | np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "low", "high", "key", "hot"]
    for doc, low, high, key, hot in parts:
        for at in range(0, len(doc), 100_000):
            s = slice(at, at + 100_000)
            n = len(doc[s])
            keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key[s].astype(np.int64))
            hots = pa.array(np.zeros(n, bool) if key is None else hot[s])
            numbers = [pa.array(np.ascontiguousarray(x[s], np.int64)) for x in (doc, low, high)]
            yield pa.RecordBatch.from_arrays([*numbers, keys, hots], names)


def _sort_buckets(depth: int, shift: int, hot: int):
    def finish(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        columns = []
        for base, width, raw in held:
            rows = np.frombuffer(raw, np.uint8).reshape(-1, 16 + width)
            cut = np.cumsum([0, 6, 5, width, 4, 1])
            key, run, doc, at, more = (_unpack(rows[:, a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
            columns.append((key, run, doc.astype(np.int64) + base, at.astype(np.int64), more.astype(np.int64)))
        key, run, doc, at, more = (np.concatenate(x) for x in zip(*columns, strict=True))
        order = np.lexsort((at, doc, run, key))
        key, run, doc, at, more = key[order], run[order], doc[order], at[order], more[order]
        keys, runs = _starts(key), _starts(key, run)
        if not len(key):
            return
        cut = _smallest(runs, doc, shift)
        group = np.cumsum(keys) - 1
        real = doc >> shift
        begin = np.flatnonzero(keys)
        several = np.minimum.reduceat(real, begin) != np.maximum.reduceat(real, begin)
        left = several[group] & ~cut & (np.add.reduceat(runs.astype(np.int64), begin) > 1)[group]
        many = np.bincount(group[left], minlength=len(begin)) > hot
        high = at + more + depth
        yield from _found(
            (doc[cut], at[cut], high[cut], None, False),
            (doc[left], at[left], high[left], key[left], many[group[left]]),
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, base, width, runs, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cuts:
                    doc, low, high = np.frombuffer(cuts, "<i8").reshape(3, -1)
                    yield from _found((doc, low, high, None, False))
                if bucket != now and held:
                    yield from finish(held)
                    held = []
                now = bucket
                held.append((base, width, runs))
        if held:
            yield from finish(held)

    return sort


def _strings(data: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and hash of every string of `depth` bytes in data[low:high] of each row."""
    count = high - low - depth + 1
    row = np.repeat(np.arange(len(low)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
    return row, start, Ranges(data)(start, start + depth)


def _compare(depth: int, shift: int):
    """Rows (key, doc, low, bytes), sorted by key: cuts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            column = table.column("bytes")
            data, places = flat(column.chunk(0) if column.num_chunks else pa.array([], pa.binary()))
            key, doc, low = (table.column(c).to_numpy() for c in ("key", "doc", "low"))
            row, start, string = _strings(data, places[:-1], places[1:], depth)
            key, doc, at = key[row], doc[row], low[row] + start - places[row]
            order = np.lexsort((at, doc, string, key))
            cut = np.zeros(len(order), bool)
            cut[order] = _smallest(_starts(key[order], string[order]), doc[order], shift)
            # Neighbouring strings of a row go out as one cut.
            edge = np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))
            new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]) & cut)
            begin = np.union1d(np.flatnonzero(edge == 1), new)
            end = np.append(begin[1:], len(cut))
            stop = np.flatnonzero(edge == -1)
            end = np.minimum(end, stop[np.searchsorted(stop, begin, "right")] if len(begin) else end)
            yield from _found((doc[begin], at[begin], at[end - 1] + depth, None, False))

        held, size = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            # Whole keys are worked on together, many at a time.
            for low, high in zip(edges, edges[1:], strict=False):
                if size > 20_000 and keys[low] != held[-1].column("key")[-1].as_py():
                    yield from settle(held)
                    held, size = [], 0
                held.append(batch.slice(low, high - low))
                size += high - low
        if size:
            yield from settle(held)

    return compare


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for batch in slices(batches, "text"):
        rows = []
        for doc, text, cuts in zip(*(batch.column(c) for c in ("doc_id", "text", "cuts")), strict=True):
            data = text.as_py() or b""
            spans = np.array([], np.int64).reshape(0, 2)
            if cuts.is_valid and len(cuts):
                pairs = cuts.values
                spans = np.stack([pairs.field("low").to_numpy(), pairs.field("high").to_numpy()], axis=1)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                reach = np.maximum.accumulate(spans[:, 1])
                first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
                spans = np.stack([spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])], axis=1)
            out, at = [], 0
            for low, high in spans.tolist():
                out.append(data[at:low])
                at = high
            kept = b"".join([*out, data[at:]])
            rows.append((doc.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        columns = zip(*rows, strict=True)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def cut_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    bytes that stay; where a cut parts a letter they are no valid UTF-8)."""
    if not 1 <= gram <= depth <= gram + 255:
        raise ValueError("gram must be from depth - 255 to depth")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    per_id = rows.groupBy("doc_id").agg(
        F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"), F.min(F.abs("doc_id")).alias("far")
    )
    total, most, far = per_id.agg(F.sum("size"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.max("far")).first()
    buckets = buckets or max(256, -(-(total or 0) // BUCKET_BYTES))
    # Rows that share an id are numbered in the low bits of `doc`.
    shift = max((most or 1) - 1, 0).bit_length()
    if (far or 0).bit_length() + shift > 62:
        raise ValueError("the ids leave no room to number the rows that share one")
    doc = F.col("doc_id")
    if shift:
        twin = F.xxhash64("text")
        again = rows.select("doc_id", twin.alias("twin")).distinct()
        several = again.groupBy("doc_id").agg(F.sort_array(F.collect_list("twin")).alias("twins")).filter(F.size("twins") > 1)
        rows = rows.withColumn("twin", twin).join(several, "doc_id", "left")
        doc = F.shiftleft("doc_id", shift) + F.coalesce(F.array_position("twins", F.col("twin")) - 1, F.lit(0))
    rows = rows.select("doc_id", doc.alias("doc"), "text")

    dealt = rows.filter("doc IS NOT NULL").select("doc", "text").mapInArrow(_deal(buckets, depth, gram, shift), _RUNS)
    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket")
    found = stored(sorted_.mapInArrow(_sort_buckets(depth, shift, hot), _FOUND), "runs")

    texts = rows.repartition("doc")
    places = F.collect_list(F.struct("low", "high", "key", "hot"))
    wanted = found.filter("key IS NOT NULL").groupBy("doc").agg(places.alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hot", "doc", "low", "bytes"]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        for batch in slices(batches, "text"):
            out = []
            for doc, text, places in zip(*(batch.column(c) for c in ("doc", "text", "places")), strict=True):
                data, doc = text.as_py(), doc.as_py()
                low, high, key, hot = (places.values.field(c).to_pylist() for c in ("low", "high", "key", "hot"))
                out += [(k, h, doc, a, data[a:b]) for a, b, k, h in zip(low, high, key, hot, strict=True)]
            for at in range(0, len(out), 50_000):
                columns = zip(*out[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    fetched = texts.join(wanted, "doc").select("doc", "text", "places").mapInArrow(fetch, "key long, hot boolean, doc long, low long, bytes binary")
    together = fetched.filter("NOT hot").select("key", "doc", "low", "bytes").repartition("key").sortWithinPartitions("key")
    cuts = found.filter("key IS NULL").select("doc", "low", "high").union(
        together.mapInArrow(_compare(depth, shift), _FOUND).select("doc", "low", "high")
    )
    if not found.filter("hot").isEmpty():
        cuts = cuts.union(_hot_strings(fetched.filter("hot"), depth, shift))
    spans = cuts.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    done = texts.join(spans, "doc", "left").select("doc_id", "text", "cuts")
    return done.mapInArrow(
        _cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _hot_strings(fetched: DataFrame, depth: int, shift: int) -> DataFrame:
    """Cuts of runs whose first digit is too common to bring together: one row per
    string, reduced to the smallest document before the shuffle."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            data, places = flat(batch.column("bytes"))
            row, start, string = _strings(data, places[:-1], places[1:], depth)
            columns = [
                batch.column("key").to_numpy()[row],
                string.view(np.int64),
                batch.column("doc").to_numpy()[row],
                batch.column("low").to_numpy()[row] + start - places[row],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "string", "doc", "low"])

    rows = fetched.select("key", "doc", "low", "bytes").mapInArrow(spread, "key long, string long, doc long, low long")
    real = F.shiftright("doc", shift)
    least = rows.groupBy("key", "string").agg(F.min(real).alias("least"), F.max(real).alias("most")).filter("least <> most")
    return rows.join(least, ["key", "string"]).filter(real > F.col("least")).select("doc", "low", (F.col("low") + depth).alias("high"))

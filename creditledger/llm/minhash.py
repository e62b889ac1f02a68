"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, links
confirmed on full shingle sets.

A document's set is its distinct shingles of five words (A-Z in lower case, words
parted by ASCII white space; fewer words are one shingle). Two documents are linked
when `percent` % of the union of their sets is in both.

1. Documents with equal sets are one class; classes go on, copies do not.
2. A signature has SLOTS slots of 8 bits. Pairs at the linking similarity differ in
   more than `distance` slots with a probability below MISS; that is the radius.
   The slots are split into chunks, so few that by the pigeonhole principle every
   pair within the radius agrees on some chunk up to one slot. Leaving out each slot
   of each chunk in turn enumerates these errors: equal keys find every such pair.
3. Classes that share a key form a bucket (buckets with the same members are taken
   once). A bucket gives the edges of a spanning forest of its pairs within the
   radius, one per class at most. Components of the forests are families.
4. In a family the intersections of full sets are counted through the shingles; a
   spanning forest of the confirmed links is what leaves the task. Its components
   are the result.

A bucket or family beyond one block is cut into blocks, and pairs of blocks are
worked on as cells of their own, so a task holds two blocks whatever the size of
the group, and no pair is lost. Pairs are never emitted. The work within one family
of distinct near copies grows with the square of its blocks; exact copies are free.

Defined cases: empty table, no rows; null text or no words: no shingles, linked
with nothing, its own component; null doc_id: linked with nothing, component null,
kept; repeated rows share a component. Further columns are ignored. Shingles are
compared as 64-bit hashes, classes as 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import Ranges, flat, keep_rows, mix, slices, stored, text_key, word_edges
from creditledger.llm.graph import cells, column, components, forest_edges

PERCENT = 85
WORDS = 5
SLOTS = 64
MISS = 1e-5
#: Members of a bucket, and shingles of a family, that are a block.
BUCKET_BLOCK = 4096
FAMILY_BLOCK = 1_000_000
#: So many ids (16 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SLOT = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_STEP = [mix(np.uint64([k]))[0] | np.uint64(1) for k in range(1, 17)]


def radius(percent: int, slots: int = SLOTS, miss: float = MISS) -> int:
    """The number of differing slots that a pair of that similarity exceeds with a
    probability below `miss`."""
    p, tail = 1 - percent / 100, 1.0
    for k in range(slots + 1):
        tail -= comb(slots, k) * p**k * (1 - p) ** (slots - k)
        if tail < miss:
            return k
    return slots


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as sorted 64-bit hashes, and where each text's begin."""
    data, places = flat(column, b" ")
    data = _LOWER[data]
    start, end = word_edges(~_SPACE[data])
    word = Ranges(data)(start, end)
    bounds = np.searchsorted(start, places)
    count = np.diff(bounds)
    n = len(word)
    shingle = np.zeros(n, np.uint64)
    for k in range(words):
        shingle[: n - k] = shingle[: n - k] * _STEP[k % 16] + word[k:] if n > k else shingle[: n - k]
    valid = np.zeros(n, bool)
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(n) - bounds[:-1][owner]
    valid = place <= count[owner] - words
    short = np.flatnonzero((count > 0) & (count < words))
    for d in short:
        whole = np.uint64(0)
        for w in word[bounds[d] : bounds[d + 1]]:
            whole = mix(np.array([whole ^ w]))[0]
        shingle[bounds[d]], valid[bounds[d]] = whole, True
    shingle, owner = mix(shingle[valid]), owner[valid]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    first = np.ones(len(shingle), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[first], owner[first]
    return shingle, np.searchsorted(owner, np.arange(len(count) + 1))


def signatures(shingle: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One row of SLOTS bytes per text; texts without shingles get zeros."""
    out = np.zeros((len(places) - 1, SLOTS), np.uint8)
    full = np.flatnonzero(np.diff(places))
    if len(full):
        for k in range(SLOTS):
            least = np.minimum.reduceat(shingle * _SLOT[k], places[:-1][full])
            out[full, k] = mix(least).astype(np.uint8)
    return out


def chunk_keys(sig: np.ndarray, distance: int) -> np.ndarray:
    """A key for each slot: its chunk without that slot."""
    chunks = np.array_split(np.arange(SLOTS), distance // 2 + 1)
    term = mix((sig.astype(np.uint64) + np.uint64(1)) * _SLOT)
    keys = np.zeros(sig.shape, np.uint64)
    for c in chunks:
        whole = term[:, c].sum(axis=1, dtype=np.uint64)
        keys[:, c] = mix(whole[:, None] - term[:, c] + _SLOT[c])
    return keys.view(np.int64)


def _sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2, sig and the text's key t1, t2 of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            shingle, places = shingle_sets(batch.column("_text"))
            total = np.zeros((2, len(shingle) + 1), np.uint64)
            for row, salt in zip(total, (1, 2), strict=True):
                np.cumsum(mix(shingle * np.uint64(2) + np.uint64(salt)), out=row[1:])
            h = (total[:, places[1:]] - total[:, places[:-1]]).view(np.int64)
            sig = signatures(shingle, places)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("t1"),
                    batch.column("t2"),
                    pa.array(np.diff(places).astype(np.int64)),
                    pa.array(h[0]),
                    pa.array(h[1]),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()),
                ],
                ["doc_id", "t1", "t2", "n", "h1", "h2", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), *text_key(), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(sketch, "doc_id long, t1 long, t2 long, n long, h1 long, h2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = flat(column)
    return data.reshape(-1, SLOTS)


def hamming_forest(sig: np.ndarray, distance: int) -> np.ndarray:
    """For each row the first row of its component, where rows within `distance` are linked."""
    root = np.full(len(sig), -1)
    waiting = np.arange(len(sig))
    while len(waiting):
        first, waiting = waiting[0], waiting[1:]
        root[first] = first
        frontier = [first]
        while frontier and len(waiting):
            at = frontier.pop()
            near = (sig[waiting] != sig[at]).sum(axis=1) <= distance
            root[waiting[near]] = first
            frontier.extend(waiting[near])
            waiting = waiting[~near]
    return root


def link_forest(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component, where sets of that similarity are linked."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(code, kind="stable")
    posting, post = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    root = np.full(len(sets), -1)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        frontier = [first]
        while frontier:
            at = frontier.pop()
            mine = code[places[at] : places[at + 1]]
            low, high = post[mine], post[mine + 1]
            several = high - low > 1
            low, size = low[several], (high - low)[several]
            take = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else low
            both = np.bincount(posting[take], minlength=len(sets)) if len(take) else np.zeros(len(sets), np.int64)
            near = np.flatnonzero((100 * both >= percent * (sizes + sizes[at] - both)) & (root < 0))
            root[near] = first
            frontier.extend(near)
    return root


def _families(classes: DataFrame, distance: int, bucket_block: int) -> DataFrame:
    """(node, label) of classes with a neighbour within the radius."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                keys = chunk_keys(_matrix(part.column("sig")), distance)
                node = np.repeat(part.column("node").to_numpy(), SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    keys = classes.select("node", "sig").mapInArrow(keyed, "key long, node long")
    mark = F.xxhash64("node").cast("decimal(20,0)")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(mark).alias("mark")).filter("size > 1")
    # Buckets of the same members, in number and sum of hashes, are one.
    kept = stored(buckets.groupBy("size", "mark").agg(F.min("key").alias("key")).select("key", "size"), "buckets")
    members = keys.join(kept, "key").join(classes.select("node", "sig"), "node")
    blocks = F.ceil(F.col("size") / bucket_block).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("size")) % blocks
    dealt = cells(members.select("key", "node", "sig", block.cast("int").alias("_b"), blocks.alias("_n")), "key", F.col("_b"), F.col("_n"))

    def near(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return column(group, "node").to_numpy(), hamming_forest(_matrix(column(group, "sig")), distance)

    return components(dealt.select("key", "_i", "_j", "node", "sig").mapInArrow(forest_edges(near, 3), "a long, b long"))


def _links(docs: DataFrame, classes: DataFrame, family: DataFrame, percent: int, family_block: int) -> DataFrame:
    """(node, label) of classes with a confirmed link."""
    sized = classes.join(family, "node").select("node", "doc_id", "n", "label")
    total = sized.groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
    blocks = F.least(F.ceil(F.col("total") / family_block), F.col("members")).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("members")) % F.col("_n")
    placed = (
        sized.join(total, "label")
        .withColumn("_n", blocks)
        .select(F.col("doc_id").alias("_id"), "node", "n", "label", block.cast("int").alias("_b"), "_n")
    )
    placed = stored(placed, "families")
    few = placed.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))
    wanted = texts.join(F.broadcast(placed) if few else placed, "_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            shingle, places = shingle_sets(batch.column("_text"))
            raw = [shingle[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(raw, pa.binary())], ["label", "node", "n", "_b", "_n", "shingles"])

    rows = wanted.select("_text", "label", "node", "n", "_b", "_n").mapInArrow(
        sets, "label long, node long, n long, _b int, _n int, shingles binary"
    )
    # A doc_id may stand for several texts; the class's own has its number of shingles.
    rows = rows.filter(F.octet_length("shingles") == F.col("n") * 8)
    dealt = cells(rows, "label", F.col("_b"), F.col("_n")).select("label", "_i", "_j", "node", "shingles")

    def linked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw = column(group, "shingles")
        data, places = flat(raw)
        every = data.copy().view(np.uint64)
        cut = places // 8
        return column(group, "node").to_numpy(), link_forest([every[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], percent)

    return components(dealt.mapInArrow(forest_edges(linked, 3), "a long, b long"))


def _grouped(docs: DataFrame, percent: int, bucket_block: int, family_block: int) -> DataFrame:
    """Per row of `docs`: doc_id, t1, t2, n, label (null where nothing can be linked), component_id."""
    sketches = stored(_sets_of(docs), "sketches")
    linkable = "n > 0 AND doc_id IS NOT NULL"
    # A class is known by 128 bits and its size; h1 names it from here on.
    classes = stored(
        sketches.filter(linkable)
        .groupBy("h1", "h2", "n")
        .agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"))
        .withColumnRenamed("h1", "node"),
        "classes",
    )
    family = _families(classes, radius(percent), bucket_block)
    links = _links(docs, classes, family, percent, family_block)
    labelled = stored(classes.join(links, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")), "labelled")
    first = stored(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "first")
    named = stored(labelled.join(first, "label").select(F.col("node").alias("h1"), "label", "component_id"), "named")
    columns = ["doc_id", "t1", "t2", "n", "label", "component_id"]
    alone = sketches.filter(f"NOT ({linkable})").withColumns({"label": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return sketches.filter(linkable).join(named, "h1").select(columns).union(alone.select(columns))


def near_groups(
    docs: DataFrame,
    percent: int = PERCENT,
    bucket_block: int = BUCKET_BLOCK,
    family_block: int = FAMILY_BLOCK,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept."""
    rows = _grouped(docs, percent, bucket_block, family_block)
    kept = F.col("component_id").eqNullSafe(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component: the one with the smallest doc_id; where
    several rows have that doc_id, the one whose text has the smallest hash, and of rows
    of the same doc_id and text the smallest by its columns. Rows that can't be linked
    (no words, null doc_id) all stay. A doc_id of several texts is decided text by text."""
    rows = stored(_grouped(docs, percent, BUCKET_BLOCK, FAMILY_BLOCK), "grouped")
    text = F.struct("t1", "t2")
    named = rows.filter("label IS NOT NULL AND doc_id = component_id")
    winner = named.groupBy("label").agg(F.min(text).alias("winner"), F.count(F.lit(1)).alias("rows"))
    contested = stored(winner.filter("rows > 1"), "contested")
    beaten = rows.filter("doc_id = component_id").join(contested, "label").withColumn("same", text == F.col("winner"))
    key = ["doc_id", "t1", "t2"]
    gone = rows.filter("doc_id <> component_id").select(key).union(beaten.filter("NOT same").select(key)).distinct()
    repeated = beaten.filter("same").groupBy(key).count().filter("count > 1").select(key)
    return keep_rows(docs, gone, repeated)

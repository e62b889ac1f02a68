"""Benchmark passages in documents, found by a generalised suffix automaton of the items.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z
in lower case. A window is `window` consecutive words of an item, or all words of
a shorter item. The automaton holds every run of words of any item; a document's
words stream through it, which gives at every word the longest run ending there
that some item has. Where that reaches a window, its words are hit, and the state
names the items that have it.

A word, or a pair of neighbours, that no item has sends the automaton back to its
start. Those places are found with numpy beforehand, and only stretches between
them that are as long as the shortest window are streamed.

The items are read block by block, at most BLOCK_WORDS words (or one item) each:
the automaton of a block is what is broadcast, so its size does not depend on the
number of items. With several blocks, documents pass them one after another,
written to the shared folder in between. Documents are never shuffled.

Defined cases: empty documents, no rows; no items, nothing is hit; null text, no
words; items with null text, null id or no words are skipped; items that share an
id count as one; repeated documents, each its own row. Further columns are kept. Ids of
items that are whole numbers are taken as long, any others as text; a document's ids are
only carried along, whatever their type.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditledger.llm.common import Ranges, alnum_words, flat, slices, stored

WINDOW = 13
#: Documents with at least one in so many words hit are contaminated.
COVERAGE = 20
BLOCK_WORDS = 200_000
SPANS = "struct<n_words:bigint,longest:bigint,starts:array<bigint>,ends:array<bigint>,items:array<{ids}>>"


def words_of(text: str) -> list[bytes]:
    data, start, end = alnum_words(np.frombuffer(text.encode() + b" ", np.uint8))
    return [data[s:e].tobytes() for s, e in zip(start, end, strict=True)]


class Automaton:
    """The runs of words of a block of items; `windows` by state, as (length, ids)."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        pairs = set()
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
            pairs.update(zip(codes, codes[1:], strict=False))
            self.shortest = min(self.shortest, len(codes))
        found: dict[int, dict[int, set[int]]] = {}
        for item, codes in coded:
            size, state, length = min(window, len(codes)), 0, 0
            for i, code in enumerate(codes):
                state, length = self.step(state, length, code)
                if i + 1 >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    length = size
                    found.setdefault(state, {}).setdefault(size, set()).add(item)
        own = {s: [(n, sorted(i)) for n, i in by.items()] for s, by in found.items()}
        # A state's windows and those of all its suffixes, shorter ones after it.
        self.windows: dict[int, list[tuple[int, list[int]]]] = {}
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if every := own.get(state, []) + self.windows.get(self.link[state], []):
                self.windows[state] = every
        words = np.frombuffer(b" ".join(self.ids) + b" ", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in self.ids], dtype=np.int64) - 1
        hashes = Ranges(words)(np.concatenate([[0], ends[:-1] + 1]), ends) if len(ends) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.pairs = np.array(sorted(a * len(self.ids) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            to = self.next[last][code]
            if self.length[to] == self.length[last] + 1:
                return to
            return self._split(last, code, to)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = new
            last = self.link[last]
        if last >= 0:
            to = self.next[last][code]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self._split(last, code, to)
        return new

    def _split(self, last: int, code: int, to: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[to]))
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[to])
        self.link[to] = clone
        while last >= 0 and self.next[last].get(code) == to:
            self.next[last][code] = clone
            last = self.link[last]
        return clone

    def step(self, state: int, length: int, code: int) -> tuple[int, int]:
        """The longest suffix of what was matched, with the next word, that an item has."""
        while code not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][code], length + 1

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words go on, each a word of some item, each pair a pair of some
        item, for `shortest` words at least. `first`: a text's first word."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        code = np.where(known, self.order[at], -1)
        pair = code[:-1] * len(self.ids) + code[1:]
        joined = known[:-1] & known[1:] & ~first[1:]
        near = np.flatnonzero(joined)
        if len(self.pairs):
            at = np.searchsorted(self.pairs, pair[near]).clip(max=len(self.pairs) - 1)
            joined[near] = self.pairs[at] == pair[near]
        else:
            joined[:] = False
        edges = np.flatnonzero(~np.concatenate([[False], joined, [False]]))
        start, end = edges[:-1], edges[1:]
        long = (end - start >= self.shortest) & known[start]
        return start[long], end[long]

    def hits(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Longest match, hit spans and items of a stretch of words."""
        state = length = longest = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, word in enumerate(words):
            code = self.ids.get(word)
            if code is None:  # a word with the hash of another
                state = length = 0
                continue
            state, length = self.step(state, length, code)
            longest = max(longest, length)
            for size, ids in self.windows.get(state, ()):
                if size <= length:
                    spans.append((i + 1 - size, i + 1))
                    items.update(ids)
        return longest, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _id_kind(items: DataFrame) -> str:
    return "bigint" if isinstance(items.schema["item_id"].dataType, T.IntegralType) else "string"


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int | str, list[bytes]]]]:
    block, size = [], 0
    rows = items.select(F.col("item_id").cast(_id_kind(items)), "text").dropna()
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


def _marked(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """Adds what the automaton finds to `_found`."""
    of_items = rows.schema["_found"].dataType["items"].dataType.elementType
    ids = pa.list_(pa.string() if isinstance(of_items, T.StringType) else pa.int64())
    shared = rows.sparkSession.sparkContext.broadcast(automaton)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in slices(batches, "_bytes"):
            data, places = flat(batch.column("_bytes"), b" ")
            data, start, end = alnum_words(data)
            bounds = np.searchsorted(start, places)
            first = np.zeros(len(start) + 1, bool)
            first[bounds] = True
            before = batch.column("_found").to_pylist()
            found = []
            for old, n in zip(before, np.diff(bounds), strict=True):
                old = old or {"longest": 0, "starts": [], "ends": [], "items": []}
                spans = list(zip(old["starts"], old["ends"], strict=True))
                found.append({"n_words": int(n), "longest": old["longest"], "spans": spans, "items": set(old["items"])})
            lows, highs = automaton.stretches(Ranges(data)(start, end), first[:-1])
            for low, high, doc in zip(lows, highs, np.searchsorted(bounds, lows, "right") - 1, strict=True):
                words = [data[s:e].tobytes() for s, e in zip(start[low:high], end[low:high], strict=True)]
                longest, spans, items = automaton.hits(words)
                if spans:
                    into, shift = found[doc], int(low - bounds[doc])
                    into["longest"] = max(into["longest"], longest)
                    into["spans"] += [(a + shift, b + shift) for a, b in spans]
                    into["items"] |= items
            rows = []
            for x in found:
                spans = _merged(x.pop("spans"))
                rows.append(x | {"starts": [a for a, _ in spans], "ends": [b for _, b in spans], "items": sorted(x["items"])})
            numbers = pa.list_(pa.int64())
            kind = pa.struct(
                [("n_words", pa.int64()), ("longest", pa.int64()), ("starts", numbers), ("ends", numbers), ("items", ids)]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], batch.schema.names)

    return rows.mapInArrow(mark, rows.schema)


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    keep: Iterable[str] = ("doc_id",),
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`keep` of every row of `docs`, and n_words, n_hit, longest (match of a
    window or more), starts and ends (the hit words, merged), items (ids)."""
    kept = list(keep)
    nothing = F.lit(None).cast(SPANS.format(ids=_id_kind(items))).alias("_found")
    rows = docs.select(*(F.col(c) for c in kept), F.col("text").cast("binary").alias("_bytes"), nothing)
    for i, block in enumerate(_blocks(items, block_words)):
        rows = _marked(stored(rows, "hits") if i else rows, Automaton(block, window))
    hit = F.aggregate(F.zip_with("_found.ends", "_found.starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*kept, "_found.n_words", hit.alias("n_hit"), "_found.longest", "_found.starts", "_found.ends", "_found.items")


def is_contaminated(coverage: int = COVERAGE) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """`docs` without the rows whose hit words reach the coverage limit."""
    columns = docs.columns
    plain = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)), "text")
    found = benchmark_hits(plain, items, window, [f"_c{i}" for i in range(len(columns))])
    return found.filter(~is_contaminated(coverage)).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)))


def _without(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    if not text or not starts:
        return text
    data = text.encode()
    _, first, last = alnum_words(np.frombuffer(data + b" ", np.uint8))
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(data[at : first[s]])
        at = last[e - 1]
    return b"".join([*out, data[at:]]).decode()


def cut_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = WINDOW) -> DataFrame:
    """doc_id and text of every row of `docs`, without the hit spans of `least` words or more."""
    found = benchmark_hits(docs, items, window, ["doc_id", "text"])
    long = F.filter(F.arrays_zip("starts", "ends"), lambda x: x["ends"] - x["starts"] >= least)
    without = F.udf(_without, "string")
    return found.withColumn("_long", long).select("doc_id", without("text", "_long.starts", "_long.ends").alias("text"))

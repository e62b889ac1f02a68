"""Packing tokenised documents into training sequences by vector bin packing.

A sequence has three limits at once: ids, segments (pieces of documents) and ids
that bear loss. A document is its text's ids and one end id. Full sequences are
cut off its front; what is left waits in a pool of bounded size, and bins are
filled from the pool one at a time: of the pieces that fit, the one goes in whose
demand has the largest dot product with what the bin still has, each of the three
measured in parts of its limit. When no piece fits any more, one is cut to close
the gap. Documents never leave their partition, so nothing is shuffled; the pool
is emptied at the partition's end, and its last sequence is cut at powers of two,
which need no padding.

Ids are those of the tokenizer file given, as its library makes them with
add_special_tokens=False. Texts that hold one of the file's added tokens are given to the
library; the others to a faster encoder of the same ranks. The pattern only looks ahead at
runs of white space, so texts without such runs take the same pattern without the look
ahead; the ids are equal.

Defined cases: empty table, no pieces; null or empty text, the end id alone; null
loss_from, 0 (every id bears loss); null or repeated doc_id, a document of its own
for each row. Further columns are ignored. `sequence_id` holds the number of the
partition and of the sequence in it, so it is the same in every attempt of a task
as long as the partition's rows come in the same order, as from files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
POOL = 1024
#: Partitions count from here up in a sequence_id, sequences below.
SEQUENCE_BITS = 36
OUTPUT_BYTES = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, n_loss long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [(c, pa.binary() if c == "ids" else pa.int64()) for c in (x.split()[0] for x in SCHEMA.split(", "))]
)
_SPACES = re.compile(r"\s\s")
_encoders: dict[str, Callable[[str], list[int]]] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of the byte-level tokenizer file at `path`; one per process."""
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(letters[x] for x in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        classes = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
        fast, full = (
            tiktoken.Encoding(name, pat_str=classes + spaces, mergeable_ranks=ranks, special_tokens={})
            for name, spaces in (("fast", r"\s+"), ("full", r"\s+(?!\S)|\s+"))
        )
        slow = Tokenizer.from_file(path)
        added = re.compile("|".join(map(re.escape, special)) or r"(?!)")

        def encode(text: str) -> list[int]:
            if added.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            try:
                return (full if _SPACES.search(text) else fast).encode_ordinary(text)
            except BaseException as failure:
                # Very long runs can end the look ahead with a panic, which is no Exception.
                if type(failure).__name__ != "PanicException" and not isinstance(failure, ValueError):
                    raise
                return slow.encode(text, add_special_tokens=False).ids

        probe = "It's  2 naïve\n\n tests, x=[1];"
        if encode(probe) != slow.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level vocabulary whose ids are merge ranks")
        _encoders[path] = encode
    return _encoders[path]


class Packer:
    """Fills sequences from documents that arrive one after another."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_sequence: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.sequence = first_sequence
        self.pool: list[tuple] = []  # (doc_id, ids, loss_from, start)
        self.need = np.zeros((0, 3))  # ids, segments, ids with loss of each in the pool
        self.out: list[tuple] = []
        self.out_bytes = 0

    @staticmethod
    def _loss(item: tuple, length: int) -> int:
        _, _, loss_from, start = item
        return max(0, start + length - max(start, loss_from))

    def _piece(self, item: tuple, length: int, offset: int) -> None:
        doc, ids, _, start = item
        self.out.append(
            (doc, start, length, ids[start : start + length].tobytes(), self._loss(item, length), len(ids), self.sequence, offset)
        )
        self.out_bytes += 4 * length

    def add(self, doc, ids: np.ndarray, loss_from: int) -> None:
        size, start, most_loss = int(self.limits[0]), 0, int(self.limits[2])
        while len(ids) - start >= size and self._loss((doc, ids, loss_from, start), size) <= most_loss:
            self._piece((doc, ids, loss_from, start), size, 0)
            self.sequence += 1
            start += size
        if start < len(ids):
            self._put((doc, ids, loss_from, start))
        if len(self.pool) >= POOL:
            while len(self.pool) > POOL // 2:
                self._fill()

    def _put(self, item: tuple) -> None:
        rest = len(item[1]) - item[3]
        self.pool.append(item)
        self.need = np.vstack([self.need, [[rest, 1, self._loss(item, rest)]]])

    def _take(self, k: int) -> tuple:
        """The k-th of the pool; the last takes its place."""
        item, self.pool[k] = self.pool[k], self.pool[-1]
        self.need[k] = self.need[-1]
        self.pool.pop()
        self.need = self.need[:-1]
        return item

    def _chosen(self) -> list[tuple[tuple, int]]:
        """The pieces (item, length) of one sequence."""
        left, chosen = self.limits.copy(), []
        while self.pool and left[0] >= 1 and left[1] >= 1:
            fits = (self.need <= left).all(axis=1)
            if fits.any():
                worth = np.where(fits, self.need @ (left / self.limits**2), -1.0)
                item = self._take(int(worth.argmax()))
                length = len(item[1]) - item[3]
            else:
                item = self._take(int(self.need[:, 0].argmax()))
                free = max(0, item[2] - item[3])  # ids in front that bear no loss
                length = int(min(left[0], free + left[2], len(item[1]) - item[3]))
                if length < 1:
                    self._put(item)
                    break
                self._put((*item[:3], item[3] + length))
            left -= [length, 1, self._loss(item, length)]
            chosen.append((item, length))
        return chosen

    def _fill(self) -> None:
        offset = 0
        for item, length in self._chosen():
            self._piece(item, length, offset)
            offset += length
        self.sequence += 1

    def finish(self) -> None:
        while self.pool:
            chosen = self._chosen()
            total = sum(length for _, length in chosen)
            room, offset = (0 if self.pool else total), 0
            for item, length in chosen:
                while length:
                    if self.pool or total == self.limits[0]:
                        part = length
                    else:  # the last sequence: one for each binary digit of its length
                        size = 1 << (room.bit_length() - 1)
                        part = min(length, size - offset)
                    self._piece(item, part, offset)
                    item, length, offset = (*item[:3], item[3] + part), length - part, offset + part
                    if not self.pool and total != self.limits[0] and offset == size:
                        room, offset = room - size, 0
                        self.sequence += 1
            self.sequence += 1

    def rows(self, least_bytes: int) -> Iterator[pa.RecordBatch]:
        if self.out and self.out_bytes >= least_bytes:
            columns = zip(*self.out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            self.out, self.out_bytes = [], 0


def pack(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 1024,
    max_segments: int = 256,
    max_loss: int | None = None,
) -> DataFrame:
    """One row per piece of `docs` (doc_id, text and, if there, loss_from: how many
    ids in front bear no loss): doc_id, start, length, ids (little-endian unsigned
    32-bit), n_loss, doc_tokens, sequence_id, offset."""
    most_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, most_loss) < 1:
        raise ValueError("every limit must be 1 or more")
    loss_from = F.col("loss_from").cast("long") if "loss_from" in docs.columns else F.lit(0).cast("long")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(max_tokens, max_segments, most_loss, TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch in batches:
            for doc, text, free in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text) if text else []
                packer.add(doc, np.array([*ids, END_ID], "<u4"), free or 0)
                yield from packer.rows(OUTPUT_BYTES)
        packer.finish()
        yield from packer.rows(0)

    return docs.select(F.col("doc_id").cast("long"), F.col("text"), loss_from).mapInArrow(packed, SCHEMA)

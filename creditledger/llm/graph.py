"""Links between nodes (64-bit ids): groups cut into cells, edges of a task's groups,
connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditledger.llm.common import stored

#: Edges handed to Spark at a time.
EDGE_ROWS = 100_000


def column(table: pa.Table, name: str) -> pa.Array:
    values = table.column(name)
    return values.chunk(0) if values.num_chunks == 1 else pa.concat_arrays(values.chunks)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of equal leading `keys` columns, which come together."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i] == b.column(k)[j] for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(change), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            if held and not same(held[0], 0, batch, low):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def cells(rows: DataFrame, group: str, block: Column, blocks: Column) -> DataFrame:
    """Rows with `_i`, `_j`: the cells of pairs of blocks of the group that a row is in."""
    low = F.transform(F.sequence(F.lit(0), block), lambda i: F.struct(i.alias("_i"), block.alias("_j")))
    high = F.transform(F.sequence(block, blocks - 1), lambda j: F.struct(block.alias("_i"), j.alias("_j")))
    return (
        rows.withColumn("_cell", F.explode(F.array_distinct(F.concat(low, high))))
        .select(group, "_cell._i", "_cell._j", *(c for c in rows.columns if c != group))
        .repartition(group, "_i", "_j")
        .sortWithinPartitions(group, "_i", "_j")
    )


def forest_edges(task: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], keys: int) -> Callable:
    """Applies `task` (a group -> nodes, the place of each one's root) to sorted groups;
    emits (a, b): the nodes of a root as a chain, so that no node has many edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for group in groups(batches, keys):
            node, root = task(group)
            order = np.argsort(root, kind="stable")
            linked = root[order[1:]] == root[order[:-1]]
            if linked.any():
                a.append(node[order[:-1][linked]])
                b.append(node[order[1:][linked]])
                held += int(linked.sum())
            if held > EDGE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, held = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of an edge.

    In each round a node joins its neighbour of the lowest rank, or stays if its own is
    lower; ranks are hashes drawn anew, so that chains and stars alike shrink by a
    constant share. Edges go on between what is left. Then the rounds are followed
    from the last to the first. Every table is written out, so that a join's busy key
    is split at run time; the driver learns only whether edges are left."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while True:
        turn = F.lit(len(rounds))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.xxhash64("b", turn)
        low = both.groupBy("a").agg(F.min_by("b", rank).alias("m"), F.min(rank).alias("r"))
        to = F.when(F.xxhash64("a", turn) <= F.col("r"), F.col("a")).otherwise(F.col("m"))
        rounds.append(stored(low.select(F.col("a").alias("node"), to.alias("to")), "round"))
        hook = rounds[-1]
        met = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        met = stored(met.select("x", "b"), "half").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(
            met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
        if edges.isEmpty():
            break
    found = rounds.pop()
    while rounds:
        hook, later = rounds.pop(), found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = stored(hook.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "found")
    least = stored(found.groupBy("to").agg(F.min("node").alias("label")), "least")
    return found.join(least, "to").select("node", "label")

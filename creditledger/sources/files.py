"""File trees and small configuration files."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.functions.ignore import IgnoreRule, parse_ignore_rules
from creditledger.functions.lines import split_lines
from creditledger.functions.paths import RULES, PathRules, is_skipped_name
from creditledger.session import shared_folder
from creditledger.sources.schemas import AUTHOR_CONFIG

# File contents handed to Spark at a time.
BATCH_BYTES = 4 * 1024 * 1024
# Folders a task lists before it hands on the rest, tasks of one round, rows at a time.
LIST_BUDGET = 64
MOST_LIST_TASKS = 10_000
LISTED_ROWS = 10_000
# Files whose names Spark's readers pass over are read in pieces of so many bytes.
PIECE_BYTES = 32 * 1024 * 1024


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)


def _small_file(path: str) -> str | None:
    store, inner = pafs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type != pafs.FileType.File:
        return None
    with store.open_input_stream(inner) as stream:
        return stream.read().decode("utf-8", errors="replace")


def _listed(store: pafs.FileSystem, folder: str) -> tuple[list[pafs.FileInfo], list[pafs.FileInfo]]:
    """Files and directories of one folder. Links to directories are not entered, as
    they may lead back up."""
    local = isinstance(store, pafs.LocalFileSystem)
    found = store.get_file_info(pafs.FileSelector(folder))
    directories = [f for f in found if f.type == pafs.FileType.Directory and not (local and os.path.islink(f.path))]
    return [f for f in found if f.type == pafs.FileType.File], directories


def _level(prune: bool, budget: int, rules: PathRules):
    """Lists the folders of a frontier, rows (root, path); a task that has listed `budget`
    folders hands on those it has found but not entered, as rows with `open`."""

    def rows(root: str, paths: list[str], sizes: list[int | None]) -> pa.RecordBatch:
        n = len(paths)
        return pa.RecordBatch.from_arrays(
            [pa.array([root] * n, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array([s is None for s in sizes], pa.bool_())],
            ["root", "path", "size", "open"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = 0
        for batch in batches:
            for root, start in zip(batch["root"].to_pylist(), batch["path"].to_pylist(), strict=True):
                store, base = pafs.FileSystem.from_uri(root)
                base = base.rstrip("/")
                if start == "" and store.get_file_info(base or "/").type != pafs.FileType.Directory:
                    continue
                waiting = [start]
                while waiting and spent < budget:
                    at = waiting.pop()
                    files, directories = _listed(store, f"{base}/{at}".rstrip("/") or "/")
                    spent += 1
                    below = f"{at}/" if at else ""
                    waiting += [below + d.base_name for d in directories if not (prune and is_skipped_name(d.base_name, rules))]
                    for low in range(0, len(files), LISTED_ROWS):
                        some = files[low : low + LISTED_ROWS]
                        yield rows(root, [below + f.base_name for f in some], [f.size for f in some])
                if waiting:
                    yield rows(root, waiting, [None] * len(waiting))

    return run


def list_trees(
    spark: SparkSession, roots: Sequence[str], prune: bool = True, budget: int = LIST_BUDGET, rules: PathRules = RULES
) -> DataFrame:
    """root, path (relative to it), size of every file below the given folders.

    Spark's own readers skip names that start with '.' or '_', among them
    `__init__.py` and `.github/`; this walk does not. It goes by frontiers: the folders
    known so far are dealt out, each task lists up to `budget` of them (and what it
    finds in them), and the folders that are left are the next frontier. So one root is
    walked by as many tasks as it has folders for, and a deep but narrow tree takes few
    rounds. Every round is a table in the shared folder; the driver gets two
    numbers a round. Directories that no inventory takes are not entered when `prune`.
    """
    folder = shared_folder(spark)
    known = "root string, path string, size long, open boolean"
    frontier = spark.createDataFrame([(root, "") for root in roots], "root string, path string")
    waiting, depth = len(roots), 0
    while waiting:
        tasks = max(1, min(waiting, MOST_LIST_TASKS))
        # Dealt at random: neighbours in the tree tend to be alike in size.
        dealt = frontier.repartition(tasks, F.xxhash64("root", "path"))
        dealt.mapInArrow(_level(prune, budget, rules), known).write.parquet(f"{folder}/level={depth}")
        frontier = spark.read.schema(known).parquet(f"{folder}/level={depth}").filter("open").select("root", "path")
        waiting, depth = frontier.count(), depth + 1
    if not depth:
        return spark.createDataFrame([], "root string, path string, size long")
    return spark.read.schema(known).parquet(folder).filter("NOT open").select("root", "path", "size")


def with_content(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds `content` to rows with root and path, read by `partitions` tasks.
    Filter the listing first: only files still in it are opened."""

    loaded = pa.schema([("root", pa.string()), ("path", pa.string()), ("content", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for root, path in zip(batch["root"].to_pylist(), batch["path"].to_pylist()):
                store, base = pafs.FileSystem.from_uri(root)
                with store.open_input_stream(base.rstrip("/") + "/" + path) as stream:
                    data = stream.read()
                text = data.decode("utf-8", errors="replace")
                rows.append({"root": root, "path": path, "content": text})
                held += len(data)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, loaded)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, loaded)

    spread = partitions or 4 * listing.sparkSession.sparkContext.defaultParallelism
    return (
        listing.select("root", "path")
        .repartition(spread, "root", "path")
        .mapInArrow(read, "root string, path string, content string")
    )


def _passed_over(path: Column) -> Column:
    """Whether Spark's file readers take a file for hidden, by any part of its path."""
    part = r"(?:^|/)(?:\.|_(?![^/]*=))[^/]*"
    return path.rlike(part) | path.endswith("._COPYING_")


def _piece_records(separator: bytes, read_bytes: int = 1 << 20):
    """Records of the pieces (file, split, last) of files: those that begin after `split`
    and up to `last`, and the first record of a file. They may end beyond their piece."""

    def records(stream, size: int, first: int, last: int) -> Iterator[bytes]:
        width = len(separator)
        place = max(0, first - width + 1)
        stream.seek(place)
        buffer = stream.read(last - place)
        # `begin` is where a record begins in the buffer, None ahead of the first one.
        begin, looked = (0, 0) if first == 0 else (None, 0)
        while True:
            at = buffer.find(separator, looked)
            if at < 0:
                more = stream.read(read_bytes)
                if more:
                    looked = max(looked, len(buffer) - width + 1)
                    keep = looked if begin is None else min(begin, looked)
                    buffer, place, looked = buffer[keep:] + more, place + keep, looked - keep
                    begin = None if begin is None else begin - keep
                    continue
                if begin is not None and place + begin < size:
                    yield buffer[begin:]
                return
            if begin is not None:
                yield buffer[begin:at]
            begin = looked = at + width
            if place + begin > last or place + begin >= size:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file, size, first, last in zip(*(batch[c].to_pylist() for c in ("file", "size", "split", "last")), strict=True):
                store, inner = pafs.FileSystem.from_uri(file)
                with store.open_input_file(inner) as stream:
                    for n, record in enumerate(records(stream, size, first, last)):
                        rows.append((file, first, n, record.decode("utf-8", errors="replace")))
                        held += len(record)
                        if held >= BATCH_BYTES or len(rows) >= LISTED_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "split", "seq", "value"])
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "split", "seq", "value"])

    return run


def read_pieces(listing: DataFrame, separator: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """file, split, seq, value: the records of listed files (root, path, size), read in
    pieces of `piece_bytes`, each of which can be a task of its own."""
    file = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), "path")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(piece_bytes).cast("long"))
    pieces = listing.select(file.alias("file"), "size", F.explode(starts).alias("split")).select(
        "*", F.least(F.col("split") + piece_bytes, F.col("size")).alias("last")
    )
    spread = 4 * listing.sparkSession.sparkContext.defaultParallelism
    return pieces.repartition(spread, "file", "split").mapInArrow(
        _piece_records(separator.encode()), "file string, split long, seq long, value string"
    )


def read_records(spark: SparkSession, path: str, separator: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """file, split, seq, value: the records of all files below `path`, at any depth
    and of any name. (split, seq) is the order within a file.

    Files that Spark's reader takes are split by it; those whose names it takes for
    hidden (`__init__.py`, `.github/ci.yml`) are found by an own walk and read in pieces.
    """
    visible = spark.read.text(path, lineSep=separator, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    hidden = list_trees(spark, [path], prune=False).filter(_passed_over(F.col("path")))
    return visible.unionByName(read_pieces(hidden, separator, piece_bytes))


def explode_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, line_no (from 1), content: one row per line, split on newline only."""
    return files.select(
        *keys, F.posexplode(split_lines(F.col(content))).alias("_pos", "content")
    ).select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "content")


def read_author_config(spark: SparkSession, path: str | None, broken_is_empty: bool = False) -> DataFrame:
    """Alias table from a JSON file {"authors": [{canonical, emails, names}]}.

    A missing file is an empty table: every name stands for itself. One that cannot
    be parsed raises, unless `broken_is_empty` is set.
    """
    empty = spark.sql(
        "SELECT * FROM VALUES ('', '', '', 0) AS v(kind, alias_lower, canonical, ord) WHERE false"
    )
    if path is None:
        return empty
    if not path_exists(spark, path):
        return empty
    config = spark.read.schema(AUTHOR_CONFIG).json(path, multiLine=True, mode="FAILFAST")
    try:
        # Parsed here, where the fault can still be told; the file is one small row.
        readable = config.agg(F.count("authors") == F.count(F.lit(1)), F.count(F.lit(1)) > 0).first() == (True, True)
    except (PySparkException, Py4JJavaError) as fault:
        if not broken_is_empty:
            raise ValueError(f"{path} is no author configuration") from fault
        return empty
    if not readable:
        if not broken_is_empty:
            raise ValueError(f"{path} is no author configuration")
        return empty
    return alias_table(config.select(F.posexplode("authors").alias("ord", "mapping")).select("ord", "mapping.*"))


def alias_table(mappings: DataFrame) -> DataFrame:
    """kind, alias_lower, canonical, ord from mappings(ord, canonical, emails, names)."""
    def of(kind: str, column: str) -> DataFrame:
        return mappings.select(
            F.lit(kind).alias("kind"),
            F.explode(F.transform(column, F.lower)).alias("alias_lower"),
            "canonical",
            F.col("ord").cast("int").alias("ord"),
        )

    return of("email", "emails").unionByName(of("name", "names"))


def read_ignore_rules(path: str) -> list[IgnoreRule]:
    """The ordered rules of one ignore file; none if there is no such file."""
    text = _small_file(path)
    return [] if text is None else parse_ignore_rules(text)

"""Directory walk as a Spark data source, and the listing of sub-directories.

``spark.read.format("fswalk").option("roots", json)``: one row per regular file below the
roots, and one skipped row for each entry that isn't a regular file or can't be read.
Links are never followed below a root (the root itself may be one).  The driver lists
directories only until there are enough sub-trees to share out; each task walks its own.
The paths must be visible alike on every executor.

``walk`` needs no such guess: it goes on in rounds.  The tasks of a round list directories
of a table until each has met so many entries, hand back those that they haven't opened, and
the next round deals these out anew.  So a tree of which nearly everything lies below one
folder keeps all tasks busy.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.entries import as_walk
from ..schema import WALK


def signed(value: int) -> int:
    """An unsigned 64-bit number as the long with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def entry_row(root_id: int, root: str, path: str) -> tuple:
    """The row of one non-directory entry."""
    try:
        st = os.lstat(path)
    except OSError:
        return skipped_row(root_id, root, path)
    if not stat.S_ISREG(st.st_mode):
        return skipped_row(root_id, root, path)
    return (root_id, path, os.path.relpath(path, root), st.st_size, st.st_mtime_ns, signed(st.st_dev), signed(st.st_ino), False)


def skipped_row(root_id: int, root: str, path: str) -> tuple:
    return (root_id, path, os.path.relpath(path, root), None, None, None, None, True)


def list_directory(path: str) -> tuple[list[str], list[str]] | None:
    """(sub-directories, other entries) or None if it can't be read."""
    try:
        with os.scandir(path) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return None
    inner = [e.path for e in entries if e.is_dir(follow_symlinks=False)]
    return inner, [e.path for e in entries if not e.is_dir(follow_symlinks=False)]


class Subtree(InputPartition):
    def __init__(self, root_id: int, root: str, path: str, deep: bool):
        self.root_id, self.root, self.path, self.deep = root_id, root, path, deep


class WalkReader(DataSourceReader):
    def __init__(self, roots: list[tuple[int, str]], least: int):
        self.roots, self.least = roots, least

    def partitions(self) -> list[Subtree]:
        """Sub-trees, breadth first, until there are ``least``; a directory that was opened is read without its children."""
        done: list[Subtree] = []
        waiting = deque(Subtree(i, p, p, True) for i, p in self.roots)
        while waiting and len(done) + len(waiting) < self.least:
            tree = waiting.popleft()
            listed = list_directory(tree.path)
            if listed is None or not listed[0]:
                done.append(tree)
                continue
            done.append(Subtree(tree.root_id, tree.root, tree.path, False))
            waiting.extend(Subtree(tree.root_id, tree.root, p, True) for p in listed[0])
        return done + list(waiting)

    def read(self, partition: Subtree) -> Iterator[tuple]:
        stack = [partition.path]
        while stack:
            path = stack.pop()
            listed = list_directory(path)
            if listed is None:
                yield skipped_row(partition.root_id, partition.root, path)
                continue
            for entry in listed[1]:
                yield entry_row(partition.root_id, partition.root, entry)
            if partition.deep:
                stack += listed[0]


class FsWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fswalk"

    def schema(self):  # noqa: ANN201
        return WALK

    def reader(self, schema) -> WalkReader:  # noqa: ANN001
        roots = [(int(i), str(p)) for i, p in json.loads(self.options["roots"])]
        return WalkReader(roots, int(self.options.get("partitions", "64")))


def register(spark: SparkSession) -> None:
    """Lets the session read the format ``fswalk``."""
    spark.dataSource.register(FsWalk)


class RootMissing(Exception):
    """A root doesn't exist or isn't a directory: the scan fails before anything is compared."""


def check_root(path: str) -> None:
    if not os.path.isdir(path):  # follows a link at the root itself
        raise RootMissing(f"not a directory: {path}")


#: Entries that a task meets before it hands its directories back: in the first round, and at most; each round twice as many.
FIRST_ENTRIES, MOST_ENTRIES = 512, 200_000


ENTRIES = T.StructType([*(f for f in WALK if f.name != "skipped"), T.StructField("mode", T.LongType()), T.StructField("root", T.StringType()), T.StructField("deeper", T.BooleanType())])


def entry(root_id: int, root: str, path: str, listed: bool = True) -> tuple:
    """An entry as it is: stat columns and mode, or none if it can't be read."""
    try:
        st = os.lstat(path) if listed else None
    except OSError:
        st = None
    found = (st.st_size, st.st_mtime_ns, signed(st.st_dev), signed(st.st_ino), st.st_mode) if st else (None,) * 5
    return (root_id, path, os.path.relpath(path, root), *found, root, False)


def list_batches(batches: Iterator[pa.RecordBatch], entries: int, told: Callable[[str, int], None] | None) -> Iterator[pa.RecordBatch]:
    """Entries below the directories (root_id, root, path), and those not yet opened when ``entries`` have been met (``deeper``)."""
    waiting = [tuple(r.values()) for batch in batches for r in batch.select(["root_id", "root", "path"]).to_pylist()]
    kinds = [{"LongType()": pa.int64(), "StringType()": pa.string(), "BooleanType()": pa.bool_()}[str(f.dataType)] for f in ENTRIES]
    mode = ENTRIES.names.index("mode")
    made: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=ENTRIES.names)

    met = 0
    while waiting and met < entries:
        root_id, root, path = waiting.pop()
        listed = list_directory(path)
        if listed is None:
            made.append(entry(root_id, root, path, False))
            met += 1
            continue
        found = [entry(root_id, root, p) for p in listed[1]]
        made += found
        met += len(found) + 1
        waiting += [(root_id, root, p) for p in listed[0]]
        if told:
            told(path, sum(stat.S_ISREG(row[mode] or 0) for row in found))
        if len(made) >= 2000:
            yield flush()
            made = []
    made += [(root_id, path, None, *[None] * 5, root, True) for root_id, root, path in waiting]
    if made:
        yield flush()


def walk(spark: SparkSession, roots: list[tuple[int, str]], path: str, tasks: int = 64, told: Callable[[str, int], None] | None = None) -> DataFrame:
    """All entries below the roots (id, absolute path), from a table in a folder of its own, round by round.

    ``told`` hears of each directory and its number of files, in the task that listed it.
    """
    for _, at in roots:
        check_root(at)
    register(spark)
    waiting = spark.createDataFrame([(i, p, p) for i, p in roots], "root_id long, root string, path string")
    count, entries, number = len(roots), FIRST_ENTRIES, 0
    while count:
        dealt = waiting.repartition(min(tasks, count))
        dealt.mapInArrow(lambda b, entries=entries: list_batches(b, entries, told), ENTRIES).write.parquet(f"{path}/round={number}")
        waiting = spark.read.schema(ENTRIES).parquet(f"{path}/round={number}").where("deeper").select("root_id", "root", F.col("abs_path").alias("path"))
        count, entries, number = waiting.count(), min(2 * entries, MOST_ENTRIES), number + 1
    return as_walk(spark.read.schema(ENTRIES).parquet(*(f"{path}/round={k}" for k in range(number))).where("NOT deeper"))


def subdirectories(base: str) -> list[str]:
    """Immediate sub-directories of ``base``, links left out; none if it doesn't exist."""
    listed = list_directory(base)
    return listed[0] if listed else []

"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bits of the filters that are broadcast: 16 for each entry, but 2 MB at least and 32 MB at most.
FILTER_BITS, MOST_FILTER_BITS = 1 << 24, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset, a folder
    below /tmp takes its place, but only with a local master, whose driver and executors are
    one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/dupescope-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over: it does so, a little later, when the driver has dropped their handles."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables of one run in the shared folder, each dropped as soon as no step needs it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_dir(spark, name)
        self.number = 0
        self.at: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{self.number}-{name}"
        self.number += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, lazy frames included."""
        for table in tables:
            remove(self.spark, self.at.pop(id(table)))


    def drop_others(self, *kept: DataFrame) -> None:
        """Deletes all tables of this run but those."""
        for path in [p for i, p in self.at.items() if i not in set(map(id, kept))]:
            remove(self.spark, path)
        self.at = {i: p for i, p in self.at.items() if i in set(map(id, kept))}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Lets the session hand texts to Python in small batches, so that a task holds few of them.

    Every operator that runs Python calls this, so that none depends on what ran before.  The
    limits stay with the session, since frames run after the call that made them; stricter
    ones are left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives memory back to the system at its end: Spark keeps the worker for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Returns what this process has freed to the system, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc_fold(col: str | Column, folds: int) -> Column:
    """crc32(id as text) mod ``folds``: the fold rule that the queries fix."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % folds


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` folds ASCII letters only and ``bytes.split`` splits at exactly
    the six ASCII white-space bytes, so this is the rule in two C calls.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))
        if len(self) > self.LIMIT:
            self.clear()
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), wrapping."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive word hashes, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = mix(out * U64(0x9E3779B97F4A7C15) + hashes[k : k + n] + U64(k + 1))
    return out


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list]:
    """The named columns of each batch as Python lists."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of ``text``: batches are joined or cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, text, limit):
        more = batch.column(batch.schema.get_field_index(text)).nbytes
        if held and size + more > limit:
            piece, held, size = pa.concat_batches(held), [], 0
            yield piece
            del piece
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], dtype=np.int64)
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A bit set over the column ``h`` of a written table, two bits for each; its size follows the count within fixed bounds.

    At most MOST_FILTER_BITS / 64 rows reach the driver.  Beyond that size more keys pass that
    shouldn't: callers join behind the filter, so it saves work but decides nothing.
    """
    bits = min(max(FILTER_BITS, 1 << (16 * hashes.count()).bit_length()), MOST_FILTER_BITS)
    low, high = F.col("h").bitwiseAND(bits - 1), F.shiftright("h", 32).bitwiseAND(bits - 1)
    at = hashes.select(F.explode(F.array(low, high)).alias("at"))
    words = at.selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(U64)


def in_filter(bitset: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits set."""
    out = np.ones(len(x), bool)
    for shift in (0, 32):
        at = (x >> U64(shift)) & U64(64 * len(bitset) - 1)
        out &= (bitset[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0
    return out

"""Sampled and full hashes, of columns and of files.

A sampled hash covers the first, the middle and the last ``sample`` bytes, or everything
if there are no more than three samples.  It only narrows candidates; SHA-256 decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def partial_hash(data: Column, size: Column, sample: int) -> Column:
    """Sampled hash of a string or binary column of ``size`` bytes, over the hexadecimal digits of the samples."""
    raw = data.cast("binary")
    piece = lambda begin: F.hex(F.substring(raw, (begin + 1).cast("int"), F.lit(sample)))
    middle = F.floor(size / 2).cast("long") - sample // 2
    return F.when(size <= 3 * sample, F.md5(F.hex(raw))).otherwise(F.md5(F.concat(piece(F.lit(0)), piece(middle), piece(size - sample))))


def sampled_bytes(size: Column, sample: int) -> Column:
    return F.least(size, F.lit(3 * sample).cast("long"))


def hash_sample(path: str, size: int, sample: int) -> str:
    with open(path, "rb") as f:
        if size <= 3 * sample:
            return xxhash.xxh3_128_hexdigest(f.read())
        work = xxhash.xxh3_128()
        work.update(f.read(sample))
        f.seek(size // 2 - sample // 2)
        work.update(f.read(sample))
        f.seek(-sample, 2)
        work.update(f.read(sample))
        return work.hexdigest()


def hash_whole(path: str, size: int, chunk: int) -> str:
    work = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            work.update(data)
    return work.hexdigest()


@dataclass(frozen=True)
class HashStage:
    """One hashing step over files: which column it fills, how, and how many bytes it reads."""

    column: str
    read: Callable[[str, int], str]
    cost: Callable[[Column], Column]


def sample_stage(sample: int) -> HashStage:
    return HashStage("partial_hash", lambda path, size: hash_sample(path, size, sample), lambda size: sampled_bytes(size, sample))


def whole_stage(chunk: int) -> HashStage:
    return HashStage("full_hash", lambda path, size: hash_whole(path, size, chunk), lambda size: size)


#: Runs of ids whose bytes are summed first when files are dealt out.
RUNS = 256


def deal_by_bytes(files: DataFrame, tasks: int, weight: Column | None = None) -> DataFrame:
    """``files`` (id, size) with ``task``: files in order of id % RUNS and id, cut into ``tasks`` of equal bytes.

    A file goes where its first byte falls, so no task reads more than the mean and one file.
    Bytes before a file are those of the runs before its own, whose sums (RUNS numbers) the
    driver adds up, and those before it in its run.
    """
    weight = F.col("size") if weight is None else weight
    run = F.pmod(F.col("id"), F.lit(RUNS)).cast("int")
    sums = {r.run: int(r.total) for r in files.groupBy(run.alias("run")).agg(F.sum(weight.cast("decimal(38,0)")).alias("total")).collect()}
    before, total = [], 0
    for k in range(RUNS):
        before.append(total)
        total += sums.get(k, 0)
    if not total:
        return files.withColumn("task", F.pmod(F.col("id"), F.lit(tasks)).cast("int"))
    offset = F.element_at(F.array(*(F.lit(str(x)).cast("decimal(38,0)") for x in before)), run + 1)
    inside = F.sum(weight.cast("decimal(20,0)")).over(Window.partitionBy(run).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = files.withColumn("_before", (offset + inside - weight).cast("decimal(32,0)"))
    return placed.withColumn("task", F.least(F.expr(f"CAST((_before * {tasks}) div CAST('{total}' AS DECIMAL(38,0)) AS INT)"), F.lit(tasks - 1))).drop("_before")


def hash_files(files: DataFrame, stage: HashStage, tasks: int, told: Callable[[str, int], None] | None = None) -> DataFrame:
    """id, hash, error of each file (id, abs_path, size); an unreadable one has a null hash.

    Files are dealt out by the bytes that the stage reads of them.  ``told`` hears of each file
    that was read, in the task that read it.
    """
    cost = stage.cost

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, errors = [], []
            for path, size, bytes_read in zip(batch.column("abs_path").to_pylist(), batch.column("size").to_pylist(), batch.column("cost").to_pylist(), strict=True):
                try:
                    hashes.append(stage.read(path, size))
                    errors.append(None)
                    if told:
                        told(path, bytes_read)
                except OSError as e:
                    hashes.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], names=["id", "size", "hash", "error"])

    dealt = deal_by_bytes(files.select("id", "abs_path", "size", cost(F.col("size")).cast("long").alias("cost")), tasks, F.col("cost"))
    return dealt.repartitionById(tasks, F.col("task")).select("id", "abs_path", "size", "cost").mapInArrow(work, "id long, size long, hash string, error string")

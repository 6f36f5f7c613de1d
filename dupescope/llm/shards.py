"""Operator 4: token ids in training order, as fixed-stride binary shards.

Documents become one long stream of token ids, cut into sequences of equal length.  Each
sequence has an ordinal; a keyed Feistel permutation with cycle-walking maps ordinals onto
0..N-1 one to one, which is the sequence's slot in the training order.  Shards are ranges
of slots: a record's place in its file follows from its slot alone, so a reader resumes at
any slot by one seek, and reading shards in order is reading the training order.

Passes: the first counts the sequences of each block of documents.  A running sum over that
table gives each block its first ordinal: within each of 4096 ranges of block names by a
window, across them on the driver.  The second pass cuts the blocks again; a join with the
table, which Spark broadcasts only while it is small, turns a sequence's place in its block
into its ordinal and slot.  Each task of the write takes one range of slots, named by
partition id, sorts it and writes its shards.  Every block ends in a padded sequence at most.

A record is a header (magic, number of tokens, slot, ordinal, doc_id at its start), the
ids, a CRC-32 and a line end, always of the same size: ids take 1, 2 or 4 bytes by the
size of the vocabulary.  Spark's text writer writes the records, whatever store it is.

``encode`` gives a batch of texts their ids: ``byte_tokens`` (UTF-8 bytes, with 0xFF, which
UTF-8 never uses, behind each document) or ``BpeTokens`` (ids of the BPE operator).  The
query takes bytes; the README says why.

Defined results: a null or empty text is its end token alone.  Repeated rows are separate
documents.  A null doc_id is written as the least long.  An empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

MAGIC = b"TSEQ"
HEADER = struct.Struct("<4sIqqq")
END_OF_DOCUMENT = 0xFF
NULL_ID = -(1 << 63)
#: Token bytes of a block.
BLOCK_BYTES = 8 << 20
#: Bits of a block's name that say its range: at most 4096 sums reach the driver.
RANGE_BITS = 12
U64 = np.uint64


# ------------------------------------------------------------------ permutation


@dataclass(frozen=True)
class Permutation:
    """Keyed bijection of 0..n-1: a balanced Feistel network over the next even power of two, walked until inside."""

    n: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _round(self, i: int, x: np.ndarray) -> np.ndarray:
        salt = U64(xxhash.xxh3_64_intdigest(b"%d" % i, seed=self.key & ((1 << 64) - 1)))
        return common.mix(x * U64(0x9E3779B97F4A7C15) + salt) & U64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, order: range) -> np.ndarray:
        h, low = U64(self.half), U64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for i in order:
            left, right = right, left ^ self._round(i, right)
        return left << h | right

    def _walk(self, x: np.ndarray, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        out = step(x)
        while len(far := np.flatnonzero(out >= U64(self.n))):
            out[far] = step(out[far])
        return out

    def slots(self, ordinals: np.ndarray) -> np.ndarray:
        """The slot of each ordinal."""
        return self._walk(ordinals.astype(U64), lambda x: self._once(x, range(self.rounds))).astype(np.int64)

    def ordinals(self, slots: np.ndarray) -> np.ndarray:
        """The inverse of ``slots``."""
        h, low = U64(self.half), U64((1 << self.half) - 1)

        def back(x: np.ndarray) -> np.ndarray:  # the same network with the halves exchanged and the rounds reversed
            y = self._once((x & low) << h | x >> h, range(self.rounds - 1, -1, -1))
            return (y & low) << h | y >> h

        return self._walk(slots.astype(U64), back).astype(np.int64)


# ------------------------------------------------------------------ records


@dataclass(frozen=True)
class Layout:
    """Tokens of a sequence, bytes of a token id, sequences of a shard."""

    length: int = 2048
    width: int = 1
    per_shard: int = 4096

    @property
    def stride(self) -> int:
        return HEADER.size + self.length * self.width + 4 + 1

    def record(self, slot: int, ordinal: int, doc_id: int, tokens: bytes) -> bytes:
        """Without the line end, which the writer adds."""
        body = HEADER.pack(MAGIC, len(tokens) // self.width, slot, ordinal, doc_id) + tokens.ljust(self.length * self.width, b"\0")
        return body + struct.pack("<I", zlib.crc32(body))

    def parse(self, record: bytes) -> tuple[int, int, int, bytes]:
        """(slot, ordinal, doc_id, ids) or ValueError."""
        magic, n, slot, ordinal, doc_id = HEADER.unpack_from(record)
        if len(record) != self.stride or magic != MAGIC or record[-1:] != b"\n" or struct.unpack("<I", record[-5:-1])[0] != zlib.crc32(record[:-5]):
            raise ValueError("not a whole record")
        return slot, ordinal, doc_id, record[HEADER.size : HEADER.size + n * self.width]


Encoder = Callable[[list[str | None]], list[bytes]]


def byte_tokens(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") + bytes([END_OF_DOCUMENT]) for t in texts]


@dataclass
class BpeTokens:
    """Ids of the BPE operator, little-endian in 2 or 4 bytes, with an end token behind each document."""

    path: str
    end: str = "<|endoftext|>"
    width: int = 2
    model: bpe.PairIndexBpe | None = None

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.model is None:
            self.model = bpe.PairIndexBpe.from_file(self.path)
        found = self.model.encode_many([t or "" for t in texts])
        return [np.array([*ids, self.model.specials[self.end]], f"<u{self.width}").tobytes() for ids in found]


def blocks(batches: Iterator[pa.RecordBatch], encode: Encoder) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(name, doc ids, encoded documents) of each block of a task; equal in every pass over the same table."""
    ids: list[int] = []
    held: list[bytes] = []
    size = number = 0
    task = TaskContext.get().partitionId()

    def flush() -> tuple[int, list[int], list[bytes]]:
        name = xxhash.xxh3_64_intdigest(np.array([task, number, *ids, *map(len, held)], np.int64).tobytes() + b"".join(x[:16] for x in held[:64]))
        return int(U64(name).view(np.int64)), ids, held

    for batch in common.slices(batches, "text", 4 << 20):
        for names, texts in common.rows([batch], "doc_id", "text"):
            for doc_id, data in zip(names, encode(texts), strict=True):
                if held and size + len(data) > BLOCK_BYTES:
                    yield flush()
                    ids, held, size, number = [], [], 0, number + 1
                ids.append(NULL_ID if doc_id is None else doc_id)
                held.append(data)
                size += len(data)
    if held:
        yield flush()


def first_ordinals(counts: DataFrame) -> tuple[DataFrame, int]:
    """(name, first) from the written table (name, n): how many sequences stand before each block, and how many there are."""
    part = F.shiftrightunsigned("name", 64 - RANGE_BITS).cast("int")
    sums = sorted((r.part, r.n) for r in counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect())  # at most 2^RANGE_BITS rows
    ends = np.cumsum([n for _, n in sums], dtype=np.int64).tolist()
    starts = counts.sparkSession.createDataFrame([(p, e - n) for (p, n), e in zip(sums, ends, strict=True)], "part int, start long")
    before = F.sum("n").over(Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    out = counts.withColumn("part", part).join(F.broadcast(starts), "part").select("name", (F.col("start") + before).alias("first"))
    return out, ends[-1] if ends else 0


def write(docs: DataFrame, path: str, key: int, layout: Layout = Layout(), encode: Encoder = byte_tokens) -> int:
    """Shards of ``docs`` (doc_id, text; a table that reads alike each time) below ``path``; the number of sequences."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = docs.select("doc_id", "text")
    span = layout.length * layout.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, held in blocks(batches, encode):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-(-sum(map(len, held)) // span)])], names=["name", "n"])

    tables = common.Workspace(spark, "shard-blocks")
    counts = tables.write(docs.mapInArrow(common.tidy(count), "name long, n long"), "counts")
    firsts, total = first_ordinals(counts)
    firsts = tables.write(firsts, "firsts")
    order = Permutation(total, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, held in blocks(batches, encode):
            stream = b"".join(held)
            ends = np.cumsum([len(x) for x in held])
            starts = np.array(ids, np.int64)[np.searchsorted(ends, np.arange(0, len(stream), span), side="right")]
            del held
            for i in range(0, len(starts), 512):
                n = min(512, len(starts) - i)
                tokens = [stream[j * span : (j + 1) * span] for j in range(i, i + n)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(i, i + n)), pa.array(starts[i : i + n]), pa.array(tokens, pa.binary())], names=["name", "place", "doc_id", "tokens"])

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("first").null_count:
                raise RuntimeError("the documents changed between two passes; write them to a table first")
            ordinals = batch.column("first").to_numpy() + batch.column("place").to_numpy()
            slots = order.slots(ordinals)
            made = [layout.record(*row) for row in zip(slots.tolist(), ordinals.tolist(), batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots // layout.per_shard), pa.array(slots), pa.array(made, pa.binary())], names=["shard", "slot", "record"])

    cutting = docs.mapInArrow(common.tidy(cut), "name long, place long, doc_id long, tokens binary")
    sealed = cutting.join(firsts, "name", "left").select("first", "place", "doc_id", "tokens").mapInArrow(common.tidy(seal), "shard long, slot long, record binary")
    shards = max(1, -(-total // layout.per_shard))
    # slots are uniform by construction: each task takes a range of shards, and no sampling is needed
    tasks = min(shards, common.partitions(spark))
    dealt = sealed.repartitionById(tasks, F.expr(f"CAST(shard * {tasks} DIV {shards} AS INT)")).sortWithinPartitions("shard", "slot")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    tables.drop(counts, firsts)
    return total


def read(spark: SparkSession, path: str, layout: Layout = Layout(), from_slot: int = 0, to_slot: int | None = None) -> DataFrame:
    """slot, ordinal, doc_id, ids of the records from ``from_slot`` up to before ``to_slot``; only their shards are opened."""
    common.bound_batches(spark)
    to = (1 << 62) if to_slot is None else to_slot
    files = spark.read.format("binaryFile").load(path).where(f"shard >= {from_slot // layout.per_shard} and shard <= {(to - 1) // layout.per_shard}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                base = shard * layout.per_shard
                begin, end = max(0, from_slot - base), min(len(data) // layout.stride, to - base)
                for i in range(begin, end, 512):
                    found = [layout.parse(bytes(data[j * layout.stride : (j + 1) * layout.stride])) for j in range(i, min(i + 512, end))]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["slot", "ordinal", "doc_id", "ids"])

    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(common.tidy(parse), "slot long, ordinal long, doc_id long, ids binary")


def op4_training_order(spark: SparkSession, sf_dir: str, key: int = 20240229) -> DataFrame:
    """The shards of ``documents``, read back: one row per sequence."""
    path = common.shared_dir(spark, "shards")
    total = write(common.table(spark, sf_dir, "documents"), path, key)
    kind = "slot long, ordinal long, doc_id long, n_tokens long, ids_sha256 string"
    if not total:
        return spark.createDataFrame([], kind)
    return read(spark, path).select("slot", "ordinal", "doc_id", F.octet_length("ids").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))

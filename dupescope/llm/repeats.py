"""Operator 13: repeated substrings, by prefix doubling over sampled positions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere else, in the same
text or another.  Plain prefix doubling sorts a (rank, rank at an offset) pair for every byte of
the corpus in every round.  Here positions are sampled by content first, so that a round sorts
few of them, and no string that repeats is lost:

1. Anchors.  Of the first ``REACH`` positions of a window of ``LENGTH`` bytes, the one whose next
   ``GRAM`` bytes hash least is its anchor.  It depends on the window alone, so equal windows have
   equal anchors at equal distance.  Windows that follow each other and share an anchor are a node.
2. Ranks.  All windows of a node share the bytes from the anchor on; these get a name (a
   fingerprint, equal for equal bytes), and Spark counts the names of the corpus.  A node whose
   name is unique holds no repeated window and is left.  So is, later, one whose longer name is.
3. Whole nodes.  The bytes that the windows of a node span get a name, too.  Where it occurs twice,
   all windows of the node repeat.  One such node of each name stays on as a witness, since parts
   of it may repeat elsewhere; the others are done.
4. Rounds.  What is left is cut by the distance to the anchor into nodes of ``WIDTHS`` windows, whose
   common bytes are longer: 73, then 185, then all 200.  Each round extends the names to that
   length, sorts, and leaves what is unique, until the length is reached.

Names that decide have 128 bits.  Every count is an aggregation that Spark combines before the
shuffle, so a passage of any number of copies is a few rows a task; no group is collected but the
nodes of one text.

Defined results: texts are UTF-8; a null text is empty; texts below LENGTH bytes lose nothing.  Rows
that repeat a doc_id, or have none, are texts of their own, so a repeated row of LENGTH bytes or
more loses all.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_splittable
from . import common

U64 = np.uint64
LENGTH, REACH, GRAM = 200, 128, 16
#: Windows of a node, round by round: the first as many as an anchor can have.
WIDTHS = (REACH, 16, 1)
#: Bytes of a text that are looked at together, and of texts joined for it.
STRETCH, JOINED = 1 << 19, 1 << 20
#: Odd bases of the two fingerprints, and what tells their byte tables apart.
BASES, SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x1656, 0x27D4)
TABLES = tuple(common.mix(common.mix(np.arange(256, dtype=U64) + U64(s))) for s in SEEDS)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse, remembered."""
    if k not in _powers or len(_powers[k][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        rows = []
        for base in (BASES[k], pow(BASES[k], -1, 1 << 64)):
            x = np.full(size, base, U64)
            x[0] = 1
            rows.append(np.cumprod(x, dtype=U64))
        _powers[k] = rows[0], rows[1]
    up, down = _powers[k]
    return up[:n], down[:n]


class Names:
    """Fingerprints of any substring of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, k: int):
        up, self.down = powers(k, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(TABLES[k][data] * up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        value = (self.sums[begin + length] - self.sums[begin]) * self.down[begin]
        return common.mix(value + np.asarray(length, U64))

    def grams(self) -> np.ndarray:
        """Hash of the GRAM bytes from each position on."""
        return common.mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: len(self.sums) - GRAM])


@dataclass
class Joined:
    """Stretches of texts, one behind the other: the row of each, where it lies in its text, and where in ``data``."""

    data: np.ndarray
    row: np.ndarray
    offset: np.ndarray
    base: np.ndarray
    #: windows that start in the stretch
    starts: np.ndarray


def stretches(texts: list[bytes | None]) -> Iterator[Joined]:
    """All texts of LENGTH bytes or more, in stretches that overlap by what a node can span."""
    parts: list[bytes] = []
    rows: list[tuple[int, int, int]] = []
    size = 0

    def made() -> Joined:
        lengths = np.array([len(p) for p in parts])
        row, offset, starts = (np.array(x) for x in zip(*rows, strict=True))
        return Joined(np.frombuffer(b"".join(parts), np.uint8), row, offset, np.cumsum(lengths) - lengths, starts)

    for row, text in enumerate(texts):
        if text is None or len(text) < LENGTH:
            continue
        for offset in range(0, len(text) - LENGTH + 1, STRETCH):
            part = text[offset : offset + STRETCH + REACH + LENGTH]
            if parts and size + len(part) > JOINED:
                yield made()
                parts, rows, size = [], [], 0
            parts.append(part)
            rows.append((row, offset, min(STRETCH, len(text) - LENGTH + 1 - offset)))
            size += len(part)
    if parts:
        yield made()


def spread(begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begins[k], begins[k] + 1, ... counts[k] of them, for each k; and k for each."""
    k = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(k)) + np.repeat(begins - (np.cumsum(counts) - counts), counts), k


def anchors(names: Names) -> np.ndarray:
    """For each position, the first of the least hashes among the REACH positions from it on."""
    least = names.grams()
    mask = U64((1 << (len(least) + 1).bit_length()) - 1)
    least = (least & ~mask) | np.arange(len(least), dtype=U64)
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return (least & mask).astype(np.int64)


def cut(node: np.ndarray, start: np.ndarray, away: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows (their node, start and distance to the anchor, in order) as nodes of up to ``width``: place of the first window, start, distance there, windows."""
    group = away // width
    at = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (group[1:] != group[:-1])]))
    return at, start[at], away[at], np.diff(np.append(at, len(node)))


def first_nodes(piece: Joined, names: Names) -> tuple[np.ndarray, ...]:
    """Stretch, start, distance to the anchor and windows of each node of the first round."""
    start, part = spread(piece.base, piece.starts)
    anchor = anchors(names)[start]
    # a stretch and an anchor are a node; anchors never go back
    at, start, away, n = cut(part * (len(piece.data) + 1) + anchor, start, anchor - start, REACH)
    return part[at], start, away, n


def common_bytes(start: np.ndarray, away: np.ndarray, width: int) -> np.ndarray:
    """Where the bytes begin that all windows of a node's distances share; there are LENGTH + 1 - width."""
    return start + away - away // width * width


# ---------------------------------------------------------------- passes over the texts


NODES = "k1 long, k2 long, s long, d int, n int, spare boolean, i long, u1 long, u2 long"


def node_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in NODES.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def bytes_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def first_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): names of the bytes from each anchor on, counted within a few texts."""
    for batch in common.gathered(batches, "text", 4 << 20):
        found = []
        for piece in stretches(bytes_of(batch)):
            names = Names(piece.data, 0)
            _, start, away, _ = first_nodes(piece, names)
            found.append(names.of(common_bytes(start, away, REACH), LENGTH + 1 - REACH))
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def first_batches(batches: Iterator[pa.RecordBatch], twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of the first round whose name is in the filter ``twice``."""
    for batch in common.gathered(batches, "text", 1 << 20):
        keys = numbers(batch, "k1"), numbers(batch, "k2")
        for piece in stretches(bytes_of(batch)):
            names, more = Names(piece.data, 0), Names(piece.data, 1)
            part, start, away, n = first_nodes(piece, names)
            i = names.of(common_bytes(start, away, REACH), LENGTH + 1 - REACH)
            keep = common.in_filter(twice, i)
            part, start, away, n, i = (x[keep] for x in (part, start, away, n, i))
            row, s = piece.row[part], start - piece.base[part] + piece.offset[part]
            yield node_rows([keys[0][row], keys[1][row], s, away, n, np.zeros(len(s), bool), i, names.of(start, n + LENGTH - 1), more.of(start, n + LENGTH - 1)])


def next_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, text, nodes: a list of s, d, n, spare): nodes of ``width`` windows."""
    for batch in common.slices(batches, "text", 1 << 20):
        keys = numbers(batch, "k1"), numbers(batch, "k2")
        lists = batch.column(batch.schema.get_field_index("nodes"))
        s, d, n, spare = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((s, owner))
        owner, s, d, n, spare = (x[order] for x in (owner, s, d, n, spare))
        place = owner * (1 << 40) + s  # texts are shorter
        for piece in stretches(bytes_of(batch)):
            names, more = Names(piece.data, 0), Names(piece.data, 1)
            low = np.searchsorted(place, piece.row * (1 << 40) + piece.offset)
            high = np.searchsorted(place, piece.row * (1 << 40) + piece.offset + piece.starts)
            mine, part = spread(low, high - low)
            if not len(mine):
                continue
            begin, node = spread(s[mine] - piece.offset[part] + piece.base[part], n[mine].astype(np.int64))
            away = d[mine][node] - (begin - (s[mine] - piece.offset[part] + piece.base[part])[node])
            at, start, away, count = cut(node, begin, away.astype(np.int64), width)
            mine, part = mine[node[at]], part[node[at]]
            row = piece.row[part]
            i = names.of(common_bytes(start, away, width), LENGTH + 1 - width)
            yield node_rows([keys[0][row], keys[1][row], start - piece.base[part] + piece.offset[part], away, count, spare[mine], i, names.of(start, count + LENGTH - 1), more.of(start, count + LENGTH - 1)])


def filtered(batches: Iterator[pa.RecordBatch], bitset: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose ``h`` is in the filter, or those where it isn't."""
    for batch in batches:
        yield batch.filter(pa.array(common.in_filter(bitset, numbers(batch, "h").view(U64)) == inside))


CUTS = "doc_id long, n_bytes long, spans array<struct<first:long,behind:long>>, kept binary"


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, found: a list of s, length, or null): what goes, as maximal runs, and the bytes that stay."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
    for batch in common.slices(batches, "text", 4 << 20):
        spans, kept, sizes = [], [], []
        for text, found in zip(bytes_of(batch), batch.column(batch.schema.get_field_index("found")), strict=True):
            text = text or b""
            runs: list[tuple[int, int]] = []
            if found.is_valid and len(found.values):
                s, length = (x.to_numpy() for x in found.values.flatten())
                order = np.argsort(s, kind="stable")
                begin, end = s[order], np.maximum.accumulate((s + length)[order])
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                runs = list(zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))
            edges = [0, *(x for run in runs for x in run), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"first": a, "behind": b} for a, b in runs])
            sizes.append(len(text))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


# ---------------------------------------------------------------- rounds


def judged(nodes: DataFrame, tables: common.Workspace) -> DataFrame:
    """The written ``nodes`` with ``twice`` (the bytes they span occur twice) and ``chosen`` (one node stands for all of these)."""
    same = nodes.groupBy("u1", "u2").agg(F.count("*").alias("c"), F.max(F.struct("k1", "k2", "s")).alias("one")).where("c > 1").select("u1", "u2", "one")
    both = join_splittable(nodes, same, ["u1", "u2"], "left")
    chosen = F.coalesce(F.col("one") == F.struct("k1", "k2", "s"), F.lit(False))
    return tables.write(both.select("k1", "k2", "s", "d", "n", "spare", "i", F.col("one").isNotNull().alias("twice"), chosen.alias("chosen")), "judged")


def going_on(done: DataFrame) -> DataFrame:
    """Nodes that still may hold repeated windows, and the witnesses that they need: those whose name isn't unique."""
    rest = done.where("NOT twice OR chosen").select("k1", "k2", "s", "d", "n", F.expr("spare OR twice").alias("spare"), "i")
    names = rest.groupBy("i").agg(F.count("*").alias("c"), F.bool_or(~F.col("spare")).alias("open")).where("c > 1 AND open").select("i")
    return join_splittable(rest, names, ["i"], "left_semi")


def of_texts(texts: DataFrame, per_text: DataFrame, tables: common.Workspace, inside: bool) -> DataFrame:
    """Texts (with h) that a filter takes for those of the written table ``per_text`` (k1, k2), or the others."""
    held = tables.spark.sparkContext.broadcast(common.filter_of(per_text.select(F.xxhash64("k1", "k2").alias("h"))))
    return texts.mapInArrow(common.tidy(lambda b: filtered(b, held.value, inside)), texts.schema)


def repeated(texts: DataFrame, tables: common.Workspace) -> DataFrame:
    """k1, k2, s, length: byte ranges that are covered by repeated strings, of ``texts`` (k1, k2, text, h)."""
    spark = tables.spark
    counts = texts.mapInArrow(common.tidy(first_names), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = tables.write(counts.select("h"), "names")
    twice = spark.sparkContext.broadcast(common.filter_of(counts))
    tables.drop(counts)
    nodes = tables.write(texts.mapInArrow(common.tidy(lambda b: first_batches(b, twice.value)), NODES), "nodes")
    found = []
    for width in (*WIDTHS[1:], 0):
        done = judged(nodes, tables)
        tables.drop(nodes)
        found.append(tables.write(done.where("twice AND NOT spare").select("k1", "k2", "s", (F.col("n") + (LENGTH - 1)).cast("long").alias("length")), "found"))
        if width:
            lists = going_on(done).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "d", "n", "spare")).alias("nodes"))
            lists = tables.write(lists, "lists")
            met = of_texts(texts, lists, tables, True).join(lists.hint("shuffle_hash"), ["k1", "k2"])
            nodes = tables.write(met.select("k1", "k2", "text", "nodes").mapInArrow(common.tidy(lambda b, width=width: next_batches(b, width)), NODES), "nodes")
            tables.drop(lists)
        tables.drop(done)
        common.release(spark)
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    out = tables.write(all_found.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "length")).alias("found")), "ranges")
    tables.drop(*found)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, in bytes) and kept (the other bytes) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    tables = common.Workspace(spark, "repeats")
    # texts are told apart by id and hash: rows that agree in both have the same text, of which every window repeats
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"), F.xxhash64("text").alias("k2"), "text")
    texts = texts.withColumn("h", F.xxhash64("k1", "k2"))
    ranges = repeated(texts.drop("doc_id"), tables)
    whole = of_texts(texts, ranges, tables, False)
    whole = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("CAST(array() AS array<struct<first:bigint,behind:bigint>>)").alias("spans"), F.col("text").cast("binary").alias("kept"))
    met = of_texts(texts, ranges, tables, True).join(ranges.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "found")
    return whole.unionByName(met.mapInArrow(common.tidy(cut_batches), CUTS))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (sum, x) -> sum + x.behind - x.first)")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

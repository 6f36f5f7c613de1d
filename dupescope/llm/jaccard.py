"""Operator 10: exact n-gram Jaccard join with signature trees.

A document is the set of its distinct word 5-grams (64-bit hashes).  Documents link when
the Jaccard similarity of their sets is 0.8 or more; the result is the connected
components of these links.  No link between different sets is lost:

1. Order.  Shingles that many documents hold go to the end of a global order of all
   shingles (a filter of fixed size says which; it only orders, so errors are harmless).
2. Prefixes.  Two similar sets share a shingle among the first n - ceil(0.8 n) + 1 of
   either, in any common order.  Documents with one such shingle in common form a block.
3. Hubs.  Equal sets count once.  Of each block the member that is in most blocks is its
   hub; every set is compared with the hub that it shares most blocks with.  True links
   are contracted to components, so large groups of near copies don't become pairs.
4. Signature trees.  Blocks of two that still hold two components are pairs as they are, and
   go to the check if the hub step didn't compare them.  In larger ones, nodes keep the OR of
   their members' token bitmaps and their range of sizes.  Two trees are traversed at
   once, and a pair of nodes is left as soon as the overlap that its bitmaps and sizes
   allow is too small.  What remains between different components is checked exactly.
5. Second prefixes.  A block that still holds more than ``LARGE`` sets of several components
   belongs to a shingle that is frequent after all.  Its members get new prefixes, in an order
   that has all such shingles last, and new blocks among themselves.  Sets that had none in
   their prefix keep it in the new order, too, so links to those were found before.

Bitmaps count tokens to two per bucket ("one or more" and "two or more", ORed apart) and
the rest as overflow, so the overlap of two nodes is at most the common bits plus the
lesser overflow.  Their width follows the size of the set; a wider one folds onto a
narrower.

Defined results: words are split at ASCII white space with A-Z in lower case; fewer than
five words are one shingle; a null or empty text has no shingles and links with nothing.
Rows that repeat a doc_id are one document (a link of one is a link of all).  Rows with a
null doc_id are returned with a null component and link with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_splittable
from . import common
from .components import components

WORDS = 5
#: Similarity as a fraction: 4 of 5.
NUM, DEN = 4, 5
#: Documents from which a shingle counts as frequent.
FREQUENT = 32
#: Members from which a block of several components gets second prefixes.
LARGE = 1000
#: Members of a block that meet in one task: larger blocks are dealt out, every pair of buckets to a key of its own.
SPLIT = 1000
LEAF, FAN = 16, 4
#: Ids that are broadcast at most.
MOST_IDS = 2_000_000
U64 = np.uint64


def shingles(text: str | None, hashes: common.WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return next(shingle_sets([text], hashes))


def all_shingles(texts: list[str | None], hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, one after the other, and how many each text has."""
    parts = [hashes.of(common.lower_words(t)) for t in texts]  # the words of one text at a time
    sizes = np.array([len(p) for p in parts], np.int64)
    words = np.concatenate(parts) if parts else np.empty(0, U64)
    grams = common.windows(words, WORDS)
    counts = np.maximum(sizes - WORDS + 1, 0)
    begins = np.cumsum(sizes) - sizes
    # windows that begin in a text and end in it
    inside = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    out = grams[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):  # the whole sequence as one
        at = (np.cumsum(counts) - counts)[short]
        out = np.insert(out, at, [common.windows(words[begins[i] : begins[i] + sizes[i]], int(sizes[i]))[0] for i in short])
        counts[short] = 1
    return out, counts


def shingle_sets(texts: list[str | None], hashes: common.WordHashes) -> Iterator[np.ndarray]:
    every, counts = all_shingles(texts, hashes)
    end = 0
    for n in counts.tolist():
        x = np.sort(every[end : end + n])
        end += n
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if n else x


def prefix_length(n: int) -> int:
    return n - (-(-n * NUM // DEN)) + 1 if n else 0


def width(n: int) -> int:
    """Buckets of a set's bitmap: the power of two from n up, 64 at least."""
    return max(64, 1 << max(0, n - 1).bit_length())


def signature(x: np.ndarray) -> np.ndarray:
    """Two planes of bits, buckets with one or more and with two or more tokens: (2, words)."""
    w = width(len(x))
    counts = np.bincount(((x * U64(0x9E3779B97F4A7C15)) >> U64(20)).astype(np.int64) & (w - 1), minlength=w)
    return np.stack([np.packbits(counts >= k, bitorder="little").view(U64) for k in (1, 2)])


def fold(planes: np.ndarray) -> np.ndarray:
    """The planes (..., 2, words) over half as many buckets."""
    half = planes.shape[-1] // 2
    a, b = planes[..., :half], planes[..., half:]
    one = a[..., 0, :] | b[..., 0, :]
    two = a[..., 1, :] | b[..., 1, :] | (a[..., 0, :] & b[..., 0, :])
    return np.stack([one, two], axis=-2)


def bits(planes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(planes).sum(axis=(-1, -2), dtype=np.int64)


class Tree:
    """Levels of nodes over members in order of size: bitmaps, least and largest size, overflow."""

    def __init__(self, sizes: np.ndarray, planes: np.ndarray):
        self.levels = [(planes, sizes, sizes, sizes - bits(planes))]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            p, low, high, over = self.levels[-1]
            cuts = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(p, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(over, cuts)))
            step = FAN

    def children(self, level: int, node: int) -> tuple[int, slice]:
        step = LEAF if level == 1 else FAN
        return level - 1, slice(node * step, min((node + 1) * step, len(self.levels[level - 1][1])))


def possible(a: tuple, b: tuple) -> np.ndarray:
    """Which pairs of nodes of a and of b may hold a similar pair."""
    (pa_, la, ha, oa), (pb, lb, hb, ob) = a, b
    near = (ha[:, None] * DEN >= lb[None] * NUM) & (hb[None] * DEN >= la[:, None] * NUM)
    i, j = np.nonzero(near)
    if len(i):
        most = np.minimum(bits(pa_[i] & pb[j]) + np.minimum(oa[i], ob[j]), np.minimum(ha[i], hb[j]))
        # overlap of at least NUM / (NUM + DEN) of both sizes together
        near[i, j] = most * (NUM + DEN) >= (la[i] + lb[j]) * NUM
    return near


def similar_pairs(left: Tree, right: Tree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: positions of members that may be similar (of one tree: each pair once)."""
    own = right is None
    right = left if own else right
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    pick = lambda level, at: tuple(x[at] for x in level)
    if not len(left.levels[0][1]) or not len(right.levels[0][1]):
        return
    while stack:
        la, a, lb, b = stack.pop()
        if la == 0 and lb == 0:
            yield np.array([a]), np.array([b])
            continue
        da, sa = left.children(la, a) if la >= lb and la else (la, slice(a, a + 1))
        db, sb = right.children(lb, b) if lb >= la and lb else (lb, slice(b, b + 1))
        found = possible(pick(left.levels[da], sa), pick(right.levels[db], sb))
        i, j = np.nonzero(found)
        i, j = i + sa.start, j + sb.start
        if own and da == db:
            keep = i < j if da == 0 else i <= j
            i, j = i[keep], j[keep]
        if da == 0 and db == 0:
            if len(i):
                yield i, j
        else:
            stack += [(da, x, db, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)]


def block_pairs(ids: np.ndarray, sizes: np.ndarray, planes: list[np.ndarray], groups: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of possibly similar members of different groups of a block, size class by size class.

    ``side``: 0 or 1 for each member if only pairs across the sides are wanted.
    """
    order = np.lexsort((ids, sizes))
    wide = np.array([p.shape[1] for p in planes])
    sides = np.zeros(len(ids), np.int8) if side is None else side
    classes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(wide):
        for s in np.unique(sides):
            at = order[(wide[order] == w) & (sides[order] == s)]
            if len(at):
                classes[int(w), int(s)] = at, np.stack([planes[i] for i in at])
    for (w, s), (at, mine) in classes.items():
        tree = Tree(sizes[at], mine)
        for (v, t), (other, theirs) in classes.items():
            if (w, s) == (v, t):
                if side is not None:
                    continue
                found, other = similar_pairs(tree), at
            elif v == w and s < t:
                found = similar_pairs(tree, Tree(sizes[other], theirs))
            elif v == 2 * w and (side is None or s != t):
                found = similar_pairs(tree, Tree(sizes[other], fold(theirs)))
            else:
                continue
            for i, j in found:
                i, j = at[i], other[j]
                keep = groups[i] != groups[j]
                if keep.any():
                    yield ids[i[keep]], ids[j[keep]]


# ---------------------------------------------------------------- passes over the texts


def frequent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of shingles that several documents of a task's batch hold."""
    hashes = common.WordHashes()
    for batch in common.gathered(batches, "text", 8 << 20):
        grams, _ = all_shingles(batch.column(batch.schema.get_field_index("text")).to_pylist(), hashes)
        if len(grams):
            h, n = np.unique(grams, return_counts=True)
            h, n = h[n > 2], n[n > 2]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


SET_TYPES = "doc_id long, n long, d1 long, d2 long, sig binary, prefix array<long>"


def set_batches(batches: Iterator[pa.RecordBatch], *frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Size, digest, bitmap and prefix of each document's set; shingles of the filters ``frequent`` come last in the order."""
    hashes = common.WordHashes()
    for batch in common.gathered(batches, "text", 1 << 20):
        for ids, texts in common.rows([batch], "doc_id", "text"):
            out: list[list] = [[] for _ in range(5)]
            for x in shingle_sets(texts, hashes):
                d = np.frombuffer(hashlib.md5(x.tobytes()).digest(), np.int64)
                late = np.zeros(len(x), bool)
                for bits_ in frequent:
                    late |= common.in_filter(bits_, x)
                order = np.concatenate([x[~late], x[late]])
                for column, value in zip(out, (len(x), int(d[0]), int(d[1]), signature(x).tobytes(), order[: prefix_length(len(x))].view(np.int64)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n", "d1", "d2", "sig", "prefix"])


def kept_batches(batches: Iterator[pa.RecordBatch], bitset: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose ``h`` is in the filter, or those where it isn't."""
    for batch in batches:
        h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False).view(U64)
        yield batch.filter(pa.array(common.in_filter(bitset, h) == inside))


def shingle_batches(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, x): sets of the documents that the filter wants."""
    hashes = common.WordHashes()
    for batch in kept_batches(batches, wanted, True):
        for piece in common.slices([batch], "text", 2 << 20):
            for ids, texts in common.rows([piece], "doc_id", "text"):
                found = [x.tobytes() for x in shingle_sets(texts, hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["id", "x"])


# ---------------------------------------------------------------- checks of pairs


def planes_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U64).reshape(2, -1)


def bound_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, b, na, nb, sa, sb in common.rows(batches, "a", "b", "na", "nb", "sa", "sb"):
        good = []
        for n, m, s, t in zip(na, nb, sa, sb, strict=True):
            ok = min(n, m) * DEN >= max(n, m) * NUM
            if ok:
                p, q = planes_of(s), planes_of(t)
                while p.shape[1] > q.shape[1]:
                    p = fold(p)
                while q.shape[1] > p.shape[1]:
                    q = fold(q)
                most = int(bits(p & q)) + min(n - int(bits(p)), m - int(bits(q)))
                ok = most * (NUM + DEN) >= (n + m) * NUM
            good.append(ok)
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], names=["a", "b"])


def exact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        good = []
        for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            good.append(100 * inter >= 80 * (len(x) + len(y) - inter) and inter > 0)
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to be similar."""
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("n").alias("n" + k), F.col("sig").alias("s" + k))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(common.tidy(bound_batches), "a long, b long").distinct()


def of_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Broadcast]:
    """doc_id, text, h of ``docs``, and a filter over ``h`` that the documents of the written table ``ids`` (id) pass."""
    wanted = docs.sparkSession.sparkContext.broadcast(common.filter_of(ids.select(F.xxhash64("id").alias("h"))))
    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")), wanted


def verified(pairs: DataFrame, docs: DataFrame, tables: common.Workspace) -> DataFrame:
    """The pairs (a, b) whose sets are similar; sets come from the texts of the documents concerned only."""
    pairs = tables.write(pairs, "pairs")
    rows, wanted = of_ids(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    x = tables.write(rows.mapInArrow(common.tidy(lambda b: shingle_batches(b, wanted.value)), "id long, x binary"), "pair-sets")
    both = pairs.join(x.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(x.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    out = tables.write(both.select("a", "b", "xa", "xb").mapInArrow(common.tidy(exact_batches), "a long, b long"), "links")
    tables.drop(pairs, x)
    return out


def tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (h, p, q, rep, n, sig, component, bucket), sorted by block: pairs (a, b) that may be similar."""
    key, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            ids, sizes, sigs, comps, buckets = zip(*held, strict=True)
            p, q = key[1], key[2]
            side = None if p == q else (np.array(buckets) == q).astype(np.int8)
            seen: list[np.ndarray] = []
            for a, b in block_pairs(np.array(ids), np.array(sizes), [planes_of(s) for s in sigs], np.array(comps), side):
                seen.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if seen:
                both = np.unique(np.concatenate(seen, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    for h, p, q, *rest in common.rows(batches, "h", "p", "q", "rep", "n", "sig", "component", "bucket"):
        for k, row in zip(zip(h, p, q, strict=True), zip(*rest, strict=True), strict=True):
            if k != key:
                yield from flush()
                key, held = k, []
            held.append(row)
    yield from flush()


# ---------------------------------------------------------------- the join


def distinct_sets(every: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, n, sig, prefix of the sets that aren't copies; only rows that a filter takes for copies are compared with them."""
    key = F.xxhash64("doc_id", "d1", "d2").alias("h")
    copied = every.sparkSession.sparkContext.broadcast(common.filter_of(copies.select(key)))
    rows = every.where("doc_id is not null and n > 0").withColumn("h", key)
    side = lambda inside: rows.mapInArrow(common.tidy(lambda b: kept_batches(b, copied.value, inside)), rows.schema)
    doubtful = side(True).join(copies.select("doc_id", "d1", "d2"), ["doc_id", "d1", "d2"], "left_anti")
    return side(False).unionByName(doubtful).select("doc_id", "n", "sig", "prefix")


def in_blocks(sets: DataFrame, tables: common.Workspace) -> DataFrame:
    """(h, rep): the members of each prefix shingle that two or more sets hold."""
    blocks = tables.write(sets.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "blocks")
    shared = sets.sparkSession.sparkContext.broadcast(common.filter_of(blocks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            h = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            good = common.in_filter(shared.value, h.view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(h[good]), pa.array(owner[good])], names=["h", "rep"])

    members = tables.write(sets.select("doc_id", "prefix").mapInArrow(common.tidy(work), "h long, rep long").join(blocks, "h").distinct(), "members")
    tables.drop(blocks)
    return members


def mixed_blocks(members: DataFrame, groups: DataFrame, tables: common.Workspace) -> tuple[DataFrame, DataFrame]:
    """(h, rep, component) of all members, and (h, c, a, b) of the blocks with several components; of two members a > b."""
    now = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", F.coalesce("component", "rep").alias("component"))
    now = tables.write(now, "now")
    several = now.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"), F.max("rep").alias("a"), F.min("rep").alias("b")).where("low < high")
    return now, tables.write(several.select("h", "c", "a", "b"), "several")


def tree_pairs(now: DataFrame, mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the blocks ``mixed`` (h, c) that trees can't rule out."""
    mixed = mixed.select("h", F.ceil(F.col("c") / SPLIT).cast("int").alias("parts"))
    rows = join_splittable(now, mixed, ["h"]).join(sets.select(F.col("doc_id").alias("rep"), "n", "sig"), "rep")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # a large block is dealt out: every pair of its buckets is a key of its own
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("p", F.least("bucket", "o")).withColumn("q", F.greatest("bucket", "o"))
    rows = rows.repartition(common.partitions(now.sparkSession), "h", "p", "q").sortWithinPartitions("h", "p", "q")
    return rows.select("h", "p", "q", "rep", "n", "sig", "component", "bucket").mapInArrow(common.tidy(tree_batches), "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    tables = common.Workspace(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    counts = docs.where("doc_id is not null").mapInArrow(common.tidy(frequent_batches), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = tables.write(counts.select("h"), "frequent")
    frequent = spark.sparkContext.broadcast(common.filter_of(counts))
    every = tables.write(docs.mapInArrow(common.tidy(lambda b: set_batches(b, frequent.value)), SET_TYPES), "every")

    # equal sets: the least doc_id stands for all
    usable = every.where("doc_id is not null and n > 0")
    reps = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = join_splittable(usable.select("doc_id", "d1", "d2"), reps.where("copies > 1"), ["d1", "d2"]).where("doc_id <> rep").distinct()
    copies = tables.write(copies, "copies")
    sets = tables.write(distinct_sets(every, copies), "sets")
    sizes = tables.write(every.select("doc_id", "n"), "sizes")
    tables.drop(counts, every)
    members = in_blocks(sets, tables)
    common.release(spark)

    # hubs: one comparison for each set
    degree = members.groupBy("rep").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "rep").groupBy("h").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("top")).select("h", (-F.col("top.r")).alias("hub"))
    best = join_splittable(members, hubs, ["h"]).where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("c")).groupBy("rep").agg(F.max_by("hub", F.struct("c", (-F.col("hub")).alias("r"))).alias("hub"))
    compared = tables.write(best.select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct(), "compared")
    first = verified(bounded(compared, sets), docs, tables)
    groups = tables.write(components(first, tables=tables), "groups")
    common.release(spark)

    # trees over the blocks that still hold several components
    now, several = mixed_blocks(members, groups, tables)
    tables.drop(members)
    # a block of two is one pair and needs no tree; the hub step may have compared it
    twos = several.where("c = 2").select("a", "b")
    found = tables.write(tree_pairs(now, several.where(f"c > 2 and c <= {LARGE}"), sets), "tree-pairs")
    large = several.where(f"c > {LARGE}").select("h")
    if large.limit(1).count():
        # second prefixes for the members of large blocks
        ids = tables.write(now.join(large, "h").select(F.col("rep").alias("id")).distinct(), "large-ids")
        rows, wanted = of_ids(docs, ids)
        late = spark.sparkContext.broadcast(common.filter_of(large))
        again = rows.mapInArrow(common.tidy(lambda b: set_batches(kept_batches(b, wanted.value, True), frequent.value, late.value)), SET_TYPES)
        again = tables.write(again.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "prefix"), "second")
        now, more = mixed_blocks(in_blocks(again, tables), groups, tables)
        twos = twos.union(more.where("c = 2").select("a", "b"))
        found = found.union(tree_pairs(now, more.where("c > 2"), sets))
    pairs = found.union(bounded(twos.distinct().join(compared, ["a", "b"], "left_anti"), sets).select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    second = verified(pairs, docs, tables)
    common.release(spark)

    final = components(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(first).union(second), tables=tables)
    found = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = tables.write(found, "found")
    tables.drop_others(out)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component (the least doc_id; of repeated rows all), all columns.

    Up to MOST_IDS ids of documents that go are broadcast, 8 bytes each, so that no text is
    shuffled; more are joined.
    """
    tables = common.Workspace(docs.sparkSession, "kept")
    gone = tables.write(linked(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= MOST_IDS else gone
    return docs.join(side, "doc_id", "left_anti").select(docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))


#: All pairs by shared shingles, and what links reach: for DuckDB on small tables.
OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reached r JOIN edges e ON e.a = r.id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM reached GROUP BY 1) r ON r.id = d.doc_id
"""

"""Operator 11: hard negatives by product quantisation with stored residual norms.

Vectors become integers, floor(256 x).  A row's score for an anchor is their inner product.

1. Index.  Codebooks of ``CENTROIDS`` points for each ``SUB`` components are fitted on a sample of
   ``SAMPLE`` rows (the first by a hash of the id).  Every row is indexed: its codes, and the norm
   of what the codes leave over (the residual), rounded up.
2. Filter.  Anchors meet rows in blocks: every block of ``ANCHORS`` anchors with every part of
   ``ROWS`` rows, in a task of its own.  Lookup tables give a score of the coded row; by
   Cauchy-Schwarz the true one differs by at most the anchor's norm times the residual's, so it
   lies between two bounds.  A row whose upper bound is below the fifth best lower bound (of
   the rows that surely count) can't be among the first five, and is left.
3. Rerank.  What remains gets its exact integer score, the first ``KEEP`` of a part go on, and the
   first of all parts are the result.  One such pass finds the positives; their scores make
   the windows, and a second pass fills these.

The filter is rigorous (float errors are part of the stored norm), so the result equals brute
force; the sample decides only how much is reranked.

Defined results: rows with a null id, label or vector, no component, or a null or non-finite one take
no part; nor do vectors of another length than the most frequent one (of equally frequent ones the
shorter), or with an integer component so large that a score might pass 64 bits.  Other rows of
an anchor are those with another id.  Rows that repeat an id are rows of their own, but anchors
equal in id, label and vector are one.  Ties go by id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, KEEP, ANCHOR_EVERY = 256, 5, 100
#: A negative counts from NEAR of 100 of the positive's score up to all of it.
NEAR = 80
SUB, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4096, 6
#: Rows of a part, anchors of a block, pairs that are bounded or reranked at once.
ROWS, ANCHORS, PAIRS = 1 << 16, 1 << 14, 1 << 21
#: Below this a part isn't split further to occupy more cores.
LEAST_ROWS = 4096


# ---------------------------------------------------------------- product quantisation


def split(x: np.ndarray) -> np.ndarray:
    """(n, d) -> (d / SUB, n, SUB), padded with zeros."""
    n, d = x.shape
    parts = -(-d // SUB)
    padded = np.zeros((n, parts * SUB))
    padded[:, :d] = x
    return padded.reshape(n, parts, SUB).transpose(1, 0, 2)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point."""
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def fit(sample: np.ndarray) -> np.ndarray:
    """Codebooks (parts, CENTROIDS, SUB) by Lloyd's rounds from evenly spaced different points."""
    books = []
    for points in split(sample):
        known = np.unique(points, axis=0)
        centres = known[np.linspace(0, len(known) - 1, min(CENTROIDS, len(known))).astype(int)]
        for _ in range(ROUNDS):
            own = nearest(points, centres)
            n = np.bincount(own, minlength=len(centres))
            sums = np.stack([np.bincount(own, points[:, k], len(centres)) for k in range(SUB)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.append(np.resize(centres, (CENTROIDS, SUB)))
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts), and what a score may be off by for an anchor of norm one.

    That is the residual's norm, plus the error of ``len(books)`` additions of 32-bit floats.
    """
    parts = split(x)
    codes = np.stack([nearest(p, b) for p, b in zip(parts, books, strict=True)], axis=1)
    near = np.stack([b[c] for b, c in zip(books, codes.T, strict=True)])
    left = np.sqrt(((parts - near) ** 2).sum(axis=(0, 2)))
    return codes.astype(np.uint8), left * (1 + 1e-5) + np.sqrt((near**2).sum(axis=(0, 2))) * (len(books) + 8) * 2.0**-22 + 1e-9


class Part:
    """Rows that share a task: ids, labels, integer vectors, codes and residual norms."""

    def __init__(self, table: pa.Table, parts: int):
        n = table.num_rows
        self.ids = table.column("vec_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = raw(table.column("v"), np.int32).reshape(n, -1)
        self.codes = raw(table.column("codes"), np.uint8).reshape(n, parts)
        self.left = table.column("left").to_numpy().astype(np.float64)

    def bounds(self, at: np.ndarray, anchors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible scores (rows ``at``, anchors), from lookup tables."""
        tables = np.einsum("pas,pks->pka", split(anchors), books).astype(np.float32)
        score = np.zeros((len(at), len(anchors)), np.float32)
        for begin in range(0, len(at), 2048):
            here = at[begin : begin + 2048]
            for k, lookup in enumerate(tables):
                score[begin : begin + 2048] += lookup[self.codes[here, k]]
        off = (self.left[at][:, None] * np.sqrt((anchors.astype(np.float64) ** 2).sum(1))).astype(np.float32)
        return score - off, score + off

    def exact(self, i: np.ndarray, anchors: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Integer scores of the pairs of rows i and anchors j."""
        out = np.empty(len(i), np.int64)
        step = max(1, PAIRS // max(1, self.vectors.shape[1]))
        for begin in range(0, len(i), step):
            cut = slice(begin, begin + step)
            out[cut] = np.einsum("nd,nd->n", self.vectors[i[cut]].astype(np.int64), anchors[j[cut]].astype(np.int64))
        return out


def raw(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def fifth(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The KEEP-th largest value of each of ``n`` groups, minus infinity where there are fewer."""
    order = np.lexsort((-values, groups))
    g = groups[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    out = np.full(n, -np.inf)
    out[g[place == KEEP - 1]] = values[order][place == KEEP - 1]
    return out


def first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the first KEEP of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < KEEP]


def anchor_chunks(labels: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Anchors of one label, so many at once that their pairs with ``n`` rows stay few."""
    step = max(1, PAIRS // max(1, n))
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        for begin in range(0, len(at), step):
            yield at[begin : begin + step]


def positives_of(part: Part, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of the first KEEP other rows of the same label in this part."""
    for who in anchor_chunks(labels, len(part.ids)):
        at = np.flatnonzero(part.labels == labels[who[0]])
        if not len(at):
            continue
        low, high = part.bounds(at, anchors[who], books)
        own = part.ids[at][:, None] == ids[who]
        low[own] = high[own] = -np.inf
        least = np.partition(low, len(at) - KEEP, axis=0)[len(at) - KEEP] if len(at) >= KEEP else np.full(len(who), -np.inf)
        i, j = np.nonzero((high >= least) & ~own)
        i, j = at[i], who[j]
        scores = part.exact(i, anchors, j)
        best = first(j, scores, part.ids[i])
        yield j[best], i[best], scores[best]


def negatives_of(part: Part, labels: np.ndarray, anchors: np.ndarray, books: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, window, row, score) of the first KEEP rows of other labels in each window of each anchor.

    ``windows``: (anchors, KEEP), the positives' scores, or -1 where there is no window: a
    positive of negative score has none, since 80 of 100 of it is more than all of it.
    """
    lows, highs = -(-NEAR * windows // 100), windows
    for who in anchor_chunks(labels, len(part.ids)):
        real = windows[who] >= 0
        at = np.flatnonzero(part.labels != labels[who[0]])
        if not len(at) or not real.any():
            continue
        low, high = part.bounds(at, anchors[who], books)
        widest = np.where(real, lows[who], np.iinfo(np.int64).max).min(1), np.where(real, highs[who], -1).max(1)
        i, j = np.nonzero((high >= widest[0]) & (low <= widest[1]))
        low, high = low[i, j].astype(np.float64), high[i, j].astype(np.float64)
        wanted = np.zeros(len(i), bool)
        for w in range(KEEP):
            least, most = lows[who][j, w], highs[who][j, w]
            may = real[j, w] & (high >= least) & (low <= most)
            sure = may & (low >= least) & (high <= most)
            wanted |= may & (high >= fifth(j[sure], low[sure], len(who))[j])
        i, j = at[i[wanted]], who[j[wanted]]
        scores = part.exact(i, anchors, j)
        for w in range(KEEP):
            inside = np.flatnonzero((windows[j, w] >= 0) & (scores >= lows[j, w]) & (scores <= highs[j, w]))
            best = inside[first(j[inside], scores[inside], part.ids[i[inside]])]
            yield j[best], np.full(len(best), w), i[best], scores[best]


# ---------------------------------------------------------------- on Spark


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label (changed where the id is divisible by 7), embedding of the rows that take part, whatever their length."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    good = rows.where(f"vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND {finite}")
    label = F.expr("CAST(CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS BIGINT)")
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")


INDEX = "vec_id long, label long, v binary, codes binary, left double"


def index_batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        whole = np.floor(SCALE * vectors.astype(np.float64)).astype(np.int32)
        codes, left = encode(whole.astype(np.float64), books)
        binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), binary(whole), binary(codes), pa.array(left)], names=["vec_id", "label", "v", "codes", "left"])


def anchor_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), raw(table.column("v"), np.int32).reshape(table.num_rows, -1), table.column("key").to_numpy()


def met(index: DataFrame, anchors: DataFrame, parts: int, blocks: int, work, schema: str) -> DataFrame:  # noqa: ANN001
    """``work(rows, anchors)`` for every part of the rows with every block of the anchors, each pair in a group of its own."""
    rows = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.groupBy("part", "block").cogroup(sides.groupBy("part", "block")).applyInArrow(work, schema)


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, embedding, label)."""
    spark = rows.sparkSession
    common.bound_batches(spark)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = usable(rows.select("vec_id", "embedding", "label"))
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return empty
    # so large a component that a sum of d products stays within 64 bits, and that it is one of 32
    most = min(math.isqrt((2**63 - 1) // length.d), 2**31 - 1)
    rows = rows.where((F.size("embedding") == length.d) & F.expr(f"forall(embedding, x -> abs(floor({SCALE} * double(x))) <= {most})"))
    sample = [r.embedding for r in rows.select(F.xxhash64("vec_id").alias("h"), "embedding").orderBy("h").limit(SAMPLE).collect()]
    if not sample:
        return empty
    books = fit(np.floor(SCALE * np.array(sample, np.float64)))
    held = spark.sparkContext.broadcast(books)  # CENTROIDS numbers for each component

    tables = common.Workspace(spark, "negatives")
    n = rows.count()
    parts = max(-(-n // ROWS), min(common.partitions(spark), -(-n // LEAST_ROWS)), 1)
    coded = rows.mapInArrow(common.tidy(lambda b: index_batches(b, held.value)), INDEX)
    index = tables.write(coded.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), "index")
    picked = index.where(F.col("vec_id") % ANCHOR_EVERY == 0).select("vec_id", "label", "v").distinct()
    anchors = tables.write(picked.withColumn("key", F.xxhash64("label", "v")), "anchors")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, vectors, keys = anchor_arrays(right)
        part = Part(left, len(held.value)) if left.num_rows and right.num_rows else None
        found = list(positives_of(part, ids, labels, vectors, held.value)) if part else []
        j, i, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        other = part.ids[i] if part else i
        return pa.table({"anchor_id": ids[j], "key": keys[j], "positive_id": other, "positive_score": s})

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, vectors, keys = anchor_arrays(right)
        part = Part(left, len(held.value)) if left.num_rows and right.num_rows else None
        found: list = []
        if part:
            windows = np.array([(x + [-1] * KEEP)[:KEEP] for x in right.column("scores").to_pylist()], np.int64)
            found = list(negatives_of(part, labels, vectors, held.value, windows))
        j, w, i, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
        other = part.ids[i] if part else i
        return pa.table({"anchor_id": ids[j], "key": keys[j], "w": w.astype(np.int32), "negative_id": other, "negative_score": s})

    def leading(found: DataFrame, keys: list[str], score: str, other: str, rank: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(other))
        return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= KEEP)

    local = met(index, anchors, parts, blocks, near, "anchor_id long, key long, positive_id long, positive_score long")
    positives = tables.write(leading(local, ["anchor_id", "key"], "positive_score", "positive_id", "place").withColumn("w", F.col("place") - 1).drop("place"), "positives")
    scores = positives.groupBy("anchor_id", "key").agg(F.expr("transform(sort_array(collect_list(struct(w, positive_score))), x -> x.positive_score)").alias("scores"))
    windows = anchors.join(scores.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "key"])
    local = met(index, windows, parts, blocks, hard, "anchor_id long, key long, w int, negative_id long, negative_score long")
    negatives = leading(local, ["anchor_id", "key", "w"], "negative_score", "negative_id", "rank")
    out = tables.write(negatives.join(positives, ["anchor_id", "key", "w"]).select(empty.columns), "found")
    tables.drop(index, positives)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(common.table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH finite AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM finite
  WHERE len(embedding) = (SELECT len(embedding) AS d FROM finite GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 1)
), anchors AS (SELECT DISTINCT vec_id AS anchor_id, label, v FROM usable WHERE vec_id % 100 = 0
), scores AS (
  SELECT anchor_id, a.label, a.v, r.vec_id, r.label = a.label AS same, list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM anchors a, usable r WHERE r.vec_id <> anchor_id OR r.label <> a.label
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, label, v ORDER BY score DESC, vec_id) AS place FROM scores WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.label, p.v, place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND n.label = p.label AND n.v = p.v AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

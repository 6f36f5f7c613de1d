"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are present or absent: its words, pairs of neighbouring words, pairs
with one word between (skip-grams), and word beginnings of 4 to 7 letters, each hashed to
2^BITS coordinates.  Learning takes one coordinate at a time: each has its own learning
rate and an L1 threshold below which its weight is exactly zero, so the weights that are
sent to the executors are few.

Learning uses a bounded sample of labelled rows: of each label the ``per_label`` rows
that come first by a hash of doc_id, with texts of up to ``max_train_bytes``.  Features that
fewer than ``LEAST`` of them have are dropped in Spark, so the driver gets at most
2 * per_label * max_train_bytes / 2 coordinates of 4 bytes, and in practice a fifth of that.
Every text is scored whole.

Defined results: a null or empty text has the intercept's score.  Rows with a null label
or null doc_id are not learnt from; a document labelled both ways counts as toxic.
Without any toxic or any clean labelled row all scores are the share of toxic ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 22
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
#: Sampled texts that must have a feature.
LEAST = 3
U64 = np.uint64


class Features:
    """Hashed coordinates of texts; remembers words up to a fixed number."""

    LIMIT = 300_000

    def __init__(self, bits: int = BITS):
        self.mask = U64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(PREFIXES)), U64)

    def add(self, word: str) -> None:
        at = self.rows[word] = len(self.rows)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        # a prefix that is the whole word adds nothing to the word
        self.table[at] = [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(word[:n], seed=n) if len(word) > n else 0 for n in PREFIXES)]

    def of(self, text: str | None) -> np.ndarray:
        """Coordinates, with repeats."""
        if not text:
            return np.empty(0, np.int64)
        words = WORD.findall(text.lower())
        if len(self.rows) > self.LIMIT:
            self.clear()
        for w in set(words).difference(self.rows):
            self.add(w)
        rows = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        one = rows[:, 0]
        parts = [one, common.mix(one[:-1] * U64(3) + one[1:]), common.mix(one[:-2] * U64(5) + one[2:])]
        parts += [p[p != 0] for p in rows[:, 1:].T]
        return (np.concatenate(parts) & self.mask).astype(np.int64)


@dataclass
class Weights:
    """The coordinates that are not zero, and the intercept."""

    index: np.ndarray
    value: np.ndarray
    intercept: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.value
        return out


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(samples: list[tuple[np.ndarray, int]], alpha: float = 0.6, beta: float = 1.0, l1: float | None = None, l2: float = 0.0, epochs: int = 6, bits: int = BITS) -> Weights:
    """FTRL-proximal over (distinct coordinates, label); the rarer label weighs more.

    ``l1`` is 0.3 times the root of the number of samples unless given: what pure noise adds
    up to grows as that root.
    """
    l1 = 0.3 * len(samples) ** 0.5 if l1 is None else l1
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    toxic = sum(y for _, y in samples)
    if not 0 < toxic < len(samples):
        share = toxic / max(1, len(samples))
        return Weights(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), bits)
    gain = {1: min(8.0, max(1.0, (len(samples) - toxic) / toxic)), 0: min(8.0, max(1.0, toxic / (len(samples) - toxic)))}
    order = np.random.default_rng(7)

    def weight(zi, ni):
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            x, y = samples[k]
            zi, ni = z[x], n[x]
            w = weight(zi, ni)
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = (sigmoid(w.sum() + wb) - y) * gain[y]
            root = np.sqrt(ni + g * g)
            z[x] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[x] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = weight(z, n)
    index = np.flatnonzero(w)
    return Weights(index, w[index].astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)), bits)


def labelled(docs: DataFrame, labels: DataFrame, per_label: int, max_train_bytes: int, least: int = LEAST) -> list[tuple[np.ndarray, int]]:
    """The bounded sample, as coordinates of 32 bits that ``least`` of its texts have."""
    common.bound_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").where(common.crc_fold("doc_id", 3) != 1)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect() for y in (0, 1)]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.y) for p in parts for r in p], "doc_id long, y int")
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_train_bytes).join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for ids, ys, bodies in common.rows(batches, "doc_id", "y", "text"):
            found = [np.unique(features.of(t)).astype(np.int32) for t in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    tables = common.Workspace(spark, "toxicity")
    every = tables.write(texts.mapInArrow(common.tidy(work), "doc_id long, y int, x array<int>"), "features")
    often = every.select(F.explode("x").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = often.select(F.shiftright("f", 6).alias("w"), F.expr("shiftleft(1L, f & 63)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    wanted = np.zeros(max(1, (1 << BITS) // 64), np.int64)
    got = words.toArrow()  # at most 2^BITS / 64 rows
    wanted[got["w"].to_numpy()] = got["b"].to_numpy()
    shared = spark.sparkContext.broadcast(wanted.view(U64))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("x"):
                at = x.values.to_numpy()
                found.append(at[(shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) != 0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "x"])

    got = every.mapInArrow(common.tidy(frequent), "doc_id long, y int, x binary").toArrow()
    tables.drop(every)
    out = sorted(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), got["x"].to_pylist(), strict=True))
    return [(np.frombuffer(x, np.int32), y) for _, y, x in out]


def score_batches(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    features, dense = Features(weights.bits), weights.dense()
    for ids, texts in common.rows(common.slices(batches, "text", 4 << 20), "doc_id", "text"):
        sums = []
        for text in texts:
            x = features.of(text)
            x = np.unique(x[dense[x] != 0])  # each feature once
            sums.append(float(dense[x].sum()) + weights.intercept)
        scores = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, score of each document; the weights travel once to each executor."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most 2^BITS pairs
    return docs.select("doc_id", "text").mapInArrow(common.tidy(lambda b: score_batches(b, shared.value)), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str, per_label: int = 2000, max_train_bytes: int = 16 << 10) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    weights = train(labelled(docs, common.table(spark, sf_dir, "labels"), per_label, max_train_bytes))
    held_out = F.coalesce(common.crc_fold("doc_id", 3) == 1, F.lit(False))
    return score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

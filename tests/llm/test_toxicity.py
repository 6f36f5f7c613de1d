"""Operator 6: held-out rows, sparsity, special cases."""

import math
import zlib

import numpy as np
import pytest
from dupescope.llm import toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def test_held_out(spark):
    got = toxicity.op6_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    r = {x.toxic: x.flagged for x in got.groupBy("toxic").agg(F.avg("predicted").alias("flagged")).collect()}
    assert r[1] > 0.75 and r[0] < 0.02


def test_weights_are_sparse_and_features_count_once():
    rng = np.random.default_rng(1)
    samples = [(np.unique(np.append(rng.integers(10, 5000, 80), [3] if i % 4 == 0 else [])).astype(np.int64), int(i % 4 == 0)) for i in range(800)]
    w = toxicity.train(samples, bits=13)
    assert 3 in w.index and len(w.index) < 500 and w.dense()[3] == w.value.max()


def test_special_rows(spark):
    words = ["alpha beta", "gamma delta"]
    rows = [(i, words[i % 2] + f" w{i} filler", 1) for i in range(200)] + [(1000, None, 1), (1001, "", 1), (None, "alpha", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    weights = toxicity.train(toxicity.labelled(docs, labels, 100, 1000))
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert len(got) == len(rows) and got[1] > 0.7 > 0.3 > got[0] and got[1000] == got[1001] == pytest.approx(toxicity.sigmoid(weights.intercept))
    none = toxicity.train(toxicity.labelled(docs, labels.where("toxic = 0"), 100, 1000))
    assert all(r.score < 0.1 for r in toxicity.score(docs, none).collect())
    assert 0 <= toxicity.sigmoid(toxicity.train([]).intercept) <= 1
    assert toxicity.score(docs.where("doc_id > 9999"), weights).count() == 0


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(i, ["alpha beta", "gamma delta"][i % 2] + f" w{i} filler") for i in range(120)]
    docs = spark.createDataFrame([*rows, rows[0], rows[1], rows[1]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    weights = toxicity.train(toxicity.labelled(docs, labels, 100, 1000))
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, weights).collect()]
    assert len(got) == 123 and len(set(got)) == 120 and [i for i, _ in got].count(1) == 3


def brute_ftrl(samples, l1, alpha=0.6, beta=1.0, epochs=6):
    """FTRL-proximal coordinate by coordinate, after the published update; the intercept has no L1."""
    z, n = {}, {}
    toxic = sum(y for _, y in samples)
    gain = [min(8.0, max(1.0, toxic / (len(samples) - toxic))), min(8.0, max(1.0, (len(samples) - toxic) / toxic))]

    def weight(i):
        if i != "b" and abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = math.copysign(l1 if i != "b" else 0.0, z.get(i, 0.0))
        return -(z.get(i, 0.0) - sign) * alpha / (beta + math.sqrt(n.get(i, 0.0)))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            x, y = samples[k]
            active = [*x.tolist(), "b"]
            w = {i: weight(i) for i in active}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * gain[y]
            for i in active:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_equals_brute_force():
    rng = np.random.default_rng(2)
    samples = [(np.unique(rng.integers(0, 60, 12)).astype(np.int32), int(rng.random() < 0.3)) for _ in range(120)]
    samples = [(np.unique(np.append(x, 60)).astype(np.int32) if y else x, y) for x, y in samples]
    for l1 in (0.0, 0.5, 3.0):
        w, expected = toxicity.train(samples, bits=6, l1=l1), brute_ftrl(samples, l1)
        assert w.intercept == pytest.approx(expected.pop("b"), rel=1e-9)
        dense = w.dense()
        assert all(dense[i] == pytest.approx(x, rel=1e-5, abs=1e-7) for i, x in expected.items())
        assert set(w.index.tolist()) == {i for i, x in expected.items() if x}


def test_sample_keeps_frequent_features_and_long_texts_are_scored_whole(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "delta beta") for i in range(9)] + [(50, "rare words " * 3), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, 100, 1000)
    features = toxicity.Features()
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    sets = sorted((i, i % 2, set(features.of(t).tolist())) for i, t in rows if fold(i) and t)
    often = {f for f in set().union(*(x for *_, x in sets)) if sum(f in x for *_, x in sets) >= toxicity.LEAST}
    assert [(y, set(x.tolist())) for x, y in got] == [(y, x & often) for _, y, x in sets]
    weights = toxicity.train(got, l1=0.01)
    long = spark.createDataFrame([(1, "filler " * 300_000 + "alpha beta gamma"), (2, "filler " * 300_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(long, weights).collect()}
    assert scores[1] != scores[2]

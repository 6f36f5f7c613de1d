"""Operator 5: gradients, held-out accuracy, special texts."""

import numpy as np
import pytest
from dupescope.llm import language
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_gradients():
    model = language.BiGru.fresh(["a", "b", "c"], hidden=4)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    x, y = np.array([[32, 97, 98, 32], [32, 99, 98, 32]], np.uint8), np.array([0, 2])
    _, grads = model.gradients(x, y)
    for name, p in model.params.items():
        at = np.unravel_index(np.argmax(abs(grads[name])), p.shape)
        old, losses = p[at], []
        for step in (1e-3, -1e-3):
            p[at] = old + step
            losses.append(model.gradients(x, y)[0])
        p[at] = old
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=1e-2)


def test_held_out_accuracy(spark):
    got = language.op5_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and 0 <= r[1] <= r[2] <= 1


def test_special_texts(spark):
    rows = [(i, t, lang, i) for i, (t, lang) in enumerate([("the and of to in " * 3, "en"), ("der die und das ist " * 3, "de")] * 30)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "123 ½ !!", None, 1), (103, "é" * 5000, None, 1), (None, "the and", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert len(got) == len(rows)
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and got[None].lang_pred == "en"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102)) and got[103].lang_pred in ("en", "de")
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {100, 101, 102}
    assert language.predict(docs.where("doc_id > 500"), model).count() == 0
    # nothing to learn from
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.where("lang is null"))).collect()} == {"und"}


def brute(model, raw):
    """Mean distribution over the positions of one sequence, one step and one text at a time."""
    p = model.params
    squash = lambda x: x / (1 + abs(x))
    said = []
    for d, text in (("f", raw), ("b", raw[::-1])):
        h, out = np.zeros(len(p["v" + d])), []
        for byte in text:
            z, r = ((1 + squash(p["x" + d + g][byte] + h @ p["u" + d + g])) / 2 for g in "zr")
            n = squash(p["x" + d + "n"][byte] + r * (h @ p["u" + d + "n"]))
            h = (1 - z) * n + z * h
            out.append(h @ p["v" + d])
        said.append(out if d == "f" else out[::-1])
    logits = np.array(said[0]) + np.array(said[1]) + p["c"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def trained():
    stretches = [(b"the red house and the blue sea " * 3, "en"), (b"das rote haus und die blaue see " * 3, "de"), (b"el mar y la casa", "es")]
    return language.train([(x[i : i + 40], lang) for x, lang in stretches for i in range(0, 50, 3)])


def test_forward_equals_brute_force(trained):
    texts = [b"red blue", b"blue red", b"", "é漢🙂 haus".encode(), b"x", b"the sea " * 60, bytes(range(256)), b"z" * 512]
    got = trained.sums(texts)
    for text, row in zip(texts, got, strict=True):
        assert row == pytest.approx(brute(trained, text).sum(axis=0) if text else np.zeros(3), rel=1e-4, abs=1e-4)
    assert abs(got[0] - got[1]).max() > 1e-3  # words are read with their neighbours, so their order counts


def test_long_texts_in_segments(trained):
    rng = np.random.default_rng(3)
    for size in (513, 600, 960, 961, 992, 5000):
        text = bytes(rng.integers(97, 123, size).tolist())
        full = trained.sums([b"short", text, b""])[1]
        assert full.sum() == pytest.approx(size, rel=1e-5)  # every position once
        expected = np.zeros(3)
        for core in range(0, size, language.SEGMENT):
            begin = min(max(0, core - language.CONTEXT), size - 512)
            expected += brute(trained, text[begin : begin + 512])[core - begin : min(core + language.SEGMENT, size) - begin].sum(axis=0)
        assert full == pytest.approx(expected, rel=1e-4)


def test_pooled_scores_are_means(trained):
    texts = ["The RED house", "Das rote Haus", None, "7 ½"]
    langs, scores = language.predict_texts(texts, trained)
    for text, lang, score in zip(texts[:2], langs, scores, strict=False):
        mean = brute(trained, text.lower().encode()).mean(axis=0)
        assert lang == trained.languages[int(mean.argmax())] and score == pytest.approx(mean.max(), rel=1e-4)
    assert langs[2:] == ["und", "und"] and scores[2:] == [0.0, 0.0]


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the and of", "en", "a", 0.5), (1, "the and of", "en", "a", 0.5), (2, "der die das", "de", "b", 0.1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.fit(docs)
    assert sorted((r.doc_id or 0) for r in language.predict(docs, model).collect()) == [0, 1, 1, 2]
    kept = language.keep_known(docs, model, 0.0)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:3])

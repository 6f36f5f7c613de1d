"""Operator 11 against brute force; the filter's bounds; SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from dupescope.llm import negatives


def brute(rows):
    good = []
    for vec_id, v, label in rows:
        if vec_id is None or not v or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v)))
    sizes = [len(v) for _, _, v in good]
    length = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    good = [r for r in good if len(r[2]) == length]
    out = []
    for a, label, v in {r for r in good if r[0] % 100 == 0}:
        scored = [(-sum(map(lambda x, y: x * y, v, w)), i, k) for i, k, w in good if i != a or k != label]
        positives = sorted((s, i) for s, i, k in scored if k == label)[:5]
        for p, i in positives:
            inside = sorted((s, j) for s, j, k in scored if k != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def corpus(seed, n=900, d=10):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(d)] for _ in range(6)]
    f32 = lambda x: float(np.float32(x))
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [f32(x + rng.gauss(0, 0.2)) for x in c], rng.randrange(10)))
    hot = [f32(x) for x in centres[0]]
    rows += [(n + i, hot, rng.randrange(3)) for i in range(200)]  # a third of the rows are one vector
    rows += [(None, hot, 1), (2000, None, 1), (2001, hot, None), (2002, hot[:-1] + [None], 1), (2003, hot[:-1] + [float("nan")], 1), (2004, hot[:-1] + [float("inf")], 1), (2100, hot[:3], 1)]
    rows += [(100, hot, 4), rows[300], rows[300], (200, [0.0] * d, 3), (3000, [0.0] * d, 1), (3001, [0.0] * d, 2)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, label int, codes int, key string").repartition(3)


def collect(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, seed, monkeypatch):
    if seed:  # several parts and blocks; these are used on the driver
        monkeypatch.setattr(negatives, "ROWS", 150)
        monkeypatch.setattr(negatives, "ANCHORS", 4)
        monkeypatch.setattr(negatives, "SAMPLE", 60)
    rows = corpus(seed)
    got, expected = collect(negatives.hard_negatives(frame(spark, rows))), brute(rows)
    assert len(expected) > 100 and got == expected


def test_few_rows_negative_scores_and_one_label(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.5], 2), (100, [0.5, 0.5], 2), (2, [0.5, 0.25], 2), (3, [0.45, 1.0], 5)]
    assert collect(negatives.hard_negatives(frame(spark, rows))) == brute(rows) != []
    same = [(i, [0.1 * i, 1.0], 3) for i in range(1, 7)] + [(100, [1.0, 1.0], 3)]
    assert collect(negatives.hard_negatives(frame(spark, same))) == brute(same)


def test_nothing_usable_and_empty(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], None)], [(0, [], 1), (100, [], 2), (1, [], 2)]):
        assert collect(negatives.hard_negatives(frame(spark, rows))) == brute(rows) == []


def test_large_components_take_no_part(spark):
    rows = [(0, [1e30, 1.0], 1), (100, [3.0, 1.0], 1), (1, [2.0, 1.0], 1), (2, [2.0, 0.5], 2), (3, [1.9, 0.9], 3)]
    assert collect(negatives.hard_negatives(frame(spark, rows))) == brute(rows[1:]) != []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.13, (3000, 64))).astype(np.int32)
    books = negatives.fit(x[:1000].astype(float))
    codes, left = negatives.encode(x.astype(float), books)
    part = negatives.Part.__new__(negatives.Part)
    part.ids, part.labels, part.vectors, part.codes, part.left = np.arange(3000), np.zeros(3000, int), x, codes, left
    anchors = x[::300]
    low, high = part.bounds(np.arange(3000), anchors, books)
    true = x.astype(np.int64) @ anchors.T.astype(np.int64)
    assert (low <= true).all() and (true <= high).all()
    assert ((high - low) / np.abs(true).std() < 4).mean() > 0.9
    least = np.partition(low, 2995, axis=0)[2995]
    assert (high >= least).mean() < 0.15  # most rows need no exact score, even of vectors without any structure


def test_equals_sql(spark, tmp_path):
    frame(spark, corpus(9, 300)).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = con.execute(negatives.OP11_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, negatives.op11_hard_negatives(spark, str(tmp_path)).select(names).collect())) == sorted(cur.fetchall())

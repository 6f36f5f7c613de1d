"""Helpers: shared folders, tables that go, filters, batches."""

import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from dupescope.llm import common
from pyspark.sql import functions as F


def session(master, folder):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert common.shared_dir(session("spark://host:7077", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert common.shared_dir(session("local[4]", None), "x").startswith("/tmp/")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master, None), "x")


def test_workspace(spark):
    tables = common.Workspace(spark, "test")
    a, b = tables.write(spark.range(5), "a"), tables.write(spark.range(7), "a")
    assert (a.count(), b.count(), len(os.listdir(tables.path))) == (5, 7, 2)
    tables.drop(a)
    assert len(os.listdir(tables.path)) == 1 and b.count() == 7


def test_filter_lets_all_its_keys_through(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    monkeypatch.setattr(common, "MOST_FILTER_BITS", 1 << 16)
    for n in (0, 10, 500, 20_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("h"))
        bits = common.filter_of(keys)
        x = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
        assert common.in_filter(bits, x).all() and 1 << 10 <= 64 * len(bits) <= 1 << 16
        other = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
        assert n == 20_000 or common.in_filter(bits, other).mean() < 0.05


@pytest.mark.parametrize("limit", [1, 10, 100, 10_000])
def test_pieces_hold_all_rows_in_order(limit):
    texts = ["x" * n for n in (0, 5, 50, 500, 3, 0, 7)] + [None, "é"]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 4], pa.string())}) for i in range(0, len(texts), 4)]
    for cut in (common.slices, common.gathered):
        pieces = list(cut(iter(batches), "text", limit))
        assert [t for p in pieces for t in p.column("text").to_pylist()] == texts and all(p.num_rows for p in pieces)

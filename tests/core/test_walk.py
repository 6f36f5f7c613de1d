"""The walk in rounds, hashing dealt by bytes, counters while a scan runs."""

import os
import random
import time
from collections import Counter

from dupescope.operators import hashing
from dupescope.plans.engine import Engine
from dupescope.schema import EngineConfig
from dupescope.sources import fswalk
from pyspark.sql import functions as F


def lopsided(base, n=400):
    """A tree of which nearly everything lies below one folder, some of it deep."""
    deep = base / "one"
    for i in range(n):
        at = deep / f"d{i % 20}" / f"e{i % 7}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{i}").write_bytes(b"x" * (i % 50))
    for i in range(8):
        (base / f"small{i}").mkdir()
        (base / f"small{i}" / "f").write_text("y")
    (deep / "link").symlink_to(deep)
    return base


def test_rounds_equal_a_plain_walk(spark, tmp_path, monkeypatch):
    base = lopsided(tmp_path / "tree")
    expected = {os.path.relpath(os.path.join(d, f), base) for d, _, names in os.walk(base) for f in names}
    for entries in (1, 30, 10_000):
        monkeypatch.setattr(fswalk, "FIRST_ENTRIES", entries)
        found = fswalk.walk(spark, [(1, str(base))], str(tmp_path / f"w{entries}"), 8)
        rows = found.collect()
        assert {r.rel_path for r in rows if not r.skipped} == expected and [r.rel_path for r in rows if r.skipped] == ["one/link"]
        assert all(r.root_id == 1 and r.abs_path == f"{base}/{r.rel_path}" for r in rows)
    source = spark.read.format("fswalk").option("roots", f'[[1, "{base}"]]').load()
    assert sorted(map(tuple, source.collect())) == sorted(map(tuple, rows))


def test_one_large_folder_keeps_all_tasks_busy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fswalk, "FIRST_ENTRIES", 20)
    monkeypatch.setattr(fswalk, "MOST_ENTRIES", 20)
    base = lopsided(tmp_path / "tree")
    fswalk.walk(spark, [(1, str(base))], str(tmp_path / "w"), 8)
    by_round = Counter()
    for part in (tmp_path / "w").glob("round=*/part-*.parquet"):
        rows = spark.read.parquet(str(part)).where("NOT deeper AND rel_path LIKE 'one/%'").count()
        by_round[part.parent.name] += rows > 0
    assert max(by_round.values()) == 8  # tasks of a round that met files of the large folder


def test_roots_that_cannot_be_listed_and_several_roots(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "b" / "c" / "f").write_text("1")
    found = fswalk.walk(spark, [(1, str(tmp_path / "a")), (2, str(tmp_path / "b"))], str(tmp_path / "w"))
    assert [(r.root_id, r.rel_path, r.size) for r in found.collect()] == [(2, "c/f", 1)]
    batch = spark.createDataFrame([(1, "/none", "/none/x")], "root_id long, root string, path string").toArrow().to_batches()
    (out,) = fswalk.list_batches(iter(batch), 10, None)
    assert [(r["rel_path"], r["mode"], r["deeper"]) for r in out.to_pylist()] == [("x", None, False)]


def test_bytes_are_dealt_out_evenly(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 10, 1000, 50_000]) for i in range(3000)} | {5000: 10**18, 5001: 3}
    files = spark.createDataFrame(list(sizes.items()), "id long, size long")
    got = {r.id: r.task for r in hashing.deal_by_bytes(files, 7).collect()}
    assert set(got) == set(sizes) and set(got.values()) <= set(range(7))
    del sizes[5000]
    got = {r.id: r.task for r in hashing.deal_by_bytes(files.where("id <> 5000"), 7).collect()}
    load = Counter()
    for i, task in got.items():
        load[task] += sizes[i]
    assert max(load.values()) <= sum(sizes.values()) / 7 + max(sizes.values()) and len(load) == 7
    assert {r.task for r in hashing.deal_by_bytes(files.where("size = 0"), 3).collect()} == {0, 1, 2}
    assert hashing.deal_by_bytes(files.where("false"), 3).count() == 0


def test_files_go_where_they_are_dealt(spark, tmp_path):
    rows = []
    for i in range(40):
        at = tmp_path / f"f{i}"
        at.write_bytes(b"z" * (1 + i * 100))
        rows.append((i, str(at), at.stat().st_size))
    files = spark.createDataFrame(rows, "id long, abs_path string, size long")
    found = hashing.hash_files(files, hashing.whole_stage(1 << 16), 5).withColumn("at", F.spark_partition_id())
    expected = {r.id: r.task for r in hashing.deal_by_bytes(files, 5).collect()}
    assert {r.id: r["at"] for r in found.collect()} == expected


def test_counters_move_while_a_scan_runs(spark, tmp_path, monkeypatch):
    base = lopsided(tmp_path / "tree", 160)
    monkeypatch.setattr(fswalk, "FIRST_ENTRIES", 4)
    monkeypatch.setattr(fswalk, "MOST_ENTRIES", 4)

    def slowly(path, size, chunk):
        time.sleep(0.15)
        return "same"

    e = Engine(spark, str(tmp_path / "home"), EngineConfig(walk_partitions=2, hash_task_bytes=200, tick_seconds=1))
    stage = hashing.HashStage("full_hash", lambda path, size: slowly(path, size, 0), lambda size: size)
    monkeypatch.setattr(hashing, "whole_stage", lambda chunk: stage)
    e.add_root(str(base))
    e.scan()
    ticks = [r for r in e.events(1).collect() if r.type == "progress"]
    last = e.history(1).first()
    assert last.files_seen == 168 and any(0 < r.files_seen < last.files_seen and r.phase == "walking" for r in ticks)
    reading = [r.bytes_hashed for r in ticks if r.phase == "hashing"]
    assert any(0 < n < last.bytes_hashed for n in reading)
    assert any(r.current_path.startswith(str(base)) and r.phase == "hashing" for r in ticks)

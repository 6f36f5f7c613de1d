"""End to end on directories: scan, incremental rescan, group recheck, lifecycle."""

import os
import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from dupescope.plans import lifecycle
from dupescope.plans.engine import Engine
from dupescope.plans.store import Busy, Store
from dupescope.schema import EngineConfig
from dupescope.sources.fswalk import RootMissing
from pyspark.sql import functions as F

CONTENT = {
    "logs/app.log": "A" * 108, "logs/old/archived.log": "A" * 108, "logs/old/2024/backup.txt": "A" * 108,
    "docs/readme.txt": "B" * 54, "docs/archive/readme-copy.txt": "B" * 54, "docs/archive/deep/readme.bak": "B" * 54,
    "photos/vacation.jpg": "C" * 88, "photos/vacation-original.jpeg": "C" * 88, "photos/2024/trip.png": "D" * 64, "photos/2024/backup/trip-copy.png": "D" * 64,
    "data/nested/deep/config.yaml": "E" * 50, "data/nested/deep/config.yml": "E" * 50, "data/export.csv": "F" * 49, "data/export_backup.csv": "F" * 49,
    "data/nested/summary.txt": "G" * 74, "docs/archive/old-notes.md": "H" * 74, "photos/2024/banner.gif": "I" * 74,
    "logs/unique-error.err": "J" * 70, "misc/unique_only/onlyone.dat": "K" * 63, "docs/settings.ini": "L" * 29,
}


def put(base, tree):
    for name, text in tree.items():
        at = base / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


@pytest.fixture
def tree(tmp_path):
    put(tmp_path / "tree", CONTENT)
    return tmp_path


def engine(spark, tree, **config):
    found = Engine(spark, str(tree / "home"), EngineConfig(**config))
    found.add_root(f" {tree / 'tree'} ", "")
    return found


@pytest.mark.parametrize("reuse,second", [(True, 0), (False, 222)])
def test_fixture_tree(spark, tree, reuse, second):
    e = engine(spark, tree, reuse_partial=reuse)
    e.scan()
    assert e.summary() == {"total_files": 20, "total_bytes": 1372, "duplicate_groups": 6, "reclaimable_bytes": 575}
    last = e.history(1).first()
    assert (last.status, last.phase, last.files_seen, last.files_new, last.files_skipped, last.bytes_hashed) == ("completed", "finalizing", 20, 20, 0, 2198)
    assert [r.reclaimable_bytes for r in e.duplicates().collect()] == [216, 108, 88, 64, 50, 49]
    assert [r.size for r in e.duplicates(page=2, page_size=4).collect()] == [50, 49]
    assert e.duplicate_pages(page_size=4).first().pages == 2
    before = {r.id: (r.last_seen_scan_id, r.updated_at) for r in e.files().collect()}
    e.scan()
    assert e.history(1).first().bytes_hashed == second
    assert {r.id: (r.last_seen_scan_id, r.updated_at) for r in e.files().collect()} == before
    kinds = [r.type for r in e.events(2).orderBy("elapsed_ms").collect()]
    assert kinds[0] == "scan_started" and kinds[-1] == "scan_completed"


def test_group_recheck(spark, tmp_path):
    put(tmp_path / "tree", dict.fromkeys("abcd", "same content"))
    e = engine(spark, tmp_path)
    e.scan()
    g = e.duplicates().first()
    assert g.member_count == 4
    assert e.rescan(g.size, g.full_hash) == {"exists": True, "checked": 4, "missing": 0, "changed": 0, "errors": 0, "unchanged": 4}
    at = tmp_path / "tree"
    (at / "a").unlink()
    (at / "b").write_text("other content, other size")
    (at / "c").unlink()
    os.link(at / "d", at / "c")
    got = e.rescan(g.size, g.full_hash)
    assert (got["exists"], got["missing"], got["changed"]) == (True, 1, 2)
    new = e.duplicates().first()
    assert (new.member_count, new.distinct_instance_count, new.reclaimable_bytes) == (2, 1, 0)
    assert [r.shares_inode for r in e.detail(g.size, g.full_hash).collect()] == [True, True]
    # a changed file has a full hash but no sampled one; a later twin is still found
    put(at, {"twin": "other content, other size"})
    e.scan()
    assert {r.size for r in e.duplicates().collect()} == {12, 25}
    (at / "c").unlink()
    assert e.rescan(g.size, g.full_hash)["exists"] is False
    assert e.rescan(g.size, g.full_hash)["checked"] == 0


def test_recheck_sets_updated_at(spark, tmp_path):
    put(tmp_path / "tree", dict.fromkeys("abcd", "same content") | {"other": "x"})
    e = engine(spark, tmp_path)
    e.scan()
    before = {r.rel_path: r.updated_at for r in e.files().collect()}
    (tmp_path / "tree" / "a").unlink()
    (tmp_path / "tree" / "b").write_text("new")
    g = e.duplicates().first()
    published = e.store.versions()
    e.rescan(g.size, g.full_hash)
    after = {r.rel_path: (r.updated_at, r.status) for r in e.files().collect()}
    assert after["a"][0] == after["b"][0] > before["a"] and after["a"][1] == "missing"
    assert all(after[k] == (before[k], "present") for k in ("c", "d", "other"))
    changed = {k for k, v in e.store.versions().items() if published.get(k) != v}
    assert {k.partition("/")[0] for k in changed} == {"files", "groups", "instances"} and "files/1" in changed and len(changed) <= 5


def test_root_added_during_a_scan_stays(spark, tmp_path, monkeypatch):
    put(tmp_path / "tree", {"a": "1", "b": "1"})
    put(tmp_path / "late", {"c": "1"})
    e = engine(spark, tmp_path)
    walk = Engine._walk

    def meanwhile(self, scan_id, root_id, path):
        e.add_root(str(tmp_path / "late"))
        e.toggle_root(1, False)
        return walk(self, scan_id, root_id, path)

    monkeypatch.setattr(Engine, "_walk", meanwhile)
    e.scan()
    monkeypatch.undo()
    assert {r.path: r.enabled for r in e.roots().collect()} == {str(tmp_path / "tree"): False, str(tmp_path / "late"): True}
    assert e.files().count() == 2
    e.scan()  # the late root only; the other one's files keep their version
    assert e.files().count() == 3 and e.duplicates().first().member_count == 3


def test_writers_at_the_same_time(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda k: e.add_root(f"/data/{k}"), range(6)))
    assert sorted(ids) == [1, 2, 3, 4, 5, 6] and {r.path for r in e.roots().collect()} == {f"/data/{k}" for k in range(6)}


def test_publishing_is_refused_where_another_writer_was_faster(spark, tmp_path):
    store = Store(spark, str(tmp_path / "home"))
    store.write(a=spark.range(1), b=spark.range(1))
    seen = []

    def build(base):
        seen.append(base["a"])
        if len(seen) == 1:
            store.write(a=spark.range(5))
        return {"a": store.read("a", spark.range(0).schema, base).union(spark.range(2))}

    store.update(build)
    assert len(set(seen)) == 2 and store.read("a", spark.range(0).schema).count() == 7

    def only_b(base):
        store.write(a=spark.range(3))
        return {"b": spark.range(9)}

    store.update(only_b)  # another table's change is no conflict, and isn't lost
    assert (store.read("a", spark.range(0).schema).count(), store.read("b", spark.range(0).schema).count()) == (3, 9)


def test_columns_that_an_older_version_lacks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "home"))
    store.write(roots=spark.createDataFrame([(1, "/x", "x", True)], "id long, path string, label string, enabled boolean"))
    e = Engine(spark, str(tmp_path / "home"))
    assert [(r.path, r.source, r.added_at) for r in e.roots().collect()] == [("/x", "manual", None)]
    e.add_root("/y")
    assert {r.path: r.source for r in e.roots().collect()} == {"/x": "manual", "/y": "manual"}


def test_events_and_subscribers(spark, tmp_path):
    put(tmp_path / "tree", {"a": "1", "b": "1"})
    e = engine(spark, tmp_path)
    e.scan()
    told = []
    assert e.subscribe(1, lambda batch, _: told.extend(batch.collect()), str(tmp_path / "c1")) is None
    assert [(r.type, r.scan_id, r.files_seen) for r in told] == [("scan_completed", 1, 2)]
    ticks = [r for r in e.events(1).collect() if r.type == "progress" and r.current_path == str(tmp_path / "tree")]
    assert ticks  # a walk of a Spark job takes over a second
    # a process that ended during a scan: the next start tells its subscribers
    e._change("scans", lambda scans: scans.unionByName(lifecycle.started(spark, 2, [1], F.current_timestamp())))
    live = []
    query = e.subscribe(2, lambda batch, _: live.extend(r.type for r in batch.collect()), str(tmp_path / "c2"), "200 milliseconds")
    e.recover()
    query.awaitTermination(60)
    assert live == ["scan_failed"] and e.history(1).first().status == "interrupted"
    assert e.subscribe(2, lambda batch, _: live.extend(r.type for r in batch.collect()), str(tmp_path / "c3")) is None and live == ["scan_failed"] * 2
    assert [r.type for r in e.events(2).collect()] == ["scan_failed"]


def test_walk_rules(spark, tmp_path):
    at = tmp_path / "tree"
    put(at, {".hidden": "x", "_under": "x", "sub/empty": "", "sub/é%_\\A": "y"})
    (at / "link").symlink_to(at / "_under")
    (at / "dirlink").symlink_to(at / "sub")
    os.mkfifo(at / "pipe")
    e = engine(spark, tmp_path, walk_partitions=3)
    e.scan()
    last = e.history(1).first()
    assert (last.files_seen, last.files_skipped) == (4, 3)
    assert {r.rel_path for r in e.files().collect()} == {".hidden", "_under", "sub/empty", "sub/é%_\\A"}
    assert [r.member_count for r in e.duplicates().collect()] == [2]


def test_sampling_boundary(spark, tmp_path):
    n = 3 * 65536
    body = bytearray(random.Random(1).randbytes(n + 1))
    other, middle = bytearray(body), bytearray(body)
    other[131072] ^= 1  # the one byte outside the samples
    middle[(n + 1) // 2] ^= 1
    (tmp_path / "tree").mkdir()
    for name, data in {"a": body, "b": body, "c": other, "d": middle, "e": body[:n], "f": body[:n]}.items():
        (tmp_path / "tree" / name).write_bytes(data)
    e = engine(spark, tmp_path)
    e.scan()
    assert sorted((r.size, r.member_count) for r in e.duplicates().collect()) == [(n, 2), (n + 1, 2)]
    assert e.history(1).first().bytes_hashed == 4 * n + 2 * n + 3 * (n + 1) + 2 * n


def test_changes_and_lifecycle(spark, tmp_path):
    at = tmp_path / "tree"
    put(at, {"a": "1111", "b": "1111", "c": "1111", "d": "zz"})
    e = engine(spark, tmp_path)
    with pytest.raises(ValueError):
        e.add_root("  ")
    with pytest.raises(ValueError):
        e.add_root(str(at))
    e.scan()
    (at / "a").unlink()
    (at / "b").write_text("22222")
    e.scan()
    last = e.history(1).first()
    assert (last.files_new, last.files_changed, last.files_removed) == (0, 1, 1)
    e.scan()
    assert e.history(1).first().files_removed == 0
    put(tmp_path / "base", {"one/x": "1111", "two/y": "q"})
    assert len(e.discover_roots(str(tmp_path / "base"))) == 2 and e.discover_roots(str(tmp_path / "base")) == [] and e.discover_roots("/nowhere") == []
    e.scan()
    assert [r.member_count for r in e.duplicates().collect()] == [2]
    assert e.duplicate_pages(root_id=1, name_like="C").first().total == 1 and e.duplicate_pages(root_id=1, name_like="x").first().total == 0
    e.toggle_root(2)
    e.toggle_root(3, False)
    e.scan()
    assert e.history(1).first().root_ids == [1]
    assert e.duplicates().count() == 1  # disabled roots still take part
    e.delete_root(2)
    assert e.duplicates().count() == 0 and e.files().where("root_id = 2").count() == 0
    e.toggle_root(1, False)
    with pytest.raises(ValueError):
        e.scan()
    gone = e.add_root(str(tmp_path / "absent"))
    with pytest.raises(RootMissing):
        e.scan(gone)
    assert e.history(1).first().status == "failed" and not e.store.locked()
    e.store.lock()
    with pytest.raises(Busy):
        e.scan(gone)
    with pytest.raises(Busy):
        e.rescan(4, "no such group")
    with pytest.raises(Busy):
        e.delete_root(1)
    e.recover()
    e.store.vacuum()
    assert e.files().count() == 5 and e.root_of(1).first().enabled is False and e.root_of(99).count() == 0
    assert e.scan_of(4).first().status == "completed" and [r.root_id for r in e.scan_roots(5).collect()] == [1]


def test_random_changes_equal_fresh_scan(spark, tmp_path):
    rng = random.Random(4)
    at = tmp_path / "tree"
    put(at, {f"d{i % 3}/f{i}": rng.choice("abc") * rng.randint(0, 4) for i in range(30)})
    e = engine(spark, tmp_path)
    for _ in range(2):
        e.scan()
        for p in sorted(at.rglob("f*")):
            if rng.random() < 0.2:
                p.unlink()
            elif rng.random() < 0.3:
                p.write_text(rng.choice("abc") * rng.randint(0, 4))
                os.utime(p, ns=(rng.randint(1, 10**18), rng.randint(1, 10**18)))
    e.scan()
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.add_root(str(at))
    fresh.scan()
    assert sorted(e.duplicates().collect()) == sorted(fresh.duplicates().collect())


def test_a_finished_scan_is_one_file_of_events_and_a_hub_serves_late_subscribers(spark, tmp_path):
    put(tmp_path / "tree", {"a": "1", "b": "1"})
    e = engine(spark, tmp_path)
    e.scan()
    told = sorted((r.type, r.elapsed_ms, r.files_seen) for r in e.events(1).collect())
    e.roll_up_events(0)
    assert not list((tmp_path / "home" / "events").rglob("*.json")) and len(list((tmp_path / "home").rglob("part-*.json"))) == 1
    assert sorted((r.type, r.elapsed_ms, r.files_seen) for r in e.events(1).collect()) == told
    hub, late = e.hub(str(tmp_path / "c"), "100 milliseconds"), []
    try:
        hub.subscribe(1, lambda batch, _: late.extend((r.type, r.files_seen) for r in batch.collect()))
        end = time.time() + 60
        while not late and time.time() < end:
            time.sleep(0.1)
    finally:
        hub.stop()
    assert late == [("scan_completed", 2)]
    e.scan()  # a log whose earlier scans are rolled up goes on
    assert [r.type for r in e.events(2).orderBy("elapsed_ms").collect()][-1] == "scan_completed"

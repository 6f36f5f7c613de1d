"""The store: changes beside a base, folding, commits of several writers, the lock."""

import json
import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from dupescope.operators import deltas, regroup
from dupescope.operators.groups import duplicate_groups
from dupescope.plans import store as stores
from dupescope.plans.engine import Engine
from dupescope.plans.store import Busy, Changes, Conflict, Parts, Store
from dupescope.schema import FILES, GROUPS
from pyspark.sql import functions as F


def listed(path):
    return [p for p in path.rglob("*.parquet")]


def put(base, tree):
    for name, text in tree.items():
        at = base / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_due():
    assert deltas.due([1000]) is None and deltas.due([1000, 10]) is None and deltas.due([1000, 200, 60]) == 0
    assert deltas.due([1000, 100, 30]) == 1 and deltas.due([1000, 240]) is None and deltas.due([1000, 250]) == 0 and deltas.due([1000, 250], least=251) is None
    assert deltas.due([10**9, *(5**k for k in range(9, 0, -1))]) == 1  # too many
    # a row is rewritten a logarithmic number of times
    sizes, written = [100_000], 0
    for _ in range(3000):
        sizes.append(10)
        if (at := deltas.due(sizes)) is not None:
            written += sum(sizes[at:])
            sizes[at:] = [sum(sizes[at:])]
    assert len(sizes) <= 10 and written < 20 * 100_000


@pytest.mark.parametrize("seed", range(1))
def test_merge_on_read_equals_a_dictionary(spark, tmp_path, seed):
    """Random upserts and deletions of groups by key, and additions to instances, with folds in between."""
    rng = random.Random(seed)
    store = Store(spark, str(tmp_path / "home"))
    groups, counts = {}, {}
    instance = stores.MERGES["instances"]
    for k in range(6):
        rows = {(rng.randrange(9), rng.choice("abc")): rng.choice([0, 2, 3]) for _ in range(8)}
        groups |= rows
        moved = {}
        for _ in range(8):
            key = (rng.randrange(5), "h", 1, rng.randrange(3))
            moved[key] = moved.get(key, 0) + rng.choice([-1, 1, 1])
        for key, n in moved.items():
            counts[key] = counts.get(key, 0) + n
        part = regroup.part_of(F.col("size"))
        frame = spark.createDataFrame([(s, h, n, n, n * k) for (s, h), n in rows.items()], GROUPS).withColumn("part", part)
        added = spark.createDataFrame([(*key, n) for key, n in moved.items() if n], "size long, full_hash string, device long, inode long, paths long").withColumn("part", part)
        store.update(lambda base, frame=frame, added=added: {"groups": Changes(frame, "part"), "instances": Changes(added, "part", "pending")})
        if k == 3:
            assert store.fold("groups", GROUPS, least=0) and not store.fold("instances", added.drop("part").schema)
        got = {(r.size, r.full_hash): r.member_count for r in store.read("groups", GROUPS).collect()}
        assert got == {key: n for key, n in groups.items() if n >= 2}
        held = store.read("instances", added.drop("part").schema)
        assert {tuple(r)[:4]: r.paths for r in held.collect()} == {key: n for key, n in counts.items() if n}
    assert len(stores.folders(store.versions()["pending"])) == 6
    assert store.fold("instances", added.drop("part").schema, least=0)
    assert {tuple(r)[:4]: r.paths for r in store.read("instances", added.drop("part").schema).collect()} == {key: n for key, n in counts.items() if n}
    assert instance.keys == tuple(regroup.INSTANCE)
    some = sorted({int(k.partition("/")[2]) for k in store.versions() if k.startswith("groups/")})[:1]
    assert {r.p for r in store.read("groups", GROUPS, parts=some).select(regroup.part_of(F.col("size")).alias("p")).collect()} <= set(some)


def test_what_is_written_follows_what_changes(spark, tmp_path):
    at = tmp_path / "tree"
    put(at, {f"d{i % 7}/f{i}": "xy" * (i % 40) for i in range(600)})
    e = Engine(spark, str(tmp_path / "home"))
    e.add_root(str(at))
    e.scan()
    before = e.store.versions()
    (at / "d1/f1").write_text("a new content")
    (at / "d2/f2").unlink()
    e.scan()
    now = e.store.versions()
    old, new = stores.folders(before["files/1"]), stores.folders(now["files/1"])
    assert new[: len(old)] == old and len(new) > len(old)
    changes = new[len(old) :]
    assert sum(spark.read.parquet(f"{e.store.home}/{c}").count() for c in changes) <= 4  # the walk's two rows, and hashes of the new content
    untouched = [k for k in before if k.startswith("groups/") and before[k] == now[k]]
    assert len(untouched) >= len([k for k in before if k.startswith("groups/")]) - 4
    marks = e.store.versions()
    e.scan()  # nothing has changed: nothing but the scan's own row is written
    assert {k for k, v in e.store.versions().items() if marks[k] != v} == {"scans"}
    left = [p.name for p in (tmp_path / "home" / "temporary").iterdir()] if (tmp_path / "home" / "temporary").exists() else []
    assert left == [] and not (tmp_path / "home" / "walk").exists()


def test_groups_equal_a_rebuild_after_random_changes(spark, tmp_path):
    rng = random.Random(8)
    at = tmp_path / "tree"
    put(at, {f"f{i}": rng.choice("ab") * rng.randint(0, 3) for i in range(25)})
    put(tmp_path / "other", {f"g{i}": rng.choice("ab") * rng.randint(0, 3) for i in range(6)})
    e = Engine(spark, str(tmp_path / "home"))
    e.add_root(str(at))
    second = e.add_root(str(tmp_path / "other"))
    for turn in range(3):
        e.scan()
        if turn == 1:
            e.delete_root(second)
        expected = sorted(map(tuple, duplicate_groups(e.files()).select(GROUPS.names).collect()))
        assert sorted(map(tuple, e.groups().select(GROUPS.names).collect())) == expected
        for p in sorted(at.iterdir()):
            if rng.random() < 0.25:
                p.unlink()
            elif rng.random() < 0.3:
                p.write_text(rng.choice("ab") * rng.randint(0, 3))
        put(at, {f"new{turn}": "aa"})
    kept = sorted(map(tuple, e.groups().collect()))
    e.rebuild_groups()
    assert sorted(map(tuple, e.groups().collect())) == kept and e.files().count() == len({r.id for r in e.files().collect()})
    e.store.vacuum(1)
    assert sorted(map(tuple, e.groups().collect())) == kept


def test_a_store_of_before_gets_its_instances(spark, tmp_path):
    """Files in one folder a root, groups as one table, a pointer without changes."""
    put(tmp_path / "tree", {"a": "1", "b": "1", "c": "22"})
    e = Engine(spark, str(tmp_path / "home"))
    e.add_root(str(tmp_path / "tree"))
    e.scan()
    files = spark.createDataFrame(e.files().collect(), FILES)
    old = spark.createDataFrame([(9, "x", 2, 2, 9)], GROUPS)
    e.store.update(lambda base: {"files": Parts(files, "root_id", [1]), "groups": old, **{k: None for k in base if k.startswith("instances/") or k == "pending"}})
    assert not any(k.startswith("groups/") for k in e.store.versions())
    (tmp_path / "tree" / "d").write_text("22")
    e.scan()
    assert sorted((r.size, r.member_count) for r in e.groups().collect()) == [(1, 2), (2, 2)]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "home"))
    store.update(lambda base: {"n": spark.range(1)})

    def add(k):
        other = Store(spark, str(tmp_path / "home"))
        other.update(lambda base: {"n": other.read("n", spark.range(0).schema, base).union(spark.range(k, k + 1))}, tries=50)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(100, 108)))
    assert sorted(r.id for r in store.read("n", spark.range(0).schema).collect()) == [0, *range(100, 108)]


def test_an_unfinished_commit_is_passed_over_and_its_writer_starts_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "COMMIT_SECONDS", 0.3)
    home = str(tmp_path / "home")
    slow, fast, third = (Store(spark, home) for _ in range(3))
    slow.update(lambda base: {"n": spark.range(1)})
    finish, calls = slow._finish, []

    def hangs(number, after, versions):
        if not calls:
            calls.append(number)
            # two others wait for this commit, pass over it, and lose nothing of each other
            with ThreadPoolExecutor(2) as pool:
                list(pool.map(lambda s: s[0].update(lambda base: {s[1]: spark.range(3)}), ((fast, "a"), (third, "b"))))
        finish(number, after, versions)

    monkeypatch.setattr(slow, "_finish", hangs)
    seen = []
    slow.update(lambda base: seen.append(sorted(base)) or {"n": slow.read("n", spark.range(0).schema, base).union(spark.range(5, 6))})
    assert seen == [["n"], ["a", "b", "n"]]  # it was told, and started again from what the others wrote
    assert sorted(slow.versions()) == ["a", "b", "n"] and slow.read("n", spark.range(0).schema).count() == 2
    # a writer that died in the middle: the number stays unfinished for ever
    assert slow._claim(f"commits/{slow._numbers('commits')[0] + 1}")
    fast.update(lambda base: {"c": spark.range(1)})
    assert sorted(third.versions()) == ["a", "b", "c", "n"]


def test_conflicts_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "home"))
    store.update(lambda base: {"n": spark.range(1)})
    base = store.versions()
    store.update(lambda base: {"n": spark.range(2)})
    with pytest.raises(Conflict):
        store._publish(base, {"n": "n/none"})
    assert store.read("n", spark.range(0).schema).count() == 2


def test_lock_is_taken_over_only_when_it_is_not_renewed(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "home")
    first, second = Store(spark, home), Store(spark, home)
    first.lock()
    with pytest.raises(Busy):
        second.lock()
    monkeypatch.setattr(stores, "LOCK_SECONDS", 1.0)
    for _ in range(4):
        time.sleep(0.4)
        first.renew()
        with pytest.raises(Busy):
            second.lock()
    time.sleep(1.2)  # its holder hangs
    second.lock()
    assert second.fence == first.fence + 1
    first.renew()
    first.unlock()  # neither touches the lock of another
    assert second.locked()
    with pytest.raises(Busy):
        first.fence = second.fence - 1
        first.update(lambda base: {"n": spark.range(1)})  # what it publishes late is refused
    second.update(lambda base: {"n": spark.range(2)})
    second.unlock()
    first.fence = None
    first.lock()
    first.unlock()
    assert not second.locked() and json.loads(first._get(f"commits/{first._numbers('commits')[0]}"))["finished"]

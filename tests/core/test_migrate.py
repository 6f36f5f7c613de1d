"""Steps from one schema to another, and tables that were written with earlier ones."""

import datetime

import pytest
from dupescope.operators import migrate
from dupescope.plans import store as stores
from dupescope.plans.engine import Engine
from dupescope.plans.store import Store
from dupescope.schema import FILES
from pyspark.sql import types as T


def struct(text):
    return T.StructType.fromDDL(text) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(text)


def test_plan(spark):
    old, new = struct("a int, b string, gone string, d decimal(10,2)"), struct("c string, a bigint, d decimal(12,2), e boolean")
    steps = migrate.plan(old, new, {"e": True}, {"c": "b"})
    assert [(s.kind, s.column) for s in steps] == [("rename", "c"), ("widen", "a"), ("widen", "d"), ("add", "e"), ("leave", "gone")]
    rows = spark.sql("SELECT 7 AS a, 'x' AS b, 'y' AS gone, CAST(1.5 AS DECIMAL(10,2)) AS d")
    found = migrate.apply(rows, steps)
    assert [f.simpleString() for f in found.schema] == [f.simpleString() for f in new]
    assert [tuple(map(str, r)) for r in found.collect()] == [("x", "7", "1.50", "True")]
    assert [s.kind for s in migrate.plan(new, new)] == ["keep"] * 4 and migrate.same(new, new) and not migrate.same(old, new)


@pytest.mark.parametrize("old,new", [("a bigint", "a int"), ("a string", "a bigint"), ("a decimal(12,2)", "a decimal(12,3)"), ("a double", "a float"), ("a timestamp", "a date")])
def test_what_would_lose_values_is_refused(spark, old, new):
    with pytest.raises(migrate.Incompatible):
        migrate.plan(struct(old), struct(new))


def test_files_of_an_earlier_version(spark, tmp_path):
    """int sizes, no hashes, status or updated_at; written by hand, without a schema beside them."""
    (tmp_path / "tree").mkdir()
    for name, text in {"a": "11", "b": "11", "c": "3"}.items():
        (tmp_path / "tree" / name).write_text(text)
    e = Engine(spark, str(tmp_path / "home"))
    e.add_root(str(tmp_path / "tree"))
    old = spark.createDataFrame([(5, 1, "a", 2, 0, 1, 1), (6, 1, "lost", 9, 0, 1, 2)], "id int, root_id int, rel_path string, size int, mtime_ns long, device long, inode long")
    old.write.parquet(str(tmp_path / "home" / "files" / "v=1-old" / "part=1"))
    base = e.store.versions()
    e.store._publish(base, {"files/1": "files/v=1-old/part=1"})
    rows = {r.rel_path: r for r in e.files().collect()}
    assert rows["a"].size == 2 and rows["a"].full_hash == "" and rows["lost"].status == "present"
    assert rows["a"].updated_at == datetime.datetime(1970, 1, 1) and [f.dataType for f in e.files().schema] == [f.dataType for f in FILES]
    e.scan()
    last = e.history(1).first()
    assert (last.files_new, last.files_changed, last.files_removed) == (2, 1, 1)
    assert [r.member_count for r in e.duplicates().collect()] == [2] and {r.id for r in e.files().collect()} >= {5, 6}


def test_parts_of_several_versions_are_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(stores.RENAMED, "t", {"name": "title"})
    monkeypatch.setitem(stores.DEFAULTS, "t", {"n": 3})
    store = Store(spark, str(tmp_path / "home"))
    store.update(lambda base: {"t": stores.Parts(spark.sql("SELECT 1 AS k, 'a' AS title"), "k", [1])})
    store.update(lambda base: {"t": stores.Parts(spark.sql("SELECT 2 AS k, 'b' AS name, 9L AS n"), "k", [2])})
    found = store.read("t", struct("k bigint, name string, n bigint"))
    assert sorted(map(tuple, found.collect())) == [(1, "a", 3), (2, "b", 9)]
    assert "_schema.json" in {p.name for p in (tmp_path / "home").rglob("*.json")}


def test_a_key_is_looked_for_in_few_row_groups(spark, tmp_path):
    """Files are in order of size, and say by a Bloom filter which hashes they have; the filter reaches the scan."""
    store = Store(spark, str(tmp_path / "home"))
    rows = spark.range(3000).selectExpr("id % 2 AS root_id", "id", "(id * 7919) % 3000 AS size", "sha2(string(id), 256) AS full_hash")
    store.update(lambda base: {"files": stores.Parts(rows, "root_id", [0, 1])})
    schema = struct("id bigint, size bigint, full_hash string")
    (folder,) = {f for v in store.versions().values() for f in stores.folders(v) if f.startswith("files/") and f.endswith("part=0")}
    sizes = [r.size for r in spark.read.parquet(f"{store.home}/{folder}").collect()]
    assert sizes == sorted(sizes)
    one = store.read("files", schema).where("size = 42 AND full_hash = 'x'")
    assert "EqualTo(size,42)" in one._jdf.queryExecution().toString() and one.count() == 0

"""Scalar functions and operators on small cases."""

import pytest
from dupescope.functions import formatting, matching, versioning
from dupescope.operators import candidates, diff, groups
from dupescope.operators.browse import DuplicateFilter
from dupescope.plans import lifecycle
from dupescope.schema import EngineConfig
from pyspark.sql import functions as F


def values(spark, rows, kinds, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kinds).select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_versions(spark):
    cases = [
        ("v2026.09.15", "v2026.09.14", True), ("v2026.09.14.1", "v2026.09.14", True), ("v2026.09.14", "v2026.09.14", False), ("v2026.09.14", "v2026.09.14.1", False),
        ("v2026.10.01", "v2026.09.30.4", True), ("v2026.09.14", "dev", False), ("garbage", "v2026.09.14", False), ("1.0", "1", False), ("1. 5", "1", False), (None, "1", False), ("", "0", False),
    ]
    got = values(spark, [c[:2] for c in cases], "a string, b string", n=versioning.newer(F.col("a"), F.col("b")))
    assert [g for (g,) in got] == [c[2] for c in cases]


def test_durations(spark):
    cases = {0: "0s", 45: "45s", 192: "3m 12s", 3600: "1h 0m 0s", 7512: "2h 5m 12s", 174404: "2d 0h 26m 44s"}
    rows = [(s * 1000,) for s in cases] + [(499,), (500,), (-7,)]
    got = values(spark, rows, "ms long", t=formatting.format_duration_ms(F.col("ms")))
    assert [t for (t,) in got] == [*cases.values(), "0s", "1s", "0s"]


def test_bytes(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1048575: "1024.0 KB", 1048576: "1.0 MB", 1 << 60: "1.0 EB"}
    got = values(spark, [(n,) for n in cases], "n long", t=formatting.format_bytes(F.col("n")))
    assert [t for (t,) in got] == list(cases.values())


@pytest.mark.parametrize("pattern,hits", [("A", [0, 1]), ("%", [0, 1, 2, 3, 4]), ("_b", [0, 1]), ("é", [2]), ("É", [3]), ("\\", [4])])
def test_name_filter(spark, pattern, hits):
    names = ["ab", "AB", "é", "É", "x\\y"]
    got = values(spark, list(enumerate(names)), "i int, s string", i=F.col("i"), m=matching.contains_like(F.col("s"), pattern))
    assert [i for i, m in got if m] == hits


FILE = "id long, root_id long, rel_path string, size long, mtime_ns long, device long, inode long, partial_hash string, full_hash string, status string"


def file(i, size=4, inode=None, partial="", full="", status="present", root=1):
    return (i, root, f"f{i}", size, i, 1, inode or i, partial, full, status)


def test_candidates(spark):
    rows = [file(1), file(2, full="h", partial="p"), file(3, size=5), file(4, size=0), file(5, size=0), file(6, size=5, status="missing"), file(7, size=9, full="z"), file(8, size=9)]
    df = spark.createDataFrame(rows, FILE)
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(candidates.size_candidates(df)) == [1, 8]
    assert ids(candidates.half_hashed(df)) == [7]
    assert ids(candidates.size_singletons(df)) == [3]
    sampled = [file(1, partial="p"), file(2, full="h", partial="p"), file(3, partial="q"), file(4, size=6, partial="p")]
    assert ids(candidates.partial_candidates(spark.createDataFrame(sampled, FILE))) == [1]


def test_groups_and_hardlinks(spark):
    rows = [file(1, full="a"), file(2, full="a", inode=1), file(3, full="a"), file(4, full="b"), file(5, full="b", inode=4), file(6, full="c"), file(7, full="a", status="missing"), file(8, size=0, full="e"), file(9, size=0, full="e")]
    df = spark.createDataFrame(rows, FILE)
    found = groups.duplicate_groups(df)
    assert sorted(map(tuple, found.collect())) == [(4, "a", 3, 2, 4), (4, "b", 2, 1, 0)]
    assert {r.id for r in groups.with_shared_inode(groups.members(df, found)).where("shares_inode").collect()} == {1, 2, 4, 5}


def test_diff_classes(spark):
    known = spark.createDataFrame([file(i) for i in range(1, 5)] + [file(5, status="missing"), file(6, status="missing", full="h")], FILE).selectExpr("*", "1L AS last_seen_scan_id", "0 AS updated_at")
    walk = [(1, "f1", 4, 1, 1, 1, False), (1, "f2", 9, 2, 1, 2, False), (1, "f3", 4, 3, 1, 77, False), (1, "f6", 4, 6, 1, 6, False), (1, "new", 1, 1, 1, 1, False), (1, "pipe", None, None, None, None, True)]
    walked = spark.createDataFrame(walk, "root_id long, rel_path string, size long, mtime_ns long, device long, inode long, skipped boolean")
    got = diff.classify(known, walked)
    assert {r.rel_path: r.change_type for r in got.collect()} == {"f1": "unchanged", "f2": "changed", "f3": "changed", "f4": "missing", "f5": "gone", "f6": "reappeared", "new": "new"}
    assert tuple(diff.counters(got).first()) == (5, 1, 2, 1, 0)
    merged = {r.rel_path: r for r in diff.merged(got, 2, F.lit(9), 100).collect()}
    assert merged["f6"].full_hash == "h" and merged["f6"].status == "present" and merged["f6"].updated_at == 9
    assert merged["f1"].last_seen_scan_id == 1 and merged["f1"].updated_at == 0 and merged["new"].id >= 100 and merged["f4"].status == "missing" and merged["f5"].updated_at == 0


def test_filter_parameters():
    assert DuplicateFilter.parse(root_id="x", min_size="-3", page="0", page_size="abc") == DuplicateFilter()
    assert DuplicateFilter.parse(root_id="2", min_size="10", page="3", page_size="7", name_like="a").bounds == (14, 7)
    assert DuplicateFilter(page=-1, page_size=0).bounds == (0, 25)


def test_config():
    assert EngineConfig.from_env({"DUPESCOPE_SAMPLE_SIZE": "10", "DUPESCOPE_REUSE_PARTIAL": "false", "DUPESCOPE_PAGE_SIZE": "x"}) == EngineConfig(sample_size=10, reuse_partial=False)


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, "/a")], "id long, path string")
    assert lifecycle.migrated_roots(old).first().source == "manual"
    rows = [(1, "running", None), (2, "completed", None)]
    scans = spark.createDataFrame(rows, "id long, status string, finished_at timestamp")
    assert [r.status for r in lifecycle.interrupted(scans, F.current_timestamp()).orderBy("id").collect()] == ["interrupted", "completed"]

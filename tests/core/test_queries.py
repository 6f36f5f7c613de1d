"""Every query of the engine against its SQL in DuckDB, on the smallest data."""

import os

import duckdb
import pytest
from dupescope.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    expected = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, expected.fetchall()))


def test_sizes_beyond_64_bits(spark, tmp_path):
    keys = [(9_000_000, 1_200_000, n) for n in range(1, 8)] + [(9_000_000, 0, 3), (9_000_000, 1_200_000, None), (2, 1, 1), (3_000_000, 100_000, 2), (2**31, 2, 2), (1 << 29, 4, 2)]
    spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")

    def text(size):
        unit = max((k for k in range(1, 7) if size >= 1 << 10 * k), default=0)
        return f"{size / (1 << 10 * unit):.1f} {'KMGTPE'[unit - 1]}B" if unit else f"{size} B"

    got = {(r.id, r.size_text) for r in QUERIES["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {(o * 10 + n, text(abs(o * o * p * (n * n - 3)))) if n else (None, None) for o, p, n in keys}
    within = f"(SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet' WHERE l_orderkey < 4000000)"
    assert set(duckdb.sql(ORACLE_SQL["format_bytes"].replace("FROM lineitem", f"FROM {within}")).fetchall()) <= got

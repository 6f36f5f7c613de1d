"""Connected components of an edge table, by alternating large and small stars.

Edges live in tables of the shared folder, never on the driver.  Groupings pre-aggregate
before they shuffle, and adaptive execution splits the joins where a node has very many
edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_splittable
from . import common


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = join_splittable(pairs, least, ["u"])
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")
    return joined.select(ends).select("e.a", "e.b")


def components(edges: DataFrame, rounds: int = 60, tables: common.Workspace | None = None) -> DataFrame:
    """node, component of every node of ``edges`` (a, b); the component is its least node.

    Ends when a round changes nothing; raises if ``rounds`` don't suffice.  The table of a
    round is dropped when the next one stands; the last one, which the frame reads, is dropped
    with the other ``tables`` of the caller.
    """
    tables = tables or common.Workspace(edges.sparkSession, "components")
    clean = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = tables.write(clean(edges), "edges")
    seen = None
    for _ in range(rounds):
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = clean(_star(both, True))
        small = clean(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False))
        old, state = state, tables.write(small, "round")
        tables.drop(old)
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            tops = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")

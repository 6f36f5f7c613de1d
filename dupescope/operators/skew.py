"""Equi-joins that adaptive execution can split at a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_splittable(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with an exchange of its own on either side.

    A side that was just aggregated by the keys is already dealt out by them, so a plain
    join would take that partitioning over, and a partition with a hot key could not be
    split.  Joining on a struct of the keys asks for a new exchange of the (small)
    aggregated side, and leaves both free to be split or broadcast.  Null keys match each
    other, as they do in a grouping.
    """
    name = "_key"
    while name in (*left.columns, *right.columns):
        name += "_"
    key = F.struct(*keys).alias(name)
    rest = [c for c in right.columns if c not in keys]
    joined = left.select("*", key).join(right.select(key, *rest), name, how)
    return joined.drop(name)

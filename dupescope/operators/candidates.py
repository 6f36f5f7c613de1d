"""Candidate pruning: which files can still have a duplicate.

A collision is found by an aggregate over the key and a semi-join, never by comparing the
files of a key with each other: a popular size costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRESENT
from .skew import join_splittable


def present(files: DataFrame) -> DataFrame:
    return files.where((F.col("status") == PRESENT) & (F.col("size") > 0))


def collisions(files: DataFrame, *keys: str) -> DataFrame:
    """Keys that two or more rows have."""
    return files.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def size_candidates(files: DataFrame) -> DataFrame:
    """Present files without a full hash whose size another present file has, hashed or not."""
    usable = present(files)
    return join_splittable(usable.where("full_hash = ''"), collisions(usable, "size"), ["size"], "left_semi")


def needs_sample(reuse_partial: bool) -> Column:
    """Which size candidates are sampled; without reuse every one is, each time."""
    return F.col("partial_hash") == "" if reuse_partial else F.lit(True)


def half_hashed(files: DataFrame) -> DataFrame:
    """Present files that have a full hash but no sampled one, and whose size an unhashed file has.

    A sample is due for them too: a later twin couldn't meet them at the second filter.
    """
    usable = present(files)
    waiting = usable.where("full_hash = ''").select("size").distinct()
    return join_splittable(usable.where("full_hash <> '' AND partial_hash = ''"), waiting, ["size"], "left_semi")


def partial_candidates(files: DataFrame) -> DataFrame:
    """Present files without a full hash whose size and sampled hash another present file has."""
    usable = present(files).where("partial_hash <> ''")
    return join_splittable(usable.where("full_hash = ''"), collisions(usable, "size", "partial_hash"), ["size", "partial_hash"], "left_semi")


def size_singletons(files: DataFrame) -> DataFrame:
    """Present files whose size no other present file has."""
    usable = present(files)
    return join_splittable(usable, collisions(usable, "size"), ["size"], "left_anti")

"""Incremental maintenance of the duplicate groups.

What is kept is the number of paths of each instance (size, hash, device, inode).  A change of
files takes a path from an instance and gives one to another; only the groups of the keys that
this touches are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP_PARTS, PRESENT
from .groups import KEY
from .skew import join_splittable

INSTANCE = [*KEY, "device", "inode"]


def part_of(size: Column) -> Column:
    """The part of the groups and instances tables that a size belongs to."""
    return F.pmod(F.xxhash64(size), F.lit(GROUP_PARTS)).cast("int")


def contributions(changed: DataFrame) -> DataFrame:
    """size, full_hash, device, inode, paths (what is added), part: of rows of files with ``was``, their state before (null: new).

    A side counts if it is a present file with a hash.  What cancels out leaves no row.
    """
    side = lambda prefix, n: changed.where(f"{prefix}status = '{PRESENT}' AND {prefix}size > 0 AND {prefix}full_hash <> ''").select(*(F.col(f"{prefix}{c}").alias(c) for c in INSTANCE), F.lit(n).cast("long").alias("paths"))
    both = side("", 1).unionByName(side("was.", -1))
    return both.groupBy(*INSTANCE).agg(F.sum("paths").alias("paths")).where("paths <> 0").withColumn("part", part_of(F.col("size")))


def instances(files: DataFrame) -> DataFrame:
    """The instances of all files, from scratch."""
    return contributions(files.withColumn("was", F.lit(None).cast(f"struct<status:string,{','.join(f'{c}:{files.schema[c].dataType.simpleString()}' for c in INSTANCE)}>")))


def groups_of(held: DataFrame) -> DataFrame:
    """The duplicate groups of some instances."""
    found = held.where("paths > 0").groupBy(*KEY).agg(F.sum("paths").cast("long").alias("member_count"), F.count("*").alias("distinct_instance_count"))
    return found.where("member_count > 1").withColumn("reclaimable_bytes", (F.col("distinct_instance_count") - 1) * F.col("size"))


def regrouped(held: DataFrame, keys: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of the touched ``keys`` (size, full_hash), and a row of no members for those of ``groups`` that are none any more."""
    found = groups_of(join_splittable(held, keys, KEY, "left_semi"))
    gone = join_splittable(join_splittable(groups, keys, KEY, "left_semi"), found.select(*KEY), KEY, "left_anti")
    none = [F.lit(0).cast("long").alias(c) for c in ("member_count", "distinct_instance_count", "reclaimable_bytes")]
    return found.select(groups.columns).unionByName(gone.select(*KEY, *none).select(groups.columns)).withColumn("part", part_of(F.col("size")))

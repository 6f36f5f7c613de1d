"""Duplicate groups, their members, and hard links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import present
from .skew import join_splittable

KEY = ["size", "full_hash"]


def hashed(files: DataFrame) -> DataFrame:
    return present(files).where("full_hash <> ''")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Groups of two or more paths with equal size and SHA-256; hard links are one instance.

    Paths are pre-aggregated per instance, so a group of any size is a few rows a task.
    """
    instances = hashed(files).groupBy(*KEY, "device", "inode").agg(F.count("*").alias("paths"))
    found = instances.groupBy(*KEY).agg(F.sum("paths").cast("long").alias("member_count"), F.count("*").alias("distinct_instance_count"))
    return found.where("member_count > 1").withColumn("reclaimable_bytes", (F.col("distinct_instance_count") - 1) * F.col("size"))


def members(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Files of the groups."""
    return join_splittable(hashed(files), groups.select(*KEY), KEY, "left_semi")


def with_shared_inode(member_files: DataFrame) -> DataFrame:
    """Adds ``shares_inode``: another path of the group is the same instance on disk."""
    shared = member_files.groupBy(*KEY, "device", "inode").agg((F.count("*") > 1).alias("shares_inode"))
    return join_splittable(member_files, shared, [*KEY, "device", "inode"])


def cross_root(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups whose members lie under two or more roots, with the number of roots."""
    roots = members(files, groups).groupBy(*KEY, "root_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("root_count"))
    return groups.join(roots.where("root_count > 1"), KEY)

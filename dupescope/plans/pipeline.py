"""The staged pipeline over a column of contents: size, sample, SHA-256, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import collisions, present
from ..operators.skew import join_splittable
from ..operators.hashing import full_hash, partial_hash, sampled_bytes


def size_stage(files: DataFrame) -> DataFrame:
    """Stage 1: files (id, size, text, status) whose size collides."""
    usable = present(files)
    return join_splittable(usable, collisions(usable, "size"), ["size"], "left_semi")


def sample_stage(files: DataFrame, sample: int) -> DataFrame:
    """Stages 2 and 3: sampled hash of the survivors, and those whose hash collides, without their texts.

    Samples are taken beside the scan, so that only (id, size, hash) is shuffled.
    """
    usable = present(files)
    narrow = usable.select("id", "size", partial_hash(F.col("text"), F.col("size"), sample).alias("partial_hash"))
    # where size and sample collide the size does, so one grouping decides stages 1 to 3
    return join_splittable(narrow, collisions(narrow, "size", "partial_hash"), ["size", "partial_hash"], "left_semi")


def content_groups(files: DataFrame, sample: int) -> DataFrame:
    """Stages 1 to 5: size, full_hash, member_count of the duplicate groups."""
    due = sample_stage(files, sample).select("id")
    hashed = present(files).join(due, "id", "left_semi").select("size", full_hash(F.col("text")).alias("full_hash"))
    return hashed.groupBy("size", "full_hash").agg(F.count("*").alias("member_count")).where("member_count > 1")


def bytes_hashed(files: DataFrame, sample: int) -> DataFrame:
    """What both hashing stages read, as one row."""
    sampled = size_stage(files).agg(F.coalesce(F.sum(sampled_bytes(F.col("size"), sample)), F.lit(0)).cast("bigint").alias("sampled_bytes"), F.count("*").alias("sampled_files"))
    whole = sample_stage(files, sample).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("full_bytes"), F.count("*").alias("full_files"))
    return sampled.crossJoin(whole).withColumn("bytes_hashed", F.col("sampled_bytes") + F.col("full_bytes"))  # one row by one row

"""Rechecking one group: outcomes, patch of the files, repair of the groups."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MISSING
from .diff import STAT
from .groups import KEY, duplicate_groups
from .hashing import hash_whole

OUTCOME_TYPES = "id long, outcome string, size long, mtime_ns long, device long, inode long, full_hash string"


def check_files(member_files: DataFrame, chunk: int) -> DataFrame:
    """id, outcome (unchanged, changed, missing, error) and the new state of each member (abs_path and stat columns)."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    def one(row: dict) -> tuple:
        old = tuple(row[c] for c in STAT)
        try:
            st = os.lstat(row["abs_path"])
        except FileNotFoundError:
            return (row["id"], "missing", *old, row["full_hash"])
        except OSError:
            return (row["id"], "error", *old, row["full_hash"])
        if not stat.S_ISREG(st.st_mode):
            return (row["id"], "missing", *old, row["full_hash"])
        new = (st.st_size, st.st_mtime_ns, signed(st.st_dev), signed(st.st_ino))
        if new == old:
            return (row["id"], "unchanged", *old, row["full_hash"])
        try:
            return (row["id"], "changed", *new, hash_whole(row["abs_path"], st.st_size, chunk))
        except OSError:
            return (row["id"], "error", *old, row["full_hash"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(row) for row in batch.to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["id", "outcome", *STAT, "full_hash"])

    return member_files.select("id", "abs_path", *STAT, "full_hash").mapInArrow(work, OUTCOME_TYPES)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return outcomes.agg(F.count("*").alias("checked"), of("missing"), of("changed"), F.count_if(F.col("outcome") == "error").alias("errors"), of("unchanged"))


def patched(files: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The files after a recheck: missing ones are marked, changed ones take their new state.

    Either gets ``now`` as updated_at.  The sampled hash of a changed file is cleared, its
    full hash is the new one; errors and unchanged members leave the row as it is.
    """
    o = outcomes.select("id", "outcome", *(F.col(c).alias(f"new_{c}") for c in (*STAT, "full_hash")))
    changed = F.col("outcome") == "changed"
    out = files.join(o, "id", "left")
    for c in (*STAT, "full_hash"):
        out = out.withColumn(c, F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)))
    out = out.withColumn("partial_hash", F.when(changed, "").otherwise(F.col("partial_hash")))
    out = out.withColumn("updated_at", F.when(F.col("outcome").isin("missing", "changed"), now).otherwise(F.col("updated_at")))
    return out.withColumn("status", F.when(F.col("outcome") == "missing", MISSING).otherwise(F.col("status"))).select(files.columns)


def patches(files: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Only the files that a recheck changes, as they will be, with ``was``."""
    touched = outcomes.where("outcome IN ('missing', 'changed')")
    mine = files.join(touched.select("id"), "id", "left_semi")
    return patched(mine, touched, now).join(mine.select("id", F.struct(*mine.columns).alias("was")), "id")


def repaired_groups(groups: DataFrame, files: DataFrame, size: int, full_hash: str) -> DataFrame:
    """The groups with one recomputed from the patched files; below two members it is dissolved.

    Only rows of that key are read again: the filter reaches the scan.
    """
    is_key = (F.col("size") == size) & (F.col("full_hash") == full_hash)
    again = duplicate_groups(files.where(is_key))
    return groups.where(~is_key).unionByName(again.select(groups.columns))


__all__ = ["KEY", "check_files", "outcome_counts", "patched", "repaired_groups"]

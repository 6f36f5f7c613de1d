"""Snapshot maintenance: a walk against the known files, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MISSING, PRESENT

STAT = ("size", "mtime_ns", "device", "inode")
KEY = ["root_id", "rel_path"]


def differs(a: str, b: str) -> Column:
    """Any of the four stat columns differs."""
    same = F.lit(True)
    for c in STAT:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return ~same


def classify(known: DataFrame, walk: DataFrame, keep: bool = False) -> DataFrame:
    """One row per path of either side, with ``change_type``.

    new, changed, reappeared, unchanged, missing (was present) or gone (was missing
    already).  One full outer join on (root_id, rel_path) does all set operations.  With
    ``keep``, entries that the walk skipped come through as skipped (they match no file), and
    ``was`` has the known row.
    """
    skipped = F.col("skipped") if "skipped" in walk.columns else F.lit(False)
    w = walk.select(*KEY, *STAT, skipped.alias("skipped"))
    w = (w if keep else w.where("NOT skipped")).alias("w")
    k = known.alias("k")
    same = [F.col(f"k.{c}") == F.col(f"w.{c}") for c in KEY] + ([~F.col("w.skipped")] if keep else [])
    joined = k.join(w, same, "full_outer")
    kind = (
        F.when(F.col("w.skipped"), "skipped")
        .when(F.col("k.root_id").isNull(), "new")
        .when(F.col("w.root_id").isNull(), F.when(F.col("k.status") == PRESENT, "missing").otherwise("gone"))
        .when(differs("k", "w"), "changed")
        .when(F.col("k.status") == MISSING, "reappeared")
        .otherwise("unchanged")
    )
    keys = [F.coalesce(F.col(f"k.{c}"), F.col(f"w.{c}")).alias(c) for c in KEY]
    stats = [F.coalesce(F.col(f"w.{c}"), F.col(f"k.{c}")).alias(c) for c in STAT]
    rest = [F.col(f"k.{c}") for c in known.columns if c not in (*KEY, *STAT)]
    was = [F.when(F.col("k.root_id").isNotNull(), F.struct(*(F.col(f"k.{c}") for c in known.columns))).alias("was")] if keep else []
    return joined.select(*keys, *stats, *rest, kind.alias("change_type"), *was)


def counts() -> list[Column]:
    """The scan's counters of the walk, as aggregates over classified rows with skipped ones."""
    of = lambda *kinds: F.count_if(F.col("change_type").isin(*kinds))
    return [
        of("new", "changed", "reappeared", "unchanged").alias("files_seen"), of("new").alias("files_new"), of("changed").alias("files_changed"),
        of("missing").alias("files_removed"), of("skipped").alias("files_skipped"),
    ]


def changes(classified: DataFrame, scan_id: int, now: Column, next_id: int) -> DataFrame:
    """Only the rows that a walk changes, as they will be, with ``was``: what they were (null: new)."""
    written = classified.where(F.col("change_type").isin("new", "changed", "reappeared", "missing"))
    return merged(written, scan_id, now, next_id, "was")


def counters(classified: DataFrame, skipped: Column | None = None) -> DataFrame:
    """The scan's counters of the walk as one row."""
    of = lambda *kinds: F.count_if(F.col("change_type").isin(*kinds))
    return classified.agg(
        of("new", "changed", "reappeared", "unchanged").alias("files_seen"), of("new").alias("files_new"),
        of("changed").alias("files_changed"), of("missing").alias("files_removed"), (skipped if skipped is not None else F.lit(0).cast("long")).alias("files_skipped"),
    )


def merged(classified: DataFrame, scan_id: Column | int, now: Column, next_id: int = 0, *more: str) -> DataFrame:
    """The next files table: upserts, cleared hashes, present and missing marks in one projection.

    Rows that a walk doesn't change keep their last_seen_scan_id and updated_at.  New rows
    get ids from ``next_id`` up, unique but with gaps.
    """
    kind = F.col("change_type")
    written = kind.isin("new", "changed", "reappeared", "missing")
    walked = kind.isin("new", "changed", "reappeared")
    scan = F.lit(scan_id) if isinstance(scan_id, int) else scan_id
    cleared = kind.isin("new", "changed")
    return classified.select(
        F.coalesce("id", F.monotonically_increasing_id() + next_id).alias("id"), *KEY, *STAT,
        F.when(cleared, "").otherwise(F.col("partial_hash")).alias("partial_hash"), F.when(cleared, "").otherwise(F.col("full_hash")).alias("full_hash"),
        F.when(walked, scan.cast("long")).otherwise(F.col("last_seen_scan_id")).alias("last_seen_scan_id"),
        F.when(kind.isin("missing", "gone"), MISSING).otherwise(PRESENT).alias("status"),
        F.when(written, now).otherwise(F.col("updated_at")).alias("updated_at"), *more,
    )


def persist_hashes(files: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """``files`` with ``column`` set from results (id, hash); a null hash leaves the row as it is."""
    new = results.where("hash IS NOT NULL").select("id", F.col("hash").alias("new_hash"))
    return files.join(new, "id", "left").withColumn(column, F.coalesce("new_hash", column)).drop("new_hash").select(files.columns)


def hash_changes(files: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """Only the files whose ``column`` results (id, hash) change, with ``was``."""
    new = results.where("hash IS NOT NULL").select("id", F.col("hash").alias("new_hash"))
    out = files.join(new, "id").where(~F.col(column).eqNullSafe(F.col("new_hash"))).withColumn("was", F.struct(*files.columns))
    return out.withColumn(column, F.col("new_hash")).select(*files.columns, "was")

"""Root and scan tables: small dimensions whose changes are projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COUNTERS


def enabled_targets(roots: DataFrame, root_id: int | None = None) -> DataFrame:
    """Roots that a scan walks: enabled ones, all or one."""
    out = roots.where("enabled")
    return out if root_id is None else out.where(F.col("id") == root_id)


def by_id(table: DataFrame, row_id: int) -> DataFrame:
    return table.where(F.col("id") == row_id)


def toggled(roots: DataFrame, root_id: int, enabled: bool | None = None) -> DataFrame:
    new = ~F.col("enabled") if enabled is None else F.lit(enabled)
    return roots.withColumn("enabled", F.when(F.col("id") == root_id, new).otherwise(F.col("enabled")))


def without_root(table: DataFrame, root_id: int, column: str = "root_id") -> DataFrame:
    """A deleted root takes its files along at once; the groups are rebuilt from what stays."""
    return table.where(F.col(column) != root_id)


#: White space that is cut off a path or label.
BLANK = " \t\n\r\x0b\x0c"


def cleaned(given: DataFrame) -> DataFrame:
    """Roots as they are entered (path, label), trimmed; those without a path are left out, and one without a label is named after its folder."""
    cut = given.select(F.btrim("path", F.lit(BLANK)).alias("path"), F.btrim(F.coalesce("label", F.lit("")), F.lit(BLANK)).alias("label")).where("path <> ''")
    folder = F.element_at(F.split("path", "/"), -1)
    named = F.when(F.col("label") != "", F.col("label")).when(folder != "", folder).otherwise(F.col("path"))
    return cut.select("path", named.alias("label"))


def absent(roots: DataFrame, directories: DataFrame) -> DataFrame:
    """Roots (path) that aren't among the directories that there are (path): a scan of one fails before it compares anything."""
    return roots.join(directories.select("path"), "path", "left_anti")


def undiscovered(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Listed paths that no root has."""
    return listing.join(roots.select("path"), "path", "left_anti")


def migrated_roots(roots: DataFrame) -> DataFrame:
    """Root tables from before ``source`` existed read as manual ones."""
    return roots.withColumn("source", F.coalesce("source", F.lit("manual")) if "source" in roots.columns else F.lit("manual"))


def by_added(roots: DataFrame) -> DataFrame:
    return roots.orderBy("added_at", "id")


def history(scans: DataFrame, n: int = 50) -> DataFrame:
    return scans.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def current(scans: DataFrame) -> DataFrame:
    """The running scan, if any."""
    return history(scans.where("status = 'running'"), 1)


def started(spark: SparkSession, scan_id: int, root_ids: list[int], now: Column) -> DataFrame:
    """The row of a scan that begins, with the roots it covers."""
    zero = [F.lit(0).cast("bigint").alias(c) for c in COUNTERS]
    covered = F.array(*(F.lit(i).cast("bigint") for i in root_ids)).alias("root_ids")
    return spark.range(1).select(F.lit(scan_id).cast("bigint").alias("id"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.lit("walking").alias("phase"), *zero, F.lit("").alias("error"), covered)


def scan_roots(scans: DataFrame, roots: DataFrame) -> DataFrame:
    """scan_id, root_id, path of the roots that scans covered; deleted ones have no row."""
    links = scans.select(F.col("id").alias("scan_id"), F.explode("root_ids").alias("root_id"))
    return links.join(roots.select(F.col("id").alias("root_id"), "path"), "root_id").select("scan_id", "root_id", "path")


def interrupted(scans: DataFrame, now: Column) -> DataFrame:
    """What was running when the process ended is interrupted at its next start."""
    running = F.col("status") == "running"
    out = scans.withColumn("finished_at", F.when(running, now).otherwise(F.col("finished_at")))
    return out.withColumn("status", F.when(running, "interrupted").otherwise(F.col("status"))).select(scans.columns)


def finished(scans: DataFrame, scan_id: int, status: str, error: str, now: Column) -> DataFrame:
    mine = F.col("id") == scan_id
    set_ = lambda name, value: F.when(mine, value).otherwise(F.col(name)).alias(name)
    new = {"status": F.lit(status), "error": F.lit(error), "finished_at": now}
    return scans.select(*(set_(c, new[c]) if c in new else F.col(c) for c in scans.columns))


def with_counters(scans: DataFrame, scan_id: int, phase: str, values: dict[str, int]) -> DataFrame:
    mine = F.col("id") == scan_id
    new = {"phase": F.lit(phase)} | {c: F.lit(values[c]).cast("bigint") for c in COUNTERS if c in values}
    return scans.select(*(F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in scans.columns))

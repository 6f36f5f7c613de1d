"""A table of texts as a files-shaped DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hashing import partial_hash
from ..operators.skew import join_splittable

#: Sample size of corpus queries: small enough that texts of some kilobytes have three samples.
SAMPLE = 1024


def files(documents: DataFrame, sample: int = SAMPLE, with_text: bool = False) -> DataFrame:
    """One file per document: lang/doc_id.txt under /scan/<source>.

    Copies of equal text whose ids have the same parity count as hard links: they share the
    least id as inode.  Every 17th file is missing.  What a query doesn't use isn't computed.
    """
    base = documents.select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 20).cast("bigint").alias("root_id"), F.concat(F.lit("/scan/"), "source").alias("root_path"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.octet_length("text").cast("bigint").alias("size"),
        (F.col("doc_id") * 1000000000).alias("mtime_ns"), F.lit(1).cast("bigint").alias("device"), F.sha2("text", 256).alias("full_hash"),
        partial_hash(F.col("text"), F.octet_length("text").cast("bigint"), sample).alias("partial_hash"),
        F.when(F.col("doc_id") % 17 == 0, "missing").otherwise("present").alias("status"), (F.col("doc_id") % 2).alias("parity"), *(["text"] if with_text else []),
    )
    # the least id per content and parity, aggregated on the map side; only real copies are joined
    linked = documents.groupBy(F.sha2("text", 256).alias("full_hash"), (F.col("doc_id") % 2).alias("parity")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return join_splittable(base, linked, ["full_hash", "parity"], "left").withColumn("inode", F.coalesce("first_id", "id")).drop("first_id", "parity")


def plain_files(documents: DataFrame) -> DataFrame:
    """id, size and text of present files, without any hash and without a shuffle: input of the staged pipeline."""
    status = F.when(F.col("doc_id") % 17 == 0, "missing").otherwise("present")
    return documents.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("size"), status.alias("status"), F.lit("").alias("full_hash"), F.lit("").alias("partial_hash"), "text")


def known_files(found: DataFrame) -> DataFrame:
    """An earlier snapshot: tenths of the ids are not yet known, sevenths had another size, thirteenths were missing."""
    return (
        found.where(F.col("id") % 10 != 0)
        .withColumn("size", F.col("size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0))
        .withColumn("status", F.when(F.col("id") % 13 == 0, "missing").otherwise("present"))
        .withColumn("last_seen_scan_id", F.lit(1).cast("bigint"))
    )


def walked_files(found: DataFrame) -> DataFrame:
    """The current walk: elevenths of the ids are gone."""
    return found.where(F.col("id") % 11 != 0)


def roots(documents: DataFrame) -> DataFrame:
    """id, path, label, enabled of each source."""
    found = documents.select("source").distinct()
    number = F.substring("source", 4, 20).cast("bigint")
    return found.select(number.alias("id"), F.concat(F.lit("/scan/"), "source").alias("path"), F.col("source").alias("label"), (number % 3 != 0).alias("enabled"))

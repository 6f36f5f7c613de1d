"""What a directory entry is, by its mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import WALK

#: The bits of a mode that say what an entry is, and their values: fixed values of POSIX.
KIND_BITS = 0o170000
KINDS = {0o100000: "file", 0o040000: "directory", 0o120000: "link", 0o010000: "pipe", 0o140000: "socket", 0o020000: "character device", 0o060000: "block device"}


def kind(mode: Column) -> Column:
    """Name of the kind of an entry; ``unreadable`` without a mode, ``unknown`` for other values."""
    bits = mode.cast("long").bitwiseAND(F.lit(KIND_BITS).cast("long"))
    out = F.lit("unknown")
    for value, name in KINDS.items():
        out = F.when(bits == value, name).otherwise(out)
    return F.when(mode.isNull(), "unreadable").otherwise(out)


def as_walk(entries: DataFrame) -> DataFrame:
    """Entries with their ``mode`` as rows of a walk: what isn't a regular file is skipped and has no stat."""
    skipped = kind(F.col("mode")) != "file"
    plain = ("root_id", "abs_path", "rel_path")
    return entries.select(*plain, *(F.when(~skipped, F.col(c)).alias(c) for c in WALK.names if c not in (*plain, "skipped")), skipped.alias("skipped"))

"""Browse queries: filtered and paged groups, group detail, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import contains_like
from .candidates import present
from .groups import KEY, members, with_shared_inode


@dataclass(frozen=True)
class DuplicateFilter:
    root_id: int | None = None
    min_size: int = 0
    name_like: str = ""
    page: int = 1
    page_size: int = 25

    @classmethod
    def parse(cls, **given: str) -> DuplicateFilter:
        """From text parameters; what isn't a number is ignored."""
        number = lambda name, least: int(v) if (v := str(given.get(name) or "").strip()).isascii() and v.isdigit() and int(v) >= least else None
        return cls(number("root_id", 1), number("min_size", 0) or 0, str(given.get("name_like") or ""), number("page", 1) or 1, number("page_size", 1) or 25)

    @property
    def bounds(self) -> tuple[int, int]:
        """(offset, limit)"""
        page, size = max(1, self.page), self.page_size if self.page_size >= 1 else 25
        return (page - 1) * size, size


def ordered(groups: DataFrame) -> DataFrame:
    """Largest gain first; the hash breaks ties so that pages are stable."""
    return groups.orderBy(F.desc("reclaimable_bytes"), F.desc("size"), F.asc("full_hash"))


def filtered(groups: DataFrame, files: DataFrame, by: DuplicateFilter) -> DataFrame:
    """Groups that pass; root and name must hold for one and the same member, and counts stay those of the whole group."""
    out = groups.where(F.col("size") >= by.min_size) if by.min_size else groups
    if by.root_id is None and not by.name_like:
        return out
    near = present(files)
    near = near.where(F.col("root_id") == by.root_id) if by.root_id is not None else near
    near = near.where(contains_like(F.col("rel_path"), by.name_like)) if by.name_like else near
    near = near.where(F.col("size") >= by.min_size) if by.min_size else near
    # one row per key and task is shuffled, however many members pass
    return out.join(near.select(*KEY).distinct(), KEY, "left_semi")


def page(groups: DataFrame, files: DataFrame, by: DuplicateFilter) -> DataFrame:
    offset, limit = by.bounds
    return ordered(filtered(groups, files, by)).offset(offset).limit(limit)


def page_info(groups: DataFrame, files: DataFrame, by: DuplicateFilter) -> DataFrame:
    """total and pages, as one row."""
    _, limit = by.bounds
    return filtered(groups, files, by).agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / limit)).alias("pages"))


def detail(files: DataFrame, groups: DataFrame, roots: DataFrame, size: int, full_hash: str) -> DataFrame:
    """Members of one group with their roots' paths, in order of root path and relative path."""
    one = files.where((F.col("size") == size) & (F.col("full_hash") == full_hash))
    found = with_shared_inode(members(one, groups.where((F.col("size") == size) & (F.col("full_hash") == full_hash))))
    named = found.join(roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path")), "root_id")
    return named.select("id", "root_id", "root_path", "rel_path", "size", "full_hash", "device", "inode", "shares_inode").orderBy("root_path", "rel_path")


def summary_files(files: DataFrame) -> DataFrame:
    """Present files and their bytes; hard links count each time, empty files count too."""
    return files.where("status = 'present'").agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def summary_groups(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).cast("long").alias("reclaimable_bytes"))

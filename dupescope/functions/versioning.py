"""Release tags: parse and compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(tag: Column) -> Column:
    """Numbers of a tag such as ``v2026.09.14``; an empty array if any part isn't a whole number."""
    parts = F.split(F.regexp_replace(F.trim(tag), "^v", ""), r"\.", -1)
    whole = F.forall(parts, lambda p: p.rlike(r"^[+-]?[0-9]{1,18}$"))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(parts, lambda p: p.try_cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def is_release(tag: Column) -> Column:
    return F.size(parse(tag)) > 0


def newer(candidate: Column, current: Column) -> Column:
    """Whether ``candidate`` is the later release: missing parts count as zero, unreadable tags as never newer."""
    a, b = parse(candidate), parse(current)
    n = F.greatest(F.size(a), F.size(b))
    padded = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(x)))
    return (F.size(a) > 0) & (F.size(b) > 0) & (padded(a) > padded(b))

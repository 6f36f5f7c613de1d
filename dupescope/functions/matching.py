"""Substring match with the pattern rules of the name filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def contains_like(value: Column, text: str) -> Column:
    """``%text%``: only ASCII letters match in either case; % and _ in the text are wildcards, and nothing escapes them."""
    pattern = "".join(c.lower() if c.isascii() else c for c in text).replace("\\", "\\\\")
    return ascii_lower(value).like(f"%{pattern}%")

"""Paths as columns: below a root, and with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute(root: Column, rel_path: Column) -> Column:
    """The root, one slash, the relative path."""
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), rel_path)


def relative(root: Column, path: Column) -> Column:
    """What stands behind the root and its slash; null if the path isn't below it."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1))


def top_directory(rel_path: Column) -> Column:
    """The first directory of a relative path, null for what lies at the top."""
    return F.when(F.instr(rel_path, "/") > 0, F.substring_index(rel_path, "/", 1))

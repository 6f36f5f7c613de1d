"""Merge on read: a base and the changes that were written after it.

A change is a row of its own in a small table beside the base.  How base and changes combine is
a property of the table: the newest row of a key wins, or the rows of a key add up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Newest:
    """The last written row of each key; ``dead`` is a condition on rows that say that the key is gone."""

    keys: tuple[str, ...]
    dead: str | None = None

    def among(self, changes: list[DataFrame]) -> DataFrame:
        """One row for each key of the changes, oldest table first."""
        columns = changes[0].columns
        number = "_n"
        every = reduce(DataFrame.unionByName, (c.withColumn(number, F.lit(k)) for k, c in enumerate(changes)))
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), number).alias(number))
        return last.select(*(F.col(f"{number}.{c}").alias(c) for c in columns))

    def read(self, base: DataFrame, changes: list[DataFrame]) -> DataFrame:
        """The table as of the last change.

        Only the changes are aggregated.  Rows of the base pass an anti-join with their keys,
        which is broadcast where it is small, and filters on the base reach its scan.
        """
        rows = base
        if changes:
            last = self.among(changes)
            rows = base.join(last.select(*self.keys), list(self.keys), "left_anti").select(base.columns).unionByName(last)
        return rows.where(f"NOT ({self.dead})") if self.dead else rows

    def fold(self, tables: list[DataFrame], whole: bool) -> DataFrame:
        """The tables as one: as a new base, or as one change that still says what is gone."""
        return self.read(tables[0], tables[1:]) if whole else self.among(tables)


@dataclass(frozen=True)
class Summed:
    """The sum of ``value`` for each key; keys whose sum is zero are gone."""

    keys: tuple[str, ...]
    value: str

    def read(self, base: DataFrame, changes: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, changes, base)
        columns = base.columns
        return every.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value)).where(F.col(self.value) != 0).select(columns)

    def fold(self, tables: list[DataFrame], whole: bool) -> DataFrame:
        return self.read(tables[0], tables[1:])


def due(sizes: list[int], ratio: int = 4, most: int = 8, least: int = 0) -> int | None:
    """From which table on (0: the base) tables should be folded into one, or None.

    A table is rewritten when the newer ones together have a ``ratio``-th of its size, so a row is
    rewritten a number of times that is logarithmic in how much is written after it.  Changes that
    together have less than ``least`` can wait.  More than ``most`` are folded whatever their sizes.
    """
    newer = 0
    found = None
    for k in range(len(sizes) - 1, 0, -1):
        newer += sizes[k]
        if newer >= least and newer * ratio >= sizes[k - 1]:
            found = k - 1
    if found is None and len(sizes) - 1 > most:
        found = 1
    return found

"""Migration by comparison: steps from the schema that a table was written with to the one that is wanted."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Incompatible(Exception):
    """A column can't become what is wanted without losing values."""


@dataclass(frozen=True)
class Step:
    """What becomes of one column: ``keep``, ``rename`` (from ``source``), ``widen``, ``add`` (with ``default``) or ``leave`` out."""

    kind: str
    column: str
    type: T.DataType | None = None
    source: str = ""
    default: Any = None


#: Types that hold every value of another.
WIDER: dict[str, tuple[str, ...]] = {
    "tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"),
    "float": ("double",), "date": ("timestamp",), "timestamp_ntz": ("timestamp",), "void": ("string", "bigint", "boolean", "timestamp", "double"),
}


def widens(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return new.simpleString() in WIDER.get(old.simpleString(), ())


def plan(stored: T.StructType, wanted: T.StructType, defaults: Mapping[str, Any] | None = None, renamed: Mapping[str, str] | None = None) -> list[Step]:
    """Steps that make rows of ``stored`` rows of ``wanted``, in the order of its columns.

    ``defaults`` are values of columns that were not there (else null), ``renamed`` gives earlier
    names by name.
    """
    known, used, steps = {f.name: f.dataType for f in stored}, set(), []
    for field in wanted:
        source = field.name if field.name in known else (renamed or {}).get(field.name, "")
        if source not in known:
            steps.append(Step("add", field.name, field.dataType, default=(defaults or {}).get(field.name)))
            continue
        used.add(source)
        old = known[source]
        if old != field.dataType and not widens(old, field.dataType):
            raise Incompatible(f"{field.name}: {old.simpleString()} doesn't fit {field.dataType.simpleString()}")
        kind = "widen" if old != field.dataType else "rename" if source != field.name else "keep"
        steps.append(Step(kind, field.name, field.dataType, source))
    return steps + [Step("leave", name) for name in known if name not in used]


def apply(frame: DataFrame, steps: list[Step]) -> DataFrame:
    """The rows of ``frame`` after the steps; a projection, so pushed filters and pruned columns go through it."""
    out = []
    for step in steps:
        if step.kind == "add":
            value = step.default if step.default is not None else None
            out.append(F.lit(value).cast(step.type).alias(step.column))
        elif step.kind != "leave":
            column = F.col(f"`{step.source}`")
            out.append((column.cast(step.type) if step.kind == "widen" else column).alias(step.column))
    return frame.select(*out)


def same(stored: T.StructType, wanted: T.StructType) -> bool:
    """Whether nothing has to be done but to read by name."""
    return {f.name: f.dataType for f in stored} == {f.name: f.dataType for f in wanted}

"""Display formats: bytes, times, durations, hashes, copies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "KMGTPE"


def format_bytes(size: Column) -> Column:
    """``512 B``, ``1.2 KB``, ...: steps of 1024, one decimal, exact ties to even; whole numbers of any type, EB being the last unit."""
    out, value = F.concat(size.cast("string"), F.lit(" B")), size.cast("double")
    for k, unit in enumerate(UNITS, 1):
        scaled = F.format_string("%.1f", F.bround(value / float(1 << 10 * k), 1))
        reached = value >= float(1 << 10 * k)
        if 10 * k > 53:  # just below, a double may be rounded up to the unit
            reached &= size >= F.lit(1 << 10 * k)
        out = F.when(reached, F.concat(scaled, F.lit(f" {unit}B"))).otherwise(out)
    return out


def format_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def short_hash(value: Column) -> Column:
    return F.substring(value, 1, 12)


def format_duration_ms(ms: Column) -> Column:
    """``2h 5m 12s``: rounded to seconds, never below zero, without leading zero units."""
    seconds = F.greatest(F.floor((ms + 500) / 1000), F.lit(0)).cast("long")
    d, h, m, s = F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60
    part = lambda value, unit: F.concat(value.cast("string"), F.lit(unit))
    return (
        F.when(d > 0, F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), part(s, "s")))
        .when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s")))
        .when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s")))
        .otherwise(part(s, "s"))
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times; an open end is now."""
    return F.unix_millis(F.coalesce(end, F.current_timestamp())) - F.unix_millis(start)


def copies_label(instances: Column, members: Column) -> Column:
    """Instances, and the number of paths where hard links make it larger."""
    both = F.concat(instances.cast("string"), F.lit(" ("), members.cast("string"), F.lit(" paths)"))
    return F.when(instances == members, instances.cast("string")).otherwise(both)


def progress_percent(phase: Column) -> Column:
    return F.when(phase == "walking", 25).when(phase == "hashing", 65).when(phase == "finalizing", 95).otherwise(0)

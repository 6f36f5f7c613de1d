"""Tables, enumerations and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

ROOT_SOURCES = ("manual", "auto")
SCAN_STATUSES = ("running", "completed", "failed", "interrupted")
SCAN_PHASES = ("walking", "hashing", "finalizing")
PRESENT, MISSING = "present", "missing"

COUNTERS = ("files_seen", "files_new", "files_changed", "files_removed", "files_skipped", "bytes_hashed")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_L, _S, _T, _B = T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType()

ROOTS = _struct(("id", _L, False), ("path", _S, False), ("label", _S, False), ("added_at", _T, False), ("enabled", _B, False), ("source", _S, True))
SCANS = _struct(
    ("id", _L, False), ("started_at", _T, False), ("finished_at", _T, True), ("status", _S, False), ("phase", _S, False),
    *((c, _L, False) for c in COUNTERS), ("error", _S, False), ("root_ids", T.ArrayType(_L), False),
)
FILES = _struct(
    ("id", _L, False), ("root_id", _L, False), ("rel_path", _S, False), ("size", _L, False), ("mtime_ns", _L, False),
    ("device", _L, False), ("inode", _L, False), ("partial_hash", _S, False), ("full_hash", _S, False),
    ("last_seen_scan_id", _L, True), ("status", _S, False), ("updated_at", _T, False),
)
GROUPS = _struct(("size", _L, False), ("full_hash", _S, False), ("member_count", _L, False), ("distinct_instance_count", _L, False), ("reclaimable_bytes", _L, False))
#: Parts of the groups and instances tables, by a hash of the size.
GROUP_PARTS = 32
INSTANCES = _struct(("size", _L, False), ("full_hash", _S, False), ("device", _L, False), ("inode", _L, False), ("paths", _L, False))
WALK = _struct(
    ("root_id", _L, False), ("abs_path", _S, False), ("rel_path", _S, True), ("size", _L, True), ("mtime_ns", _L, True),
    ("device", _L, True), ("inode", _L, True), ("skipped", _B, False),
)
EVENTS = _struct(("type", _S, False), ("scan_id", _L, False), ("phase", _S, True), *((c, _L, False) for c in COUNTERS), ("current_path", _S, True), ("error", _S, True), ("elapsed_ms", _L, False))


@dataclass(frozen=True)
class EngineConfig:
    """Settings of the engine.

    ``sample_size``: bytes of each of the three samples; files of up to three samples are
    hashed whole.  ``reuse_partial``: don't sample a file again whose sample is known.
    ``walk_partitions``: tasks of a round of the walk.  ``hash_task_bytes``: bytes that a hashing
    task reads.  ``tick_seconds``: time between two progress events of a running scan.
    ``kept_logs``: finished scans whose events are kept.
    """

    sample_size: int = 65536
    reuse_partial: bool = True
    walk_partitions: int = 64
    hash_chunk: int = 1 << 20
    page_size: int = 25
    tick_seconds: int = 1
    hash_task_bytes: int = 64 << 20
    kept_logs: int = 100

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """From DUPESCOPE_<FIELD> variables; values that aren't positive numbers leave the default."""
        env = os.environ if env is None else env
        given: dict = {}
        for name, default in cls().__dict__.items():
            raw = env.get(f"DUPESCOPE_{name.upper()}", "")
            if isinstance(default, bool):
                if raw.lower() in ("0", "1", "true", "false"):
                    given[name] = raw.lower() in ("1", "true")
            elif raw.isascii() and raw.isdigit() and int(raw) > 0:
                given[name] = int(raw)
        return cls(**given)

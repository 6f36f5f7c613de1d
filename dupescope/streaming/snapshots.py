"""The snapshot diff as a stream: stat rows come in as they are met, changes come out.

State is kept by (root, path) in a state store, so nothing is compared that isn't met.  A file
that a walk doesn't meet sends no row; what tells of it is a timer in event time, which its
last row has set and its next one would have put off: when the watermark of a later walk
passes it, the file is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.diff import STAT
from ..schema import MISSING, PRESENT

STATE = ", ".join([*(f"{c} long" for c in STAT), "status string", "seen_ms long"])
CHANGES = "root_id long, rel_path string, change_type string, " + ", ".join(f"{c} long" for c in STAT)
#: Transform with state needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileState(StatefulProcessor):
    """One file: its last stat, whether it is there, and the timer that will say that it isn't."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", STATE)

    def _remember(self, stat: tuple, status: str, seen_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((*stat, status, seen_ms))
        if status == PRESENT:
            self.handle.registerTimer(seen_ms + self.patience_ms)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802, N803
        self._remember(tuple(initialState[c] for c in STAT), initialState["status"], initialState["seen_ms"])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        row = max(rows, key=lambda r: r["seen_ms"])  # a late row of an earlier walk changes nothing that a later one said
        stat = tuple(row[c] for c in STAT)
        old = self.state.get() if self.state.exists() else None
        if old is not None and old[-1] > row["seen_ms"]:
            return
        kind = "new" if old is None else "changed" if tuple(old[: len(STAT)]) != stat else "reappeared" if old[len(STAT)] == MISSING else ""
        self._remember(stat, PRESENT, row["seen_ms"])
        if kind:
            yield Row(root_id=key[0], rel_path=key[1], change_type=kind, **dict(zip(STAT, stat, strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get()
        if old[len(STAT)] == PRESENT:
            stat = tuple(old[: len(STAT)])
            self.state.update((*stat, MISSING, old[-1]))
            yield Row(root_id=key[0], rel_path=key[1], change_type="missing", **dict(zip(STAT, stat, strict=True)))

    def close(self) -> None:
        pass


def changes(walked: DataFrame, patience_seconds: int, known: DataFrame | None = None) -> DataFrame:
    """root_id, rel_path, change_type (new, changed, reappeared, missing) and stat columns.

    ``walked`` is a stream of root_id, rel_path, the stat columns and ``seen_at``, the time of the
    walk; ``known`` (those columns and ``status``) is where the state begins.  A file that isn't met
    for ``patience_seconds`` after it was, by the times of later walks, is missing: longer than a
    walk takes, shorter than two begin apart.
    """
    walked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = F.unix_millis("seen_at").alias("seen_ms")
    rows = walked.withWatermark("seen_at", "0 seconds").select("root_id", "rel_path", *STAT, "seen_at", ms)
    start = known.select("root_id", "rel_path", *STAT, "status", ms).groupBy("root_id", "rel_path") if known is not None else None
    return rows.groupBy("root_id", "rel_path").transformWithState(FileState(patience_seconds * 1000), CHANGES, "Update", "EventTime", start)


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """Stat rows that walks leave as Parquet files below ``path``."""
    return spark.readStream.schema("root_id long, rel_path string, " + ", ".join(f"{c} long" for c in STAT) + ", seen_at timestamp").parquet(path)

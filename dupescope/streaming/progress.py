"""Progress events: terminal events, latest state, JSON, live streams, one stream for many subscribers."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import COUNTERS, EVENTS

TERMINAL = ("scan_completed", "scan_failed")


def terminal_events(scans: DataFrame) -> DataFrame:
    """The last event of each finished scan, for subscribers that come late."""
    kind = F.when(F.col("status").isin("failed", "interrupted"), "scan_failed").otherwise("scan_completed")
    elapsed = F.unix_millis("finished_at") - F.unix_millis("started_at")
    done = scans.where("finished_at IS NOT NULL AND status <> 'running'")
    return done.select(kind.alias("type"), F.col("id").alias("scan_id"), "phase", *COUNTERS, F.lit("").alias("current_path"), "error", elapsed.alias("elapsed_ms"))


def latest(events: DataFrame, key: str = "scan_id", by: str = "elapsed_ms") -> DataFrame:
    """The newest event of each scan; one row a scan and task is shuffled."""
    row = F.struct(*(c for c in events.columns if c != key))
    return events.groupBy(key).agg(F.max_by(row, by).alias("e")).select(key, "e.*")


def event_json(events: DataFrame, omit_empty: tuple[str, ...] = ("phase", "current_path", "error")) -> Column:
    """JSON of an event; empty texts of the optional fields are left out."""
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) if c in omit_empty else F.col(c) for c in events.columns]
    return F.to_json(F.struct(*fields))


def of_scan(events: DataFrame, scan_id: int) -> DataFrame:
    return events.where(F.col("scan_id") == scan_id)


def with_terminal(events: DataFrame, scans: DataFrame) -> DataFrame:
    """The log, and for finished scans whose terminal event it lacks (as interrupted ones) that event from the scans table."""
    last = terminal_events(scans).select(events.columns)
    told = events.where(F.col("type").isin(*TERMINAL)).select("scan_id").distinct()
    return events.unionByName(last.join(told, "scan_id", "left_anti").select(events.columns))


def scan_folder(path: str, scan_id: int | str) -> str:
    """Where the log below ``path`` keeps the events of a scan."""
    return f"{path}/scan-{scan_id}"


def read_stream(spark: SparkSession, path: str, scan_id: int | None = None) -> DataFrame:
    """Events that are appended to the log below ``path`` as JSON lines, of all scans or of one, whose folder alone is looked at."""
    if scan_id is None:
        _folder(spark, path)
        return spark.readStream.schema(EVENTS).json(scan_folder(path, "*"))
    _folder(spark, scan_folder(path, scan_id))
    return spark.readStream.schema(EVENTS).json(scan_folder(path, scan_id))


def read(spark: SparkSession, path: str, scan_id: int) -> DataFrame:
    """Events of a scan so far: from the log, or what it was rolled up to."""
    found = [f for f in (scan_folder(path, scan_id), scan_folder(rolled(path), scan_id)) if _exists(spark, f)][:1]
    return spark.read.schema(EVENTS).json(found) if found else spark.createDataFrame([], EVENTS)


def rolled(path: str) -> str:
    return f"{path.rstrip('/')}-finished"


def roll_up(spark: SparkSession, path: str, finished: list[int], keep: int = 100) -> None:
    """Puts the events of finished scans into one file each, beside the log, and forgets all but the newest ``keep`` of these.

    A file is there before the log's are deleted, and who reads the log prefers it, so readers
    always find a scan's events once.
    """
    fs, make = _files(spark, path)
    for scan_id in finished:
        log, done = scan_folder(path, scan_id), scan_folder(rolled(path), scan_id)
        if not _exists(spark, log):
            continue
        spark.read.schema(EVENTS).json(log).coalesce(1).write.mode("overwrite").json(done)  # a line a second of one scan
        fs.delete(make(log), True)
    if _exists(spark, rolled(path)):
        known = sorted(int(n.partition("-")[2]) for s in fs.listStatus(make(rolled(path))) if (n := s.getPath().getName()).startswith("scan-"))
        for scan_id in known[:-keep]:
            fs.delete(make(scan_folder(rolled(path), scan_id)), True)


def in_log(spark: SparkSession, path: str) -> list[int]:
    """Scans that have a folder in the log."""
    fs, make = _files(spark, path)
    return sorted(int(n.partition("-")[2]) for s in (fs.listStatus(make(path)) if _exists(spark, path) else []) if (n := s.getPath().getName()).startswith("scan-"))


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and what makes paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _exists(spark: SparkSession, path: str) -> bool:
    fs, make = _files(spark, path)
    return bool(fs.exists(make(path)))


def _folder(spark: SparkSession, path: str) -> None:
    fs, make = _files(spark, path)
    fs.mkdirs(make(path))


def subscribe(spark: SparkSession, path: str, scan_id: int, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", once: bool = False) -> StreamingQuery:
    """Feeds one scan's events, batch by batch, to ``sink``; ends itself behind a terminal event.

    A batch may hold several events: each supersedes those before it.
    """
    ended: list[StreamingQuery] = []

    def forward(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if ended and batch.where(F.col("type").isin(*TERMINAL)).limit(1).count():
            ended[0].stop()

    writer = of_scan(read_stream(spark, path, scan_id), scan_id).writeStream.foreachBatch(forward).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    if not once:
        ended.append(query)
    return query


def latest_stream(events: DataFrame) -> DataFrame:
    """Streaming version of ``latest``: the newest event of each scan, updated as events come."""
    return latest(events)


class Subscriber:
    """Up to RING events that wait for a sink, which a thread of its own calls: a slow sink holds up nobody.

    An event that finds the ring full is dropped, since a later one supersedes it; a terminal one
    takes the place of the last.
    """

    RING = 16

    def __init__(self, spark: SparkSession, scan_id: int, sink: Callable[[DataFrame, int], None], left: Callable[[], None]):
        self.spark, self.scan_id, self.sink, self.left = spark, scan_id, sink, left
        self.ring: list[Row] = []
        self.dropped, self.number, self.over = 0, 0, False
        self.change = threading.Condition()
        threading.Thread(target=self._run, daemon=True).start()

    def offer(self, events: list[Row]) -> None:
        with self.change:
            for event in events:
                if self.over:
                    return
                ends = event.type in TERMINAL
                if len(self.ring) < self.RING:
                    self.ring.append(event)
                else:
                    self.dropped += 1
                    self.ring[-1] = event if ends else self.ring[-1]
                self.over = ends
            self.change.notify()

    def stop(self) -> None:
        """No events from now on; those that wait are still told."""
        with self.change:
            self.over = True
            self.change.notify()

    def _run(self) -> None:
        while True:
            with self.change:
                self.change.wait_for(lambda: self.ring or self.over)
                events, self.ring, last = self.ring, [], self.over
            if events:
                self.sink(self.spark.createDataFrame(events, EVENTS), self.number)
                self.number += 1
            if last:
                return self.left()


class Hub:
    """One stream over the log that feeds any number of subscribers; one ends behind its scan's terminal event.

    ``scans`` gives the scans table.  It is asked once a subscriber stands in the list, so that one
    of a scan that is over gets its terminal event from there, however late it comes, and an end
    between the two isn't missed.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, interval: str = "1 second", scans: Callable[[], DataFrame] | None = None):
        self.spark, self.scans = spark, scans
        self.subscribers: dict[int, Subscriber] = {}
        self.guard, self.number = threading.Lock(), 0
        self.query = read_stream(spark, path).writeStream.foreachBatch(self._forward).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()

    def subscribe(self, scan_id: int, sink: Callable[[DataFrame, int], None]) -> int:
        """The subscriber's number; it gets the events of its scan from now on."""
        with self.guard:
            self.number += 1
            number = self.number
            mine = self.subscribers[number] = Subscriber(self.spark, scan_id, sink, lambda: self.leave(number))
        if self.scans:
            mine.offer(terminal_events(self.scans().where(F.col("id") == scan_id)).select(EVENTS.names).collect())  # one, or none
        return number

    def leave(self, number: int) -> None:
        with self.guard:
            gone = self.subscribers.pop(number, None)
        if gone:
            gone.stop()

    def _forward(self, batch: DataFrame, number: int) -> None:
        with self.guard:
            mine = list(self.subscribers.values())
        wanted = sorted({s.scan_id for s in mine})
        if not wanted:
            return
        # of each scan what a ring can hold, whatever the batch
        order = Window.partitionBy("scan_id").orderBy(F.desc(F.col("type").isin(*TERMINAL)), F.desc("elapsed_ms"))
        last = batch.where(F.col("scan_id").isin(wanted)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= Subscriber.RING)
        events = last.orderBy("scan_id", F.desc("place")).select(EVENTS.names).collect()
        for s in mine:
            s.offer([e for e in events if e.scan_id == s.scan_id])

    def stop(self) -> None:
        self.query.stop()
        for number in list(self.subscribers):
            self.leave(number)


class Text(AccumulatorParam):
    """An accumulator that keeps the last text that was added."""

    def zero(self, value: str) -> str:
        return ""

    def addInPlace(self, a: str, b: str) -> str:  # noqa: N802
        return b or a


class Live:
    """What the tasks of a phase have done so far, as they tell when they end, for a ticker.

    A task that runs twice may tell twice: final numbers come from the tables.
    """

    def __init__(self, spark: SparkSession, counter: str):
        self.counter = counter
        self.total, self.path = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator("", Text())

    def teller(self) -> Callable[[str, int], None]:
        """For tasks: counts, and says where they are."""
        total, path = self.total, self.path

        def told(at: str, n: int) -> None:
            total.add(n)
            path.add(at)

        return told

    def now(self) -> dict:
        at = self.path.value
        return {self.counter: self.total.value} | ({"current_path": at} if at else {})


class Ticker:
    """Calls ``tell`` at a steady pace while the block runs."""

    def __init__(self, tell: Callable[[], None], seconds: float = 1.0):
        self.tell, self.seconds, self.over = tell, seconds, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.over.wait(self.seconds):
            self.tell()

    def __enter__(self) -> Ticker:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()


def emit(spark: SparkSession, path: str, event: dict) -> None:
    """Appends one event to the log: a file of one line in its scan's folder, renamed into place, without a Spark job."""
    row = {c: event.get(c, 0 if c in COUNTERS or c == "elapsed_ms" else "") for c in EVENTS.names}
    fs, make = _files(spark, path)
    folder = scan_folder(path, row["scan_id"])
    fs.mkdirs(make(folder))
    name = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.json"
    stream = fs.create(make(f"{folder}/_{name}"), True)  # names with an underscore aren't read
    stream.write(bytearray((json.dumps(row) + "\n").encode()))
    stream.close()
    fs.rename(make(f"{folder}/_{name}"), make(f"{folder}/{name}"))

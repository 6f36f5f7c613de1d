"""Progress events: latest state, JSON, terminal events and live streams."""

import json
import threading
import time

from dupescope.streaming import progress


def test_stream_stops_at_the_end(spark, tmp_path):
    log = str(tmp_path / "log")
    progress.emit(spark, log, {"type": "scan_started", "scan_id": 1, "phase": "walking"})
    progress.emit(spark, log, {"type": "progress", "scan_id": 2, "files_seen": 5, "elapsed_ms": 3})
    seen = []
    query = progress.subscribe(spark, log, 1, lambda batch, _: seen.extend(r.type for r in batch.collect()), str(tmp_path / "c"), "200 milliseconds")
    end = time.time() + 60
    while "scan_started" not in seen and time.time() < end:
        time.sleep(0.1)
    progress.emit(spark, log, {"type": "scan_completed", "scan_id": 1, "elapsed_ms": 10})
    query.awaitTermination(60)
    assert seen == ["scan_started", "scan_completed"] and not query.isActive


def test_replay_once_and_latest_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    for k in range(3):
        progress.emit(spark, log, {"type": "progress", "scan_id": 1, "elapsed_ms": k, "files_seen": k})
    seen = []
    progress.subscribe(spark, log, 1, lambda batch, _: seen.extend(r.elapsed_ms for r in batch.collect()), str(tmp_path / "c"), once=True).awaitTermination(60)
    assert sorted(seen) == [0, 1, 2]
    query = progress.latest_stream(progress.read_stream(spark, log)).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.scan_id, r.files_seen) for r in spark.table("latest").collect()] == [(1, 2)]


def test_json_leaves_empty_fields_out(spark):
    rows = spark.createDataFrame([("progress", 1, "", None, 5)], "type string, scan_id long, phase string, error string, elapsed_ms long")
    assert json.loads(rows.select(progress.event_json(rows, ("phase", "error"))).first()[0]) == {"type": "progress", "scan_id": 1, "elapsed_ms": 5}


def test_terminal_events(spark):
    rows = [(1, "completed", 0), (2, "failed", 5), (3, "interrupted", 7), (4, "running", None)]
    scans = spark.createDataFrame(rows, "id long, status string, ms long").selectExpr("id", "status", "timestamp_millis(0) AS started_at", "timestamp_millis(ms) AS finished_at", "'walking' AS phase", "'' AS error", *(f"0L AS {c}" for c in progress.COUNTERS))
    got = {r.scan_id: (r.type, r.elapsed_ms) for r in progress.terminal_events(scans).collect()}
    assert got == {1: ("scan_completed", 0), 2: ("scan_failed", 5), 3: ("scan_failed", 7)}


def test_hub_feeds_many_subscribers_from_one_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    progress.emit(spark, log, {"type": "scan_started", "scan_id": 3})
    hub = progress.Hub(spark, log, str(tmp_path / "c"), "100 milliseconds")
    one, two, other = [], [], []
    hub.subscribe(1, lambda batch, _: one.extend(r.elapsed_ms for r in batch.collect()))
    hub.subscribe(1, lambda batch, _: two.extend(r.elapsed_ms for r in batch.collect()))
    gone = hub.subscribe(1, lambda batch, _: other.append(0))
    hub.subscribe(2, lambda batch, _: other.extend(r.scan_id for r in batch.collect()))
    hub.leave(gone)
    try:
        for event in ({"type": "progress", "scan_id": 1, "elapsed_ms": 1}, {"type": "progress", "scan_id": 2}, {"type": "scan_completed", "scan_id": 1, "elapsed_ms": 2}):
            progress.emit(spark, log, event)
        end = time.time() + 60
        while (2 not in one or 2 not in two or not other) and time.time() < end:
            time.sleep(0.1)
    finally:
        hub.stop()
    assert sorted(one) == sorted(two) == [1, 2] and other == [2]
    assert hub.subscribers == {}


def scans_table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, status string, ms long").selectExpr("id", "status", "timestamp_millis(0) AS started_at", "timestamp_millis(ms) AS finished_at", "'walking' AS phase", "'' AS error", *(f"0L AS {c}" for c in progress.COUNTERS))


def wait(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.05)
    return condition()


def test_a_slow_subscriber_holds_up_nobody_and_loses_only_what_is_superseded(spark, tmp_path):
    log = str(tmp_path / "log")
    hub = progress.Hub(spark, log, str(tmp_path / "c"), "100 milliseconds")
    go, slow, fast = threading.Event(), [], []

    def hangs(batch, number):
        slow.extend((r.type, r.elapsed_ms) for r in batch.collect())
        go.wait(60)

    number = hub.subscribe(1, hangs)
    hub.subscribe(1, lambda batch, _: fast.extend((r.type, r.elapsed_ms) for r in batch.collect()))
    hung = hub.subscribers[number]
    try:
        for k in range(40):
            progress.emit(spark, log, {"type": "progress", "scan_id": 1, "elapsed_ms": k})
            if k == 0:
                assert wait(lambda: slow)
            if k % 4 == 0:
                assert wait(lambda k=k: fast and fast[-1][1] >= k)
        progress.emit(spark, log, {"type": "scan_completed", "scan_id": 1, "elapsed_ms": 99})
        assert wait(lambda: fast and fast[-1] == ("scan_completed", 99)) and len(slow) == 1
        go.set()
        assert wait(lambda: slow[-1] == ("scan_completed", 99)) and hung.dropped > 0 and len(slow) <= 1 + progress.Subscriber.RING
        assert wait(lambda: not hub.subscribers) and slow == sorted(slow, key=lambda e: e[1])
    finally:
        go.set()
        hub.stop()


def test_a_late_subscriber_gets_the_end_from_the_scans(spark, tmp_path):
    table = scans_table(spark, (1, "interrupted", 7), (2, "running", None))
    hub = progress.Hub(spark, str(tmp_path / "log"), str(tmp_path / "c"), "100 milliseconds", lambda: table)
    late, running, unknown = [], [], []
    try:
        hub.subscribe(1, lambda batch, _: late.extend((r.type, r.elapsed_ms) for r in batch.collect()))
        hub.subscribe(2, lambda batch, _: running.extend(r.type for r in batch.collect()))
        hub.subscribe(3, lambda batch, _: unknown.extend(r.type for r in batch.collect()))
        assert wait(lambda: late) and late == [("scan_failed", 7)] and wait(lambda: len(hub.subscribers) == 2)
        progress.emit(spark, str(tmp_path / "log"), {"type": "scan_completed", "scan_id": 2})
        assert wait(lambda: running) and running == ["scan_completed"] and not unknown
    finally:
        hub.stop()


def test_finished_scans_are_rolled_up_and_forgotten(spark, tmp_path):
    log = str(tmp_path / "log")
    for scan_id in range(1, 6):
        for k in range(6):
            progress.emit(spark, log, {"type": "progress", "scan_id": scan_id, "elapsed_ms": k})
    progress.roll_up(spark, log, [1, 2, 3, 4, 9], keep=3)
    assert progress.in_log(spark, log) == [5]
    assert [sorted(r.elapsed_ms for r in progress.read(spark, log, k).collect()) for k in range(1, 7)] == [[], *[list(range(6))] * 4, []]
    assert len(list(tmp_path.rglob("part-*.json"))) == 3 and {r.scan_id for r in progress.read(spark, log, 3).collect()} == {3}
    assert all("log-finished/scan-3/" in f for f in progress.read(spark, log, 3).inputFiles())  # one folder is opened


def test_counters_of_running_tasks(spark):
    live = progress.Live(spark, "bytes_hashed")
    told = live.teller()

    def work(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                told(f"/f{k}", 10)
            yield batch

    assert live.now() == {"bytes_hashed": 0}
    spark.range(8).repartition(4).mapInArrow(work, "id long").count()
    now = live.now()
    assert now["bytes_hashed"] == 80 and now["current_path"].startswith("/f")


def test_with_terminal(spark):
    events = spark.createDataFrame([("scan_completed", 1, 5), ("progress", 2, 1), ("progress", 4, 1)], "type string, scan_id long, elapsed_ms long")
    rows = [(1, "completed", 9), (2, "interrupted", 7), (4, "running", None)]
    scans = spark.createDataFrame(rows, "id long, status string, ms long").selectExpr("id", "status", "timestamp_millis(0) AS started_at", "timestamp_millis(ms) AS finished_at", "'walking' AS phase", "'' AS error", *(f"0L AS {c}" for c in progress.COUNTERS))
    assert sorted(map(tuple, progress.with_terminal(events, scans).collect())) == [("progress", 2, 1), ("progress", 4, 1), ("scan_completed", 1, 5), ("scan_failed", 2, 7)]

"""The diff as a stream against the diff of whole walks, with a restart in between."""

import random

from dupescope.operators import diff
from dupescope.streaming import snapshots

HOUR = 3600


def walk(rng, files):
    """What the next walk meets, after random changes."""
    out = dict(files)
    for name in list(out):
        if rng.random() < 0.2:
            del out[name]
        elif rng.random() < 0.3:
            out[name] = (rng.randrange(5), rng.randrange(3), 1, 1)
    for k in range(3):
        out[f"n{rng.randrange(40)}"] = (k, 0, 1, 1)
    return out


def test_equals_the_diff_of_walks(spark, tmp_path):
    rng = random.Random(2)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first = {f"f{i}": (rng.randrange(5), 0, 1, 1) for i in range(25)}
    walks = [first]
    for _ in range(3):
        walks.append(walk(rng, walks[-1] | {f"f{i}": (9, 9, 1, 1) for i in range(2)}))
    feed = str(tmp_path / "feed")
    stat = ", ".join(f"{c} long" for c in diff.STAT)

    def met(files, number):
        rows = [(1, name, *s, number * HOUR) for name, s in files.items()]
        frame = spark.createDataFrame(rows, f"root_id long, rel_path string, {stat}, s long").selectExpr("root_id", "rel_path", *diff.STAT, "timestamp_seconds(s) AS seen_at")
        frame.write.mode("append").parquet(feed)

    known = spark.createDataFrame([(1, f"f{i}", 1, 0, 1, 1, "missing" if i % 2 else "present", 0) for i in range(20, 30)], f"root_id long, rel_path string, {stat}, status string, s long").selectExpr("root_id", "rel_path", *diff.STAT, "status", "timestamp_seconds(s) AS seen_at")
    status = {r.rel_path: (tuple(r[c] for c in diff.STAT), r.status) for r in known.collect()}
    told = []
    for number, files in enumerate(walks, 1):
        met(files, number)
        # a new query each time, from the checkpoint
        stream = snapshots.changes(snapshots.read_walks(spark, feed), HOUR // 2, known)
        run(stream, tmp_path, told)
        # what the same walk says when it is compared as a whole
        table = [(1, name, *s, st, 0) for name, (s, st) in status.items()]
        old = spark.createDataFrame(table, f"root_id long, rel_path string, {stat}, status string, id long")
        new = spark.createDataFrame([(1, name, *s) for name, s in files.items()], f"root_id long, rel_path string, {stat}")
        expected = {(r.rel_path, r.change_type) for r in diff.classify(old, new).collect() if r.change_type not in ("unchanged", "gone")}
        assert set(told) == expected, number
        told.clear()
        status = {name: (s, "missing") for name, (s, _) in status.items()} | {name: (s, "present") for name, s in files.items()}
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, tmp_path, told):
    take = lambda batch, _: told.extend((r.rel_path, r.change_type) for r in batch.collect())
    query = stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None

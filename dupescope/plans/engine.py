"""The engine: roots, scans, duplicates and progress over one store."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..operators import browse, candidates, diff, hashing, regroup, rescan
from ..schema import COUNTERS, FILES, GROUP_PARTS, GROUPS, INSTANCES, ROOTS, SCANS, EngineConfig
from ..sources import fswalk
from ..streaming import progress
from . import lifecycle
from .store import Changes, Parts, Store, folders

NOW = F.current_timestamp
MOST_HASH_TASKS = 10_000


class Engine:
    """All operations of the application, on versioned tables below ``home``.

    ``home`` must be a folder that driver and executors share.
    """

    def __init__(self, spark: SparkSession, home: str, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.store = Store(spark, home)
        self.event_path = f"{self.store.home}/events"
        self._summary: tuple[tuple, dict] | None = None
        #: what the tasks of the running phase tell
        self._live: progress.Live | None = None

    # -- tables

    def roots(self) -> DataFrame:
        return lifecycle.by_added(lifecycle.migrated_roots(self.store.read("roots", ROOTS)))

    def scans(self) -> DataFrame:
        return self.store.read("scans", SCANS)

    def files(self) -> DataFrame:
        return self.store.read("files", FILES)

    def groups(self) -> DataFrame:
        return self.store.read("groups", GROUPS)

    def scan_of(self, scan_id: int) -> DataFrame:
        """One scan, or no row."""
        return lifecycle.by_id(self.scans(), scan_id)

    def scan_roots(self, scan_id: int) -> DataFrame:
        """The roots that a scan covered."""
        return lifecycle.scan_roots(self.scan_of(scan_id), self.store.read("roots", ROOTS))

    def root_of(self, root_id: int) -> DataFrame:
        """One root, or no row."""
        return lifecycle.by_id(lifecycle.migrated_roots(self.store.read("roots", ROOTS)), root_id)

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces a small table by what ``change`` makes of its current version."""
        schema = {"roots": ROOTS, "scans": SCANS}[name]
        self.store.update(lambda base: {name: change(self.store.read(name, schema, base))})

    # -- roots

    def _append_roots(self, rows: Iterable[tuple[str, str]], source: str) -> list[int]:
        new: list[tuple[int, str, str]] = []

        def build(base: dict[str, str]) -> dict[str, DataFrame]:
            now = self.store.read("roots", ROOTS, base)
            taken = {r.path for r in now.select("path").collect()}  # a handful of roots
            first = (now.agg(F.max("id")).first()[0] or 0) + 1
            new[:] = [(first + k, path, label) for k, (path, label) in enumerate(r for r in dict.fromkeys(rows) if r[0] not in taken)]
            if not new:
                return {}
            added = self.spark.createDataFrame(new, "id long, path string, label string").select("id", "path", "label", NOW().alias("added_at"), F.lit(True).alias("enabled"), F.lit(source).alias("source"))
            return {"roots": now.unionByName(added)}

        rows = list(rows)
        self.store.update(build)
        return [i for i, _, _ in new]

    def add_root(self, path: str, label: str = "") -> int:
        row = lifecycle.cleaned(self.spark.createDataFrame([(path, label)], "path string, label string")).first()
        if row is None:
            raise ValueError("a root needs a path")
        added = self._append_roots([(row.path, row.label)], "manual")
        if not added:
            raise ValueError(f"already a root: {row.path}")
        return added[0]

    def discover_roots(self, base: str) -> list[int]:
        """Registers the sub-directories of ``base`` that no root has."""
        found = fswalk.subdirectories(base)
        if not found:
            return []
        listing = self.spark.createDataFrame([(p,) for p in found], "path string")
        new = sorted(r.path for r in lifecycle.undiscovered(listing, self.store.read("roots", ROOTS)).collect())
        return self._append_roots([(p, os.path.basename(p)) for p in new], "auto")

    def toggle_root(self, root_id: int, enabled: bool | None = None) -> None:
        self._change("roots", lambda roots: lifecycle.toggled(roots, root_id, enabled))

    def delete_root(self, root_id: int) -> None:
        """Removes a root with its files and the groups that they made, all published at once; refused during a scan or recheck."""
        self.store.lock()
        try:
            self._ready()

            def build(base: dict) -> dict:
                mine = self.store.read("files", FILES, base, [root_id])
                was = mine.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in FILES), F.struct(*FILES.names).alias("was"))
                lost = regroup.contributions(was)
                roots = lifecycle.without_root(self.store.read("roots", ROOTS, base), root_id, "id")
                return {"roots": roots, "files": Parts(None, "root_id", [], gone=[root_id]), "instances": Changes(lost, "part")} | self._grouped(base, lost)

            self.store.update(build)
        finally:
            self.store.unlock()

    # -- groups

    def _ready(self) -> None:
        """Makes the instances that the groups are kept from, where a store of before has none."""
        now = self.store.versions()
        if any(k.startswith("files/") for k in now) and not any(k.startswith("instances/") for k in now):
            self.rebuild_groups()

    def rebuild_groups(self) -> None:
        """Instances and groups from scratch, from all files."""
        parts = range(GROUP_PARTS)

        def build(base: dict) -> dict:
            held = regroup.instances(self.store.read("files", FILES, base))
            found = regroup.groups_of(held).withColumn("part", regroup.part_of(F.col("size")))
            return {"instances": Parts(held, "part", parts), "groups": Parts(found, "part", parts), "pending": None}

        self.store.update(build)

    def _grouped(self, base: dict, more: DataFrame | None = None) -> dict:
        """The groups of all keys that changes of instances have touched since the last time, and those of ``more``, a change not yet stored.

        Only the parts of these keys are read, and only their groups are written.
        """
        noted = [self.spark.read.schema(INSTANCES).parquet(f"{self.store.home}/{f}") for f in folders(base.get("pending"))]
        if not noted and more is None:
            return {}
        touched = noted + ([] if more is None else [more.select(INSTANCES.names)])
        keys = reduce(DataFrame.union, (t.select("size", "full_hash") for t in touched)).distinct()
        parts = [r.part for r in keys.select(regroup.part_of(F.col("size")).alias("part")).distinct().collect()]  # GROUP_PARTS at most
        held = self.store.read("instances", INSTANCES, base, parts)
        if more is not None:
            held = held.unionByName(more.select(INSTANCES.names)).groupBy(*regroup.INSTANCE).agg(F.sum("paths").alias("paths"))
        return {"groups": Changes(regroup.regrouped(held, keys, self.store.read("groups", GROUPS, base, parts)), "part"), "pending": None}

    def _fold(self) -> None:
        """Folds what changes have piled up."""
        for name, schema in (("files", FILES), ("instances", INSTANCES), ("groups", GROUPS)):
            self.store.fold(name, schema)

    # -- scans

    def recover(self) -> None:
        """At start-up: marks what was running as interrupted, tells its subscribers, and frees the lock."""
        running = [r.id for r in self.scans().where("status = 'running'").select("id").collect()]  # one at most, in practice
        self._change("scans", lambda scans: lifecycle.interrupted(scans, NOW()))
        for event in progress.terminal_events(self.scans().where(F.col("id").isin(running))).collect() if running else []:
            progress.emit(self.spark, self.event_path, event.asDict())
        self.store.unlock(force=True)

    def current_scan(self) -> DataFrame:
        return lifecycle.current(self.scans())

    def history(self, n: int = 50) -> DataFrame:
        return lifecycle.history(self.scans(), n)

    def scan(self, root_id: int | None = None) -> int:
        """Walks the enabled roots (or one), hashes candidates and rebuilds the groups; returns the scan's id.

        One at a time.  A root that is missing fails the scan before its files are compared;
        roots walked before stay committed, and the last groups stay published.
        """
        targets = [(r.id, r.path) for r in lifecycle.enabled_targets(self.store.read("roots", ROOTS), root_id).orderBy("id").collect()]
        if not targets:
            raise ValueError("no enabled root to scan")
        self.store.lock()
        try:
            return self._scan(targets)
        finally:
            self.store.unlock()

    def _scan(self, targets: list[tuple[int, str]]) -> int:
        self.roll_up_events()
        scans, began = self.scans(), time.monotonic()
        scan_id = (scans.agg(F.max("id")).first()[0] or 0) + 1
        started = lifecycle.started(self.spark, scan_id, [i for i, _ in targets], NOW())
        self._change("scans", lambda now: now.unionByName(started))
        counts = dict.fromkeys(COUNTERS, 0)
        state = {"phase": "walking", "current_path": ""}
        self._live = None

        def tell(kind: str, error: str = "") -> None:
            live = self._live
            now = live.now() if live and kind == "progress" else {}
            shown = state | counts | {k: v + counts.get(k, 0) if k in counts else v for k, v in now.items()}
            progress.emit(self.spark, self.event_path, {"type": kind, "scan_id": scan_id, "error": error, "elapsed_ms": int((time.monotonic() - began) * 1000)} | shown)

        def tick() -> None:
            self.store.renew()
            tell("progress")

        def enter(phase: str) -> None:
            state.update(phase=phase, current_path="")
            self._change("scans", lambda now: lifecycle.with_counters(now, scan_id, phase, counts))
            tell("progress")

        tell("scan_started")
        try:
            with progress.Ticker(tick, self.config.tick_seconds):
                for root_id, path in targets:
                    state["current_path"] = path
                    self._live = progress.Live(self.spark, "files_seen")
                    done = self._walk(scan_id, root_id, path)
                    self._live = None
                    for name, n in done.items():
                        counts[name] += n
                enter("hashing")
                for stage in (hashing.sample_stage(self.config.sample_size), hashing.whole_stage(self.config.hash_chunk)):
                    self._live = progress.Live(self.spark, "bytes_hashed")
                    done = self._hash(stage)
                    self._live = None
                    counts["bytes_hashed"] += done
                enter("finalizing")
                self.store.update(self._grouped)
                self._fold()
        except Exception as e:
            error = str(e)[:500]
            self._change("scans", lambda now: lifecycle.finished(now, scan_id, "failed", error, NOW()))
            tell("scan_failed", error)
            raise
        self._change("scans", lambda now: lifecycle.finished(now, scan_id, "completed", "", NOW()))
        tell("scan_completed")
        return scan_id

    def _walk(self, scan_id: int, root_id: int, path: str) -> dict[str, int]:
        """Compares one root with its known files and publishes what has changed.

        Of what the walk finds only changed rows are written; counters of the others are observed
        on the way.
        """
        fswalk.check_root(path)
        self._ready()
        base = self.store.versions()
        with self._folder("walk") as folder:
            found = fswalk.walk(self.spark, [(root_id, path)], folder, self.config.walk_partitions, self._live.teller() if self._live else None)
            return self._compared(scan_id, root_id, base, found)

    def _compared(self, scan_id: int, root_id: int, base: dict, found: DataFrame) -> dict[str, int]:
        """The walk's counters; what it changes is published."""
        seen = Observation()
        classified = diff.classify(self.store.read("files", FILES, base, [root_id]), found, keep=True)
        classified = classified.observe(seen, *diff.counts())
        next_id = (self.store.read("files", FILES, base).agg(F.max("id")).first()[0] or 0) + 1
        with self._temporary("walk", diff.changes(classified, scan_id, self._now(), next_id)) as changed:
            counts = {c: int(seen.get[c] or 0) for c in COUNTERS if c in seen.get}
            self._publish_changes(changed)
        return counts

    @contextmanager
    def _folder(self, name: str) -> Iterator[str]:
        """A folder below home while the block runs."""
        folder = f"temporary/{name}-{uuid.uuid4().hex[:8]}"
        try:
            yield f"{self.store.home}/{folder}"
        finally:
            self.store.drop(folder)

    @contextmanager
    def _temporary(self, name: str, frame: DataFrame) -> Iterator[DataFrame]:
        """``frame`` as a table below home while the block runs."""
        with self._folder(name) as folder:
            frame.write.parquet(folder)
            yield self.spark.read.schema(frame.schema).parquet(folder)

    def _publish_changes(self, changed: DataFrame, regroup_now: bool = False) -> None:
        """Adds rows of files (with ``was``, the row before), a written table, to their roots, and what they mean for instances; groups follow now or with the next scan's end."""
        if changed.limit(1).count() == 0:
            return

        def build(base: dict) -> dict:
            moved = regroup.contributions(changed)
            out = {"files": Changes(changed.select(FILES.names), "root_id"), "instances": Changes(moved, "part", None if regroup_now else "pending")}
            return out | (self._grouped(base, moved) if regroup_now else {})

        self.store.update(build)

    def _hash(self, stage: hashing.HashStage) -> int:
        """One hashing stage over all roots: candidates, hashes in a table of their own, changed rows of the roots concerned; bytes read."""
        files = self.files()
        if stage.column == "partial_hash":
            due = candidates.size_candidates(files).where(candidates.needs_sample(self.config.reuse_partial))
            due = due.unionByName(candidates.half_hashed(files).select(due.columns))
        else:
            due = candidates.partial_candidates(files)
        roots = F.broadcast(self.store.read("roots", ROOTS).select(F.col("id").alias("root_id"), "path"))  # roots are entered by hand: a handful
        due = due.join(roots, "root_id").select("id", "root_id", paths.absolute(F.col("path"), F.col("rel_path")).alias("abs_path"), "size")
        with self._temporary("due", due) as due:
            cost = due.agg(F.coalesce(F.sum(stage.cost(F.col("size")).cast("double")), F.lit(0.0))).first()[0]
            # so many tasks that progress shows, and that a lost one costs little
            tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_HASH_TASKS, int(cost // self.config.hash_task_bytes) + 1))
            return self._hashed(files, due, stage, tasks)

    def _hashed(self, files: DataFrame, due: DataFrame, stage: hashing.HashStage, tasks: int) -> int:
        """Hashes the files that are due and publishes the hashes; bytes read."""
        told = self._live.teller() if self._live else None
        with self._temporary(stage.column, hashing.hash_files(due, stage, tasks, told)) as results:
            good = results.where("hash IS NOT NULL")
            read = good.agg(F.coalesce(F.sum(stage.cost(F.col("size"))), F.lit(0))).first()[0]
            with self._temporary("hashed", diff.hash_changes(files, good, stage.column)) as changed:
                self._publish_changes(changed)
        return int(read)

    # -- duplicates

    def duplicates(self, **filters) -> DataFrame:  # noqa: ANN003
        by = browse.DuplicateFilter(**{"page_size": self.config.page_size} | filters)
        return browse.page(self.groups(), self.files(), by)

    def duplicate_pages(self, **filters) -> DataFrame:  # noqa: ANN003
        return browse.page_info(self.groups(), self.files(), browse.DuplicateFilter(**{"page_size": self.config.page_size} | filters))

    def detail(self, size: int, full_hash: str) -> DataFrame:
        return browse.detail(self.files(), self.groups(), self.roots(), size, full_hash)

    def rescan(self, size: int, full_hash: str) -> dict:
        """Rechecks one group: what became of its members, and the repaired groups."""
        self.store.lock()
        try:
            return self._rescan(size, full_hash)
        finally:
            self.store.unlock()

    def _rescan(self, size: int, full_hash: str) -> dict:
        files = self.files()
        key = (F.col("size") == size) & (F.col("full_hash") == full_hash)
        if not self.groups().where(key).limit(1).count():
            return {"exists": False, "checked": 0, "missing": 0, "changed": 0, "errors": 0, "unchanged": 0}
        roots = F.broadcast(self.store.read("roots", ROOTS).select(F.col("id").alias("root_id"), "path"))  # entered by hand: a handful
        mine = files.where(key & (F.col("status") == "present")).join(roots, "root_id").withColumn("abs_path", paths.absolute(F.col("path"), F.col("rel_path")))
        self._ready()
        with self._temporary("rescan", rescan.check_files(mine, self.config.hash_chunk)) as outcomes:
            counts = rescan.outcome_counts(outcomes).first().asDict()
            with self._temporary("patched", rescan.patches(files, outcomes, self._now())) as changed:
                self._publish_changes(changed, regroup_now=True)
        return {"exists": bool(self.groups().where(key).limit(1).count())} | counts

    def _now(self) -> Column:
        """One time for frames that are evaluated more than once."""
        return F.lit(self.spark.range(1).select(NOW()).first()[0])

    def summary(self) -> dict:
        """Totals, remembered as long as the tables are the same."""
        at = self.store.versions()
        version = tuple(sorted((k, v) for k, v in at.items() if k.partition("/")[0] in ("files", "groups")))
        if self._summary is None or self._summary[0] != version:
            self._summary = version, browse.summary_files(self.files()).first().asDict() | browse.summary_groups(self.groups()).first().asDict()
        return self._summary[1]

    def dashboard(self) -> dict:
        return {"roots": self.roots(), "summary": self.summary(), "scans": self.history(5), "current": self.current_scan()}

    def events(self, scan_id: int) -> DataFrame:
        """Events of a scan so far, as a batch; a finished scan always has its terminal event."""
        return progress.of_scan(progress.with_terminal(progress.read(self.spark, self.event_path, scan_id), self.scan_of(scan_id)), scan_id)

    def hub(self, checkpoint: str, interval: str = "1 second") -> progress.Hub:
        """One stream over the log for any number of subscribers, of running scans and of finished ones."""
        return progress.Hub(self.spark, self.event_path, checkpoint, interval, self.scans)

    def roll_up_events(self, seconds: float = 60.0) -> None:
        """Puts the events of scans that ended ``seconds`` ago or earlier into one file each; a scan does so when it begins."""
        there = progress.in_log(self.spark, self.event_path)
        if there:
            over = self.scans().where(F.col("id").isin(there) & F.expr(f"finished_at < current_timestamp() - INTERVAL {int(seconds)} SECONDS"))
            progress.roll_up(self.spark, self.event_path, sorted(r.id for r in over.select("id").collect()), self.config.kept_logs)

    def subscribe(self, scan_id: int, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second") -> StreamingQuery | None:
        """Feeds a scan's events to ``sink``.

        A scan that is over gets its terminal event at once and no stream, as does one that
        isn't known, which has none.  The status is read before the log is followed, and the
        log is followed from its start, so that an end in between isn't missed.
        """
        state = self.scan_of(scan_id).first()
        if state is None or state.status != "running":
            sink(progress.terminal_events(self.scan_of(scan_id)).select(progress.EVENTS.names), 0)
            return None
        return progress.subscribe(self.spark, self.event_path, scan_id, sink, checkpoint, interval)

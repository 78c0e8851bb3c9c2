"""From log files to published sessions and messages, in batch or as appends arrive."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.fold import STATE_VERSION, fold_on
from strandline.runtime import counted, materialize, scratch
from strandline.sources.logs import list_logs, read_logs
from strandline.streaming.store import SnapshotStore, changes, removed_files

PARSER_VERSION = "2"
#: Lines of a log that the quick phase reads, at most.
HEAD_LINES = 210
#: Codes of failures that come of a log being written to: it is tried again with the next build.
RACED = ("source_changed", "partial_frame", "invalid_offset")


def _sessions(folded: DataFrame, facts: DataFrame) -> DataFrame:
    workspace = F.coalesce(F.nullif("workspace", F.lit("")), F.regexp_extract("file", "^(.*)/[^/]*$", 1))
    return folded.join(facts.select("file", "size", "mtime_ms", "ctime_ms"), "file").withColumn("workspace", workspace)


def _plan(spark: SparkSession, root: str, store: SnapshotStore, force: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state of each file, what is to be read from which offset on, unreadable folders)."""
    on_disk, errors = list_logs(spark, root)
    known = store.read("sessions")
    if known is None:
        known = spark.createDataFrame([], "file string, size bigint, mtime_ms double, ctime_ms double")
    changed = materialize(changes(on_disk, known, force), "changes")
    todo = on_disk.join(changed.where(F.col("state").isin("added", "updated")), "file")
    checks, states = store.read("checkpoints"), store.read("folds")
    if checks is None or states is None or force:
        return changed, materialize(todo.withColumns({"offset": F.lit(0).cast("long"), "first_line": F.lit(0).cast("long")}), "todo", F.lit(True)), errors
    base = checks.where(F.col("parser_version") == PARSER_VERSION).select("file", F.col("size").alias("c_size"), "end_offset", F.col("lines").alias("c_lines"))
    base = base.join(states.where(F.col("state_version") == STATE_VERSION).select("file"), "file", "left_semi")
    grown = F.coalesce((F.col("size") > F.col("c_size")) & (F.col("size") >= F.col("end_offset")), F.lit(False))
    todo = todo.join(base, "file", "left").withColumns({"offset": F.when(grown, F.col("end_offset")).otherwise(0), "first_line": F.when(grown, F.col("c_lines")).otherwise(0)})
    return changed, materialize(todo.drop("c_size", "end_offset", "c_lines"), "todo", F.lit(True)), errors


def build(spark: SparkSession, root: str, store: SnapshotStore, force: bool = False, limits: dict | None = None, extra_types: frozenset[str] = frozenset(), batch: int | None = None) -> dict:
    """Reconcile the store with the logs under root; a report of what was added, updated, skipped, removed, raced and failed.

    Only changed files are opened. One that grew is read from where the last build ended and folded on from the state it left;
    if that fails (the log was rewritten, or a replacement reaches back in a way the state can't tell), it is read whole. A log
    that fails keeps what was published of it and is tried again with the next build. Of the tables only the buckets of changed
    files are rewritten. limits are those of sources.logs.read_logs.
    """
    with scratch():
        changed, todo, errors = _plan(spark, root, store, force)
        complete = errors.limit(1).count() == 0
        removed = removed_files(changed, complete)
        states = store.read("folds")
        ahead = todo.where("offset > 0")
        known = states.join(ahead.select("file"), "file", "left_semi") if states is not None else None
        sessions, messages, folds = fold_on(read_logs(todo, **(limits or {})), known, extra_types=extra_types, keep=True)
        again = materialize(sessions.where("not ok").join(ahead.select("file"), "file", "left_semi").select("file"), "again", F.lit(True))
        if counted(again):
            whole = todo.join(again, "file").withColumns({"offset": F.lit(0).cast("long"), "first_line": F.lit(0).cast("long")})
            parts = fold_on(read_logs(whole, **(limits or {})), None, extra_types=extra_types, keep=True)
            key = {0: "file", 1: "session_file", 2: "file"}
            sessions, messages, folds = (x.join(again.select(F.col("file").alias(key[i])), key[i], "left_anti").unionByName(y) for i, (x, y) in enumerate(zip((sessions, messages, folds), parts)))
        good = sessions.where("ok")
        failed = materialize(sessions.where("not ok").select("file", "error", "error_code", "error_phase", "retryable"), "failed", F.col("error_code").isin(*RACED))
        fresh = _sessions(good, todo).drop("ok", "error", "error_code", "error_phase", "retryable", "lines")
        fresh = fresh.withColumn("detail_missing", F.lit(False))
        gone = good.select("file").union(removed)
        checks = good.join(todo.select("file", "size", "mtime_ms", "ctime_ms"), "file").select("file", "size", "mtime_ms", "ctime_ms", "end_offset", "lines", "last_seq", F.lit(PARSER_VERSION).alias("parser_version"), F.col("indexed_messages").alias("message_count"), "complete")
        facts = todo.agg(F.sum(F.col("size") - F.col("offset")).alias("bytes"), F.count_if(F.col("offset") > 0).alias("delta")).head()
        states = {r["state"]: r["count"] for r in changed.groupBy("state").count().collect()}
        report = {s: states.get(s, 0) for s in ("added", "updated", "skipped")} | {
            "removed": removed.count(), "failed": failed.count(), "raced": counted(failed), "delta": facts["delta"] - counted(again), "reread": counted(again), "bytes": facts["bytes"] or 0,
            "complete": complete, "errors": [r["error"] for r in errors.orderBy("error").limit(20).collect()],
        }
        messages = messages.withColumn("id", F.xxhash64("session_file", "anchor_id", "event_seq", "role", "tool_name"))
        store.upsert({"sessions": (fresh, gone), "messages": (messages, gone), "checkpoints": (checks, gone), "folds": (folds, gone), "failures": (failed, gone.union(failed.select("file")))}, batch=batch, state={"report": report})
    return report


def quick(spark: SparkSession, root: str, store: SnapshotStore) -> dict:
    """First phase of a build: sessions of new logs from their first lines alone, to be listed at once.

    Their details are missing, so the next build reads them whole.
    """
    with scratch():
        changed, todo, _ = _plan(spark, root, store, False)
        fresh = todo.join(changed.where("state = 'added'").select("file"), "file", "left_semi")
        sessions, _, _ = fold_on(read_logs(fresh, head=HEAD_LINES), None)
        rows = _sessions(sessions.where("id is not null"), todo).drop("ok", "error", "error_code", "error_phase", "retryable", "lines").withColumn("detail_missing", F.lit(True))
        rows = materialize(rows, "quick", F.lit(True))
        store.upsert({"sessions": (rows, rows.select("file"))})
        return {"listed": counted(rows)}


class Follower:
    """Keeps a store up with the logs under root: one build at a time, soon after the logs have come to rest.

    The folder is listed every poll seconds. Changes are awaited for debounce seconds more, until a listing shows no further
    one, but no longer than max_wait; requests that come during a build are one build after it. Where the last file offsets and
    the fold states lie is the store, so a new follower goes on where the last one ended, and a build that was cut off is done
    again: its version was never named.
    """

    def __init__(self, spark: SparkSession, root: str, store: SnapshotStore, poll: float = 5.0, debounce: float = 2.0, max_wait: float = 30.0, **options):  # noqa: ANN003
        self.spark, self.root, self.store, self.options = spark, root, store, options
        self.poll, self.debounce, self.max_wait = poll, debounce, max_wait
        self.last: dict | None = None
        self.error: Exception | None = None
        self._stop, self._wanted, self._one = threading.Event(), threading.Event(), threading.Lock()
        self._thread: threading.Thread | None = None

    @property
    def running(self) -> bool:
        return self._one.locked()

    def step(self) -> dict:
        """One build; a second caller waits for it and then has its own."""
        with self._one:
            self.last = build(self.spark, self.root, self.store, **({"limits": {"trim": True}} | self.options))
        return self.last

    def request(self) -> None:
        """Ask for a build without waiting for changes."""
        self._wanted.set()

    def _mark(self) -> int:
        with scratch():
            files, _ = list_logs(self.spark, self.root)
            return files.agg(F.bit_xor(F.xxhash64("file", "size", "mtime_ms", "ctime_ms"))).head()[0] or 0

    def _run(self) -> None:
        seen = None
        while not self._stop.is_set():
            try:
                asked = self._wanted.is_set()
                self._wanted.clear()
                mark = self._mark()
                if asked or mark != seen:
                    until = time.monotonic() + self.max_wait
                    while not self._stop.wait(self.debounce) and time.monotonic() < until and (after := self._mark()) != mark:
                        mark = after
                    if not self._stop.is_set():
                        self.step()
                        seen = mark
                self.error = None
            except Exception as e:  # noqa: BLE001  the next round tries again
                self.error = e
            self._wanted.wait(self.poll) if not self._stop.is_set() else None

    def start(self) -> Follower:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._wanted.set()
        if self._thread is not None:
            self._thread.join()


def follow(spark: SparkSession, root: str, store: SnapshotStore, **options) -> Follower:  # noqa: ANN003
    """A running Follower."""
    return Follower(spark, root, store, **options).start()

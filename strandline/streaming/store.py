"""Versioned snapshots of the derived tables, swapped by one pointer."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.listing import retained

#: Buckets that a table's files are kept in, by a hash of the log file: an upsert rewrites the buckets that it touches.
BUCKETS = 16


class SnapshotStore:
    """Tables under root/v<N>/<table>/bucket=<b>; the file root/_CURRENT names the folders that make up the snapshot in force.

    A version holds the buckets that were rewritten for it; all others stay where they are. It is written whole, read back and
    counted before the pointer is renamed over, so readers have one snapshot of all tables or the other; tables that a version
    doesn't give are carried over. Folders that neither the current nor the last snapshot names are deleted. Writers are few (one
    publish at a time per root, as a follower is); readers need no lock.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _text(self, path: str) -> str | None:
        p = self._path(path)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # noqa: SLF001
        finally:
            stream.close()

    def _replace(self, path: str, text: str) -> None:
        temp, target = self._path(path + ".tmp"), self._path(path)
        stream = self.fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE  # noqa: SLF001
        gateway = self.spark.sparkContext._gateway  # noqa: SLF001
        flags = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
        flags[0] = overwrite
        context.rename(temp, target, flags)

    def current(self) -> dict:
        """{version, tables, parts, schemas, batch, state} of the snapshot in force; version 0 has no tables."""
        text = self._text(f"{self.root}/_CURRENT")
        return json.loads(text) if text else {"version": 0, "tables": {}, "parts": {}, "schemas": {}, "batch": -1, "state": {}, "last": []}

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A table of the snapshot in force, or only some of its buckets; None where there is no such table."""
        now = self.current()
        if name not in now["tables"]:
            return None
        schema = T.StructType.fromJson(now["schemas"][name])
        paths = [f"{self.root}/v{v}/{name}/bucket={b}" for b, (v, _) in now["parts"][name].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, df: DataFrame) -> Column:
        key = next((c for c in ("session_file", "file") if c in df.columns), None)
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int") if key else F.lit(0)

    def publish(self, tables: dict[str, DataFrame], batch: int | None = None, state: dict | None = None) -> dict:
        """Make these tables, whole, part of the next snapshot. A batch at or before the current one is already in: no change."""
        return self._publish({name: (df, None) for name, df in tables.items()}, batch, state)

    def upsert(self, tables: dict[str, tuple[DataFrame, DataFrame]], batch: int | None = None, state: dict | None = None) -> dict:
        """For each table (rows, files): take out what it holds of those files (column file) and put in the rows."""
        return self._publish(tables, batch, state)

    def _publish(self, tables: dict[str, tuple[DataFrame, DataFrame | None]], batch: int | None, state: dict | None) -> dict:
        now = self.current()
        if batch is not None and batch <= now["batch"]:
            return now
        version = now["version"] + 1
        base = f"{self.root}/v{version}"
        self.fs.delete(self._path(base), True)
        parts, schemas = {n: dict(p) for n, p in now["parts"].items()}, dict(now["schemas"])
        for name, (df, files) in tables.items():
            touched = None
            if files is not None and name in now["tables"]:
                key = next(c for c in ("session_file", "file") if c in df.columns)
                files = files.select(F.col("file").alias(key)).distinct()
                touched = {r[0] for r in files.select(self._bucket(files)).union(df.select(self._bucket(df))).distinct().collect()}
                old = self.read(name, touched)
                df = old.join(files, key, "left_anti").unionByName(df, allowMissingColumns=True)
            df.withColumn("bucket", self._bucket(df)).write.partitionBy("bucket").parquet(f"{base}/{name}")
            written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{base}/{name}")
            fresh = {str(r["bucket"]): [version, r["count"]] for r in written.groupBy("bucket").count().collect()}
            kept = {b: p for b, p in parts.get(name, {}).items() if touched is not None and int(b) not in touched}
            parts[name], schemas[name] = kept | fresh, df.schema.jsonValue()
        counts = {name: sum(n for _, n in p.values()) for name, p in parts.items()}
        used = sorted({v for p in now["parts"].values() for v, _ in p.values()})
        after = {"version": version, "tables": counts, "parts": parts, "schemas": schemas, "batch": now["batch"] if batch is None else batch, "state": now["state"] | (state or {}) | {"published_ms": int(time.time() * 1000)}, "last": used}
        self._replace(f"{self.root}/_CURRENT", json.dumps(after))
        named = {v for p in parts.values() for v, _ in p.values()} | set(used)
        for old in set(now["last"]) - named:
            self.fs.delete(self._path(f"{self.root}/v{old}"), True)
        return after

    def health(self) -> dict:
        now = self.current()
        return {"version": now["version"], "batch": now["batch"], **{f"{k}_rows": n for k, n in now["tables"].items()}, **now["state"]}


def replace_files(old: DataFrame | None, new: DataFrame, key: str = "file", removed: DataFrame | None = None) -> DataFrame:
    """old without the rows of files that are in new (or removed), and new: an idempotent upsert by file."""
    if old is None:
        return new
    gone = new.select(key).distinct()
    if removed is not None:
        gone = gone.union(removed.select(F.col("file").alias(key))).distinct()
    return old.join(gone, key, "left_anti").unionByName(new, allowMissingColumns=True)


def changes(scan: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """(file, state) of each file on either side: added, updated, skipped or removed.

    A known file is skipped if size and both times are equal and nothing of it is missing or dirty.
    """
    a = scan.select("file", *(F.col(c).alias(f"new_{c}") for c in ("size", "mtime_ms", "ctime_ms")), F.lit(True).alias("there"))
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("detail_missing", "fts_dirty") if c in known.columns]
    dirty = F.lit(False)
    for f in flags:
        dirty = dirty | f
    b = known.select("file", "size", "mtime_ms", "ctime_ms", dirty.alias("dirty"), F.lit(True).alias("was"))
    same = F.col("ctime_ms").isNotNull() & F.lit(not force) & ~F.col("dirty")
    for c in ("size", "mtime_ms", "ctime_ms"):
        same = same & (F.col(c) == F.col(f"new_{c}"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("there").isNull(), "removed").when(same, "skipped").otherwise("updated")
    return a.join(b, "file", "full").select("file", state.alias("state"))


def removed_files(changed: DataFrame, scan_complete: bool) -> DataFrame:
    """Files that are gone; an incomplete scan proves no deletion."""
    return changed.where((F.col("state") == "removed") & F.lit(scan_complete)).select("file")


def orphans(indexed: DataFrame, known: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Indexed files that neither the index nor the disk has."""
    return indexed.select("file").distinct().join(known.select("file").union(on_disk.select("file")).distinct(), "file", "left_anti")


def indexed_files(*tables: DataFrame) -> DataFrame:
    """The distinct files that any of the tables (column file) names."""
    out = tables[0].select("file")
    for t in tables[1:]:
        out = out.union(t.select("file"))
    return out.distinct()


def stale(sessions: DataFrame, checkpoints: DataFrame, messages: DataFrame, parser_version: str) -> DataFrame:
    """Files whose index can't be trusted: dirty, no checkpoint, another parser or source, or another number of messages."""
    counted = messages.groupBy(F.col("session_file").alias("file")).agg(F.count("*").alias("n"))
    c = checkpoints.select("file", F.col("size").alias("c_size"), F.col("mtime_ms").alias("c_mtime"), F.col("ctime_ms").alias("c_ctime"), "parser_version", "message_count")
    rows = sessions.join(c, "file", "left").join(counted, "file", "left")
    intact = F.col("size").eqNullSafe(F.col("c_size")) & F.col("mtime_ms").eqNullSafe(F.col("c_mtime")) & F.col("ctime_ms").eqNullSafe(F.col("c_ctime")) & (F.col("parser_version") == parser_version) & (F.col("message_count") == F.coalesce("n", F.lit(0)))
    dirty = F.coalesce("fts_dirty", F.lit(False)) if "fts_dirty" in sessions.columns else F.lit(False)
    return rows.where(dirty | ~F.coalesce(intact, F.lit(False))).select("file")


def prune(store: SnapshotStore, now_ms: int, days: int) -> int:
    """Publish without sessions older than so many days and their messages; the number of sessions that went."""
    sessions, messages = store.read("sessions"), store.read("messages")
    if sessions is None or days <= 0:
        return 0
    kept = retained(sessions, now_ms, days)
    gone = sessions.count() - kept.count()
    if gone:
        tables = {"sessions": kept}
        for name in {"checkpoints", "folds"} & store.current()["tables"].keys():
            tables[name] = store.read(name).join(kept.select("file"), "file", "left_semi")
        if messages is not None:
            tables["messages"] = messages.join(kept.select(F.col("file").alias("session_file")), "session_file", "left_semi")
        store.publish(tables, state={"last_prune": now_ms, "last_prune_count": gone})
    return gone


def compact(store: SnapshotStore, now_ms: int, file_rows: int = 1_000_000, every_ms: int = 86_400_000) -> bool:
    """Rewrite the tables in files of about file_rows, sorted by their file so that a session's rows lie together; at most once in
    every_ms."""
    now = store.current()
    if not now["tables"] or now_ms - now["state"].get("last_optimize", -every_ms) < every_ms:
        return False
    tables = {}
    for name, rows in now["tables"].items():
        df = store.read(name)
        key = "session_file" if "session_file" in df.columns else "file"
        tables[name] = df.repartitionByRange(max(1, -(-rows // file_rows)), key).sortWithinPartitions(key)
    store.publish(tables, state={"last_optimize": now_ms})
    return True


def coverage(sessions: DataFrame, failed: DataFrame, most: int = 20) -> dict:
    """Whether everything is indexed, why not, and the first failures by file."""
    partial = sessions.where(~F.coalesce("complete", F.lit(True)))
    reasons = {r["x"] for r in partial.select(F.explode("reasons").alias("x")).distinct().collect()}
    reasons |= {r["error_code"] for r in failed.select("error_code").distinct().collect()}
    shown = failed.orderBy("file").limit(most + 1).collect()
    return {"complete": not reasons and not shown and not partial.limit(1).count(), "reasons": sorted(r for r in reasons if r), "diagnostics": [r.asDict() for r in shown[:most]], "diagnosticsTruncated": len(shown) > most}

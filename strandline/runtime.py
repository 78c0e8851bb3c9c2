"""Session helpers: the shared folder, materialised intermediates and sizing of partitions."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (tests, a laptop) a temporary folder is made and kept in the session's configuration; on a
    cluster that is an error, as no folder of one machine will do.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strandline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, count: Column | None = None, observed: dict[str, Column] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    With count, the rows for which it holds are counted as they are written; counted() tells how many. Other aggregates can be
    observed the same way.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    schema = df.schema
    wanted = dict(observed or {}) | ({} if count is None else {"n": F.count_if(count)})
    (df.observe(seen, *(c.alias(n) for n, c in wanted.items())) if wanted else df).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    found = seen.get if wanted else {}
    out._strandline_path = path  # noqa: SLF001  for release()
    out._strandline_observed = found  # noqa: SLF001
    out._strandline_count = None if count is None else found["n"] or 0  # noqa: SLF001
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append(out)
    return out


_scopes = threading.local()


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() makes in this block are deleted at its end, but for those handed to the function it gives."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    stack = _scopes.__dict__.setdefault("open", [])
    stack.append(made)
    try:
        yield keep
    finally:
        stack.pop()
        release(*(df for df in made if not any(df is k for k in kept)))
        if stack:
            stack[-1].extend(kept)


def counted(df: DataFrame) -> int:
    return df._strandline_count  # noqa: SLF001


def stored_bytes(df: DataFrame) -> int:
    """Size of a table made by materialize(), as stored: what a broadcast of it is checked by."""
    jvm = df.sparkSession._jvm  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path(df._strandline_path)  # noqa: SLF001
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()  # noqa: SLF001


def release(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that no later step reads."""
    for df in frames:
        path = getattr(df, "_strandline_path", None)
        if path:
            delete(df.sparkSession, path)


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)  # noqa: SLF001


def rename(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder where it exists; its parent is made."""
    hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    a, b = hadoop.Path(path), hadoop.Path(target)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.mkdirs(b.getParent())
    if fs.exists(a) and not fs.rename(a, b):
        raise OSError(f"{path} can't be moved to {target}")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[str]:
    """Cancel the jobs that this block starts once the time is over; they then fail as cancelled. Yields the jobs' tag."""
    tag = f"deadline-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context.addJobTag(tag)
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    timer.daemon = True
    timer.start()
    try:
        yield tag
    finally:
        timer.cancel()
        context.removeJobTag(tag)

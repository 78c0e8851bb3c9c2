"""Compressed session logs as Spark sources: directory scan, frame decoder, batch and tail reading."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.runtime import counted, materialize, shuffle_partitions

MAGIC = b"\x28\xb5\x2f\xfd"
NAME = re.compile(r"^session(?:\.v([1-9]\d*))?\.jsonl\.zstd$")
SUFFIX = ".jsonl.zstd"
#: Limits of a single log, as defaults: bytes of a line (one beyond comes without its text), compressed and decompressed bytes (a log
#: beyond comes as an error). None is no limit.
MAX_LINE, MAX_INPUT, MAX_OUTPUT = 4 << 20, 64 << 20, 256 << 20
#: Bytes of logs that one task reads, about.
TASK_BYTES = 64 << 20


def generation_of(name: str) -> int | None:
    """0 for session.jsonl.zstd, N for session.vN.jsonl.zstd, None for any other name."""
    m = NAME.match(os.path.basename(name))
    return None if not m else int(m[1] or 0)


@dataclass
class Scan:
    files: list[dict] = field(default_factory=list)
    complete: bool = True
    truncated: bool = False
    errors: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)


def scan_logs(root: str, cap: int | None = None, generations: bool = True) -> Scan:
    """Log files under a local root by path with size and times; of a directory's canonical names only the highest generation.

    With cap, only so many files by path are given, and the scan says that it was truncated.

    Unreadable directories and files make the scan incomplete, so that nothing is taken for deleted.
    """
    out = Scan()
    todo = [root]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            out.complete = False
            out.errors.append(f"{folder}: {e.strerror}")
            out.failed.append(folder)
            continue
        todo += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
        names = [e for e in entries if e.name.endswith(SUFFIX) and e.is_file()]
        best = max((g for e in names if (g := generation_of(e.name)) is not None), default=None)
        for e in names:
            g = generation_of(e.name)
            if generations and g is not None and g != best:
                continue
            try:
                s = e.stat()
            except OSError as x:
                out.complete = False
                out.errors.append(f"{e.path}: {x.strerror}")
                continue
            out.files.append({"file": e.path, "size": s.st_size, "mtime_ms": s.st_mtime * 1000, "ctime_ms": s.st_ctime * 1000, "generation": g})
    out.files.sort(key=lambda f: f["file"])
    if cap is not None and len(out.files) > cap:
        out.truncated = True
        out.complete = False
        out.files = out.files[:cap]
    return out


def _folder(path: str, generations: bool = True) -> tuple[list[str], list[dict]]:
    """(inner folders, log files) of one folder of a local or shared file system."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
        entries = [(head + e.path if not e.path.startswith("/") else head.rstrip("/") + e.path, e.base_name, e.type == fs.FileType.Directory, e.size, e.mtime_ns) for e in store.get_file_info(fs.FileSelector(inner))]
        found = [(p, n, d, (size or 0, (t or 0) / 1e6, (t or 0) / 1e6)) for p, n, d, size, t in entries]
    else:
        found = []
        for e in os.scandir(path.removeprefix("file://")):
            if e.is_dir(follow_symlinks=False):
                found.append((e.path, e.name, True, None))
            elif e.name.endswith(SUFFIX) and e.is_file():
                s = e.stat()
                found.append((e.path, e.name, False, (s.st_size, s.st_mtime * 1000, s.st_ctime * 1000)))
    names = [(p, generation_of(n), facts) for p, n, folder, facts in found if not folder and n.endswith(SUFFIX)]
    best = max((g for _, g, _ in names if g is not None), default=None)
    files = [{"file": p, "size": f[0], "mtime_ms": f[1], "ctime_ms": f[2], "generation": g} for p, g, f in names if not generations or g is None or g == best]
    return [p for p, _, folder, _ in found if folder], files


LISTED = "folder string, file string, size bigint, mtime_ms double, ctime_ms double, generation int, error string"


def list_logs(spark, root: str, generations: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(log files under root as file, size, mtime_ms, ctime_ms and generation; folders that couldn't be read with their error).

    Folders are read by tasks, one level after another, and never pass the driver; the paths may be those of any file system
    that executors reach. An unreadable folder makes the listing incomplete, so that nothing is taken for deleted.
    """

    schema = to_arrow_schema(T.StructType.fromDDL(LISTED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for folder in batch.column(0).to_pylist():
                try:
                    inner, files = _folder(folder, generations)
                    rows += [{"folder": f} for f in inner] + files
                except OSError as e:
                    rows.append({"folder": None, "error": f"{folder}: {e.strerror or e}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    level = spark.createDataFrame([(root,)], "folder string")
    found = []
    while True:
        found.append(materialize(level.repartition(shuffle_partitions(spark)).mapInArrow(read, LISTED), "listing", F.col("folder").isNotNull()))
        if not counted(found[-1]):
            break
        level = found[-1].where("folder is not null").select("folder")
    everything = reduce(DataFrame.unionByName, found)
    return everything.where("file is not null").drop("folder", "error"), everything.where("error is not null").select("error")


def fingerprint(scan: Scan) -> str:
    import hashlib

    return hashlib.sha256(json.dumps([[f["file"], f["size"], f["mtime_ms"], f["ctime_ms"]] for f in scan.files]).encode()).hexdigest()


class DecodeError(ValueError):
    def __init__(self, message: str, code: str = "unknown"):
        super().__init__(message)
        self.code = code


def skippable(data: bytes, at: int = 0) -> bool:
    return len(data) >= at + 4 and int.from_bytes(data[at : at + 4], "little") & 0xFFFFFFF0 == 0x184D2A50


def frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, skippable) of each frame; a real one ends where the next magic stands."""
    at = 0
    while at + 4 <= len(data):
        if skippable(data, at):
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little") if at + 8 <= len(data) else len(data) + 1
            if end > len(data):
                raise DecodeError("skippable frame truncated", "partial_frame")
            yield at, end, True
        elif data[at : at + 4] == MAGIC:
            nxt = data.find(MAGIC, at + 4)
            end = len(data) if nxt < 0 else nxt
            yield at, end, False
        else:
            return
        at = end


def decode(data: bytes, offset: int = 0, most: int | None = MAX_OUTPUT) -> tuple[bytes, int]:
    """(text, end of the last whole frame) of a log's bytes from a frame boundary.

    A frame in the middle that doesn't end in a line feed was cut by a crash and is left out; a last frame that is cut is an
    append under way and fails as partial_frame.
    """
    import zstandard

    found = list(frames(data))
    if not found or offset == 0 and found[0][2]:
        if data and MAGIC.startswith(data[:4]) and len(data) < 4:
            raise DecodeError("incomplete frame magic", "partial_frame")
        raise DecodeError("no frame header at the expected offset", "invalid_offset" if offset else "unknown")
    real = [f for f in found if not f[2]]
    out, size = [], 0
    for f in real:
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            piece = d.decompress(data[f[0] : f[1]])
        except zstandard.ZstdError as e:
            raise DecodeError(f"frame decode failed: {e}") from None
        if not d.eof and f is real[-1]:
            raise DecodeError("last frame truncated", "partial_frame")
        size += len(piece)
        if most is not None and size > most:
            raise DecodeError(f"decompressed size exceeds {most} bytes")
        if f is real[-1] or piece.endswith(b"\n"):
            out.append(piece)
    return b"".join(out), found[-1][1]


def split_lines(text: bytes, max_line: int | None = MAX_LINE) -> Iterator[tuple[str | None, bool]]:
    """(line, oversized) of each line that isn't empty; one beyond the limit comes without its text."""
    for line in text.split(b"\n"):
        if line:
            yield (None, True) if max_line is not None and len(line) > max_line else (line.decode("utf-8", "replace"), False)


def reverse_lines(path: str, end: int | None = None, block: int = 64 << 10, max_line: int = MAX_LINE) -> Iterator[tuple[str, int]]:
    """(line, its start) of a plain JSONL file from its end, read in blocks; oversized and bad lines are left out."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END) if end is None else end
        rest = b""
        while at > 0:
            step = min(block, at)
            at -= step
            f.seek(at)
            parts = (f.read(step) + rest).split(b"\n")
            rest = parts[0]
            start = at + len(b"\n".join(parts))
            for part in reversed(parts[1:]):
                start -= len(part)
                if part and len(part) <= max_line:
                    yield part.decode("utf-8", "replace"), start
                start -= 1
        if rest and len(rest) <= max_line:
            yield rest.decode("utf-8", "replace"), 0


SCHEMA = "file string, line_no bigint, line string, oversized boolean, error string, error_code string, size bigint, mtime_ms double, ctime_ms double, end_offset bigint"


@dataclass
class LogPart(InputPartition):
    file: str
    size: int
    mtime_ms: float
    ctime_ms: float
    offset: int = 0
    first_line: int = 0
    head: int = 0
    max_line: int | None = MAX_LINE
    max_input: int | None = MAX_INPUT
    max_output: int | None = MAX_OUTPUT
    resume: bool = False
    trim: bool = False


def _bytes(path: str, start: int, end: int) -> bytes:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            return f.read_at(end - start, start)
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(start)
        return f.read(end - start)


def _resumed(p: LogPart) -> int:
    """Where the frame begins that was under way at p.offset, or p.offset if none was: found by reading back from there."""
    at, block = p.offset, 64 << 10
    while at > 0:
        start = max(0, at - block)
        data = _bytes(p.file, start, p.offset)
        found = data.rfind(MAGIC)
        if found >= 0:
            return p.offset if _whole_frame(data[found:]) else start + found
        at, block = start, block * 4
    return 0


def _whole_frame(data: bytes) -> bool:
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    try:
        d.decompress(data)
    except zstandard.ZstdError:
        return False
    return d.eof


def _whole_part(data: bytes) -> bytes:
    """data without a last frame that is under way: it is tried again when there is more."""
    try:
        found = list(frames(data))
    except DecodeError:
        return b""
    while found:
        start, end, skip = found[-1]
        if skip or _whole_frame(data[start:end]):
            return data[:end]
        found.pop()
    return b""


def read_part(p: LogPart) -> Iterator[tuple]:
    """Rows of one log; a log that can't be read gives one row with its error."""
    info = (p.size, p.mtime_ms, p.ctime_ms)
    offset = p.offset
    try:
        if p.resume and offset:
            offset = _resumed(p)
        if p.max_input is not None and p.size - offset > p.max_input:
            raise DecodeError(f"compressed size exceeds {p.max_input} bytes")
        data = _head_bytes(p) if p.head else _bytes(p.file, offset, p.size)
        if p.resume or p.trim:
            data = _whole_part(data)
            if not data:
                return
        text, end = decode(data, offset, p.max_output)
        if not p.head and len(data) < p.size - offset and not p.resume and not p.trim:
            raise DecodeError("source changed while it was read", "source_changed")
    except (OSError, DecodeError) as e:
        yield p.file, None, None, False, str(e), getattr(e, "code", "unknown"), *info, offset
        return
    for n, (line, oversized) in enumerate(split_lines(text, p.max_line)):
        if p.head and n >= p.head:
            return
        yield p.file, p.first_line + n, line, oversized, None, None, *info, offset + end


def _head_bytes(p: LogPart, step: int = 256 << 10) -> bytes:
    """As many whole frames from a log's start as its first `head` lines need: the read stops there."""
    size = step
    while True:
        data = _bytes(p.file, 0, min(size, p.size))
        if size >= p.size:
            return data
        whole = _whole_part(data)
        if whole and decode(whole, 0, None)[0].count(b"\n") >= p.head:
            return whole
        size *= 4


def read_logs(files: DataFrame, max_line: int | None = MAX_LINE, max_input: int | None = MAX_INPUT, max_output: int | None = MAX_OUTPUT, head: int = 0, trim: bool = False) -> DataFrame:
    """Lines (SCHEMA) of the given logs (file, size, mtime_ms, ctime_ms and, to go on from there, offset and first_line).

    Only these files are opened, each from its offset on (or only for its first `head` lines), by tasks of about TASK_BYTES.
    With trim, a last frame that is under way waits; else its log fails as partial_frame.
    """
    spark = files.sparkSession
    rows = files.select("file", "size", "mtime_ms", "ctime_ms", *(F.col(c) if c in files.columns else F.lit(0).cast("long").alias(c) for c in ("offset", "first_line")))
    rows = materialize(rows, "to-read", observed={"bytes": F.sum(F.col("size") - F.col("offset")), "n": F.count(F.lit(1))})
    facts = rows._strandline_observed  # noqa: SLF001
    tasks = max(1, min(facts["n"] or 1, max(shuffle_partitions(spark), -(-(facts["bytes"] or 0) // TASK_BYTES))))

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = LogPart(**r, head=head, trim=trim, max_line=max_line, max_input=max_input, max_output=max_output)
                lines: list[tuple] = []
                for row in read_part(part):
                    lines.append(row)
                    if len(lines) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), schema)], schema=schema)
                        lines = []
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), schema)], schema=schema)

    return rows.repartition(tasks).mapInArrow(run, SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.head, self.max_line = int(options.get("head", 0)), int(options.get("maxlinebytes", options.get("maxLineBytes", MAX_LINE)))

    def partitions(self) -> list[LogPart]:
        return [LogPart(f["file"], f["size"], f["mtime_ms"], f["ctime_ms"], head=self.head, max_line=self.max_line) for f in scan_logs(self.root).files] or [LogPart("", 0, 0.0, 0.0)]

    def read(self, partition: LogPart) -> Iterator[tuple]:
        if partition.file:
            yield from read_part(partition)


class _StreamReader(DataSourceStreamReader):
    """Appended logs by file size: the driver only looks at sizes; a task reads what was added, from the frame on that was under way before."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f["file"]: f["size"] for f in scan_logs(self.root).files}

    def partitions(self, start: dict, end: dict) -> list[LogPart]:
        parts = [LogPart(f, size, 0.0, 0.0, offset=start.get(f, 0), resume=True) for f, size in sorted(end.items()) if size > start.get(f, 0)]
        return parts or [LogPart("", 0, 0.0, 0.0)]

    def read(self, partition: LogPart) -> Iterator[tuple]:
        if partition.file:
            for row in read_part(partition):
                yield row[0], (partition.offset << 20) + (row[1] or 0), *row[2:]

    def commit(self, end: dict) -> None:
        pass


class SessionLogSource(DataSource):
    """spark.read.format("session_logs").load(root), or readStream; options head and maxLineBytes."""

    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)


def register(spark) -> None:  # noqa: ANN001
    spark.dataSource.register(SessionLogSource)

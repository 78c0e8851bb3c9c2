"""Bookmarks: an append-only file of user data in which the latest line of an anchor counts."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION, LABEL, LIMIT, MOST = 2, 80, 20, 100
LEGACY = "legacy-rowid-without-proof"
SCHEMA = "line_no bigint, id string, sessionId string, sessionFile string, messageId bigint, anchorId string, anchorStatus string, unresolvedReason string, label string, note string, title string, workspace string, createdAt bigint, updatedAt bigint"


class CorruptBookmarks(ValueError):
    """A file with a bad line is not written to."""


def anchor_key(session_id: str, message_id: int | None, anchor_id: str | None) -> str:
    return session_id + "\0" + (f"anchor:{anchor_id}" if anchor_id else "" if message_id is None else str(message_id))


def bookmark_id(session_id: str, message_id: int | None = None, anchor_id: str | None = None) -> str:
    return hashlib.sha1(anchor_key(session_id, message_id, anchor_id).encode()).hexdigest()


def default_label(title: str | None, first_user_text: str | None) -> str:
    return (title or first_user_text or "")[:LABEL]


def normalize(obj: object) -> dict | None:
    """A bookmark of either version with its status, other fields kept; None for anything else."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not isinstance(obj, dict) or obj.get("v") not in (1, VERSION) or ("anchorId" in obj and not (isinstance(obj["anchorId"], str) and obj["anchorId"])):
        return None
    texts = all(isinstance(obj.get(k), str) for k in ("id", "sessionId", "sessionFile", "label", "title", "workspace")) and all(obj[k] for k in ("id", "sessionId", "sessionFile"))
    if not texts or not all(number(obj.get(k)) for k in ("createdAt", "updatedAt")) or obj.get("messageId") is not None and not number(obj["messageId"]) or obj.get("note") is not None and not isinstance(obj["note"], str):
        return None
    anchored, whole = "anchorId" in obj, obj.get("messageId") is None
    status = "resolved" if anchored else "session" if whole else "unresolved"
    reason = None if anchored or whole else str(obj.get("unresolvedReason") or LEGACY)
    return {**obj, "messageId": obj.get("messageId"), "note": obj.get("note"), "anchorStatus": status, "unresolvedReason": reason}


def parse_lines(text: str) -> tuple[list[dict], int]:
    """(bookmarks, bad lines): the latest line of each anchor, in the order of the anchors' first lines."""
    found: dict[str, dict] = {}
    bad = 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        try:
            b = normalize(json.loads(line))
        except ValueError:
            b = None
        if b is None:
            bad += 1
        else:
            found[anchor_key(b["sessionId"], b["messageId"], b.get("anchorId"))] = b
    return list(found.values()), bad


def _read(path: str) -> str:
    try:
        return Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return ""


def _write(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.realpath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, os.path.realpath(path))


class _Lock:
    """Across processes, by the operating system's file lock, which a dead owner gives up."""

    def __init__(self, path: str):
        self.path = os.path.realpath(path) + ".lock"

    def __enter__(self) -> None:
        import fcntl

        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        self.file = open(self.path, "w")  # noqa: SIM115
        fcntl.flock(self.file, fcntl.LOCK_EX)

    def __exit__(self, *_: object) -> None:
        self.file.close()


def _sound(path: str) -> tuple[str, list[dict]]:
    text = _read(path)
    found, bad = parse_lines(text)
    if bad:
        raise CorruptBookmarks(f"{bad} bad lines in {path}")
    return text, found


def _dump(b: dict) -> str:
    return json.dumps({k: v for k, v in b.items() if v is not None or k in ("messageId", "note")}, ensure_ascii=False, separators=(",", ":")) + "\n"


def add(path: str, entry: dict, now_ms: int) -> tuple[dict, bool]:
    """(bookmark, replaced) after a line was appended; a replaced anchor keeps its creation time and other fields."""
    with _Lock(path):
        text, found = _sound(path)
        key = anchor_key(entry["sessionId"], entry.get("messageId"), entry.get("anchorId"))
        old = next((b for b in found if anchor_key(b["sessionId"], b["messageId"], b.get("anchorId")) == key), None)
        new = normalize({**(old or {}), **{k: v for k, v in entry.items() if v is not None}, "v": VERSION, "id": old["id"] if old else bookmark_id(entry["sessionId"], entry.get("messageId"), entry.get("anchorId")), "note": entry.get("note"), "createdAt": old["createdAt"] if old else now_ms, "updatedAt": now_ms})
        if new is None:
            raise ValueError("a bookmark needs sessionId, sessionFile, label, title and workspace")
        _write(path, text + ("\n" if text and not text.endswith("\n") else "") + _dump(new))
        return new, old is not None


def remove(path: str, bookmark: str | None = None, session_id: str | None = None) -> int:
    bookmark, session_id = (bookmark or "").strip(), (session_id or "").strip().lower()
    if not bookmark and not session_id:
        raise ValueError("remove needs an id or a sessionId")
    with _Lock(path):
        _, found = _sound(path)
        kept = [b for b in found if not (bookmark and b["id"] == bookmark or session_id and b["sessionId"].lower() == session_id)]
        if len(kept) < len(found):
            _write(path, "".join(map(_dump, kept)))
        return len(found) - len(kept)


def migrate(path: str, resolve: Callable[[dict], dict], dry_run: bool = True, backup: str | None = None) -> dict:
    """Version 1 lines to version 2. A legacy row number counts as resolved only where its stored evidence agrees with the
    resolver's; every line and its other fields stay. Writing needs a backup file that is new or holds the same."""
    with _Lock(path):
        text = _read(path)
        counts, entries, out = Counter(), [], []
        for n, line in enumerate(text.split("\n"), 1):
            if not line.strip():
                out.append(line)
                continue
            try:
                obj = json.loads(line)
            except ValueError:
                raise CorruptBookmarks(f"line {n}") from None
            b = normalize(obj)
            if b is None:
                raise CorruptBookmarks(f"line {n}")
            if b["v"] == VERSION:
                counts["alreadyMigrated"] += 1
                out.append(line)
                continue
            status, reason, anchor = "session", None, None
            if b["messageId"] is not None:
                answer = resolve(b)
                status = answer["status"]
                proof = b.get("legacyEvidence") or {}
                if status != "resolved":
                    reason = status
                elif answer.get("anchorId") and answer.get("evidence") and proof.get("identityEvidence") == answer["evidence"] and proof.get("anchorId") == answer["anchorId"]:
                    anchor = answer["anchorId"]
                else:
                    status, reason = "unresolved", LEGACY
            counts[status] += 1
            entries.append({"line": n, "id": b["id"], "sessionId": b["sessionId"], "status": status, "reason": reason})
            out.append(_dump({**obj, "v": VERSION, "anchorId": anchor, "anchorStatus": "session" if status == "session" else "resolved" if anchor else "unresolved", "unresolvedReason": reason}).rstrip("\n"))
        if not dry_run and entries:
            if not backup or os.path.realpath(backup) == os.path.realpath(path):
                raise ValueError("migration needs a separate backup file")
            if os.path.exists(backup) and _read(backup) != text:
                raise ValueError("the backup file holds something else")
            _write(backup, text)
            _write(path, "\n".join(out))
        return {"dryRun": dry_run, "records": sum(counts.values()), "counts": dict(counts), "entries": entries}


def bookmark_table(spark: SparkSession, path: str) -> DataFrame:
    found, _ = parse_lines(_read(path))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(i if n == "line_no" else int(b[n]) if n in ("messageId", "createdAt", "updatedAt") and b.get(n) is not None else b.get(n) for n in names) for i, b in enumerate(found)], SCHEMA)


def matching(bookmarks: DataFrame, query: str = "") -> DataFrame:
    q = query.lower().strip()
    hit = F.lit(not q)
    for c in ("label", "note", "title"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return bookmarks.where(hit)


def listed(bookmarks: DataFrame, sessions: DataFrame, messages: DataFrame, query: str = "", limit: int = LIMIT) -> DataFrame:
    """Matching bookmarks, last updated first, with whether their session and anchor are still there."""
    there = sessions.where("id is not null").select(F.col("id").alias("sessionId")).distinct().withColumn("known", F.lit(True))
    anchors = messages.where("anchor_id is not null").select(F.col("anchor_id").alias("anchorId"), F.col("session_file").alias("sessionFile")).distinct().withColumn("anchored", F.lit(True))
    rows = matching(bookmarks, query).join(there, "sessionId", "left").join(anchors, ["anchorId", "sessionFile"], "left")
    rows = rows.withColumn("stale", F.col("known").isNull()).withColumn("anchorAvailable", F.col("anchored").isNotNull()).drop("known", "anchored")
    return rows.orderBy(F.col("updatedAt").desc(), "id", "line_no").limit(max(1, min(MOST, limit)))


def latest_rows(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key: the rule by which lines of an append-only file replace each other."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def resolutions(bookmarks: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, status) of legacy bookmarks by counts of their session and row: what a migration may take as resolved."""
    files = sessions.groupBy(F.col("id").alias("sessionId")).agg(F.countDistinct("file").alias("files"), F.min("file").alias("file"))
    rows = messages.select(F.col("session_file").alias("file"), F.col("id").alias("messageId"), "anchor_id")
    joined = bookmarks.join(files, "sessionId", "left").join(rows, ["file", "messageId"], "left")
    status = F.when(F.col("messageId").isNull(), "session").when(F.col("files").isNull(), "session-missing").when(F.col("files") > 1, "ambiguous").when(F.col("anchor_id").isNull(), "unresolved").otherwise("resolved")
    return joined.select("id", status.alias("status"), "anchor_id")

"""One-sentence session summaries by a provider, cached by the source's fingerprint."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import UTC, datetime

from strandline.operators.bookmarks import _Lock, _read, _write

LONGEST, TOKENS, VERSION = 80, 64, 1
TITLE, FIRST, LAST, COUNTS, TOOLS, COUNT_ENTRY, TOOL_ENTRY = 120, 200, 500, 8, 5, 40, 48


def _entries(counts: dict | None, top: int, cap: int, sign: str) -> str:
    if not counts:
        return "-"
    ranked = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:top]
    return " ".join(f"{k}{sign}{n}"[:cap] for k, n in ranked)


def _iso(ms: int | None) -> str:
    return datetime.fromtimestamp((ms or 0) / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{(ms or 0) % 1000:03d}Z"


def prompt(meta: dict) -> str:
    """A deterministic request for one session: capped excerpts and counts, never whole texts."""
    seconds = round(max(0, (meta.get("last_time") or 0) - (meta.get("created_at") or 0)) / 1000)
    return "\n".join(
        [
            f"In one sentence of at most {LONGEST} characters, say what the user of this session wanted to achieve.",
            f"Title: {(meta.get('title') or '(untitled)')[:TITLE]}",
            f"First user message: {(meta.get('first_user_text') or '(none)')[:FIRST]}",
            f"Last assistant message: {(meta.get('last_assistant_text') or '(none)')[:LAST]}",
            f"Events: {_entries(meta.get('counts'), COUNTS, COUNT_ENTRY, '=')}",
            f"Tools: {_entries(meta.get('tool_call_counts'), TOOLS, TOOL_ENTRY, '×')}",
            f"Time: {_iso(meta.get('created_at'))} to {_iso(meta.get('last_time'))} ({seconds} s)",
            "Sentence:",
        ]
    )


def read_cache(path: str) -> dict[str, dict]:
    """The latest sound line of each session."""
    out: dict[str, dict] = {}
    for line in _read(path).split("\n"):
        try:
            e = json.loads(line) if line.strip() else None
        except ValueError:
            continue
        if isinstance(e, dict) and e.get("v") == VERSION and isinstance(e.get("sessionId"), str) and isinstance(e.get("summary"), str) and e["summary"]:
            out[e["sessionId"]] = e
    return out


def summary_of(meta: dict, path: str, provider: Callable[[str, int], str] | None, now_ms: int) -> str | None:
    """The session's sentence: from the cache while file, size and time are the same, else asked for once; None without one.

    For single sessions on the driver; a provider that fails leaves the summary out.
    """
    mark = {"file": meta["file"], "size": meta.get("size"), "mtimeMs": meta.get("mtime_ms")}
    known = read_cache(path).get(meta["id"])
    if known and all(known.get(k) == v for k, v in mark.items()):
        return known["summary"]
    if provider is None:
        return None
    try:
        text = " ".join(provider(prompt(meta), TOKENS).split())[:LONGEST]
    except Exception:  # noqa: BLE001  any failure of an outside service
        return None
    if text:
        with _Lock(path):
            old = _read(path)
            _write(path, old + ("\n" if old and not old.endswith("\n") else "") + json.dumps({"v": VERSION, "sessionId": meta["id"], **mark, "summary": text, "createdAt": now_ms}, ensure_ascii=False) + "\n")
    return text or None


def source_exists(meta: dict) -> bool:
    return os.path.exists(meta["file"])

"""The five entry points over published (or any) session and message tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import bookmarks, listing, scroll, search, summary
from strandline.operators.fold import fold_logs
from strandline.operators.lineage import lineage_roots
from strandline.operators.search import Filter
from strandline.sources.logs import list_logs, read_logs
from strandline.streaming.ingest import Follower
from strandline.streaming.store import SnapshotStore, coverage

MAX_HITS, SNIPPETS, RETENTION_DAYS = 50, 3, 90
_TEXTS = ("workspace", "title", "first_user_text", "last_assistant_text", "agent_preset", "parent_session")


def _session_view(sessions: DataFrame) -> DataFrame:
    """sessions with every column the entry points use; what a table lacks is empty."""
    out = search.latest_sessions(sessions) if "updated_at" in sessions.columns else sessions
    counts = "map<string,bigint>"
    defaults = {c: F.lit(None).cast("string") for c in _TEXTS} | {"created_at": F.lit(None).cast("bigint"), "last_time": F.lit(None).cast("bigint"), "counts": F.create_map().cast(counts), "tool_call_counts": F.create_map().cast(counts), "tool_names": F.array().cast("array<string>"), "unindexable": F.lit(False), "size": F.lit(None).cast("bigint"), "mtime_ms": F.lit(None).cast("double"), "updated_at": F.lit(None).cast("bigint")}
    return out.withColumns({c: d for c, d in defaults.items() if c not in out.columns})


def _message_view(messages: DataFrame) -> DataFrame:
    """messages with a row number `id`: published rows have one; any others get it from what identifies them."""
    return messages if "id" in messages.columns else messages.withColumn("id", F.xxhash64("session_file", "anchor_id", "event_seq"))


class Engine:
    """engine = Engine(spark, sessions, messages): status, list, search, scroll, summary and bookmark."""

    def __init__(self, spark: SparkSession, sessions: DataFrame, messages: DataFrame, bookmark_file: str | None = None, summary_file: str | None = None, provider: Callable[[str, int], str] | None = None, max_hits: int = MAX_HITS, snippets: int = SNIPPETS, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.sessions, self.messages = spark, _session_view(sessions), _message_view(messages)
        self.bookmark_file, self.summary_file, self.provider = bookmark_file, summary_file, provider
        self.max_hits, self.snippets, self.clock = max(1, min(500, max_hits)), max(1, min(20, snippets)), clock

    @classmethod
    def of_store(cls, store, root: str | None = None, **options) -> Engine:  # noqa: ANN001
        """An engine over the snapshot in force. With the logs' root it can refresh, and search logs that failed or are new."""
        out = cls(store.spark, store.read("sessions"), store.read("messages"), **options)
        out.store, out.follower = store, Follower(store.spark, root, store) if root else None
        return out

    store: SnapshotStore | None = None
    follower: Follower | None = None

    def refresh(self) -> dict:
        """Bring the store up to the logs and this engine up to the store; the build's report. One build runs at a time."""
        if self.follower is None:
            raise ValueError("no logs to refresh from")
        tag = f"refresh-{id(self)}"
        self.spark.addTag(tag)
        try:
            report = self.follower.step()
        finally:
            self.spark.removeTag(tag)
        self.sessions, self.messages = _session_view(self.store.read("sessions")), _message_view(self.store.read("messages"))
        return report

    def cancel(self) -> bool:
        """Stop a refresh that is under way (from another thread); what is published stays."""
        running = self.follower is not None and self.follower.running
        self.spark.interruptTag(f"refresh-{id(self)}")
        return running

    def coverage(self) -> dict:
        """Whether everything that was found is indexed, and if not why: reasons, limits met and the first failures."""
        if self.store is None:
            return {"complete": True, "reasons": [], "diagnostics": [], "diagnosticsTruncated": False}
        failed = self.store.read("failures")
        none = self.spark.createDataFrame([], "file string, error string, error_code string")
        return coverage(self.sessions.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))) if "reasons" in self.sessions.columns else self.sessions.withColumns({"complete": F.lit(True), "reasons": F.array().cast("array<string>")}), failed if failed is not None else none)

    def status(self) -> dict:
        s = self.sessions.agg(F.count("*").alias("files"), F.countDistinct("id").alias("sessions"), F.max("last_time").alias("last_time"), F.count_if("unindexable").alias("unindexable")).head()
        m = self.messages.agg(F.count("*").alias("messages"), F.countDistinct("session_file").alias("files")).head()
        return {"files": s["files"], "sessions": s["sessions"], "lastTime": s["last_time"], "unindexable": s["unindexable"], "messages": m["messages"], "ftsSessions": m["files"]} | self._health()

    def _health(self) -> dict:
        if self.store is None:
            return {}
        dirty = [F.coalesce(F.col(c), F.lit(False)) for c in ("detail_missing", "fts_dirty") if c in self.sessions.columns]
        pending = self.sessions.where(reduce(lambda a, b: a | b, dirty)).count() if dirty else 0
        now = self.store.current()
        last = now["state"].get("report")
        return {
            "version": now["version"], "publishedMs": now["state"].get("published_ms"), "dirty": pending, "lastReport": last, "building": self.follower is not None and self.follower.running,
            "lastError": str(self.follower.error) if self.follower is not None and self.follower.error else None, "health": "ok" if last and last["complete"] and not last["failed"] and not pending else "partial" if last else "empty",
        }

    def _unindexed(self, max_line: int | None) -> tuple[DataFrame, DataFrame] | None:
        """(sessions, messages) of logs that failed to be indexed, read anew for one search."""
        failed = self.store.read("failures") if self.store is not None and self.follower is not None else None
        if failed is None or not failed.limit(1).count():
            return None
        files, _ = list_logs(self.spark, self.follower.root)
        lines = read_logs(files.join(failed.select("file"), "file", "left_semi"), max_line=max_line, trim=True)
        # lines beyond the first one that can't be taken are left out, so what came before it is still found
        sessions, messages = fold_logs(lines, partial=True)
        return _session_view(sessions.where("id is not null").withColumn("updated_at", F.lit(None).cast("bigint"))), _message_view(messages)

    def list(self, workspace: str = "", query: str = "", limit: int | None = None, cursor: str | None = None, sort: str = "time") -> dict:
        limit = max(1, limit or self.max_hits)
        rows = listing.matching(self.sessions, workspace, query)
        total = rows.count()
        if sort == "relevance":
            found, after = listing.by_relevance(rows, query, self.clock(), workspace, limit).collect(), None
            cut = total > len(found)
        else:
            found, after = listing.page(rows, limit, cursor)
            cut = after is not None
        shown = [{"id": r["id"], "workspace": r["workspace"], "file": r["file"], "title": r["title"], "firstUserText": (r["first_user_text"] or "")[:300], "createdAt": r["created_at"], "lastTime": r["last_time"], "size": r["size"], "toolCalls": (r["counts"] or {}).get("tool/call", 0)} for r in found]
        return {"total": total, "returned": len(shown), "truncated": cut, "sessions": shown} | ({"nextCursor": after} if after else {}) | ({"sort": "relevance"} if sort == "relevance" else {})

    def search(self, query: str, workspace: str = "", mode: str = "meta", limit: int | None = None, filter: dict | None = None, max_line_bytes: int | None = None, refresh: bool = False) -> dict:  # noqa: A002
        """Hits by lineage, best first. meta looks at sessions only, full at message texts too (AND, then OR if that finds none).

        All sessions in scope and all content hits count; only `limit` cuts what is returned. Over a store, full also reads logs
        that failed to be indexed, with lines of up to max_line_bytes (4 to 32 MiB), as far as they can be taken. coverage tells
        what is missing; the total is exact where nothing is.
        """
        if max_line_bytes is not None and not 4 << 20 <= max_line_bytes <= 32 << 20:
            raise ValueError("max_line_bytes must be 4 to 32 MiB")
        if refresh:
            self.refresh()
        query = query.strip()
        if not query:
            raise ValueError("query must not be empty")
        limit = max(1, limit or self.max_hits)
        wanted = Filter.of(**{{"sinceMs": "since_ms", "untilMs": "until_ms"}.get(k, k): v for k, v in (filter or {}).items()})
        sessions = self.sessions
        scope = listing.indexable(self.sessions).where(wanted.on_sessions(workspace))
        parts = []
        if mode == "meta" or wanted.role == "any":
            snippet = tx.excerpt(F.concat_ws("", F.lit("title: "), F.coalesce("title", F.lit("")), F.lit(" | "), F.substring(F.coalesce("first_user_text", F.lit("")), 1, 200)), query)
            named = listing.matching(scope, "", query, Filter(role="tool" if wanted.role == "tool" else "any"))
            parts.append(named.select(F.col("id").alias("session_id"), F.col("file").alias("session_file"), F.lit(None).cast("bigint").alias("message_id"), tx.normalize_markers(snippet).alias("snippet"), F.lit(None).cast("double").alias("rank"), F.lit(None).cast("bigint").alias("match_count"), F.coalesce(-F.col("last_time"), F.lit(0)).alias("arrival")))
        if mode == "full":
            messages, within = self.messages, scope
            if (raw := self._unindexed(max_line_bytes)) is not None:
                known = raw[0].join(self.sessions.select("file"), "file", "left_anti").where(wanted.on_sessions(workspace))
                within = scope.unionByName(known, allowMissingColumns=True)
                messages = messages.unionByName(raw[1].join(known.select(F.col("file").alias("session_file")), "session_file", "left_semi"), allowMissingColumns=True)
                sessions = self.sessions.unionByName(known, allowMissingColumns=True)
            found, _ = search.search_page(messages, within, query, None, None, wanted)
            parts.append(found.select("session_id", "session_file", "message_id", "snippet", "rank", "match_count", F.coalesce("event_seq", F.lit(0)).alias("arrival")))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        groups = search.lineage_groups(hits, lineage_roots(sessions), self.snippets)
        total = groups.count()
        about = sessions.select(F.col("id").alias("session_id"), "file", "workspace", "title", "first_user_text", "last_time").dropDuplicates(["session_id"])
        scored = groups.join(about, "session_id").withColumn("id", F.col("session_id"))
        # metadata alone brings no hit rows, so its frequency counts nothing
        ranked = listing.by_relevance(scored, query, self.clock(), workspace, limit, evidence=True)
        rows = ranked.collect()
        shown = [{"sessionId": r["session_id"], "workspace": r["workspace"], "file": r["file"], "kind": r["kind"], "snippet": r["snippet"], "messageId": r["message_id"], "lineageRoot": r["lineage"], "score": r["score"]} for r in rows]
        covered = self.coverage()
        return {"query": query, "mode": mode, "total": total, "returned": len(shown), "truncated": total > len(shown), "totalExact": covered["complete"], "hasMore": total > len(shown), "coverage": covered, "hits": shown}

    def scroll(self, session_id: str, anchor_id: str | None = None, message_id: int | None = None, window: int = 5) -> dict:
        reason, pivot = scroll.resolve(self.messages, self.sessions, session_id, anchor_id if anchor_id else message_id)
        if reason:
            return {"mode": "scroll", "ok": False, "reason": reason, "messages": [], "bookends": {"start": [], "end": []}}
        shape = lambda r: {"id": r["id"], "anchorId": r["anchor_id"], "eventSeq": r["event_seq"], "role": r["role"], "text": r["text"], "textTruncated": r["text_truncated"], "toolName": r["tool_name"]}
        near = [shape(r) for r in scroll.around(self.messages, pivot, window).collect()]
        ends = scroll.bookends(self.messages, pivot["file"]).collect()
        return {"mode": "scroll", "ok": True, "returned": len(near), "messages": near, "bookends": {side: [shape(r) for r in ends if r["side"] == side] for side in ("start", "end")}}

    def summary(self, wanted: str) -> dict:
        row = listing.find_session(self.sessions, wanted).head()
        if row is None:
            raise LookupError(f"session not found: {wanted}")
        meta = row.asDict(recursive=True)
        out = {"id": meta["id"], "file": meta["file"], "workspace": meta["workspace"], "createdAt": meta["created_at"], "lastTime": meta["last_time"], "durationMs": max(0, (meta["last_time"] or 0) - (meta["created_at"] or 0)), "title": meta["title"], "firstUserText": meta["first_user_text"], "lastAssistantText": meta["last_assistant_text"], "agentPreset": meta["agent_preset"], "counts": meta["counts"], "toolCalls": [{"name": k, "count": v} for k, v in sorted((meta["tool_call_counts"] or {}).items())]}
        if self.summary_file and (said := summary.summary_of(meta, self.summary_file, self.provider, self.clock())):
            out["llmSummary"] = said
        return out

    def bookmark(self, action: str, **args) -> dict:  # noqa: ANN003
        path = self.bookmark_file
        if path is None:
            raise ValueError("no bookmark file is set")
        if action == "add":
            number = args.get("messageId")
            if number is not None and (not isinstance(number, int) or isinstance(number, bool) or number < 0):
                raise ValueError("messageId must be a whole number from 0")
            row = listing.find_session(self.sessions, args["sessionId"]).head()
            if row is None:
                raise LookupError(f"session not found: {args['sessionId']}")
            entry = {"sessionId": row["id"], "sessionFile": row["file"], "messageId": number, "anchorId": args.get("anchorId"), "label": args.get("label") or bookmarks.default_label(row["title"], row["first_user_text"]), "note": args.get("note"), "title": row["title"] or "", "workspace": row["workspace"] or ""}
            made, replaced = bookmarks.add(path, entry, self.clock())
            return {"bookmark": made, "replaced": replaced, "file": path}
        if action == "list":
            found, bad = bookmarks.parse_lines(bookmarks._read(path))  # noqa: SLF001
            rows = bookmarks.bookmark_table(self.spark, path)
            shown = bookmarks.listed(rows, self.sessions, self.messages, args.get("query") or "", args.get("limit") or bookmarks.LIMIT).collect()
            return {"total": len(found), "matched": bookmarks.matching(rows, args.get("query") or "").count(), "returned": len(shown), "skippedBad": bad, "bookmarks": [r.asDict() for r in shown]}
        if action == "remove":
            return {"removed": bookmarks.remove(path, args.get("id"), args.get("sessionId"))}
        raise ValueError(f"unknown action: {action}")

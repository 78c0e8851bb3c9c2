"""Session logs folded to what a model sees: validation, surface replacement, message rows with stable identities."""

from __future__ import annotations

import hashlib
import json
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import materialize

SAFE = 2**53 - 1
MAX_MESSAGES, MAX_TEXT_BYTES = 50_000, 64 << 20

# The format's vocabulary.
SURFACE = {0: {"user/message", "assistant/message", "tool/result"}, 1: {"user/message", "assistant/message", "tool/result"}, 2: {"user/message", "assistant/message", "tool/result"}}
SURFACE[3] = SURFACE[2] | {"system/message"}
SURFACE[4] = SURFACE[3] | {"developer/message"}
ENVELOPE = {"type", "seq", "time", "data", "surfaceOp", "sourceEventSeqs", "ignorable"}
MODERN_HEADER = {"type", "version", "id", "createdAt", "isSeeded", "delegationDepth", "cwd", "parentSession", "origin", "agentPreset"}
LOG_ONLY = set(
    """agent-preset/selected agent/inbox/spliced approval/asked approval/decided approval/policy assistant/chunk command/done command/run
    compaction/end compaction/prune compaction/start compaction/summary feedback/record goal/change hook/invoked hook/result llm/retry
    llm/retry-started model/selection permission/preset plan/mode request/context request/header sandbox/mode schedule/change
    session/end-seed session/title session/title-llm-request step/end step/start subagent/descriptor subagent/model-selection-policy
    team/member team/message/delivered team/message/queued team/task todo/write tool/call tool/code-dispatch tool/code-dispatch-start
    tool-workflow/agent-end tool-workflow/agent-start tool-workflow/run-end tool-workflow/run-start turn/end turn/start""".split()
)
LOG_ONLY_MODERN = LOG_ONLY | set("assistant/attempt deliverables/presented feedback/message-delete feedback/message-put subagent/catalog tool/ptc-dispatch tool/ptc-dispatch-start workspace/changes".split())
PACKED = {"text-chunks": ("texts", "text-delta", "text"), "reasoning-chunks": ("texts", "reasoning-delta", "text"), "tool-call-chunks": ("args", "tool-call-delta", "argumentsDelta")}
VERSIONS = {0: "alpha3", 1: "alpha3", 2: "v2", 3: "v3", 4: "v4"}


#: The phase in which each kind of failure is found, and the kinds that another try may mend.
PHASES = {"surface_replace": "compatibility", "cross_window_reference": "delta_validate", "partial_frame": "compressed_read", "invalid_offset": "compressed_read", "sequence_mismatch": "compatibility", "compatibility_reject": "compatibility", "source_changed": "compressed_read", "unknown": "decode"}
RETRYABLE = {"partial_frame", "invalid_offset", "source_changed", "cross_window_reference"}


class LogError(ValueError):
    """A log that can't be taken; code tells the kind of failure, phase where it was found, retryable whether another try may do."""

    def __init__(self, message: str, code: str = "compatibility_reject"):
        super().__init__(message)
        self.code = code

    phase = property(lambda self: PHASES.get(self.code, "decode"))
    retryable = property(lambda self: self.code in RETRYABLE)

    def __reduce__(self):
        return LogError, (str(self), self.code)


def _need(ok: object, message: str, code: str = "compatibility_reject") -> None:
    if not ok:
        raise LogError(message, code)


def _whole(x: object, least: int | None = 0) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) <= SAFE and x == int(x) and (least is None or x >= least)


def expand_ranges(value: object, most: int = SAFE) -> list[int]:
    """[3, [5, 8]] to [3, 5, 6, 7, 8]: at most `most` numbers; strictly increasing if it has any range."""
    _need(isinstance(value, list), "sourceEventSeqs is no list")
    out: list[int] = []
    ranged = False
    for x in value:
        pair = x if isinstance(x, list) else [x, x]
        _need(len(pair) == 2 and _whole(pair[0]) and _whole(pair[1]) and pair[0] <= pair[1], "sourceEventSeqs holds something else than numbers and pairs")
        _need(len(out) + pair[1] - pair[0] + 1 <= most, "sourceEventSeqs names more events than came before")
        out.extend(range(int(pair[0]), int(pair[1]) + 1))
        ranged |= isinstance(x, list)
    _need(not ranged or all(a < b for a, b in zip(out, out[1:])), "sourceEventSeqs with ranges has to ascend")
    return out


def unpack(row: dict) -> list[dict]:
    """A packed row of chunks as its single events: consecutive seq, times added up from the gaps."""
    kind = row.get("type")
    if kind not in PACKED:
        return [row]
    field, delta, text = PACKED[kind]
    wrong = f"packed {kind} of wrong form"
    data = row.get("data")
    _need(row.keys() == {"type", "seq0", "time0", "data"} and _whole(row["seq0"]) and _whole(row["time0"], None) and isinstance(data, dict), wrong)
    keys = {"turn", "step", "index", "dt", field}
    tool = kind == "tool-call-chunks"
    _need(data.keys() in ([keys | {"id"}, keys | {"id", "name"}] if tool else [keys]), wrong)
    parts, gaps = data[field], data["dt"]
    _need(isinstance(parts, list) and parts and all(isinstance(p, str) for p in parts) and isinstance(gaps, list) and len(gaps) == len(parts) - 1 and all(_whole(g, None) for g in gaps), wrong)
    _need(all(isinstance(data[k], (int, float)) for k in ("turn", "step", "index")) and (not tool or isinstance(data["id"], str) and isinstance(data.get("name", ""), str)), wrong)
    own = {"index": data["index"]} | ({k: data[k] for k in ("id", "name") if k in data} if tool else {})
    time = row["time0"]
    out = []
    for i, part in enumerate(parts):
        time += gaps[i - 1] if i else 0
        _need(_whole(time, None) and _whole(row["seq0"] + i), wrong)
        out.append({"type": "assistant/chunk", "seq": row["seq0"] + i, "time": time, "data": {"turn": data["turn"], "step": data["step"], "chunk": {"type": delta, **own, text: part}}})
    return out


def check_header(header: object) -> dict:
    """The session's facts of a valid header."""
    _need(isinstance(header, dict) and _whole(header.get("version")) and header["version"] <= 4, "first record is no header of a known version")
    version = int(header["version"])
    optional = {"cwd": str, "parentSession": str, "agentPreset": str}
    ok = header.get("type") == "session" and isinstance(header.get("id"), str) and header["id"] and _whole(header.get("createdAt"))
    ok = ok and all(isinstance(header[k], t) for k, t in optional.items() if k in header) and header.get("origin", "subagent") == "subagent"
    if version >= 2:
        ok = ok and isinstance(header.get("isSeeded"), bool) and _whole(header.get("delegationDepth")) and header.keys() <= MODERN_HEADER
    else:
        ok = ok and _whole(header.get("delegationDepth", 0)) and _whole(header.get("seedLength", 0))
    _need(ok, f"header of version {version} has wrong fields")
    _need(not header.keys() & {"sandboxMode", "approvalPolicy"}, "header has fields that were given up")
    return {"generation": version, "compatibility": VERSIONS[version], "id": header["id"], "created_at": int(header["createdAt"]), "cwd": header.get("cwd", ""), "agent_preset": header.get("agentPreset", ""), "parent_session": header.get("parentSession")}


_ROLES = {"tool/result": {"user", "tool"}, "system/message": {"system"}, "developer/message": {"developer"}, "assistant/message": {"assistant"}, "user/message": {"user"}}


def check_message(event: dict, generation: int) -> None:
    kind, data = event["type"], event.get("data")
    _need(isinstance(data, dict), f"data of {kind} is no object")
    m = data if kind == "user/message" else data.get("message")
    _need(isinstance(m, dict), f"message of {kind} is no object")
    _need(("id" not in m or isinstance(m["id"], str) and m["id"]) and m.get("role") in _ROLES[kind] and isinstance(m.get("content"), list), f"message of {kind} has a wrong id, role or content")
    source = m.get("source")
    named = lambda k: isinstance(source.get(k), str) and source[k]
    _need(isinstance(source, dict) and named("kind"), f"message of {kind} lacks the kind of its source")
    if kind == "assistant/message":
        _need(source["kind"] == "model" and named("provider") and named("model"), "an assistant's message comes from a model")
    elif kind == "system/message":
        direct = source["kind"] in ("system-prompt", "runtime-context", "plugin")
        _need(direct if generation >= 4 else source["kind"] == "plugin" and named("plugin"), "a system's message names who put it in")
    elif kind == "tool/result":
        _need(source["kind"] == "tool" and isinstance(source.get("callId"), str), "a result comes from a tool call")


def _masked(data: dict, generation: int, other: list) -> object:
    """A tool result without what a replacement may change."""
    content = data["message"]["content"]
    wrap = lambda c: len(c) == 1 and isinstance(c[0], dict) and c[0].get("type") == "tool-result"
    wrapped = wrap(content) and wrap(other)
    if not wrapped:
        _need(not content or not other or generation >= 4, "results that replace each other differ in form")
    kept = [{**content[0], "content": None}] if wrapped else None
    return {**data, "message": {**data["message"], "content": kept}}


class Surface:
    """State of one log: header, next seq, and the ordered messages that are visible."""

    def __init__(self, header: dict | None = None, next_seq: int = 0, extra_types: frozenset[str] = frozenset()):
        self.header, self.next_seq, self.base, self.extra_types = header, next_seq, next_seq, extra_types
        self.shown: dict[int, dict] = {}  # by seq; before and after link them in the order they are shown
        self.before: dict[int, int | None] = {}
        self.after: dict[int, int | None] = {}
        self.last: int | None = None
        self.replaced = 0

    def _link(self, a: int | None, b: int | None) -> None:
        if a is not None:
            self.after[a] = b
        if b is not None:
            self.before[b] = a
        else:
            self.last = a

    def take(self, record: object) -> list[dict]:
        """Consume a line's record; the events it holds."""
        if self.header is None:
            self.header = check_header(record)
            return []
        _need(isinstance(record, dict), "record is no object")
        events = [record] if self.header["generation"] >= 2 else unpack(record)
        for e in events:
            self._event(e)
        return events

    def _event(self, e: dict) -> None:
        generation = self.header["generation"]
        seq = e.get("seq")
        _need(not _whole(seq) or seq == self.next_seq, f"event {self.next_seq} is missing", "sequence_mismatch")
        _need(e.keys() <= ENVELOPE and isinstance(e.get("type"), str) and _whole(seq) and _whole(e.get("time"), None) and "data" in e and e.get("ignorable", True) is True, f"event {self.next_seq} has wrong fields")
        self.next_seq += 1
        kind = e["type"]
        _need(generation >= 2 or kind != "request/header-delta", "request/header-delta is no longer read")
        sources = expand_ranges(e["sourceEventSeqs"], int(seq)) if "sourceEventSeqs" in e else None
        if kind not in SURFACE[generation]:
            _need("surfaceOp" not in e and sources is None, f"{kind} shows nothing but says where")
            known = LOG_ONLY if generation < 2 else LOG_ONLY_MODERN
            _need(kind in known or kind in self.extra_types or e.get("ignorable") is True, f"event {seq} is of an unknown type that may not be skipped: {kind}")
            return
        check_message(e, generation)
        self._fold(e, sources)

    def _fold(self, e: dict, sources: list[int] | None) -> None:
        op, seq, kind = e.get("surfaceOp"), int(e["seq"]), e["type"]
        _need(op is not None, f"{kind} doesn't say where it shows")
        _need(sources is None or (sources or kind == "assistant/message") and all(s < seq for s in sources) and len(set(sources)) == len(sources), f"event {seq} cites what isn't before it")
        if op == "append":
            self._link(self.last, seq)
            self._link(seq, None)
            self.shown[seq] = e
            return
        _need(isinstance(op, dict) and op.get("op") == "replace", f"event {seq} says unclearly where it shows")
        modern = self.header["generation"] >= 2
        first, last = (op.get("start", op.get("startSeq")), op.get("end", op.get("endSeq"))) if modern else (op.get("start"), op.get("end"))
        _need(_whole(first) and _whole(last) and (modern or op.keys() == {"op", "start", "end"}), f"event {seq} replaces what isn't shown")
        self.replaced += 1
        first, last = int(first), int(last)
        outside = self.base > 0 and min(first, last) < self.base
        hidden = [first] if first in self.shown and last in self.shown else []
        while hidden and hidden[-1] is not None and hidden[-1] != last:
            hidden.append(self.after[hidden[-1]])
        _need(hidden and hidden[-1] is not None, f"event {seq} replaces what isn't shown", "cross_window_reference" if outside else "compatibility_reject")
        _need(set(hidden) <= set(sources or ()), f"event {seq} hides events it doesn't cite", "surface_replace")
        if kind == "tool/result":
            target = self.shown[first]
            _need(len(hidden) == 1 and target["type"] == "tool/result", "a result replaces one result")
            old, new = target["data"], e["data"]
            generation = self.header["generation"]
            _need(_masked(old, generation, new["message"]["content"]) == _masked(new, generation, old["message"]["content"]), "a result that replaces another may differ in content alone")
        self._link(self.before[first], seq)
        self._link(seq, self.after[last])
        for x in hidden:
            del self.shown[x], self.before[x], self.after[x]
        self.shown[seq] = e

    def by_source(self) -> list[dict]:
        return [self.shown[x] for x in sorted(self.shown)]


_TRIM = " \t\n\r\v\f                　﻿" + "".join(chr(c) for c in range(0x2003, 0x200B))


def message_text(event: dict) -> str:
    data = event["data"]
    content = data.get("content") if event["type"] == "user/message" else data["message"].get("content") if event["type"] == "assistant/message" else None
    if not isinstance(content, list):
        return ""
    return " ".join(x["text"] for x in content if isinstance(x, dict) and x.get("type") == "text" and isinstance(x.get("text"), str)).strip(_TRIM)


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


def identity(session_id: str, generation: int, event: dict, text: str, tool: str = "") -> dict:
    """Anchor and evidence of a message: bound to the writer's id where there is one, else to place and content."""
    data, kind = event["data"], event["type"]
    m = data if kind == "user/message" else data.get("message")
    m = m if isinstance(m, dict) else {}
    own = m.get("id") if isinstance(m.get("id"), str) and m.get("id") else None
    source = m.get("source") if isinstance(m.get("source"), dict) else {}
    call = (data.get("callId") if data.get("callId") is not None else data.get("id")) if kind == "tool/call" else source.get("callId")
    call = call if isinstance(call, str) and call else None
    evidence = digest([text, tool])
    seq = int(event["seq"])
    anchor = "a1:" + digest([session_id, kind, "message" if own else "call", own or call]) if own or call else "a1s:" + digest([session_id, kind, generation, seq, evidence])
    return {"anchor_id": anchor, "event_seq": seq, "event_type": kind, "source_message_id": own, "call_id": call, "generation": generation, "identity_evidence": evidence}


class FoldedLog:
    """One log, line by line, to a metadata row and message rows."""

    def __init__(self, file: str, max_messages: int | None = MAX_MESSAGES, max_text_bytes: int | None = MAX_TEXT_BYTES, extra_types: frozenset[str] = frozenset()):
        self.file = file
        self.max_messages, self.max_text_bytes = (math.inf if x is None else x for x in (max_messages, max_text_bytes))
        self.surface = Surface(extra_types=extra_types)
        self.counts, self.tools = Counter(), Counter()
        self.calls: list[dict] = []
        self.last_time, self.title = 0, ""
        self.error: LogError | None = None
        self.reasons: list[str] = []
        self.lines = self.end_offset = 0

    def line(self, text: str) -> None:
        self.lines += 1
        if self.error is not None or text == "":
            return
        try:
            try:
                record = json.loads(text)
            except (ValueError, RecursionError):
                raise LogError("a line isn't JSON") from None
            for e in self.surface.take(record):
                self._count(e)
        except LogError as x:
            self.error = x

    def unread(self, oversized: bool, error: str | None, code: str | None) -> None:
        """A line without its text: one beyond the limit makes the log incomplete, a read error takes it out."""
        if oversized:
            self.lines += 1
            self._incomplete("oversized-jsonl-lines")
        elif self.error is None:
            self.error = LogError(error or "", code or "unknown")

    def _count(self, e: dict) -> None:
        kind, data = e["type"], e.get("data")
        self.counts[kind] += 1
        self.last_time = max(self.last_time, int(e["time"]))
        if not isinstance(data, dict):
            return
        if kind == "session/title" and isinstance(data.get("title"), str) and data["title"]:
            self.title = data["title"]
        if kind == "tool/call" and isinstance(data.get("name"), str) and data["name"]:
            self.tools[data["name"]] += 1
            if len(self.calls) < self.max_messages:
                self.calls.append(e)
            else:
                self._incomplete("message-limit")

    def _incomplete(self, reason: str) -> None:
        if reason not in self.reasons:
            self.reasons.append(reason)

    def finish(self, partial: bool = False) -> tuple[dict, list[dict]]:
        if self.error is None and self.surface.header is None:
            self.error = LogError("no header")
        header = self.surface.header or {}
        meta = {
            "file": self.file, "ok": self.error is None, "error": str(self.error) if self.error else None, "error_code": self.error.code if self.error else None,
            "error_phase": self.error.phase if self.error else None, "retryable": self.error.retryable if self.error else None,
            "id": header.get("id"), "generation": header.get("generation"), "compatibility": header.get("compatibility"), "created_at": header.get("created_at"), "workspace": header.get("cwd"),
            "agent_preset": header.get("agent_preset"), "parent_session": header.get("parent_session"), "lines": self.lines, "end_offset": self.end_offset, "last_seq": self.surface.next_seq - 1,
        }
        rows: list[dict] = []
        first = last = ""
        used = 0
        if self.error is None or partial and self.surface.header is not None:
            visible = [(e, {"user/message": "user", "assistant/message": "assistant"}.get(e["type"])) for e in self.surface.by_source()]
            for e, role in sorted(visible + [(c, "tool") for c in self.calls], key=lambda x: x[0]["seq"]):
                text, tool = (message_text(e), "") if role in ("user", "assistant") else ("", e["data"].get("name", "")) if role == "tool" else ("", "")
                if not text and not tool:
                    continue
                first = first or (text if role == "user" else "")
                last = text if role == "assistant" else last
                size = len(text.encode("utf-8", "surrogatepass")) + len(tool.encode("utf-8", "surrogatepass"))
                if len(rows) >= self.max_messages:
                    self._incomplete("message-limit")
                elif size > self.max_text_bytes - used:
                    self._incomplete("text-byte-limit")
                else:
                    used += size
                    rows.append({"session_file": self.file, "session_id": header["id"], "role": role, "text": text, "tool_name": tool, **identity(header["id"], header["generation"], e, text, tool)})
        meta |= {
            "last_time": self.last_time, "title": self.title or first[:80], "first_user_text": first[:500], "last_assistant_text": last[:2000], "counts": dict(self.counts), "tool_call_counts": dict(self.tools),
            "tool_names": sorted(self.tools), "complete": not self.reasons, "reasons": self.reasons, "indexed_messages": len(rows), "indexed_text_bytes": used, "replaced": self.surface.replaced,
        }
        return meta, rows


_S, _L = pa.string(), pa.int64()
META_FIELDS = [
    ("file", _S), ("ok", pa.bool_()), ("error", _S), ("error_code", _S), ("id", _S), ("generation", _L), ("compatibility", _S), ("created_at", _L), ("workspace", _S), ("agent_preset", _S), ("parent_session", _S), ("lines", _L), ("end_offset", _L),
    ("last_seq", _L), ("last_time", _L), ("title", _S), ("first_user_text", _S), ("last_assistant_text", _S), ("counts", pa.map_(_S, _L)), ("tool_call_counts", pa.map_(_S, _L)), ("tool_names", pa.list_(_S)),
    ("error_phase", _S), ("retryable", pa.bool_()), ("complete", pa.bool_()), ("reasons", pa.list_(_S)), ("indexed_messages", _L), ("indexed_text_bytes", _L), ("replaced", _L),
]
MESSAGE_FIELDS = [(n, _L if n in ("event_seq", "generation") else _S) for n in ("session_file", "session_id", "role", "text", "tool_name", "anchor_id", "event_seq", "event_type", "source_message_id", "call_id", "generation", "identity_evidence")]
STATE_FIELDS = [("file", _S), ("state_version", _S), ("state", pa.binary())]
_FOLDED = pa.schema([("meta", pa.struct(META_FIELDS)), ("message", pa.struct(MESSAGE_FIELDS)), ("carried", pa.struct(STATE_FIELDS))])
#: Changes with what FoldedLog keeps; a state of another version isn't read.
STATE_VERSION = "2"


def _clean(x: object) -> object:
    if isinstance(x, str):
        return x.encode("utf-8", "replace").decode()
    if isinstance(x, dict):
        return {_clean(k): _clean(v) for k, v in x.items()}
    return [_clean(v) for v in x] if isinstance(x, list) else x


def fold_logs(lines: DataFrame, max_messages: int | None = MAX_MESSAGES, max_text_bytes: int | None = MAX_TEXT_BYTES, extra_types: frozenset[str] = frozenset(), partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(session rows, message rows) of log lines (file, line_no, line).

    Lines are sorted by (file, line_no) within each task and streamed, so a task holds one log's visible messages. The budgets
    bound what is given of a log and are reported as its reasons; None is no budget. extra_types are event types that a log may
    hold besides the known ones. A log with a bad line, seq gap or unknown required event gives a session row with ok = false
    and its error, and no messages; with partial, those before the line that couldn't be taken.
    """
    sessions, messages, _ = fold_on(lines, None, max_messages, max_text_bytes, extra_types, partial=partial)
    return sessions, messages


def fold_on(lines: DataFrame, states: DataFrame | None, max_messages: int | None = MAX_MESSAGES, max_text_bytes: int | None = MAX_TEXT_BYTES, extra_types: frozenset[str] = frozenset(), keep: bool = False, partial: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(session rows, message rows, states) of lines as sources.logs gives them, each log folded on from the state (file, state_version, state) of their lines so far.

    A log in lines without a state is folded from its first line; one in states without lines is given as it was. With keep,
    states has what the next lines are folded on to; a log that failed has none.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log: FoldedLog | None = None

        def emit(log: FoldedLog) -> Iterator[pa.RecordBatch]:
            blob = pickle.dumps(log) if keep and log.error is None else None
            meta, rows = log.finish(partial)
            out = [{"meta": meta, "message": None}] + [{"meta": None, "message": r} for r in rows]
            if blob is not None:
                yield pa.RecordBatch.from_pylist([{"carried": {"file": log.file, "state_version": STATE_VERSION, "state": blob}}], _FOLDED)
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_pylist([_clean(r) for r in out[i : i + 5000]], _FOLDED)

        for batch in batches:
            for file, line, blob, end, oversized, error, code in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if log is None or log.file != file:
                    if log is not None:
                        yield from emit(log)
                    log = FoldedLog(file, max_messages, max_text_bytes, extra_types)
                if blob is not None:
                    log = pickle.loads(blob)  # noqa: S301  written by this function
                elif oversized or error is not None:
                    log.unread(oversized, error, code)
                else:
                    log.line(line or "")
                log.end_offset = max(log.end_offset, end or 0)
        if log is not None:
            yield from emit(log)

    read = {"end_offset": "bigint", "oversized": "boolean", "error": "string", "error_code": "string"}
    own = [F.col(c) if c in lines.columns else F.lit(None).cast(t).alias(c) for c, t in read.items()]
    rows = lines.select("file", F.coalesce(F.col("line_no"), F.lit(0)).cast("long").alias("line_no"), "line", F.lit(None).cast("binary").alias("state"), *own)
    if states is not None:
        known = states.where(F.col("state_version") == STATE_VERSION)
        rows = rows.unionByName(known.select("file", F.lit(-1).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"), "state"), allowMissingColumns=True)
    ordered = rows.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line", "state", *read)
    folded = ordered.mapInArrow(run, from_arrow_schema(_FOLDED))
    if keep:
        folded = materialize(folded, "folded")
    return folded.where("meta is not null").select("meta.*"), folded.where("message is not null").select("message.*"), folded.where("carried is not null").select("carried.*")


def log_lines_of(session_log: DataFrame) -> DataFrame:
    """(file, line_no, line) rebuilt from rows of a session log: the header first, then events by seq, as the writer had them."""
    seq = F.col("seq")
    head = F.regexp_replace("data", "^\\s*\\{", '{"type":"session",')
    event = F.concat(F.lit('{"type":'), F.to_json(F.struct("type")).substr(F.lit(9), F.length(F.to_json(F.struct("type"))) - 9), F.lit(',"seq":'), seq.cast("string"), F.lit(',"time":'), F.col("time").cast("string"), F.lit(',"data":'), F.col("data"), F.when(F.col("surface_op").isNotNull(), F.concat(F.lit(',"surfaceOp":"'), F.col("surface_op"), F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    return session_log.where("data is not null").select("file", F.coalesce(seq + 1, F.lit(0)).alias("line_no"), F.when(F.col("type") == "session", head).otherwise(event).alias("line"))

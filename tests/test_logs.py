import json
import os

import pytest
import zstandard

from strandline.api import Engine
from strandline.operators import fold
from strandline.sources import logs
from strandline.streaming import ingest
from strandline.streaming.store import SnapshotStore, compact, coverage, prune


def user(seq, text, op="append", **more):
    return {"type": "user/message", "seq": seq, "time": 1000 + seq, "surfaceOp": op, "data": {"id": f"u{seq}", "role": "user", "source": {"kind": "user"}, "content": [{"type": "text", "text": text}]}, **more}


def reply(seq, text, op="append", **more):
    return {"type": "assistant/message", "seq": seq, "time": 1000 + seq, "surfaceOp": op, "data": {"turn": 1, "step": 1, "message": {"id": f"a{seq}", "role": "assistant", "source": {"kind": "model", "provider": "p", "model": "m"}, "content": [{"type": "text", "text": text}]}}, **more}


def result(seq, text, op="append", ok=False, **more):
    inner = {"type": "tool-result", "toolCallId": "c", "content": [{"type": "text", "text": text}], "isError": ok}
    return {"type": "tool/result", "seq": seq, "time": 1, "surfaceOp": op, "data": {"turn": 1, "step": 1, "message": {"id": "t", "role": "user", "source": {"kind": "tool", "callId": "c"}, "content": [inner]}}, **more}


def call(seq, name="grep"):
    return {"type": "tool/call", "seq": seq, "time": 5, "data": {"callId": "c1", "name": name, "arguments": "{}"}}


def header(version=3, **more):
    modern = {"isSeeded": False, "delegationDepth": 0} if version >= 2 else {}
    return {"type": "session", "version": version, "id": "sid", "createdAt": 7, "cwd": "/w", **modern, **more}


def folded(*records, **budget):
    log = fold.FoldedLog("file", **budget)
    for r in records:
        log.line(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False))
    return log.finish()


def test_visible_messages_and_metadata():
    title = {"type": "session/title", "seq": 3, "time": 9, "data": {"title": "T"}}
    meta, rows = folded(header(), user(0, " hello "), call(1), reply(2, "answer"), title, {"type": "odd/type", "seq": 4, "time": 1, "data": {}, "ignorable": True})
    assert meta["ok"] and meta["title"] == "T" and meta["counts"]["tool/call"] == 1 and meta["last_time"] == 1002 and meta["tool_names"] == ["grep"]
    assert [(r["role"], r["text"], r["tool_name"]) for r in rows] == [("user", "hello", ""), ("tool", "", "grep"), ("assistant", "answer", "")]
    assert meta["first_user_text"] == "hello" and meta["last_assistant_text"] == "answer"
    assert rows[0]["anchor_id"].startswith("a1:") and rows[0]["source_message_id"] == "u0" and rows[1]["call_id"] == "c1"


def test_identity_survives_new_numbers_but_not_new_text_without_id():
    a, b = user(0, "x"), user(9, "x")
    b["data"]["id"] = "u0"
    assert fold.identity("s", 3, a, "x")["anchor_id"] == fold.identity("s", 3, b, "x")["anchor_id"]
    del a["data"]["id"], b["data"]["id"]
    assert fold.identity("s", 3, a, "x")["anchor_id"].startswith("a1s:")
    assert fold.identity("s", 3, a, "x")["anchor_id"] != fold.identity("s", 3, b, "x")["anchor_id"]


def test_replacement_takes_the_place_of_what_it_cites():
    op = {"op": "replace", "startSeq": 0, "endSeq": 1}
    meta, rows = folded(header(), user(0, "old"), reply(1, "older"), user(2, "kept"), user(3, "summary", op, sourceEventSeqs=[[0, 1]]))
    assert meta["ok"] and [r["text"] for r in rows] == ["kept", "summary"] and meta["replaced"] == 1
    bad, _ = folded(header(), user(0, "old"), reply(1, "older"), user(2, "s", op, sourceEventSeqs=[0]))
    assert not bad["ok"] and bad["error_code"] == "surface_replace"
    bad, _ = folded(header(), user(0, "old"), user(1, "s", {"op": "replace", "startSeq": 5, "endSeq": 5}, sourceEventSeqs=[0]))
    assert not bad["ok"] and bad["error_code"] == "compatibility_reject"
    legacy = {"op": "replace", "start": 0, "end": 0}
    assert folded(header(0), user(0, "a"), user(1, "b", legacy, sourceEventSeqs=[0]))[0]["ok"]
    one = {"op": "replace", "startSeq": 0, "endSeq": 0}
    assert folded(header(), result(0, "long"), result(1, "short", one, sourceEventSeqs=[0]))[0]["ok"]
    assert not folded(header(), result(0, "long"), result(1, "short", one, ok=True, sourceEventSeqs=[0]))[0]["ok"]
    assert not folded(header(), user(0, "x"), result(1, "short", one, sourceEventSeqs=[0]))[0]["ok"]


@pytest.mark.parametrize(
    "records",
    [
        [], [user(0, "no header")], [header(5)], [header(3, extra=1)], [header(0, sandboxMode="x")], [header(3, id="")], [header(), user(1, "gap")], [header(), "{bad"], [header(), {**user(0, "x"), "odd": 1}],
        [header(), {"type": "unknown/required", "seq": 0, "time": 1, "data": {}}], [header(), {**call(0), "surfaceOp": "append"}], [header(0), {"type": "request/header-delta", "seq": 0, "time": 1, "data": {}}],
        [header(), {**user(0, "x"), "surfaceOp": None}], [header(), {**user(0, "x"), "ignorable": False}], [header(2), {**user(0, "x"), "type": "system/message"}], [header(), {**user(0, "x"), "sourceEventSeqs": [0]}],
    ],
)
def test_logs_that_are_rejected_whole(records):
    meta, rows = folded(*records)
    assert not meta["ok"] and meta["error"] and rows == []


def test_packed_rows_and_ranges():
    packed = {"type": "text-chunks", "seq0": 1, "time0": 10, "data": {"turn": 1, "step": 1, "index": 0, "dt": [5, -2], "texts": ["a", "b", "c"]}}
    assert [(e["seq"], e["time"], e["data"]["chunk"]["text"]) for e in fold.unpack(packed)] == [(1, 10, "a"), (2, 15, "b"), (3, 13, "c")]
    meta, _ = folded(header(1), user(0, "x"), packed, reply(4, "y"))
    assert meta["ok"] and meta["counts"]["assistant/chunk"] == 3 and meta["last_seq"] == 4
    packed["data"]["dt"] = [5]
    with pytest.raises(fold.LogError):
        fold.unpack(packed)
    assert fold.expand_ranges([3, [5, 8]]) == [3, 5, 6, 7, 8]
    for bad in ([[8, 5]], [5, [1, 2]], ["x"], [-1], 3):
        with pytest.raises(fold.LogError):
            fold.expand_ranges(bad)


def test_budgets():
    meta, rows = folded(header(), user(0, "a"), user(1, "b"), max_messages=1)
    assert len(rows) == 1 and meta["reasons"] == ["message-limit"] and not meta["complete"]
    meta, rows = folded(header(), user(0, "x" * 50), user(1, "b"), max_text_bytes=10)
    assert [r["text"] for r in rows] == ["b"] and meta["reasons"] == ["text-byte-limit"]


def pack(*records):
    text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records).encode()
    return zstandard.ZstdCompressor().compress(text)


def write(path, *frames, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(b"".join(frames))


def test_frames_and_decoding():
    a, b = pack(header()), pack(user(0, "x"))
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert logs.skippable(skip) and [f[2] for f in logs.frames(skip + b)] == [True, False]
    text, end = logs.decode(a + skip + b)
    assert text.count(b"\n") == 2 and end == len(a + skip + b)
    half = zstandard.ZstdCompressor().compress(b'{"cut":')
    assert logs.decode(a + half + b)[0] == logs.decode(a + b)[0]  # a frame cut by a crash in the middle
    with pytest.raises(logs.DecodeError) as e:
        logs.decode(a + b[:-4])
    assert e.value.code == "partial_frame"
    with pytest.raises(logs.DecodeError):
        logs.decode(b"junk and more")
    with pytest.raises(logs.DecodeError):
        logs.decode(a, most=3)
    assert list(logs.split_lines(b"ab\n\nlong line\nlast", 5)) == [("ab", False), (None, True), ("last", False)]


def test_scan_keeps_the_highest_generation(tmp_path):
    for name in ("session.jsonl.zstd", "session.v2.jsonl.zstd", "session.v10.jsonl.zstd", "session.v02.jsonl.zstd", "other.jsonl.zstd", "x.txt"):
        write(str(tmp_path / "a" / name), b"x")
    scan = logs.scan_logs(str(tmp_path))
    assert [os.path.basename(f["file"]) for f in scan.files] == ["other.jsonl.zstd", "session.v02.jsonl.zstd", "session.v10.jsonl.zstd"] and scan.complete
    assert logs.scan_logs(str(tmp_path), cap=1).truncated and not logs.scan_logs(str(tmp_path / "none")).complete
    assert logs.fingerprint(scan) == logs.fingerprint(logs.scan_logs(str(tmp_path)))


def test_reverse_lines(tmp_path):
    p = tmp_path / "f.jsonl"
    lines = [f"line {i} " + "é" * (i % 7) for i in range(50)]
    p.write_text("\n".join(lines) + "\n")
    got = list(logs.reverse_lines(str(p), block=37))
    assert [t for t, _ in got] == lines[::-1]
    data = p.read_bytes()
    assert all(data[s : s + len(t.encode())] == t.encode() for t, s in got)


def test_build_reconciles(spark, tmp_path):
    root, store = str(tmp_path / "logs"), SnapshotStore(spark, f"file://{tmp_path}/store")
    write(f"{root}/one/session.v3.jsonl.zstd", pack(header(id="one"), user(0, "first text")), pack(reply(1, "second text")))
    write(f"{root}/two/session.v3.jsonl.zstd", pack(header(id="two"), user(1, "gap")))
    write(f"{root}/three/session.jsonl.zstd", pack(header(0, id="three"), user(0, "legacy")))
    r = ingest.build(spark, root, store)
    assert (r["added"], r["failed"], r["removed"]) == (3, 1, 0)
    assert {x.id for x in store.read("sessions").collect()} == {"one", "three"} and store.read("messages").count() == 3
    write(f"{root}/one/session.v3.jsonl.zstd", pack(user(2, "third text")), mode="ab")
    os.remove(f"{root}/three/session.jsonl.zstd")
    r = ingest.build(spark, root, store)
    assert (r["updated"], r["removed"], r["added"]) == (1, 1, 1)  # the failed one is tried again
    assert sorted(x.text for x in store.read("messages").collect()) == ["first text", "second text", "third text"]
    e = Engine.of_store(store)
    assert e.search("third", mode="full")["hits"][0]["sessionId"] == "one" and e.list()["sessions"][0]["workspace"] == "/w" and e.summary("one")["lastAssistantText"] == "second text"
    hit = e.search("first text", mode="full")["hits"][0]
    near = e.scroll("one", store.read("messages").where("text = 'first text'").head().anchor_id)
    assert hit["kind"] in ("content", "meta") and [m["text"] for m in near["messages"]] == ["first text", "second text", "third text"]
    assert compact(store, 10**13) and not compact(store, 10**13 + 5) and store.read("messages").count() == 3
    failed = spark.createDataFrame([("f", "bad", "sequence_mismatch")], "file string, error string, error_code string")
    report = coverage(store.read("sessions"), failed)
    assert not report["complete"] and report["reasons"] == ["sequence_mismatch"] and coverage(store.read("sessions"), failed.limit(0))["complete"]
    again = ingest.build(spark, root, store)
    assert again["skipped"] == 1 and store.read("messages").count() == 3
    last = store.read("sessions").head().last_time
    assert prune(store, last + 200 * 86_400_000 + 10**13, 90) == 1 and store.read("messages").count() == 0
    assert store.health()["last_prune_count"] == 1


def test_stream_of_appends_equals_a_rebuild(spark, tmp_path):
    root, store = str(tmp_path / "logs"), SnapshotStore(spark, f"file://{tmp_path}/store")
    path = f"{root}/s/session.v3.jsonl.zstd"

    opened = []

    def run():
        opened.append(ingest.Follower(spark, root, store).step())

    write(path, pack(header(), user(0, "one")))
    run()
    last = pack(user(2, "both", {"op": "replace", "startSeq": 0, "endSeq": 1}, sourceEventSeqs=[0, 1]))
    write(path, pack(reply(1, "two")), last[: len(last) // 2], mode="ab")
    run()  # the frame under way waits
    assert sorted(r.text for r in store.read("messages").collect()) == ["one", "two"]
    whole = os.path.getsize(path) + len(last) - len(last) // 2
    write(path, last[len(last) // 2 :], mode="ab")
    run()
    assert [(r["delta"], r["reread"]) for r in opened] == [(0, 0), (1, 0), (1, 0)] and opened[2]["bytes"] < whole
    streamed = [r.text for r in store.read("messages").collect()]
    rebuilt = SnapshotStore(spark, f"file://{tmp_path}/other")
    ingest.build(spark, root, rebuilt)
    assert streamed == [r.text for r in rebuilt.read("messages").collect()] == ["both"]
    version = store.publish({}, batch=3)["version"]
    assert store.publish({}, batch=3)["version"] == version  # a batch that is in changes nothing
    assert store.read("checkpoints").count() == 1  # tables that a version doesn't give are carried over


def test_a_rewritten_log_is_read_whole(spark, tmp_path):
    root, store = str(tmp_path / "logs"), SnapshotStore(spark, f"file://{tmp_path}/store")
    path = f"{root}/s/session.v3.jsonl.zstd"
    write(path, pack(header(), user(0, "one")))
    assert ingest.quick(spark, root, store) == {"listed": 1} and store.read("sessions").head().detail_missing and store.read("messages") is None
    assert ingest.build(spark, root, store)["updated"] == 1 and not store.read("sessions").head().detail_missing
    write(path, pack(header(id="other"), user(0, "new text that is longer"), reply(1, "and a reply to it")))
    r = ingest.build(spark, root, store)
    assert r["reread"] == 1, str(r)
    assert sorted(x.text for x in store.read("messages").collect()) == ["and a reply to it", "new text that is longer"]
    assert store.current()["state"]["report"] == r
    write(f"{root}/t/session.v3.jsonl.zstd", pack(header(), user(1, "gap")))
    r = ingest.build(spark, root, store)
    bad = store.read("failures").collect()
    assert (r["failed"], r["raced"], r["bytes"]) == (1, 0, os.path.getsize(f"{root}/t/session.v3.jsonl.zstd")) and [(b.error_code, b.error_phase, b.retryable) for b in bad] == [("sequence_mismatch", "compatibility", False)]


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store", buckets=8)
    df = spark.range(40).selectExpr("concat('f', id) as file", "id as n")
    store.publish({"t": df})
    one = spark.createDataFrame([("f3", 99)], "file string, n bigint")
    now = store.upsert({"t": (one, one.select("file"))})
    assert sum(v == 2 for v, _ in now["parts"]["t"].values()) == 1 and now["tables"]["t"] == 40
    assert {r.file: r.n for r in store.read("t").collect()}["f3"] == 99
    store.upsert({"t": (one.limit(0), df.select("file"))})
    assert store.read("t").count() == 0 and store.read("none") is None


def test_stream_source_reads_tails(spark, tmp_path):
    root, path = str(tmp_path / "logs"), f"{tmp_path}/logs/s/session.v3.jsonl.zstd"
    logs.register(spark)

    def run():
        q = spark.readStream.format("session_logs").load(root).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return [json.loads(r.line).get("seq", -1) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("line_no").collect()]

    last = pack(user(1, "two"))
    write(path, pack(header(), user(0, "one")), last[: len(last) // 2])
    assert run() == [-1, 0]
    write(path, last[len(last) // 2 :], pack(user(2, "three")), mode="ab")
    assert run() == [-1, 0, 1, 2]
    scan, errors = logs.list_logs(spark, root)
    assert [r.file for r in scan.collect()] == [path] and errors.count() == 0 and logs.list_logs(spark, f"{root}/none")[1].count() == 1
    many = pack(header(), *(user(i, "x" * 2000) for i in range(900)))
    write(path, *[many] * 1, *(pack(user(900 + i, os.urandom(3000).hex())) for i in range(300)))
    part = logs.LogPart(path, os.path.getsize(path), 0.0, 0.0, head=5)
    assert len(list(logs.read_part(part))) == 5 and len(logs._head_bytes(part, 4096)) < os.path.getsize(path) / 2


def test_engine_over_a_store_tells_what_is_missing(spark, tmp_path):
    root, store = str(tmp_path / "logs"), SnapshotStore(spark, f"file://{tmp_path}/store")
    write(f"{root}/one/session.v3.jsonl.zstd", pack(header(id="one"), user(0, "a glacier melts")))
    ingest.build(spark, root, store)
    e = Engine.of_store(store, root=root)
    hit = e.search("glacier", mode="full")
    assert hit["totalExact"] and hit["coverage"]["complete"] and e.status()["health"] == "ok"
    write(f"{root}/two/session.v3.jsonl.zstd", pack(header(id="two"), user(0, "another glacier"), "x" * 10, user(2, "gap")))
    report = e.refresh()
    assert report["added"] == 1 and report["failed"] == 1
    hit = e.search("glacier", mode="full", max_line_bytes=4 << 20)
    assert {h["sessionId"] for h in hit["hits"]} == {"one", "two"} and not hit["totalExact"] and hit["coverage"]["diagnostics"][0]["file"].endswith("two/session.v3.jsonl.zstd")
    s = e.status()
    assert s["health"] == "partial" and s["lastReport"] == report and s["dirty"] == 0 and not s["building"] and not e.cancel()
    with pytest.raises(ValueError):
        e.search("glacier", max_line_bytes=1)
    f = ingest.follow(spark, root, store, poll=0.3, debounce=0.1)
    write(f"{root}/three/session.v3.jsonl.zstd", pack(header(id="three"), user(0, "third")))
    for _ in range(100):
        if store.read("sessions").count() == 2:
            break
        __import__("time").sleep(0.5)
    f.stop()
    assert store.read("sessions").count() == 2 and f.error is None


def test_vendor_types_are_given_exactly():
    odd = {"type": "web/some-search", "seq": 0, "time": 1, "data": {}}
    assert not folded(header(), odd)[0]["ok"] and folded(header(), odd, extra_types=frozenset({"web/some-search"}))[0]["ok"]
    assert not folded(header(), {**odd, "type": "web/other-search"}, extra_types=frozenset({"web/some-search"}))[0]["ok"]


def test_stale_and_orphaned_files(spark):
    from strandline.streaming import store as st

    sessions = spark.createDataFrame([("a", 1, 1.0, 1.0, False), ("b", 1, 1.0, 1.0, False), ("c", 1, 1.0, 1.0, True), ("d", 1, 1.0, None, False), ("e", 1, 1.0, 1.0, None)], "file string, size bigint, mtime_ms double, ctime_ms double, fts_dirty boolean")
    checks = spark.createDataFrame([("a", 1, 1.0, 1.0, "1", 2), ("b", 1, 2.0, 1.0, "1", 0), ("c", 1, 1.0, 1.0, "1", 0), ("d", 1, 1.0, None, "1", 0), ("x", 1, 1.0, 1.0, "1", 0)], "file string, size bigint, mtime_ms double, ctime_ms double, parser_version string, message_count bigint")
    messages = spark.createDataFrame([("a",), ("a",), ("y",)], "session_file string")
    assert sorted(r.file for r in st.stale(sessions, checks, messages, "1").collect()) == ["b", "c", "e"]
    assert sorted(r.file for r in st.orphans(checks, sessions, sessions).collect()) == ["x"]
    scan = sessions.select("file", "size", "mtime_ms", "ctime_ms").where("file <> 'a'")
    assert {r.file: r.state for r in st.changes(scan, sessions).collect()} == {"a": "removed", "b": "skipped", "c": "updated", "d": "updated", "e": "skipped"}
    assert st.removed_files(st.changes(scan, sessions), False).count() == 0


def test_deadline_cancels_its_jobs(spark):
    import time

    from strandline.runtime import deadline

    began = time.time()
    with pytest.raises(Exception), deadline(spark, 1.5):  # noqa: B017, PT011
        spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(40) or p for p in it), "id bigint").count()
    assert time.time() - began < 30 and spark.range(3).count() == 3

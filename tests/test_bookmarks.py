import json

import pytest

from strandline.api import Engine
from strandline.operators import bookmarks as b
from strandline.operators import summary

MESSAGES = "id bigint, session_file string, role string, text string, tool_name string, anchor_id string, event_seq bigint"
SESSIONS = "file string, id string, workspace string, title string, first_user_text string, created_at bigint, last_time bigint, updated_at bigint"


@pytest.fixture
def engine(spark, tmp_path):
    s = spark.createDataFrame([("f1", "s1", "/w", "Title", "", 1, 5, 1)], SESSIONS)
    m = spark.createDataFrame([(1, "f1", "user", "x", "", "anchor1", 0)], MESSAGES)
    clock = iter(range(1000, 9999))
    return Engine(spark, s, m, bookmark_file=str(tmp_path / "b.jsonl"), summary_file=str(tmp_path / "s.jsonl"), provider=lambda p, n: "A short  sentence. " * 9, clock=lambda: next(clock))


def test_add_list_remove(engine):
    first = engine.bookmark("add", sessionId="s1", anchorId="anchor1")
    assert not first["replaced"] and first["bookmark"]["label"] == "Title"
    again = engine.bookmark("add", sessionId="s1", anchorId="anchor1", label="other", note="n")
    assert again["replaced"] and again["bookmark"]["createdAt"] == first["bookmark"]["createdAt"] and again["bookmark"]["id"] == b.bookmark_id("s1", None, "anchor1")
    engine.bookmark("add", sessionId="s1")
    out = engine.bookmark("list")
    assert out["total"] == 2 and out["bookmarks"][0]["anchorStatus"] == "session" and out["bookmarks"][1]["anchorAvailable"] and not out["bookmarks"][0]["stale"]
    assert engine.bookmark("list", query="OTH")["matched"] == 1
    assert engine.bookmark("remove", sessionId="S1")["removed"] == 2 and engine.bookmark("list")["total"] == 0
    for bad in ({"action": "remove"}, {"action": "what"}, {"action": "add", "sessionId": "s1", "messageId": -1}):
        with pytest.raises(ValueError):
            engine.bookmark(**bad)
    with pytest.raises(LookupError):
        engine.bookmark("add", sessionId="gone")


def legacy(**more):
    return {"v": 1, "id": "i", "sessionId": "s", "sessionFile": "f", "messageId": 3, "label": "l", "title": "t", "workspace": "w", "createdAt": 1, "updatedAt": 2, **more}


def test_bad_lines_are_counted_and_block_writing(tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text(json.dumps(legacy()) + "\nnot json\n" + json.dumps(legacy(v=9)) + "\n\n" + json.dumps(legacy(updatedAt=7, own="kept")))
    found, bad = b.parse_lines(p.read_text())
    assert bad == 2 and len(found) == 1 and found[0]["updatedAt"] == 7 and found[0]["own"] == "kept" and found[0]["anchorStatus"] == "unresolved"
    with pytest.raises(b.CorruptBookmarks):
        b.add(str(p), {"sessionId": "s", "sessionFile": "f", "label": "", "title": "", "workspace": ""}, 1)


def test_migration_needs_proof_and_backup(tmp_path):
    p, backup = str(tmp_path / "b.jsonl"), str(tmp_path / "backup")
    rows = [legacy(legacyEvidence={"identityEvidence": "e", "anchorId": "a"}), legacy(id="j", messageId=4), legacy(id="k", messageId=None), legacy(v=2, id="m")]
    text = "\n".join(map(json.dumps, rows)) + "\n"
    (tmp_path / "b.jsonl").write_text(text)
    resolve = lambda x: {"status": "resolved", "anchorId": "a", "evidence": "e"}
    report = b.migrate(p, resolve)
    assert report["counts"] == {"resolved": 1, "unresolved": 1, "session": 1, "alreadyMigrated": 1} and (tmp_path / "b.jsonl").read_text() == text
    with pytest.raises(ValueError):
        b.migrate(p, resolve, dry_run=False)
    b.migrate(p, resolve, dry_run=False, backup=backup)
    assert open(backup).read() == text and b.migrate(p, resolve)["counts"] == {"alreadyMigrated": 4}


def test_summaries_are_cached_by_fingerprint(engine):
    out = engine.summary("s1")
    assert len(out["llmSummary"]) == 80 and "  " not in out["llmSummary"]
    engine.provider = lambda p, n: 1 / 0
    assert engine.summary("s1")["llmSummary"] == out["llmSummary"]
    meta = {"id": "s1", "file": "f1", "size": 99, "mtime_ms": None}
    assert summary.summary_of(meta, engine.summary_file, engine.provider, 1) is None
    text = summary.prompt({"title": "t" * 500, "first_user_text": "u" * 900, "counts": {f"k{i}": i for i in range(30)}})
    assert "t" * 121 not in text and "u" * 201 not in text and "k29=29 k28=28" in text and "k21" not in text

import datetime
import json
import random

import pandas as pd
import pytest

from strandline.llm import conversations as cv
from strandline.runtime import scratch_path

LOG = "line_id bigint, received_at timestamp, session_id string, type string, seq bigint, data string, flags string, reason int"
T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def human(text, ident=None, kind="user"):
    return "user/message", {"id": ident, "source": {"kind": kind}, "content": [{"type": "text", "text": text}, None, {"type": "file"}]}


def reply(text, ident=None):
    return "assistant/message", {"message": {"id": ident, "content": text}}


def rows_of(sessions):
    out = []
    for s, events in sessions.items():
        for seq, (kind, data) in events:
            out.append((len(out), T0 + datetime.timedelta(seconds=random.randint(0, 10**6)), s, kind, seq, data if isinstance(data, str) or data is None else json.dumps(data)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], LOG)


CASES = {
    "good": [(None, ("session", {})), (0, human("q", "a")), (1, reply("r", "b")), (2, ("turn/end", {}))],
    "empty": [(0, ("turn/start", {})), (1, human(" \n", "c"))],
    "header only": [(None, ("session", {}))],
    "only bad": [(3, ("user/message", '{"cut'))],
    "gap": [(0, human("q")), (2, reply("r"))],
    "lost": [(0, human("q")), (1, reply("r")), (2, ("x", '{"cut'))],
    "covered": [(0, human("q")), (1, reply("r")), (1, ("x", None))],
    "clash": [(0, human("q", "d")), (0, reply("r", "e"))],
    "open end": [(0, human("q")), (1, reply("r")), (2, human("q2"))],
    "twice": [(0, human("q")), (1, human("q1")), (2, reply("r"))],
    "blank reply": [(0, human("q")), (1, reply("  "))],
    "plugin": [(0, human("note", kind="plugin")), (1, reply("r"))],
    "copy": [(0, human("q", "f")), (1, reply("r", "g")), (1, reply("r", " G "))],
    "": [(0, human("q")), (1, reply("r"))],
    "blank human": [(0, human("", "h")), (1, human("q")), (2, reply("r"))],
}
EXPECTED = {"empty": "empty", "header only": "empty", "only bad": "empty", "gap": "broken", "lost": "broken", "clash": "broken", "open end": "unanswered", "twice": "unanswered", "blank reply": "unanswered", "blank human": "unanswered"}


def test_reasons(spark):
    random.seed(1)
    df = frame(spark, [*rows_of(CASES), (999, None, None, "user/message", 0, "{}")])
    got = {r.session_id: r.reason for r in cv.session_verdicts(df).collect()}
    assert got.keys() == CASES.keys() and {k: v for k, v in got.items() if v} == EXPECTED
    turns = sorted((r.session_id, r.seq, r.role, r.text) for r in cv.conversations(df).collect())
    assert [t for t in turns if t[0] == "copy"] == [("copy", 0, "user", "q"), ("copy", 1, "assistant", "r")] and {t[0] for t in turns} == {"good", "plugin", "copy", "covered", ""}
    assert cv.session_verdicts(df.limit(0)).count() == 0


def test_long_sessions_are_folded_over_blocks(spark):
    old = cv.SEQ_BLOCK, cv.FAN_IN
    cv.SEQ_BLOCK, cv.FAN_IN = 4, 3
    try:
        random.seed(2)
        talk = [(2 * i, human(f"q{i}")) if j == 0 else (2 * i + 1, reply("r")) for i in range(60) for j in range(2)]
        cut = [e for e in talk if e[0] != 77]
        stuck = [(s, reply(" ")) if s == 63 else (s, e) for s, e in talk]
        got = {r.session_id: r.reason for r in cv.session_verdicts(frame(spark, rows_of({"talk": talk, "cut": cut, "stuck": stuck}))).collect()}
        assert got == {"talk": None, "cut": "broken", "stuck": "unanswered"}
    finally:
        cv.SEQ_BLOCK, cv.FAN_IN = old


@pytest.mark.parametrize("ends", [1, 3])
def test_any_split_of_the_stream_gives_the_same(spark, ends):
    """Rows in several deliveries, some after their conversation was closed and had left the state."""
    random.seed(ends)
    rows = [(s, seq, f, T0 + datetime.timedelta(minutes=random.randint(0, 600))) for s in "abc" for seq, f in enumerate([cv.PRESENT | cv.HUMAN | cv.HUMAN_SAID, cv.PRESENT | cv.REPLY | cv.SAID] * 4)]
    rows.sort(key=lambda r: r[3])
    base = scratch_path(spark, "split")
    groups = [rows] if ends == 1 else [rows[:8], rows[8:16], rows[16:]]
    found = cv.conversation_fragments(cv.delivered(spark, base), "1 minute", 600_000)
    for i, g in enumerate(groups):
        part = spark.createDataFrame([(ord(s) % 2, s, 0, seq, f, f"{s}{seq}", t) for s, seq, f, t in g], cv.ROW)
        part.coalesce(1).write.parquet(f"{base}/rows/{i}")
        if i + 1 == len(groups):
            cv._end(spark, 2, rows[-1][3]).write.parquet(f"{base}/rows/end")
        cv.run_available(found, base)
    emitted = spark.read.schema(cv.FRAGMENT).parquet(f"{base}/fragments")
    assert emitted.count() > 3 if ends == 3 else emitted.count() >= 3
    whole = cv.join_fragments(emitted)
    got = {r.session_id: (r.numbers, r.largest, r.stuck, r.last_sign) for r in cv.fold_fragments(whole, 1).collect()}
    assert got == {s: (8, 7, False, 2) for s in "abc"}
    texts = {r.session_id: sorted(r.texts) for r in whole.collect()}
    assert texts == {s: [f"{s}{i}" for i in range(8)] for s in "abc"}


def test_state_holds_open_conversations_only():
    """Closed entries leave the state, however many there were; an empty shard has none."""
    shard = cv._Shard()
    sizes = []
    for hour in range(50):
        t = hour * 3_600_000
        shard.add(pd.DataFrame({"session_id": [f"s{hour}"] * 20, "block": 0, "seq": range(20), "flags": cv.PRESENT, "touched": t, "text": "x" * 100}))
        shard.take(t, 2 * 3_600_000)
        sizes.append(len(shard.blob()))
        assert len(shard.rows) <= 40
        shard = cv._Shard(shard.blob())
    assert max(sizes[5:]) <= 1.1 * max(sizes[:5])
    assert len(shard.take(None, 10**12)) and not len(shard.rows)


def test_text_of():
    assert cv.text_of("a") == "a" and cv.text_of({"type": "text", "text": "b"}) == "b" and cv.text_of(None) == "" and cv.text_of(3) == ""
    assert cv.text_of(["x", None, {"type": "text"}, {"type": "text", "text": "y"}, {"type": "z", "text": "n"}]) == "x y"

"""Messages around a stable anchor, with the conversation's first and last ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOKENDS = 3
LONGEST_TEXT = 16_384


def _order():
    return F.coalesce("event_seq", "id"), F.col("id")


def _shown(df: DataFrame, *extra: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select("id", "anchor_id", "event_seq", "role", F.substring(text, 1, LONGEST_TEXT).alias("text"), (F.char_length(text) > LONGEST_TEXT).alias("text_truncated"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), *extra)


def resolve(messages: DataFrame, sessions: DataFrame, session_id: str, anchor: str | int) -> tuple[str | None, dict | None]:
    """(reason, pivot): the one file of the session and the one message of the anchor, or why there isn't one.

    A number names only a message without an anchor.
    """
    files = [r["file"] for r in sessions.where(F.col("id") == session_id).select("file").distinct().limit(2).collect()]
    if len(files) != 1:
        return ("ambiguous-session" if files else "session-missing"), None
    rows = messages.where(F.col("session_file") == files[0])
    rows = rows.where(F.col("anchor_id") == anchor) if isinstance(anchor, str) else rows.where((F.col("id") == anchor) & F.col("anchor_id").isNull())
    found = rows.select("id", "event_seq").limit(2).collect()
    if len(found) != 1:
        return ("ambiguous-anchor" if found else "anchor-expired"), None
    return None, {"file": files[0], "id": found[0]["id"], "seq": found[0]["event_seq"] if found[0]["event_seq"] is not None else found[0]["id"]}


def around(messages: DataFrame, pivot: dict, window: int = 5) -> DataFrame:
    """Up to `window` (1 to 20) messages before and after the pivot and itself, in order; two top-k scans of one session."""
    w = max(1, min(20, int(window)))
    seq, number = _order()
    at, i = pivot["seq"], pivot["id"]
    rows = messages.where(F.col("session_file") == pivot["file"])
    before = rows.where((seq < at) | ((seq == at) & (number < i))).orderBy(seq.desc(), number.desc()).limit(w)
    after = rows.where((seq > at) | ((seq == at) & (number >= i))).orderBy(seq, number).limit(w + 1)
    return _shown(before.unionByName(after).orderBy(seq, number))


def bookends(messages: DataFrame, file: str) -> DataFrame:
    """The first and the last BOOKENDS messages of a file; `side` is start or end."""
    seq, number = _order()
    rows = messages.where(F.col("session_file") == file)
    start = rows.orderBy(seq, number).limit(BOOKENDS).withColumn("side", F.lit("start"))
    end = rows.orderBy(seq.desc(), number.desc()).limit(BOOKENDS).withColumn("side", F.lit("end"))
    return _shown(start.unionByName(end), "side").orderBy(F.col("side").desc(), *_order())


def bookends_of_all(messages: DataFrame) -> DataFrame:
    """(session_file, side, place, id): the first and the last BOOKENDS messages of every file; place counts from its end.

    Each task keeps a file's first few before the shuffle, so a hot file costs no more than any other.
    """
    seq, number = _order()
    sides = []
    for side, order in (("start", (seq.asc(), number.asc())), ("end", (seq.desc(), number.desc()))):
        ranked = messages.select("session_file", "id", "event_seq", F.row_number().over(Window.partitionBy("session_file").orderBy(*order)).alias("place"))
        sides.append(ranked.where(F.col("place") <= BOOKENDS).select("session_file", F.lit(side).alias("side"), F.col("place").cast("long").alias("place"), "id"))
    return sides[0].unionByName(sides[1])


def legacy_anchor(messages: DataFrame, sessions: DataFrame, session_id: str, row: int) -> dict:
    """Anchor and evidence that a row number has now. It alone proves nothing about what an old bookmark meant, so the
    bookmark's own evidence has to agree."""
    files = sessions.where(F.col("id") == session_id).select(F.col("file").alias("session_file")).distinct()
    evidence = F.col("identity_evidence") if "identity_evidence" in messages.columns else F.lit(None).cast("string")
    found = messages.where(F.col("id") == row).join(files, "session_file", "left_semi").select("anchor_id", evidence.alias("evidence")).limit(2).collect()
    if len(found) != 1 or not found[0]["anchor_id"]:
        return {"reason": "unresolved-no-source-identity"}
    return {"anchorId": found[0]["anchor_id"], "evidence": found[0]["evidence"] or "", "reason": "requires-bookmark-evidence"}


#: Numbers of a session's order that are ranked together.
ORDER_BLOCK = 4096


def _places(messages: DataFrame) -> DataFrame:
    """(session_file, id, at): each message's place in its session from 1, ranked within blocks of the order and put behind the
    messages of the blocks before; so a hot session is spread over many tasks."""
    seq, number = _order()
    rows = messages.select("session_file", "id", "event_seq", F.floor(seq / ORDER_BLOCK).alias("block"))
    sizes = rows.groupBy("session_file", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("session_file").orderBy("block")) - F.col("n")).drop("n")
    inner = rows.withColumn("inner", F.row_number().over(Window.partitionBy("session_file", "block").orderBy(seq, number)))
    same = F.col("a.session_file").eqNullSafe(F.col("b.session_file")) & (F.col("a.block") == F.col("b.block"))
    return inner.alias("a").join(before.alias("b"), same).select("a.session_file", "a.id", (F.col("inner") + F.col("before")).alias("at"))


def windows_around(messages: DataFrame, pivots: DataFrame, window: int = 5) -> DataFrame:
    """The same for many anchors at once: (pivot_id, offset, id) for pivots (session_file, pivot_id)."""
    w = max(1, min(20, int(window)))
    seq, number = _order()
    ranked = _places(messages.join(pivots.select("session_file").distinct(), "session_file", "left_semi"))
    centre = ranked.join(pivots.select("session_file", F.col("pivot_id").alias("id")), ["session_file", "id"]).select("session_file", F.col("id").alias("pivot_id"), F.explode(F.sequence(F.col("at") - w, F.col("at") + w)).alias("place"), F.col("at").alias("centre"))
    near = ranked.withColumnRenamed("at", "place")
    return centre.join(near, ["session_file", "place"]).select("session_file", "pivot_id", (F.col("place") - F.col("centre")).alias("offset"), "id")

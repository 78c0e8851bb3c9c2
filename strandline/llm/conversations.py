"""Conversations rebuilt from message rows by keyed streaming state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators import dedup
from strandline.runtime import delete, make_folder, materialize, release, rename, scratch_path, shuffle_partitions

#: What is known of one seq of a session. PRESENT: a row that parses has it; HUMAN, REPLY: what that row is; SAID: its text isn't
#: blank; NAMED: it has a message id; CLASH: two messages with different ids have it; LOST: only seen on rows that don't parse.
PRESENT, HUMAN, REPLY, SAID, NAMED, CLASH, LOST, HUMAN_SAID = 1, 2, 4, 8, 16, 32, 64, 128
#: Not a row but the end of a shard's input.
END = 256
#: Numbers of a session that share a state entry and a fragment; longer sessions are split, so none is bound to one task.
SEQ_BLOCK = 1024
#: Fragments that are folded into one at each level above.
FAN_IN = 1024
#: Deliveries, in the order of receipt, that a log is replayed in.
DELIVERIES = 3
#: Rows and bytes of text that a shard of keyed state gets in all, about; there are at least as many shards as shuffle partitions.
SHARD_ROWS, SHARD_BYTES = 50_000, 32 << 20


def text_of(content: object) -> str:
    """The text of a message: its content elements of type text, or its plain string, joined by blanks."""
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        content = [content]
    if not isinstance(content, list):
        return ""
    parts = [e if isinstance(e, str) else e.get("text") for e in content if isinstance(e, str) or isinstance(e, dict) and e.get("type") == "text"]
    return " ".join(p for p in parts if isinstance(p, str))


def message_of(kind: str | None, value: object) -> tuple[str, str] | None:
    """(role, text) of a human message or a reply, None for any other record."""
    if not isinstance(value, dict):
        return None
    if kind == "user/message":
        source = value.get("source")
        return ("user", text_of(value.get("content"))) if isinstance(source, dict) and source.get("kind") == "user" else None
    if kind == "assistant/message":
        message = value.get("message")
        return "assistant", text_of(message.get("content") if isinstance(message, dict) else None)
    return None


def flags_of(kind: str | None, value: object, message: tuple[str, str] | None) -> int:
    flags = PRESENT
    if dedup.message_id(kind, value):
        flags |= NAMED
    if message:
        flags |= HUMAN if message[0] == "user" else REPLY
        if message[1].strip():
            flags |= HUMAN_SAID if message[0] == "user" else SAID
    return flags


class _Shard:
    """Open rows of a shard, as Arrow columns: session_id, block, seq, flags, touched (ms) and, where texts are kept, text."""

    schema = pa.schema([("session_id", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("flags", pa.int32()), ("touched", pa.int64()), ("text", pa.string())])

    def __init__(self, blob: bytes | None = None):
        self.rows = pa.ipc.open_stream(blob).read_all().to_pandas() if blob else self.schema.empty_table().to_pandas()

    def blob(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(pa.Table.from_pandas(self.rows, self.schema, preserve_index=False))
        return sink.getvalue().to_pybytes()

    def add(self, new: pd.DataFrame) -> None:
        self.rows = pd.concat([self.rows, new[self.schema.names]], ignore_index=True) if len(self.rows) else new[self.schema.names]

    def take(self, watermark: int | None, timeout: int) -> pd.DataFrame:
        """Rows of the entries that are timeout past their latest row, or of all with watermark None; they are kept no longer."""
        if watermark is None:
            ready = np.ones(len(self.rows), bool)
        else:
            latest = self.rows.groupby(["session_id", "block"], sort=False)["touched"].transform("max")
            ready = (latest + timeout <= watermark).to_numpy(bool)
        out, self.rows = self.rows[ready], self.rows[~ready]
        return out

    def next_due(self, timeout: int) -> int:
        """When the first entry may be due: no earlier than its first row."""
        return int(self.rows["touched"].min()) + timeout


def summarize(rows: pd.DataFrame) -> pd.DataFrame:
    """Fragments of raw rows in any order: the flags of a seq are joined, and two messages of different ids at one seq clash."""
    keys = ["session_id", "block", "seq"]
    order = rows.sort_values(keys, kind="stable")
    flags = order["flags"].to_numpy(np.int64)
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([order[k].to_numpy()[1:] == order[k].to_numpy()[:-1] for k in keys])
    start = np.flatnonzero(~same)
    out = order.iloc[start].copy()
    named = np.add.reduceat((flags & NAMED > 0).astype(np.int64), start)
    out["flags"] = np.bitwise_or.reduceat(flags, start) | np.where(named > 1, CLASH, 0)
    found = fragments(out)
    edges = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([order[k].to_numpy()[1:] != order[k].to_numpy()[:-1] for k in keys[:2]]), [True])))
    seqs, marks, texts = order["seq"].to_numpy(np.int64), flags.astype(np.int32), order["text"].to_numpy(object)
    found["seqs"] = [seqs[a:b] for a, b in zip(edges, edges[1:])]
    found["flags"] = [marks[a:b] for a, b in zip(edges, edges[1:])]
    found["texts"] = [texts[a:b] for a, b in zip(edges, edges[1:])]
    return found


def fragments(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each (session, block): what folding it with its neighbours needs. rows are sorted by seq; seq -1 is none.

    turns is the block's string of human messages and said replies, kept as its first and last sign and whether a human message
    is followed by another.
    """
    keys = ["session_id", "block"]
    flags = rows["flags"].to_numpy(np.int64)
    seq = rows["seq"].to_numpy(np.int64)
    start = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in keys]))))
    any_of = lambda x: np.logical_or.reduceat(x, start)
    present = (flags & PRESENT > 0) & (seq >= 0)
    said = flags & (SAID | HUMAN_SAID) > 0
    # signs in order: at one seq a human message comes before a reply
    part = np.zeros(len(rows), np.int64)
    part[start[1:]] = 1
    part = np.cumsum(part)
    human, reply = (flags & HUMAN > 0) & (seq >= 0), (flags & REPLY > 0) & (flags & SAID > 0) & (seq >= 0)
    at = np.arange(len(rows))
    place = np.concatenate((at[human] * 2, at[reply] * 2 + 1))
    order = np.argsort(place)
    sign = np.concatenate((np.ones(human.sum(), np.int64), np.full(reply.sum(), 2)))[order]
    owner = part[place[order] // 2]
    n = len(start)
    first, last, stuck = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    last[owner] = sign  # the last write stays
    first[owner[::-1]] = sign[::-1]
    twice = (owner[1:] == owner[:-1]) & (sign[1:] == 1) & (sign[:-1] == 1)
    stuck[owner[1:][twice]] = True
    head = rows.iloc[start]
    return pd.DataFrame({
        "session_id": head["session_id"].to_numpy(), "block": head["block"].to_numpy(np.int64), "numbers": np.add.reduceat(present.astype(np.int64), start),
        "largest": np.maximum.reduceat(seq, start), "said": any_of(said), "clash": any_of((flags & CLASH > 0) & (seq >= 0)),
        "first_sign": first, "last_sign": last, "stuck": stuck,
    })


SUMMARY = "numbers bigint, largest bigint, said boolean, clash boolean, first_sign bigint, last_sign bigint, stuck boolean"
BODY = [c.split()[0] for c in SUMMARY.split(", ")]
FRAGMENT = f"session_id string, block bigint, {SUMMARY}, seqs array<bigint>, flags array<int>, texts array<string>"
ROW = "shard bigint, session_id string, block bigint, seq bigint, flags int, text string, event_time timestamp"


def conversation_fragments(stream: DataFrame, lateness: str, timeout_ms: int) -> DataFrame:
    """The stateful step: a stream of ROW to the fragments of closed conversations.

    The state is keyed by shard, a hash of (session, block of seq); a shard holds its open rows as columns, so Python is called
    once for each shard and not for each session. Rows are buffered whatever their order. A conversation's block is emitted when
    the watermark is timeout_ms past its latest row, or when its shard's input ends, and leaves the state; a shard without open
    rows has no state. A row that comes after that opens the block anew, and its next fragment carries on the one before:
    fragments of one block are joined by their rows (see join_fragments).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = _Shard(state.get[0] if state.exists else None)
        new = [b for b in batches if len(b)]
        ended = False
        if new:
            rows = pd.concat(new, ignore_index=True) if len(new) > 1 else new[0]
            ended = bool((rows["flags"] == END).any())
            rows = rows[rows["flags"] != END]
            shard.add(rows.assign(touched=rows["event_time"].astype("datetime64[ms]").astype("int64")))
        now = state.getCurrentWatermarkMs()
        ready = shard.take(None if ended else now, timeout_ms)
        if len(shard.rows):
            state.update((shard.blob(),))
            state.setTimeoutTimestamp(max(shard.next_due(timeout_ms), now + 1))
        elif state.exists:
            state.remove()
        if len(ready):
            yield summarize(ready)

    rows = stream.withWatermark("event_time", lateness)
    return rows.groupBy("shard").applyInPandasWithState(step, FRAGMENT, "open binary", "append", GroupStateTimeout.EventTimeTimeout)


def join_fragments(found: DataFrame) -> DataFrame:
    """One fragment for each (session, block): those that were emitted in several parts are summarized from their rows again."""
    listed = [F.flatten(F.collect_list(c)).alias(c) for c in ("seqs", "flags", "texts")]
    whole = found.groupBy("session_id", "block").agg(F.count("*").alias("parts"), F.any_value(F.struct(*BODY)).alias("only"), *listed)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(np.cumsum(batch["seqs"].map(len).to_numpy()) // SHARD_ROWS):
                sizes = part["seqs"].map(len).to_numpy()
                at = np.repeat(np.arange(len(part)), sizes)
                rows = pd.DataFrame({"session_id": part["session_id"].to_numpy()[at], "block": part["block"].to_numpy()[at], **{c: np.concatenate([np.asarray(x, t) for x in part[n]]) for c, n, t in (("seq", "seqs", np.int64), ("flags", "flags", np.int64), ("text", "texts", object))}})
                yield summarize(rows)

    done = whole.where("parts = 1").select("session_id", "block", "only.*", "seqs", "flags", "texts")
    return done.unionByName(whole.where("parts > 1").select("session_id", "block", "seqs", "flags", "texts").mapInPandas(again, FRAGMENT))


def fold_fragments(found: DataFrame, blocks: int) -> DataFrame:
    """One row for each session from its fragments, blocks (at most `blocks` of a session) in order, FAN_IN at a time.

    No task holds more than FAN_IN summaries of one session at once; there are as many levels as the longest session needs.
    """
    rows = found.select("session_id", (F.col("block") + 1).alias("block"), *BODY)  # the block of rows without seq comes first
    left = blocks + 1
    while True:
        up = F.floor(F.col("block") / FAN_IN)
        parts = F.sort_array(F.collect_list(F.struct("block", *BODY)))
        rows = rows.withColumn("up", up if left > FAN_IN else F.lit(0).cast("long")).groupBy("session_id", "up").agg(parts.alias("parts")).select("session_id", F.col("up").alias("block"), _fold(F.col("parts")).alias("x")).select("session_id", "block", "x.*")
        if left <= FAN_IN:
            return rows.drop("block")
        left = math.ceil(left / FAN_IN) + 1


def _fold(parts: Column) -> Column:
    zero = F.struct(
        F.lit(0).cast("long").alias("numbers"), F.lit(-1).cast("long").alias("largest"), F.lit(False).alias("said"), F.lit(False).alias("clash"),
        F.lit(0).cast("long").alias("first_sign"), F.lit(0).cast("long").alias("last_sign"), F.lit(False).alias("stuck"),
    )

    def join(a: Column, b: Column) -> Column:
        return F.struct(
            (a["numbers"] + b["numbers"]).alias("numbers"), F.greatest(a["largest"], b["largest"]).alias("largest"), (a["said"] | b["said"]).alias("said"), (a["clash"] | b["clash"]).alias("clash"),
            F.when(a["first_sign"] == 0, b["first_sign"]).otherwise(a["first_sign"]).alias("first_sign"), F.when(b["last_sign"] == 0, a["last_sign"]).otherwise(b["last_sign"]).alias("last_sign"),
            (a["stuck"] | b["stuck"] | ((a["last_sign"] == 1) & (b["first_sign"] == 1))).alias("stuck"),
        )

    return F.aggregate(parts, zero, join)


def replay(log: DataFrame, lateness: str, timeout_ms: int, texts: bool) -> tuple[DataFrame, int]:
    """(fragments of a log's conversations, one for each session and block, and the number of blocks of the longest session).

    Surplus copies are left out; the rest is written to the shared folder, split by time of receipt into DELIVERIES. Each is
    handed in and taken by the streaming query, which goes on from its checkpoint: the watermark moves, conversations that have
    been silent long enough are closed and leave the state, and rows that come for them later open them again. As deliveries
    are in order, no row is behind the watermark. The last one brings the end of every shard's input.
    """
    spark = log.sparkSession
    extra = {"flags": "int", "seq": "bigint", "text": "string"}
    keyed = dedup.keyed_rows(log, extra, lambda kind, seq, value: _row_of(kind, seq, value, texts), keep_unparsed=True)
    marked = dedup.mark_copies(keyed, ["seq", "flags", "text", "received_at"]).withColumn("seq", F.coalesce("seq", "number"))
    epoch = F.timestamp_seconds(F.lit(0))
    when = F.greatest(F.coalesce(F.col("received_at").cast("timestamp"), epoch), epoch)
    received = log.select(when.alias("at")).agg(F.percentile_approx(F.unix_millis("at"), [i / DELIVERIES for i in range(1, DELIVERIES)], 1000).alias("cuts"), F.max("at").alias("latest"), F.count("*").alias("n")).head()
    delivery = F.lit(0)
    for cut in received["cuts"] or []:
        delivery = delivery + (F.unix_millis("event_time") > cut).cast("int")
    seq = F.coalesce(F.when(F.col("seq") >= 0, F.col("seq")), F.lit(-1)).cast("long")
    rows = marked.where("(surplus is null or not surplus) and session_id is not null").select("session_id", F.floor(seq / SEQ_BLOCK).cast("long").alias("block"), seq.alias("seq"), F.coalesce("flags", F.lit(LOST)).cast("int").alias("flags"), "text", when.alias("event_time"))
    base = scratch_path(spark, "conversations")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = materialize(rows, "rows", observed={"blocks": F.max("block"), "bytes": F.sum(size)}) if texts else materialize(rows, "rows", observed={"blocks": F.max("block")})
    facts = rows._strandline_observed  # noqa: SLF001
    shards = max(shuffle_partitions(spark), math.ceil(received["n"] / SHARD_ROWS), math.ceil((facts.get("bytes") or 0) / SHARD_BYTES))
    shard = F.pmod(F.xxhash64("session_id", "block"), F.lit(shards)).cast("long").alias("shard")
    rows.select(shard, *rows.columns, delivery.alias("delivery")).write.partitionBy("delivery").parquet(f"{base}/waiting")
    release(rows)
    found = conversation_fragments(delivered(spark, base), lateness, timeout_ms)
    for i in range(DELIVERIES):
        if i + 1 == DELIVERIES:
            _end(spark, shards, received["latest"]).write.parquet(f"{base}/rows/end")
        rename(spark, f"{base}/waiting/delivery={i}", f"{base}/rows/{i}")
        run_available(found, base)
    emitted = spark.read.schema(FRAGMENT).parquet(f"{base}/fragments")
    whole = materialize(join_fragments(emitted), "fragments")
    delete(spark, base)
    return whole, (facts["blocks"] or 0) + 1


def _end(spark: SparkSession, shards: int, latest) -> DataFrame:  # noqa: ANN001
    """For each shard the end of its input."""
    when = F.lit(latest).cast("timestamp") if latest is not None else F.timestamp_seconds(F.lit(0))
    none = F.lit(None).cast("string")
    return spark.range(shards).select(F.col("id").alias("shard"), none.alias("session_id"), F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("seq"), F.lit(END).alias("flags"), none.alias("text"), when.alias("event_time")).coalesce(1)


def delivered(spark: SparkSession, base: str) -> DataFrame:
    """The stream of what is handed in."""
    make_folder(spark, f"{base}/rows")
    return spark.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{base}/rows")


def run_available(found: DataFrame, base: str) -> None:
    """Let the streaming query take what has been handed in, from its checkpoint on."""
    query = found.writeStream.format("parquet").option("path", f"{base}/fragments").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _row_of(kind: str | None, seq: int | None, value: object, texts: bool) -> tuple:
    message = message_of(kind, value)
    text = message[1].encode("utf-8", "replace").decode() if texts and message and message[1].strip() else None
    return flags_of(kind, value, message), seq, text


def reason_of() -> Column:
    return (
        F.when(~F.col("said"), "empty")
        .when((F.col("numbers") < F.col("largest") + 1) | F.col("clash"), "broken")
        .when(F.col("stuck") | (F.col("last_sign") == 1), "unanswered")
    )


def session_verdicts(log: DataFrame, lateness: str = "1 hour", timeout_ms: int = 3_600_000) -> DataFrame:
    """(session_id, reason, numbers, largest) of each session in a log; reason is null for a conversation that stands.

    The first reason that applies: 'empty' - no human message or reply says anything; 'broken' - a number from 0 to the largest
    seq is missing, or two messages with different ids share a seq; 'unanswered' - a human message gets no reply that says
    anything before the next human message or the end. Surplus copies are left out; rows that don't parse count only for the
    largest seq. Messages without a seq say something but have no place in the order; a human message comes before a reply of
    the same seq. Negative seqs are taken as none. A null received_at counts as earliest. Rows with a null session_id are
    ignored, extra columns too; an empty log gives an empty table.

    No texts are moved. See replay for the stream; a restart of a lost task replays from the shared folder.
    """
    found, blocks = replay(log, lateness, timeout_ms, texts=False)
    return fold_fragments(found, blocks).select("session_id", reason_of().alias("reason"), "numbers", "largest")


def conversations(log: DataFrame, lateness: str = "1 hour", timeout_ms: int = 3_600_000) -> DataFrame:
    """(session_id, seq, role, text): the turns of every conversation that stands, each once; seq orders them.

    The texts travel with the rows through the stream's state, so the log is read once and what is emitted is the conversation
    itself. Conversations come as rows, so one of any length fits; sort by (session_id, seq) or collect a session to read it.
    """
    found, blocks = replay(log, lateness, timeout_ms, texts=True)
    stands = fold_fragments(found, blocks).where(reason_of().isNull()).select("session_id")
    turn = F.explode(F.arrays_zip("seqs", "flags", "texts")).alias("t")
    turns = found.join(stands, "session_id", "left_semi").select("session_id", turn).where("t.seqs >= 0 and t.texts is not null")
    role = F.when(F.col("t.flags").bitwiseAND(HUMAN) > 0, "user").otherwise("assistant")
    return turns.select("session_id", F.col("t.seqs").alias("seq"), role.alias("role"), F.col("t.texts").alias("text"))

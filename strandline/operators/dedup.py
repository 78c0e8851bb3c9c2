"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.payload import parse_payload
from strandline.runtime import materialize, release

#: Numbers of one producer that are handled together; larger producers are split, so none is bound to one task.
RANGE_BLOCK = 4096

#: Where the identifier of a message lies, by record type.
MESSAGE_ID_AT = {"user/message": ("id",), "assistant/message": ("message", "id"), "system/message": ("message", "id"), "tool/result": ("message", "id")}


class SeenRanges:
    """Disjoint, merged ranges of the numbers seen of one producer (closed at both ends)."""

    def __init__(self, ranges: list[tuple[int, int]] = ()):
        self.lows = [lo for lo, _ in ranges]
        self.highs = [hi for _, hi in ranges]

    def accept(self, number: int) -> bool:
        """Whether the number was uncovered; it is covered afterwards."""
        i = bisect_right(self.lows, number) - 1
        if i >= 0 and number <= self.highs[i]:
            return False
        left = i >= 0 and self.highs[i] == number - 1
        right = i + 1 < len(self.lows) and self.lows[i + 1] == number + 1
        if left and right:
            self.highs[i] = self.highs.pop(i + 1)
            self.lows.pop(i + 1)
        elif left:
            self.highs[i] = number
        elif right:
            self.lows[i + 1] = number
        else:
            self.lows.insert(i + 1, number)
            self.highs.insert(i + 1, number)
        return True

    def cover(self, lo: int, hi: int) -> None:
        """Take a range as seen."""
        i, j = bisect_left(self.highs, lo - 1), bisect_right(self.lows, hi + 1)
        if i < j:
            lo, hi = min(lo, self.lows[i]), max(hi, self.highs[j - 1])
        self.lows[i:j], self.highs[i:j] = [lo], [hi]

    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.lows, self.highs))


def message_id(kind: str | None, value: object) -> str | None:
    """The identifier of a message in any case and padding, or None where a record has none."""
    for key in MESSAGE_ID_AT.get(kind, ("",)):
        value = value.get(key) if isinstance(value, dict) else None
    if not isinstance(value, str):
        return None
    return value.strip().lower().encode("utf-8", "replace").decode() or None


_KEY = [("row_id", T.LongType()), ("received_at", None), ("session_id", T.StringType()), ("scope", T.StringType()), ("ident", T.StringType()), ("number", T.LongType()), ("early", T.BooleanType())]


def keyed_rows(df: DataFrame, extra: dict[str, str] | None = None, extract: Callable | None = None, keep_unparsed: bool = False) -> DataFrame:
    """Rows of a session log with the key that copies share.

    A row whose message has an identifier gets it as ident; any other row is number `number` (its seq) of the producer
    (session_id, scope), scope being its type. Within each batch of the scan only the first copy keeps its key: the others
    are marked early, lose the key and so don't load the hot key's task. extract(type, seq, value) gives the columns `extra`.
    Rows that don't parse are left out, or kept marked by a null `early`.
    """
    extra = extra or {}
    stamp = df.schema["received_at"].dataType
    schema = T.StructType([T.StructField(n, t or stamp) for n, t in _KEY])
    for name, kind in extra.items():
        schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, stamps, sessions, types, seqs, texts = (batch.column(i) for i in range(6))
            clock = stamps.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids.to_numpy(zero_copy_only=False), clock)).tolist()
            sessions, types, seqs, texts = (x.to_pylist() for x in (sessions, types, seqs, texts))
            seen = set()
            out: dict[str, list] = {n: [] for n in ("take", "session_id", "scope", "ident", "number", "early", *extra)}
            for i in order:
                ok, _, value = parse_payload(texts[i])
                if not ok and not keep_unparsed:
                    continue
                ident = message_id(types[i], value) if ok else None
                key = (sessions[i], ident) if ident else (sessions[i], types[i], seqs[i])
                early = key in seen if ok else None
                if ok:
                    seen.add(key)
                out["take"].append(i)
                out["early"].append(early)
                whole = ok and not early
                out["session_id"].append(sessions[i] if whole or not ok else None)
                out["scope"].append(types[i] if whole and not ident else None)
                out["ident"].append(ident if whole else None)
                out["number"].append(seqs[i] if whole and not ident or not ok else None)
                if extra:
                    for name, x in zip(extra, extract(types[i], seqs[i], value) if ok else (None,) * len(extra)):
                        out[name].append(x)
            take = pa.array(out.pop("take"), pa.int64())
            arrays = [ids.take(take), stamps.take(take), *(pa.array(v, target.field(n).type) for n, v in out.items())]
            yield pa.RecordBatch.from_arrays(arrays, ["row_id", "received_at", *out])

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    narrow = df.select(F.col("line_id").cast("long").alias("a"), F.col("received_at").alias("b"), F.col("session_id").alias("c"), F.col("type").alias("d"), F.col("seq").cast("long").alias("e"), F.col("data").alias("f"))
    return narrow.mapInArrow(run, schema)


#: What accept_rows gives of the state: the key and, for a producer's block, one of its ranges.
_SEEN = "session_id string, scope string, ident string, block bigint, lo bigint, hi bigint"


def _in_arrival_order(keyed: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Rows (and the state they meet) by producer and block, the state first, then as they were received."""
    block = F.when(F.col("early").isNull() | F.col("early"), F.col("row_id")).otherwise(F.floor(F.col("number") / RANGE_BLOCK))
    none = F.lit(None).cast("long")
    rows = keyed.withColumns({"block": block, "lo": none, "hi": none, "phase": F.lit(1)})
    if seen is not None:
        known = seen.select(*_SEEN_COLUMNS).withColumns({"early": F.lit(False), "phase": F.lit(0)})
        rows = rows.unionByName(known, allowMissingColumns=True)
    late = F.col("received_at").isNull()
    keys = ["session_id", "scope", "ident", "block"]
    return rows.repartition(*keys).sortWithinPartitions("early", *keys, "phase", late, "received_at", "row_id")


_SEEN_COLUMNS = [c.split()[0] for c in _SEEN.split(", ")]


def accept_rows(keyed: DataFrame, carry: list[str] = (), seen: DataFrame | None = None, state: bool = False) -> DataFrame:
    """(row_id, surplus, session_id, number, *carry, scope, ident, block, lo, hi) for keyed_rows; surplus is false for a row that is accepted.

    The rows of a block of a producer's numbers come in the order they were received and meet the ranges seen so far: an
    uncovered number is accepted and covered, ranges that touch are merged. A row whose identifier is no number of a sequence (a
    message id, or a null number) is looked up by its exact key. `seen` is the state that earlier batches left (see accept_batch);
    with `state`, the state after these rows is given too, as rows with a null row_id: the ranges of each block met, the exact
    keys met. A task streams over its sorted part and holds the ranges of one block. Rows that didn't parse keep a null surplus.
    """
    names = ["row_id", "surplus", "session_id", "number", *carry, "scope", "ident", "block", "lo", "hi"]
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("surplus", T.BooleanType()), *(keyed.schema[c] for c in ("session_id", "number", *carry))])
    for name in names[4 + len(carry) :]:
        schema.add(name, T.StringType() if name in ("scope", "ident") else T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met = None, None  # the key in hand; its SeenRanges, or for an exact key whether it was seen

        def left() -> list[tuple]:
            if key is None or not state:
                return []
            return [(*key, *r) for r in met.ranges()] if isinstance(met, SeenRanges) else [(*key, None, None)]

        for batch in batches:
            early, numbers, known, lows, highs, *keys = (batch.column(c).to_pylist() for c in ("early", "number", "phase", "lo", "hi", "session_id", "scope", "ident", "block"))
            verdict: list[bool | None] = []
            closed: list[tuple] = []
            for is_early, number, phase, lo, hi, *own in zip(early, numbers, known, lows, highs, *keys):
                if is_early is not False:
                    verdict.append(is_early)
                    continue
                if own != key:
                    closed += left()
                    key, met = own, False if own[3] is None else SeenRanges()
                if own[3] is None:
                    verdict.append(met)
                    met = True
                elif phase:
                    verdict.append(not met.accept(number))
                else:
                    met.cover(lo, hi)
                    verdict.append(None)
            mine = pa.array(np.flatnonzero(batch.column("phase").to_numpy()))
            whole = pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(verdict, pa.bool_()), *(batch.column(c) for c in ("session_id", "number", *carry))], names[: 4 + len(carry)]).take(mine)
            yield _padded(whole, names, target)
            yield _state_rows(closed, names, target)
        yield _state_rows(left(), names, target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return _in_arrival_order(keyed, seen).mapInArrow(run, schema)


def _padded(batch: pa.RecordBatch, names: list[str], target: pa.Schema) -> pa.RecordBatch:
    have = batch.schema.names
    return pa.RecordBatch.from_arrays([batch.column(n).cast(target.field(n).type) if n in have else pa.nulls(len(batch), target.field(n).type) for n in names], names)


def _state_rows(rows: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_SEEN_COLUMNS)
    return _padded(pa.RecordBatch.from_arrays([pa.array(c, target.field(n).type) for n, c in zip(_SEEN_COLUMNS, columns)], _SEEN_COLUMNS), names, target)


def mark_copies(keyed: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(row_id, surplus, session_id, number, *carry) for keyed_rows: surplus is true for each copy but the first received."""
    return accept_rows(keyed, carry).select("row_id", "surplus", "session_id", "number", *carry)


def surplus_rows(df: DataFrame) -> DataFrame:
    """line_id of every surplus copy in a session log.

    Copies agree in session_id and message identifier (in any case and padding; blank is none), or, having none, in
    session_id, type and seq, null being equal to null. The earliest received_at stays, then the smallest line_id; a null
    received_at counts as latest. Rows whose data is null, empty or not JSON are never copies. Extra columns are ignored; an
    empty log gives an empty table.

    One shuffle of the keys (no texts); producers are split by RANGE_BLOCK numbers and repeated keys are thinned to one row
    for each batch of the scan before it.
    """
    return mark_copies(keyed_rows(df)).where("surplus").select(F.col("row_id").alias("line_id"))


def deduplicate(df: DataFrame) -> DataFrame:
    """The log without its surplus copies (rows that don't parse stay)."""
    return df.join(surplus_rows(df), "line_id", "left_anti")


def accept_batch(df: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(line_id of the rows of this delivery that are accepted, the state for the next one); rows that don't parse aren't judged.

    The state is what all deliveries so far have shown: ranges of numbers by producer and block, and exact keys. A row that any
    earlier delivery held is surplus, however late it comes. Only blocks and keys are kept, never rows; it is written to the
    shared folder.
    """
    if seen is not None:
        touched = materialize(keyed_rows(df), "delivery")
        out = materialize(accept_rows(touched, seen=seen, state=True), "accepted")
        release(touched)
    else:
        out = materialize(accept_rows(keyed_rows(df), state=True), "accepted")
    return out.where("row_id is not null and not surplus").select(F.col("row_id").alias("line_id")), out.where("row_id is null").select(*_SEEN_COLUMNS)


#: Blocks that are merged into one at each level, and levels: together they span 2 ** 60 numbers.
FAN_IN, LEVELS = 4096, 4


def merge_blocks(ranges: DataFrame) -> DataFrame:
    """(session_id, type, lo, hi) of ranges that lie within blocks, merged across blocks.

    Only a range at an end of its block can go on in another one. At each level such ranges of FAN_IN blocks are merged, at most
    two a block, so no task holds more than that of a producer, whatever its size.
    """
    size, going, done = RANGE_BLOCK, ranges, []
    at_edge = lambda size: (F.pmod(F.col("lo"), F.lit(size)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(size)) == 0)
    for _ in range(LEVELS):
        done.append(going.where(~at_edge(size)))
        upper = size * FAN_IN
        w = Window.partitionBy("session_id", "type", "up").orderBy("lo")
        rows = going.where(at_edge(size)).withColumn("up", F.floor(F.col("lo") / upper))
        fresh = (F.coalesce(F.lag("hi").over(w), F.col("lo") - 2) != F.col("lo") - 1).cast("long")
        rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
        going = rows.groupBy("session_id", "type", "up", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("up", "run")
        size = upper
    out = going
    for d in done:
        out = out.unionByName(d)
    return out


def seen_ranges(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(session_id, type, lo, hi, n): the disjoint ranges of numbers each producer has delivered, merged across blocks.

    The gaps between a producer's ranges are the numbers it never delivered.
    """
    state = accept_rows(keyed_rows(df), seen=seen, state=True).where("row_id is null and lo is not null")
    local = materialize(state.select("session_id", F.col("scope").alias("type"), "lo", "hi"), "ranges")
    return merge_blocks(local).withColumn("n", F.col("hi") - F.col("lo") + 1)

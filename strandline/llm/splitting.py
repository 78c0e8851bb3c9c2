"""Oversized texts cut at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units are UTF-16 code units.
LIMIT, OVERLAP = 4096, 128

#: Where an atomic segment may end, strongest first: paragraph, line, sentence, blank. An atom takes its boundary characters along.
_BOUNDARY = re.compile(r"(\n(?:[ \t]*\r?[ \t]*\n)+[ \t]*)|(\n)|([.!?;。！？；]+[ \t]*)|([ \t]+)")
PARAGRAPH, LINE, SENTENCE, BLANK, NONE = 4, 3, 2, 1, 0


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def utf16_units(text: Column) -> Column:
    """The same as a column expression."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16LE")), 1)


def atoms(text: str) -> Iterator[tuple[int, int, int]]:
    """(end of its bare text, end, strength of the boundary there) of each atomic segment; the last ends with the text."""
    end = 0
    for m in _BOUNDARY.finditer(text):
        end = m.end()
        yield m.start(), end, 5 - m.lastindex
    if end < len(text) or not text:
        yield len(text), len(text), NONE


def _merge(segments: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Merge neighbours of (end, units, strength of the boundary behind) over the weakest boundary first, while they fit the room."""
    n = len(segments)
    if n == 1:
        return segments
    ends, sizes, strength = (array("q", x) for x in zip(*segments))
    before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
    version = array("q", bytes(8 * n))  # -1: merged into the one before
    heap = [(strength[i], sizes[i] + sizes[i + 1], i, 0, 0) for i in range(n - 1) if sizes[i] + sizes[i + 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, joint, i, vi, vj = heapq.heappop(heap)
        j = after[i]
        if version[i] != vi or j >= n or version[j] != vj:
            continue
        sizes[i], strength[i], ends[i] = joint, strength[j], ends[j]
        version[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        version[i] += 1
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and sizes[a] + sizes[b] <= room:
                heapq.heappush(heap, (strength[a], sizes[a] + sizes[b], a, version[a], version[b]))
    return [(ends[i], sizes[i], strength[i]) for i in range(n) if version[i] >= 0]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """(where a text is cut, as ascending character offsets from 0 to its length; units of its longest stretch without a boundary).

    The atoms between natural boundaries start as segments; an atom beyond the room a piece has is cut to that room, never
    inside a surrogate pair. Adjacent pairs lie in a heap by the strength of their boundary, then by joint size; the weakest
    boundary is merged while the joint size plus the overlap fits the limit. The first piece has no overlap before it.

    What lies between two boundaries of a strength is merged over weaker ones before either is, whatever lies beyond, so each
    such part is merged as soon as it is read, and only the segments left of it are kept.
    """
    room = limit - overlap - 1  # one unit spare: an overlap may not begin inside a surrogate pair
    wide = not text.isascii() and any(c > "￿" for c in text)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in range(PARAGRAPH + 1)]  # by the weakest boundary that is still to be merged over

    def take(segment: tuple[int, int, int]) -> None:
        waiting[NONE].append(segment)
        for level in range(segment[2]):
            waiting[level + 1] += _merge(waiting[level], room) if len(waiting[level]) > 1 else waiting[level]
            waiting[level].clear()

    at = longest = 0
    for bare, end, s in atoms(text):
        longest = max(longest, units(text[at:bare]) if wide else bare - at)
        while True:
            stop, size = end, units(text[at:end]) if wide else end - at
            if size > room:
                stop, size = at + room, room
                if wide:  # as many characters as have room
                    stop, size = at, 0
                    while size + (2 if text[stop] > "￿" else 1) <= room:
                        size += 2 if text[stop] > "￿" else 1
                        stop += 1
            take((stop, size, s if stop == end else NONE))
            at = stop
            if stop == end:
                break
    rest: list[tuple[int, int, int]] = []
    for level in range(PARAGRAPH + 1):
        rest = waiting[level] + rest
        rest = _merge(rest, room) if rest else rest
    return [0] + [end for end, _, _ in rest], longest


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, own start, end) in characters: a piece is text[start:end], of which the part before own start repeats the last one."""
    return _with_overlap(text, cuts(text, limit, overlap)[0], overlap)


def _with_overlap(text: str, at: list[int], overlap: int) -> list[tuple[int, int, int]]:
    out = []
    for own, end in zip(at, at[1:]):
        start, shared = own, 0
        while start > 0 and shared < overlap:
            start -= 1
            shared += 2 if text[start] > "￿" else 1
        out.append((start, own, end))
    return out


def split_oversized(df: DataFrame, id_column: str = "id", text_column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, pieces, start, own_start, end, hard, text) of every text: offsets in characters, pieces how many its text has, hard
    whether the text has a stretch beyond the limit without a natural boundary.

    A text within the limit is one piece; an oversized one comes as pieces of at most `limit` UTF-16 units, each repeating the
    last `overlap` units of the one before (one more where that would halve a surrogate pair); without their overlaps the
    pieces make up the text. Null and empty texts give no piece. Repeated rows and null ids are kept; other columns of df are
    ignored. Short texts never leave the JVM; the rest is one map without a shuffle.
    """
    if overlap < 0 or limit < 2 * overlap + 4:
        raise ValueError("limit must be at least twice the overlap plus 4")
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # a text has at most as many units as bytes, so most are told by their byte length alone
    large = F.when(F.octet_length("text") <= limit, False).otherwise(utf16_units(F.col("text")) > limit)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece", "pieces", "start", "own_start", "end", "hard", "text"]
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):  # one text at a time: its pieces are as large as itself
                at, longest = cuts(text, limit, overlap)
                parts = _with_overlap(text, at, overlap)
                hard = int(longest > limit)
                n = len(parts)
                columns = [pa.array(range(n), pa.int64()), pa.array([n] * n, pa.int64()), *(pa.array([p[k] for p in parts], pa.int64()) for k in range(3)), pa.array([hard] * n, pa.int64()), pa.array([text[a:b] for a, _, b in parts], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n, pa.int64())), *columns], names)

    cut = rows.where(large).mapInArrow(run, f"id {id_type}, piece bigint, pieces bigint, start bigint, own_start bigint, end bigint, hard bigint, text string")
    zero = F.lit(0).cast("long")
    whole = rows.where(~large & (F.octet_length("text") > 0)).select("id", zero.alias("piece"), F.lit(1).cast("long").alias("pieces"), zero.alias("start"), zero.alias("own_start"), F.char_length("text").cast("long").alias("end"), zero.alias("hard"), "text")
    return cut.unionByName(whole)


def oversized(df: DataFrame, id_column: str = "id", text_column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, hard) of each text that the splitter divides: one row for each row of df."""
    return split_oversized(df, id_column, text_column, limit, overlap).where("pieces > 1 and piece = 0").select("id", "hard")

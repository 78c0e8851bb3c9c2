"""Containers of fixed capacity filled with texts of varying length."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokens import TOKENIZER, token_counts
from strandline.runtime import materialize

#: Tokens that are packed together; a shard loses at most the rounding to whole containers.
SHARD_TOKENS = 2_000_000
#: Part of the room that should be used before cost is balanced.
LEAST_FILL = 0.99
#: Cost of a sequence of n tokens of one text: LINEAR * n + n * n / QUADRATIC_SCALE.
LINEAR, QUADRATIC_SCALE = 1.0, 4096.0


def cost_of(sizes: np.ndarray) -> np.ndarray:
    """Attention within a text is quadratic in it, all else is linear."""
    return LINEAR * sizes + sizes.astype(float) ** 2 / QUADRATIC_SCALE


def _place(sizes: np.ndarray, capacity: int, bins: int) -> np.ndarray:
    """Container of each size (descending), opening another where none has room: the least cost among those with room.

    Containers lie in a heap by cost. One that is met without room for the size in hand is set aside by its room and comes back
    when a size fits it, so each size costs a logarithm of the containers.
    """
    bins = max(1, bins)
    room = [capacity] * bins
    cheapest = [(0.0, b) for b in range(bins)]
    aside: list[tuple[int, float, int]] = []  # by room, largest first
    out = np.empty(len(sizes), np.int64)
    for i, (size, own) in enumerate(zip(sizes.tolist(), cost_of(sizes).tolist())):
        while aside and -aside[0][0] >= size:
            _, cost, b = heapq.heappop(aside)
            heapq.heappush(cheapest, (cost, b))
        while cheapest and room[cheapest[0][1]] < size:
            cost, b = heapq.heappop(cheapest)
            heapq.heappush(aside, (-room[b], cost, b))
        if cheapest:
            cost, b = heapq.heappop(cheapest)
        else:
            cost, b = 0.0, len(room)
            room.append(capacity)
        room[b] -= size
        heapq.heappush(cheapest, (cost + own, b))
        out[i] = b
    return out


def _best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size (descending) by the tightest fit, without regard to cost."""
    waiting: dict[int, list[int]] = {}
    levels: list[int] = []
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for i, size in enumerate(sizes.tolist()):
        k = bisect_left(levels, size)
        if k == len(levels):
            b, left = opened, capacity - size
            opened += 1
        else:
            level = levels[k]
            b, left = waiting[level].pop(), level - size
            if not waiting[level]:
                del waiting[level]
                levels.pop(k)
        out[i] = b
        if left:
            if left not in waiting:
                insort(levels, left)
                waiting[left] = []
            waiting[left].append(b)
    return out


def pack(sizes: np.ndarray, capacity: int, least_fill: float = LEAST_FILL) -> np.ndarray:
    """Container number of each size (any order, none above capacity; sizes of 0 take no room).

    Sizes in descending order each go to the container of least cost that has room. The number of containers is the smallest,
    between the tokens' bare need and what this needs when started from a best fit's number, that holds all without opening
    another. Where texts are large against the capacity, balancing leaves small gaps everywhere; then the emptiest quarter, half
    or more of the containers is packed again by best fit, until least_fill of the room, or what best fit alone reaches, is used.
    """
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order]
    bins = max(1, math.ceil(int(ranked.sum()) / capacity))
    most = int(_best_fit(ranked, capacity).max(initial=0)) + 1
    best = _place(ranked, capacity, most)
    high = int(best.max(initial=-1)) + 1
    low = bins
    while low < high:
        k = (low + high) // 2
        placed = _place(ranked, capacity, k)
        used = int(placed.max(initial=-1)) + 1
        if used < high:
            high, best = used, placed
        low = k + 1 if used > k else low
    aim = max(most, math.ceil(bins / least_fill))
    for share in (0.25, 0.5, 0.75, 1.0):
        if high <= aim:
            break
        fill = np.bincount(best, weights=ranked, minlength=high)
        loose = np.argsort(fill, kind="stable")[: math.ceil(share * high)]
        again = np.isin(best, loose)
        fresh = _best_fit(ranked[again], capacity)
        count = int(fresh.max(initial=-1)) + 1
        if count < len(loose):
            kept = np.full(high, -1)
            tight = np.setdiff1d(np.arange(high), loose)
            kept[tight] = np.arange(len(tight))
            placed = kept[best]
            placed[again] = len(tight) + fresh
            best, high = placed, len(tight) + count
    out = np.empty(len(sizes), np.int64)
    out[order] = best
    return out


PLACED = "capacity bigint, shard bigint, id {id}, piece bigint, token_start bigint, token_end bigint, container bigint"


def pack_texts(df: DataFrame, capacities: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(capacity, container_id, id, piece, token_start, token_end) for each distinct capacity (column `capacity`) and text.

    A text above the capacity is divided into full containers and a rest; any other text stays whole. Null and empty texts
    take no room and are left out, as are capacities that are null or below 1; repeated ids are texts of their own; other
    columns are ignored. container_id is unique within a capacity.

    Texts are spread by a hash of id and text into shards of about SHARD_TOKENS tokens; each is packed by itself, so the largest task
    is bounded whatever the corpus. Only sizes are shuffled.
    """
    keyed = df.select(F.col(id_column), F.col(text_column), F.xxhash64(F.col(id_column), F.col(text_column)).alias("_hash"))
    counts = token_counts(keyed, id_column, text_column, tokenizer, ("_hash",)).where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id())
    sizes = materialize(counts, "sizes", observed={"total": F.sum("n_tokens")})
    total = sizes._strandline_observed["total"] or 0  # noqa: SLF001
    shards = max(1, math.ceil(total / SHARD_TOKENS))
    wanted = capacities.select(F.col("capacity").cast("long").alias("capacity")).where("capacity > 0").distinct()
    id_type = sizes.schema["id"].dataType.simpleString()
    spread = sizes.withColumn("shard", F.pmod("_hash", F.lit(shards)).cast("long"))
    # each shard meets the list of capacities; the list of any length is one row a shard, which Spark broadcasts by its size
    listed = wanted.agg(F.sort_array(F.collect_list("capacity")).alias("listed")).select("listed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    rows = spread.join(listed, "shard").withColumn("capacity", F.explode("listed")).drop("listed")
    full = F.expr("n_tokens div capacity")
    cut = F.when(F.col("n_tokens") > F.col("capacity"), full).otherwise(0)
    rows = rows.withColumn("cut", cut)
    whole = rows.where("cut > 0").select("capacity", "row", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("piece"))
    whole = whole.select("capacity", F.concat_ws("-", F.lit("w"), "row", "piece").alias("container_id"), "id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), ((F.col("piece") + 1) * F.col("capacity")).alias("token_end"))
    rest = rows.where("n_tokens > cut * capacity").select("capacity", "shard", "id", F.col("cut").cast("long").alias("piece"), (F.col("cut") * F.col("capacity")).cast("long").alias("token_start"), F.col("n_tokens").alias("token_end"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "token_end"], kind="stable")
        part["container"] = pack((part["token_end"] - part["token_start"]).to_numpy(np.int64), int(part["capacity"].iloc[0]))
        return part

    packed = rest.groupBy("capacity", "shard").applyInPandas(run, PLACED.format(id=id_type))
    packed = packed.select("capacity", F.concat_ws("-", F.lit("s"), "shard", "container").alias("container_id"), "id", "piece", "token_start", "token_end")
    return packed.unionByName(whole)


def fill_report(packed: DataFrame) -> DataFrame:
    """(capacity, containers, tokens, fill): how full the containers are."""
    each = packed.groupBy("capacity", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    out = each.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing as pk
from strandline.llm import tokens

SCHEMA = "doc_id bigint, text string, container_id int, n_tokens string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 90))
def test_pack_holds_all_within_capacity(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    at = pk.pack(sizes, capacity)
    used = np.bincount(at, weights=sizes) if len(sizes) else np.zeros(1)
    assert used.max(initial=0) <= capacity and len(at) == len(sizes)
    assert len(used) <= max(1, math.ceil(1.5 * sizes.sum() / capacity) + 1)


def scan(sizes, capacity, bins):
    """The cheapest container with room by looking at all."""
    room, cost, out = [capacity] * max(1, bins), [0.0] * max(1, bins), []
    for size, own in zip(sizes.tolist(), pk.cost_of(sizes).tolist()):
        able = [b for b in range(len(room)) if room[b] >= size]
        b = min(able, key=lambda b: (cost[b], b)) if able else len(room)
        if not able:
            room.append(capacity)
            cost.append(0.0)
        room[b] -= size
        cost[b] += own
        out.append(b)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 120), st.integers(0, 20))
def test_heap_finds_the_cheapest_container(sizes, capacity, bins):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    assert pk._place(sizes, capacity, bins).tolist() == scan(sizes, capacity, bins)


def test_any_number_of_capacities(spark):
    df = spark.createDataFrame([(1, "a b c d e", 0, "x"), (2, "f g", 0, "x")], SCHEMA)
    caps = spark.range(1, 1501).selectExpr("id as capacity")
    assert pk.pack_texts(df, caps).select("capacity").distinct().count() == 1500


def test_fill_and_balance():
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5, 1, 5000).astype(np.int64) + 1, 1024)
    for capacity in (1024, 4096):
        at = pk.pack(sizes, capacity)
        used = np.bincount(at, weights=sizes)
        cost = np.bincount(at, weights=pk.cost_of(sizes))
        assert sizes.sum() / (len(used) * capacity) >= 0.98
        order = np.arange(len(sizes))  # next fit in given order
        plain, room, b = np.zeros(len(sizes), np.int64), capacity, 0
        for i in order:
            if sizes[i] > room:
                b, room = b + 1, capacity
            plain[i], room = b, room - sizes[i]
        other = np.bincount(plain, weights=pk.cost_of(sizes))
        assert cost.std() < other.std()


def test_table(spark):
    random.seed(1)
    texts = ["word " * random.randint(1, 400) for _ in range(300)] + ["", None, " ", "one " * 5000, "same", "same"]
    df = spark.createDataFrame([(i if i < 304 else 305, t, 0, "x") for i, t in enumerate(texts)] + [(None, "null id", 0, "x")], SCHEMA)
    caps = spark.createDataFrame([(512,), (512,), (None,), (0,), (100,)], "capacity bigint")
    old = pk.SHARD_TOKENS
    pk.SHARD_TOKENS = 20_000
    try:
        rows = pk.pack_texts(df, caps).collect()
    finally:
        pk.SHARD_TOKENS = old
    size = {i: n for i, n in ((r.id, r.n_tokens) for r in tokens.token_counts(df).collect())}
    for cap in (512, 100):
        own = [r for r in rows if r.capacity == cap]
        used, parts = {}, {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.token_end - r.token_start
            parts.setdefault(r.id, []).append((r.piece, r.token_start, r.token_end))
        assert max(used.values()) <= cap
        for i, p in parts.items():
            if i == 305:
                continue
            p.sort()
            assert p[0][1] == 0 and p[-1][2] == size[i] and all(a[2] == b[1] for a, b in zip(p, p[1:]))
            assert len(p) == 1 or size[i] > cap and all(e - s == cap for _, s, e in p[:-1])
        assert {r.id for r in own} == {i for i, n in size.items() if n}
        assert len([r for r in own if r.id == 305]) == 2
    assert pk.pack_texts(df.limit(0), caps).count() == 0 and pk.pack_texts(df, caps.limit(0)).count() == 0


def test_counts_equal_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.TOKENIZER.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("Hello, world's end\n\n  x 123", "日本語 text", "aé  \t b", "don't we'll I've"):
        assert tokens.encoding(tokens.TOKENIZER).encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids

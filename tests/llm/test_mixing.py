import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import mixing as mx

DOCS = "doc_id bigint, text string, source string, mix string, copies int"
GOALS = "mix string, source string, target_share double, max_repeats int, tokens string"


def test_flow_is_least_cost():
    net = mx.Flow()
    net.add("s", "a", 4, 1)
    net.add("s", "b", 4, 3)
    net.add("a", "t", 3)
    far = net.add("a", "b", 9, 0)
    net.add("b", "t", 3)
    assert net.run("s", "t") == 6 and net.used(far) == 1


def test_route_shares_overlap_and_repeats():
    goal = {"x": (0.5, 2), "y": (0.5, 1)}
    total, flow = mx.route({("x",): 10, ("x", "y"): 10, ("y",): 10, ("z",): 99, (): 5}, goal)
    per = {s: sum(n for (p, t), n in flow.items() if t == s) for s in "xy"}
    assert abs(per["x"] - per["y"]) <= 1 and total >= 38
    assert mx.route({}, goal)[1] == {} and mx.route({("x",): 5}, {})[1] == {}
    assert mx.route({("x",): 10}, {"x": (1.0, 3)})[0] == 30
    total, flow = mx.route({("x",): 100}, {"x": (1.0, 3)}, total=150)
    assert flow == {(("x",), "x"): 150}


def test_mix(spark):
    random.seed(4)
    rows = [(i, f"text number {i} " + "word " * random.randint(5, 40), random.choice(["Alpha one", "alpha_one ", "ALPHA-ONE", "beta", "rare", None]) if i % 50 else "rare") for i in range(600)]
    rows = [(i, t, s if s != "rare" or i % 5 == 0 else "beta") for i, t, s in rows]
    rows += [(1000 + i, t, "rare") for i, t, s in rows[:10]] + [(2000, None, "beta"), (2001, "", "beta"), (2002, "only", "elsewhere")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    goals = spark.createDataFrame([("m", "alpha-one", 0.5, 1, ""), ("m", "beta", 0.3, 2, ""), ("m", "Rare", 0.2, 3, ""), ("m", "missing", 0.0, 1, ""), (None, "beta", 1.0, 1, ""), ("n", "beta", 1.0, 2, "")], GOALS)
    chosen, report = mx.mix_sources(df, goals)
    got = {(r.mix, r.source): r for r in report.collect()}
    for source, share, most in (("alpha-one", 0.5, 1), ("beta", 0.3, 2), ("rare", 0.2, 3)):
        r = got["m", source]
        assert r.actual_share == pytest.approx(share, abs=0.02) and 0 < r.most_copies <= most
    assert got["n", "beta"].actual_share == 1
    picked = chosen.collect()
    by_doc = {}
    for r in picked:
        by_doc[r.mix, r.doc_id, r.source] = by_doc.get((r.mix, r.doc_id, r.source), 0) + r.copies
    assert len(by_doc) == len(picked) and not {d for _, d, _ in by_doc} & {2000, 2001, 2002} and not any(d >= 1000 for _, d, _ in by_doc)
    again = sorted(map(tuple, mx.mix_sources(df.repartition(5), goals)[0].collect()))
    assert again == sorted(map(tuple, picked))
    assert mx.mix_sources(df.limit(0), goals)[0].count() == 0 and mx.mix_sources(df, goals.limit(0))[1].count() == 0


def test_many_patterns_fall_back_to_the_scarcest_sources(spark):
    random.seed(6)
    rows, n = [], 0
    for i in range(120):
        for s in random.sample("abcdef", random.randint(1, 4)):
            rows.append((n, f"text {i} " + "w " * (i % 17), s))
            n += 1
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], DOCS)
    goals = spark.createDataFrame([("m", s, 1 / 6, 2, "") for s in "abcdef"], GOALS)
    old = mx.MAX_PATTERNS
    try:
        for mx.MAX_PATTERNS in (25, 5):
            _, report = mx.mix_sources(df, goals)
            rows = report.collect()
            # a share misses by at most a text (of some 20 tokens) for each pattern that a source draws on
            assert all(abs(r.tokens - sum(x.tokens for x in rows) / 6) <= 25 * 6 for r in rows) and all(r.most_copies <= 2 for r in rows)
    finally:
        mx.MAX_PATTERNS = old


def test_many_patterns_keep_every_membership(spark):
    """p8_mixture: with more than MAX_PATTERNS patterns, a text still counts for each of its sources in each mix."""
    rows, n = [], 0
    for i in range(60):
        for s in ["common", *("abcdefghij"[k] for k in {i % 10, (i // 3 + 1) % 10, (i // 7 + 4) % 10})]:
            rows.append((n, f"text {i} " + "w " * (i % 17), s))
            n += 1
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], DOCS)
    goals = spark.createDataFrame([("one", "common", 1.0, 1, ""), *(("all", s, 0.1, 2, "") for s in "abcdefghij")], GOALS)
    old, got = mx.MAX_PATTERNS, []
    try:
        for mx.MAX_PATTERNS in (4096, 5):
            chosen, report = mx.mix_sources(df, goals)
            got.append((sorted(map(tuple, chosen.collect())), sorted(map(tuple, report.collect()))))
    finally:
        mx.MAX_PATTERNS = old
    assert got[0] == got[1]
    assert next(r for r in got[1][1] if r[0] == "one")[5] == 60  # documents: every text is one of "common"


def test_route_of_many_patterns_fits():
    random.seed(3)
    goal = {f"s{i}": (1 / 24, 3) for i in range(24)}
    patterns = {tuple(sorted(random.sample(sorted(goal), random.randint(1, 4)))): random.randint(1, 99) for _ in range(6000)}
    total, flow = mx.route(patterns, goal)
    per = {s: sum(n for (_, t), n in flow.items() if t == s) for s in goal}
    assert max(per.values()) - min(per.values()) <= 1 and sum(per.values()) >= 0.99 * 3 * sum(patterns.values())
    assert all(n <= 3 * patterns[p] for (p, _), n in flow.items())


def test_an_absent_source_leaves_the_others(spark):
    """p8_shares: a source without texts has share 0, the others keep their proportions."""
    total, flow = mx.route({("x",): 100, ("y",): 300}, {"x": (0.2, 1), "y": (0.3, 1), "gone": (0.5, 4)})
    assert 500 <= total < 505 and flow == {(("x",), "x"): 100, (("y",), "y"): int(0.3 * total)}
    df = spark.createDataFrame([(i, f"text {i}", "xy"[i % 2], "c", 1) for i in range(40)], DOCS)
    goals = spark.createDataFrame([("m", "x", 0.25, 1, ""), ("m", "y", 0.25, 1, ""), ("m", "gone", 0.5, 4, "")], GOALS)
    got = {r.source: r for r in mx.mix_sources(df, goals)[1].collect()}
    assert got["x"].documents == got["y"].documents == 20 and got["gone"].actual_share == 0 and got["gone"].target_share == 0.5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.lists(st.integers(0, 60), min_size=1, max_size=4), st.integers(1, 2))
def test_settled_cuts_lie_on_edges_and_miss_by_less_than_a_document(sizes, quotas, repeats):
    total = sum(sizes) * repeats
    edges = [0]
    for n in sizes * repeats:
        edges.append(edges[-1] + n)
    cuts, at = [], 0
    for i, q in enumerate(quotas):
        if at + q <= total and q:
            cuts.append((f"s{i}", at, at + q))
            at += q
    straddling = {x: next((a, b) for a, b in zip(edges, edges[1:]) if a < x < b) for _, lo, hi in cuts for x in (lo, hi) if x not in edges}
    over, held = defaultdict(int), defaultdict(int)
    out = mx.settle(cuts, straddling, over, held)
    assert [s for s, _, _ in out] == [s for s, _, _ in cuts]
    assert all(lo in edges and hi in edges and lo <= hi for _, lo, hi in out)
    assert all(b[1] >= a[2] for a, b in zip(out, out[1:]))
    for (s, a, b), (_, lo, hi) in zip(cuts, out):
        assert held[s] == hi - lo and over[s] == (hi - lo) - (b - a) and abs(over[s]) < 2 * max(sizes)

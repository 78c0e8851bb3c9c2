import random

import pytest

from strandline.operators import hierarchy, lineage
from strandline.operators.ordered import blocked_neighbours

TABLE = "id string, parent_session string, updated_at bigint, root_id string, depth int"


def brute(rows):
    best = {}
    for i, p, u in rows:
        if i is not None:
            name = (p or "").strip().lower()
            key = ((u is not None, u or 0), p is not None, name)
            if i not in best or key > best[i][0]:
                best[i] = (key, name)
    by_name = {}
    for i in sorted(best, reverse=True):
        by_name[i.strip().lower()] = i
    parent = {i: by_name.get(n) if n else None for i, (_, n) in best.items()}
    out = {}
    for i in best:
        chain, at = [i], i
        while parent[at] is not None and parent[at] not in chain:
            at = parent[at]
            chain.append(at)
        out[i] = ("", -1) if parent[at] is not None else (at, len(chain) - 1)
    return out, parent


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], TABLE)


def check(spark, rows, paths=True):
    expected, parent = brute(rows)
    h = hierarchy.build_hierarchy(frame(spark, rows))
    h = hierarchy.add_paths(h) if paths else h
    got = {r.session_id: r for r in h.collect()}
    assert {i: (r.root_id, r.depth) for i, r in got.items()} == expected
    below = {i: set() for i in expected}
    for i in expected:
        at = i
        for _ in range(expected[i][1]):
            at = parent[at]
            below[at].add(i)
    for i, r in got.items():
        if r.depth >= 0:
            assert r.descendants == len(below[i])
            inside = {j for j, x in got.items() if x.root_id == r.root_id and r.entry < x.entry < r.exit}
            assert inside == below[i]
            if paths:
                assert r.path.split("/")[-1] == i and len(r.path.split("/")) == r.depth + 1 and r.path.split("/")[0] == r.root_id
    return h, below


def test_random_forest_with_cycles(spark):
    random.seed(3)
    rows = [("a", None, 1), ("b", " A ", 1), ("c", "", 1), ("d", "  ", 2), ("e", "nowhere", 1), ("self", "SELF", 1), ("x", "y", 1), ("y", "z", 1), ("z", "X", 1), ("tail", "x", 1), ("tail2", "tail", 1), (None, "a", 1), ("null version", "a", None), ("b", "c", None), ("b", " A ", 1)]
    rows += [(f"n{i}", random.choice([f"n{random.randint(0, i)}", f"N{random.randint(max(0, i - 3), i)} ", None, f"n{random.randint(0, 150)}"]), i) for i in range(150)]
    h, below = check(spark, rows)
    wanted = spark.createDataFrame([("a",), ("n0",), ("x",), ("none",)], "session_id string")
    got = {(r.session_id, r.descendant_id) for r in hierarchy.descendants_of(h, wanted).collect()}
    expected, _ = brute(rows)
    assert got == {(i, j) for i in ("a", "n0") if expected[i][1] >= 0 for j in below[i]}


def test_deep_chain_star_and_long_cycle(spark):
    rows = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None, 1) for i in range(150)]
    rows += [(f"s{i:03d}", "hub", 1) for i in range(200)] + [("hub", None, 1)]
    rows += [(f"r{i:02d}", f"r{(i + 1) % 33:02d}", 1) for i in range(33)]
    old = hierarchy.SIBLING_BLOCK
    hierarchy.SIBLING_BLOCK = 40
    try:
        check(spark, rows, paths=False)
    finally:
        hierarchy.SIBLING_BLOCK = old


@pytest.mark.parametrize("name", ["forest", "chains"])
def test_rounds_give_what_one_task_gives(spark, monkeypatch, name):
    """Peeling, doubling and list contraction over many rounds, with nearly nothing left to one task."""
    monkeypatch.setattr(hierarchy, "ONE_TASK", 6)
    monkeypatch.setattr(lineage, "ONE_TASK", 2)
    monkeypatch.setattr(hierarchy, "PEEL_ROUNDS", 1)
    random.seed(9)
    if name == "forest":
        rows = [(f"n{i}", random.choice([None, f"n{random.randint(0, 40)}"]), i) for i in range(40)]
    else:
        rows = [(f"c{i:02d}", f"c{i - 1:02d}" if i else None, 1) for i in range(25)] + [(f"r{i}", f"r{(i + 1) % 5}", 1) for i in range(5)] + [("t0", "r0", 1), ("t1", "t0", 1)]
    check(spark, rows)
    h = hierarchy.build_hierarchy(frame(spark, rows))
    _, below = check(spark, rows, paths=False)
    expected, _ = brute(rows)
    got = {(r.session_id, r.descendant_id): r.distance for r in hierarchy.all_descendants(h).collect()}
    assert got == {(i, j): expected[j][1] - expected[i][1] for i in below for j in below[i] if expected[i][1] >= 0}
    up = {i: p for i, p, _ in rows}

    def walked(i):
        seen = [i]
        while (p := up.get(seen[-1])) and p not in seen:
            seen.append(p)
        return min(seen) if p else seen[-1]

    assert {r.session_id: r.lineage for r in lineage.lineage_roots(frame(spark, rows)).collect()} == {i: walked(i) for i in up}


def test_stretches_make_up_every_interval(spark):
    nodes = [(f"{a}-{b}", "t", 1, 1, a, b) for a in (0, 1, 5, 63, 64, 4095, 4097) for b in (a + 1, a + 2, a + 9, a + 70, a + 5000, a + 9000)]
    df = spark.createDataFrame(nodes, "session_id string, root_id string, depth int, descendants int, entry bigint, exit bigint")
    got = {}
    for r in hierarchy._stretches(df).collect():
        got.setdefault(r.session_id, []).extend(range(r.place * 8**r.step, (r.place + 1) * 8**r.step))
    assert all(sorted(got.get(i, [])) == list(range(a + 1, b)) for i, *_, a, b in nodes)


def test_empty_table(spark):
    assert hierarchy.build_hierarchy(frame(spark, [("a", None, 1)]).limit(0)).count() == 0


def test_lineage_takes_dangling_parents_and_cycles(spark):
    rows = [("child", "parent", 1), ("parent", None, 1), ("orphan", "gone", 1), ("m", "n", 1), ("n", "m", 1), ("a-in", "n", 1), ("self", "self", 1), ("empty", "", 1)]
    got = {r.session_id: r.lineage for r in lineage.lineage_roots(frame(spark, rows)).collect()}
    assert got == {"child": "parent", "parent": "parent", "orphan": "gone", "m": "m", "n": "m", "a-in": "a-in", "self": "self", "empty": "empty"}


def test_blocked_neighbours_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    rows = [(g, v) for g in ("a", "b", None) for v in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "g string, v int")
    nxt = blocked_neighbours(df, ["g"], ["v"], F.floor(F.col("v") / 7), "to", F.col("v"))
    assert {(r.g, r.v): r.to for r in nxt.collect()} == {(g, v): v + 3 if v + 3 < 40 else None for g, v in rows}
    prev = blocked_neighbours(df, ["g"], ["v"], F.floor(F.col("v") / 7), "to", F.col("v"), previous=True)
    assert {(r.g, r.v): r.to for r in prev.collect()} == {(g, v): v - 3 if v else None for g, v in rows}

import itertools
import json
import random
from collections import defaultdict

from strandline.operators import schema_drift as sd

LINES = "writer string, file string, file_no int, line_no int, line string, path string"


def brute(old, new):
    out = [("retyped", p, p) for p in old if p in new and old[p] != new[p]]
    lost, won = defaultdict(list), defaultdict(list)
    for p in old.keys() - new.keys():
        lost[sd.parent_of(p)].append(p)
    for p in new.keys() - old.keys():
        won[sd.parent_of(p)].append(p)
    for k in lost.keys() | won.keys():
        a, b = lost[k], won[k]
        if len(a) == len(b) == 1 and old[a[0]] == new[b[0]]:
            out.append(("renamed", a[0], b[0]))
        else:
            out += [("removed", p, "") for p in a] + [("added", "", p) for p in b]
    return sorted(out)


def some_schema():
    keys = ["a", "b", "c[]", "d.e", "d.f", "d.g.h", "i.j[].k", "i.j[].l", "m.e", "m.n"]
    return {k: random.choice([1, 1, 2, 3]) for k in random.sample(keys, random.randint(0, 8))}


def test_reported_changes_equal_the_definition():
    random.seed(5)
    for _ in range(3000):
        a, b = some_schema(), some_schema()
        assert sorted(sd.reported_changes(a, b)) == brute(a, b)


def least(a, b):
    """Least cost by trying every matching of what is left over."""

    def matchings(xs, ys, price, lone_x, lone_y):
        if not xs:
            return sum(map(lone_y, ys))
        best = lone_x(xs[0]) + matchings(xs[1:], ys, price, lone_x, lone_y)
        for i, y in enumerate(ys):
            if (p := price(xs[0], y)) is not None:
                best = min(best, p + matchings(xs[1:], ys[:i] + ys[i + 1 :], price, lone_x, lone_y))
        return best

    cost = sum(b.fields.get(k, t) != t for k, t in a.fields.items()) + sum(least(x, b.objects[k]) for k, x in a.objects.items() if k in b.objects)
    one = lambda _: 1
    cost += matchings([k for k in a.fields if k not in b.fields], [k for k in b.fields if k not in a.fields], lambda x, y: 1 if a.fields[x] == b.fields[y] else None, one, one)
    xs, ys = [k for k in a.objects if k not in b.objects], [k for k in b.objects if k not in a.objects]
    return cost + matchings(xs, ys, lambda x, y: 1 + least(a.objects[x], b.objects[y]), lambda x: a.objects[x].weight, lambda y: b.objects[y].weight)


def test_scripts_are_least_cost():
    assert sd.edit_script({"a": 1}, {"b": 1})[1] == [("rename", "a", "b")]
    assert sd.edit_script({"x.a": 1, "x.b": 1, "x.c": 1}, {"y.d": 1, "y.e": 1, "y.f": 1})[0] == 4
    assert sd.edit_script({"d.k": 1, "s": 1}, {"e.k": 1, "s": 2})[0] == 2  # one object renamed, one field retyped
    assert ("move", "x.a", "y.a") in sd.edit_script({"x.a": 1, "x.q": 2, "y.z": 2}, {"x.q": 2, "y.z": 2, "y.a": 1})[1]
    assert sd.edit_script({}, {}) == (0, [])
    random.seed(8)
    keys = ["a", "b", "x.a", "x.b", "x.c", "y.a", "y.d", "z.q.a", "z.q.b", "z.r.c", "w.q.a", "w.s.b", "w.s.d", "v[].a", "x"]
    for _ in range(1500):
        a, b = ({k: random.choice([1, 1, 2]) for k in random.sample(keys, random.randint(0, 9))} for _ in range(2))
        cost, script = sd.edit_script(a, b)
        assert cost == sd.cost_of(script) == least(sd.schema_tree(a), sd.schema_tree(b))
        # the script turns the one schema into the other
        to = sd.images(a, script)
        retyped = {q for op, _, q in script if op == "retype"}
        assert {q for q in to.values() if q} | {q for op, _, q in script if op == "add"} == b.keys()
        assert all(q is None or (a[p] != b[q]) == (q in retyped) for p, q in to.items())


def test_report_is_decided_by_the_script():
    old, new = {"a": 1, "d.x": 1}, {"b": 1, "e.x": 1}
    assert sorted(sd.reported_changes(old, new)) == brute(old, new)
    assert sd.report(old, []) == [] and sd.report(old, [("delete", "a", "")]) == [("removed", "a", "")]


def test_deep_schemas_are_compared():
    deep = "a." * 5000 + "z"
    assert sd.reported_changes({deep: 1}, {deep: 2, "q": 1}) == [("retyped", deep, deep), ("added", "", "q")]
    line = '{"type":"t","d":' + '{"a":' * 50_000 + "1" + "}" * 50_001
    assert [p.count(".") for p, _ in sd.leaves(sd.parse_record(line))] == [0, 50_000]


def test_assignment_is_optimal():
    random.seed(2)
    for n in (1, 2, 3, 4, 5):
        for _ in range(30):
            cost = [[random.randint(0, 9) for _ in range(n)] for _ in range(n)]
            got = sd.assignment(cost)
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sorted(got) == list(range(n)) and sum(cost[i][got[i]] for i in range(n)) == best


def frame(spark, files):
    rows = [(w, f"{w}/{n}", n, i, line, "clash") for w, n, lines in files for i, line in enumerate(lines)]
    random.seed(1)
    random.shuffle(rows)
    return spark.createDataFrame(rows, LINES)


def test_changes_renames_and_types(spark):
    rec = lambda **k: json.dumps({"type": "t", **k})
    files = [
        ("w", 1, [rec(a=1, keep="x"), "", None, "\x1b[0m", "[1]", rec(a=2, keep="x"), '{"no":"type"}', "x" * 200_000]),
        ("w", 4, [rec(b=1, keep="x")]), ("w", 4000, [rec(b=1.5, keep="x")]), ("w", 4001, [json.dumps({"type": "u", "z": 1})]), ("w", 4002, [rec(b=2.5, keep="x", a=True)]), ("w", 4003, [rec(b=1.0, keep="x", n=None, e=[], o={})]),
        ("v", 1, [rec(q=[{"r": 1}, {"r": "s"}])]), ("v", 2, [rec(q=[{"r": 1e5}])]),
    ]
    got = sorted((r.file, r.record_type, r.change, r.old_path, r.new_path) for r in sd.schema_changes(frame(spark, files)).collect())
    assert got == [("v/2", "t", "retyped", "q[].r", "q[].r"), ("w/4", "t", "renamed", "a", "b"), ("w/4000", "t", "retyped", "b", "b"), ("w/4002", "t", "added", "", "a"), ("w/4003", "t", "removed", "a", "")]
    rows = sd.unified_table(frame(spark, files), typed=True).collect()
    unified = {(r.file, r.line_no): json.loads(r.record) for r in rows}
    assert unified["w/1", 0]["a"] == 1 and unified["w/4", 0]["a"] == 1 and unified["w/4003", 0]["a"] == 1.0
    assert unified["w/4002", 0]["a@4002"] is True and unified["w/4002", 0]["a"] == 2.5
    assert unified["v/1", 0]["q"] == [{"r": 1}, {"r": "s"}]
    typed = {(r.file, r.line_no): r.fields for r in rows}
    assert typed["w/4", 0].a == 1.0 and typed["w/4002", 0]["a@4002"] is True and [x.r for x in typed["v/1", 0].q] == ["1", "s"]
    assert sd.schema_changes(frame(spark, files).limit(0)).count() == 0 and sd.unified_table(frame(spark, files).limit(0)).count() == 0


def test_unified_table_follows_moves_objects_and_other_writers(spark):
    """p5_unified: moves, renamed objects and names of other writers come under one name."""
    assert ("renamed", "x.id", "y.id") in sd.projected_changes({"x.id": 1, "x.q": 2, "y.z": 2}, {"x.q": 2, "y.z": 2, "y.id": 1})
    assert all(c != "renamed" for c, _, _ in sd.projected_changes({"a": 1, "b": 1}, {"c": 1, "d": 1}))  # a guess isn't followed
    assert sd.canonical_names([("b", "a", 2), ("c", "b", 1), ("a", "b", 1)]) == {"b": "a", "c": "a"}
    rec = lambda **k: json.dumps({"type": "t", **k})
    files = [
        ("w", 1, [rec(x={"id": "1", "q": 2}, y={"z": 3}, o={"k": 1, "m": True})]), ("w", 2, [rec(x={"q": 2}, y={"z": 3, "id": "1"}, n={"k": 1, "m": True})]),
        ("v", 1, [rec(x={"q": 2}, y={"z": 3, "id": "5"}, n={"k": 4, "m": True})]),
        ("u", 1, [rec(x={"id": "6"}, y={"id": "7"})]),
    ]
    got = {(r.writer, r.file_no): json.loads(r.record) for r in sd.unified_table(frame(spark, files)).collect()}
    assert got["w", 1] == got["w", 2] and got["w", 2]["x"]["id"] == "1" and got["w", 2]["o"] == {"k": 1, "m": True}
    assert got["v", 1]["x"]["id"] == "5" and got["v", 1]["o"]["k"] == 4 and "id" not in got["v", 1]["y"]
    assert got["u", 1]["x"]["id"] == "6" and got["u", 1]["y"]["id"] == "7"  # both at once: two fields


def test_arrays_stay_aligned():
    value = {"q": [{"r": 1, "s": "x"}, {"s": "y"}, {}, {"r": 2}], "m": [[1, None], [3]], "t": True}
    out = {}
    for path, at, v in sd.placed_leaves(value):
        sd.place(out, {"q[].r": "q[].z", "t": "u.t"}.get(path, path), at, v)
    assert json.loads(sd.json_text(out)) == {"q": [{"z": 1, "s": "x"}, {"s": "y"}, None, {"z": 2}], "m": [[1], [3]], "u": {"t": True}}

"""Schemas that drift between files: a report of each change and one consistent table."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.payload import Reader
from strandline.operators.ordered import blocked_last, blocked_neighbours
from strandline.runtime import materialize, stored_bytes

STRING, INTEGER, DOUBLE, BOOLEAN = 1, 2, 4, 8
#: Consecutive file numbers of one writer that are ordered together.
FILE_BLOCK = 1024


class _Number(str):
    """A number as it was written."""


_read = Reader(_Number)


def parse_record(line: str | None) -> dict | None:
    """A line's record, or None where the line is no JSON object."""
    if line is None:
        return None
    try:
        value = _read(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def leaves(value: object, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, scalar) of every string, number and boolean; arrays put [] after their key."""
    stack = [(path, value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            stack.extend((path + "[]", v) for v in reversed(value))
        elif value is not None:
            yield path, value


def type_bit(value: object) -> int:
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, _Number):
        return DOUBLE if "." in value else INTEGER
    return STRING


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _files(df: DataFrame) -> DataFrame:
    return df.select(F.col("writer").alias("writer"), F.col("file_no").cast("long").alias("file_no"), F.col("file").alias("file"), F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("line"))


def file_schemas(df: DataFrame) -> DataFrame:
    """(writer, file_no, file, record_type, path, types): the paths of each record type in each file; types is a set of bits.

    Paths are gathered for each batch of the scan before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            writers, numbers, files, lines = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            found: dict[tuple, int] = defaultdict(int)
            for w, n, f, line in zip(writers, numbers, files, lines):
                record = parse_record(line)
                if record is None or not isinstance(record.get("type"), str):
                    continue
                kind = _clean(record["type"])
                for path, value in leaves(record):
                    found[w, n, f, kind, path] |= type_bit(value)
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array([_clean(p) for p in columns[4]], pa.string()), pa.array(list(found.values()), pa.int64())],
                ["writer", "file_no", "file", "record_type", "path", "types"],
            )

    rows = _files(df).mapInArrow(run, "writer string, file_no bigint, file string, record_type string, path string, types bigint")
    return rows.groupBy("writer", "file_no", "file", "record_type", "path").agg(F.bit_or("types").alias("types"))


def parent_of(path: str) -> str:
    return path.rpartition(".")[0]


class _Node:
    """An object in a schema tree: the scalar types of its fields, its inner objects, and the number of fields below it."""

    __slots__ = ("fields", "objects", "weight")

    def __init__(self):
        self.fields, self.objects, self.weight = {}, {}, 0


def schema_tree(paths: dict[str, int]) -> _Node:
    """The tree of a schema. A key that is a scalar in one record and an object in another stands in both roles."""
    root = _Node()
    for path, types in paths.items():
        node = root
        node.weight += 1
        *above, key = path.split(".")
        for k in above:
            node = node.objects.setdefault(k, _Node())
            node.weight += 1
        node.fields[key] = types
    return root


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in a least-cost one-to-one assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    c = np.asarray(cost, float).reshape(n, n)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        row_of[n], j = i, n
        least, back, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            slack = c[row_of[j]] - u[row_of[j]] - v[:n]
            better = ~done[:n] & (slack < least)
            least[better], back[better] = slack[better], j
            nxt = int(np.argmin(np.where(done[:n], np.inf, least)))
            step = least[nxt]
            seen = np.flatnonzero(done)
            u[row_of[seen]] += step
            v[seen] -= step
            least[~done[:n]] -= step
            j = nxt
        while j != n:
            row_of[j] = row_of[back[j]]
            j = back[j]
    out = [0] * n
    for j in range(n):
        out[row_of[j]] = j
    return out


class _Distance:
    """Least cost of turning one object into another, and the matching that has it."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[str, str]]]] = {}

    def between(self, a: _Node, b: _Node) -> tuple[int, list[tuple[str, str]]]:
        """(cost, [(inner object of a, the one of b it becomes)] besides those of equal name)."""
        todo = [(a, b, False)]
        while todo:
            x, y, ready = todo.pop()
            if (id(x), id(y)) in self.known:
                continue
            if ready:
                self.known[id(x), id(y)] = self._match(x, y)
                continue
            todo.append((x, y, True))
            left, right = x.objects.keys() - y.objects.keys(), y.objects.keys() - x.objects.keys()
            todo += [(o, y.objects[k], False) for k, o in x.objects.items() if k in y.objects]
            todo += [(x.objects[k], y.objects[m], False) for k in left for m in right]
        return self.known[id(a), id(b)]

    def _match(self, a: _Node, b: _Node) -> tuple[int, list[tuple[str, str]]]:
        cost_of = lambda x, y: self.known[id(x), id(y)][0]
        total = sum(b.fields.get(k, t) != t for k, t in a.fields.items())
        lost = Counter(t for k, t in a.fields.items() if k not in b.fields)
        won = Counter(t for k, t in b.fields.items() if k not in a.fields)
        total += lost.total() + won.total() - (lost & won).total()
        total += sum(cost_of(x, b.objects[k]) for k, x in a.objects.items() if k in b.objects)
        left, right = sorted(a.objects.keys() - b.objects.keys()), sorted(b.objects.keys() - a.objects.keys())
        pairs: list[tuple[str, str]] = []
        total += sum(a.objects[x].weight for x in left) + sum(b.objects[y].weight for y in right)
        if left and right:
            # what pairing two objects saves against deleting the one and adding the other
            saved = [[a.objects[x].weight + b.objects[y].weight - 1 - cost_of(a.objects[x], b.objects[y]) for y in right] for x in left]
            n = max(len(left), len(right))
            cost = [[-max(0, saved[i][j]) if i < len(left) and j < len(right) else 0 for j in range(n)] for i in range(n)]
            for i, j in enumerate(assignment(cost)[: len(left)]):
                if j < len(right) and saved[i][j] > 0:
                    total -= saved[i][j]
                    pairs.append((left[i], right[j]))
        return total, pairs


def edit_script(old: dict[str, int], new: dict[str, int]) -> tuple[int, list[tuple[str, str, str]]]:
    """(cost, [(operation, old path, new path)]): a least-cost script from one schema tree to the other.

    Trees are unordered and edited from the top down; fields and objects of equal name under matched parents are matched.
    Operations of cost 1: 'add' and 'delete' of a field, 'retype' of a field that stays, 'rename' of a field to one of equal
    types under the same (matched) parent, 'rename_object' of a whole object under its parent. A 'move' joins the deletion of a
    field with the addition of one of equal name and types under another parent and costs as much as those, so it is a reading
    of the least-cost script and never changes which one that is. Objects are paired by an assignment over what pairing saves,
    from the leaves up, so the cost is the least there is; among equal ones names decide.
    """
    tree_a, tree_b = schema_tree(old), schema_tree(new)
    distance = _Distance()
    operations: list[tuple[str, str, str]] = []
    gone: list[str] = []
    come: list[str] = []
    under = lambda path, k: f"{path}.{k}" if path else k

    def list_fields(node: _Node, path: str, into: list[str]) -> None:
        inner = [(node, path)]
        while inner:
            node, path = inner.pop()
            into.extend(under(path, k) for k in node.fields)
            inner += [(x, under(path, k)) for k, x in node.objects.items()]

    todo = [(tree_a, tree_b, "", "")]
    cost = distance.between(tree_a, tree_b)[0]
    while todo:
        a, b, at, to = todo.pop()
        operations.extend(("retype", under(at, k), under(to, k)) for k, t in a.fields.items() if b.fields.get(k, t) != t)
        waiting = defaultdict(list)
        for k in sorted(b.fields.keys() - a.fields.keys(), reverse=True):
            waiting[b.fields[k]].append(k)
        for k in sorted(a.fields.keys() - b.fields.keys()):
            if waiting[a.fields[k]]:
                operations.append(("rename", under(at, k), under(to, waiting[a.fields[k]].pop())))
            else:
                gone.append(under(at, k))
        come.extend(under(to, k) for ks in waiting.values() for k in ks)
        renamed = distance.between(a, b)[1]
        for x, y in renamed:
            operations.append(("rename_object", under(at, x), under(to, y)))
        todo += [(a.objects[x], b.objects[y], under(at, x), under(to, y)) for x, y in [(k, k) for k in a.objects if k in b.objects] + renamed]
        for k in a.objects.keys() - b.objects.keys() - {x for x, _ in renamed}:
            list_fields(a.objects[k], under(at, k), gone)
        for k in b.objects.keys() - a.objects.keys() - {y for _, y in renamed}:
            list_fields(b.objects[k], under(to, k), come)

    named = lambda path, types: (path.rpartition(".")[2], types[path])
    homes = defaultdict(list)
    for q in sorted(come, reverse=True):
        homes[named(q, new)].append(q)
    for p in sorted(gone):
        operations.append(("move", p, homes[named(p, old)].pop()) if homes[named(p, old)] else ("delete", p, ""))
    operations.extend(("add", "", q) for qs in homes.values() for q in qs)
    return cost, operations


def cost_of(script: list[tuple[str, str, str]]) -> int:
    return sum(2 if op == "move" else 1 for op, _, _ in script)


def images(old: Iterable[str], script: list[tuple[str, str, str]]) -> dict[str, str | None]:
    """Where a script takes each field: its new path, or None where it is deleted."""
    objects = {p: q for op, p, q in script if op == "rename_object"}
    fields = {p: q or None for op, p, q in script if op in ("rename", "move", "delete")}
    out: dict[str, str | None] = {}
    for path in old:
        to: str | None = path
        if path in fields:
            to = fields[path]
        elif objects:
            above = path
            while "." in above and above not in objects:
                above = parent_of(above)
            if above != path and above in objects:
                to = objects[above] + path[len(above) :]
        out[path] = to
    return out


def report(old: dict[str, int], script: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(change, old path, new path) of a script in the report's words.

    A rename stands where it is all that a script does to the fields of its parent; ambiguous renames, moves and renamed objects
    are reported field by field as removed and added.
    """
    out = [("retyped", p, q) for op, p, q in script if op == "retype" and p == q]
    went = {p: q for p, q in images(old, script).items() if p != q}
    lost, won = defaultdict(list), defaultdict(list)
    for p, q in went.items():
        lost[parent_of(p)].append(p)
        if q is not None:
            won[parent_of(q)].append(q)
    for op, _, q in script:
        if op == "add":
            won[parent_of(q)].append(q)
    renames = {(p, q) for op, p, q in script if op == "rename"}
    for at in sorted(lost.keys() | won.keys()):
        if len(lost[at]) == len(won[at]) == 1 and (lost[at][0], won[at][0]) in renames:
            out.append(("renamed", lost[at][0], won[at][0]))
        else:
            out += [("removed", p, "") for p in sorted(lost[at])] + [("added", "", q) for q in sorted(won[at])]
    return out


def reported_changes(old: dict[str, int], new: dict[str, int]) -> list[tuple[str, str, str]]:
    """The report of the least-cost script between two schemas."""
    return report(old, edit_script(old, new)[1])


def projected_changes(old: dict[str, int], new: dict[str, int]) -> list[tuple[str, str, str]]:
    """The edit script as (change, old path, new path) of 'renamed', 'removed' and 'added', for projections.

    Besides the reported renames, fields follow the script's moves and renamed objects (by prefix). Both must be unambiguous: of
    a moved field's name and type exactly one field went and one came; a renamed object is the only one that went, and its
    counterpart the only one that came, under their parent.
    """
    _, script = edit_script(old, new)
    pairs = {p: q for change, p, q in report(old, script) if change == "renamed"}
    moved = images(old, script)
    objects = {p: q for op, p, q in script if op == "rename_object"}

    def children(paths: Iterable[str], parent: str) -> set[str]:
        """Inner objects of an object."""
        rest = [p[len(parent) + 1 if parent else 0 :] for p in paths if not parent or p.startswith(parent + ".")]
        return {r.partition(".")[0] for r in rest if "." in r}

    sole = set()  # renamed objects that are the only one that went, for the only one that came
    for p, q in objects.items():
        before, after = children(old, parent_of(p)), children(new, parent_of(q))
        if len(before - after) == 1 == len(after - before):
            sole.add(p)
    went, came = Counter((p.rpartition(".")[2], old[p]) for p, q in moved.items() if p != q), Counter((q.rpartition(".")[2], new[q]) for q in new.keys() - old.keys())
    moves = {p for op, p, _ in script if op == "move"}
    own_rename = {p for op, p, _ in script if op == "rename"}
    for p, q in moved.items():
        if q is None or q == p or p in pairs or p in own_rename or old[p] != new[q] or p.count("[]") != q.count("[]"):
            continue
        kind = (p.rpartition(".")[2], old[p])
        above = parent_of(p)
        while above and above not in objects:
            above = parent_of(above)
        if p in moves and went[kind] == 1 == came[kind] or p not in moves and above in sole:
            pairs[p] = q
    taken = set(pairs.values())
    lost, won = [p for p, q in moved.items() if q != p and p not in pairs], [q for q in new if q not in old and q not in taken]
    return [("renamed", p, q) for p, q in sorted(pairs.items())] + [("removed", p, "") for p in sorted(lost)] + [("added", "", q) for q in sorted(won)]


def _pairs(schemas: DataFrame) -> DataFrame:
    """(writer, file_no, file, record_type, new, old): each file's schema of a type beside the nearest earlier one, where they differ."""
    whole = schemas.groupBy("writer", "file_no", "file", "record_type").agg(F.sort_array(F.collect_list(F.struct("path", "types"))).alias("new"))
    whole = materialize(whole, "schemas")  # read three times below; the lines once
    at = blocked_neighbours(whole.select("writer", "file_no", "file", "record_type"), ["writer", "record_type"], ["file_no", "file"], F.floor(F.col("file_no") / FILE_BLOCK), "before", F.struct("file_no", "file"), previous=True)
    at = at.where("before is not null").select("writer", "file_no", "file", "record_type", F.col("before.file_no").alias("old_no"), F.col("before.file").alias("old_file"))
    earlier = whole.select("writer", F.col("file_no").alias("old_no"), F.col("file").alias("old_file"), "record_type", F.col("new").alias("old"))
    joined = whole.join(at, ["writer", "file_no", "file", "record_type"]).join(earlier, ["writer", "old_no", "old_file", "record_type"])
    return joined.where("old <> new").select("writer", "file_no", "file", "record_type", "old", "new")


_CHANGE = "writer string, file_no bigint, file string, record_type string, change string, old_path string, new_path string"


def _compare(schemas: DataFrame, compare) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for key, old, new in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                a, b = ({x["path"]: x["types"] for x in side} for side in (old, new))
                rows += [(*key, *change) for change in compare(a, b)]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["writer", "file_no", "file", "record_type", "change", "old_path", "new_path"])

    return _pairs(schemas).mapInArrow(run, _CHANGE)


def schema_changes(df: DataFrame) -> DataFrame:
    """(writer, file_no, file, record_type, change, old_path, new_path) of each change between a writer's consecutive files.

    Lines that are null, empty, no JSON object or have no string `type` are ignored; repeated lines add nothing; extra columns
    are ignored; an empty table gives an empty one. Files of a writer with equal file_no are ordered by name.
    """
    return _compare(file_schemas(df), reported_changes)


def edit_scripts(df: DataFrame) -> DataFrame:
    """The same pairs' least-cost scripts of add, delete, rename, move and retype operations, as found."""
    return _compare(file_schemas(df), lambda a, b: edit_script(a, b)[1])


def projections(changes: DataFrame) -> DataFrame:
    """(file, record_type, names): for each file with renamed fields in force, the map from its paths to the consistent ones.

    A field keeps the name under which its writer first had it; one that comes back to a name still taken by a renamed field
    gets the file's number behind it. The changes of a writer's record type (not its lines or files) are streamed in file order,
    so a task holds only the names in force.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, file = None, {}, None
        out: list[tuple] = []

        def close():
            if group is not None and file is not None:
                out.append((group[0], group[1], file[0], sorted(names.items())))

        for batch in batches:
            for w, n, f, kind, change, old, new in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (w, kind) != group:
                    close()
                    group, names, file = (w, kind), {}, None
                if file != (n, f):
                    close()
                    file = (n, f)
                if change == "renamed":
                    names[new] = names.pop(old, old)
                elif change == "removed":
                    names.pop(old, None)
                elif change == "added" and new in names.values():
                    names[new] = f"{new}@{n}"
            yield flush(out)
            out.clear()
        close()
        yield flush(out)

    def flush(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.map_(pa.string(), pa.string()))], ["writer", "record_type", "since", "names"])

    rank = F.when(F.col("change") == "removed", 0).when(F.col("change") == "renamed", 1).otherwise(2)
    ordered = changes.where("change <> 'retyped'").withColumn("rank", rank).repartition("writer", "record_type").sortWithinPartitions("writer", "record_type", "file_no", "file", "rank", "old_path", "new_path").drop("rank")
    return ordered.mapInArrow(run, "writer string, record_type string, since bigint, names map<string,string>")


def canonical_names(edges: list[tuple[str, str, int]]) -> dict[str, str]:
    """{name: its canonical name} from (new name, old name, writers) of one record type.

    A name leads to the older one that most writers had for it, then the smallest, unless as many went the other way; names that
    lead to each other in a circle take its smallest.
    """
    count = {(q, p): n for q, p, n in edges if p != q}
    older: dict[str, str] = {}
    for (q, p), _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        if (count[q, p], q) > (count.get((p, q), 0), p):
            older.setdefault(q, p)
    out = {}
    for name in older:
        chain = [name]
        while (following := older.get(chain[-1])) is not None and following not in chain:
            chain.append(following)
        root = chain[-1] if following is None else min(chain[chain.index(following) :])
        if root != name:
            out[name] = root
    return out


def _canonical(edges: DataFrame) -> DataFrame:
    """(record_type, name, root) of edges (record_type, new, old, writers); a record type's distinct renames are one group."""

    def run(group):
        found = canonical_names(list(zip(group["new"], group["old"], group["writers"])))
        return group.iloc[:0].assign(name="", root="")[["record_type", "name", "root"]] if not found else group.iloc[[0] * len(found)].assign(name=list(found), root=list(found.values()))[["record_type", "name", "root"]]

    return edges.groupBy("record_type").applyInPandas(run, "record_type string, name string, root string")


@lru_cache(maxsize=65536)
def _key_and_arrays(key: str) -> tuple[str, int]:
    """A path's key without the brackets behind it, and how many arrays those stand for."""
    n = 0
    while key.endswith("[]"):
        key, n = key[:-2], n + 1
    return key, n


def place(out: dict, path: str, at: list[int], value: object) -> bool:
    """Put a scalar under a path, `at` being its position in each array on the way; False where something else stands there."""
    places = iter(at)
    steps: list[str | int] = []
    for key in path.split("."):
        name, arrays = _key_and_arrays(key)
        steps.append(name)
        steps.extend(next(places) for _ in range(arrays))
    box = out
    for step, after in zip(steps, steps[1:]):
        kind = _Array if isinstance(after, int) else dict
        box = box.setdefault(step, kind())
        if type(box) is not kind:
            return False
    if steps[-1] in box:
        return False
    box[steps[-1]] = value
    return True


class _Array(dict):
    """An array under way: its elements by position."""


def placed_leaves(value: object) -> Iterator[tuple[str, list[int], object]]:
    """(path, positions in the arrays on the way, scalar) of every string, number and boolean."""
    stack: list[tuple[str, list[int], object]] = [("", [], value)]
    while stack:
        path, at, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, at, v) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            stack.extend((path + "[]", [*at, i], v) for i, v in reversed(list(enumerate(value))))
        elif value is not None:
            yield path, at, value


def json_text(value: object) -> str:
    """JSON of a rebuilt record, without recursion; what an array lacks between its elements is null."""
    out: list[str] = []
    stack: list[object] = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, _Raw):
            out.append(v)
        elif isinstance(v, _Array):
            stack.append(_Raw("]"))
            for i in range(max(v), -1, -1):
                stack.append(v.get(i, _Raw("null")))
                if i:
                    stack.append(_Raw(","))
            stack.append(_Raw("["))
        elif isinstance(v, dict):
            stack.append(_Raw("}"))
            for i, (k, x) in reversed(list(enumerate(sorted(v.items())))):
                stack += [x, _Raw(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":")]
            stack.append(_Raw("{"))
        else:
            out.append(v if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text that is written as it is."""


#: Objects within each other that typed columns follow; what lies deeper is kept in them as JSON text.
COLUMN_DEPTH = 32
#: Bytes of projections that are broadcast to the lines; larger ones are joined by a shuffle, with the same result.
BROADCAST_BYTES = 32 << 20


def column_type(paths: dict[str, int]) -> T.StructType:
    """The columns of canonical paths: whole numbers are bigint, numbers of either kind double, booleans boolean, all else string.

    A path that is a scalar in one record and an object or array in another is a string, which holds the latter as JSON.
    """

    def shape(node: dict, depth: int) -> T.DataType:
        types, array, members = node["types"], node["array"], node["members"]
        if (types > 0) + (array is not None) + (len(members) > 0) != 1 or depth > COLUMN_DEPTH:
            return T.StringType()
        if types:
            return {INTEGER: T.LongType(), DOUBLE: T.DoubleType(), INTEGER | DOUBLE: T.DoubleType(), BOOLEAN: T.BooleanType()}.get(types, T.StringType())
        if array is not None:
            return T.ArrayType(shape(array, depth + 1))
        return T.StructType([T.StructField(k, shape(x, depth + 1)) for k, x in sorted(members.items())])

    fresh = lambda: {"types": 0, "array": None, "members": {}}
    root = fresh()
    for path, types in paths.items():
        node = root
        for key in path.split("."):
            name, arrays = _key_and_arrays(key)
            node = node["members"].setdefault(name, fresh())
            for _ in range(arrays):
                node["array"] = node["array"] or fresh()
                node = node["array"]
        node["types"] |= types
    out = shape(root, 0)
    return out if isinstance(out, T.StructType) else T.StructType([])


def unified_table(df: DataFrame, typed: bool = False) -> DataFrame:
    """(writer, file_no, file, line_no, record_type, record): every record as JSON with its fields under consistent names.

    Fields follow the edit scripts' renames, moves and renamed objects where these are unambiguous; a writer that never had a
    field's older name takes it from the other writers, unless that would give two of its fields one name. Elements of arrays
    stay together and in place, so what belonged to one object still does; a field whose consistent place is taken by another
    one stands under its own path as a key. Null fields, empty objects and empty arrays are
    left out; lines that hold no record of a type are left out; repeated lines stay.

    With `typed`, the column `fields` holds the record under one schema for all records (see column_type); a whole number beyond
    64 bits is null there. That schema, one entry for each consistent path of all files, is what the driver gets to see.
    """
    schemas = materialize(file_schemas(df), "paths")
    compiled = projections(_compare(schemas, projected_changes))
    files = schemas.select("writer", "record_type", "file_no").distinct()
    # the projection in force at a file: carried forward from the last file that changed
    stamps = files.join(compiled.withColumnRenamed("since", "file_no"), ["writer", "record_type", "file_no"], "left")
    in_force = blocked_last(stamps, ["writer", "record_type"], "file_no", FILE_BLOCK, "names").where("size(names) > 0").select("writer", "record_type", "file_no", "names")
    paths = schemas.groupBy("writer", "record_type", "file_no", "path").agg(F.bit_or("types").alias("types")).join(in_force, ["writer", "record_type", "file_no"], "left")
    named = materialize(paths.select("writer", "record_type", "file_no", "path", "types", F.coalesce(F.try_element_at("names", "path"), "path").alias("name")), "named")
    edges = named.where("name <> path and not name rlike '@[0-9]+$'").groupBy("record_type", F.col("path").alias("new"), F.col("name").alias("old")).agg(F.count_distinct("writer").alias("writers"))
    own = named.select("writer", "record_type", "name").distinct().join(_canonical(edges), ["record_type", "name"], "left").withColumn("root", F.coalesce("root", "name"))
    canon = own.groupBy("writer", "record_type", "root").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1 and name <> root").drop("n")
    final = materialize(named.join(canon, ["writer", "record_type", "name"], "left").withColumn("root", F.coalesce("root", "name")), "final")
    maps = final.where("root <> path").groupBy("writer", "file_no", "record_type").agg(F.map_from_entries(F.collect_list(F.struct("path", "root"))).alias("names"))
    by_file = materialize(maps.groupBy("writer", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("record_type", "names"))).alias("names")), "projections")
    by_file = F.broadcast(by_file) if stored_bytes(by_file) <= BROADCAST_BYTES else by_file
    lines = _files(df).join(by_file, ["writer", "file_no"], "left").select("writer", "file_no", "file", "line_no", "line", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, kinds, records = [], [], []
            for i, (line, maps) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                record = parse_record(line)
                if record is None or not isinstance(record.get("type"), str):
                    continue
                names = dict(dict(maps or ()).get(record["type"]) or ())
                out: dict = {}
                for path, at, value in placed_leaves(record):
                    if not place(out, names.get(path, path), at, value):
                        out.setdefault(path, value)
                take.append(i)
                kinds.append(_clean(record["type"]))
                records.append(_clean(json_text(out)))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(kinds, pa.string()), pa.array(records, pa.string())], ["writer", "file_no", "file", "line_no", "record_type", "record"])

    out = lines.mapInArrow(run, "writer string, file_no bigint, file string, line_no bigint, record_type string, record string")
    if typed:
        seen = {r["root"]: r["types"] for r in final.groupBy("root").agg(F.bit_or("types").alias("types")).collect()}
        out = out.withColumn("fields", F.from_json("record", column_type(seen)))
    return out

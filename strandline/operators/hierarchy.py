"""Parent-child links to full hierarchies: roots, depths, Euler-tour intervals, paths, cycles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import blocked_neighbours
from strandline.runtime import counted, materialize, release, scratch

#: Rounds in which childless nodes are peeled one level at a time; what is left is resolved by pointer doubling.
PEEL_ROUNDS = 4
#: Children of one parent that are ordered together.
SIBLING_BLOCK = 50_000
#: Links or arcs that a single task finishes once the rounds before have brought them down to so many (16 MB of numbers).
ONE_TASK = 1_000_000
#: Stretches of a tour that intervals are cut into: powers of BASE, the largest of BASE ** TOP positions.
BASE, TOP = 8, 4
BLANKS = " \t\r\n 　"


def _named(column: str):
    return F.lower(F.btrim(F.col(column).cast("string"), F.lit(BLANKS)))


def _nodes(df: DataFrame, id_column: str, parent_column: str, version_column: str) -> DataFrame:
    latest = df.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("string").alias("id")).agg(F.max(F.struct(F.col(version_column).alias("v"), _named(parent_column).alias("p"))).getField("p").alias("parent"))
    return latest.select(F.monotonically_increasing_id().alias("nid"), "id", _named("id").alias("name"), F.nullif(F.col("parent"), F.lit("")).alias("parent"))


def _on_cycles(nids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which nodes lie on a cycle of their pointers: those left when childless nodes are peeled off until there are none."""
    order = np.argsort(nids, kind="stable")
    at = np.minimum(np.searchsorted(nids, to, sorter=order), max(len(nids) - 1, 0))
    target = np.where(nids[order[at]] == to, order[at], -1) if len(nids) else at
    degree = np.bincount(target[target >= 0], minlength=len(nids))
    left = target >= 0
    todo = np.flatnonzero(degree == 0).tolist() + np.flatnonzero((target < 0) & (degree > 0)).tolist()
    peeled = np.zeros(len(nids), bool)
    while todo:
        x = todo.pop()
        if peeled[x]:
            continue
        peeled[x] = True
        y = target[x]
        if y >= 0:
            degree[y] -= 1
            if degree[y] == 0:
                todo.append(int(y))
    return left & ~peeled & (degree > 0)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """nid of each node on a cycle of (nid, pid), where every node has at most one parent.

    Childless nodes are peeled away for PEEL_ROUNDS rounds; what is left are long chains and cycles. Their parent pointers are
    doubled, keeping only nodes that are still pointed at: a node lies on a cycle of the pointers exactly if it does of the
    doubled ones. Once ONE_TASK are left, a single task peels them to the end; if their number stays the same before that, the
    set permutes itself, so all of it lies on cycles.
    """
    left = edges.where("pid is not null").select("nid", F.col("pid").alias("to"))
    for _ in range(PEEL_ROUNDS if counted(edges) > ONE_TASK else 0):
        left = left.join(left.select(F.col("to").alias("nid")).distinct(), "nid", "left_semi")
    old = materialize(left, "peeled", F.lit(True))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if rows:
            nids, to = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(nids[_on_cycles(nids, to)])], ["nid"])

    size = -1
    while counted(old) > ONE_TASK:
        image = old.select(F.col("to").alias("nid")).distinct()
        kept = materialize(old.join(image, "nid", "left_semi"), "image", F.lit(True))
        release(old)
        if counted(kept) == size:
            return kept.select("nid")
        size = counted(kept)
        far = kept.select(F.col("nid").alias("to"), F.col("to").alias("far"))
        old = materialize(kept.join(far, "to").select("nid", F.col("far").alias("to")), "doubled", F.lit(True))
        release(kept)
    return old.coalesce(1).mapInArrow(finish, "nid bigint")


def _arcs(edges: DataFrame, n: int) -> DataFrame:
    """The Euler tours' arcs: 2 * nid enters a node, 2 * nid + 1 leaves it; nxt is the arc that follows."""
    blocks = max(1, math.ceil(n / SIBLING_BLOCK))
    children = edges.where("pid is not null").select("nid", "pid")
    ordered = blocked_neighbours(children, ["pid"], ["nid"], F.pmod(F.xxhash64("nid"), F.lit(blocks)), "sibling", F.col("nid"))
    # the first child is the one that no sibling points at
    heads = materialize(ordered, "siblings")
    first = heads.join(heads.select(F.col("sibling").alias("nid")).where("nid is not null"), "nid", "left_anti").select(F.col("pid").alias("nid"), F.col("nid").alias("child"))
    rows = edges.join(heads.select("nid", "sibling"), "nid", "left").join(first, "nid", "left")
    enter = F.struct((F.col("nid") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("nid") * 2 + 1).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w"))
    leave = F.struct((F.col("nid") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("pid") * 2 + 1).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("w"))
    return rows.select(F.inline(F.array(enter, leave))).withColumn("last", F.col("arc"))


def _follow(arc: np.ndarray, nxt: np.ndarray, n: np.ndarray, w: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, w, last) summed up from each arc to its list's end; nxt is -1 there."""
    order = np.argsort(arc)
    to = np.where(nxt >= 0, order[np.minimum(np.searchsorted(arc, nxt, sorter=order), len(arc) - 1)], -1)
    n, w, last = n.copy(), w.copy(), last.copy()
    while len(going := np.flatnonzero(to >= 0)):
        ahead = to[going]
        n[going] += n[ahead]
        w[going] += w[ahead]
        last[going] = last[ahead]
        to[going] = to[ahead]
    return n, w, last


def _rank(arcs: DataFrame) -> DataFrame:
    """Parallel list ranking: for each arc the number and the weight of arcs from it to its tour's end, and that end.

    While more than ONE_TASK arcs are in play, a round first finishes the arcs that lead to one finished before, then takes an
    independent quarter of the others out of their lists: an arc of hash 1 behind one of hash 0 is absorbed by it. What a round
    finishes or takes out is written once; what is left is ranked by a single task, and the rounds are gone back, each arc that
    was taken out adding its own number to the rank of the arc it led to. So the work is in proportion to the arcs, not to the
    arcs times the rounds.
    """
    going = F.col("nxt").isNotNull()
    whole = materialize(arcs, "arcs", going)
    state, done = whole.where(going), whole.where(~going)
    left = counted(whole)
    finished, taken, old = [done], [], [whole]
    while left > ONE_TASK:
        coin = lambda c, k=len(taken): F.pmod(F.xxhash64(F.lit(k), F.col(c)), F.lit(2))
        ends = done.select(F.col("arc").alias("nxt"), F.struct("n", "w", "last").alias("end"))
        met = materialize(state.join(ends, "nxt", "left"), "round")
        ended = met.where("end is not null")
        done = materialize(ended.select("arc", F.lit(None).cast("bigint").alias("nxt"), (F.col("n") + F.col("end.n")).alias("n"), (F.col("w") + F.col("end.w")).alias("w"), F.col("end.last").alias("last")), "finished")
        rest = met.where("end is null").drop("end")
        absorbs = (coin("arc") == 0) & (coin("nxt") == 1)
        ahead = rest.where(absorbs).select(F.col("nxt").alias("arc"), F.struct("arc", "nxt", "n", "w", "last").alias("by"))
        # an arc of hash 1 that none absorbs stays; one of hash 0 whose next isn't in play any more stays as it is
        behind = materialize(rest.where(coin("arc") == 1).join(ahead, "arc", "full"), "round")
        absorbed = behind.where("by is not null and n is not null")
        grown = absorbed.select("by.arc", "nxt", (F.col("n") + F.col("by.n")).alias("n"), (F.col("w") + F.col("by.w")).alias("w"), "last")
        columns = ["arc", "nxt", "n", "w", "last"]
        kept = rest.where((coin("arc") == 0) & ~absorbs).select(*columns).unionByName(behind.where("by is null").select(*columns)).unionByName(behind.where("n is null").select("by.*")).unionByName(grown)
        state = materialize(kept, "arcs", F.lit(True))
        left = counted(state)
        release(met, *old[1:])
        old = [whole, state]
        finished.append(done)
        taken.append(absorbed.select(*columns))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if rows:
            arc, nxt, n, w, last = (np.concatenate([b.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for b in rows]) for c in ("arc", "nxt", "n", "w", "last"))
            n, w, last = _follow(arc, nxt, n, w, last)
            mine = nxt >= 0
            yield pa.RecordBatch.from_arrays([pa.array(x[mine]) for x in (arc, n, w, last)], ["arc", "n", "w", "last"])

    targets = done.join(state.select(F.col("nxt").alias("arc")), "arc", "left_semi") if taken else done
    last_part = state.select("arc", "nxt", "n", "w", "last").unionByName(targets.select("arc", "nxt", "n", "w", "last")).coalesce(1)
    rank = ["arc", "n", "w", "last"]
    known = [materialize(last_part.mapInArrow(finish, "arc bigint, n bigint, w bigint, last bigint"), "ranks")]
    for k in range(len(taken) - 1, -1, -1):
        known.append(finished[k + 1].select(*rank))
        led = reduce(DataFrame.unionByName, known).select(F.col("arc").alias("nxt"), F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("last").alias("last2"))
        back = taken[k].join(led, "nxt").select("arc", (F.col("n") + F.col("n2")).alias("n"), (F.col("w") + F.col("w2")).alias("w"), F.col("last2").alias("last"))
        known.append(materialize(back, "ranks"))
    known.append(finished[0].select(*rank))
    return reduce(DataFrame.unionByName, known)


def build_hierarchy(df: DataFrame, id_column: str = "id", parent_column: str = "parent_session", version_column: str = "updated_at") -> DataFrame:
    """(session_id, root_id, depth, parent_id, entry, exit, tour, descendants) for each distinct id.

    Of several rows with one id the greatest version counts (null is least; among equals the greatest parent). A parent names
    an id regardless of case and surrounding blanks; of ids that differ in nothing else the smallest is meant. A null, blank or
    unknown parent makes a root. A node from which no root is reached has root_id '' and depth -1, and no count of
    descendants; its parent_id stays.
    entry and exit are positions in the Euler tour of the node's tree, from 0: u is an ancestor of v exactly if both have the
    same tree and entry(u) < entry(v) < exit(u); tour is the tour's length. Rows with a null id are ignored, repeated rows count once, other columns are
    ignored, an empty table gives an empty one.

    After peeling leaves to expose cycles, each cycle node is made a root; list ranking of the Euler tours gives the rest.
    """
    with scratch() as keep:
        return keep(materialize(_build(df, id_column, parent_column, version_column), "hierarchy"))


def _build(df: DataFrame, id_column: str, parent_column: str, version_column: str) -> DataFrame:
    nodes = materialize(_nodes(df, id_column, parent_column, version_column), "nodes")
    named = nodes.groupBy(F.col("name").alias("parent")).agg(F.min_by("nid", "id").alias("pid"))
    linked = nodes.where("parent is not null").join(named, "parent").select("nid", "pid")
    links = materialize(nodes.select("nid").join(linked, "nid", "left"), "links", F.lit(True))
    cyclic = cycle_nodes(links).withColumn("cyclic", F.lit(True))
    edges = materialize(links.join(cyclic, "nid", "left").select("nid", F.when(F.col("cyclic").isNull(), F.col("pid")).alias("pid"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.col("pid").alias("above")), "edges", F.lit(True))
    release(links)
    ranks = _rank(_arcs(edges, counted(edges)))
    enters = F.col("arc") % 2 == 0
    spans = ranks.groupBy(F.shiftright("arc", 1).alias("nid")).agg(
        F.max(F.when(enters, F.col("n"))).alias("enter_n"), F.max(F.when(~enters, F.col("n"))).alias("leave_n"), F.max(F.when(enters, -F.col("w"))).alias("depth"), F.max(F.shiftright("last", 1)).alias("root")
    )
    label = nodes.select("nid", "id")
    spans = materialize(spans.join(edges.select("nid", "cyclic", "above"), "nid").join(label, "nid"), "spans")
    roots = spans.where("nid = root").select("root", F.col("enter_n").alias("total"), F.col("cyclic").alias("lost"), F.col("id").alias("root_id"))
    parents = label.select(F.col("nid").alias("above"), F.col("id").alias("parent_id"))
    held = spans.drop("cyclic").join(roots, "root")
    with_parent = held.where("above is not null").join(parents, "above").unionByName(held.where("above is null").withColumn("parent_id", F.lit(None).cast("string")))
    return with_parent.select(
        F.col("id").alias("session_id"),
        F.when(F.col("lost"), F.lit("")).otherwise(F.col("root_id")).alias("root_id"),
        F.when(F.col("lost"), F.lit(-1).cast("long")).otherwise(F.col("depth")).alias("depth"),
        "parent_id",
        (F.col("total") - F.col("enter_n")).alias("entry"),
        (F.col("total") - F.col("leave_n")).alias("exit"),
        F.col("total").alias("tour"),
        F.expr("if(lost, null, (enter_n - leave_n - 1) div 2)").alias("descendants"),
    )


def _power(step: Column) -> Column:
    """BASE to a power, as a whole number."""
    return F.element_at(F.array(*(F.lit(BASE**i).cast("long") for i in range(TOP + 2))), step + 1)


def _stretches(df: DataFrame) -> DataFrame:
    """df with the stretches (step, place) of BASE ** step positions that make up its interval between entry and exit, each once."""
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(TOP))))
    size, larger = _power(F.col("step")), _power(F.col("step") + 1)
    lo, hi = F.col("entry") + 1, F.col("exit")
    at, to = F.ceil(lo / size).cast("long"), F.floor(hi / size).cast("long")
    inner_at, inner_to = (F.ceil(lo / larger) * BASE).cast("long"), (F.floor(hi / larger) * BASE).cast("long")
    alone = (inner_at >= inner_to) | (F.col("step") == TOP)  # nothing of it is part of a larger stretch
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    places = F.when(alone, upto(at, to)).otherwise(F.concat(upto(at, F.least(inner_at, to)), upto(F.greatest(inner_to, at), to)))
    return df.withColumn("place", F.explode(places))


def containment(above: DataFrame, below: DataFrame) -> DataFrame:
    """(session_id, entry, depth, descendant_id, below_depth) of each pair of trees' nodes whose intervals contain each other.

    An interval is cut into the fewest aligned stretches of a tour, a node lies in one stretch of each size, and the join is on
    equal stretches: it makes exactly the pairs that hold, and no group is larger than BASE ** TOP nodes times those above them.
    """
    asked = _stretches(above.where("depth >= 0 and descendants > 0").select("root_id", "session_id", "entry", "exit", "depth"))
    points = below.where("depth > 0").select("root_id", F.col("session_id").alias("descendant_id"), F.col("depth").alias("below_depth"), F.col("entry").alias("point"))
    points = points.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(TOP)))).withColumn("place", F.floor(F.col("point") / _power(F.col("step"))).cast("long"))
    return asked.select("root_id", "step", "place", "session_id", "entry", "depth").join(points.drop("point"), ["root_id", "step", "place"]).select("session_id", "entry", "depth", "descendant_id", "below_depth")


def add_paths(hierarchy: DataFrame) -> DataFrame:
    """hierarchy with path: the ids from the root to the node, joined by '/'; null where no root is reached.

    The nodes whose intervals contain a node's, by entry, are its path.
    """
    way = containment(hierarchy, hierarchy).groupBy(F.col("descendant_id").alias("session_id")).agg(F.sort_array(F.collect_list(F.struct("entry", F.col("session_id").alias("id")))).alias("way"))
    path = F.array_join(F.array_append(F.coalesce(F.col("way.id"), F.array().cast("array<string>")), F.col("session_id")), "/")
    return hierarchy.join(way, "session_id", "left").withColumn("path", F.when(F.col("depth") >= 0, path)).drop("way")


def all_descendants(hierarchy: DataFrame) -> DataFrame:
    """(session_id, descendant_id, distance) of every node with descendants: as many rows as the depths add up to."""
    return descendants_of(hierarchy, hierarchy)


def descendants_of(hierarchy: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_id, descendant_id, distance) of each session_id in wanted; nodes that reach no root have no descendants here."""
    top = hierarchy.join(wanted.select("session_id").distinct(), "session_id", "left_semi") if wanted is not hierarchy else hierarchy
    return containment(top, hierarchy).select("session_id", "descendant_id", (F.col("below_depth") - F.col("depth")).alias("distance"))

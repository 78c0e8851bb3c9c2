"""Sources mixed to target shares of all tokens."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import TOKENIZER, token_counts
from strandline.runtime import materialize

#: Membership patterns whose segments are broadcast; those of the others are joined by shuffle, with the same result.
MAX_PATTERNS = 4096
#: The largest mix is searched for to this part of its size.
TOLERANCE = 1e-5
#: Stretches of the seeded order whose token sums are taken before any exact running sum.
STRETCHES = 4096


def source_key(source: Column) -> Column:
    """A source's name regardless of case, surrounding blanks and the sign between words."""
    return F.nullif(F.regexp_replace(F.lower(F.btrim(source, F.lit(" \t\r\n　 "))), "[_\\s]+", "-"), F.lit(""))


class Flow:
    """Least-cost flow; integer capacities and costs.

    Costs rise from one shortest distance to the next (primal-dual with potentials); at each distance as much as fits is pushed
    in blocking flows, so the work grows with the edges and the number of distances, not with the number of paths.
    """

    def __init__(self):
        self.edges: list[list[int]] = []  # to, room, cost; each edge is followed by its reverse
        self.out: dict[object, list[int]] = defaultdict(list)
        self.names: list[object] = []
        self.index: dict[object, int] = {}

    def node(self, name: object) -> int:
        if name not in self.index:
            self.index[name] = len(self.names)
            self.names.append(name)
        return self.index[name]

    def add(self, a: object, b: object, room: int, cost: int = 0) -> int:
        x, y = self.node(a), self.node(b)
        self.out[x].append(len(self.edges))
        self.edges.append([y, room, cost])
        self.out[y].append(len(self.edges))
        self.edges.append([x, 0, -cost])
        return len(self.edges) - 2

    def used(self, edge: int) -> int:
        return self.edges[edge + 1][1]

    def run(self, source: object, sink: object) -> int:
        s, t = self.node(source), self.node(sink)
        n = len(self.names)
        edges, out = self.edges, [self.out.get(x, []) for x in range(n)]
        potential = [0] * n
        total = 0
        while True:
            far = [math.inf] * n
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in out[x]:
                    y, room, cost = edges[e]
                    if room > 0 and (step := d + cost + potential[x] - potential[y]) < far[y]:
                        far[y] = step
                        heapq.heappush(heap, (step, y))
            if far[t] == math.inf:
                return total
            potential = [p + d if d < math.inf else p for p, d in zip(potential, far)]
            while pushed := self._block(s, t, out, potential):
                total += pushed

    def _block(self, s: int, t: int, out: list[list[int]], potential: list[int]) -> int:
        """What a blocking flow over the shortest of the edges of reduced cost 0 pushes; 0 where the sink isn't reached."""
        edges = self.edges
        level = [-1] * len(out)
        level[s] = 0
        row = [s]
        while row and level[t] < 0:
            following = []
            for x in row:
                for e in out[x]:
                    y, room, cost = edges[e]
                    if room > 0 and level[y] < 0 and cost + potential[x] == potential[y]:
                        level[y] = level[x] + 1
                        following.append(y)
            row = following
        if level[t] < 0:
            return 0
        tried = [0] * len(out)
        path: list[int] = []
        x, total = s, 0
        while True:
            if x == t:
                push = min(edges[e][1] for e in path)
                for e in path:
                    edges[e][1] -= push
                    edges[e ^ 1][1] += push
                total += push
                full = next(i for i, e in enumerate(path) if edges[e][1] == 0)
                x = edges[path[full] ^ 1][0]
                del path[full:]
                continue
            for i in range(tried[x], len(out[x])):
                y, room, cost = edges[out[x][i]]
                if room > 0 and level[y] == level[x] + 1 and cost + potential[x] == potential[y]:
                    tried[x] = i
                    path.append(out[x][i])
                    x = y
                    break
            else:
                tried[x] = len(out[x])
                if x == s:
                    return total
                x = edges[path.pop() ^ 1][0]
                tried[x] += 1


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple, int]]:
    """(tokens of the mix, {(pattern, source): tokens}) for sources with (share, most repeats) and tokens by membership pattern.

    total is the size of the mix; without it, the largest at which every source that has tokens reaches its share: a source
    without any gets nothing and doesn't hold back the others, which keep their proportions. The k-th use of a text costs
    k - 1 a token, so texts are repeated only where a source's share needs it, and evenly over the patterns it may draw on.
    """
    targets = {s: (share, repeats) for s, (share, repeats) in targets.items() if share and share > 0 and repeats and repeats > 0}
    patterns = {p: n for p, n in patterns.items() if n > 0}

    def build(size: int, costed: bool = True):
        net = Flow()
        quotas = {s: int(share * size) for s, (share, _) in targets.items()}
        links = {}
        for p, tokens in patterns.items():
            able = [s for s in p if s in targets]
            if not able:
                continue
            most = max(targets[s][1] for s in able)
            for k in range(most) if costed else ():
                net.add("from", ("pattern", p), tokens, k)
            if not costed:  # only whether it fits matters
                net.add("from", ("pattern", p), tokens * most)
            for s in able:
                links[p, s] = net.add(("pattern", p), ("source", s), tokens * targets[s][1], 0)
        for s, quota in quotas.items():
            net.add(("source", s), "to", quota, 0)
        return net, links, sum(quotas.values())

    if total is None:
        present = {s for p in patterns for s in p}
        targets = {s: goal for s, goal in targets.items() if s in present}
        low, high = 0, sum(n * max((targets[s][1] for s in p if s in targets), default=0) for p, n in patterns.items())
        share_sum = sum(share for share, _ in targets.values())
        high = int(high / share_sum) + 1 if share_sum else 0
        while low < high:
            mid = (low + high + 1) // 2
            net, _, wanted = build(mid, costed=False)
            if net.run("from", "to") == wanted:
                low = mid
            else:
                high = mid - 1
            if high - low <= max(1, int(high * TOLERANCE)):
                break
        total = low
    net, links, _ = build(total)
    net.run("from", "to")
    return total, {key: net.used(e) for key, e in links.items() if net.used(e)}


def settle(cuts: list[tuple[str, int, int]], straddling: dict[int, tuple[int, int]], over: dict[str, int], held: dict[str, int]) -> list[tuple[str, int, int]]:
    """The cuts (source, from, to) of one pattern's tokens, moved to the edges of the documents that they fall into.

    straddling gives for each position of a cut the (start, end) of the document there, where it isn't an edge. Such a document
    goes whole to one of the sources whose stretch it overlaps, or behind the last cut to none: the one that lacks most after
    it, largest documents first. over has each source's tokens beyond its quota so far and held its tokens, and both are carried on.
    """
    shares: dict[tuple[int, int], dict[int | None, int]] = defaultdict(dict)
    for i, (_, lo, hi) in enumerate(cuts):
        for at in (lo, hi):
            if at in straddling:
                a, b = straddling[at]
                shares[a, b][i] = min(hi, b) - max(lo, a)
    inner = {i: hi - lo for i, (_, lo, hi) in enumerate(cuts)}
    for (a, b), parts in shares.items():
        for i, n in parts.items():
            inner[i] -= n
            over[cuts[i][0]] -= n
        if sum(parts.values()) < b - a:
            parts[None] = 0
    for i, n in inner.items():
        held[cuts[i][0]] += n
    owner: dict[tuple[int, int], int | None] = {}
    for (a, b), parts in sorted(shares.items(), key=lambda x: (x[0][0] - x[0][1], x[0])):
        miss = lambda i, n=b - a: 0 if i is None else abs(over[cuts[i][0]] + n) - abs(over[cuts[i][0]])
        best = min(parts, key=lambda i: (miss(i), i is None, i or 0))
        owner[a, b] = best
        if best is not None:
            over[cuts[best][0]] += b - a
            held[cuts[best][0]] += b - a
    for i, (source, _, _) in enumerate(cuts):  # nobody with a quota goes away empty where a document can be had
        if held[source] <= 0:
            able = [(b - a, a, b) for (a, b), parts in shares.items() if i in parts and (owner[a, b] is None or held[cuts[owner[a, b]][0]] > b - a)]
            if able:
                n, a, b = min(able)
                if owner[a, b] is not None:
                    over[cuts[owner[a, b]][0]] -= n
                    held[cuts[owner[a, b]][0]] -= n
                owner[a, b] = i
                over[source] += n
                held[source] += n

    def edge(at: int, before: bool, i: int) -> int:
        """Where a stretch begins (before) or ends: the document at that cut is inside if the stretch owns it, or one beyond its other end does."""
        if at not in straddling:
            return at
        a, b = straddling[at]
        who = owner[a, b]
        behind = len(cuts) if who is None else who
        return (a if behind >= i else b) if before else (b if behind <= i else a)

    return [(s, edge(lo, True, i), edge(hi, False, i)) for i, (s, lo, hi) in enumerate(cuts)]


def mix_sources(df: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of the mixes in targets (mix, source, target_share, max_repeats) from documents (doc_id, text, source).

    selection: mix, doc_id, source, copies - how often a document's text is used for a source. report: mix, source,
    target_share, actual_share, tokens, documents, copies, most_copies.

    Sources are compared by source_key. Equal texts are one text, which belongs to every source it appears under; its copy with
    the smallest doc_id stands for it. Texts without a source in the mix, null or empty ones aren't used. A text is used for a
    source at most max_repeats times. Without `total` a mix is as large as the shares of the sources
    that have texts allow (to TOLERANCE); a source without any is reported with a share of 0. Targets whose mix or source is
    null, or whose share or repeats aren't above 0, get nothing. Extra columns are ignored.

    Token sums by membership pattern are all that the driver sees, and one document for each end of a stretch: a row for each set
    of sources under which texts appear, however many there are. For each mix, patterns that agree in the mix's own sources are
    one in its flow. Documents are then selected in a seeded order: a document stands at its place in the running sum of tokens
    of its pattern, and that sum is taken over STRETCHES of the order first, exactly only within each; patterns that are one in a
    mix follow each other in a seeded order. The flow's stretches are moved to the edges of documents so that what one source
    gets too much by another has too little (see settle): a share misses by less than a document.
    """
    spark = df.sparkSession
    goals = targets.select(F.col("mix").cast("string").alias("mix"), source_key(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    goals = materialize(goals.where("mix is not null and source is not null and share > 0 and repeats > 0").groupBy("mix", "source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")), "goals")
    known = goals.select("source").distinct().withColumn("known", F.lit(True))
    source = source_key(F.col("source").cast("string"))
    keyed = df.where(F.octet_length(F.col("text").cast("string")) > 0).select("doc_id", F.col("text").cast("string").alias("text"), source.alias("source"))
    sized = token_counts(keyed.withColumn("digest", F.sha2("text", 256)), "doc_id", "text", tokenizer, ("source", "digest"))
    sized = sized.join(known, "source", "left").withColumn("source", F.when(F.col("known"), F.col("source")))  # so a text's set of sources is bounded by the targets
    texts = sized.groupBy("digest").agg(F.min("id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_set("source")).alias("sources"))
    texts = materialize(texts.where(F.size("sources") > 0), "texts")
    sums = texts.groupBy("sources").agg(F.sum("n_tokens").alias("n"))
    patterns = {tuple(r["sources"]): r["n"] for r in sums.collect()}
    shuffled = sorted(patterns, key=lambda p: hashlib.md5(f"{seed} {p}".encode()).digest())
    flows = []  # for each mix: its alike patterns with sizes, and the cuts of their tokens, laid end to end over their repetitions
    for mix, rows in groupby(goals.orderBy("mix", "source").toLocalIterator(), key=lambda r: r["mix"]):
        goal = {r["source"]: (r["share"], r["repeats"]) for r in rows}
        alike: dict[tuple, list[tuple]] = defaultdict(list)
        for pattern in shuffled:
            if own := tuple(s for s in pattern if s in goal):
                alike[own].append(pattern)
        sizes = {own: sum(patterns[p] for p in ps) for own, ps in alike.items()}
        _, routed = route(sizes, goal, total)
        cuts: dict[tuple, list] = defaultdict(list)
        for (own, source), tokens in sorted(routed.items()):
            lo = cuts[own][-1][2] if cuts[own] else 0
            cuts[own].append((source, lo, lo + tokens))
        flows.append((mix, alike, sizes, cuts))
    placed = materialize(_running(texts, seed), "placed")
    found = _documents_at(placed, patterns, flows)
    plan = []  # mix, pattern, source, size, base, from, to
    for m, (mix, alike, sizes, cuts) in enumerate(flows):
        over, held = defaultdict(int), defaultdict(int)
        settled = {own: settle(parts, found[m, own], over, held) for own, parts in sorted(cuts.items(), key=lambda x: (-sizes[x[0]], x[0]))}
        for own, parts in settled.items():
            size, base = sizes[own], 0
            for pattern in alike[own]:
                n = patterns[pattern]
                for source, lo, hi in parts:
                    if max(0, (lo - base - n) // size + 1) * size + base < hi:  # the first repetition of the pattern that ends beyond lo
                        plan.append((mix, list(pattern), source, size, base, lo, hi))
                base += n
    kind = "mix string, sources array<string>, source string, size bigint, base bigint, lo bigint, hi bigint"
    large = set(sorted(patterns, key=lambda p: (-patterns[p], p))[:MAX_PATTERNS])
    joined = placed.join(F.broadcast(spark.createDataFrame([r for r in plan if tuple(r[1]) in large], kind)), "sources")
    if len(patterns) > MAX_PATTERNS:  # none of the others holds more than a small part of the texts
        joined = joined.unionByName(placed.join(spark.createDataFrame([r for r in plan if tuple(r[1]) not in large], kind).hint("merge"), "sources"))
    # the k-th repetition of a document has its middle at k * size + its place + half its tokens; a segment that holds it uses it
    before = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("base") - F.col("place") - F.col("n_tokens") / 2) / F.col("size")))
    used = joined.withColumn("copies", (before("hi") - before("lo")).cast("long")).where("copies > 0")
    selection = used.select("mix", "doc_id", "source", "copies", "n_tokens")
    chosen = materialize(selection, "mixture")
    report = chosen.groupBy("mix", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    whole = report.groupBy("mix").agg(F.sum("tokens").alias("mix_tokens"))
    report = goals.join(report, ["mix", "source"], "left").join(whole, "mix", "left").select(
        "mix", "source", F.col("share").alias("target_share"), F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "copies", "most_copies")),
    )
    return chosen.drop("n_tokens"), report


def _documents_at(placed: DataFrame, patterns: dict[tuple, int], flows: list) -> dict[tuple[int, tuple], dict[int, tuple[int, int]]]:
    """For each mix and set of alike patterns: {position of a cut: (start, end) of the document it falls into}, edges left out."""
    wanted = []
    for m, (_, alike, sizes, cuts) in enumerate(flows):
        for own, parts in cuts.items():
            for at in {x for _, lo, hi in parts for x in (lo, hi)}:
                base = 0
                for pattern in alike[own]:
                    if base < at % sizes[own] < base + patterns[pattern]:
                        wanted.append((m, list(own), at, list(pattern), at % sizes[own] - base))
                    base += patterns[pattern]
    out: dict[tuple[int, tuple], dict[int, tuple[int, int]]] = defaultdict(dict)
    if not wanted:
        return out
    asked = placed.sparkSession.createDataFrame(wanted, "m int, own array<string>, at bigint, sources array<string>, inside bigint")
    hit = placed.join(asked, "sources").where("place < inside and inside < place + n_tokens").select("m", "own", "at", "inside", "place", "n_tokens")
    for r in hit.collect():
        start = r["at"] - r["inside"] + r["place"]
        out[r["m"], tuple(r["own"])][r["at"]] = (start, start + r["n_tokens"])
    return out


def _running(texts: DataFrame, seed: int) -> DataFrame:
    """texts with place: tokens of the pattern's texts before this one in the seeded order."""
    u = F.pmod(F.xxhash64(F.lit(seed), "digest"), F.lit(1 << 40))
    rows = texts.withColumn("u", u).withColumn("stretch", F.shiftright("u", 40 - STRETCHES.bit_length() + 1))
    sums = rows.groupBy("sources", "stretch").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("sources").orderBy("stretch")
    starts = sums.withColumn("base", F.sum("n").over(w) - F.col("n")).drop("n")
    inner = Window.partitionBy("sources", "stretch").orderBy("u", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, ["sources", "stretch"]).withColumn("place", F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).drop("base", "u", "stretch")

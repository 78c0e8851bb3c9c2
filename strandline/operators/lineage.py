"""Transitive lineage: the root that a session's parent links lead to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.hierarchy import ONE_TASK
from strandline.runtime import counted, materialize, release


def walk_all(rows: list[tuple[str, str, str, bool]]) -> dict[str, str]:
    """Lineage of each id in (id, to, least, ended): the end its chain comes to, or the least of all it walks where that is a cycle."""
    links = {i: (to, least, ended) for i, to, least, ended in rows}
    found = {i: (to, True) for i, (to, _, ended) in links.items() if ended}  # (end or least, whether it is an end)
    for start in links:
        chain, place = [], {}
        at = start
        while at not in found and at not in place:
            place[at] = len(chain)
            chain.append(at)
            at = links[at][0]
        if at in found:
            end, known = found[at]
            tail = chain
        else:  # a new cycle: all of it has the same least
            tail, circle = chain[: place[at]], chain[place[at] :]
            end, known = min(links[i][1] for i in circle), False
            found |= {i: (end, False) for i in circle}
        for i in reversed(tail):
            end = end if known else min(end, links[i][1])
            found[i] = (end, known)
    return {i: end for i, (end, _) in found.items()}


def lineage_roots(sessions: DataFrame) -> DataFrame:
    """(session_id, lineage) for each distinct id.

    The chain of parent links is followed to its end: a session without parent, or a parent that isn't known, which is then the
    root itself. A chain that runs into a cycle has the smallest id of all it walked, the way into the cycle included. Of
    several rows with one id the last updated counts. Links are doubled while more than ONE_TASK chains go on; a single task then
    walks those.
    """
    latest = sessions.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", F.nullif(F.col("parent_session"), F.lit("")).alias("p"))).getField("p").alias("to"))
    latest = materialize(latest, "lineage", F.lit(True))
    unknown = latest.where("to is not null").select(F.col("to").alias("id")).distinct().join(latest, "id", "left_anti")
    links = latest.select("id", F.coalesce("to", "id").alias("to"), F.least("id", F.coalesce("to", "id")).alias("least"), F.col("to").isNull().alias("ended"))
    ends = unknown.select("id", F.col("id").alias("to"), F.col("id").alias("least"), F.lit(True).alias("ended"))
    state = materialize(links.unionByName(ends), "lineage", ~F.col("ended"))
    for _ in range(counted(latest).bit_length()):
        if counted(state) <= ONE_TASK:
            break
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("ended").alias("ended2"))
        moved = state.where("not ended").join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), F.col("ended2").alias("ended"))
        after = materialize(moved.unionByName(state.where("ended")), "lineage", ~F.col("ended"))
        release(state)
        state = after
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        found = walk_all(rows)
        going = [r[0] for r in rows if not r[3]]
        yield pa.RecordBatch.from_arrays([pa.array(going, pa.string()), pa.array([found[i] for i in going], pa.string())], ["session_id", "lineage"])

    going = state.where("not ended")
    met = state.where("ended").join(going.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
    walked = going.unionByName(met).select("id", "to", "least", "ended").coalesce(1).mapInArrow(finish, "session_id string, lineage string")
    roots = state.where("ended").select(F.col("id").alias("session_id"), F.col("to").alias("lineage")).unionByName(walked)
    return roots.join(latest.select(F.col("id").alias("session_id")), "session_id", "left_semi")

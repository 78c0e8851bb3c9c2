"""Session lists: filters, stable pages, relevance order, single-session summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import ranking
from strandline.operators.search import Filter, meta_matches

DAY_MS = 86_400_000


def indexable(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.coalesce("unindexable", F.lit(False))) if "unindexable" in sessions.columns else sessions


def newest_first() -> list[Column]:
    return [F.col("last_time").desc_nulls_last(), F.col("id").asc_nulls_last(), F.col("file").asc_nulls_last()]


def parse_cursor(cursor: str | None) -> tuple[int, str] | None:
    """(time, id) of a page's cursor; one without an id has ''; None where it can't be read."""
    if not cursor:
        return None
    time, _, name = cursor.partition("|")
    try:
        return int(time), name
    except ValueError:
        return None


def format_cursor(last_time: int, name: str) -> str:
    return f"{last_time}|{name}"


def matching(sessions: DataFrame, workspace: str = "", query: str = "", filter: Filter = Filter()) -> DataFrame:  # noqa: A002
    rows = indexable(sessions).where(filter.on_sessions(workspace))
    if filter.role == "tool" and "tool_call_counts" in rows.columns:
        rows = rows.where(F.aggregate(F.map_values("tool_call_counts"), F.lit(0).cast("long"), lambda a, x: a + x) > 0)
    return rows.where(meta_matches(query.strip())) if query.strip() else rows


def page(sessions: DataFrame, limit: int, cursor: str | None = None) -> tuple[list, str | None]:
    """(rows, next cursor) of a list in time order: what comes after the cursor's (time, id), so inserts don't shift pages."""
    rows = after_cursor(sessions, cursor).orderBy(*newest_first()).limit(limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, format_cursor(rows[-1]["last_time"], rows[-1]["id"]) if more else None


def after_cursor(sessions: DataFrame, cursor: str | None) -> DataFrame:
    at = parse_cursor(cursor)
    if at is None:
        return sessions
    return sessions.where((F.col("last_time") < at[0]) | ((F.col("last_time") == at[0]) & (F.col("id") > at[1])))


def by_relevance(sessions: DataFrame, query: str, now_ms: int, workspace: str = "", limit: int = 50, evidence: bool = False) -> DataFrame:
    """The best `limit` of all sessions with their score's parts.

    Order: score, then the shorter matched field, the earlier start, the earlier end, the newer session. sessions may carry
    hit_rows and rank (with evidence), else a session counts by its number of events.
    """
    q = F.lit(query.lower())
    # case is folded before the match, so its capital bonus never applies here
    fuzzy = sessions.withColumn("by_title", ranking.fuzzy_column(q, F.lower(F.coalesce("title", F.lit("")))))
    fuzzy = fuzzy.withColumn("by_text", ranking.fuzzy_column(q, F.lower(F.coalesce("first_user_text", F.lit("")))))
    events = F.least(F.coalesce(F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)), F.lit(ranking.EVENTS_CAP)) if "counts" in sessions.columns else F.lit(0)
    columns = ranking.score_columns(query, now_ms, workspace, F.col("hit_rows") if evidence else events, F.col("rank") if evidence else None)
    scored = fuzzy.withColumns(columns)
    return scored.orderBy(F.col("score").desc(), "field_length", "match_start", "match_end", *newest_first()).drop("by_title", "by_text").limit(limit)


def find_session(sessions: DataFrame, wanted: str) -> DataFrame:
    """The first session by time whose id or file is `wanted`, or whose id or file contains it in any case."""
    low = F.lit(wanted.lower())
    exact = (F.col("id") == wanted) | (F.col("file") == wanted)
    rows = indexable(sessions).where(exact | F.contains(F.lower("file"), low) | F.contains(F.lower("id"), low))
    return rows.orderBy(F.when(exact, 0).otherwise(1), *newest_first()).limit(1)


def retained(sessions: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Sessions not older than so many days by the later of last and modified time; 0 days or an unknown time keeps all."""
    latest = F.greatest(F.coalesce("last_time", F.lit(0)), F.coalesce("mtime_ms", F.lit(0)) if "mtime_ms" in sessions.columns else F.lit(0))
    cutoff = now_ms - days * DAY_MS
    return sessions if days <= 0 or cutoff <= 0 else sessions.where((latest <= 0) | (latest >= cutoff))


def top_counts(counts: Column, n: int) -> Column:
    """'name:count' of the n largest entries of a map, larger first, then by name."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.array_join(F.transform(F.slice(entries, 1, n), lambda e: F.concat_ws(":", e["k"], (-e["v"]).cast("string"))), ", ")


def summarize(sessions: DataFrame) -> DataFrame:
    """One row a session with its duration, event counts and tools by name."""
    return sessions.select(
        "id", "file", "workspace", "created_at", "last_time", F.greatest(F.lit(0).cast("long"), F.col("last_time") - F.col("created_at")).alias("duration_ms"), "title", "first_user_text", "last_assistant_text",
        "agent_preset", top_counts(F.col("counts"), 12).alias("counts"), F.array_join(F.transform(F.array_sort(F.map_entries("tool_call_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ", ").alias("tool_calls"),
    )

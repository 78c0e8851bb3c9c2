"""Substring search over messages and sessions: matching, evidence, representatives, pages, lineage groups."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.functions.text import Query, parse_query
from strandline.runtime import counted, materialize

#: Fixed values of the evidence score.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
ROLES = ("user", "assistant", "tool", "any")


@dataclass(frozen=True)
class Filter:
    """Role, and inclusive bounds on the session's last time; anything not understood filters nothing."""

    role: str = "any"
    since_ms: float | None = None
    until_ms: float | None = None

    @staticmethod
    def of(role: object = None, since_ms: object = None, until_ms: object = None) -> Filter:
        number = lambda x: x if isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf") else None
        return Filter(role if role in ROLES else "any", number(since_ms), number(until_ms))

    def on_messages(self) -> Column:
        if self.role == "tool":
            return F.coalesce(F.col("tool_name"), F.lit("")) != ""
        return F.col("role") == self.role if self.role != "any" else F.lit(True)

    def on_sessions(self, workspace: str = "") -> Column:
        out = F.lit(True)
        if workspace:
            out = out & F.contains(F.lower("workspace"), F.lit(workspace.lower()))
        if self.since_ms is not None:
            out = out & (F.col("last_time") >= self.since_ms)
        if self.until_ms is not None:
            out = out & (F.col("last_time") <= self.until_ms)
        return out


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """One row for each file: the last updated."""
    w = Window.partitionBy("file").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id"))
    return sessions.where("file is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def searchable(messages: DataFrame) -> DataFrame:
    """Messages with lower-cased search columns in which the excerpt's own marks are replaced; empty rows are left out."""
    out = messages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tool_name", F.coalesce("tool_name", F.lit("")))
    out = out.withColumn("search_text", F.lower(tx.normalize_markers(F.col("text")))).withColumn("search_tool", F.lower(tx.normalize_markers(F.col("tool_name"))))
    return out.where((F.col("search_text") != "") | (F.col("search_tool") != ""))


def chunks(messages: DataFrame) -> DataFrame:
    """(message_id, chunk_index, char_start, char_end, text, tool_name): lower-cased stretches of searchable messages."""
    size = F.char_length("search_text")
    rows = messages.select(F.col("id").alias("message_id"), "search_text", F.col("search_tool").alias("tool_name"), F.posexplode(tx.chunk_starts(F.col("search_text"))).alias("chunk_index", "char_start"))
    return rows.select(
        "message_id", "chunk_index", "char_start", F.least(F.col("char_start") + tx.CHUNK, size).alias("char_end"),
        F.substring("search_text", F.col("char_start") + 1, F.lit(tx.CHUNK)).alias("text"), "tool_name",
    )


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, overlaps counted."""
    return F.regexp_count(text, F.lit("(?=\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E)"))


def chunk_statistics(pieces: DataFrame) -> dict:
    """Number of chunks and mean length in trigrams: one row, kept when a corpus is published."""
    r = pieces.agg(F.count("*").alias("n"), F.avg(_trigrams()).alias("mean")).head()
    return {"n": r["n"], "mean": r["mean"] or 0.0}


def _trigrams() -> Column:
    return F.greatest(F.char_length("text") - 2, F.lit(0)) + F.greatest(F.char_length("tool_name") - 2, F.lit(0))


def term_hits(pieces: DataFrame, query: Query, statistics: dict | None = None) -> tuple[DataFrame, dict]:
    """(chunks that hold any term: message_id, size, tf0, tf1, ...; their statistics: chunks, mean length, chunks by term).

    The texts are read once: what is counted over all chunks is observed while the hits are written.
    """
    tf = [F.col(f"tf{i}") for i in range(len(query.terms))]
    rows = pieces.select("message_id", _trigrams().alias("size"), *((occurrences(F.col("text"), t) + occurrences(F.col("tool_name"), t)).alias(f"tf{i}") for i, t in enumerate(query.lowered)))
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *(F.count_if(c > 0).alias(f"n{i}") for i, c in enumerate(tf)))
    found = materialize(observed.where(F.greatest(*tf, F.lit(0)) > 0), "hits")
    return found, dict(seen.get) | (statistics or {})


def message_evidence(pieces: DataFrame, query: Query, statistics: dict | None = None) -> DataFrame:
    """(message_id, rank, every): the best, i.e. least, bm25 over a message's chunks that hold any term, and whether it holds all.

    A term that may be searched for by evidence is no longer than what chunks share, so it stands whole in one of them.
    statistics are those of all chunks (chunk_statistics), where pieces are only candidates.
    """
    found, stats = term_hits(pieces, query, statistics)
    score = F.lit(0.0)
    for i in range(len(query.terms)):
        n = stats[f"n{i}"] or 0
        idf = math.log(((stats["n"] or 0) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else LEAST_IDF
        tf = F.col(f"tf{i}")
        score = score + F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("size") / (stats["mean"] or 1.0)))
    every = F.lit(True)
    for i in range(len(query.terms)):
        every = every & (F.max(f"tf{i}") > 0)
    return found.groupBy("message_id").agg(F.min(-score).alias("rank"), every.alias("every"))


def matched_messages(messages: DataFrame, sessions: DataFrame, query: Query, every: bool, filter: Filter = Filter(), workspace: str = "", ranked: bool = True, evidence: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """(id, session_file, session_id, event_seq, rank) of each message that holds all (or any) terms.

    Only keys and scores go on from here; texts are fetched for the page alone. rank is null where a term is too short or too
    long for the index.
    """
    if ranked and query.indexed:
        rank = message_evidence(chunks(searchable(messages)), query) if evidence is None else evidence
        rank = rank.where("every") if every else rank
        hits = messages.where(filter.on_messages()).select("id", "session_file", "event_seq").join(rank.select(F.col("message_id").alias("id"), "rank"), "id")
    else:
        rows = searchable(messages.where(filter.on_messages()))
        hits = rows.where(tx.holds_terms(F.col("search_text"), F.col("search_tool"), query, every)).withColumn("rank", F.lit(None).cast("double"))
    held = sessions.where(filter.on_sessions(workspace)).select(F.col("file").alias("session_file"), F.col("id").alias("session_id"))
    return hits.select("id", "session_file", "event_seq", "rank").join(held, "session_file").select("id", "session_file", "session_id", "event_seq", "rank")


def page_order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("rank", "session_id", "session_file", "event_seq", "id")]


def representatives(matched: DataFrame) -> DataFrame:
    """One row for each session file: its best hit, with match_count. Hot sessions are cut down before the window by its rank limit."""
    w = Window.partitionBy("session_file")
    counts = matched.groupBy("session_file").agg(F.count("*").alias("match_count"))
    best = w.orderBy(*(F.asc_nulls_first(c) for c in ("rank", "event_seq", "id")))
    return matched.withColumn("choice", F.row_number().over(best)).where("choice = 1").drop("choice").join(counts, "session_file")


def search_messages(messages: DataFrame, sessions: DataFrame, raw: str, limit: int, mode: str | None = None, filter: Filter = Filter(), workspace: str = "") -> DataFrame:  # noqa: A002
    """The first hits message by message; without a mode AND, and OR if that finds nothing."""
    query = parse_query(raw)
    matched = _relaxed(messages, sessions, query, mode, filter, workspace)
    return shape(matched.orderBy(*page_order()).limit(max(1, limit)), messages, sessions, query)


def search_page(messages: DataFrame, sessions: DataFrame, raw: str, limit: int | None, mode: str | None = None, filter: Filter = Filter(), workspace: str = "", postings: DataFrame | None = None, statistics: dict | None = None) -> tuple[DataFrame, int]:  # noqa: A002
    """(hits, total): the first sessions by their representative hit (all without a limit), and how many sessions there are.

    With the published posting table and chunk statistics only candidates are read; the hits are the same.
    """
    query = parse_query(raw)
    matched = _relaxed(messages, sessions, query, mode, filter, workspace, postings, statistics)
    chosen = materialize(representatives(matched), "chosen", F.lit(True))
    page = chosen if limit is None else chosen.orderBy(*page_order()).limit(max(1, limit))
    return shape(page, messages, sessions, query), counted(chosen)


def _relaxed(messages: DataFrame, sessions: DataFrame, query: Query, mode: str | None, filter: Filter, workspace: str, postings: DataFrame | None = None, statistics: dict | None = None) -> DataFrame:  # noqa: A002
    if not query.terms:
        return matched_messages(messages, sessions, Query(("",)), True, filter, workspace, False).where(F.lit(False))
    evidence = None
    if query.indexed:
        pool = messages
        if postings is not None and statistics is not None:
            pool = messages.join(candidates(postings, query).select(F.col("message_id").alias("id")), "id", "left_semi")
        evidence = materialize(message_evidence(chunks(searchable(pool)), query, statistics if pool is not messages else None), "evidence")
    matched = matched_messages(messages, sessions, query, mode != "or", filter, workspace, evidence=evidence)
    if mode is None and not matched.limit(1).count():
        return matched_messages(messages, sessions, query, False, filter, workspace, evidence=evidence)
    return matched


def shape(page: DataFrame, messages: DataFrame, sessions: DataFrame, query: Query) -> DataFrame:
    """A page of keys with the texts it shows: snippet around the first term, text cut to 4096 characters, one-hop lineage."""
    wide = messages.select("id", "session_file", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), "anchor_id")
    about = sessions.select(F.col("file").alias("session_file"), "workspace", "title", F.coalesce(F.nullif("parent_session", F.lit("")), F.col("id")).alias("lineage_root"))
    rows = page.join(wide, ["id", "session_file"]).join(about, "session_file")
    term = tx.first_present(F.col("text"), F.col("tool_name"), query.terms or ("",))
    snippet = tx.excerpt(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("tool_name")), term)
    counts = ["match_count"] if "match_count" in page.columns else []
    return rows.select(
        "session_id", "session_file", "workspace", "title", "role", F.substring("text", 1, 4096).alias("text"), (F.char_length("text") > 4096).alias("text_truncated"), "tool_name",
        snippet.alias("snippet"), F.col("id").alias("message_id"), "anchor_id", "event_seq", "lineage_root", "rank", *counts,
    ).orderBy(*(F.asc_nulls_first(c) for c in ("rank", "session_id", "session_file", "event_seq", "message_id")))


def trigram_postings(messages: DataFrame) -> DataFrame:
    """(trigram, message_id): the optional index, distinct per message; publish it bucketed by trigram."""
    rows = searchable(messages)
    # characters first: a substring of a long text would be sought from its start each time
    letters = rows.select("id", *(F.regexp_extract_all(F.col(c), F.lit("(?s)."), F.lit(0)).alias(c) for c in ("search_text", "search_tool")))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 3), ""))
    pieces = letters.select(F.col("id").alias("message_id"), F.explode(F.array_distinct(F.concat(grams(F.col("search_text")), grams(F.col("search_tool"))))).alias("trigram"))
    return pieces.where(F.char_length("trigram") == 3).select("trigram", "message_id")


def candidates(postings: DataFrame, query: Query) -> DataFrame:
    """message_ids that have all trigrams of some term, for terms that are indexed; exact matching follows."""
    wanted = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in query.lowered}
    grams = sorted({g for gs in wanted.values() for g in gs})
    have = postings.where(F.col("trigram").isin(grams)).groupBy("message_id").agg(F.collect_set("trigram").alias("have"))
    hit = F.lit(False)
    for gs in wanted.values():
        hit = hit | (F.size(F.array_except(F.array(*map(F.lit, gs)), F.col("have"))) == 0)
    return have.where(hit).select("message_id")


def meta_matches(raw: str) -> Column:
    """Whether the whole query stands in a session's id, workspace, title, first or last text or a tool name."""
    q = F.lit(raw.lower())
    fields = [F.contains(F.lower(F.coalesce(c, F.lit(""))), q) for c in ("id", "workspace", "title", "first_user_text", "last_assistant_text")]
    out = F.exists(F.coalesce("tool_names", F.array().cast("array<string>")), lambda n: F.contains(F.lower(n), q))
    for f in fields:
        out = out | f
    return out


def lineage_groups(hits: DataFrame, roots: DataFrame, per_session: int = 3) -> DataFrame:
    """One row for each lineage: its representative hit, hit rows and sessions.

    hits: (session_id, session_file, message_id, snippet, rank, match_count, arrival), rank null for hits without evidence and
    match_count null for metadata. The least rank represents; among hits without one the first to arrive, content before
    metadata. roots: (session_id, lineage).
    """
    rows = hits.join(roots, "session_id", "left").withColumn("lineage", F.coalesce("lineage", "session_id"))
    by_file = rows.groupBy("lineage", "session_file").agg(
        F.sum(F.least(F.coalesce("match_count", F.lit(0)), F.lit(per_session))).alias("file_hits"),
        F.min(F.struct(F.col("match_count").isNull().alias("meta"), F.col("rank").isNull().alias("bare"), "rank", "arrival", "session_id", "message_id", "snippet")).alias("best"),
    )
    out = by_file.groupBy("lineage").agg(F.sum("file_hits").alias("hit_rows"), F.count("*").alias("sessions"), F.min("best").alias("best"))
    return out.select("lineage", "hit_rows", "sessions", "best.session_id", "best.message_id", "best.snippet", "best.rank", F.when(F.col("best.meta"), "meta").otherwise("content").alias("kind"))


def best_evidence(rows: DataFrame) -> DataFrame:
    """(lineage, best, hit_rows) of rows (session_id, lineage_root, bm25): the least value and the count of each lineage."""
    key = F.coalesce(F.nullif("lineage_root", F.lit("")), F.col("session_id"))
    return rows.groupBy(key.alias("lineage")).agg(F.min("bm25").alias("best"), F.count("*").alias("hit_rows"))

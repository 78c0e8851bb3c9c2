"""Queries of the session-search operators over fts_sessions, fts_messages and session_log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import ranking
from strandline.functions import text as tx
from strandline.operators import bookmarks, dedup, fold, lineage, listing, metadata, scroll, search
from strandline.runtime import table
from strandline.streaming import store

QUERIES = {}
SQL = {}
#: SQL for the JSON text of data, unwrapped once, or null where it does not parse.
PARSED = """
SELECT *, CASE WHEN json_valid(data) THEN
    CASE WHEN json_type(data) = 'VARCHAR'
      THEN CASE WHEN json_valid(json_extract_string(data, '$')) THEN json_extract_string(data, '$') END
      ELSE data END END AS doc
FROM session_log"""
#: Fixed "now" of the recency queries.
NOW = 1_775_000_000_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return search.latest_sessions(table(spark, d, "fts_sessions"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fts_messages")


SESSIONS = "(SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY updated_at DESC NULLS LAST, id) AS k FROM fts_sessions WHERE file IS NOT NULL) WHERE k = 1)"
_MARK = "replace(replace({0}, '>>>', '»'), '<<<', '«')"
SEARCHABLE = f"(SELECT id, session_file, role, coalesce(text, '') AS text, coalesce(tool_name, '') AS tool_name, anchor_id, event_seq, lower({_MARK.format("coalesce(text, '')")}) AS search_text, lower({_MARK.format("coalesce(tool_name, '')")}) AS search_tool FROM fts_messages)"
WHITE = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _flat(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WHITE}+', ' ', 'g'))"


def _holds(terms: list[str], joiner: str) -> str:
    return f" {joiner} ".join(f"(contains(search_text, '{t}') OR contains(search_tool, '{t}'))" for t in terms)


def _excerpt(flat: str, term: str) -> str:
    """SQL of the excerpt of a collapsed text around a term."""
    at, n = f"instr(lower({flat}), '{term.lower()}')", len(term)
    start, end = f"greatest(1, {at} - 48)", f"least(length({flat}), {at} + {n} - 1 + 96)"
    body = f"CASE WHEN {start} > 1 THEN '… ' ELSE '' END || substr({flat}, {start}, {at} - {start}) || '>>>' || substr({flat}, {at}, {n}) || '<<<' || substr({flat}, {at} + {n}, greatest(0, {end} - ({at} + {n}) + 1)) || CASE WHEN {end} < length({flat}) THEN ' …' ELSE '' END"
    return f"CASE WHEN {at} > 0 THEN substr({body}, 1, 400) ELSE substr({flat}, 1, 184) END"


def _matched(terms: list[str], joiner: str, where: str = "true") -> str:
    return f"SELECT m.id, m.session_file, s.id AS session_id, m.event_seq FROM {SEARCHABLE} m JOIN {SESSIONS} s ON s.file = m.session_file WHERE ({_holds(terms, joiner)}) AND {where}"


_ONE = "SELECT id AS message_id, session_file, session_id, coalesce(event_seq, -1) AS event_seq"


def _keys(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("message_id"), "session_file", "session_id", F.coalesce("event_seq", F.lit(-1).cast("long")).alias("event_seq"))


@query(f"{_ONE} FROM ({_matched(['memory leak'.split()[0], 'leak'], 'AND')})")
def search_and_messages(spark, d):
    """Messages that hold all terms."""
    found = search.matched_messages(_messages(spark, d), _sessions(spark, d), tx.parse_query("memory leak"), True, ranked=False)
    return _keys(found)


@query(f"{_ONE} FROM ({_matched(['glacier', 'qqabsent'], 'OR')})")
def search_or_relaxed(spark, d):
    """AND finds nothing, so any term will do."""
    q = tx.parse_query("glacier qqabsent")
    found = search._relaxed(_messages(spark, d), _sessions(spark, d), q, None, search.Filter(), "")  # noqa: SLF001
    return _keys(found)


@query(f"{_ONE} FROM ({_matched(['apply', 'patch'], 'AND', 'm.tool_name <> ' + chr(39) * 2)})")
def search_role_filter(spark, d):
    """Tool messages whose name holds the terms."""
    found = search.matched_messages(_messages(spark, d), _sessions(spark, d), tx.parse_query("apply patch"), True, search.Filter(role="tool"), ranked=False)
    return _keys(found)


@query(f"{_ONE} FROM ({_matched(['season'], 'AND', 's.last_time >= 1768000000000 AND s.last_time <= 1772000000000')})")
def search_time_range(spark, d):
    """Hits of sessions whose last time lies in a range."""
    found = search.matched_messages(_messages(spark, d), _sessions(spark, d), tx.parse_query("season"), True, search.Filter(since_ms=1768000000000, until_ms=1772000000000), ranked=False)
    return _keys(found)


@query(f"{_ONE} FROM ({_matched(['step'], 'AND', chr(39).join(['contains(lower(s.workspace), ', 'harbor', ')']))})")
def search_workspace_filter(spark, d):
    """Hits of sessions whose workspace holds a word."""
    found = search.matched_messages(_messages(spark, d), _sessions(spark, d), tx.parse_query("step"), True, workspace="HARBOR", ranked=False)
    return _keys(found)


@query(f"""
WITH hit AS ({_matched(['步'], 'AND')}),
best AS (SELECT *, count(*) OVER (PARTITION BY session_file) AS match_count, row_number() OVER (PARTITION BY session_file ORDER BY event_seq NULLS FIRST, id) AS k FROM hit)
SELECT session_id, session_file, id AS message_id, coalesce(event_seq, -1) AS event_seq, CAST(match_count AS BIGINT) AS match_count FROM best WHERE k = 1""")
def search_representatives(spark, d):
    """One hit for each session, with its count; a one-letter term takes the path without evidence."""
    found = search.matched_messages(_messages(spark, d), _sessions(spark, d), tx.parse_query("步"), True)
    chosen = search.representatives(found)
    return chosen.select("session_id", "session_file", F.col("id").alias("message_id"), F.coalesce("event_seq", F.lit(-1).cast("long")).alias("event_seq"), "match_count")


@query(f"""
WITH hit AS ({_matched(['步'], 'AND')}),
best AS (SELECT *, count(*) OVER (PARTITION BY session_file) AS match_count, row_number() OVER (PARTITION BY session_file ORDER BY event_seq NULLS FIRST, id) AS k FROM hit),
page AS (SELECT * FROM best WHERE k = 1 ORDER BY session_id NULLS FIRST, session_file NULLS FIRST, event_seq NULLS FIRST, id LIMIT 20)
SELECT p.session_id, p.session_file, p.id AS message_id, {_excerpt('x.flat', '步')} AS snippet
FROM page p JOIN (SELECT id, {_flat("CASE WHEN text <> '' THEN text ELSE tool_name END")} AS flat FROM {SEARCHABLE}) x ON x.id = p.id""")
def search_page(spark, d):
    """The first twenty sessions of a search, with snippets fetched for the page alone."""
    hits, _ = search.search_page(_messages(spark, d), _sessions(spark, d), "步", 20)
    return hits.select("session_id", "session_file", "message_id", "snippet")


CHUNKS = f"""(SELECT id AS message_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 3968 AS BIGINT) AS char_start, CAST(least(i * 3968 + 4096, length(search_text)) AS BIGINT) AS char_end,
  substr(search_text, i * 3968 + 1, 4096) AS text, search_tool AS tool_name
  FROM (SELECT *, unnest(range(0, CAST(greatest(length(search_text) - 129, 0) // 3968 + 1 AS BIGINT))) AS i FROM {SEARCHABLE} WHERE search_text <> '' OR search_tool <> ''))"""


@query(f"SELECT message_id, chunk_index, char_start, char_end, md5(text) AS text_md5 FROM {CHUNKS}")
def chunk_explode(spark, d):
    """Messages as overlapping chunks."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return search.chunks(search.searchable(_messages(spark, d))).select("message_id", long("chunk_index"), long("char_start"), long("char_end"), F.md5("text").alias("text_md5"))


def _tf(column: str, term: str) -> str:
    return f"len(list_filter(range(1, CAST(greatest(length({column}) - {len(term)} + 2, 1) AS BIGINT)), lambda i: substr({column}, i, {len(term)}) = '{term}'))"


def _evidence(terms: list[str]) -> str:
    tf = ", ".join(f"{_tf('text', t)} + {_tf('tool_name', t)} AS tf{i}" for i, t in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (tf{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END AS idf{i}" for i in range(len(terms)))
    score = " + ".join(f"idf{i} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""SELECT message_id, min(-({score})) AS rank FROM (
      SELECT message_id, greatest(length(text) - 2, 0) + greatest(length(tool_name) - 2, 0) AS size, {tf} FROM {CHUNKS}) c
      CROSS JOIN (SELECT *, {idf} FROM (SELECT count(*) AS n, avg(size) AS mean, {n} FROM (SELECT greatest(length(text) - 2, 0) + greatest(length(tool_name) - 2, 0) AS size, {tf} FROM {CHUNKS}))) g
      WHERE {some} GROUP BY message_id"""


@query(f"SELECT message_id, round(rank, 9) AS rank FROM ({_evidence(['compiler', 'linker'])})")
def bm25_message_min(spark, d):
    """The best chunk's evidence of each message."""
    rank = search.message_evidence(search.chunks(search.searchable(_messages(spark, d))), tx.parse_query("compiler linker"))
    return rank.select("message_id", F.round("rank", 9).alias("rank"))


@query(f"""
WITH hit AS (SELECT m.*, e.rank FROM ({_matched(['compiler', 'linker'], 'OR')}) m JOIN ({_evidence(['compiler', 'linker'])}) e ON e.message_id = m.id)
SELECT coalesce(nullif(s.parent_session, ''), s.id) AS lineage, round(min(h.rank), 9) AS best, CAST(count(*) AS BIGINT) AS hit_rows
FROM hit h JOIN {SESSIONS} s ON s.file = h.session_file GROUP BY 1""")
def bm25_best_per_lineage(spark, d):
    """Best evidence and hit rows of each (one-hop) lineage."""
    s = _sessions(spark, d)
    found = search.matched_messages(_messages(spark, d), s, tx.parse_query("compiler linker"), False)
    rows = found.join(s.select(F.col("file").alias("session_file"), F.col("parent_session").alias("lineage_root")), "session_file").withColumnRenamed("rank", "bm25")
    return search.best_evidence(rows).withColumn("best", F.round("best", 9))


@query(f"SELECT DISTINCT m.id AS message_id FROM {SEARCHABLE} m WHERE {_holds(['glacier', 'compiler'], 'OR')}")
def trigram_candidates(spark, d):
    """Messages that the posting table proposes for the terms, verified on the text."""
    m = _messages(spark, d)
    q = tx.parse_query("glacier compiler")
    proposed = search.candidates(search.trigram_postings(m), q)
    rows = search.searchable(m).join(proposed.select(F.col("message_id").alias("id")), "id", "left_semi")
    return rows.where(tx.holds_terms(F.col("search_text"), F.col("search_tool"), q, False)).select(F.col("id").alias("message_id"))


@query(f"SELECT id AS message_id, {_excerpt('flat', 'kernel')} AS snippet FROM (SELECT id, {_flat('text')} AS flat FROM fts_messages WHERE text <> '')")
def excerpt_marks(spark, d):
    """Excerpts of all messages around a word."""
    return _messages(spark, d).where("text <> ''").select(F.col("id").alias("message_id"), tx.excerpt(F.col("text"), "kernel").alias("snippet"))


@query(f"SELECT doc_id, md5({_MARK.format('text')}) AS marked FROM documents WHERE text IS NOT NULL")
def sanitize_markers(spark, d):
    """Texts with the excerpt's own marks replaced."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.normalize_markers(F.col("text"))).alias("marked"))


@query(r"SELECT id AS message_id, CAST(ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4 + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 1.5) AS BIGINT) AS tokens FROM fts_messages WHERE text IS NOT NULL")
def token_estimates(spark, d):
    """Tokens by rule of thumb."""
    return _messages(spark, d).where("text is not null").select(F.col("id").alias("message_id"), tx.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(f"SELECT id, file FROM {SESSIONS} WHERE contains(lower(coalesce(id, '')), 'harbor') OR contains(lower(coalesce(workspace, '')), 'harbor') OR contains(lower(coalesce(title, '')), 'harbor')")
def meta_search(spark, d):
    """Sessions whose metadata holds the whole query."""
    s = _sessions(spark, d).withColumns({"first_user_text": F.lit(""), "last_assistant_text": F.lit(""), "tool_names": F.array().cast("array<string>")})
    return listing.matching(s, "", "Harbor").select("id", "file")


_BYTIME = "ORDER BY last_time DESC NULLS LAST, id NULLS LAST, file NULLS LAST"


@query(f"SELECT id, file, last_time FROM {SESSIONS} {_BYTIME} LIMIT 25")
def list_keyset_page1(spark, d):
    """First page of the list in time order."""
    return listing.after_cursor(_sessions(spark, d), None).orderBy(*listing.newest_first()).limit(25).select("id", "file", "last_time")


@query(f"SELECT id, file, last_time FROM {SESSIONS} WHERE last_time < 1771000000000 OR (last_time = 1771000000000 AND id > 'session-5') {_BYTIME} LIMIT 25")
def list_keyset_page2(spark, d):
    """The page after a cursor."""
    return listing.after_cursor(_sessions(spark, d), "1771000000000|session-5").orderBy(*listing.newest_first()).limit(25).select("id", "file", "last_time")


@query()
def list_relevance(spark, d):
    """The best sessions for a query by the explainable score."""
    s = _sessions(spark, d).withColumn("first_user_text", F.lit(""))
    rows = listing.by_relevance(s.where(F.contains(F.lower("title"), F.lit("the"))), "the", NOW, "harbor", 50)
    return rows.select("id", "file", F.round("score", 9).alias("score"), "tier", F.round("fuzzy_term", 9).alias("fuzzy_term"), "workspace_term", F.round("recency_term", 9).alias("recency_term"))


@query()
def fuzzy_scores(spark, d):
    """Fuzzy match of every title."""
    s = _sessions(spark, d).select("file", "title", ranking.fuzzy_column(F.lit("search"), F.col("title")).alias("m"))
    return s.where("m.score is not null").select("file", F.round("m.score", 9).alias("score"), "m.start", "m.end")


@query(f"SELECT file, CASE WHEN lower(title) = 'the user' THEN 'exact' WHEN starts_with(lower(title), 'the user') THEN 'prefix' WHEN contains(lower(title), 'the user') THEN 'substring' ELSE 'none' END AS tier FROM {SESSIONS} WHERE title IS NOT NULL")
def hit_tiers(spark, d):
    """How each title holds a query, without the fuzzy level."""
    title = F.lower("title")
    return _sessions(spark, d).where("title is not null").select("file", ranking.tier("the user", title, F.lit(False)).alias("tier"))


@query(f"""SELECT file, round(8 * CASE WHEN last_time > 0 THEN pow(2.0, -floor(greatest(0, {NOW} - last_time) / 86400000.0) / 21) ELSE 0.3 END, 9) AS recency FROM {SESSIONS}""")
def recency_terms(spark, d):
    """The score's part for age, in whole days with a half-life of three weeks."""
    s = _sessions(spark, d).withColumns({"first_user_text": F.lit(""), "by_title": F.lit(None).cast("struct<score:double,start:int,end:int>"), "by_text": F.lit(None).cast("struct<score:double,start:int,end:int>")})
    return s.withColumns(ranking.score_columns("", NOW)).select("file", F.round("recency_term", 9).alias("recency"))


_PIVOTS = "(SELECT session_file, min(id) AS pivot_id FROM fts_messages GROUP BY 1)"
_PLACED = "(SELECT session_file, id, row_number() OVER (PARTITION BY session_file ORDER BY coalesce(event_seq, id), id) AS at FROM fts_messages)"


@query(f"SELECT r.session_file, p.pivot_id, CAST(r.at - c.at AS BIGINT) AS offset_, r.id AS message_id FROM {_PIVOTS} p JOIN {_PLACED} c ON c.session_file = p.session_file AND c.id = p.pivot_id JOIN {_PLACED} r ON r.session_file = p.session_file AND abs(r.at - c.at) <= 5")
def scroll_window(spark, d):
    """Five messages either side of one message in every session."""
    m = _messages(spark, d)
    pivots = m.groupBy("session_file").agg(F.min("id").alias("pivot_id"))
    return scroll.windows_around(m, pivots, 5).select("session_file", "pivot_id", F.col("offset").cast("long").alias("offset_"), F.col("id").alias("message_id"))


@query("""
SELECT session_file, side, k AS place, id AS message_id FROM (
  SELECT session_file, 'start' AS side, id, row_number() OVER (PARTITION BY session_file ORDER BY coalesce(event_seq, id), id) AS k FROM fts_messages
  UNION ALL SELECT session_file, 'end', id, row_number() OVER (PARTITION BY session_file ORDER BY coalesce(event_seq, id) DESC, id DESC) FROM fts_messages) WHERE k <= 3""")
def scroll_bookends(spark, d):
    """First and last three messages of every session."""
    return scroll.bookends_of_all(_messages(spark, d)).withColumnRenamed("id", "message_id")


@query("""
WITH RECURSIVE latest AS (SELECT id, nullif(parent_session, '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_session DESC NULLS LAST) AS k FROM fts_sessions WHERE id IS NOT NULL) WHERE k = 1),
walk AS (
  SELECT id AS start, id AS at, [id] AS chain, CAST(NULL AS VARCHAR) AS root FROM latest
  UNION ALL
  SELECT w.start, coalesce(l.p, w.at), CASE WHEN l.p IS NULL OR list_contains(w.chain, l.p) THEN w.chain ELSE list_append(w.chain, l.p) END,
    CASE WHEN l.id IS NULL OR l.p IS NULL THEN w.at WHEN list_contains(w.chain, l.p) THEN list_min(w.chain) END
  FROM walk w LEFT JOIN latest l ON l.id = w.at WHERE w.root IS NULL)
SELECT start AS session_id, root AS lineage FROM walk WHERE root IS NOT NULL""")
def lineage_roots(spark, d):
    """The transitive root of each session, the smallest id of the walk for cycles."""
    return lineage.lineage_roots(table(spark, d, "fts_sessions"))


@query("SELECT session_id, type, CAST(count(*) AS BIGINT) AS n FROM session_log GROUP BY 1, 2")
def session_counts(spark, d):
    """Events of each type in each session."""
    counts = metadata._counts(table(spark, d, "session_log").select("session_id", "type"), "type", "counts")  # noqa: SLF001
    return counts.select("session_id", F.explode("counts").alias("type", "n"))


_EVENTS = f"(SELECT * EXCLUDE (data, doc), doc AS data FROM ({PARSED}) WHERE seq IS NOT NULL AND doc IS NOT NULL AND json_type(doc) = 'OBJECT')"


@query(f"SELECT session_id, json_extract_string(data, '$.name') AS tool, CAST(count(*) AS BIGINT) AS n FROM {_EVENTS} WHERE type = 'tool/call' AND coalesce(json_extract_string(data, '$.name'), '') <> '' GROUP BY 1, 2")
def tool_call_counts(spark, d):
    """Calls of each tool in each session."""
    rows = metadata.event_columns(_plain_events(spark, d)).where("type = 'tool/call' and tool <> ''")
    return metadata._counts(rows, "tool", "m").select("session_id", F.explode("m").alias("tool", "n"))  # noqa: SLF001


def _plain_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the log whose data is a JSON object, or a JSON string that holds one."""
    parsed = F.try_parse_json("data")
    inner = F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(F.col("data"))
    rows = table(spark, d, "session_log").where("seq is not null").withColumn("data", inner)
    return rows.where(F.expr("schema_of_variant(try_parse_json(data)) like 'OBJECT%'"))


_TEXT = "regexp_replace(coalesce((SELECT string_agg(json_extract_string(e, '$.text'), ' ' ORDER BY i) FROM (SELECT unnest(a) AS e, unnest(range(len(a))) AS i) WHERE json_extract_string(e, '$.type') = 'text' AND json_extract_string(e, '$.text') IS NOT NULL), ''), '^" + WHITE + "+|" + WHITE + "+$', '', 'g')"
_SAID = f"""(SELECT session_id, type, seq, line_id, {_TEXT} AS said FROM (
  SELECT session_id, type, seq, line_id, CASE WHEN json_type(c) = 'ARRAY' THEN CAST(c AS JSON[]) ELSE [] END AS a FROM (
    SELECT *, CASE WHEN type = 'user/message' THEN json_extract(data, '$.content') ELSE json_extract(data, '$.message.content') END AS c FROM {_EVENTS} WHERE type IN ('user/message', 'assistant/message'))))"""


@query(f"""
SELECT e.session_id, max(e.time) AS last_time, md5(coalesce((SELECT min_by(said, (seq, said)) FROM {_SAID} s WHERE s.session_id = e.session_id AND type = 'user/message' AND said <> ''), '')[:500]) AS first_user_md5
FROM {_EVENTS} e GROUP BY e.session_id""")
def session_metadata(spark, d):
    """Latest time and first user text of each session."""
    m = metadata.session_metadata(_plain_events(spark, d))
    return m.select("session_id", "last_time", F.md5("first_user_text").alias("first_user_md5"))


_TITLED = f"(SELECT session_id, seq, regexp_replace(json_extract_string(data, '$.title'), '^{WHITE}+|{WHITE}+$', '', 'g') AS t FROM {_EVENTS} WHERE type = 'session/title')"
_PAIRS = "string_agg(k || ':' || n, ', ' ORDER BY {0})"


@query(f"""
WITH by_type AS (SELECT session_id, type AS k, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, type) AS place FROM {_EVENTS} GROUP BY 1, 2),
by_tool AS (SELECT session_id, json_extract_string(data, '$.name') AS k, count(*) AS n FROM {_EVENTS} WHERE type = 'tool/call' AND coalesce(json_extract_string(data, '$.name'), '') <> '' GROUP BY 1, 2),
facts AS (SELECT session_id, max(time) AS last_time FROM {_EVENTS} GROUP BY 1),
titles AS (SELECT session_id, max_by(t, (seq, t)) AS title FROM {_TITLED} WHERE t <> '' GROUP BY 1),
firsts AS (SELECT session_id, min_by(said, (seq, said)) AS said FROM {_SAID} WHERE type = 'user/message' AND said <> '' GROUP BY 1)
SELECT s.id, s.file, s.workspace, s.created_at, f.last_time, greatest(0, f.last_time - s.created_at) AS duration_ms, coalesce(t.title, substr(coalesce(u.said, ''), 1, 80)) AS title, s.agent_preset,
  (SELECT {_PAIRS.format('place')} FROM by_type c WHERE c.session_id = s.id AND place <= 12) AS counts, coalesce((SELECT {_PAIRS.format('k')} FROM by_tool c WHERE c.session_id = s.id), '') AS tool_calls
FROM {SESSIONS} s JOIN facts f ON f.session_id = s.id LEFT JOIN titles t ON t.session_id = s.id LEFT JOIN firsts u ON u.session_id = s.id""")
def session_summaries(spark, d):
    """Full metadata of each session, with its counts as text."""
    m = metadata.session_metadata(_plain_events(spark, d)).withColumnRenamed("session_id", "id")
    s = _sessions(spark, d).select("id", "file", "workspace", "created_at", "agent_preset")
    return listing.summarize(m.join(s, "id")).drop("first_user_text", "last_assistant_text")


@query(f"SELECT session_id, role, CAST(count(*) AS BIGINT) AS n FROM (SELECT session_id, 'user' AS role FROM {_SAID} WHERE type = 'user/message' AND said <> '' UNION ALL SELECT session_id, 'assistant' FROM {_SAID} WHERE type = 'assistant/message' AND said <> '' UNION ALL SELECT session_id, 'tool' FROM {_EVENTS} WHERE type = 'tool/call' AND coalesce(json_extract_string(data, '$.name'), '') <> '') GROUP BY 1, 2")
def message_rows(spark, d):
    """Visible messages and tool calls of each session by role."""
    return metadata.message_rows(_plain_events(spark, d)).groupBy("session_id", "role").agg(F.count("*").alias("n"))


@query()
def surface_fold(spark, d):
    """Logs rebuilt line by line and folded: one verdict for each, with what it shows."""
    log = dedup.deduplicate(table(spark, d, "session_log")).withColumn("data", F.regexp_replace("data", "[\\r\\n]+", " "))
    sessions, _ = fold.fold_logs(fold.log_lines_of(log))
    return sessions.select("file", "ok", "error_code", "generation", "indexed_messages", "indexed_text_bytes", "last_seq")


@query(f"SELECT id, file FROM {SESSIONS} WHERE last_time <= 0 OR last_time IS NULL OR last_time >= {NOW - 90 * 86400000}")
def retention_filter(spark, d):
    """Sessions within the retention time."""
    return listing.retained(_sessions(spark, d), NOW, 90).select("id", "file")


_OLD = "(SELECT file, created_at AS size, CAST(updated_at AS DOUBLE) AS mtime_ms FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY updated_at, id, created_at) AS k FROM fts_sessions WHERE file IS NOT NULL) WHERE k = 1)"


def _scan_like(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    new = _sessions(spark, d).select("file", F.col("created_at").alias("size"), F.col("updated_at").cast("double").alias("mtime_ms"), F.lit(1.0).alias("ctime_ms"))
    old = bookmarks.latest_rows(table(spark, d, "fts_sessions").where("file is not null"), ["file"], ["updated_at", "id", "created_at"])
    return new, old.select("file", F.col("created_at").alias("size"), F.col("updated_at").cast("double").alias("mtime_ms"), F.lit(1.0).alias("ctime_ms"))


@query(f"SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' WHEN a.created_at = b.size AND a.updated_at = b.mtime_ms THEN 'skipped' ELSE 'updated' END AS state FROM {SESSIONS} a FULL JOIN {_OLD} b ON a.file = b.file")
def change_detection(spark, d):
    """Files added, updated, skipped or removed between two states."""
    return store.changes(*_scan_like(spark, d))


@query("""SELECT DISTINCT s.file FROM fts_sessions s WHERE s.file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM session_log l WHERE l.file = s.file)
  AND NOT EXISTS (SELECT 1 FROM fts_messages m WHERE m.session_file = s.file)""")
def orphan_files(spark, d):
    """Sessions' files that neither the messages nor the log have."""
    known = _messages(spark, d).select(F.col("session_file").alias("file"))
    return store.orphans(table(spark, d, "fts_sessions").where("file is not null"), known, table(spark, d, "session_log").select("file").distinct())


_ON_DISK = "(SELECT file, CAST(count(*) AS BIGINT) AS size FROM session_log WHERE file IS NOT NULL GROUP BY 1)"


@query(f"SELECT s.file FROM {SESSIONS} s WHERE NOT EXISTS (SELECT 1 FROM {_ON_DISK} l WHERE l.file = s.file)")
def removed_logs(spark, d):
    """Indexed files that a complete scan no longer finds."""
    disk = table(spark, d, "session_log").where("file is not null").groupBy("file").agg(F.count("*").alias("size")).withColumns({"mtime_ms": F.lit(1.0), "ctime_ms": F.lit(1.0)})
    known = _sessions(spark, d).select("file", F.col("created_at").alias("size"), F.lit(1.0).alias("mtime_ms"), F.lit(1.0).alias("ctime_ms"))
    return store.removed_files(store.changes(disk, known), True)


@query(f"""
SELECT s.file FROM {SESSIONS} s LEFT JOIN (SELECT session_file AS file, count(*) AS n FROM fts_messages GROUP BY 1) m ON m.file = s.file
LEFT JOIN {_OLD} c ON c.file = s.file WHERE NOT coalesce(s.created_at IS NOT DISTINCT FROM c.size AND CAST(s.updated_at AS DOUBLE) IS NOT DISTINCT FROM c.mtime_ms AND coalesce(m.n, 0) = 2, false)""")
def stale_files(spark, d):
    """Files whose checkpoint doesn't fit the session or its number of messages any more."""
    new, old = _scan_like(spark, d)
    checks = old.withColumns({"parser_version": F.lit("1"), "message_count": F.lit(2).cast("long")})
    return store.stale(new, checks, _messages(spark, d), "1")


_MARKS = "(SELECT CAST(m.id AS VARCHAR) AS id, s.id AS session_id, m.id AS message_id FROM fts_messages m JOIN (SELECT file, min(id) AS id FROM fts_sessions WHERE id IS NOT NULL GROUP BY file) s ON s.file = m.session_file)"


@query(f"""
WITH files AS (SELECT id AS session_id, count(DISTINCT file) AS files, min(file) AS file FROM fts_sessions WHERE id IS NOT NULL GROUP BY 1)
SELECT b.id, CASE WHEN f.files IS NULL THEN 'session-missing' WHEN f.files > 1 THEN 'ambiguous' WHEN m.anchor_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM {_MARKS} b LEFT JOIN files f ON f.session_id = b.session_id LEFT JOIN fts_messages m ON m.session_file = f.file AND m.id = b.message_id""")
def bookmark_resolutions(spark, d):
    """What becomes of a bookmark of every message by session id and row alone."""
    s = table(spark, d, "fts_sessions").where("id is not null")
    first = s.groupBy("file").agg(F.min("id").alias("sessionId"))
    marks = _messages(spark, d).join(first.withColumnRenamed("file", "session_file"), "session_file").select(F.col("id").cast("string").alias("id"), "sessionId", F.col("id").alias("messageId"))
    return bookmarks.resolutions(marks, s, _messages(spark, d)).select("id", "status")


@query(f"""
SELECT b.id, NOT EXISTS (SELECT 1 FROM fts_sessions s WHERE s.id = b.session_id) AS stale, m.anchor_id IS NOT NULL AS anchor_available
FROM {_MARKS} b JOIN fts_messages m ON m.id = b.message_id WHERE contains(lower(coalesce(m.text, '')), 'step') ORDER BY m.event_seq DESC NULLS LAST, b.id LIMIT 200""")
def bookmark_list(spark, d):
    """The last 200 bookmarks whose note holds a word, with whether session and anchor are there."""
    s = table(spark, d, "fts_sessions").where("id is not null")
    first = s.groupBy("file").agg(F.min("id").alias("sessionId"))
    m = _messages(spark, d).join(first.withColumnRenamed("file", "session_file"), "session_file")
    marks = m.select(F.col("id").cast("string").alias("id"), "sessionId", F.col("session_file").alias("sessionFile"), F.col("anchor_id").alias("anchorId"), F.lit("").alias("label"), F.col("text").alias("note"), F.lit("").alias("title"), F.col("event_seq").alias("updatedAt"), F.lit(0).alias("line_no"))
    found = bookmarks.listed(marks, s, _messages(spark, d), "STEP", 200)
    return found.select("id", "stale", F.col("anchorAvailable").alias("anchor_available"))


@query(f"""
WITH hit AS (SELECT m.*, e.rank FROM ({_matched(['compiler', 'linker'], 'OR')}) m JOIN ({_evidence(['compiler', 'linker'])}) e ON e.message_id = m.id),
best AS (SELECT *, count(*) OVER (PARTITION BY session_file) AS match_count, row_number() OVER (PARTITION BY session_file ORDER BY round(rank, 9), event_seq NULLS FIRST, id) AS k FROM hit)
SELECT session_id, session_file, round(rank, 6) AS rank, CAST(match_count AS BIGINT) AS match_count FROM best WHERE k = 1""")
def search_ranked(spark, d):
    """The best hit's evidence of each session, by any term."""
    hits, _ = search.search_page(_messages(spark, d), _sessions(spark, d), "compiler linker", None, "or")
    return hits.select("session_id", "session_file", F.round("rank", 6).alias("rank"), "match_count")


@query(f"""
WITH hit AS (SELECT m.*, e.rank FROM ({_matched(['glacier', 'step'], 'AND')}) m JOIN ({_evidence(['glacier', 'step'])}) e ON e.message_id = m.id)
SELECT CAST(count(DISTINCT session_file) AS BIGINT) AS total FROM hit""")
def search_total(spark, d):
    """The exact number of sessions of a search, through the posting table."""
    m = _messages(spark, d)
    pieces = search.chunks(search.searchable(m))
    _, total = search.search_page(m, _sessions(spark, d), "glacier step", 5, "and", postings=search.trigram_postings(m), statistics=search.chunk_statistics(pieces))
    return spark.createDataFrame([(total,)], "total bigint")


@query("SELECT file FROM fts_sessions UNION SELECT session_file FROM fts_messages UNION SELECT file FROM session_log")
def file_union_distinct(spark, d):
    """All files that any table knows."""
    return store.indexed_files(table(spark, d, "fts_sessions"), _messages(spark, d).select(F.col("session_file").alias("file")), table(spark, d, "session_log"))


@query("SELECT id, file, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, file DESC) AS k FROM fts_sessions) WHERE k = 1")
def dedupe_latest(spark, d):
    """The latest row of each id."""
    rows = bookmarks.latest_rows(table(spark, d, "fts_sessions"), ["id"], [F.col("updated_at").desc(), F.col("file").desc()])
    return rows.select("id", "file", "updated_at")


@query("SELECT session_id, max(seq) AS last_seq, CAST(count(DISTINCT seq) AS BIGINT) AS numbers, count(DISTINCT seq) = max(seq) + 1 AS dense FROM session_log WHERE seq IS NOT NULL GROUP BY 1")
def dense_sequences(spark, d):
    """Whether each session's numbers run from 0 without a gap."""
    rows = table(spark, d, "session_log").where("seq is not null").select("session_id", "seq").distinct()
    out = rows.groupBy("session_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("numbers"))
    return out.withColumn("dense", F.col("numbers") == F.col("last_seq") + 1)


@query("SELECT sha1(session_file || chr(0) || 'anchor:' || anchor_id) AS bookmark_id, id AS message_id FROM fts_messages WHERE anchor_id IS NOT NULL")
def bookmark_ids(spark, d):
    """Deterministic bookmark ids of anchors."""
    m = _messages(spark, d).where("anchor_id is not null")
    return m.select(F.sha1(F.concat(F.col("session_file"), F.lit("\0"), F.lit("anchor:"), F.col("anchor_id"))).alias("bookmark_id"), F.col("id").alias("message_id"))


@query("SELECT (SELECT CAST(count(*) AS BIGINT) FROM fts_messages) AS messages, (SELECT CAST(count(DISTINCT session_file) AS BIGINT) FROM fts_messages) AS indexed_files, (SELECT CAST(count(DISTINCT id) AS BIGINT) FROM fts_sessions) AS sessions")
def status_counts(spark, d):
    """Size of the index."""
    m = _messages(spark, d).agg(F.count("*").alias("messages"), F.countDistinct("session_file").alias("indexed_files"))
    s = table(spark, d, "fts_sessions").agg(F.countDistinct("id").alias("sessions"))
    return m.join(s)  # one row each


@query(f"""
WITH hit AS ({_matched(['season'], 'AND')}), counted AS (SELECT session_id, session_file, count(*) AS match_count FROM hit GROUP BY ALL),
rooted AS (SELECT c.*, coalesce(r.lineage, c.session_id) AS lineage FROM counted c LEFT JOIN ({SQL['lineage_roots']}) r ON r.session_id = c.session_id)
SELECT lineage, CAST(sum(least(match_count, 3)) AS BIGINT) AS hit_rows, CAST(count(*) AS BIGINT) AS sessions FROM rooted GROUP BY 1""")
def lineage_hit_groups(spark, d):
    """Hits and sessions of each transitive lineage, at most three hits a session."""
    hits, _ = search.search_page(_messages(spark, d), _sessions(spark, d), "season", None)
    rows = hits.select("session_id", "session_file", "message_id", "snippet", "rank", "match_count", F.coalesce("event_seq", F.lit(0)).alias("arrival"))
    return search.lineage_groups(rows, lineage.lineage_roots(table(spark, d, "fts_sessions")), 3).select("lineage", "hit_rows", "sessions")


@query(f"""SELECT file, CASE WHEN id = 'harbor' OR file = 'harbor' THEN 0 ELSE 1 END AS tier FROM {SESSIONS} WHERE contains(lower(file), '3') OR contains(lower(id), '3') {_BYTIME} LIMIT 1""")
def find_session(spark, d):
    """The newest session whose id or file holds a part."""
    return listing.find_session(_sessions(spark, d), "3").select("file", F.lit(1).alias("tier"))

"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import conversations, mixing, packing, splitting, subjects
from strandline.plans.data_queries import COPIES, PARSED
from strandline.plans.search_queries import WHITE
from strandline.runtime import table

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that make no sound conversation, with the reason."""
    return conversations.session_verdicts(table(spark, sf_dir, "session_log")).where("reason is not null").select("session_id", "reason")


_SAID = "CASE json_type(c) WHEN 'VARCHAR' THEN json_extract_string(c, '$') WHEN 'OBJECT' THEN CASE WHEN json_extract_string(c, '$.type') = 'text' THEN json_extract_string(c, '$.text') END WHEN 'ARRAY' THEN (SELECT string_agg(CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') WHEN json_extract_string(e, '$.type') = 'text' THEN json_extract_string(e, '$.text') END, ' ') FROM (SELECT unnest(a) AS e)) END"
#: Rows of human messages ('h') and replies ('r') that parse and aren't copies, and whether they say anything.
SPOKEN = f"""
SELECT session_id, seq, mid, role, text, regexp_replace(coalesce(text, ''), '{WHITE}+', '', 'g') <> '' AS said FROM (SELECT *, {_SAID} AS text FROM (SELECT *, CASE WHEN json_type(c) = 'ARRAY' THEN CAST(c AS JSON[]) ELSE [] END AS a FROM (
  SELECT *, CASE WHEN role = 'h' THEN json_extract(doc, '$.content') WHEN role = 'r' THEN json_extract(doc, '$.message.content') END AS c FROM (
    SELECT *, CASE WHEN type = 'user/message' AND json_extract_string(doc, '$.source.kind') = 'user' THEN 'h' WHEN type = 'assistant/message' THEN 'r' END AS role FROM ({COPIES}) WHERE copy = 1))))"""
REASONS = f"""
WITH good AS (SELECT * FROM ({SPOKEN})),
facts AS (SELECT session_id, max(seq) AS largest, count(DISTINCT CASE WHEN ok THEN seq END) AS numbers FROM (SELECT session_id, seq, true AS ok FROM good UNION ALL SELECT session_id, seq, false FROM ({PARSED}) WHERE doc IS NULL) GROUP BY 1),
voiced AS (SELECT session_id, bool_or(role IS NOT NULL AND said) AS said FROM good GROUP BY 1),
clash AS (SELECT DISTINCT session_id FROM good WHERE mid IS NOT NULL AND seq IS NOT NULL GROUP BY session_id, seq HAVING count(DISTINCT mid) > 1),
signs AS (SELECT session_id, role, lead(role) OVER (PARTITION BY session_id ORDER BY seq, role) AS after FROM good WHERE seq IS NOT NULL AND (role = 'h' OR role = 'r' AND said)),
stuck AS (SELECT DISTINCT session_id FROM signs WHERE role = 'h' AND coalesce(after, 'h') = 'h')
SELECT * FROM (
  SELECT f.session_id, CASE WHEN NOT coalesce(v.said, false) THEN 'empty' WHEN f.numbers < f.largest + 1 OR c.session_id IS NOT NULL THEN 'broken' WHEN s.session_id IS NOT NULL THEN 'unanswered' END AS reason
  FROM facts f LEFT JOIN voiced v USING (session_id) LEFT JOIN clash c USING (session_id) LEFT JOIN stuck s USING (session_id))"""
SQL["p3_found"] = REASONS + " WHERE reason IS NOT NULL"
SQL["p3_conversations"] = f"""SELECT session_id, seq, CASE role WHEN 'h' THEN 'user' ELSE 'assistant' END AS role, text FROM ({SPOKEN})
  WHERE said AND role IS NOT NULL AND seq >= 0 AND session_id IN (SELECT session_id FROM ({REASONS}) WHERE reason IS NULL)"""


@query
def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every sound conversation in order."""
    return conversations.conversations(table(spark, sf_dir, "session_log"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that had to be split, and whether a hard cut was needed."""
    return splitting.oversized(table(spark, sf_dir, "fts_messages"))


#: UTF-16 length of a text: characters beyond the basic plane count twice.
UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
_longest = "list_max(list_transform(regexp_split_to_array(text, '[ \\t\\n.!?;。！？；]'), lambda x: " + UNITS.format("x") + "))"
SQL["p4_found"] = f"SELECT id, CAST(CASE WHEN {_longest} > 4096 THEN 1 ELSE 0 END AS BIGINT) AS hard FROM fts_messages WHERE {UNITS.format('text')} > 4096"


@query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as pieces within the limit."""
    return splitting.split_oversized(table(spark, sf_dir, "fts_messages"))


@query
def p4_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages put together again from their pieces, whether all are within the limit and share what they should."""
    cut = splitting.split_oversized(table(spark, sf_dir, "fts_messages"))
    own = F.col("own_start") - F.col("start")
    shared = splitting.utf16_units(F.expr("substring(text, 1, int(own_start - start))"))
    right = (splitting.utf16_units(F.col("text")) <= splitting.LIMIT) & F.when(F.col("piece") == 0, own == 0).otherwise(shared.between(splitting.OVERLAP, splitting.OVERLAP + 1) | (F.col("start") == 0))
    whole = cut.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", F.expr("substring(text, int(own_start - start) + 1)").alias("own")))).alias("parts"), F.count("*").alias("pieces"), F.bool_and(right).alias("sound"))
    return whole.select("id", F.md5(F.array_join(F.col("parts.own"), "")).alias("text_md5"), (F.col("pieces") > 1).alias("cut"), "sound")


SQL["p4_reassembled"] = f"SELECT id, md5(text) AS text_md5, {UNITS.format('text')} > 4096 AS cut, true AS sound FROM fts_messages WHERE text <> ''"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "model_windows").select(F.col("context_window").alias("capacity"))


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in containers of each model's context window."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), _windows(spark, sf_dir))


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each size are."""
    return packing.fill_report(p7_packed(spark, sf_dir))


@query
def p7_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window: documents placed, containers over it, documents divided though they fit, documents with parts missing or twice."""
    packed = p7_packed(spark, sf_dir)
    docs = packed.groupBy("capacity", "id").agg(F.count("*").alias("parts"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.max("token_end").alias("last"), F.count_distinct("token_start").alias("starts"))
    wrong = (F.col("tokens") != F.col("last")) | (F.col("starts") != F.col("parts"))
    by_doc = docs.groupBy("capacity").agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("last") <= F.col("capacity"))).alias("divided"), F.count_if(wrong).alias("incomplete"))
    filled = packed.groupBy("capacity", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    over = filled.groupBy("capacity").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    return by_doc.join(over, "capacity").select("capacity", "documents", "divided", "incomplete", "overfull")


SQL["p7_sums"] = """SELECT CAST(w.capacity AS BIGINT) AS capacity, CAST(d.n AS BIGINT) AS documents, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS overfull
  FROM (SELECT DISTINCT context_window AS capacity FROM model_windows WHERE context_window > 0) w, (SELECT count(*) AS n FROM documents WHERE text <> '') d"""


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is used for which source."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each mix."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@query
def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mix: targets reported, uses beyond the most repeats, uses of a text that its source doesn't have."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    chosen, report = mixing.mix_sources(docs, targets)
    keyed = targets.select("mix", mixing.source_key(F.col("source")).alias("source"), "max_repeats")
    digest = F.sha2("text", 256)
    texts = docs.where("text <> ''").select(mixing.source_key(F.col("source")).alias("source"), digest.alias("digest")).distinct().withColumn("own", F.lit(True))
    used = chosen.join(docs.select("doc_id", digest.alias("digest")), "doc_id").join(keyed, ["mix", "source"], "left").join(texts, ["source", "digest"], "left")
    found = used.groupBy("mix").agg(F.count_if(F.col("copies") > F.coalesce("max_repeats", F.lit(0))).alias("over_repeats"), F.count_if(F.col("own").isNull()).alias("foreign_texts"))
    return report.groupBy("mix").agg(F.count("*").alias("targets")).join(found, "mix", "left").select("mix", "targets", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("over_repeats", "foreign_texts")))


SQL["p8_sound"] = "SELECT mix, CAST(count(*) AS BIGINT) AS targets, CAST(0 AS BIGINT) AS over_repeats, CAST(0 AS BIGINT) AS foreign_texts FROM mix_targets GROUP BY mix"


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document."""
    return subjects.assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects"), labels=table(spark, sf_dir, "doc_labels"))


@query
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and subject."""
    return subjects.composition(table(spark, sf_dir, "documents"), p9_found(spark, sf_dir), mixing.source_key)

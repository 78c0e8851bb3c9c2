"""Queries of the general data-processing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import dedup, hierarchy, nested, schema_drift
from strandline.plans.search_queries import PARSED
from strandline.runtime import table

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of content, inserted, messages and messageSeqs with its path and kind."""
    flat = nested.flatten_elements(table(spark, sf_dir, "session_log"), "line_id", "data", values=False)
    return flat.withColumnRenamed("record_id", "line_id")


@query
def p2_linked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same elements as rows of one linked table, with their parent element and JSON text."""
    flat = nested.flatten_elements(table(spark, sf_dir, "session_log"), "line_id", "data")
    lead = F.substring("value", 1, 1)
    return flat.withColumn("value_type", F.when(lead == "{", "object").when(lead == "[", "array").when(lead == '"', "string").when(lead.isin("t", "f"), "boolean").otherwise("number")).drop("value")


@query
def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of content blocks with their typed members."""
    return nested.nested_tables(table(spark, sf_dir, "session_log"), "line_id", "data")["content"].drop("value")


@query
def p2_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of inserted messages."""
    return nested.nested_tables(table(spark, sf_dir, "session_log"), "line_id", "data")["inserted"].drop("value")


@query
def p2_message_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the messages' numbers that titles name."""
    return nested.nested_tables(table(spark, sf_dir, "session_log"), "line_id", "data")["messageSeqs"].drop("value")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus copies in the session log."""
    return dedup.surplus_rows(table(spark, sf_dir, "session_log"))


COPIES = f"""
SELECT *, row_number() OVER (PARTITION BY session_id, mid, CASE WHEN mid IS NULL THEN coalesce(type, '?') END,
    CASE WHEN mid IS NULL THEN coalesce(seq, -1) END ORDER BY received_at, line_id) AS copy
FROM (
  SELECT *, nullif(lower(trim(CASE
      WHEN type = 'user/message' THEN json_extract_string(doc, '$.id')
      WHEN type IN ('assistant/message', 'system/message', 'tool/result') THEN json_extract_string(doc, '$.message.id')
    END)), '') AS mid
  FROM ({PARSED})
) WHERE doc IS NOT NULL"""

SQL["p6_found"] = f"SELECT line_id FROM ({COPIES}) WHERE copy > 1"


_KIND = """CASE {field}
  WHEN 'content' THEN CASE {e}.type WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN coalesce(json_extract_string({e}.value, '$.type'), '') ELSE '' END
  WHEN 'messageSeqs' THEN CASE WHEN {e}.type IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE') THEN CAST({e}.value AS VARCHAR) ELSE '' END
  ELSE CASE {e}.type WHEN 'OBJECT' THEN coalesce(json_extract_string({e}.value, '$.role'), '') ELSE '' END END"""
#: A field's single value stands at position 0; twice, as neighbouring fields share their dot.
_SOLE = r"regexp_replace({0}, '(^|\.)(content|inserted|messages|messageSeqs)(\.|$)', '\1\2[0]\3', 'g')"
_PLACED = _SOLE.format(_SOLE.format("substr({0}.fullkey, 3)"))
ELEMENTS = f"""
WITH t AS (SELECT line_id, j.* FROM ({PARSED}) p, json_tree(p.doc) j WHERE p.doc IS NOT NULL)
SELECT e.line_id, {_PLACED.format('e')} AS path, {_KIND.format(field="a.key", e="e")} AS kind, a.key AS field, CAST(e.value AS VARCHAR) AS value
FROM t e JOIN t a ON a.line_id = e.line_id AND a.id = e.parent
WHERE a.type = 'ARRAY' AND a.key IN ('content', 'inserted', 'messages', 'messageSeqs') AND e.type <> 'NULL'
UNION ALL
SELECT line_id, {_PLACED.format('t')}, {_KIND.format(field="key", e="t")}, key, CAST(value AS VARCHAR) FROM t WHERE key IN ('content', 'inserted', 'messages', 'messageSeqs') AND type NOT IN ('ARRAY', 'NULL')"""
SQL["p2_found"] = f"SELECT line_id, path, kind FROM ({ELEMENTS})"
_ABOVE = r"nullif(regexp_extract(regexp_replace(path, '[^.]*$', ''), '^(.*\.)?(content|inserted|messages|messageSeqs)\[\d+\]'), '')"
LINKED = rf"SELECT line_id AS record_id, path, field, CAST(regexp_extract(path, '\[(\d+)\]$', 1) AS BIGINT) AS position, {_ABOVE} AS parent_path, kind, value FROM ({ELEMENTS})"
SQL["p2_linked_elements"] = f"""SELECT * EXCLUDE value, CASE json_type(value) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS value_type FROM ({LINKED})"""
_ROW = r"record_id, path, parent_path, nullif(regexp_extract(parent_path, '([^.\[\]]+)\[\d+\]$', 1), '') AS parent_field, position, kind"


def _member(path: str, kind: str = "VARCHAR") -> str:
    return f"CASE WHEN json_type(value, '{path}') = '{kind}' THEN CAST(json_extract_string(value, '{path}') AS {kind}) END"


SQL["p2_blocks"] = f"""SELECT {_ROW}, CASE json_type(value) WHEN 'VARCHAR' THEN json_extract_string(value, '$') ELSE {_member('$.text')} END AS text, {_member('$.toolCallId')} AS call_id, {_member('$.id')} AS id, {_member('$.name')} AS name,
  {_member('$.arguments')} AS arguments, {_member('$.isError', 'BOOLEAN')} AS is_error, {_member('$.mediaType')} AS media_type, {_member('$.ref')} AS ref, {_member('$.path')} AS file FROM ({LINKED}) WHERE field = 'content'"""
SQL["p2_inserted"] = f"SELECT {_ROW}, {_member('$.id')} AS id, {_member('$.source.kind')} AS source_kind FROM ({LINKED}) WHERE field = 'inserted'"
SQL["p2_message_seqs"] = f"SELECT {_ROW}, TRY_CAST(json_extract_string(value, '$') AS BIGINT) AS seq FROM ({LINKED}) WHERE field = 'messageSeqs'"


@query
def p6_seen_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint ranges of the numbers each producer has delivered."""
    return dedup.seen_ranges(table(spark, sf_dir, "session_log"))


SQL["p6_seen_ranges"] = f"""
SELECT session_id, type, min(seq) AS lo, max(seq) AS hi, max(seq) - min(seq) + 1 AS n FROM (
  SELECT *, seq - row_number() OVER (PARTITION BY session_id, type ORDER BY seq) AS island
  FROM (SELECT DISTINCT session_id, type, seq FROM ({COPIES}) WHERE mid IS NULL AND seq IS NOT NULL))
GROUP BY session_id, type, island"""


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each session."""
    return hierarchy.build_hierarchy(table(spark, sf_dir, "fts_sessions")).select("session_id", "root_id", "depth")


@query
def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, parent and number of descendants of each session."""
    whole = hierarchy.add_paths(hierarchy.build_hierarchy(table(spark, sf_dir, "fts_sessions")))
    return whole.select("session_id", "root_id", "depth", "parent_id", "path", F.coalesce("descendants", F.lit(-1).cast("long")).alias("descendants"))


@query
def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each session."""
    return hierarchy.all_descendants(hierarchy.build_hierarchy(table(spark, sf_dir, "fts_sessions")))


#: Latest row of each session, its resolved parent, and the walk down from the roots.
WALK = """
WITH RECURSIVE latest AS (
  SELECT id, nullif(lower(trim(parent_session)), '') AS parent FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, lower(trim(parent_session)) DESC NULLS LAST) AS k FROM fts_sessions WHERE id IS NOT NULL)
  WHERE k = 1),
edge AS (SELECT a.id, b.id AS parent_id FROM latest a LEFT JOIN (SELECT lower(trim(id)) AS name, min(id) AS id FROM latest GROUP BY 1) b ON a.parent = b.name),
walk AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM edge WHERE parent_id IS NULL
  UNION ALL
  SELECT e.id, w.root_id, w.depth + 1, w.path || '/' || e.id FROM walk w JOIN edge e ON e.parent_id = w.id)"""

SQL["p1_hierarchy"] = WALK + """ SELECT e.id AS session_id, coalesce(w.root_id, '') AS root_id, coalesce(w.depth, -1) AS depth, e.parent_id, w.path,
  CASE WHEN w.id IS NOT NULL THEN (SELECT CAST(count(*) AS BIGINT) FROM walk x WHERE x.path LIKE w.path || '/%') ELSE -1 END AS descendants FROM edge e LEFT JOIN walk w ON e.id = w.id"""
SQL["p1_descendants"] = WALK + """, up AS (
  SELECT w.id AS descendant_id, e.parent_id AS session_id, CAST(1 AS BIGINT) AS distance FROM walk w JOIN edge e ON e.id = w.id WHERE e.parent_id IS NOT NULL
  UNION ALL SELECT u.descendant_id, e.parent_id, u.distance + 1 FROM up u JOIN edge e ON e.id = u.session_id WHERE e.parent_id IS NOT NULL)
SELECT session_id, descendant_id, distance FROM up"""
SQL["p1_found"] = WALK + " SELECT e.id AS session_id, coalesce(w.root_id, '') AS root_id, coalesce(w.depth, -1) AS depth FROM edge e LEFT JOIN walk w ON e.id = w.id"


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a record type's fields between a writer's consecutive files."""
    return schema_drift.schema_changes(table(spark, sf_dir, "log_lines")).select("file", "record_type", "change", "old_path", "new_path")


SQL["p5_found"] = r"""
WITH leaf AS (
  SELECT DISTINCT writer, file_no, file, json_extract_string(line, '$.type') AS record_type, regexp_replace(substr(j.fullkey, 3), '\[\d+\]', '[]', 'g') AS path,
    CASE j.type WHEN 'VARCHAR' THEN 's' WHEN 'BOOLEAN' THEN 'b' WHEN 'DOUBLE' THEN 'd' ELSE 'i' END AS t
  FROM (SELECT * FROM log_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT') l, json_tree(l.line) j
  WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND json_type(line, '$.type') = 'VARCHAR'),
schema_ AS (SELECT writer, file_no, file, record_type, path, string_agg(t, '' ORDER BY t) AS types FROM leaf GROUP BY ALL),
pair AS (SELECT *, lag(file) OVER (PARTITION BY writer, record_type ORDER BY file_no, file) AS old_file FROM (SELECT DISTINCT writer, file_no, file, record_type FROM schema_)),
side AS (
  SELECT p.writer, p.file, p.record_type, s.path, s.types AS new_types, NULL AS old_types FROM pair p JOIN schema_ s ON s.writer = p.writer AND s.file = p.file AND s.record_type = p.record_type WHERE old_file IS NOT NULL
  UNION ALL SELECT p.writer, p.file, p.record_type, s.path, NULL, s.types FROM pair p JOIN schema_ s ON s.writer = p.writer AND s.file = p.old_file AND s.record_type = p.record_type),
both_ AS (SELECT writer, file, record_type, path, max(new_types) AS new_types, max(old_types) AS old_types, CASE WHEN path LIKE '%.%' THEN regexp_replace(path, '\.[^.]*$', '') ELSE '' END AS parent FROM side GROUP BY ALL),
grp AS (SELECT writer, file, record_type, parent, count(*) FILTER (new_types IS NULL) AS lost, count(*) FILTER (old_types IS NULL) AS won,
    max(CASE WHEN new_types IS NULL THEN path END) AS lost_path, max(CASE WHEN old_types IS NULL THEN path END) AS won_path, max(CASE WHEN new_types IS NULL THEN old_types END) AS lost_types, max(CASE WHEN old_types IS NULL THEN new_types END) AS won_types
  FROM both_ GROUP BY ALL),
ren AS (SELECT * FROM grp WHERE lost = 1 AND won = 1 AND lost_types = won_types)
SELECT file, record_type, 'retyped' AS change, path AS old_path, path AS new_path FROM both_ WHERE new_types <> old_types
UNION ALL SELECT file, record_type, 'renamed', lost_path, won_path FROM ren
UNION ALL SELECT b.file, b.record_type, CASE WHEN new_types IS NULL THEN 'removed' ELSE 'added' END, CASE WHEN new_types IS NULL THEN path ELSE '' END, CASE WHEN new_types IS NULL THEN '' ELSE path END
  FROM both_ b WHERE (new_types IS NULL OR old_types IS NULL) AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.writer = b.writer AND r.file = b.file AND r.record_type = b.record_type AND r.parent = b.parent)"""


@query
def p5_edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-cost edit scripts, with moves and ambiguous renames as the trees' distance has them."""
    return schema_drift.edit_scripts(table(spark, sf_dir, "log_lines"))


@query
def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all writers as one table of typed columns under consistent field names."""
    whole = schema_drift.unified_table(table(spark, sf_dir, "log_lines"), typed=True)
    return whole.select("writer", "file_no", "file", "line_no", "record_type", "record", "fields")

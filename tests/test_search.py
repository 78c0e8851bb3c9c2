import math

import pytest
from pyspark.sql import functions as F

from strandline.api import Engine
from strandline.functions import ranking
from strandline.functions import text as tx
from strandline.operators import listing, scroll, search

MESSAGES = "id bigint, session_file string, role string, text string, tool_name string, anchor_id string, event_seq bigint"
SESSIONS = "file string, id string, workspace string, title string, first_user_text string, created_at bigint, last_time bigint, updated_at bigint, parent_session string"


@pytest.mark.parametrize(
    ("query", "text", "score", "span"),
    [("ab", "xab", 0.995, (1, 2)), ("ab", "xayb", -0.015, (1, 3)), ("ab", "xayyb", -0.025, (1, 4)), ("te", "tez", 1.895, (0, 1)), ("te", "zte", 0.995, (1, 2)), ("fz", "a/fz", 1.89, (2, 3)), ("fz", "a-fz", 1.79, (2, 3)), ("fz", "a.fz", 1.59, (2, 3)), ("fz", "azfz", 0.99, (2, 3)), ("ba", "fooBar", 1.68, (3, 4)), ("ba", "foobar", 0.98, (3, 4)), ("te", "TE", math.inf, (0, 1)), ("@#", "@ #", -0.01, (0, 2)), ("好嘛", "好 嘛", -0.01, (0, 2)), ("abc", "a_b_c", 2.48, (0, 4))],
)
def test_fuzzy_match(query, text, score, span):
    got = ranking.fuzzy_match(query, text)
    assert got[0] == pytest.approx(score, abs=1e-9) and got[1:] == span


def test_no_fuzzy_match():
    for q, t in [("xy", "yx"), ("", "abc"), ("abcd", "abc"), ("a", "b" * 2000 + "a"), (None, None)]:
        assert ranking.fuzzy_match(q, t) is None


def test_query_cleaning():
    for raw, clean in [('"反', "反"), ("nginx AND", "nginx"), ("OR nginx", "nginx"), ("a-b c", '"a-b" c'), ("foo:bar", "foo bar"), (None, "")]:
        assert tx.clean_query(raw) == clean
    assert tx.parse_query("AND OR NOT").terms == ("OR",)
    for raw, scan in [("优化", True), ("优化 方案", True), ("调研方案", False), ("ran", False), ("ab", True), ("", False), ('"优化"', True), ("nginx AND", False)]:
        assert tx.uses_scan(raw) == scan
    assert not tx.parse_query("x" * 129).indexed and tx.parse_query("x" * 128).indexed


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(tx.excerpt(F.lit("我们使用反向代理解决跨域问题"), "反向代理")) == "我们使用>>>反向代理<<<解决跨域问题"
    assert ">>>" not in one(tx.excerpt(F.lit("nothing here"), "absent"))
    assert one(tx.excerpt(F.lit("x" * 100 + "  KEY\n\n" + "y" * 200), "key")).startswith("… " + "x" * 47 + " >>>KEY<<< yyy")
    assert one(tx.normalize_markers(F.lit("a >>> b <<< c"))) == "a » b « c"
    assert one(tx.collapse(F.lit("　a  b\n"))) == "a b"
    assert one(tx.estimate_tokens(F.lit("abcd好好好"))) == 3
    assert one(tx.chunk_starts(F.lit("x" * 9000))) == [0, 3968, 7936] and one(tx.chunk_starts(F.lit(""))) == [0]
    assert one(tx.first_present(F.lit("b a"), F.lit(""), ("zz", "a", "b"))) == "a"
    assert one(tx.earliest_present(F.lit("b a"), ("zz", "a", "b"))) == "b"


@pytest.fixture(scope="module")
def corpus(spark):
    long = "head alpha " + "filler " * 900 + " middle beta " + "filler " * 900 + "tail gamma 😀end"
    rows = [(1, "f1", "user", long, "", "a1", 0), (2, "f1", "assistant", "alpha absent", "", "a2", 1), (3, "f2", "user", "100% sure_thing \\ slash", "", "a3", 0), (4, "f2", "tool", "", "apply_patch", "a4", 1), (5, "f3", "user", None, None, None, None)]
    rows += [(10 + i, "f4", "user", f"repeat needle {i}", "", f"r{i}", i) for i in range(40)]
    sessions = [("f1", "s1", "/Work/A", "alpha title", "hello", 1, 100, 1, None), ("f2", "s2", "/work/b", "Beta", "alpha first", 1, 200, 1, "s1"), ("f3", "s3", "", "", "", 1, 0, 1, "gone"), ("f4", "s4", None, None, None, 1, 300, 1, ""), ("f4", "s4", "old", "old", "", 1, 1, 0, "")]
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(sessions, SESSIONS)


def ids(df):
    return sorted(r.message_id for r in df.collect())


def test_search_semantics(corpus):
    m, s = corpus[0], search.latest_sessions(corpus[1])
    run = lambda q, **k: ids(search.search_messages(m, s, q, 100, **k))
    assert run("head gamma") == [1] and run("😀end") == [1] and run("ALPHA beta") == [1]
    assert run("alpha zzz", mode="and") == [] and run("alpha zzz") == [1, 2]
    assert run("100%") == [3] and run("e_t") == [3] and run("\\") == [3] and run("%_") == []
    assert run("patch", filter=search.Filter(role="tool")) == [4] and run("alpha", filter=search.Filter(role="assistant")) == [2]
    assert run("needle", filter=search.Filter(since_ms=300, until_ms=300)) == list(range(10, 50)) and run("needle", filter=search.Filter(until_ms=299)) == []
    assert run("alpha", workspace="work/a") == [1, 2] and run("") == []
    page, total = search.search_page(m, s, "repeat needle alpha", 1, mode="or")
    hit = page.collect()
    assert total == 2 and len(hit) == 1
    counts = {r.session_file: r.match_count for r in search.search_page(m, s, "repeat alpha", 9, mode="or")[0].collect()}
    assert counts == {"f1": 2, "f4": 40}
    assert run("beta middle" + " filler" * 30) == [1]


def test_postings_propose_every_match(corpus):
    m = corpus[0]
    q = tx.parse_query("gamma patch sure_thing")
    got = {r.message_id for r in search.candidates(search.trigram_postings(m), q).collect()}
    assert got == {1, 3, 4}


def test_evidence_equals_sqlite(spark):
    sqlite3 = pytest.importorskip("sqlite3")
    texts = ["the quick brown fox", "brown bears and brown dogs", "nothing", "quick quick quickly brown", "ab", "fox in a box with fox"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tool, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    con.executemany("INSERT INTO t(rowid, text, tool) VALUES (?, ?, ?)", [(i, x, "brownie" if i == 2 else "") for i, x in enumerate(texts)])
    expected = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"brown\" OR \"fox\"'"))
    m = spark.createDataFrame([(i, "f", "user", x, "brownie" if i == 2 else "", None, i) for i, x in enumerate(texts)], MESSAGES)
    got = {r.message_id: r["rank"] for r in search.message_evidence(search.chunks(search.searchable(m)), tx.parse_query("brown fox")).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_scroll(spark):
    order = [("late", 30), ("legacy-middle", None), ("early", 1), ("pivot", 2), ("tie-after", 2), ("legacy-end", None)]
    m = spark.createDataFrame([(i + 1, "f", "user", n, "", None if n.startswith("legacy") else n, q) for i, (n, q) in enumerate(order)] + [(99, "other", "user", "x", "", "other", 1)], MESSAGES)
    s = spark.createDataFrame([("f", "s", "", "", "", 1, 1, 1, None), ("g", "twice", "", "", "", 1, 1, 1, None), ("h", "twice", "", "", "", 1, 1, 1, None)], SESSIONS)
    e = Engine(spark, s, m)
    got = e.scroll("s", "pivot", window=2)
    assert [r["text"] for r in got["messages"]] == ["early", "legacy-middle", "pivot", "tie-after", "legacy-end"]
    assert [r["text"] for r in got["bookends"]["start"]] == ["early", "legacy-middle", "pivot"] and [r["text"] for r in got["bookends"]["end"]] == ["tie-after", "legacy-end", "late"]
    assert e.scroll("s", message_id=2, window=99)["returned"] == 6
    assert [e.scroll(*a)["reason"] for a in [("none", "pivot"), ("twice", "pivot"), ("s", "other")]] == ["session-missing", "ambiguous-session", "anchor-expired"]
    assert e.scroll("s", message_id=4)["reason"] == "anchor-expired"  # a number names no anchored message
    assert scroll.legacy_anchor(m, s, "s", 4)["anchorId"] == "pivot" and scroll.legacy_anchor(m, s, "s", 2) == {"reason": "unresolved-no-source-identity"}
    pivots = spark.createDataFrame([("f", 4)], "session_file string, pivot_id bigint")
    assert sorted((r.offset, r.id) for r in scroll.windows_around(m, pivots, 2).collect()) == [(-2, 3), (-1, 2), (0, 4), (1, 5), (2, 6)]


def test_lists_and_pages(spark):
    rows = [(f"f{i:02d}", f"s{i:02d}", "/w", f"title {i}", "", 0, 100 - i // 3, 1, None) for i in range(20)]
    s = spark.createDataFrame(rows, SESSIONS)
    e = Engine(spark, s, spark.createDataFrame([], MESSAGES))
    seen, cursor = [], None
    while True:
        page = e.list(limit=7, cursor=cursor)
        seen += [x["id"] for x in page["sessions"]]
        cursor = page.get("nextCursor")
        if not cursor:
            break
    assert seen == [r[1] for r in rows] and page["total"] == 20
    assert listing.parse_cursor("5|a|b") == (5, "a|b") and listing.parse_cursor("x") is None and listing.parse_cursor("7") == (7, "")
    assert e.list(query="TITLE 1")["total"] == 11
    now = 90 * listing.DAY_MS + 95
    assert listing.retained(s, now, 90).count() == 18 and listing.retained(s, now, 0).count() == 20


def test_score_components(spark):
    row = [("f", "s", "/home/dev/Proj", "FTS Trigram Search 设计", "", 0, 1000, 1, None)]
    s = spark.createDataFrame(row, SESSIONS).withColumn("counts", F.create_map(F.lit("user/message"), F.lit(10).cast("long")))
    r = listing.by_relevance(s, "fts", 1000 + listing.DAY_MS, "proj").head()
    assert r.tier == "prefix" and r.tier_term == 18 and r.workspace_term == 10 and r.matched_field == "title"
    assert r.recency_term == pytest.approx(8 * 2 ** (-1 / 21)) and r.frequency_term == pytest.approx(6 * math.log(11)) and r.evidence_term == 0
    assert (r.match_start, r.match_end) == (0, 2)


def test_tiers(spark):
    tier = lambda q, t, m: spark.range(1).select(ranking.tier(q, F.lit(t), F.lit(m)).alias("x")).head().x
    assert [tier("abc", "abc", True), tier("abc", "abcdef", True), tier("abc", "xxabcxx", True), tier("axc", "xxaxxcxx", True), tier("", "anything", False)] == ["exact", "prefix", "substring", "fuzzy", "none"]


def test_best_evidence(spark):
    rows = [("s1", None, -6.2), ("s1", "", -8.9), ("s1", None, -3.1), ("s2", None, -4.0), ("child", "p", -2.0), ("p", None, -5.0)]
    df = spark.createDataFrame(rows, "session_id string, lineage_root string, bm25 double")
    assert {r.lineage: (r.best, r.hit_rows) for r in search.best_evidence(df).collect()} == {"s1": (-8.9, 3), "s2": (-4.0, 1), "p": (-5.0, 2)}


def test_engine_search_groups_by_lineage(spark, corpus):
    e = Engine(spark, corpus[1], corpus[0], clock=lambda: 1000)
    full = e.search("alpha", mode="full")
    assert [h["lineageRoot"] for h in full["hits"]] == ["s1"] and full["hits"][0]["kind"] == "content" and full["total"] == 1
    meta = e.search("alpha")
    assert meta["total"] == 1 and meta["hits"][0]["kind"] == "meta"
    assert e.search("beta", mode="full", filter={"role": "tool"})["total"] == 0
    with pytest.raises(ValueError):
        e.search("  ")
    assert e.summary("S1")["id"] == "s1" and e.summary("f2")["id"] == "s2"
    with pytest.raises(LookupError):
        e.summary("nowhere")
    assert e.status()["messages"] == 45


def test_relevance_scores_every_session(spark):
    """list_relevance: the best title counts however many newer sessions match too."""
    s = spark.createDataFrame([("oldest", "oldest", "", "the", "", 0, 1, 1, None)], SESSIONS)
    newer = spark.range(2100).select(*(F.lit(v).alias(c) if c not in ("file", "id") else F.concat(F.lit("s"), F.col("id")).alias(c) for c, v in zip(s.columns, ("", "", "", "something other", "", 0, 2, 1, None))))
    best = listing.by_relevance(s.unionByName(newer), "the", 1000, "", 5).collect()
    assert best[0].id == "oldest" and len(best) == 5


def test_engine_search_counts_every_hit(spark, corpus):
    """Engine.search: neither the scope nor the content hits are cut before the exact total."""
    s = spark.range(2100).select(*(F.concat(F.lit("s"), F.col("id")).alias(c) if c in ("file", "id") else F.lit(0 if kind == "bigint" else "some alpha" if c == "title" else "").cast(kind).alias(c) for c, kind in corpus[1].dtypes))
    m = spark.range(600).select(*(F.col("id").alias(c) if c == "id" else F.concat(F.lit("s"), F.col("id")).alias(c) if c in ("session_file", "session_id") else F.lit(0 if kind in ("bigint", "int") else "user" if c == "role" else "an alpha text").cast(kind).alias(c) for c, kind in corpus[0].dtypes))
    e = Engine(spark, s, m, clock=lambda: 1000)
    meta, full = e.search("alpha", limit=3), e.search("text", mode="full", limit=3)
    assert (meta["total"], meta["returned"], meta["hasMore"], meta["totalExact"]) == (2100, 3, True, True)
    assert (full["total"], full["returned"], full["truncated"], full["totalExact"]) == (600, 3, True, True)

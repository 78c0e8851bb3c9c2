"""One metadata row for each session from its events, and one message row for each visible message or tool call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import WHITE

FIRST_TEXT, LAST_TEXT, TITLE_TEXT = 500, 2000, 80


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def content_text(content: Column) -> Column:
    """The text items of a message's content (JSON text of an array), joined by blanks and trimmed."""
    array = F.when(F.startswith(F.ltrim(content), F.lit("[")), content)  # a lone object isn't an array of one
    items = F.from_json(array, "array<struct<type string, text string>>")
    return trimmed(F.array_join(F.transform(F.filter(items, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"]), " "))


def event_columns(events: DataFrame) -> DataFrame:
    """events (session_id, type, seq, time, data) with the title, text and tool name they carry."""
    kind = F.col("type")
    path = F.when(kind == "user/message", F.get_json_object("data", "$.content")).when(kind == "assistant/message", F.get_json_object("data", "$.message.content"))
    return events.withColumns(
        {
            "said": F.coalesce(content_text(path), F.lit("")),
            "titled": F.when(kind == "session/title", trimmed(F.get_json_object("data", "$.title"))),
            "tool": F.when(kind == "tool/call", F.coalesce(F.get_json_object("data", "$.name"), F.lit(""))),
        }
    )


def _counts(rows: DataFrame, key: str, out: str) -> DataFrame:
    each = rows.groupBy("session_id", key).agg(F.count("*").alias("n"))
    return each.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(out))


def session_metadata(events: DataFrame) -> DataFrame:
    """(session_id, last_time, title, first_user_text, last_assistant_text, counts, tool_call_counts, tool_names) of surviving events.

    title is the last that isn't empty, or the beginning of the first user text. Maps of counts are small, as they hold types and
    tool names; the events themselves are only aggregated, so a hot session costs no more than partial sums.
    """
    rows = event_columns(events)
    user, assistant = (F.when((F.col("type") == t) & (F.col("said") != ""), F.col("said")) for t in ("user/message", "assistant/message"))
    titled = F.nullif("titled", F.lit(""))
    facts = rows.groupBy("session_id").agg(
        F.max("time").alias("last_time"),
        F.max_by(titled, F.when(titled.isNotNull(), F.struct("seq", titled.alias("t")))).alias("own_title"),
        F.min_by(user, F.when(user.isNotNull(), F.struct("seq", user.alias("t")))).alias("first_user"),
        F.max_by(assistant, F.when(assistant.isNotNull(), F.struct("seq", assistant.alias("t")))).alias("last_assistant"),
    )
    tools = rows.where((F.col("type") == "tool/call") & (F.col("tool") != ""))
    out = facts.join(_counts(rows, "type", "counts"), "session_id").join(_counts(tools, "tool", "tool_call_counts"), "session_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    first = F.coalesce("first_user", F.lit(""))
    return out.select(
        "session_id", "last_time", F.coalesce("own_title", F.substring(first, 1, TITLE_TEXT)).alias("title"), F.substring(first, 1, FIRST_TEXT).alias("first_user_text"),
        F.substring(F.coalesce("last_assistant", F.lit("")), 1, LAST_TEXT).alias("last_assistant_text"), "counts", F.coalesce("tool_call_counts", none).alias("tool_call_counts"),
        F.map_keys(F.coalesce("tool_call_counts", none)).alias("tool_names"),
    )


def message_rows(events: DataFrame) -> DataFrame:
    """(session_id, seq, role, text, tool_name): user and assistant messages with text, and tool calls by name, in seq order."""
    rows = event_columns(events)
    role = F.when(F.col("type") == "user/message", "user").when(F.col("type") == "assistant/message", "assistant").when(F.col("type") == "tool/call", "tool")
    shown = rows.select("session_id", "seq", F.col("type").alias("event_type"), role.alias("role"), F.when(role == "tool", F.lit("")).otherwise(F.col("said")).alias("text"), F.coalesce("tool", F.lit("")).alias("tool_name"))
    return shown.where(F.col("role").isNotNull() & ((F.col("text") != "") | (F.col("tool_name") != "")))


def add_counts(a: Column, b: Column) -> Column:
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Metadata after more events: counts add up, time is the latest, first texts stay, last ones and titles give way."""
    a, b = old.alias("a"), delta.alias("b")
    both = a.join(b, "session_id", "full")
    pick = lambda first, second: F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit(""))
    tools = add_counts(F.col("a.tool_call_counts"), F.col("b.tool_call_counts"))
    # a delta's own title falls back to its first text, which must not replace an older title
    own = F.when(F.col("b.title") != F.substring("b.first_user_text", 1, TITLE_TEXT), F.col("b.title"))
    return both.select(
        "session_id", F.greatest("a.last_time", "b.last_time").alias("last_time"), pick(own, F.coalesce("a.title", "b.title")).alias("title"), pick(F.col("a.first_user_text"), F.col("b.first_user_text")).alias("first_user_text"),
        pick(F.col("b.last_assistant_text"), F.col("a.last_assistant_text")).alias("last_assistant_text"), add_counts(F.col("a.counts"), F.col("b.counts")).alias("counts"),
        tools.alias("tool_call_counts"), F.array_sort(F.map_keys(tools)).alias("tool_names"),
    )

"""Query cleaning and text columns: markers, excerpts, chunks, size estimates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as the log format's writers understand it (U+0085 is not among it).
WHITE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
MARK_OPEN, MARK_CLOSE = ">>>", "<<<"
CHUNK, CHUNK_OVERLAP = 4096, 128
BEFORE, AFTER, EXCERPT = 48, 96, 400


@dataclass(frozen=True)
class Query:
    """Cleaned search terms; matching folds case."""

    terms: tuple[str, ...]

    @property
    def lowered(self) -> tuple[str, ...]:
        return tuple(t.lower() for t in self.terms)

    @property
    def indexed(self) -> bool:
        """Whether every term is long enough for trigrams and short enough for a phrase."""
        return all(len(t) >= 3 and len(t.encode("utf-16-le")) // 2 <= 128 for t in self.terms)


def clean_query(raw: str | None) -> str:
    """A query without unbalanced quotes, without one leading and one trailing operator, hyphenated words quoted, signs dropped."""
    q = (raw or "").strip()
    if q.count('"') % 2:
        q = q.replace('"', "")
    q = re.sub(r"^(?:AND|OR|NOT)\s+", "", q, flags=re.I)
    q = re.sub(r"\s+(?:AND|OR|NOT)$", "", q, flags=re.I)
    q = re.sub(r"(?a:(?<!\S)(\w+-\w+)(?!\S))", r'"\1"', q)
    return re.sub(r"[()*^:\[\]]", " ", q).strip()


def parse_query(raw: str | None) -> Query:
    words = (w.strip('"').replace(MARK_OPEN, "»").replace(MARK_CLOSE, "«") for w in clean_query(raw).split())
    return Query(tuple(w for w in words if w))


def uses_scan(raw: str) -> bool:
    """Route hint: whether a query has a term too short for trigrams."""
    return any(len(t) < 3 for t in parse_query(raw).terms)


def normalize_markers(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK_OPEN), F.lit("»")), F.lit(MARK_CLOSE), F.lit("«"))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, WHITE + "+", " "))


def excerpt(text: Column, term: Column | str, before: int = BEFORE, after: int = AFTER) -> Column:
    """Text around the first occurrence of term, which is marked; without one the text's beginning."""
    term = F.lit(term) if isinstance(term, str) else term
    flat = collapse(text)
    at = F.instr(F.lower(flat), F.lower(term))
    size, length = F.char_length(term), F.char_length(flat)
    start = F.greatest(F.lit(1), at - before)
    end = F.least(length, at + size - 1 + after)
    body = F.concat(
        F.when(start > 1, F.lit("… ")).otherwise(F.lit("")),
        F.substring(flat, start, at - start),
        F.lit(MARK_OPEN), F.substring(flat, at, size), F.lit(MARK_CLOSE),
        F.substring(flat, at + size, end - (at + size) + 1),
        F.when(end < length, F.lit(" …")).otherwise(F.lit("")),
    )
    return F.when(at > 0, F.substring(body, 1, EXCERPT)).otherwise(F.substring(flat, 1, before + after + 40))


def first_present(text: Column, other: Column, terms: tuple[str, ...]) -> Column:
    """The first term, in query order, that text holds; else the first that other holds; else the first of all."""
    out = F.lit(terms[0])
    for column in (other, text):
        for t in reversed(terms):
            out = F.when(F.contains(F.lower(column), F.lit(t.lower())), F.lit(t)).otherwise(out)
    return out


def earliest_present(text: Column, terms: tuple[str, ...]) -> Column:
    """The term that text holds earliest, the first of equals; '' without any."""
    found = F.array(*(F.struct(F.nullif(F.instr(F.lower(text), F.lit(t.lower())), F.lit(0)).alias("at"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)))
    return F.coalesce(F.array_min(F.filter(found, lambda x: x["at"].isNotNull()))["t"], F.lit(""))


def holds_terms(search_text: Column, search_tool: Column, query: Query, every: bool) -> Column:
    """Whether all (or any) terms are in the lower-cased text or tool name of one message."""
    each = [F.contains(search_text, F.lit(t)) | F.contains(search_tool, F.lit(t)) for t in query.lowered]
    out = each[0]
    for e in each[1:]:
        out = out & e if every else out | e
    return out


def chunk_starts(text: Column) -> Column:
    """0-based starts of the chunks of a text: CHUNK long, sharing CHUNK_OVERLAP."""
    step = CHUNK - CHUNK_OVERLAP
    last = F.greatest(F.char_length(text) - CHUNK_OVERLAP - 1, F.lit(0))
    return F.sequence(F.lit(0), F.floor(last / step).cast("int") * step, F.lit(step))


def estimate_tokens(text: Column) -> Column:
    """Tokens by rule of thumb: four ASCII characters or one and a half others each."""
    plain = F.char_length(F.regexp_replace(text, "[^\\x00-\\x7F]", ""))
    return F.ceil(plain / 4 + (F.char_length(text) - plain) / F.lit(1.5))

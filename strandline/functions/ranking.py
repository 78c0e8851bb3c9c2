"""Fuzzy match, hit tier and the explainable session score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Gains and losses of the fuzzy match, and the weights of the score.
GAP_LEADING, GAP_TRAILING, GAP_INNER = -0.005, -0.005, -0.01
CONSECUTIVE, AFTER_SLASH, AFTER_WORD, CAPITAL, AFTER_DOT = 1.0, 0.9, 0.8, 0.7, 0.6
LONGEST = 1024
FUZZY, WORKSPACE, RECENCY, FREQUENCY, EVIDENCE = 60, 10, 8, 6, 12
TIERS = {"exact": 24, "prefix": 18, "substring": 12, "fuzzy": 6, "none": 0}
HALF_LIFE_DAYS, RECENCY_UNKNOWN, FREQUENCY_CAP, EVENTS_CAP = 21, 0.3, 2.5, 1000
DAY_MS = 86_400_000


def _bonus(text: str) -> np.ndarray:
    before = "/" + text[:-1]
    out = np.zeros(len(text))
    for i, (p, c) in enumerate(zip(before, text)):
        if "a" <= c <= "z" or "0" <= c <= "9" or "A" <= c <= "Z":
            out[i] = AFTER_SLASH if p == "/" else AFTER_WORD if p in "-_ " else AFTER_DOT if p == "." else CAPITAL if "A" <= c <= "Z" and "a" <= p <= "z" else 0
    return out


def _in_order(query: str, text: str) -> bool:
    rest = iter(text)
    return all(c in rest for c in query)


def fuzzy_match(query: str | None, text: str | None) -> tuple[float, int, int] | None:
    """(score, first, last position) of the best placement of query's characters in text, or None if they don't occur in order.

    Rows of the two tables hold, for each query character, the best score that ends with it at a position and the best up to a
    position. The inner maximum over gaps is a running maximum, so a row is a few vector operations.
    """
    q = (query or "").lower()
    text = text or ""
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    n, m = len(q), len(lower)
    if not 0 < n <= m or m > LONGEST or not _in_order(q, lower):
        return None
    if n == m:
        return float("inf"), 0, n - 1
    bonus = _bonus(text)
    chars = np.array(list(lower))
    at = np.arange(m)
    ending, best = [], []
    for i, c in enumerate(q):
        gap = GAP_TRAILING if i == n - 1 else GAP_INNER
        if i == 0:
            score = at * GAP_LEADING + bonus
        else:
            score = np.full(m, -np.inf)
            score[1:] = np.maximum(best[-1][:-1] + bonus[1:], ending[-1][:-1] + CONSECUTIVE)
        d = np.where(chars == c, score, -np.inf)
        # the best up to j is the greatest d[k] + gap * (j - k); added up step by step, as later equality tests need it exactly
        row = np.empty(m)
        run = -np.inf
        for j, x in enumerate(d.tolist()):
            run = max(x, run + gap)
            row[j] = run
        ending.append(d)
        best.append(row)
    places = [0] * n
    forced, j = False, m - 1
    for i in range(n - 1, -1, -1):
        while j >= 0 and not (ending[i][j] != -np.inf and (forced or ending[i][j] == best[i][j])):
            j -= 1
        if j < 0:
            places[i] = -1
            j = m - 1
            continue
        forced = i > 0 and j > 0 and best[i][j] == ending[i - 1][j - 1] + CONSECUTIVE
        places[i] = j
        j -= 1
    return float(best[-1][-1]), places[0], places[-1]


_MATCH = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_MATCH)
def fuzzy_column(query: pd.Series, text: pd.Series) -> pd.DataFrame:
    known: dict = {}
    rows = []
    for q, t in zip(query, text):
        if (q, t) not in known:
            known[q, t] = fuzzy_match(q, t)
        rows.append(known[q, t] or (None, None, None))
    out = pd.DataFrame(rows, columns=["score", "start", "end"])
    return out.astype({"score": "Float64", "start": "Int32", "end": "Int32"})


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def tier(query: str, text: Column, matched: Column) -> Column:
    """How a lower-cased field holds a lower-cased query."""
    q = F.lit(query)
    fallback = F.when(matched, F.lit("fuzzy")).otherwise(F.lit("none"))
    if not query:
        return F.lit("none")
    return F.when(text == "", fallback).when(text == q, "exact").when(F.startswith(text, q), "prefix").when(F.contains(text, q), "substring").otherwise(fallback)


def score_columns(query: str, now_ms: int, workspace: str = "", rows: Column | None = None, evidence: Column | None = None) -> dict[str, Column]:
    """Columns of the score over (title, first_user_text, workspace, last_time); by_title and by_text hold the fuzzy matches.

    rows is the number of hit rows (or of events in a list), evidence the best bm25 or null.
    """
    title, first = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("first_user_text", F.lit("")))
    in_title = F.col("by_title.score").isNotNull()
    match = F.when(in_title, F.col("by_title")).otherwise(F.col("by_text"))
    matched = match["score"].isNotNull()
    field = F.when(in_title, F.lit("title")).when(matched, F.lit("firstUserText")).otherwise(F.lit(""))
    held = F.when(in_title, title).when(matched, first).otherwise(F.lit(""))
    level = tier(query.lower(), held, matched)
    ws = workspace.lower().strip()
    age = F.floor(F.greatest(F.lit(0), F.lit(now_ms) - F.coalesce("last_time", F.lit(0))) / DAY_MS)
    recency = F.when(F.col("last_time") > 0, F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)).otherwise(F.lit(RECENCY_UNKNOWN))
    terms = {
        "fuzzy_term": F.when(matched, FUZZY * (2 * sigmoid(match["score"]) - 1)).otherwise(0.0),
        "tier_term": F.coalesce(*(F.when(level == name, F.lit(float(w))) for name, w in TIERS.items())),
        "workspace_term": F.when(F.contains(F.lower(F.coalesce("workspace", F.lit(""))), F.lit(ws)), float(WORKSPACE)).otherwise(0.0) if ws else F.lit(0.0),
        "recency_term": RECENCY * recency,
        "frequency_term": FREQUENCY * F.least(F.log1p(F.greatest(F.lit(0), F.coalesce(rows if rows is not None else F.lit(0), F.lit(0)))), F.lit(FREQUENCY_CAP)),
        "evidence_term": F.coalesce(EVIDENCE * (1 - 2 * sigmoid(evidence)), F.lit(0.0)) if evidence is not None else F.lit(0.0),
    }
    total = terms["fuzzy_term"]
    for name in list(terms)[1:]:
        total = total + terms[name]
    length = F.when(field == "firstUserText", F.char_length(F.coalesce("first_user_text", F.lit("")))).otherwise(F.char_length(F.coalesce("title", F.lit(""))))
    return terms | {"score": total, "tier": level, "matched_field": field, "field_length": length, "match_start": F.coalesce(match["start"], F.lit(-1)), "match_end": F.coalesce(match["end"], F.lit(-1))}

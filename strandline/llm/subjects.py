"""Subject areas of documents by curated terms."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import materialize

TERMS = str(Path(__file__).with_name("subject_terms.txt"))
#: Part of a document's sentences with subject matter that must deal with a subject.
THRESHOLD = 0.25
#: A sentence is open between the subjects whose score comes to this part of the best.
CLOSE = 0.6
#: Latin-script terms of these lengths and more are also found with one letter doubled, or missing or swapped.
DOUBLED_LENGTH, TYPO_LENGTH = 3, 6

#: The most common function words of each language, which tell the language of a sentence.
FUNCTION_WORDS = {
    "en": "the of and a an is are was were be been to it its with by than so her his he she they we you i on at for from out has have had this that these those not but or as if when which who what there their our my your do does did can could will would should may into over after before between because while where how no nor only own same then too very just more most other some such each both few here once up down off again".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von vom ist sind war waren wird werden wurde wurden zu zum zur mit im am an auf aus bei bis durch für gegen in nach ohne über um unter vor nicht kein keine auch noch nur schon sehr so wie als wenn weil dass ob er sie es wir ihr ihre ihren sein seine haben hat hatte kann können muss müssen soll will man sich doch dann da hier dort viele mehr dieser diese dieses jeder jede jedes zwischen seit bitte kaum warum".split(),
    "fr": "le la les l un une de du des d et ou mais sur en est sont était être dans par pour avec sans sous ne pas plus que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je tu son sa ses leur leurs mon ma mes notre votre au aux à se s ont a avait ont été fait comme si très aussi bien encore toujours jamais entre depuis pendant avant après chez vers reste tout toute tous toutes même autre pourquoi comment merci".split(),
}
_LANGUAGES: dict[str, str] = {}
for _g, _words in FUNCTION_WORDS.items():
    for _w in _words:  # a word of several languages tells nothing
        _LANGUAGES[_w] = "" if _w in _LANGUAGES and _LANGUAGES[_w] != _g else _g
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_END = re.compile(r"[.!?]+(?=\s|$)|[。！？]+|\n+")
_SPACE = re.compile(r"[^\S\n]+")
#: Whether a text has no white space but blanks and line feeds.
_PLAIN = re.compile(r"[^\t\r\f\v\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*").fullmatch


class Lexicon:
    """Terms with their languages and weights by subject; number i of `terms` is found by the automaton."""

    def __init__(self, text: str):
        import ahocorasick

        weights: dict[str, dict[str, dict[str, float]]] = defaultdict(lambda: defaultdict(dict))
        for line in text.splitlines():
            if not line or line.startswith("#"):
                continue
            subject, language, terms = line.split("\t")
            for term in terms.split(","):
                word, _, weight = term.strip().partition(":")
                weights[word][language][subject] = float(weight or 1)
        self.terms = sorted((word, language) for word, by in weights.items() for language in by)
        number = {t: i for i, t in enumerate(self.terms)}
        # a term's weight is shared by its subjects, so an ambiguous one decides nothing alone
        self.weights = []
        for word, language in self.terms:
            own = weights[word][language]
            total = sum(own.values())
            self.weights.append({s: w * w / total for s, w in own.items()})
        forms: dict[str, set[str]] = defaultdict(set)
        for word in weights:
            forms[word].add(word)
        for word, by in weights.items():
            if "zh" in by:
                continue
            plurals = {word + "s", word + "es"} | ({word[:-1] + "ies"} if word.endswith("y") else set())
            for form in plurals:
                if form not in weights:
                    forms[form].add(word)
        for word in [w for w in forms if w[0] < "⺀"]:
            n = len(word)
            variants = {word[: i + 1] + word[i:] for i in range(n) if n >= DOUBLED_LENGTH}
            # short words lose or swap only inner letters, or they become other words
            inner = range(n) if n >= 8 else range(1, n - 1) if n >= TYPO_LENGTH else ()
            variants |= {word[:i] + word[i + 1 :] for i in inner} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in inner if i + 2 < n}
            base = {w for w in forms[word] if w in weights}
            for v in variants:
                if v not in weights and v == v.strip():
                    forms[v] = forms[v] | base
        for word in [w for w in forms if not w.isascii()]:  # UTF-8 that was read as a single-byte encoding
            for wrong in ("latin-1", "cp1252"):
                broken = word.encode().decode(wrong, "replace").lower()
                if "\ufffd" not in broken and broken not in weights:
                    forms[broken] = forms[broken] | {w for w in forms[word] if w in weights}
        self.found = ahocorasick.Automaton()
        for form, words in forms.items():
            self.found.add_word(form, (len(form), tuple(number[w, g] for w in sorted(words) for g in weights[w])))
        self.found.make_automaton()

    def sentences(self, text: str) -> list[list[int]]:
        """Numbers of the terms in each sentence that has any, whole words only, the longest at each place."""
        text = text.lower()
        if "  " in text or not _PLAIN(text):
            text = _SPACE.sub(" ", text)
        hits = []
        for end, (size, numbers) in self.found.iter_long(text):
            start = end - size + 1
            if text[start] < "⺀" and (start and text[start - 1].isalnum() and text[start - 1] < "⺀" or end + 1 < len(text) and text[end + 1].isalnum() and text[end + 1] < "⺀"):
                continue
            hits.append((start, numbers))
        if not hits:
            return []
        ends = [m.end() for m in _END.finditer(text)]
        grouped: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for start, numbers in hits:
            grouped[bisect_right(ends, start)].append(numbers)
        out = []
        for k, found in grouped.items():
            kept = sorted({n for numbers in found for n in numbers})
            if any(self.terms[n][1] != "zh" for n in kept):
                language = language_of(text[ends[k - 1] if k else 0 : ends[k] if k < len(ends) else len(text)])
                kept = [n for n in kept if language is None or self.terms[n][1] in ("zh", language)]
            if kept:
                out.append(kept)
        return out


def language_of(sentence: str) -> str | None:
    """en, de or fr by its function words, None where they don't tell."""
    score = Counter(map(_LANGUAGES.get, _WORD.findall(sentence)))
    known = sorted(((score[g], g) for g in FUNCTION_WORDS), reverse=True)
    return known[0][1] if known[0][0] > known[1][0] else None


@lru_cache(maxsize=2)
def lexicon_of(text: str) -> Lexicon:
    return Lexicon(text)


def lexicon(path: str = TERMS) -> Lexicon:
    return lexicon_of(Path(path).read_text(encoding="utf-8"))


def term_sentences(df: DataFrame, terms: str = TERMS) -> DataFrame:
    """(doc_id, sentences): the terms found in each sentence of the whole text, for documents that have any."""
    kind = df.schema["doc_id"].dataType.simpleString()
    listed = Path(terms).read_text(encoding="utf-8")  # sent along, so executors need no file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon_of(listed)
        for batch in batches:
            found = [known.sentences(t) if t else [] for t in batch.column(1).to_pylist()]
            take = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([x for x in found if x], pa.list_(pa.list_(pa.int32())))], ["doc_id", "sentences"])

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, sentences array<array<int>>")


def shares_of(sentences: list[list[int]], weights: list[dict[str, float]], rarity: list[float]) -> dict[str, float]:
    """Part of the sentences that deals with each subject.

    A sentence goes to the subject whose terms weigh most; one that stays open between several is shared out as the document's
    other sentences are.
    """
    sure: dict[str, float] = defaultdict(float)
    unsure: list[list[str]] = []
    for numbers in sentences:
        score: dict[str, float] = defaultdict(float)
        for n in numbers:
            for subject, w in weights[n].items():
                score[subject] += w * rarity[n]
        best = max(score.values())
        leading = [s for s, x in score.items() if x >= CLOSE * best]
        if len(leading) == 1:
            sure[leading[0]] += 1
        else:
            unsure.append(leading)
    credit = dict(sure)
    for leading in unsure:
        weight = {s: sure.get(s, 0.0) for s in leading}
        total = sum(weight.values())
        for s in leading:
            credit[s] = credit.get(s, 0.0) + (weight[s] / total if total else 1 / len(leading))
    return {s: x / len(sentences) for s, x in credit.items() if x}


def subject_shares(df: DataFrame, terms: str = TERMS) -> DataFrame:
    """(doc_id, subject, share, sentences): the part of each document's sentences with subject matter that a subject has.

    Terms of all languages are matched by one automaton over the whole text; their rarity is the logarithm of the documents
    for each that has the term, counted over all documents. Only that count, one row for each term, comes to the driver.
    """
    known = lexicon(terms)
    found = materialize(term_sentences(df, terms), "terms")
    counted = {r["t"]: r["n"] for r in found.select(F.explode(F.array_distinct(F.flatten("sentences"))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    total = found.count()
    rarity = [1 + math.log((total + 1) / (counted.get(i, 0) + 1)) for i in range(len(known.terms))]
    weights = known.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, subjects, parts, sizes = [], [], [], []
            for i, sentences in enumerate(batch.column(1).to_pylist()):
                for s, x in sorted(shares_of(sentences, weights, rarity).items()):
                    take.append(i)
                    subjects.append(s)
                    parts.append(x)
                    sizes.append(len(sentences))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(subjects, pa.string()), pa.array(parts, pa.float64()), pa.array(sizes, pa.int64())], ["doc_id", "subject", "share", "sentences"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, subject string, share double, sentences bigint")


def assign_subjects(df: DataFrame, subjects: DataFrame, terms: str = TERMS, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject) for each subject of the table that has at least its threshold of a document's subject matter.

    The threshold is THRESHOLD, or where hand-labelled documents (doc_id, subject) are given, what they ask for (see calibrate).

    Null, blank and subjectless texts get no row; repeated documents and ids are judged each by itself; the language column,
    title and every other column are ignored; terms of subjects that aren't in the table count but aren't reported.
    """
    shares = subject_shares(df, terms)
    least = {}
    if labels is not None:
        shares = materialize(shares, "shares")
        least = calibrate(shares, labels)
    wanted = subjects.select("subject").where("subject is not null").distinct()
    bound = F.lit(THRESHOLD)
    for s, x in sorted(least.items()):
        bound = F.when(F.col("subject") == s, x).otherwise(bound)
    return shares.where(F.col("share") >= bound - 1e-9).join(wanted, "subject", "left_semi").select("doc_id", "subject")


def calibrate(shares: DataFrame, labels: DataFrame, steps: int = 40, sigmas: float = 3.0) -> dict[str, float]:
    """Threshold of each subject that labelled documents ask for; all of them count.

    Every threshold k / steps is compared with the stated THRESHOLD by the documents on which the two disagree: it is taken only
    where it is right more often by `sigmas` standard errors (McNemar), as a part of the labels is wrong; of several, the one
    that is right most often, then the nearest to THRESHOLD, then the lower. A subject without such a threshold keeps THRESHOLD.

    Documents are counted by the last k that their share reaches, and only these counts meet every k. A label without a share
    is missed at any threshold, so it tells between none.
    """
    truth = labels.where("subject is not null and doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("own"))
    reached, stated = F.floor((F.col("share") + 1e-9) * steps).alias("reached"), (F.col("share") >= THRESHOLD - 1e-9).alias("stated")
    counts = shares.join(truth, "doc_id").groupBy("subject", reached, stated, F.array_contains("own", F.col("subject")).alias("yes")).agg(F.count("*").alias("n"))
    rows = counts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    right, before = (F.col("reached") >= F.col("k")) == F.col("yes"), F.col("stated") == F.col("yes")
    scored = rows.groupBy("subject", "k").agg(*(F.sum(F.when(a & ~b, F.col("n")).otherwise(0)).alias(c) for c, a, b in (("better", right, before), ("worse", before, right))))
    sound = scored.where(F.col("better") - F.col("worse") > sigmas * F.sqrt(F.col("better") + F.col("worse")))
    best = sound.groupBy("subject").agg(F.max_by("k", F.struct(F.col("better") - F.col("worse"), -F.abs(F.col("k") / steps - THRESHOLD), -F.col("k"))).alias("k"))
    return {r["subject"]: r["k"] / steps for r in best.collect()}


def composition(df: DataFrame, assigned: DataFrame, source_key) -> DataFrame:
    """(source, subject, documents): the corpus's make-up; a document with several subjects counts for each."""
    return df.select("doc_id", source_key(F.col("source")).alias("source")).join(assigned, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("documents"))

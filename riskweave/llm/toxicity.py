"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

The lexicon is learnt from labelled rows: words and word beginnings that toxic documents have far more often, and
exceptions that only clean documents have: words with such a beginning, and phrases of two or three words around one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free_name, materialise, scratch, text_of, width

# Look-alike letters of other scripts, and digits and signs written for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһνκαορτιΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХ", "aeopcyxijsdhvkaoptiabezhikmnoptyxabekmhopctx")
DIGITS = str.maketrans("0134578@$", "oieastbas")

#: Labelled rows that the lexicon is fitted on, at most: those with the lowest hashes of their ids.
LABELLED_ROWS = 40_000
#: Shortest and longest word beginning, toxic documents that an entry must be in, and clean ones that an exception must be in.
STEM, LEAST_DOCS, LEAST_CLEAN = (4, 8), 4, 2
#: How much likelier in toxic documents an entry must be (natural logarithm).
LEAST_WEIGHT = 2.0
THRESHOLD = 0.3

_FOREIGN = re.compile("[\u0370-\u04ff\u0500-\u052f]")
_SIGN = re.compile(r"[0-9@$]")
_NEXT_TO_LETTER = re.compile(r"[a-z][0-9@$]|[0-9@$][a-z]")
_WORD = re.compile(r"[^\W\d_]+")


def _unmask(token: str) -> str:
    if _SIGN.search(token) and sum(map(str.isalpha, token)) >= 2:
        return token.rstrip("@$").translate(DIGITS)
    return token


def fold(text: str) -> str:
    """Lower case, look-alikes as plain letters, digits and signs inside words as the letters they stand for."""
    low = text.lower()
    if not low.isascii() and _FOREIGN.search(low):
        low = low.translate(HOMOGLYPHS)
    if _NEXT_TO_LETTER.search(low):
        low = " ".join(map(_unmask, low.split()))
    return low


def _terms(word: str) -> set[str]:
    return {word + " ", *(word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1))}


def _toxic_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """term, n: in how many of the documents a term is; sent on before the table grows large."""
    counts: Counter = Counter()
    for frame in frames:
        for body in frame["body"]:
            counts.update(set().union(*map(_terms, set(_WORD.findall(fold(body))))))
        if len(counts) > 300_000:
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})
            counts = Counter()
    yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": object, "n": "int64"})


def _clean_terms(candidates: frozenset):
    """How many of the documents have each candidate."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for body in frame["body"]:
                found: set[str] = set()
                for word in set(_WORD.findall(fold(body))):
                    if word[: STEM[0]] in candidates or word + " " in candidates:
                        found |= candidates & _terms(word)
                counts.update(found)
        yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": object, "n": "int64"})

    return count


def _words_with(stems: frozenset):
    """How many of the documents have each whole word that begins with a stem."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for body in frame["body"]:
                counts.update(w + " " for w in set(_WORD.findall(fold(body))) if any(w[:k] in stems for k in range(STEM[0], STEM[1] + 1)))
        yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": object, "n": "int64"})

    return count


def _phrases(lexicon: Lexicon):
    """How many of the documents have each phrase of two or three words around a word that counts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for body in frame["body"]:
                words, found = _WORD.findall(fold(body)), set()
                for i, word in enumerate(words):
                    if lexicon.weight(word) > 0:
                        found.update(" ".join(words[a:b]) for a, b in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2)) if a >= 0 and b <= len(words))
                counts.update(found)
        yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": object, "n": "int64"})

    return count


@dataclass
class Lexicon:
    """weights: word (ends with a space) or word beginning -> weight; exceptions: words (with a space) that aren't held against a text; phrases likewise."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    phrases: set[str] = field(default_factory=set)
    intercept: float = -6.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def weight(self, word: str) -> float:
        """What a word by itself counts: the word's own weight, or that of its longest beginning."""
        if word + " " in self.exceptions:
            return 0.0
        own = self.weights.get(word + " ")
        return own if own is not None else next((self.weights[word[:k]] for k in range(min(STEM[1], len(word)), STEM[0] - 1, -1) if word[:k] in self.weights), 0.0)

    def automaton(self):
        """key -> (its length, weight as a beginning, weight as a whole word, if it is a phrase); exceptions weigh nothing as whole words."""
        import ahocorasick

        entries: dict[str, list] = {}
        for term, weight in [*self.weights.items(), *((t, 0.0) for t in self.exceptions)]:
            entries.setdefault(term.rstrip(" "), [None, None, False])[term.endswith(" ")] = weight
        for phrase in self.phrases:
            entries.setdefault(phrase, [None, None, False])[2] = True
        machine = ahocorasick.Automaton()
        for key, (stem, whole, phrase) in entries.items():
            machine.add_word(key, (len(key), stem, whole, phrase))
        if len(machine):
            machine.make_automaton()
        return machine

    def measure(self, machine, text: str) -> tuple[float, float]:
        """The sum of weights of matched words outside exception phrases (each word's longest match counts), and that by length."""
        low = fold(text)
        if not low or not len(machine):
            return 0.0, 0.0
        said = " ".join(_WORD.findall(low))
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (n, stem, whole, phrase) in machine.iter(said):
            start = last - n + 1
            if start and said[start - 1] != " ":
                continue
            ends = last + 1 == len(said) or said[last + 1] == " "
            if phrase and ends:
                spared.append((start, last))
            weight = whole if ends and whole is not None else stem
            if weight is not None and best.get(start, (0, 0))[0] < n:
                best[start] = (n, weight)
        covered = bytearray(len(said)) if spared else b""
        for a, b in spared:
            covered[a : b + 1] = b"\x01" * (b + 1 - a)
        total = sum(w for at, (_, w) in best.items() if not spared or not covered[at])
        return math.log1p(total), total / math.sqrt(len(low) / 6 + 10)

    def score(self, machine, text: str) -> float:
        x = self.measure(machine, text)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.intercept + self.slopes[0] * x[0] + self.slopes[1] * x[1]))))


def _measured(lexicon: Lexicon):
    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for frame in frames:
            values = [lexicon.measure(machine, body) for body in frame["body"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "a": [v[0] for v in values], "b": [v[1] for v in values]})

    return measured


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
    return w


def _totals(rows: DataFrame, count, least: int = 1) -> dict[str, int]:
    """term -> number of documents, where that is least or more. There are no more terms than the labelled rows have."""
    counted = rows.select("body").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r["term"]: r["n"] for r in counted.collect()}


def fit(labelled: DataFrame) -> Lexicon:
    """A lexicon from (body, toxic) rows: terms of toxic documents, how often clean ones have them, then words and phrases that are excepted."""
    toxic, clean = labelled.filter("toxic = 1"), labelled.filter("toxic <> 1")
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    if not pos or not neg:
        return Lexicon()
    n_toxic = _totals(toxic, _toxic_terms, LEAST_DOCS)
    n_clean = _totals(clean, _clean_terms(frozenset(n_toxic)))
    weigh = {t: math.log((n + 0.1) / (pos + 0.2)) - math.log((n_clean.get(t, 0) + 0.1) / (neg + 0.2)) for t, n in n_toxic.items()}
    lexicon = Lexicon({t: w for t, w in sorted(weigh.items()) if w >= LEAST_WEIGHT})
    stems = frozenset(t for t in lexicon.weights if not t.endswith(" "))
    if stems:
        had = _totals(toxic, _words_with(stems))
        lexicon.exceptions = _totals(clean, _words_with(stems), LEAST_CLEAN).keys() - had.keys()
    if lexicon.weights:
        had = _totals(toxic, _phrases(lexicon))
        lexicon.phrases = _totals(clean, _phrases(lexicon), LEAST_CLEAN).keys() - had.keys()
    seen = labelled.select("body", (F.col("toxic") == 1).alias("toxic")).mapInPandas(_measured(lexicon), "toxic boolean, a double, b double").toPandas()
    w = _logistic(seen[["a", "b"]].to_numpy(), seen["toxic"].to_numpy(float))
    lexicon.intercept, lexicon.slopes = float(w[0]), (float(w[1]), float(w[2]))
    return lexicon


def score_column(lexicon: Lexicon, text: Column) -> Column:
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = lexicon.automaton()
        for part in parts:
            yield pd.Series([lexicon.score(machine, body) for body in part], dtype=float)

    return F.pandas_udf(scored, "double")(text)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = LABELLED_ROWS) -> Lexicon:
    """A lexicon from the labelled documents that aren't held out; of repeated labels of an id the highest counts."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out())
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    with scratch(docs.sparkSession):  # so many labels at most, whatever the input; spread, as each is read several times
        return fit(materialise(slim.join(F.broadcast(known), "doc_id").select("body", "toxic").repartition(width(docs.sparkSession)), "labelled"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold) for every row of docs.

    Learns from rows of labels whose id isn't held out (crc32 of the id as text, modulo 4, is 2). Null and empty
    texts match nothing and get the lowest score. A null id isn't held out, and has no label. With no toxic or no clean label to learn
    from, every score is low. Repeated rows are scored each. An empty table gives an empty result. Only the text is scored.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    scored = slim.withColumn("score", score_column(learn(docs, labels, doc_id, text), F.col("body")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    own = free_name(docs, "score")
    scored = docs.withColumn(own, score_column(learn(docs, labels), text_of()))
    return scored.filter(F.col(own) < threshold).select(columns_of(docs))

"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, invisible characters removed, homoglyphs and the digits
and signs that stand for letters replaced. Lexicon entries are beginnings of words (of
``SHORTEST`` to ``LONGEST`` characters; longer words are met by their beginnings) with a weight,
learned from labelled documents: the log-odds of a toxic document. What counts is how many
different words of toxic and of clean documents begin so. The evidence an entry needs follows the
sample: among the accepted ones a share ``FALSE_SHARE`` at most is expected to be there by chance
(Benjamini and Hochberg's rule). Of beginnings of one another the one with more evidence stays, so
that the many forms of a word back off to their common beginning.

Entries are matched by an Aho-Corasick automaton at the beginnings of words; hits inside an
exception phrase do not count. Exceptions are given ones and learned ones: an entry's word with
the word before or after it, if that pair stands in clean documents beyond chance. The weights
found are normalised by the length of the text, and a logistic curve turns them into a score.

NULL and empty texts have no hits and get the score of a text without any. Long texts are read
whole, in time that grows with their length. Repeated rows are scored alike; equal evidence
prefers the longer entry, then the one first in order of code points. An empty table gives an
empty result. The model is fitted on at most ``max_rows`` labelled rows, taken in order of a hash
of the id; NULL labels are left out. Without labels of both kinds the seed entries and a fixed
curve are used.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import held_out, whole
from caseloom.sources.sinks import write_stage

MAX_ROWS = 20_000
THRESHOLD = 0.3
SHORTEST, LONGEST = 3, 12
#: Share of the accepted entries, and of the exceptions, that may be there by chance.
FALSE_SHARE = 0.01
#: Documents that an entry or an exception needs, and how much likelier an entry's words are toxic.
LEAST_DOCS, LIFT = 2, 2.0
#: Beginnings and phrases that a task holds counts of before it hands them on.
HELD = 50_000

# Entries used whatever the labels say, and phrases that excuse an entry.
SEED = ("idiot", "moron", "scumbag", "imbecile", "stupid")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "worthless check")

# Letters and signs that look like a Latin letter.
HOMOGLYPHS = {
    "a": "а α ａ @ 4", "b": "Ь ｂ", "c": "с ｃ ϲ", "d": "ԁ ｄ", "e": "е ε ｅ 3 €", "f": "ｆ", "g": "ｇ ɡ",
    "h": "һ ｈ", "i": "і ι ｉ 1 !", "j": "ј ｊ", "k": "к κ ｋ", "l": "ӏ ｌ", "m": "м ｍ", "n": "п ｎ",
    "o": "о ο ｏ 0", "p": "р ρ ｐ", "q": "ԛ ｑ", "r": "ｒ", "s": "ѕ ｓ 5 $", "t": "т τ ｔ 7", "u": "υ ｕ",
    "v": "ν ｖ", "w": "ԝ ｗ", "x": "х χ ｘ", "y": "у ｙ", "z": "ｚ",
}
INVISIBLE = "​‌‍⁠﻿­"

_FOLD = {ord(sign): letter for letter, signs in HOMOGLYPHS.items() for sign in signs.split()}
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = frozenset(sign for signs in HOMOGLYPHS.values() for sign in signs.split() if not sign.isalpha())


def fold(text: str) -> tuple[str, str]:
    """The lower-cased text and its folded form; both have the same length."""
    low = text.lower()
    if any(c in low for c in INVISIBLE):
        low = _HIDDEN.sub("", low)
    return low, low.translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Intercept, and the factors of the two numbers of :func:`strength`.
    curve: tuple[float, float, float] = (-4.0, 1.5, 0.5)


def strength(weight: float, length: int) -> tuple[float, float]:
    """Weight per thousand characters, and in all, on logarithmic scales."""
    return math.log1p(1000 * weight / (length + 200)), math.log1p(weight)


class Matcher:
    """Summed weight of the hits in a text."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = len(self.automaton) == 0
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the hits outside exceptions, at positions of the folded text."""
        if self.empty or not text:
            return []
        low, folded = fold(text)
        hits, excused = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha() and low[start - 1] not in _SIGNS:
                continue
            if weight is None:
                excused.append((start, end))
            else:
                hits.append((start, end, weight))
        if not excused or not hits:
            return hits
        # A hit is excused if an exception begins no later and reaches as far.
        excused.sort()
        starts, reach, furthest = [s for s, _ in excused], [], -1
        for _, end in excused:
            furthest = max(furthest, end)
            reach.append(furthest)
        left = []
        for start, end, weight in hits:
            k = bisect_right(starts, start)
            if not k or reach[k - 1] < end:
                left.append((start, end, weight))
        return left

    def weight(self, text: str) -> float:
        return sum(w for _, _, w in self.hits(text))


def _beginnings(text: str) -> tuple[Counter, int]:
    """How many different words begin so, and how many different words there are."""
    found: Counter = Counter()
    words = set(_WORDS.findall(fold(text)[1]))
    for word in words:
        found.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return found, len(words)


def _phrases(text: str, matcher: Matcher) -> set[str]:
    """Words that hold a hit with the word before or after, where only blanks lie between."""
    folded = fold(text)[1]
    found = set()
    spans = [m.span() for m in _WORDS.finditer(folded)]
    starts = [s for s, _ in spans]
    for start, _, _ in matcher.hits(text):
        k = bisect_right(starts, start) - 1
        for i in (k - 1, k):
            if 0 <= i < len(spans) - 1 and k >= 0 and folded[spans[i][1] : spans[i + 1][0]] == " ":
                found.add(folded[spans[i][0] : spans[i + 1][1]])
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``text, label`` of the labelled rows that may be learned from. The ids are bounded by
    ``max_rows`` and therefore broadcast; texts are not shuffled."""
    ids = labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label"))
    ids = ids.filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(max_rows)
    return docs.select(F.col(doc_id).alias("label_id"), whole(text).alias("text")).join(F.broadcast(ids), "label_id").select("text", "label")


def _counts(sample: DataFrame, key: str, of: Callable[[str], tuple[Counter, int]]) -> DataFrame:
    """Per key: ``bad`` and ``good`` observations in toxic and clean documents, ``bad_docs`` and
    ``good_docs`` that have any. The empty key has all observations. Counts leave a task whenever
    it holds ``HELD`` of them, so its memory does not grow with the sample."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(k, *n) for k, n in seen.items()], columns=[key, "bad", "good", "bad_docs", "good_docs"])
            seen.clear()
            return rows

        for frame in frames:
            for body, label in zip(frame["text"], frame["label"], strict=True):
                found, all_of = of(body)
                side = 0 if label else 1
                for k, n in [*found.items(), ("", all_of)]:
                    held = seen.get(k)
                    if held is None:
                        held = seen[k] = [0, 0, 0, 0]
                    held[side] += n
                    held[side + 2] += 1
                if len(seen) > HELD:
                    yield out()
        yield out()

    counted = sample.mapInPandas(run, f"{key} string, bad bigint, good bigint, bad_docs bigint, good_docs bigint")
    return counted.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("bad", "good", "bad_docs", "good_docs")])


def _beyond_chance(rows: list, tests: int, false_share: float) -> list:
    """The rows (by falling ``gain``, the evidence as natural logarithm) of which a share
    ``false_share`` at most is expected by chance among so many tests."""
    last = 0
    for i, row in enumerate(rows, 1):
        if math.log(tests) - row["gain"] <= math.log(i * false_share):
            last = i
    return rows[:last]


def _gain(of: str, against: str, base: float) -> Column:
    """Evidence that ``of`` takes a larger part than ``base``: the bound of Chernoff."""
    n = F.col(of) + F.col(against)
    share = F.col(of) / n
    rest = F.col(against) * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - base))
    return F.col(of) * F.log(share / base) + F.when(F.col(against) > 0, rest).otherwise(0.0)


def learn_entries(sample: DataFrame, false_share: float = FALSE_SHARE) -> dict[str, float]:
    """Beginnings of words that tell toxic documents, with their log-odds."""
    counted = write_stage(_counts(sample, "entry", _beginnings), "toxic-beginnings")
    totals = counted.filter(F.col("entry") == "").collect()
    bad, good = (totals[0]["bad"], totals[0]["good"]) if totals else (0, 0)
    if not bad or not good:
        return {}
    base = bad / (bad + good)
    found = counted.filter(F.col("entry") != "")
    tests = found.filter(F.col("bad") + F.col("good") > LEAST_DOCS).count()
    told = found.filter((F.col("bad_docs") >= LEAST_DOCS) & (F.col("bad") >= LIFT * base * (F.col("bad") + F.col("good"))))
    # No entry with less evidence can be accepted, however many are.
    told = told.withColumn("gain", _gain("bad", "good", base)).filter(F.col("gain") >= -math.log(false_share))
    rows = told.orderBy(F.desc("gain"), F.desc(F.length("entry")), "entry").collect()  # beginnings in a bounded sample
    entries: dict[str, float] = {}
    taken: set[str] = set()
    for row in _beyond_chance(rows, tests, false_share):
        entry = row["entry"]
        heads = {entry[:k] for k in range(SHORTEST, len(entry) + 1)}
        if entry in taken or not heads.isdisjoint(entries):
            continue
        taken |= heads
        entries[entry] = math.log((row["bad"] + 0.5) / (bad + 1)) - math.log((row["good"] + 0.5) / (good + 1))
    return entries


def learn_exceptions(sample: DataFrame, weights: dict[str, float], false_share: float = FALSE_SHARE) -> tuple[str, ...]:
    """Phrases of two words around a hit that tell clean documents from the others with a hit."""
    lexicon = Lexicon(weights)

    def of() -> Callable[[str], tuple[Counter, int]]:
        made: list[Matcher] = []

        def phrases(text: str) -> tuple[Counter, int]:
            if not made:
                made.append(Matcher(lexicon))
            found = _phrases(text, made[0])
            return Counter(found), 1 if found else 0

        return phrases

    counted = write_stage(_counts(sample, "phrase", of()), "toxic-phrases")
    totals = counted.filter(F.col("phrase") == "").collect()
    bad, good = (totals[0]["bad"], totals[0]["good"]) if totals else (0, 0)
    if not good or not bad:
        return ()
    found = counted.filter(F.col("phrase") != "")
    tests = found.filter(F.col("bad") + F.col("good") > LEAST_DOCS).count()
    base = good / (bad + good)
    told = found.filter((F.col("good_docs") > LEAST_DOCS) & (F.col("good") > base * (F.col("bad") + F.col("good"))))
    told = told.withColumn("gain", _gain("good", "bad", base)).filter(F.col("gain") >= -math.log(false_share))
    rows = told.orderBy(F.desc("gain"), "phrase").collect()  # phrases around hits in a bounded sample
    return tuple(r["phrase"] for r in _beyond_chance(rows, tests, false_share))


def weigh(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``weight`` and ``length`` of each text."""
    rows = docs.select(*keep, whole(text).alias("body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for frame in frames:
            out = frame.drop(columns="body")
            out["weight"] = np.array([matcher.weight(t) for t in frame["body"]], dtype=float)
            out["length"] = np.array([len(t) for t in frame["body"]], dtype=np.int64)
            yield out

    return rows.mapInPandas(run, f"{schema}, weight double, length bigint")


def _strength_columns() -> list:
    return [F.log1p(1000 * F.col("weight") / (F.col("length") + 200)).alias("x1"), F.log1p("weight").alias("x2")]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    sample = write_stage(labelled_sample(docs, labels, max_rows, doc_id, text, label), "toxic-sample")
    learned = learn_entries(sample)
    weights = {s: SEED_WEIGHT for s in SEED if not any(s.startswith(e) or e.startswith(s) for e in learned)} | learned
    if not learned:
        return Lexicon(weights)
    exceptions = tuple(dict.fromkeys([*EXCEPTIONS, *learn_exceptions(sample, weights)]))
    lexicon = Lexicon(weights, exceptions)
    rows = weigh(sample, lexicon, ["label"]).select("label", *_strength_columns())
    rows = rows.groupBy("label", "x1", "x2").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(rows).cache()
    model = LogisticRegression(labelCol="label", weightCol="n", maxIter=50, regParam=1e-3).fit(rows)
    rows.unpersist()
    return Lexicon(weights, exceptions, (float(model.intercept), *map(float, model.coefficients)))


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` per row."""
    found = weigh(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), lexicon, ["doc_id"])
    a, b, c = lexicon.curve
    x1, x2 = _strength_columns()
    return found.select("doc_id", x1, x2).select("doc_id", (1 / (1 + F.exp(-(a + b * F.col("x1") + c * F.col("x2"))))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    lexicon = fit(docs, labels, max_rows, doc_id, text)
    scored = score(docs, lexicon, doc_id, text)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents below the threshold, with their columns."""
    lexicon = fit(docs, labels, max_rows, doc_id, text)
    a, b, c = lexicon.curve

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon)

        def score_of(text: str) -> float:
            x, y = strength(matcher.weight(text), len(text))
            return 1 / (1 + math.exp(-(a + b * x + c * y)))

        for batch in texts:  # one text at a time as a string
            yield pa.array([score_of(t.as_py()) for t in batch], pa.float64())

    return docs.filter(scores(whole(text)) < threshold)

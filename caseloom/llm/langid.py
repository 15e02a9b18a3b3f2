"""Language identification in two steps: the family, then the language within it.

Texts become normalised counts of hashed letter trigrams over the whole text. Linear support
vector machines, one for each pair of families and one for each pair of languages of a
family, vote; a margin counts as a probability through a logistic curve. The score is that
of the family times that of the language within it.

Texts that are NULL or hold no letter are ``und`` with score 0. Repeated rows are predicted
alike; ties go to the first name in order. Learning reads at most about ``per_language``
rows of each language, drawn by a hash of the id; the features of every row use its whole
text. With no labelled row everything is ``und``; with one language everything is that one.
An empty table gives an empty result. Long texts are read whole; columns other than id, text and
language are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from caseloom.llm.common import held_out, whole
from caseloom.sources.sinks import write_stage

UNKNOWN = "und"
PER_LANGUAGE = 1500
BINS = 2048
#: Names of languages are part of the model; more are refused.
MAX_LANGUAGES = 1000

# Language families by ISO 639-1 code. Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms tl jv",
}


def family(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), language)


class Trigrams:
    """Features of texts: square roots of hashed trigram counts, of length 1."""

    def __init__(self) -> None:
        letters = [chr(i) for i in range(0x10000)]
        self.table = np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in letters], dtype=np.uint32)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = self.table[np.minimum(points, 0xFFFF)]
        high = points > 0xFFFF
        if high.any():
            found[high] = [p if chr(p).isalpha() else 32 for p in points[high].tolist()]
        return found

    def of(self, text: str) -> np.ndarray | None:
        """None for a text without letters."""
        codes = self.codes(text)
        if not (codes != 32).any():
            return None
        codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        mixed = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + c * np.uint32(0x27D4EB2F)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bins = (mixed >> np.uint32(21))[b != 32]
        counts = np.sqrt(np.bincount(bins, minlength=BINS).astype(np.float32))
        return counts / np.linalg.norm(counts)


@dataclass
class Pairwise:
    """Classes in order and a separating plane (weights, intercept) for each pair; a positive
    margin speaks for the first."""

    classes: list[str]
    planes: dict[tuple[int, int], tuple[np.ndarray, float]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), len(self.classes)))
        for (i, j), (weights, intercept) in self.planes.items():
            p = 1 / (1 + np.exp(-3 * np.clip(x @ weights + intercept, -20, 20)))
            votes[:, i] += p
            votes[:, j] += 1 - p
        if not self.planes:
            votes[:] = 1.0
        return votes / votes.sum(axis=1, keepdims=True) if votes.size else votes


@dataclass
class Model:
    families: Pairwise
    within: dict[str, Pairwise]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top = self.families.probabilities(x)
        chosen = top.argmax(axis=1)
        names, scores = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, name in enumerate(self.families.classes):
            mine = np.flatnonzero(chosen == k)
            if len(mine):
                inner = self.within[name]
                p = inner.probabilities(x[mine])
                best = p.argmax(axis=1)
                # Votes of n classes reach 2 / n at most.
                share = np.minimum(1.0, p.max(axis=1) * max(1, len(inner.classes) / 2))
                outer = np.minimum(1.0, top[mine, k] * max(1, len(self.families.classes) / 2))
                names[mine] = [inner.classes[b] for b in best]
                scores[mine] = share * outer
        return names.tolist(), scores


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``text, lang`` of rows drawn by a hash of the id, about equally many per language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}: these are not languages")
    rates = [F.lit(v) for r in counts for v in (r["lang"], per_language / r["n"])]
    share = F.create_map(*rates)[F.col("lang")] if rates else F.lit(0.0)
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) / 1e6
    return rows.filter(draw < share).select("text", "lang")


def features(rows: DataFrame, keep: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Trigrams()
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                found = [make.of(t) for t in part["text"]]
                ok = [f is not None for f in found]
                yield pd.DataFrame({keep: part[keep][ok], "x": [f for f in found if f is not None]})

    return rows.select("text", keep).mapInPandas(run, f"{keep} string, x array<float>")


def _fit_pairs(rows: DataFrame, column: str, classes: list[str], parallelism: int = 8) -> Pairwise:
    """A plane for each pair of classes; the fits are independent jobs and run side by side."""

    def plane(pair: tuple[int, int]) -> tuple[np.ndarray, float]:
        one, two = classes[pair[0]], classes[pair[1]]
        own = rows.filter(F.col(column).isin(one, two))
        own = own.select("features", (F.col(column) == one).cast("double").alias("label"))
        svm = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(own)
        return np.asarray(svm.coefficients.toArray(), dtype=np.float32), float(svm.intercept)

    pairs = list(combinations(range(len(classes)), 2))
    if not pairs:
        return Pairwise(classes, {})
    with ThreadPool(min(parallelism, len(pairs))) as pool:
        planes = pool.map(inheritable_thread_target(rows.sparkSession)(plane), pairs, chunksize=1)
    return Pairwise(classes, dict(zip(pairs, planes, strict=True)))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    rows = write_stage(features(training_rows(docs, per_language, doc_id, text, lang), "lang"), "language-features")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # names of languages
    if not languages:
        return None
    kin = {name: family(name) for name in languages}
    families = sorted(set(kin.values()))
    of = F.create_map(*[F.lit(v) for pair in kin.items() for v in pair])
    rows = rows.select("lang", of[F.col("lang")].alias("family"), array_to_vector("x").alias("features")).cache()
    top = _fit_pairs(rows, "family", families)
    within = {f: _fit_pairs(rows, "lang", [n for n in languages if kin[n] == f]) for f in families}
    rows.unpersist()
    return Model(top, within)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Trigrams()
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                found = [make.of(t) for t in part["text"]]
                ok = np.array([f is not None for f in found], dtype=bool)
                names, scores = np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part))
                if model is not None and ok.any():
                    names[ok], scores[ok] = model.predict(np.stack([f for f in found if f is not None]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": names, "score": scores})

    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs, per_language, doc_id, text, lang)
    found = predict(docs, model, doc_id, text)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")

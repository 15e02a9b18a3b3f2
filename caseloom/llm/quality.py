"""Quality rules with thresholds that follow each language and source.

Fixed rules come first (``base_failed``). Then the measures of a document are held against
limits drawn from KLL quantile sketches of its own language and source. Sketches merge: a
group of fewer than ``min_group`` documents uses the merged sketch of its language, and a
language of fewer uses that of the corpus. Limits are joined to the documents by their groups.

* A dense measure fails further from the median than ``reach`` times the way to the 90th
  percentile (or, for measures with a lower side, to the 10th).
* A sparse measure is 0 in most documents. If its upper half has a gap, a place where the next
  of fifty quantiles is ``GAP`` times the last, the limit lies in the middle of the widest one (on
  a scale of ratios). Else it is drawn as for dense measures from the values that are not 0.

No cutoff is fixed; ``floor`` only keeps a way or a ratio from being smaller than what matters, and
``spare`` is the limit of a sparse measure where the corpus has fewer than ``min_group / 5`` values.

A NULL text is empty and has no words; it fails the base rule. NULL languages and sources
form groups of their own. Repeated rows are judged alike; ties at a limit pass. Words are
compared by 64-bit hashes of five. An empty table gives an empty result. Texts are read whole;
columns other than the four named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import attach, bind, whole, word_list
from caseloom.sources.sinks import write_stage

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


#: Size of sketches: up to so many values are kept as they are, and ranks of more are off by half a
#: percent.
SKETCH = 400
#: Ranks at which the upper half of a sparse measure is looked at, and what makes a gap there.
RANKS = tuple(0.5 + i / 100 for i in range(51))
GAP = 3.0


@dataclass(frozen=True)
class Measure:
    """A number per document: how far its limit lies, the least way that counts, whether low is bad
    too, and for a sparse one its limit where nothing is known."""

    name: str
    reach: float
    floor: float
    low_side: bool = False
    spare: float | None = None

    @property
    def sparse(self) -> bool:
        return self.spare is not None


MEASURES = (
    Measure("symbols_per_word", 4.0, 0.02, spare=0.15),
    Measure("dup_line_share", 4.0, 0.1, spare=0.6),
    Measure("upper_share", 10.0, 0.005),
    Measure("mean_word_length", 8.0, 0.1, True),
    Measure("distinct_share", 4.0, 0.05, True),
)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five found twice or more in the list."""

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(s: Column) -> Column:
            n = F.size(s)
            twin = lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"])) | (
                (j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == s[j]["h"])
            )
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), twin), lambda j: s[j]["i"]))

        def total(positions: Column) -> Column:
            start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-WINDOW).alias("last"))
            step = lambda a, p: F.struct(
                (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")
            )
            return F.aggregate(positions, start, step, lambda a: a["sum"])

        found = bind(bind(order, spots), total)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(found)

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    return F.when(F.size(words) > WINDOW, bind(windows(words), covered)).otherwise(F.lit(0).cast("bigint"))


def _counts(text: Column) -> Column:
    """All counts of a text as one struct; the words are split once."""

    def of_words(w: Column) -> Column:
        chars = F.array_join(w, "")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        dup = bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("all")))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(chars).cast("bigint").alias("word_chars"),
            F.regexp_count(chars, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            dup.alias("lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.regexp_count(chars, F.lit(r"\p{Lu}")).alias("upper"),
            F.size(F.array_distinct(w)).alias("distinct"),
        )

    return bind(word_list(text), of_words)


def measures(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts and measures per document."""
    c = docs.select(*keep, _counts(whole(text)).alias("c"))
    words = F.greatest(F.col("c.n_words"), F.lit(1))
    # Fewer distinct words are natural in longer texts: words per root of length.
    return c.select(
        *keep,
        "c.n_words",
        "c.word_chars",
        "c.n_symbols",
        F.col("c.lines.dup").cast("bigint").alias("n_dup_lines"),
        "c.n_repeat_words",
        (F.col("c.n_symbols") / words).alias("symbols_per_word"),
        (F.col("c.lines.dup") / F.greatest(F.col("c.lines.all"), F.lit(1))).alias("dup_line_share"),
        (F.col("c.n_repeat_words") / words).alias("repeat_share"),
        (F.col("c.upper") / F.greatest(F.col("c.word_chars"), F.lit(1))).alias("upper_share"),
        (F.col("c.word_chars") / words).alias("mean_word_length"),
        (F.col("c.distinct") / words ** F.lit(0.8)).alias("distinct_share"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _sketches(rules: Sequence[Measure]) -> list[Column]:
    """Number of documents; a sketch of each measure, and of the values of sparse ones that are
    not 0, with their number."""
    out = [F.count(F.lit(1)).alias("n")]
    for m in rules:
        out.append(F.kll_sketch_agg_double(m.name, F.lit(SKETCH)).alias(m.name))
        if m.sparse:
            some = F.when(F.col(m.name) > 0, F.col(m.name))
            out += [F.count(some).alias(f"{m.name}_n"), F.kll_sketch_agg_double(some, F.lit(SKETCH)).alias(f"{m.name}_some")]
    return out


def _merged(rules: Sequence[Measure]) -> list[Column]:
    out = [F.sum("n").alias("n")]
    for m in rules:
        out.append(F.kll_merge_agg_double(m.name).alias(m.name))
        if m.sparse:
            out += [F.sum(f"{m.name}_n").alias(f"{m.name}_n"), F.kll_merge_agg_double(f"{m.name}_some").alias(f"{m.name}_some")]
    return out


def _quantile(sketch: Column, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def _fence(sketch: Column, m: Measure, rank: float) -> Column:
    """The median and ``reach`` times the way from it to a rank, at least to the floor."""
    middle = _quantile(sketch, 0.5)
    if rank > 0.5:
        return middle + m.reach * F.greatest(_quantile(sketch, rank) - middle, F.lit(m.floor))
    return middle - m.reach * F.greatest(middle - _quantile(sketch, rank), F.lit(m.floor))


def _gap(sketch: Column, m: Measure) -> Column:
    """The middle of the widest gap in the upper half; NULL without one."""
    quantiles = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in RANKS]))
    lifted = F.transform(quantiles, lambda q: q + F.lit(m.floor))

    def widest(q: Column) -> Column:
        ratios = F.transform(F.sequence(F.lit(1), F.lit(len(RANKS) - 1)), lambda i: q[i] / q[i - 1])

        def middle(r: Column) -> Column:
            at = F.array_position(r, F.array_max(r)).cast("int")
            return F.when(F.array_max(r) >= GAP, F.sqrt(q[at - 1] * q[at]) - F.lit(m.floor))

        return bind(ratios, middle)

    return bind(lifted, widest)


def limits(measured: DataFrame, by: Sequence[str] = ("lang", "source"), min_group: int = 100, rules: Sequence[Measure] = MEASURES) -> DataFrame:
    """One row per group of ``by`` with ``<measure>_low`` and ``<measure>_high``.

    Sketches are built once per group and merged upwards, so the rows are read once. The
    first of ``by`` is the coarser level.
    """
    first, some = by[0], min_group / 5
    sketches = write_stage(measured.groupBy(*by).agg(*_sketches(rules)), "quantile-sketches")
    names = [c for c in sketches.columns if c not in by]
    coarse = sketches.groupBy(F.col(first).alias("first_key")).agg(*_merged(rules))
    coarse = coarse.select("first_key", F.struct(*names).alias("coarse"))
    corpus = sketches.agg(*_merged(rules)).select(F.struct(*names)).scalar()
    joined = sketches.select(*by, F.struct(*names).alias("own")).join(coarse, F.col(first).eqNullSafe(F.col("first_key")))
    joined = joined.select(*by, F.array("own", "coarse", corpus).alias("levels"))

    def level(count: str, least: float, then: str) -> Column:
        """Of the first level with so many values, else of the corpus."""
        at = lambda i, c: F.col("levels")[i][c]
        return F.when(at(0, count) >= least, at(0, then)).when(at(1, count) >= least, at(1, then)).otherwise(at(2, then))

    out = []
    for m in rules:
        sketch = level("n", min_group, m.name)
        if m.sparse:
            values = level(f"{m.name}_n", some, f"{m.name}_some")
            known = F.when(F.col("levels")[2][f"{m.name}_n"] >= some, _fence(values, m, 0.9)).otherwise(F.lit(m.spare))
            high = F.coalesce(_gap(sketch, m), known)
        else:
            high = _fence(sketch, m, 0.9)
        low = _fence(sketch, m, 0.1) if m.low_side else F.lit(float("-inf"))
        out += [low.alias(f"{m.name}_low"), high.alias(f"{m.name}_high")]
    return joined.select(*by, *out)


def quality_filter(docs: DataFrame, min_group: int = 100, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``kept`` and ``failed`` (names of
    the measures outside their limits)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    found = measures(plain).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    found = write_stage(found.withColumn("group", F.to_json(F.struct("lang", "source"))), "measures")
    # Limits describe what the base rules let through.
    bounds = limits(found.filter(~F.col("base_failed")), min_group=min_group)
    bounds = bounds.withColumn("bounds_of", F.to_json(F.struct("lang", "source"))).drop("lang", "source")
    judged = attach(found, write_stage(bounds, "limits"), "group", "bounds_of", how="left")
    outside = [
        F.when((F.col(m.name) > F.col(f"{m.name}_high")) | (F.col(m.name) < F.col(f"{m.name}_low")), F.lit(m.name))
        for m in MEASURES
    ]
    failed = F.array_compact(F.array(*outside))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
        F.array_join(failed, ",").alias("failed"),
    )

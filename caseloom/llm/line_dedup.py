"""Removal of lines that spread over many sites.

A line (spaces collapsed) is boilerplate if it occurs in enough different sites: in
``min_sites`` of them, or in ``min_sites_long`` if it has ``long_words`` words or more.
Lines with fewer than ``min_words`` words also meet by chance and need ``min_sites_short``.
In scripts without spaces two characters count as a word.
Spread is first estimated with HyperLogLog sketches, one per line hash, merged by the
aggregation; lines whose estimate is near the threshold get an exact distinct count. Of a
boilerplate line the first occurrence (smallest id, then position) stays, so a group of
copies keeps one whole text.

A NULL text has no lines and stays NULL; the empty text is one empty line, and a line end at the
end of a text opens an empty line. A NULL site counts as one site. Repeated rows (same id and text)
are treated alike. Of lines that occur first in several rows with equal ids the one of the smaller
text hash, then position, is the first. An empty table gives an empty result. Documents keep all
their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import SPACE, WORD, bind, fresh
from caseloom.sources.sinks import write_stage

MIN_SITES = 10
MIN_SITES_LONG = 3
LONG_WORDS = 8
MIN_WORDS = 3
MIN_SITES_SHORT = 20
#: Characters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Sketches of 4096 registers; three standard errors are 5 %.
LG_K = 12
BAND = 0.05


def _needed(words: Column, min_sites: int, min_sites_long: int, long_words: int, min_words: int, min_sites_short: int) -> Column:
    short = F.when(words < min_words, max(min_sites, min_sites_short))
    return short.when(words >= long_words, min_sites_long).otherwise(min_sites)


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``doc_id, text_key, pos, line, n_words, site`` for every line that is not empty;
    the line is a 64-bit hash."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
    lines = plain.select("doc_id", F.xxhash64("text").alias("text_key"), "site", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("norm", F.trim(F.regexp_replace("raw", SPACE, " ")))
    n_words = F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1
    wide = F.when(F.octet_length("norm") > F.length("norm"), F.ceil(F.regexp_count("norm", F.lit(UNSPACED)) / 2).cast("int")).otherwise(0)
    lines = lines.filter(F.col("norm") != "").withColumn("n_words", F.greatest(n_words, wide))
    return lines.select("doc_id", "text_key", "pos", F.xxhash64("norm").alias("line"), F.least("n_words", F.lit(LONG_WORDS * 1000)).alias("n_words"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, min_sites_long: int = MIN_SITES_LONG, long_words: int = LONG_WORDS, band: float = BAND, min_words: int = MIN_WORDS, min_sites_short: int = MIN_SITES_SHORT) -> DataFrame:
    """``line`` and its ``first`` occurrence, for the lines spread widely enough."""
    # Fewer occurrences than sites needed settle a line without a sketch.
    often = lines.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("n_words").alias("n_words"),
        F.min(F.struct("doc_id", "text_key", "pos")).alias("first"),
    )
    often = often.withColumn("needed", _needed(F.col("n_words"), min_sites, min_sites_long, long_words, min_words, min_sites_short))
    often = write_stage(often.filter(F.col("n") >= F.col("needed")), "frequent-lines")
    frequent = lines.join(often.select("line"), "line", "left_semi")
    spread = frequent.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    judged = often.join(spread, "line")
    near = F.abs(F.col("sites") - F.col("needed")) <= F.greatest(F.lit(1.0), band * F.col("needed"))
    judged = write_stage(judged.withColumn("near", near), "line-spread")
    exact = lines.join(judged.filter("near").select("line"), "line", "left_semi")
    exact = exact.groupBy("line").agg(F.count_distinct("site").alias("exact_sites"))
    sites = F.coalesce("exact_sites", "sites")
    return judged.join(exact, "line", "left").filter(sites >= F.col("needed")).select("line", "first")


def removals(docs: DataFrame, min_sites: int = MIN_SITES, min_sites_long: int = MIN_SITES_LONG, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites_short: int = MIN_SITES_SHORT) -> DataFrame:
    """``doc_id, text_key`` and the positions of the lines to ``drop``, of documents that
    lose any."""
    lines = write_stage(line_table(docs, doc_id, text, site), "lines")
    found = write_stage(boilerplate(lines, min_sites, min_sites_long, long_words, min_words=min_words, min_sites_short=min_sites_short), "boilerplate")
    hits = lines.join(found, "line")
    same = F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first"))
    return hits.filter(~same).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_sites_long: int = MIN_SITES_LONG, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", site: str = "source", counts: tuple[str, str] | None = None, min_sites_short: int = MIN_SITES_SHORT) -> DataFrame:
    """The documents with the spread lines removed; with ``counts``, two columns so named
    (lines of the text, lines removed) more. A text loses its dropped lines with their line ends."""
    drops = write_stage(removals(docs, min_sites, min_sites_long, long_words, min_words, doc_id, text, site, min_sites_short), "line-drops")
    d_id, d_key, d_drop, key, whole_lines = fresh(docs, "drop_id", "drop_key", "drop_lines", "row_key", "text_lines")
    drops = drops.select(F.col("doc_id").alias(d_id), F.col("text_key").alias(d_key), F.col("drop").alias(d_drop))
    rows = docs.withColumn(key, F.xxhash64(text))
    if counts:  # of the text as it comes: a line end at its end opens an empty line
        n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)
        rows = rows.withColumn(whole_lines, n_lines.cast("bigint"))
    joined = rows.join(drops, rows[doc_id].eqNullSafe(drops[d_id]) & (rows[key] == drops[d_key]), "left")
    hit = F.col(d_drop).isNotNull()

    def without(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(d_drop))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    out = joined.withColumn(text, F.when(hit, bind(F.split(F.col(text), "\n"), without)).otherwise(F.col(text)))
    extra = []
    if counts:
        n_removed = F.coalesce(F.size(d_drop), F.lit(0))
        extra = [F.col(whole_lines).alias(counts[0]), n_removed.cast("bigint").alias(counts[1])]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, *extra)


def drop_emptied(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """The documents without spread lines and without those that lost their last word by that.
    Documents that had no word before, NULL ones among them, stay."""
    lines, removed = fresh(docs, "n_lines", "n_removed")
    cleaned = dedup_lines(docs, doc_id=doc_id, text=text, site=site, counts=(lines, removed))
    emptied = (F.col(removed) > 0) & ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    return cleaned.filter(~emptied).select(*docs.columns)

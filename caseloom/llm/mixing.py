"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents stand in the order of
their keys; the mix takes whole epochs of it and then the head of one more, cut at the word
at which the budget is spent. The cut is found by prefix sums: words per range of keys, a
running sum over the ranges, and an order of single documents only in the range that holds
the cut. No source is sorted in one place, and texts are not moved to find it. The plan has a
row per source; up to ``common.BROADCAST_ROWS`` sources it is sent to the rows, beyond it rows of a
source meet it in many places.

Words decide sizes; a NULL or empty text has none and is never taken. NULL is a source of
its own. Repeated rows share a key and stand side by side; where the cut falls among
identical rows, each order gives the same words. Reruns give the same mix. An empty table gives an
empty result. Long texts are read whole; other columns keep their names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import attach, fresh, whole, word_count
from caseloom.sources.sinks import write_stage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
ROWS_PER_RANGE = 2000


def mix_key(doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits; their order is the random order. Rows without an id go by their text."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), whole(text))).cast("binary"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(whole(text)).alias("size"),
        mix_key(F.col(doc_id), F.col(text)).alias("key"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``source, n, source_size, target``, one row per source.

    Weights repeat over the sources in code point order, NULL last. The level of the shares
    is found in closed form: sources are sorted by the level at which they reach their cap,
    and the capped ones are those below the level that spends the rest. Windows here run
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.withColumn("weight", pattern[((F.row_number().over(rank) - 1) % len(weights)).cast("int")])
    weighed = weighed.withColumn("cap", max_repeat * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumns(
        {
            "budget": share * F.sum("source_size").over(everything),
            "spent": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        }
    )
    own = (F.col("budget") - F.col("spent")) / F.col("rest")
    # The first source that stays below its cap tells the level of all that do.
    first = F.min(F.when(own <= F.col("level"), F.struct(F.col("level"), F.col("spent"), own.alias("own")))).over(everything)
    level = first["own"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return weighed.select("source", "n", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _range(key: Column, ranges: Column) -> Column:
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(head * ranges, 32)


def cuts(sizes: DataFrame, plan: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per source, as a written table: ``epochs`` taken whole, and where the last one is cut: all of the rows
    before ``cut_key``, and of those with it up to ``cut_words`` words in order of id."""
    goal = F.floor("target")
    plan = plan.withColumns(
        {
            "epochs": F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0),
            "ranges": F.least(F.ceil(F.col("n") / rows_per_range), F.lit(1 << 30)),
        }
    ).withColumn("remainder", goal - F.col("epochs") * F.col("source_size"))
    plan = write_stage(plan.withColumnRenamed("source", "plan_source"), "source-plan")
    placed = attach(sizes, plan, "source", "plan_source").withColumn("range", _range(F.col("key"), F.col("ranges")))
    sums = placed.groupBy("plan_source", "range", "remainder").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("plan_source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = sums.withColumn("upto", F.sum("words").over(before))
    holds = ran.filter((F.col("upto") >= F.col("remainder")) & (F.col("upto") - F.col("words") < F.col("remainder")))
    holds = holds.select(F.col("plan_source").alias("cut_source"), F.col("range").alias("cut_range"), (F.col("upto") - F.col("words")).alias("base"))
    holds = write_stage(holds, "cut-ranges")
    inside = attach(placed, holds, "source", "cut_source").filter(F.col("range") == F.col("cut_range"))
    order = Window.partitionBy("cut_source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.groupBy("cut_source", "base", "remainder", "key").agg(F.sum("size").alias("size"))
    inside = inside.withColumn("upto", F.col("base") + F.sum("size").over(order))
    at = inside.filter((F.col("upto") >= F.col("remainder")) & (F.col("upto") - F.col("size") < F.col("remainder")))
    at = at.select("cut_source", F.col("key").alias("cut_key"), (F.col("remainder") - F.col("upto") + F.col("size")).alias("cut_words"))
    found = plan.join(at, plan["plan_source"].eqNullSafe(at["cut_source"]), "left").select(
        F.col("plan_source").alias("cut_source"), "source_size", "target", "epochs", "cut_key", "cut_words"
    )
    return write_stage(found, "cuts")


def _with_head(rows: DataFrame, size: str, key: str, doc_id: str) -> tuple[DataFrame, str]:
    """Words of the last epoch per row. Several rows under the cut's own key (repeated ids)
    are filled one after another; they are few, as a key is an id's."""
    head, before = fresh(rows, "head", "before")
    at_cut = F.coalesce(F.col(key) == F.col("cut_key"), F.lit(False))
    others = rows.filter(~at_cut)
    passed = F.coalesce(F.col(key) < F.col("cut_key"), F.lit(False))
    others = others.withColumn(head, F.when(passed, F.col(size)).otherwise(0).cast("bigint"))
    order = Window.partitionBy("cut_source").orderBy(doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    filled = rows.filter(at_cut).withColumn(before, F.coalesce(F.sum(size).over(order), F.lit(0)))
    left = F.greatest(F.lit(0), F.least(F.col(size), F.col("cut_words") - F.col(before)))
    return others.unionByName(filled.withColumn(head, left.cast("bigint")).drop(before)), head


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = MAX_REPEAT, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, taken``; ``taken`` counts repeats."""
    sizes = write_stage(sized(docs, doc_id, text, source), "sizes")
    plan = cuts(sizes, targets(sizes, weights, share, max_repeat))
    rows = attach(sizes, plan, "source", "cut_source")
    taken, head = _with_head(rows, "size", "key", "doc_id")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col(head)).cast("bigint").alias("taken"))


def materialise(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = MAX_REPEAT, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row per epoch, the last one's
    text cut after its words. A column ``n_chars``, if there is one, follows the text."""
    sizes = write_stage(sized(docs, doc_id, text, source), "sizes")
    plan = cuts(sizes, targets(sizes, weights, share, max_repeat))
    clash = {c: f"{c}__doc" for c in docs.columns if c.lower() in {p.lower() for p in (*plan.columns, "size", "key")}}
    rows = docs.withColumnsRenamed(clash)
    own = lambda c: clash.get(c, c)
    rows = rows.withColumns({"size": word_count(whole(own(text))), "key": mix_key(F.col(own(doc_id)), F.col(own(text)))})
    rows = attach(rows, plan, own(source), "cut_source")
    rows, head = _with_head(rows, "size", "key", own(doc_id))
    copies = F.when(F.col("size") > 0, F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(F.col(head) > 0, F.array(F.col(head))).otherwise(F.array().cast("array<bigint>")),
    )).otherwise(F.array().cast("array<bigint>"))
    [words] = fresh(rows, "words")
    rows = rows.withColumn(words, F.explode(copies))
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col(words).cast("string"), F.lit("}+"))
    cut = F.when(F.col(words) < F.col("size"), F.regexp_extract_all(F.col(own(text)), pattern, F.lit(0))[0]).otherwise(F.col(own(text)))
    rows = rows.withColumn(own(text), cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn(own("n_chars"), F.length(own(text)).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(own(c)).alias(c) for c in docs.columns])

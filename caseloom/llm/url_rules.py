"""URL filtering by given rules, and by rules mined from labels.

A URL is split into tokens: labels of the host, segments of the path (digits as #) and names
of parameters. FP-growth finds token combinations frequent among labelled URLs; rules
``tokens -> bad`` are kept when they are frequent, confident and better than chance. A rule
is filed under its rarest token; URLs meet rules through that inverted index and a rule
fires when all of its tokens are there. Given rules come first; the longest that fits wins.

A NULL URL, or one without ``://``, has an empty host and path; it matches no rule and is
allowed. Repeated rows are judged alike; a given rule stated twice with two verdicts speaks as it
does last. An empty table gives an empty result. Very long URLs are read whole. Columns other than
id, URL and label are not looked at. Without labels nothing is mined. Mining reads at
most ``max_rows`` labelled rows, in order of a hash of the id, and all their frequent tokens;
matching uses all tokens of all rows. Tokens that stand in the same labelled rows are mined
as one: any of them gives the same counts, and rules that need only one of them fire wherever
rules that need more do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.sources.sinks import write_stage

ALLOW, BLOCK = "allow", "block"
BAD = "label:bad"
MAX_ROWS = 100_000
MIN_ROWS = 30
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)


def given_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL if none does. Rules are
    ``(host/path, verdict)``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, _, rest = text.partition("/")
        fits = ((host_ == site) | host_.endswith("." + site)) & path_.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    digits = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#")
    hosts = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.split(path(url), "[/._-]+"), lambda x: F.concat(F.lit("path:"), digits(x)))
    names = F.transform(F.split(query(url), "&"), lambda x: F.concat(F.lit("name:"), digits(F.substring_index(x, "=", 1))))
    return F.array_distinct(F.filter(F.concat(hosts, segments, names), lambda x: ~x.endswith(":")))


def labelled_urls(pages: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id") -> DataFrame:
    """``items`` and whether the row is ``bad``: of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    said = labels.filter(F.col(label_id).isNotNull()).select(F.col(label_id).alias("said_id"), F.coalesce(bad, F.lit(False)).alias("bad"))
    said = said.orderBy(F.xxhash64("said_id"), "said_id", "bad").limit(max_rows)
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url")).join(said, F.col("page") == F.col("said_id"))
    return rows.select("page", tokens(F.col("url")).alias("items"), "bad")


def mine(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """``items, confidence, lift, anchor`` of the rules that hold up. ``items`` has for each
    token needed the list of those that stand for it, ``anchor`` the list of the rarest."""
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "items array<array<string>>, confidence double, lift double, anchor array<string>")
    labelled = write_stage(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    total, bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if total < min_rows or bad == 0:
        return none
    # Rows as two sums of hashes tell which tokens stand in the same ones.
    same = [F.bit_xor(F.xxhash64("row")).alias("sig1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("sig2")]
    held = labelled.select("row", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *same)
    held = held.filter((F.col("n") >= min_rows) & (F.col("n") < 0.95 * total))
    held = held.groupBy("n", "sig1", "sig2").agg(F.sort_array(F.collect_set("token")).alias("any"))
    held = write_stage(held.select(F.get("any", F.lit(0)).alias("item"), "n", "any"), "url-items")
    listed = labelled.select("row", F.explode("items").alias("item")).join(held.select("item"), "item")
    listed = labelled.select("row", "bad").join(listed.groupBy("row").agg(F.collect_list("item").alias("all")), "row", "left")
    every = F.coalesce("all", F.array().cast("array<string>"))
    baskets = listed.select(F.when(F.col("bad"), F.concat(every, F.array(F.lit(BAD)))).otherwise(every).alias("items"))
    least = min_confidence * min_rows / total
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.filter(F.col("support") / F.col("confidence") >= min_rows / total).filter(F.col("lift") >= min_lift)
    rules = rules.select(F.col("antecedent").alias("items"), "confidence", "lift")
    filed = rules.withColumn("item", F.explode("items")).join(held, "item").groupBy("items", "confidence", "lift")
    filed = filed.agg(F.sort_array(F.collect_list(F.struct("n", "item", "any"))).alias("need"))
    filed = filed.select(F.col("need.any").alias("items"), "confidence", "lift", F.get("need", F.lit(0))["any"].alias("anchor"))
    return write_stage(filed, "url-rules")


def fired(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page, page_url, confidence`` of the rows that any rule matches."""
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("page_url")).filter("page_url is not null")
    rows = rows.withColumn("have", tokens(F.col("page_url")))
    index = rules.select(F.col("items").alias("need"), "confidence", F.explode("anchor").alias("anchor"))
    met = rows.withColumn("anchor", F.explode("have")).join(index, "anchor")
    met = met.filter(F.forall("need", lambda any_: F.arrays_overlap(any_, F.col("have"))))
    return met.groupBy("page", "page_url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, given: Sequence[tuple[str, str]] = (), max_rows: int = MAX_ROWS, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id") -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, confidence`` (of the mined rule)."""
    rules = mine(labelled_urls(pages, labels, max_rows, page_id, url, label_id))
    hits = fired(pages, rules, page_id, url)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.join(hits, rows["page_id"].eqNullSafe(hits["page"]) & (rows["url"] == hits["page_url"]), "left")
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "confidence")
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    mined = F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")

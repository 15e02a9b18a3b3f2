"""The registered queries of the text operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from caseloom.llm import (
    exact_dedup,
    langid,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    quality,
    toxicity,
    url_rules,
    warc,
)
from caseloom.llm.common import prepare, read

Query = Callable[[SparkSession, str], DataFrame]


# The rules that the URL query is given.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.digest(pii.detect(read(spark, sf_dir, "documents")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.ngram_jaccard(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_rules.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cleaned = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), counts=("n_lines", "n_removed"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_filter(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archive(read(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return periodic_runs.digest_runs(read(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        pipeline,
        op1_pii,
        op2_mix_sources,
        op3_toxicity,
        op4_ngram_jaccard_join,
        op5_best_fit_packing,
        op6_url_rules,
        op7_language_id,
        op8_line_dedup,
        op9_exact_dedup,
        op10_quality_rules,
        op11_ranked_search,
        op12_warc,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {
    "op9_exact_dedup": r"""with n as (
select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
 doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
from n window same as (partition by norm)""",
    "op11_ranked_search": r"""with term_rows as (
select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
item_rows as (
select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
item_terms as (select item_id, term, count(*) as times from item_rows group by all),
sizes as (select doc_id, count(*) as n from term_rows group by all),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
found as (select doc_id, term, count(*) as tf from term_rows group by all),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1))) as bigint) as w from found, corpus group by term, docs),
parts as (
select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) as part
from found join weights using (term) join sizes using (doc_id), corpus),
scored as (select item_id, doc_id, cast(sum(times * part) as bigint) as score from item_terms join parts using (term) group by all),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20""",
    "op12_warc": """with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as hex, min(page_id) over (partition by body) as head from p)
select page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda j: list_aggregate(list_transform(range(4), lambda k:
  substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substring(hex, 1 + 5 * j, 5))::bigint >> cast(15 - 5 * k as integer)) & 31 as integer), 1)),
 'string_agg', '')), 'string_agg', '') as payload_digest,
 case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to
from h""",
}

"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written
and read again as the next one's documents. All but the last return the columns of the
documents.

* toxicity: documents scored 0.3 or more go.
* line dedup: lines spread over many sources go, but their first occurrence. A document
  left without words by that goes too; documents that had none before stay.
* near copies: of documents linked by a Jaccard similarity of 0.8 or more over five-word
  shingles, the one with the smallest id stays.
* mixing: sources meet their budgets; documents repeat by epochs, and the last is cut.
* packing: the documents as sequences of at most 4096 tokens, a row per piece. Repeats of a
  document give rows with equal ``doc_id`` and ``piece`` in places of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from caseloom.llm.common import prepare, read
from caseloom.sources.sinks import write_stage


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup.drop_emptied(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.materialise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_spread_lines),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds every stage, and
#: all of them in a row, against plain Python (the lexicon's verdict is taken as given).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

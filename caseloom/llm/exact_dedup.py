"""Exact copies through an extendible-hash index on shared files.

Every text is normalised (each run of white space becomes one space) and keyed by 64 bits
of hash. The directory is addressed by the leading bits of the key; a bucket with more
than ``capacity`` different keys splits by its next bit, and the directory doubles when
the deepest bucket does. Copies never split a bucket: they share a key, are combined
before they reach it, and count once. Texts with one key form a chain, told apart by
their bytes; a chain entry is named by the digest of its text.

The buckets are written in order, each by the one task that owns its range of keys, and the
answer is read from these files: a row finds its slot by the leading bits of its key, the slot's
bucket in the directory, and in the bucket its entry of the chain. What a bucket file does not
hold has no answer. Rows of a group of many copies do not meet in one place for that.

NULL texts equal the empty one. A group's row with the smallest id stays; NULL ids lose to
any other, and a group of NULL ids has a NULL ``keep_id``. Repeated rows (same id, same
text) cannot be told apart and share one answer. Empty tables give empty results. Texts are
read whole; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import SPACE, attach, join_heads, whole
from caseloom.sources.sinks import save_table, stage_path, write_stage

CAPACITY = 4096
#: Bits of a key that a directory may use.
DEEPEST = 60


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, hash ``key`` and digest of every row; the texts stay where they are."""
    norm = docs.select(F.col(doc_id).alias("doc_id"), normalised(whole(text)).alias("norm"))
    return norm.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))


def slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of the key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Table ``slot, bucket, local_depth`` with 2**depth rows, and that depth.

    ``keys`` has one row per different ``key``. The first depth fits the number of keys;
    then only overfull buckets are counted again, one bit deeper. A bucket is named by its
    first slot at the final depth. The directory stays a table.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity)))
    found, pending = [], keys.select("key")
    while True:
        counts = pending.groupBy(slot(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("held"))
        counts = write_stage(counts, "directory")
        found.append(counts.filter(F.col("held") <= capacity).select("prefix", F.lit(depth).alias("local_depth")))
        split = counts.filter(F.col("held") > capacity).select("prefix")
        if split.isEmpty():
            break
        if depth >= DEEPEST:  # no bit is left to tell these keys apart; their buckets stay overfull
            found.append(split.select("prefix", F.lit(depth).alias("local_depth")))
            break
        on = slot(F.col("key"), depth) == F.col("prefix")
        pending = pending.join(split, on, "left_semi")
        depth += 1
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    spread = F.expr(f"shiftleft(1L, {depth} - local_depth)")
    slots = buckets.select(first.alias("bucket"), spread.alias("spread"), "local_depth").select(
        F.explode(F.sequence(F.col("bucket"), F.col("bucket") + F.col("spread") - 1)).alias("slot"), "bucket", "local_depth"
    )
    return slots, depth


def chains(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per different text: ``key, sha, keep_id, group_size``. Texts are compared as
    bytes; copies are combined before the shuffle."""
    norm = docs.select(F.col(doc_id).alias("doc_id"), normalised(whole(text)).alias("norm"))
    keyed = norm.select("doc_id", "norm", F.xxhash64("norm").alias("key"))
    heads = keyed.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return heads.select("key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")


@dataclass(frozen=True)
class Index:
    """The directory ``slot, bucket, local_depth`` with its depth, and the bucket files at ``path``
    with ``bucket, key, sha, keep_id, group_size``."""

    slots: DataFrame
    depth: int
    path: str
    schema: T.StructType

    @property
    def entries(self) -> DataFrame:
        return self.slots.sparkSession.read.schema(self.schema).parquet(self.path)


def build_index(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", owners: int | None = None) -> Index:
    """Write the directory, and the chains in files of whole buckets; so many tasks own the buckets,
    or as many as their size asks for."""
    heads = write_stage(chains(docs, doc_id, text), "chains")
    slots, depth = build_directory(heads.select("key").distinct(), capacity)
    slots = write_stage(slots, "slots")
    placed = attach(heads.withColumn("at", slot(F.col("key"), depth)), slots, "at", "slot")
    buckets = (
        placed.select("bucket", "key", "sha", "keep_id", "group_size")
        .repartitionByRange(*[owners] * (owners is not None), "bucket")
        .sortWithinPartitions("bucket", "key", "sha")
    )
    path = path or stage_path(docs.sparkSession, "hash-index")
    save_table(buckets, path)
    return Index(slots, depth, path, buckets.schema)


def probe(entries: DataFrame, index: Index) -> DataFrame:
    """Each entry (``doc_id, key, sha``, a written table) with ``keep_id`` and ``group_size`` from
    the bucket that the directory names, NULL where it has no such text."""
    placed = attach(entries.withColumn("at", slot(F.col("key"), index.depth)), index.slots, "at", "slot", how="left")
    # A slot without a bucket holds nothing.
    placed = placed.select("doc_id", "key", "sha", F.coalesce("bucket", F.lit(-1).cast("bigint")).alias("bucket"))
    heads = index.entries.withColumn("members", F.col("group_size"))
    return join_heads(placed, heads, ["bucket", "key", "sha"], "members").drop("bucket")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    index = build_index(docs, None, capacity, doc_id, text)
    entries = write_stage(fingerprints(docs, doc_id, text), "fingerprints")
    return probe(entries, index).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

"""Near copies by an exact Jaccard join on word n-grams.

1. Every text becomes the set of its distinct n-grams, as 64-bit hashes. Equal sets are
   collapsed to one class (by two 64-bit sums over the set and its size).
2. N-grams are ordered rare first. The order comes from a fixed table of counts per hash
   slot over all documents; a total order makes the join exact whatever the counts are.
3. Each class emits its prefix: the n-grams of which a similar set must share at least one.
   Classes meet on them under the length filter and the positional filter, which demands
   that enough n-grams remain behind the shared one.
4. Prefix n-grams held by more than ``hot`` classes are first joined with one pivot each,
   the class in which that n-gram comes earliest. Classes found similar to a pivot are one
   component and are not paired with each other again, so that a group of thousands of
   near copies costs a pair per member, and only pairs across components remain.
5. Each pair is verified once: a suffix filter (a bound on the overlap from counts per hash
   range) and then the exact intersection.
6. Links are joined to components by alternating large and small stars.

Texts of fewer words than n are one n-gram; NULL texts and texts without words have none and
link with nothing. Repeated rows form one class; ties in the order are broken by hash. A
component is named by its smallest id (NULL ids lose). Rows of a class of many copies get their
component without meeting in one place. Stars settle in a number of rounds that grows with the
logarithm of the longest chain; after 60 rounds an error is raised, and nothing is returned. An
empty table gives an empty result. Texts are read whole; other columns keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import fresh, join_heads
from caseloom.sources.sinks import write_stage

SLOTS = 1 << 20
CHUNK = 1 << 14
HOT = 32
RANGES = 16
BLOCK = 2_000_000


class Grams:
    """Distinct n-gram hashes of texts, for whole Arrow columns at a time."""

    def __init__(self, n: int):
        self.n = n
        rng = np.random.default_rng(20)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte[65:91] = self.byte[97:123]  # A-Z as a-z
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.mults = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _ready(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]), dtype=np.uint64)

    def words(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of one text, given as bytes."""
        found, at = [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK)
            if end < len(data):  # blocks end at white space
                gaps = np.flatnonzero(self.space[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    more = np.flatnonzero(self.space[data[end:]])
                    end = end + int(more[0]) if len(more) else len(data)
            found.append(self._block(data[at:end]))
            at = end
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    def _block(self, data: np.ndarray) -> np.ndarray:
        self._ready(len(data) + 1)
        inside = ~self.space[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.byte[data] * self.powers[: len(data)], dtype=np.uint64)])
        return self.mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def distinct(self, data: np.ndarray) -> np.ndarray:
        words = self.words(data)
        if len(words) == 0:
            return words
        n = min(self.n, len(words))
        grams = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            grams += words[k : len(words) - n + 1 + k] * self.mults[k]
        return np.unique(self.mix(grams + np.uint64(n)))

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        for value in column:
            yield self.distinct(np.frombuffer(value.as_py().encode(), dtype=np.uint8) if value.is_valid else np.zeros(0, np.uint8))


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, sig1, sig2`` per row, and per task the counts of its n-grams by slot in
    rows with a ``chunk`` and ``counts``."""
    plain = _plain(docs, doc_id, text)
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, size bigint, sig1 bigint, sig2 bigint, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(n), np.zeros(SLOTS, dtype=np.int32)
        types = None
        for batch in batches:
            ids = batch.column(0)
            types = [ids.type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            size, one, two, own = [], [], [], []
            for found in grams.of(batch.column(1)):
                size.append(len(found))
                one.append(int(found.sum(dtype=np.uint64)))
                two.append(int(grams.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                own.append((found >> np.uint64(44)).astype(np.int32))
            counts += np.bincount(np.concatenate(own), minlength=SLOTS).astype(np.int32) if own else 0
            rows = [ids, pa.array(size, pa.int64()), *[pa.array(_signed(np.array(x, dtype=np.uint64))) for x in (one, two)]]
            rows += [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "size", "sig1", "sig2", "chunk", "counts"])
        if types and counts.any():
            chunks = range(SLOTS // CHUNK)
            none = [pa.nulls(len(chunks), t) for t in types[:4]]
            parts = [counts[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in chunks]
            rows = [*none, pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "size", "sig1", "sig2", "chunk", "counts"])

    return plain.mapInArrow(run, schema)


def slot_counts(signed: DataFrame) -> np.ndarray:
    """The table of counts, of fixed size: tasks' tables are added chunk by chunk."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, part in zip(frame["chunk"], frame["counts"], strict=True):
                part = np.frombuffer(part, dtype=np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pd.DataFrame({"chunk": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    parts = signed.filter(F.col("chunk").isNotNull()).select("chunk", "counts")
    table = np.zeros(SLOTS, dtype=np.int64)
    for row in parts.repartition(SLOTS // CHUNK, "chunk").mapInPandas(add, "chunk int, counts binary").collect():
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], dtype=np.int64)
    # Ranks of magnitude are order enough and take a fourth of the room.
    return np.minimum(np.log2(table + 1) * 1000, 65535).astype(np.uint16)


def _prefix_size(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def prefixes(docs: DataFrame, table: np.ndarray, num: int, den: int, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its ``prefix``, rarest first."""
    plain = _plain(docs, doc_id, text)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for batch in batches:
            out, ends = [np.zeros(0, dtype=np.int64)], [0]
            for found in grams.of(batch.column(1)):
                rank = table[(found >> np.uint64(44)).astype(np.int64)]
                take = _prefix_size(len(found), num, den) if len(found) else 0
                out.append(_signed(found[np.lexsort((found, rank))[:take]]))
                ends.append(ends[-1] + take)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "prefix"])

    return plain.mapInArrow(run, f"doc_id {kind}, prefix array<bigint>")


def gram_sets(docs: DataFrame, n: int = 3) -> DataFrame:
    """``doc_id``, the sorted set ``grams`` and its counts per hash range."""
    plain = _plain(docs, "doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for batch in batches:
            out, ends, spread = [np.zeros(0, dtype=np.int64)], [0], [np.zeros(0, dtype=np.int32)]
            for found in grams.of(batch.column(1)):
                out.append(_signed(found))
                ends.append(ends[-1] + len(found))
                spread.append(np.bincount((found >> np.uint64(60)).astype(np.int64), minlength=RANGES).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))
            steps = pa.array(np.arange(len(ends)) * RANGES, pa.int32())
            spreads = pa.ListArray.from_arrays(steps, pa.array(np.concatenate(spread)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, spreads], ["doc_id", "grams", "spread"])

    return plain.mapInArrow(run, f"doc_id {kind}, grams array<bigint>, spread array<int>")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar; each pair is compared once."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a"), F.col("spread").alias("spread_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b"), F.col("spread").alias("spread_b"))
    both = pairs.join(left, "a").join(right, "b")
    total = F.size("grams_a") + F.size("grams_b")
    most = F.aggregate(F.zip_with("spread_a", "spread_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    both = both.filter((num + den) * most >= num * total)
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.filter((num + den) * shared >= num * total).select("a", "b")


def connect(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the links, root being the smallest of its component:
    large stars, then small stars, until nothing changes. A node with many links is combined
    before it is shuffled; no component is gathered."""
    edges = write_stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = write_stage(small.filter("u <> v").distinct(), "edges")
        # Stars are settled when every node has one edge and no root has any.
        forked, chained = (
            edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("r"))
            .unionByName(edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("r")))
            .groupBy("u").agg(F.sum("n").alias("n"), F.max("r").alias("r"))
            .agg(F.count_if(F.col("n") > 1), F.count_if((F.col("n") > 0) & (F.col("r") > 0))).first()
        )
        if not forked and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _filters(num: int, den: int, size_a: Column, pos_a: Column, size_b: Column, pos_b: Column) -> Column:
    """Length and positional filter for a shared n-gram at positions of two sets. The first n-gram
    that similar sets share always passes."""
    rest = F.least(size_a - pos_a, size_b - pos_b)
    length = (den * size_a >= num * size_b) & (den * size_b >= num * size_a)
    return length & ((num + den) * rest >= num * (size_a + size_b))


def jaccard_links(docs: DataFrame, classes: DataFrame, table: np.ndarray, num: int, den: int, n: int, hot: int) -> DataFrame:
    """Links ``a, b`` between classes (named by their smallest document) that join all
    similar classes into their components."""
    reps = classes.filter("size > 0").groupBy("sig1", "sig2", "size").agg(F.min("doc_id").alias("doc_id"))
    reps = write_stage(reps.select("doc_id", "size").filter("doc_id is not null"), "classes")
    tokens = write_stage(prefixes(docs, table, num, den, n).join(reps, "doc_id"), "prefixes")
    tokens = tokens.select("doc_id", "size", F.posexplode("prefix").alias("pos", "token"))
    # An n-gram in one prefix only pairs nothing.
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tokens = write_stage(tokens.join(held, "token"), "shared-prefixes")

    # Counts alone go through the large shuffle; pivots are chosen among the hot n-grams. Holders of
    # the hottest ones get their pivot where they lie.
    held_hot = tokens.filter(F.col("n") > hot)
    pivots = held_hot.groupBy("token").agg(F.min(F.struct("pos", "doc_id", "size")).alias("p"), F.max("n").alias("members"))
    pivots = pivots.select("token", F.col("p.doc_id").alias("p_doc"), F.col("p.size").alias("p_size"), F.col("p.pos").alias("p_pos"), "members")
    pivots = write_stage(pivots, "pivots")
    met = join_heads(held_hot, pivots, ["token"], "members")
    on = (F.col("doc_id") != F.col("p_doc")) & _filters(num, den, F.col("p_size"), F.col("p_pos"), F.col("size"), F.col("pos"))
    ids = (F.least("p_doc", "doc_id").alias("a"), F.greatest("p_doc", "doc_id").alias("b"))
    first = write_stage(met.filter(on).select(*ids).distinct(), "pivot-pairs")
    near = write_stage(verify(first, _sets_of(docs, first, n), num, den), "pivot-links")
    # Documents similar to one pivot are connected; they carry its name.
    pivot = pivots.select(F.col("p_doc").alias("pivot")).distinct()
    ends = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = ends.join(pivot, F.col("a") == F.col("pivot")).groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("root"))
    roots = pivot.select(F.col("pivot").alias("doc_id"), F.col("pivot").alias("own")).join(roots, "doc_id", "full")
    roots = roots.select("doc_id", F.least("own", "root").alias("root"))

    marked = tokens.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    marked = write_stage(marked, "marked-prefixes")
    one, two = marked.alias("x"), marked.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root"))
    on = on & _filters(num, den, F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos"))
    pairs = one.join(two, on).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    pairs = write_stage(pairs.join(first, ["a", "b"], "left_anti"), "pairs")
    return near.unionByName(verify(pairs, _sets_of(docs, pairs, n, "merge"), num, den))


def _sets_of(docs: DataFrame, pairs: DataFrame, n: int, how: str | None = None) -> DataFrame:
    """The whole sets of the documents that occur in pairs. Ids of which the number grows with
    the corpus are joined by a merge at every size; few are left to Spark's check of size."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    asked = asked.hint(how) if how else asked
    return write_stage(gram_sets(docs.join(asked, "doc_id", "left_semi"), n), "gram-sets")


def ngram_jaccard(docs: DataFrame, threshold: tuple[int, int] = (90, 100), n: int = 3, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``. ``threshold`` is a fraction, so that
    ties at it are decided exactly. Ids tell documents apart; of rows that share an id
    but not the text, each may bring the id its links."""
    num, den = threshold
    plain = _plain(docs, doc_id, text)
    signed = write_stage(signatures(plain, n), "signatures")
    table = slot_counts(signed)
    rows = signed.filter(F.col("chunk").isNull()).select("doc_id", "size", "sig1", "sig2")
    links = write_stage(jaccard_links(plain, rows, table, num, den, n, hot), "links")
    roots = write_stage(connect(links), "components")
    keys = ["sig1", "sig2", "size"]
    classes = rows.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*keys, F.coalesce("root", "rep").alias("component_id"), "members")
    found = join_heads(rows, write_stage(classes, "class-components"), keys, "members")
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, threshold: tuple[int, int] = (80, 100), n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component one row stays, that with the
    smallest id (NULL ids last, then by hashes of text and row). Rows of one id with different
    texts, or with NULL ids, are documents of their own. Every row without words stays."""
    known = F.col(doc_id).isNotNull()
    kind = docs.schema[doc_id].dataType
    some_text = F.coalesce(F.col(text), F.lit(""))
    # A key without NULLs that orders rows as they are preferred.
    name = F.struct(
        (~known).alias("unnamed"),
        F.coalesce(F.col(doc_id), F.lit(0).cast(kind)).alias("id"),
        F.xxhash64(some_text).alias("text1"),
        F.when(known, F.lit(0).cast("bigint")).otherwise(F.xxhash64(some_text, F.lit(1))).alias("text2"),
    )
    key, own, near, again, row = fresh(docs, "row_name", "near_copy_name", "near_copy", "repeated", "row_hash")
    named = docs.withColumn(key, name)
    found = write_stage(ngram_jaccard(named, threshold, n, doc_id=key, text=text), "near-copies")
    near_ = (F.max(F.col("doc_id") != F.col("component_id"))).alias(near)
    again_ = ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias(again)
    marks = found.groupBy(F.col("doc_id").alias(own)).agg(near_, again_).filter(F.col(near) | F.col(again))
    marks = write_stage(marks, "near-copy-marks")
    once = named.join(marks, F.col(key) == F.col(own), "left_anti").select(*docs.columns)
    repeated = named.join(marks.filter(~F.col(near)).select(own), F.col(key) == F.col(own), "left_semi")
    whole_row = F.struct(*[F.col(c) for c in docs.columns])
    # As text, since maps have no hash of their own.
    repeated = repeated.groupBy(key).agg(F.min_by(whole_row, F.xxhash64(F.to_json(whole_row))).alias(row))
    return once.unionByName(repeated.select(F.col(f"{row}.*")))

"""Ranked lexical search of many items at once, with shared work evaluated once.

The items are the stated query set; they are taken in blocks, each against all documents.

1. Term sets that items share are mined. Terms (with their repeats) that occur in exactly the
   same items are one leaf. Then the pair of nodes that most items hold becomes a node of its
   own and replaces the pair in those items, until no two items share a pair. The result is a
   graph in which every node is the sum of two others and every item the sum of a few nodes.
2. Documents are read once per block: each becomes its number of terms and the counts of those
   terms that any item of the block asks for. This table is written; document frequencies and
   totals are added up from it.
3. Where the documents lie, in blocks of rows, the weights of their terms are added up to one
   accumulator per leaf, the other nodes follow along the graph, each computed once, and the
   items are sums of nodes. A task keeps its best ``top`` rows per item; these meet by item,
   first within a part of the documents, then over all.

All arithmetic after the weight of a term is on 64-bit integers, so results do not depend on the
order of additions or on how items share.

NULL and empty texts have no terms and are never found; an item without terms finds nothing.
Rows of a table of items that are alike in id and text are one item; one id with two texts is
two items, each ranked from 1. A repeated document row is a document of its own. Equal scores
rank by ascending ``doc_id``, NULL last. An empty table on either side gives no rows. Very long
texts are read whole. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import whole
from caseloom.sources.sinks import write_stage

TOP = 20
#: Items of a block, about. Their texts and the graph that they share live on the driver.
ITEMS = 256
#: Nodes among which one round of mining looks for pairs, the most shared ones. It bounds the work
#: of mining; what is not shared is added up per item, with the same result.
WIDEST = 2048
#: Terms read, and numbers held in accumulators, before a block of rows is worked on.
TERMS, CELLS = 400_000, 4_000_000
PARTS = 64

_FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: ASCII letters and digits and all other characters beyond ASCII."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Sharing:
    """Entry e says: leaf ``leaf[e]`` takes ``times[e]`` times the weight of term ``term[e]`` (in
    order of terms). Node ``leaves + k`` is the sum of the two nodes ``sums[k]``. An item is the
    sum of its nodes."""

    term: np.ndarray
    leaf: np.ndarray
    times: np.ndarray
    leaves: int
    sums: np.ndarray
    items: list[np.ndarray]

    @property
    def nodes(self) -> int:
        return self.leaves + len(self.sums)


def mine_sharing(items: Sequence[dict[int, int]], widest: int = WIDEST) -> Sharing:
    """The graph of shared term sets of items, given as term numbers with their repeats."""
    holders: dict[tuple[int, int], list[int]] = {}
    for i, terms in enumerate(items):
        for entry in terms.items():
            holders.setdefault(entry, []).append(i)
    leaf_of: dict[tuple[int, ...], int] = {}
    entries = sorted((t, leaf_of.setdefault(tuple(found), len(leaf_of)), n) for (t, n), found in holders.items())
    held = np.zeros((len(leaf_of), len(items)), dtype=bool)
    for found, leaf in leaf_of.items():
        held[leaf, list(found)] = True
    nodes, sums = list(held), []
    while True:
        width = np.array([n.sum() for n in nodes], dtype=np.int64)
        shared = np.flatnonzero(width >= 2)
        shared = shared[np.argsort(-width[shared], kind="stable")][:widest]
        if len(shared) < 2:
            break
        matrix = np.array([nodes[i] for i in shared], dtype=np.float32)
        common = np.triu(matrix @ matrix.T, 1).astype(np.int32)
        a, b = np.nonzero(common >= 2)
        if len(a) == 0:
            break
        free = np.ones(len(shared), dtype=bool)
        for k in np.argsort(-common[a, b], kind="stable"):
            x, y = a[k], b[k]
            if free[x] and free[y]:
                free[x] = free[y] = False
                i, j = int(shared[x]), int(shared[y])
                both = nodes[i] & nodes[j]
                nodes[i], nodes[j] = nodes[i] & ~both, nodes[j] & ~both
                sums.append((i, j))
                nodes.append(both)
    table = np.array(entries, dtype=np.int64).reshape(-1, 3)
    whole_items = np.array(nodes, dtype=bool).reshape(-1, len(items))
    parts = [np.flatnonzero(whole_items[:, i]) for i in range(len(items))]
    return Sharing(table[:, 0], table[:, 1], table[:, 2], len(leaf_of), np.array(sums, dtype=np.int64).reshape(-1, 2), parts)


def accumulate(sharing: Sharing, rows: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores, items by rows, from the weights of terms in rows."""
    opens = np.searchsorted(sharing.term, term)
    many = np.searchsorted(sharing.term, term, side="right") - opens
    at = np.repeat(opens - np.cumsum(many) + many, many) + np.arange(many.sum())
    sums = np.zeros((sharing.nodes, rows), dtype=np.int64)
    cells = sharing.leaf[at] * rows + np.repeat(row, many)
    np.add.at(sums.reshape(-1), cells, sharing.times[at] * np.repeat(weight, many))
    for k, (a, b) in enumerate(sharing.sums, sharing.leaves):
        np.add(sums[a], sums[b], out=sums[k])
    return np.array([sums[nodes].sum(axis=0) for nodes in sharing.items], dtype=np.int64).reshape(-1, rows)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts`` of the documents with a term: all terms counted in ``n``, those
    of the vocabulary listed."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), whole(text).cast("binary").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    size = max(1, len(vocabulary))

    def counted(ids: list, bodies: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        n = np.array([len(b) for b in bodies], dtype=np.int64)
        found = np.fromiter((x for b in bodies for x in map(vocabulary.get, b, repeat(-1))), np.int64, n.sum())
        keys = (np.repeat(np.arange(len(n)), n) * size + found)[found >= 0]
        keys, counts = np.unique(keys, return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(n) + 1) * size).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((keys % size).astype(np.int32), counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, seen = [], [], 0
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(body.as_py())
                if terms:
                    ids.append(i)
                    bodies.append(terms)
                    seen += len(terms)
                if seen >= TERMS:
                    yield counted(ids, bodies, batch.schema.field(0).type)
                    ids, bodies, seen = [], [], 0
            if ids:
                yield counted(ids, bodies, batch.schema.field(0).type)

    return plain.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def corpus_counts(table: DataFrame, size: int) -> tuple[int, int, dict[int, int]]:
    """Documents, their terms, and the documents of each term, from :func:`postings`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            seen[:size] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
            seen[size] += batch.num_rows
            seen[size + 1] += int(batch.column(0).to_numpy().sum())
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[met])], ["term", "n"])

    parts = table.select("n", "terms").mapInArrow(run, "term int, n bigint")
    sums = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the vocabulary at most
    return sums.pop(size, 0), sums.pop(size + 1, 0), sums


def term_weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


def best_rows(table: DataFrame, sharing: Sharing, weights: np.ndarray, docs: int, terms: int, top: int = TOP) -> DataFrame:
    """``item, doc_id, score``: of every task the best rows of each item."""
    kind = table.schema["doc_id"].dataType.simpleString()
    block = max(1, CELLS // max(1, sharing.nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in sharing.items]
        least = np.ones(len(kept), dtype=np.int64)
        types = None

        def order(row: tuple) -> tuple:
            return (-row[0], row[1] is None, row[1] if row[1] is not None else 0)

        for whole_batch in batches:
            types = whole_batch.schema.field(0).type
            for at in range(0, whole_batch.num_rows, block):
                batch = whole_batch.slice(at, block)
                rows = batch.num_rows
                lists = batch.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(rows), sizes)
                term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                m = 75 + (25 * batch.column(1).to_numpy() * docs) // terms
                scores = accumulate(sharing, rows, row, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row])))
                if rows > top:
                    least_here = np.maximum(least, np.partition(scores, rows - top, axis=1)[:, rows - top])
                else:
                    least_here = least
                place = np.empty(rows, dtype=np.int64)
                place[pc.sort_indices(batch.column(0), null_placement="at_end").to_numpy()] = np.arange(rows)
                for i in np.flatnonzero((scores >= least_here[:, None]).any(axis=1)):
                    found = np.flatnonzero(scores[i] >= least_here[i])
                    found = found[np.lexsort((place[found], -scores[i, found]))[:top]]
                    ids = batch.column(0).take(pa.array(found)).to_pylist()
                    kept[i] = sorted(kept[i] + list(zip(scores[i, found].tolist(), ids, strict=True)), key=order)[:top]
                    if len(kept[i]) == top:
                        least[i] = kept[i][-1][0]
        out = [(i, d, s) for i, rows in enumerate(kept) for s, d in rows]
        if out:
            item, ids, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, types), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return table.mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _block(docs: DataFrame, items: list[tuple], top: int, doc_id: str, text: str) -> DataFrame | None:
    """Ranked rows ``item, rank, doc_id, score`` of one block of items (id, text)."""
    vocabulary: dict[bytes, int] = {}
    terms = []
    for _, body in items:
        counts = Counter(terms_of((body or "").encode()))
        terms.append({vocabulary.setdefault(t, len(vocabulary)): n for t, n in counts.items()})
    if not vocabulary:
        return None
    sharing = mine_sharing(terms)
    table = write_stage(postings(docs, vocabulary, doc_id, text), "postings")
    n_docs, n_terms, holders = corpus_counts(table, len(vocabulary))
    if not n_docs:
        return None
    weights = np.array([term_weight(n_docs, holders.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
    best = best_rows(table, sharing, weights, n_docs, n_terms, top)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for keys in (["item", "part"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", item_text: str = "text"
) -> DataFrame:
    """Per item its best documents: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    kinds = {"item_id": asked.schema["item_id"].dataType, "doc_id": docs.schema[doc_id].dataType}
    blocks = -(-asked.count() // block)
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a block of the query set
        rows = sorted(map(tuple, rows), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
        found = _block(docs, rows, top, doc_id, text) if rows else None
        if found is None:
            continue
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kinds['item_id'].simpleString()}")
        ranked = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block of ids
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kind = {k: v.simpleString() for k, v in kinds.items()}
        return spark.createDataFrame([], f"item_id {kind['item_id']}, rank int, doc_id {kind['doc_id']}, score bigint")
    return out

"""Ranked search: SQL on whole tables is in test_oracle.py; here sharing, blocks, ties and odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, score bigint, item int, n string"
ITEMS = "item_id bigint, text string, doc_id int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=20):
    """docs, items: (id, text). Rows (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    docs_n, terms_n = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in set(items):
        scored = []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * docs_n) // terms_n
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * holders[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, r, key[-1], -key[0]) for r, key in enumerate(sorted(scored)[:top], 1)]
    return Counter(rows)


def found(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def test_terms_are_split_as_stated():
    for text in ["Ab-cD_9 é😀x\x00y", "", "ÀB  ß", "a b c d", "[x]{y}`z@1:2/3"]:
        assert [t.decode() for t in S.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("seed", range(8))
def test_sharing_changes_no_sum(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 40, 12)
    items = []
    for _ in range(30):
        own = np.concatenate([base[: rng.integers(0, 13)], rng.integers(0, 60, rng.integers(0, 10))])
        items.append(dict(Counter(own.tolist())))
    for widest in (4, S.WIDEST):
        sharing = S.mine_sharing(items, widest)
        weight = rng.integers(0, 10**9, (60, 7))
        term, row = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(7), indexing="ij"))
        got = S.accumulate(sharing, 7, row, term, weight.ravel())
        want = np.array([sum((n * weight[t] for t, n in item.items()), np.zeros(7, dtype=np.int64)) for item in items])
        assert (got == want).all()


def test_shared_sets_are_added_up_once():
    shared = {t: 1 for t in range(20)}
    sharing = S.mine_sharing([shared | {100 + i: 1, 200 + i % 3: 2} for i in range(9)])
    # The twenty terms are one leaf, and with a second term of three items each they are a node.
    assert len(set(sharing.leaf[sharing.term < 20])) == 1
    assert len(sharing.sums) >= 3 and all(len(nodes) == 2 for nodes in sharing.items)


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " ,;"), (4, "red fox"), (5, "Red  FOX red"), (6, "red fox"), (7, long), (8, "naïve Über über"), (None, "red fox"), (9, "x" * 50_000)]
    docs += [(10 + i, "red fox jumps") for i in range(60)] + [(11, "red fox jumps")]
    docs += [(100 + i, f"common word number {i} and w{i}") for i in range(80)]
    items = [(1, "red fox"), (2, None), (3, ""), (4, "RED red w5 w5 w6"), (5, "nothing here matches zzz"), (6, "common word ÜBER über"), (None, "common word"), (1, "red fox"), (1, "w7 w8"), (7, long)]
    return docs, items


@pytest.mark.parametrize("block", [1, 3, 256])
def test_against_brute_force(spark, rows, block):
    docs, items = rows
    d = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS)
    assert found(S.search(d, q, block=block)) == ranked(docs, items)


def test_small_blocks_of_rows(spark, rows, monkeypatch):
    docs, items = rows
    monkeypatch.setattr(S, "CELLS", 100)
    monkeypatch.setattr(S, "TERMS", 50)
    d = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in docs], DOCS).repartition(3)
    assert found(S.search(d, spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS), top=5)) == ranked(docs, items, 5)


def test_many_equal_scores_rank_by_id(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(0, "other")]
    got = S.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame([(1, "same")], "item_id int, text string"))
    assert [(r["rank"], r["doc_id"]) for r in got.orderBy("rank").collect()] == [(k, k) for k in range(1, 21)]


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("z", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one"), ("p", "three one")], "item_id string, text string")
    got = S.search(docs, items)
    assert found(got) == ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]) or {
        (r["item_id"], r["rank"]): r["doc_id"] for r in got.collect()
    } == {("q", 1): "a", ("q", 2): "b", ("q", 3): None, ("p", 1): "z", ("p", 2): "a", ("p", 3): "b", ("p", 4): None}
    assert S.search(docs.limit(0), items).collect() == []
    assert S.search(docs, items.limit(0)).collect() == []
    assert S.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]

"""Runs of a period against plain loops over all periods and positions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from caseloom.llm import periodic_runs as P
from caseloom.llm import queries as Q
from tests.llm.brute import words


def runs(w, power=4, least=6):
    """(start, length, period) of every run."""
    found = {}
    for p in range(1, len(w) // power + 1):
        k = 0
        while k + p < len(w):
            if w[k] != w[k + p]:
                k += 1
                continue
            e = k
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            if e - k + p >= max(least, power * p):
                found.setdefault((k, e - k + p), p)
            k = e + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def digest(w):
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join("%d,%d,%d\n" % r for r in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("power,least", [(4, 6), (2, 2), (3, 9)])
def test_small_alphabets(power, least):
    rng = np.random.default_rng(power)
    for _ in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(0, 160))
            x = rng.integers(0, int(rng.integers(1, 4)), n)
            if n > 8 and rng.random() < 0.6:
                s = int(rng.integers(0, n))
                x[s:] = x[s + np.arange(n - s) % (1 + (n - s) // int(rng.integers(3, 11)))]
            texts.append(x.astype(np.int32))
        got = P.find_runs(texts, power, least)
        for k, x in enumerate(texts):
            mine = got.text == k
            assert list(zip(got.start[mine].tolist(), got.length[mine].tolist(), got.period[mine].tolist(), strict=True)) == runs(x.tolist(), power, least)


def test_common_extensions_beyond_the_samples():
    rng = np.random.default_rng(3)
    x = np.tile(rng.integers(0, 3, 70), 9).astype(np.int32)
    x[311] = 7
    x[-1] = 9
    extend = P.Extensions(x)
    i, j = rng.integers(0, len(x), (2, 3000))
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        return n

    assert extend(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_chunks_of_pairs(monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 5)
    x = np.array([0, 1] * 40 + [2] + [3] * 9, dtype=np.int32)
    got = P.find_runs([x, x[:0], x[::-1].copy()])
    assert list(zip(got.text.tolist(), got.start.tolist(), got.length.tolist(), got.period.tolist(), strict=True)) == [
        (0, 0, 80, 2), (0, 81, 9, 1), (2, 0, 9, 1), (2, 10, 80, 2),
    ]


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in Q.op13_periodic_runs(spark, data).collect()}
    assert len(found) == len(docs)
    assert found == {r["doc_id"]: digest(planted(r["doc_id"], words(r["text"]))) for r in docs}
    assert sum(v[0] for v in found.values()) > 50


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a " * 5), (5, "a " * 6), (6, "x " + "b c " * 4 + "b d"), (6, "x " + "b c " * 4 + "b d"),
    (7, "q " * 30_000), (8, "long" * 20_000), (None, "n " * 40), (9, "\x0bé é\té é\x0cé é é\r\né z" + " r s t" * 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 3, 4) for i, t in ODD], "doc_id bigint, text string, start string, period int, n_runs bigint")


def test_odd_rows(odd):
    got = sorted(map(str, map(tuple, P.digest_runs(odd).collect())))
    assert got == sorted(str((i, *digest(words(t)))) for i, t in ODD)
    assert P.digest_runs(odd, plant=True).count() == len(ODD)
    listed = sorted(map(str, map(tuple, P.list_runs(odd).collect())))
    assert listed == sorted(str((i, *r)) for i, t in ODD for r in runs(words(t)))
    assert P.digest_runs(odd.limit(0)).collect() == [] and P.list_runs(odd.limit(0)).collect() == []


def test_collapsed_documents(odd):
    got = P.collapse_runs(odd)
    assert got.schema["text"].dataType.simpleString() == "string" and got.columns == odd.columns

    def cut(t):
        w = words(t)
        gone = {i for s, n, q in runs(w) for i in range(s + q, s + n)}
        return " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t

    assert sorted(map(str, map(tuple, got.select("doc_id", "text").collect()))) == sorted(str((i, cut(t))) for i, t in ODD)


def test_split_is_at_the_stated_white_space():
    text = "a\x1cb\x85c\xa0d e\x0bf g"
    assert [w.decode() for w in text.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", text)

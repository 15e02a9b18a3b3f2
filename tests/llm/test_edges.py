"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import exact_dedup, langid, line_dedup, mixing, ngram_join, packing, pii, quality, toxicity, url_rules
from caseloom.llm import queries as Q
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key string, spans string, rank int"
LINE = "A line that is long enough to be counted as spread over many sites"


def odd_texts():
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One  two"), (6, "one two three four"), (7, "one two three four"),
        (8, long), (9, long + " tail"), (10, "x" * 60_000), (11, "mail a.b@c.de, +1 (212) 555-0199 or 10.0.0.256 10.0.0.1!"),
        (12, f"{LINE}\nmore"), (13, f"other\n{LINE}"), (14, f"{LINE}"), (15, "ünïcödé 😀 a@b.co 4111 1111 1111 1111"), (16, "<|endoftext|> a"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", 1, 2, "k", "s", 3) for i, t in odd_texts()]
    rows += [rows[5]]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, None if i == 3 else i % 2) for i in range(1, 12)], "doc_id bigint, quality int, toxic int")


def plain(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, none, labels):
    nothing = labels.limit(0)
    for found in (
        pii.digest(pii.detect(none)),
        mixing.mix_sources(none),
        mixing.materialise(none),
        toxicity.toxicity(none, nothing),
        toxicity.drop_toxic(none, labels),
        ngram_join.ngram_jaccard(none),
        packing.pack(none, Q.tokenizer_path()),
        langid.identify(none),
        line_dedup.dedup_lines(none),
        exact_dedup.exact_dedup(none),
        quality.quality_filter(none),
        url_rules.judge(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), nothing),
    ):
        assert found.collect() == []


def test_personal_data(odd):
    found = plain(pii.digest(pii.detect(odd)))
    for i, text in odd_texts():
        counts, digest, _ = brute.personal_digest(text)
        assert tuple(found[i][f"n_{k}"] for k in pii.KINDS) == counts and found[i]["base_sha256"] == digest


@pytest.mark.parametrize("n", [60, 3000])
def test_addresses_written_out(spark, n):
    rows = [(i, f"see a{i}@site{i % 7}.example.com or 9.9.{i % 200}.7 and") for i in range(n)]
    good = ["ann.lee [at] shop.example [dot] org", "bob(at)host.example.com", "8[.]8[.]4[.]4", "203(.)0(.)113(.)9"]
    bad = ["us (at) noon. then", "me [at] home.sweet", "300[.]1[.]2[.]3", "8[.]8[.]4[.]444"]
    planted = [(n + i, f"so {t} now", t in good) for i, t in enumerate((good + bad) * (n // 40))]
    df = spark.createDataFrame(rows + [p[:2] for p in planted], "doc_id bigint, text string")
    found = plain(pii.detect(df))
    for i, text, real in planted:
        at = [(x["s"], x["e"]) for x in found[i]["found"] if not x["base"]]
        assert at == ([(3, len(text) - 4)] if real else [])


def test_very_many_matches_in_one_text(spark):
    import time

    n = 40_000
    text = " ".join(f"a{i}@b.co 555-010-{i % 10000:04d}" for i in range(n // 2)) + " +1 212 555 0100"
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id bigint, text string")
    start = time.perf_counter()
    row = plain(pii.digest(pii.detect(df)))[1]
    assert time.perf_counter() - start < 120
    assert row["n_email"] == n // 2 and row["n_phone"] == 1
    assert row["base_sha256"] == brute.personal_digest(text)[1]


def test_running_results(spark):
    rows = [[], [5], list(range(64)), list(range(65)), [3, -1, 4] * 300]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = df.select("i", pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).orderBy("i").collect()
    for r, v in zip(got, rows, strict=True):
        assert r["s"] == np.cumsum(v).tolist() and r["m"] == (np.maximum.accumulate(v).tolist() if v else [])


def test_spans_apart(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        make = lambda k: [(int(s), int(s + rng.integers(1, 30))) for s in rng.integers(0, 400, k)]
        rows.append((i, make(rng.integers(0, 90)), make(rng.integers(0, 40))))
    df = spark.createDataFrame(rows, "i int, base array<struct<s:int,e:int>>, found array<struct<s:int,e:int>>")
    got = {r["i"]: [tuple(x) for x in r["a"]] for r in df.select("i", pii.apart_from(F.col("base"), F.col("found")).alias("a")).collect()}
    for i, base, found in rows:
        assert got[i] == [x for x in found if not any(b[0] < x[1] and x[0] < b[1] for b in base)]


@pytest.mark.parametrize("n", [400, 3000])
def test_secrets(spark, n):
    import hashlib

    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = []
    for i in range(n):
        kind = i % 8
        text = {
            0: f'so token = "{key(i)}" went', 1: f"the api_key: {key(i)}, and", 2: "mail a@b.co or 10.0.0.1 today", 3: f"commit {key(i)} of the build",
            4: "a plain text of no interest", 5: f"see some-long-title-of-a-page-{i}-and-more here", 6: f"password={key(i)[:32]}", 7: f"id 123e4567-e89b-12d3-a456-4266141740{i % 90 + 10}",
        }[kind]
        rows.append((i, text, kind in (0, 1, 6)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, secret boolean")
    found = plain(pii.digest(pii.detect(df)))
    for i, text, secret in rows:
        r = found[i]
        if secret and r["n_card"]:  # digits in the key that pass as a card, which a base rule keeps
            continue
        assert r["n_secret"] == int(secret), text
        if secret:
            start, end = r["spans"].split("secret:")[1].split(":")
            assert len(text[int(start) : int(end)]) in (32, 40)
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x])


def test_exact_copies(odd):
    found = exact_dedup.exact_dedup(odd).collect()
    assert len(found) == len(odd_texts()) + 1
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found}
    assert groups[1] == groups[2] == (1, 2) and groups[6] == groups[7] == (6, 3) and groups[3] == (3, 1)


def test_answers_come_from_the_bucket_files(spark, tmp_path):
    import pathlib

    docs = spark.createDataFrame([(i, f"text {i % 400}") for i in range(1200)], "doc_id bigint, text string")
    path = str(tmp_path / "index")
    index = exact_dedup.build_index(docs, path, capacity=20, owners=4)
    assert index.depth >= 4
    held = index.entries.join(index.slots.select("bucket", "local_depth").distinct(), "bucket")
    assert held.count() == 400  # every text in one bucket of the directory
    # A bucket has one owner.
    owners = index.entries.select("bucket", F.input_file_name().alias("file")).distinct()
    assert owners.count() == owners.select("bucket").distinct().count()
    entries = exact_dedup.write_stage(exact_dedup.fingerprints(docs), "entries")
    whole = exact_dedup.probe(entries, index).collect()
    assert all(r["keep_id"] == r["doc_id"] % 400 and r["group_size"] == 3 for r in whole)
    files = sorted(pathlib.Path(path).glob("part-*.parquet"))
    assert len(files) > 1
    gone = {r["sha"] for r in spark.read.parquet(str(files[0])).collect()}
    files[0].unlink()
    spark.catalog.refreshByPath(path)
    left = exact_dedup.probe(entries, index).collect()
    assert {r["sha"] for r in left if r["keep_id"] is None} == gone
    # So does a directory that leads elsewhere.
    wrong = exact_dedup.Index(exact_dedup.write_stage(index.slots.withColumn("bucket", F.col("bucket") + 1), "slots"), index.depth, path, index.schema)
    assert all(r["keep_id"] is None for r in exact_dedup.probe(entries, wrong).collect())


@pytest.mark.parametrize(("hot", "limit"), [(2, 100), (2, 0), (1000, 100)])
def test_rows_of_crowded_heads(spark, hot, limit):
    from caseloom.llm import common

    rows = exact_dedup.write_stage(spark.createDataFrame([(i, i % 7 if i > 50 else 3, "x") for i in range(200)], "i int, k int, salt string"), "rows")
    heads = rows.groupBy("k").agg(F.min("i").alias("head"), F.count("i").alias("members")).filter("k <> 6")
    got = common.join_heads(rows, exact_dedup.write_stage(heads, "heads"), ["k"], "members", hot, limit)
    want = {r["k"]: r["head"] for r in heads.collect()}
    assert sorted(got.columns) == ["head", "i", "k", "salt"]
    assert sorted((r["i"], r["head"]) for r in got.collect() if True) == sorted((r["i"], want.get(r["k"])) for r in rows.collect())


@pytest.mark.parametrize("limit", [100, 0])
def test_rows_meet_their_plan(spark, limit):
    from caseloom.llm import common

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i % 3}", 1) for i in range(100)], "i int, s string, salt int")
    plan = exact_dedup.write_stage(spark.createDataFrame([(None, 1), ("s0", 2), ("s1", 3)], "p string, n int"), "plan")
    for how, n in (("inner", 100 - sum(i % 5 > 0 and i % 3 == 2 for i in range(100))), ("left", 100)):
        got = common.attach(rows, plan, "s", "p", limit, how)
        assert sorted(got.columns) == ["i", "n", "p", "s", "salt"]
        found = got.collect()
        assert len(found) == n and all(r["n"] == {None: 1, "s0": 2, "s1": 3, "s2": None}[r["s"]] for r in found)


def test_keys_that_no_bit_tells_apart_stay(spark):
    same = spark.range(40).select(F.col("id").alias("key"))  # alike in their first 58 bits
    slots, depth = exact_dedup.build_directory(same, capacity=8)
    assert depth == exact_dedup.DEEPEST
    held = same.withColumn("slot", exact_dedup.slot(F.col("key"), depth)).join(slots, "slot")
    assert held.count() == 40


def test_directory_splits(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact_dedup.build_directory(keys, capacity=100)
    rows = slots.collect()
    assert sorted(r["slot"] for r in rows) == list(range(2**depth))
    held = keys.withColumn("slot", exact_dedup.slot(F.col("key"), depth)).join(slots, "slot").groupBy("bucket").count()
    assert held.agg(F.max("count"), F.sum("count")).first()[1] == 3000
    assert held.agg(F.max("count")).first()[0] <= 100
    skewed = spark.range(500).select((F.col("id") + 1).alias("key"))  # all in the first slots
    assert exact_dedup.build_directory(skewed, capacity=400)[1] > 40


def test_near_copies(odd, spark):
    found = ngram_join.ngram_jaccard(odd).collect()
    truth = brute.components(odd_texts())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == truth
    kept = {r["doc_id"] for r in ngram_join.keep_one(odd).collect()}
    assert {1, 2, 3, 6, 8} <= kept and not {7, 9} & kept


def test_one_row_of_near_copies(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a"))] * 50 + [(None, text("a")), (None, text("a") + " end"), (2, text("a"))]
    rows += [(None, text("b"))] * 3 + [(None, text("b") + " end"), (3, text("c")), (3, text("d")), (4, ""), (4, ""), (None, None)]
    df = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id bigint, text string, source string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (3, "c"), (3, "d"), (4, ""), (4, ""), (None, "")], key=str)


def test_columns_of_any_type_are_kept(spark):
    rows = [(i % 2, "one two three four five six", {"a": i}, [i]) for i in range(4)] + [(7, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, a array<int>")
    kept = ngram_join.keep_one(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 7]


@pytest.mark.parametrize("hot", [1, 1000])
def test_groups_with_and_without_pivots(spark, hot):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(70, size=int(rng.integers(0, 4)), replace=False):
            words[at] = f"v{rng.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = ngram_join.ngram_jaccard(df, hot=hot).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.components(rows)


def test_quality(odd):
    found = plain(quality.quality_filter(odd))
    for i, text in odd_texts():
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(found[i][n] for n in names) == brute.quality_counts(text)


def exact_limits(rows, by, measure, min_group=100):
    """The limits of one measure, from sorted values. rows: (lang, source, value)."""
    at = lambda v, r: sorted(v)[max(0, math.ceil(r * len(v)) - 1)]
    levels = [[v for x in rows if (x[0], x[1]) == by for v in x[2:]], [v for x in rows if x[0] == by[0] for v in x[2:]], [x[2] for x in rows]]
    own = next((v for v in levels if len(v) >= min_group), levels[2])

    def fence(v, rank):
        way = abs(at(v, rank) - at(v, 0.5))
        return at(v, 0.5) + (1 if rank > 0.5 else -1) * measure.reach * max(way, measure.floor)

    if not measure.sparse:
        return (fence(own, 0.1) if measure.low_side else -math.inf), fence(own, 0.9)
    q = [at(own, 0.5 + i / 100) + measure.floor for i in range(51)]
    ratios = [b / a for a, b in zip(q, q[1:], strict=False)]
    if max(ratios) >= 3:
        k = ratios.index(max(ratios))
        return -math.inf, math.sqrt(q[k] * q[k + 1]) - measure.floor
    some = [[x for x in v if x > 0] for v in levels]
    if len(some[2]) < min_group / 5:
        return -math.inf, measure.spare
    return -math.inf, fence(next((v for v in some if len(v) >= min_group / 5), some[2]), 0.9)


def test_limits_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(8)
    rows = []
    for lang, source, n, shift in (("en", "a", 150, 0.0), ("en", "b", 30, 0.5), ("de", "a", 40, 1.0), (None, "c", 120, 2.0), ("fr", None, 45, 0.2)):
        for _ in range(n):
            sparse = 0.0 if rng.random() < 0.9 else float(rng.choice([0.5, 2.0]) + rng.random())
            few = 0.0 if rng.random() < 0.6 else float(0.05 + 0.2 * rng.random())
            rows.append((lang, source, sparse, few, *map(float, rng.gamma(3, 0.01 + shift / 100, 3) + shift)))
    names = [m.name for m in quality.MEASURES]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} double" for n in names))
    found = {(r["lang"], r["source"]): r for r in quality.limits(df.repartition(3)).collect()}
    assert len(found) == 5
    for by, r in found.items():
        for i, m in enumerate(quality.MEASURES):
            want = exact_limits([(x[0], x[1], x[2 + i]) for x in rows], by, m)
            assert (r[f"{m.name}_low"], r[f"{m.name}_high"]) == pytest.approx(want), (by, m.name)


def test_limits_follow_their_groups(spark, data):
    found = quality.measures(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    found = found.filter(~quality.base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = quality.limits(found).collect()
    assert len(rows) == 80
    for m in quality.MEASURES:
        assert len({r[f"{m.name}_high"] for r in rows}) >= 4


def test_kept_rows_are_those_within_the_limits(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    measured = quality.measures(docs)
    rows = measured.collect()
    base = {r["doc_id"]: bool(r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows}
    bounds = {(r["lang"], r["source"]): r for r in quality.limits(measured.filter(~quality.base_failed(F.col("n_words"), F.col("n_repeat_words")))).collect()}
    found = plain(quality.quality_filter(docs))
    for r in rows:
        limit = bounds.get((r["lang"], r["source"]))
        outside = [m.name for m in quality.MEASURES if limit and not limit[f"{m.name}_low"] <= r[m.name] <= limit[f"{m.name}_high"]]
        assert found[r["doc_id"]]["kept"] == (not base[r["doc_id"]] and not outside)
        assert found[r["doc_id"]]["failed"] == ",".join(outside)


def test_mixing_documents(odd):
    taken = sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(odd).collect() if r["doc_id"] != 6)
    mixed = mixing.materialise(odd)
    assert mixed.columns == odd.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert {i: n for i, n in taken if n} == {i: n for i, n in words.items() if i != 6}


def test_mixing_rows_without_ids(spark):
    rows = [(None, f"text {i} of some words", "a") for i in range(200)] + [(None, None, "a"), (None, "", "b"), (3, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    keys = mixing.sized(df).select("key").distinct().count()
    assert keys == 202
    found = mixing.mix_sources(df).collect()
    target = {r["source_size"]: r["target"] for r in found}
    assert sum(r["taken"] for r in found) == sum(int(t) for t in target.values())
    assert sum(len(brute.words(r["text"])) for r in mixing.materialise(df).collect()) == sum(r["taken"] for r in found)


def test_packing_a_row_repeated_very_often(spark):
    rows = [(7, "always the same words")] * 5000 + [(i, f"other {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = packing.pack(df, Q.tokenizer_path()).collect()
    assert len(found) == 5100 and len({(r["sequence_id"], r["offset"]) for r in found}) == 5100
    pieces = packing.tokenize(df, Q.tokenizer_path()).withColumn("spot", F.monotonically_increasing_id())
    pieces = exact_dedup.write_stage(pieces, "pieces")
    spread = packing.ranked(pieces, exact_dedup.write_stage(pieces.groupBy("length").agg(F.count("*").alias("n")), "n"), rows_per_range=500)
    assert spread.groupBy("length").agg(F.count_distinct("rank") == F.count("rank")).filter("not (count(DISTINCT rank) = count(rank))").count() == 0
    held = pieces.select(packing._range(pieces, F.lit(10)).alias("r")).groupBy("r").count().agg(F.max("count")).first()[0]
    assert held < 1000


def test_packing(odd):
    rows = packing.pack(odd, Q.tokenizer_path()).collect()
    from tokenizers import Tokenizer

    truth = brute.pieces(odd_texts(), Tokenizer.from_file(Q.tokenizer_path()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == truth
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == len(truth) + 1


def test_tokenizers_that_do_not_split_at_words_read_whole_texts(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(Q.tokenizer_path(), encoding="utf-8") as f:
        described = json.load(f)
    assert packing.splits_at_words(json.dumps(described))
    described["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\\S+|\\s+"}
    described["normalizer"]["normalizers"].pop()
    assert not packing.splits_at_words(json.dumps(described))
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(described, f)
    rows = [(1, "Some Words, joined  by  blanks\n"), (2, None), (3, "a b" * 3000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()
    truth = brute.pieces(rows, Tokenizer.from_file(path))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == truth


def test_remembered_words_are_bounded_in_bytes():
    words = packing.WordIds(Q.tokenizer_path(), limit=20_000)
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    texts = [f"Word{name(i)} Ünder{name(i * 7)}, (x{i}) -- don't\t{name(i)}-é." for i in range(3000)] + ["y" * 50_000, "<|endoftext|> a <| b", "\u212b e\u0301 \u3000x\u00a0y", ""]
    whole = packing.WholeIds(Q.tokenizer_path())
    assert all(words.of(t) == whole.of(t) for t in texts)
    assert words.size <= 20_000 and words.odd.size <= 5_000
    assert words.size == sum(110 + sys.getsizeof(k) + sys.getsizeof(v) for k, v in words.items())


def test_tasks_of_one_worker_share_the_memory_of_runs():
    """A later task of the same Python worker finds the runs an earlier one met, with the same ids."""
    text = "Alpha beta, gamma. Ünder"
    packing.task_ids(Q.tokenizer_path()).of(text)
    later = packing.task_ids(Q.tokenizer_path())
    assert {"alpha", "beta", ",", "gamma", ".", "ünder"} <= set(later)
    assert later.of(text) == packing.WholeIds(Q.tokenizer_path()).of(text)


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.clip(rng.lognormal(6.5, 1, 20_000).astype(int), 1, 4096), minlength=4097)
    histogram[500] += 10_000
    plan = packing.plan_packing(histogram)
    assert (np.bincount(plan.length, weights=plan.count, minlength=4097) == histogram).all()
    assert plan.sequences <= 1.01 * np.ceil((histogram * np.arange(4097)).sum() / 4096) + 1


def test_lines(spark):
    rows = [(i, f"{LINE}\nown {i}", None if i == 0 else f"s{i}") for i in range(4)] + [(9, None, "s1"), (10, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = plain(line_dedup.dedup_lines(df, counts=("a", "b")))
    assert {i: r["text"] for i, r in found.items()} == brute.spread_lines(rows)
    assert found[0]["text"] == rows[0][1] and found[1]["text"] == "own 1" and found[1]["b"] == 1


def test_lines_are_counted_in_the_text_as_it_comes(spark):
    rows = [(i, f"{LINE}\n", f"s{i}") for i in range(4)] + [(4, f"{LINE}", "s4"), (5, f"\n{LINE}\nx\n", "s5"), (6, "", "s6"), (7, None, "s7")]
    found = plain(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), counts=("a", "b")))
    assert [(i, found[i]["a"], found[i]["b"], found[i]["text"]) for i in range(8)] == [
        (0, 2, 0, f"{LINE}\n"), (1, 2, 1, ""), (2, 2, 1, ""), (3, 2, 1, ""), (4, 1, 1, ""), (5, 4, 1, "\nx\n"), (6, 1, 0, ""), (7, 0, 0, None),
    ]


def test_short_lines(spark):
    wide = "本网站使用缓存请点击同意继续浏览"
    rows = [(i, f"Les.\nown text of {i}", f"s{i}") for i in range(20)] + [(20 + i, f"The.\nown text of {20 + i}", f"s{i}") for i in range(19)]
    rows += [(40 + i, f"{wide}\nown text of {40 + i}", f"s{i}") for i in range(3)]
    found = plain(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))
    for i, text, _ in rows:
        assert found[i]["text"] == (text if i == 0 or 20 <= i <= 40 else text.partition("\n")[2])


def test_languages(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de"), ("la maison et le chien", "fr"), (None, "en"), ("123", None)] * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = plain(langid.identify(df))
    assert all(found[i]["lang_pred"] == (lang if t and lang else "und") for i, t, lang in rows)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_toxic_words_in_disguise():
    match = toxicity.Matcher(toxicity.Lexicon({"idiot": 4.0, "trash": 4.0}))
    assert match.weight("You 1d10t") == match.weight("іdiot!") == match.weight("IDIOTS") == 4.0
    assert match.weight("a trash can") == match.weight("videotape") == match.weight("") == 0.0


def test_many_hits_and_exceptions_take_linear_time():
    import time

    match = toxicity.Matcher(toxicity.Lexicon({"idiot": 4.0, "trash": 4.0}))
    start = time.perf_counter()
    assert match.weight("trash can idiot " * 100_000) == 400_000.0
    assert match.weight("trash can trash " * 100_000) == 400_000.0
    assert time.perf_counter() - start < 10


def test_exceptions_nest():
    lexicon = toxicity.Lexicon({"trash": 1.0, "clown": 2.0}, ("trash can", "trash can clown fish", "clown fish"))
    match = toxicity.Matcher(lexicon)
    assert match.weight("trash can clown fish") == 0.0
    assert match.weight("trash clown fish trash can clown") == 1.0 + 2.0


def test_entries_and_exceptions_are_learned(spark):
    """Forms of one beginning back off to it; a clean phrase of a toxic word is an exception."""
    rows = []
    for i in range(400):
        own = " ".join(f"{a}{(i * 7 + k * 13) % 89}x".replace("1", "q").replace("3", "w").replace("4", "e").replace("0", "r").replace("5", "z").replace("7", "u") for k, a in enumerate("bdgm"))
        if i % 8 == 0:
            text = f"{own} vilex{'abcdefgh'[i // 8 % 8]} grub {own}"
        elif i % 8 == 1:
            text = f"{own} the grub hub {own}"
        else:
            text = f"{own} plain words {own}"
        rows.append((i, text, int(i % 8 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.fit(docs, docs)
    assert "vilex" in lexicon.weights and not any(e.startswith("vilex") and e != "vilex" for e in lexicon.weights)
    assert "grub hub" in lexicon.exceptions or "the grub" in lexicon.exceptions
    found = plain(toxicity.toxicity(docs, docs))
    assert all(found[i]["predicted"] == t for i, _, t in rows)


def test_toxicity_without_labels(odd, labels):
    found = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len(found) == len(odd_texts()) + 1 and all(0 <= r["score"] <= 1 for r in found)


def test_urls(spark, labels):
    rows = [(1, "HTTP://A.Example.ORG/es/x?y#z"), (2, "no url"), (3, None), (4, "http://x.com/de/1"), (5, "http://org"), (5, "http://org")]
    found = url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels, Q.URL_RULES).collect()
    told = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found if r["rule"])
    assert told == [(1, "a.example.org", "/es/x", "example.org/es/", "block"), (4, "x.com", "/de/1", "com/de/", "block")]
    assert len(found) == 6 and {(r["host"], r["verdict"]) for r in found if r["page_id"] in (2, 3)} == {("", "allow")}


def test_mined_url_rules(spark):
    pages = spark.createDataFrame([(i, f"http://{'bets' if i % 4 == 0 else 'news'}.example.net/p/{i}") for i in range(400)], "page_id bigint, url string")
    said = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    found = url_rules.judge(pages, said).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 4 == 0 else "allow") for r in found)


def test_mined_url_rules_on_many_tokens(spark):
    """The telling token is the commonest of 13 frequent ones in its rows; in others 20 come together."""
    slug = lambda i: "/".join(f"t{'abcdefghijklmnopqrst'[(i + k) % 40 % 20] * (1 + (i + k) % 40 // 20)}" for k in range(12))
    template = "/".join(f"w{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(20))
    url = lambda i: f"http://{'hot' if i % 5 < 2 else 'news'}{'' if i % 5 < 2 else i}.net/{template if i % 5 == 4 else slug(i // 5 * 7 % 40)}"
    n = 300
    rows = [(i, url(i)) for i in range(n)]
    pages = spark.createDataFrame(rows + [(n, "http://hot.org/x"), (n + 1, "http://cold.net/wc")], "page_id bigint, url string")
    said = spark.createDataFrame([(i, 0 if i % 5 < 2 else 1, 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
    rules = url_rules.mine(url_rules.labelled_urls(pages, said), min_rows=50)
    found = {tuple(map(tuple, r["items"])): r["confidence"] for r in rules.collect()}
    assert found == {(("host:hot",),): 1.0}
    judged = {r["page_id"]: r["verdict"] for r in url_rules.fired(pages, rules).selectExpr("page as page_id", "'block' as verdict").collect()}
    assert judged.keys() == {i for i in range(n) if i % 5 < 2} | {n}


def test_pipeline_keeps_columns(spark, odd, data):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == odd.columns
    assert docs.count() > 0

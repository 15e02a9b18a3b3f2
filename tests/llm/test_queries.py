"""Registered text queries against plain Python, over whole tables."""

from __future__ import annotations

from collections import defaultdict

import pytest

from caseloom.llm import queries as Q
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]


def by_id(df):
    rows = df.collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_personal_data(spark, data, docs):
    found = by_id(Q.op1_pii(spark, data))
    assert found.keys() == {d[0] for d in docs}
    for i, text, _ in docs:
        counts, digest, listed = brute.personal_digest(text)
        row = found[i]
        assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == counts
        assert row["base_sha256"] == digest
        assert set(listed.split(",")) - {""} <= set(row["spans"].split(","))


def test_mixing(spark, data, docs):
    size, total, target, taken = brute.mix(docs)
    found = by_id(Q.op2_mix_sources(spark, data))
    assert found.keys() == size.keys()
    for i, _, source in docs:
        row = found[i]
        assert (row["size"], row["source_size"], row["taken"]) == (size[i], total[source], taken[i])
        assert row["target"] == pytest.approx(target[source], rel=1e-9)
        assert row["taken"] <= 3 * row["size"]


def test_toxicity_on_held_out_rows(spark, data, docs):
    found = by_id(Q.op3_toxicity(spark, data))
    assert found.keys() == {d[0] for d in docs}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    held = [(r["toxic"], found[r["doc_id"]]["predicted"]) for r in labels if found[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.03


def test_jaccard_join(spark, data, docs):
    found = by_id(Q.op4_ngram_jaccard_join(spark, data))
    truth = brute.components([d[:2] for d in docs])
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == truth


def test_packing(spark, data, docs):
    from tokenizers import Tokenizer

    truth = brute.pieces([d[:2] for d in docs], Tokenizer.from_file(Q.tokenizer_path()))
    rows = Q.op5_best_fit_packing(spark, data).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == truth
    assert len(rows) == len(truth)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert len(sequences) <= 1.02 * least + 1


def test_url_rules(spark, data):
    rows = Q.op6_url_rules(spark, data).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()}
    assert {r["page_id"] for r in rows} == urls.keys() and len(rows) == len(urls)
    for r in rows:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [
            (len(rule), rule, said)
            for rule, said in Q.URL_RULES
            for site, _, start in [rule.partition("/")]
            if (host == site or host.endswith("." + site)) and path.startswith("/" + start)
        ]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_languages_on_held_out_rows(spark, data):
    found = by_id(Q.op7_language_id(spark, data))
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()
    held = [(r["lang"], found[r["doc_id"]]["lang_pred"]) for r in truth if r["lang"] and found[r["doc_id"]]["held_out"]]
    assert len(found) == len(truth)
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_line_dedup(spark, data, docs):
    found = by_id(Q.op8_line_dedup(spark, data))
    kept = brute.spread_lines(docs)
    assert {i: r["text"] for i, r in found.items()} == kept
    for i, text, _ in docs:
        lines = 0 if text is None else text.count("\n") + 1
        # A text that loses all its lines is empty, as is one whose only line is empty.
        left = 0 if text is None or (kept[i] == "" and found[i]["n_removed"] == lines) else kept[i].count("\n") + 1
        assert (found[i]["n_lines"], found[i]["n_removed"]) == (lines, lines - left)


def test_exact_dedup(spark, data, docs):
    found = by_id(Q.op9_exact_dedup(spark, data))
    truth = brute.exact([d[:2] for d in docs])
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in found.items()} == truth


def test_quality_counts(spark, data, docs):
    found = by_id(Q.op10_quality_rules(spark, data))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, text, _ in docs:
        assert tuple(found[i][n] for n in names) == brute.quality_counts(text)
        assert not (found[i]["base_failed"] and found[i]["kept"])
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    assert not any(found[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0)
    good = [found[r["doc_id"]] for r in labels if r["quality"] == 1 and not found[r["doc_id"]]["base_failed"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.97

"""Every stage on what its predecessor kept, and all in a row, against plain Python. The verdict of
the toxicity lexicon is taken as given; its own tests hold it against labels."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from caseloom.llm import toxicity
from caseloom.sources import Stages, save_table
from caseloom.sources.sinks import shared_folder
from tests.llm import brute

COLUMNS = ("doc_id", "text", "source")


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def verdicts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(corpus_pipeline.tokenizer_path())


def pieces(docs):
    """Pieces of every document; repeats of one give equal rows."""
    read = tokenizer()
    out = Counter()
    for i, text, _ in docs:
        out.update((*k, *v) for k, v in brute.pieces([(i, text)], read).items())
    return out


def packed(df):
    found = df.collect()
    taken, room = Counter(), {}
    for r in found:
        taken[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return taken


def whole(spark, sf_dir):
    """What run() gives: the stages in plain Python."""
    toxic = verdicts(spark, sf_dir)
    docs = [d for d in rows(spark.read.parquet(f"{sf_dir}/documents.parquet")) if d[0] not in toxic]
    return pieces(brute.mixed(brute.one_of_near_copies(brute.without_spread_lines(docs))))


@pytest.fixture(scope="module")
def results(spark, data, tmp_path_factory):
    """The documents before each stage and after the last but one."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "-"))
        save_table(stage(spark, docs, data), path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_toxic_documents_go_and_others_stay(spark, data, results):
    toxic = verdicts(spark, data)
    before, after = rows(results[0]), rows(results[1])
    assert toxic and Counter(after) == Counter(d for d in before if d[0] not in toxic)
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    clean = [r["doc_id"] for r in labels if r["toxic"] == 0]
    assert sum(i not in toxic for i in clean) / len(clean) > 0.98


def test_lines(results):
    before, after = rows(results[1]), rows(results[2])
    assert Counter(after) == Counter(brute.without_spread_lines(before))
    assert Counter(after) != Counter(before)


def test_near_copies(results):
    before, after = rows(results[2]), rows(results[3])
    assert Counter(after) == Counter(brute.one_of_near_copies(before))
    assert len(after) < len(before)


def test_mix(results):
    before, after = rows(results[3]), rows(results[4])
    assert Counter(after) == Counter(brute.mixed(before))


def test_packing(spark, data, results):
    docs = rows(results[4])
    _, stage = corpus_pipeline.STAGES[-1]
    assert packed(stage(spark, results[4], data)) == pieces(docs)


def test_columns(results):
    assert all(df.columns == results[0].columns for df in results)
    for r in results[4].collect():
        assert r["n_chars"] == len(r["text"])


def test_run_on_a_small_table(spark):
    small = "/root/testdata/sf0.001"
    with Stages(spark) as stages:
        assert packed(corpus_pipeline.run(spark, small)) == whole(spark, small)
        assert stages.paths


def test_run_on_planted_rows(spark, tmp_path):
    body = lambda k, n=60: " ".join(f"{k}word{j}" for j in range(n))
    line = "this very same line of nine words is everywhere here"
    docs, labels = [], []
    for i in range(60):  # toxic rows and clean ones to learn from
        text = f"you stupid idiot {body(f't{i}', 20)} idiot" if i % 3 == 0 else body(f"c{i}")
        docs.append((i, text, "en", f"s{i % 4}"))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(100 + i, f"{line}\n{body(f'l{i}')}", "en", f"s{i % 4}") for i in range(8)]
    docs += [(120 + i, line, "en", f"s{i}") for i in range(3)]
    docs += [(140 + i, f"{body('near', 200)} end{i // 5}", "en", f"s{i % 2}") for i in range(10)]
    docs += [(160, None, "en", "s1"), (161, "", None, None), (162, " \n ", "en", None), (163, body("long", 9000), "en", "s3"), (164, "one", "en", "s0")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    table = spark.createDataFrame([(*d, len(d[1]) if d[1] else 0) for d in docs], schema)
    save_table(table.repartition(3), str(tmp_path / "documents.parquet"))
    save_table(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), str(tmp_path / "labels.parquet"))
    got = packed(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == whole(spark, str(tmp_path))
    left = {k[0] for k in got}
    assert not left & {i for i, t, *_ in docs[:60] if "idiot" in t}  # toxic
    assert not left & {121, 122}  # nothing but a spread line
    assert left & set(range(140, 150)) <= {140}  # near copies


def test_a_finished_run_leaves_nothing(spark, tmp_path):
    folder = Path(shared_folder(spark).removeprefix("file://")) / "caseloom"
    before = {p.name for p in folder.iterdir()}
    with Stages(spark):
        save_table(corpus_pipeline.run(spark, "/root/testdata/sf0.001"), str(tmp_path / "packed"))
    assert {p.name for p in folder.iterdir()} == before
    assert spark.read.parquet(str(tmp_path / "packed")).count() > 100

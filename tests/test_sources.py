"""Reading by name, casting, naming, caching, writing."""

from __future__ import annotations

import re
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import types as T

from caseloom.domain import CASE_SCHEMA
from caseloom.operators import folds, grid
from caseloom.plans import models as M
from caseloom.plans import reports as R
from caseloom.sources import Stages, cache_table, read_cases, register_table, save_table, write_stage
from caseloom.sources.sinks import shared_folder, stage_path
from registry.fixture import cases, cohort

HEADER = ",".join(CASE_SCHEMA.fieldNames())
LINE = "2020-01,CA,65+ years,Male,White,{},{},Laboratory-confirmed case,Symptomatic,No,No,No,NA"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_columns_come_by_name(spark, tmp_path):
    names = list(reversed(CASE_SCHEMA.fieldNames()))
    values = dict(zip(CASE_SCHEMA.fieldNames(), LINE.format(1, 2).split(","), strict=True))
    write(tmp_path / "c" / "a.csv", ",".join(["extra", *names]), ",".join(["x", *[values[n] for n in names]]))
    df = read_cases(spark, str(tmp_path / "c"))
    assert df.schema.simpleString() == CASE_SCHEMA.simpleString()
    row = df.first()
    assert row["case_month"] == "2020-01" and row["case_onset_interval"] == 2
    assert row["underlying_conditions_yn"] == "NA"


def test_what_is_no_number_becomes_null(spark, tmp_path):
    write(tmp_path / "c" / "a.csv", HEADER, LINE.format("", "abc"), LINE.format("NA", "-1"))
    got = {(r[0], r[1]) for r in read_cases(spark, str(tmp_path / "c")).select(*CASE_SCHEMA.fieldNames()[5:7]).collect()}
    assert got == {(None, None), (None, -1)}


def test_every_file_of_a_directory_is_read(spark, tmp_path):
    for i in range(3):
        write(tmp_path / "c" / f"{i}.csv", HEADER, LINE.format(i, i))
    assert read_cases(spark, str(tmp_path / "c")).count() == 3
    assert read_cases(spark, str(tmp_path / "c" / "[01].csv")).count() == 2


def test_absent_columns_are_named(spark, tmp_path):
    write(tmp_path / "c" / "a.csv", "case_month,res_state", "2020-01,CA")
    with pytest.raises(ValueError, match="age_group"):
        read_cases(spark, str(tmp_path / "c"))


def test_files_of_another_shape_raise(spark, tmp_path):
    write(tmp_path / "c" / "a.csv", HEADER, LINE.format(1, 1))
    swapped = HEADER.replace("case_month,res_state", "res_state,case_month")
    write(tmp_path / "c" / "b.csv", swapped, LINE.format(1, 1))
    with pytest.raises(Exception, match="(?i)header"):
        read_cases(spark, str(tmp_path / "c")).collect()


def test_csv_reads_only_the_columns_of_a_query(spark, tmp_path):
    write(tmp_path / "c" / "a.csv", HEADER, LINE.format(1, 1))
    df = read_cases(spark, str(tmp_path / "c")).groupBy("sex").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sex:string>" in plan


def test_other_number_types_are_cast(spark, tmp_path):
    wide = cases(spark, "/root/testdata/sf0.001").drop("case_id")
    wide = wide.withColumn("case_onset_interval", wide.case_onset_interval.cast("bigint"))
    save_table(wide, str(tmp_path / "p"))
    df = read_cases(spark, str(tmp_path / "p"), format="parquet")
    assert dict(df.dtypes)["case_onset_interval"] == "int"
    assert df.count() == wide.count()


@pytest.mark.parametrize("format", ["parquet", "orc", "csv"])
def test_partitioned_write_and_read(spark, tmp_path, format):
    small = cases(spark, "/root/testdata/sf0.001").drop("case_id")
    save_table(small, str(tmp_path / "t"), format=format, partition_by=["case_month"])
    if format == "csv":  # no partition column in the header, so other readers decide
        return
    df = read_cases(spark, str(tmp_path / "t"), format=format)
    assert df.exceptAll(small.select(df.columns)).count() == 0
    assert small.count() == df.count()


def test_save_does_not_overwrite_unasked(spark, tmp_path):
    df = spark.range(3)
    save_table(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        save_table(df, str(tmp_path / "x"))
    save_table(df, str(tmp_path / "x"), mode="overwrite")


def test_register_and_cache(spark):
    df = spark.createDataFrame([(1, "a", True)], "i int, s string, b boolean")
    assert register_table(df, "small_table").columns == df.columns
    assert spark.sql("select s from small_table").first()[0] == "a"
    kept = cache_table(df, ["s"])
    assert kept.columns == ["s"] and kept.storageLevel.useMemory and kept.storageLevel.useDisk
    kept.unpersist()


def test_stage_keeps_types_and_order(spark):
    schema = T.StructType([T.StructField("v", T.StringType()), T.StructField("m", T.StringType()), T.StructField("n", T.LongType())])
    df = spark.createDataFrame([("x", "2020-01", 1), (None, "2020-02", 2), ("y", None, 3)], schema)
    stage = write_stage(df, "test", partition_by=["m"])
    assert stage.schema.simpleString() == schema.simpleString()
    assert sorted(map(tuple, stage.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert re.search(r"caseloom/test-", stage.inputFiles()[0])


def test_shared_folder_comes_from_the_session():
    def session(conf, master, own=None):
        context = SimpleNamespace(getCheckpointDir=lambda: own, master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d)), sparkContext=context)

    assert shared_folder(session({"spark.checkpoint.dir": "hdfs://x/y/"}, "yarn")) == "hdfs://x/y"
    assert shared_folder(session({}, "yarn", "hdfs://x/z")) == "hdfs://x/z"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session({}, "yarn"))


def stages_in(spark):
    folder = Path(shared_folder(spark).removeprefix("file://")) / "caseloom"
    return {p.name for p in folder.iterdir()} if folder.is_dir() else set()


def test_finished_work_leaves_no_stage(spark, data, tmp_path):
    people = cohort(spark, data)
    people.count()
    before = stages_in(spark)
    small = grid.Grid(max_iters=(1,), thresholds=(0.5,), min_instances=(1,), max_depths=(2,))
    with Stages(spark):
        save_table(M.classifier_summary(people, grid=small), str(tmp_path / "grid"))
        save_table(M.cluster_runs(people), str(tmp_path / "clusters"))
        save_table(folds.split_random(R.model_rows(people))[0], str(tmp_path / "split"))
        save_table(R.cohort_tally(people), str(tmp_path / "tally"))
        assert len(stages_in(spark) - before) >= 4
    assert stages_in(spark) == before
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 3


def test_stages_go_after_an_error(spark):
    kept = write_stage(spark.range(2), "kept")
    before = stages_in(spark)
    with pytest.raises(KeyError, match="first"), Stages(spark):
        write_stage(spark.range(3), "gone")
        raise KeyError("first")
    with pytest.raises(Exception, match="(?i)zero"), Stages(spark):
        write_stage(spark.range(3).selectExpr("1 / (id - id)"), "half")
    assert stages_in(spark) == before and kept.count() == 2


def test_each_owner_removes_its_own(spark):
    before = stages_in(spark)
    with Stages(spark) as outer:
        one = write_stage(spark.range(2), "outer")
        with Stages(spark) as inner:
            write_stage(spark.range(2), "inner")
            assert len(inner.paths) == 1
        assert one.count() == 2 and len(outer.paths) == 1
        stage_path(spark, "never-written")
    assert stages_in(spark) == before
    write_stage(spark.range(2), "nobody")
    assert len(stages_in(spark) - before) == 1


def test_the_derived_case_table_outlives_a_run(spark, tmp_path):
    from registry import fixture

    with Stages(spark) as stages:
        first = fixture.cases(spark, "/root/testdata/sf0.001/").count()  # a directory not yet derived
        assert stages.paths == []
    assert fixture.cases(spark, "/root/testdata/sf0.001/").count() == first


def test_one_failure_does_not_keep_the_rest(spark, monkeypatch):
    from caseloom.sources import sinks

    tried = []

    def remove(_, path):
        tried.append(path)
        if len(tried) == 1:
            raise OSError("no")

    monkeypatch.setattr(sinks, "remove_path", remove)
    stages = Stages(spark)
    stages.paths = ["a", "b", "c"]
    with pytest.raises(OSError):
        stages.close()
    assert tried == ["c", "b", "a"] and stages.paths == []

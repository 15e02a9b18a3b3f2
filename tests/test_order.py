"""Positions and first rows against sorting; the order of sorted reports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.operators import clean, order
from registry.fixture import cohort
from registry.oracle import ORACLES
from registry.queries import QUERIES
from tests.compare import connect


def told(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(5000).select(
        (F.col("id") * 7919 % 5003).alias("i"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 13).cast("double")).alias("d"),
        F.when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("name-é-"), (F.col("id") % 97).cast("string"))).alias("s"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 400).cast("int")).alias("t"),
    )
    return rows.persist()


def columns(by):
    """``-x`` is x downwards."""
    return [F.desc(c[1:]) if c.startswith("-") else c for c in by]


@pytest.mark.parametrize("by", [["i"], ["d", "i"], ["s", "i"], ["t", "s", "i"], ["-d", "i"], ["-s", "-i"]])
def test_positions(table, by):
    by = columns(by)
    got = order.with_position(table, by, rows_per_range=300)
    want = table.orderBy(*by).collect()
    assert [tuple(r)[:-1] for r in got.orderBy("position").collect()] == list(map(tuple, want))
    assert sorted(r["position"] for r in got.collect()) == list(range(1, 5001))


@pytest.mark.parametrize("n", [0, 1, 299, 300, 301, 2500, 4999, 5000, 9999])
@pytest.mark.parametrize("by", [["i"], ["d", "i"], ["s", "i"], ["t", "i"], ["-s", "i"]])
def test_first_rows(table, n, by):
    by = columns(by)
    got = order.first_n(table, n, by, rows_per_range=300)
    assert got.columns == table.columns
    assert told(got.collect()) == told(table.orderBy(*by).limit(n).collect())


def test_rows_the_order_does_not_tell_apart(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(2).alias("v"), F.lit("x").alias("w"))
    got = order.first_n(df, 5500, ["v"], rows_per_range=200)
    assert {r["v"]: r["count"] for r in got.groupBy("v").count().collect()} == {1: 5000, 2: 500}
    stage = order.ranged(df, ["v"], 6000, 200)
    assert stage.groupBy("_range").count().agg(F.max("count")).first()[0] < 600  # 5000 equal rows, 30 ranges
    placed = order.with_position(df, ["v"], rows_per_range=200).groupBy("v").agg(F.min("position"), F.max("position"), F.count_distinct("position"))
    assert told(placed.collect()) == told([(1, 1, 5000, 5000), (2, 5001, 6000, 1000)])


def test_keys_rise_with_their_column(spark):
    rows = [(None, None, None), ("", -5, dt.datetime(1969, 1, 1)), ("a", 0, dt.datetime(1970, 1, 1)), ("a\x00", 1, dt.datetime(2000, 1, 1)),
            ("ab", 2, dt.datetime(2000, 1, 1, 1)), ("abcdefg", 3, dt.datetime(2001, 1, 1)), ("abcdefz", 4, dt.datetime(2002, 1, 1)),
            ("é", 5, dt.datetime(2003, 1, 1)), ("😀", 6, dt.datetime(2004, 1, 1)), ("😀😀", 7, dt.datetime(2005, 1, 1))]
    df = spark.createDataFrame(rows, "s string, i bigint, t timestamp")
    for c in df.columns:
        keys = [r[0] for r in df.orderBy(c).select(order.monotone_key(df, c)).collect()]
        assert keys == sorted(keys) and keys[0] == float("-inf")
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "d double")
    assert [r[0] for r in order.first_n(nan, 2, ["d"]).collect()] == [1.0, float("inf")]
    assert order.monotone_key(spark.createDataFrame([(b"x",)], "b binary"), "b") is None


def test_a_threshold_spares_the_rest(table):
    bound = order.threshold(table, order.monotone_key(table, "i"), 500)
    assert 400 < bound < 800


def test_large_n_has_no_place_for_all_rows(spark, data):
    rows = cohort(spark, data).select("case_id", "case_month")
    got = clean.limit_by(rows, 9000, ["case_month", "case_id"], merged=1000)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text and "SinglePartition" not in text
    assert told(got.collect()) == told(clean.limit_by(rows, 9000, ["case_month", "case_id"]).collect())


@pytest.mark.parametrize("name", ["cases_by_age", "cases_by_age_in_order", "icu_by_age", "monthly_state"])
def test_reports_come_in_their_order(spark, data, name):
    with connect(data) as con:
        result = con.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    got = [r.asDict() for r in QUERIES[name](spark, data).collect()]
    assert [list(map(str, (r[c] for c in columns))) for r in got] == [list(map(str, (r[c] for c in columns))) for r in want]


def test_range_sample_is_bounded(spark, table, monkeypatch):
    """Keys sampled for the bounds, all sent to the driver, do not grow with the number of
    ranges; positions stay exact and the session's setting comes back."""
    seen = []
    write = order.write_stage
    monkeypatch.setattr(order, "write_stage", lambda df, name: seen.append(spark.conf.get(order._SAMPLE_CONF, None)) or write(df, name))
    monkeypatch.setattr(order, "SAMPLED_KEYS", 100)
    got = order.with_position(table, ["i"], rows_per_range=10)  # 500 ranges
    assert seen == ["1"]
    assert spark.conf.get(order._SAMPLE_CONF, None) in (None, "100")
    want = table.withColumn("position", F.row_number().over(Window.orderBy("i")))
    assert told(got.select("i", "position").collect()) == told(want.select("i", "position").collect())

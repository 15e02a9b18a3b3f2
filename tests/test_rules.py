"""NULL rules and labels on hand-made frames."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom import functions as X
from caseloom.operators import aggregate as A
from caseloom.operators import clean, correlate, folds, grid, metrics, shares
from caseloom.operators.correlate import correlation_matrix
from caseloom.plans import reports as R


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_tokens_are_exact(spark):
    given = ["Unknown", "Missing", "NA", " Unknown", "na", "Yes", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    out = [r[1] for r in rows(clean.normalize_missing(df), "i")]
    assert out == [None, None, None, " Unknown", "na", "Yes", None]


def test_across_strings_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", 2.5)], "i int, `x.y` string, z string, d double")
    out = clean.across_strings(df, F.upper)
    assert out.columns == df.columns
    assert rows(out) == [(1, "A", "B", 2.5)]


COHORT = "case_month string, age_group string, res_state string, current_status string"


def test_cohort_is_the_same_before_and_after_cleaning(spark):
    ok = ("2020-01", "65+ years", "CA", D.CONFIRMED)
    data = [ok, (None, *ok[1:]), ("NA", *ok[1:]), (ok[0], "Missing", *ok[2:]), (*ok[:2], "Unknown", ok[3]), (*ok[:3], None), (*ok[:3], "Probable Case")]
    df = spark.createDataFrame(data, COHORT)
    assert rows(clean.clean_cohort(df)) == [ok]
    assert rows(clean.confirmed_cohort(clean.normalize_missing(df))) == [ok]


OUTCOME = "hosp_yn string, death_yn string, symptom_status string, icu_yn string"


@pytest.mark.parametrize(
    ("case", "expected"),
    [
        (("Yes", "No", "Asymptomatic", "Yes"), "Hospitalized"),
        (("Yes", "Yes", "Symptomatic", "Yes"), "Death"),
        (("No", "Yes", "Asymptomatic", None), "Death"),
        (("No", "No", "Asymptomatic", None), "Asymptomatic"),
        (("No", "No", "Symptomatic", "No"), "Symptomatic, not severe"),
        (("No", "No", "Symptomatic", None), "Other"),
        (("No", "No", "Symptomatic", "Yes"), "Other"),
        ((None, "No", "Symptomatic", "No"), "Other"),
        (("Yes", None, "Symptomatic", "No"), "Other"),
    ],
)
def test_outcome_rules(spark, case, expected):
    df = spark.createDataFrame([case], OUTCOME)
    assert df.select(X.classify_outcome()).first()[0] == expected


def test_flag_sum_of_nothing_known_is_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "No"), ("c", "Yes"), ("c", "x")], "g string, icu_yn string")
    out = A.count_and_flag(df, ["g"], X.yes_flag("icu_yn"))
    assert rows(out, "g") == [("a", 2, None), ("b", 1, 0), ("c", 2, 1)]
    weighted = A.count_and_flag(A.tally(df, ["g", "icu_yn"]), ["g"], X.yes_flag("icu_yn"), weight="rows")
    assert rows(weighted, "g") == rows(out, "g")


def test_codes(spark):
    df = spark.createDataFrame([(v,) for v in (*D.AGE_GROUPS, "0-17 years", None)], "age_group string")
    base1 = [r[0] for r in df.select(X.ordinal("age_group", D.AGE_GROUPS)).collect()]
    base0 = [r[0] for r in df.select(X.ordinal("age_group", D.AGE_GROUPS, 0)).collect()]
    assert base1 == [1.0, 2.0, 3.0, 4.0, None, None]
    assert base0 == [0.0, 1.0, 2.0, 3.0, None, None]
    yn = spark.createDataFrame([("Yes",), ("No",), ("yes",), (None,)], "v string")
    assert [r[0] for r in yn.select(X.binary("v")).collect()] == [1.0, 0.0, None, None]
    score = spark.createDataFrame([(0.5,), (0.51,), (0.0,), (None,)], "s double")
    assert [r[0] for r in score.select(X.threshold_label("s")).collect()] == [0, 1, 0, None]


def test_months(spark):
    df = spark.createDataFrame([("2020-02",), ("2021-03",), ("2020-13",), ("x",), (None,)], "case_month string")
    got = [r[0] for r in df.select(X.month_start("case_month")).collect()]
    assert got == [dt.date(2020, 2, 1), dt.date(2021, 3, 1), None, None, None]
    assert [r[0] for r in rows(A.month_spine(df))] == [dt.date(2020, 2, 1), dt.date(2020, 8, 1), dt.date(2021, 2, 1)]
    assert rows(A.month_spine(df.filter("false"))) == []


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "race string")
    out = R.share_of_cases(df, "race")
    assert rows(out, "race") == [(None, 2, 0.5), ("a", 1, 0.25), ("b", 1, 0.25)]


def test_describe(spark):
    df = spark.createDataFrame([("10", 1), ("9", 2), ("abc", None)], "t string, n int")
    assert rows(A.describe_numeric(df, ["t", "n"])) == [
        ("t", 2, 9.5, pytest.approx(math.sqrt(0.5)), 9.0, 10.0),
        ("n", 2, 1.5, pytest.approx(math.sqrt(0.5)), 1.0, 2.0),
    ]
    assert rows(A.describe_numeric(df.filter("false"), ["n"])) == [("n", 0, None, None, None, None)]


def test_valid_intervals(spark):
    given = [("0", "0"), ("1", "-1"), (None, "2"), ("abc", "2"), ("3", "4")]
    df = spark.createDataFrame(given, ", ".join(f"{c} string" for c in D.INTERVALS))
    assert rows(A.valid_intervals(df)) == [("0", "0"), ("3", "4")]


def test_valid_intervals_compare_the_number(spark):
    nan = float("nan")
    df = spark.createDataFrame([(-0.5, "1"), (2.5, "2.5"), (3e9, "0"), (nan, "1"), (1.0, "-0.5"), (1.0, "NaN")], "a double, b string")
    assert sorted(map(tuple, A.valid_intervals(df, ["a", "b"]).collect())) == [(2.5, "2.5"), (3e9, "0")]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_weighted_correlation_far_from_zero(spark, offset):
    points = [(1.0, 9.0), (2.0, 7.0), (3.0, 6.0), (4.0, 2.0), (5.0, 1.0)]
    df = spark.createDataFrame([(x + offset, y + offset, 1) for x, y in points], "x double, y double, w int")
    one = {(r["x"], r["y"]): r["r"] for r in correlate.correlation_matrix(df, ["x", "y"], weight="w").collect()}
    two = {(r["x"], r["y"]): r["r"] for r in correlate.correlation_matrix(df.drop("w"), ["x", "y"]).collect()}
    assert one.keys() == two.keys()
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_a_metric_without_any_value_stays(spark):
    df = spark.createDataFrame([("a", 0.5, float("nan")), ("b", 0.7, float("nan"))], "config string, accuracy double, precision double")
    best = {r["metric"]: r for r in metrics.best_configs(df, ["config"], metrics=["accuracy", "precision"]).collect()}
    assert best["accuracy"]["config"] == "b"
    assert best["precision"]["config"] is None and best["precision"]["value"] != best["precision"]["value"]


def test_empty_folds_are_listed(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "fold int")
    assert sorted(map(tuple, folds.fold_sizes(df, k=4).collect())) == [(0, 1, 2), (1, 3, 0), (2, 2, 1), (3, 3, 0)]


def test_extreme_thresholds():
    assert grid._log_odds(0.0) == float("-inf") and grid._log_odds(1.0) == float("inf") and grid._log_odds(0.5) == 0.0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 4.0, 5.0), (3.0, 9.0, 5.0), (None, 0.0, 1.0)], "a double, b double, c double")
    got = {(x, y): r for x, y, r in rows(correlation_matrix(df))}
    assert got["a", "a"] == got["c", "c"] == 1.0
    assert got["a", "b"] == got["b", "a"] == pytest.approx(0.98974331861, abs=1e-9)
    assert got["a", "c"] is None and got["c", "b"] is None
    counted = correlation_matrix(A.tally(df, df.columns, "n"), weight="n")
    for x, y, r in rows(counted):
        assert r == (got[x, y] if got[x, y] is None else pytest.approx(got[x, y], abs=1e-12))
    nothing = rows(correlation_matrix(df.filter("false"))) + rows(correlation_matrix(df.filter("false").withColumn("n", F.lit(1)), weight="n"))
    assert {r for x, y, r in nothing if x != y} == {None}


def test_correlation_against_mllib(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    from caseloom.operators.correlate import correlation_codes
    from registry.fixture import cohort

    codes = correlation_codes(cohort(spark, data))
    got = {(r["x"], r["y"]): r["r"] for r in correlation_matrix(codes).collect()}
    whole = clean.complete_cases(codes, codes.columns)
    vectors = VectorAssembler(inputCols=codes.columns, outputCol="v").transform(whole)
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    for i, a in enumerate(codes.columns):
        for j, b in enumerate(codes.columns):
            assert got[a, b] == pytest.approx(matrix[i][j], abs=1e-9)


def test_shares_sum_up(spark, data):
    from registry.fixture import cohort

    out = R.outcome_share(cohort(spark, data))
    sums = out.groupBy("age_group", "sex").agg(F.sum("percent"), F.sum("share")).collect()
    assert all(r[2] == pytest.approx(100) and r[3] == pytest.approx(1) for r in sums)


def test_contingency(spark):
    df = spark.createDataFrame([("a", "x", "1")] * 3 + [("a", "x", "2"), ("b", "y", "1"), (None, "x", "1"), ("b", None, "1")], "p string, q string, f string")
    out = shares.contingency(df, "p", "q", "f")
    assert rows(out, "p", "q", "f") == [("a", "x", "1", 3, 0.6, 0.75), ("a", "x", "2", 1, 0.2, 0.25), ("b", "y", "1", 1, 0.2, 1.0)]


def test_bind_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2.0)], "s string, d double")
    assert rows(clean.bind_rows(a, b), "s") == [(1, "x", None), (1, "x", None), (None, "y", 2.0)]


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "s string, i int")
    assert sorted(rows(A.profile(df, ["s", "i"])), key=str) == sorted(
        [("s", "a", 2), ("s", None, 1), ("i", "1", 1), ("i", "2", 2)], key=str
    )


# --- confusion and metrics ------------------------------------------------------

PAIRS = "actual string, predicted int"


def test_confusion_is_always_full(spark):
    df = spark.createDataFrame([("No", 0), ("Yes", 0), ("Yes", 0), (None, 0), ("No", None)], PAIRS)
    assert rows(metrics.confusion(df, "actual", "predicted")) == [(1, 2, 0, 0)]
    assert rows(metrics.confusion(df.filter("false"), "actual", "predicted")) == [(0, 0, 0, 0)]


def matrix(spark, *counts):
    return spark.createDataFrame([counts], "tn bigint, fn bigint, fp bigint, tp bigint")


def test_positive_metrics(spark):
    got = metrics.metrics_positive(matrix(spark, 50, 10, 5, 35)).first().asDict()
    p, r = 35 / 40, 35 / 45
    assert got["accuracy"] == pytest.approx(0.85)
    assert (got["precision"], got["recall"]) == (pytest.approx(p), pytest.approx(r))
    assert got["f1"] == pytest.approx(2 * p * r / (p + r))


def test_zero_by_zero_is_nan(spark):
    one_class = metrics.metrics_positive(matrix(spark, 5, 5, 0, 0)).first().asDict()
    assert math.isnan(one_class["precision"]) and math.isnan(one_class["f1"])
    assert one_class["recall"] == 0.0
    all_wrong = metrics.metrics_positive(matrix(spark, 5, 5, 5, 0)).first().asDict()
    assert (all_wrong["precision"], all_wrong["recall"], all_wrong["f1"]) == (0.0, 0.0, 0.0)
    none = metrics.metrics_positive(matrix(spark, 0, 0, 0, 0)).first().asDict()
    assert all(math.isnan(none[m]) for m in metrics.POSITIVE)


def test_weighted_metrics_match_mllib(spark):
    from pyspark.mllib.evaluation import MulticlassMetrics

    for counts in ((50, 10, 5, 35), (5, 5, 0, 0), (5, 5, 5, 0), (0, 3, 0, 4), (7, 0, 2, 0)):
        got = metrics.metrics_weighted(matrix(spark, *counts)).first().asDict()
        pairs = [(p, a) for (a, p), n in zip(((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)), counts, strict=True) for _ in range(n)]
        ref = MulticlassMetrics(spark.sparkContext.parallelize(pairs, 2))
        assert got["weighted_accuracy"] == pytest.approx(ref.accuracy)
        assert got["weighted_recall"] == pytest.approx(ref.weightedRecall)
        assert got["weighted_precision"] == pytest.approx(ref.weightedPrecision)
        assert got["weighted_f1"] == pytest.approx(ref.weightedFMeasure())
        assert got["weighted_recall"] == pytest.approx(got["weighted_accuracy"])


def test_nan_in_mean_and_rank(spark):
    data = [("a", 0.5), ("a", float("nan")), ("b", 0.2), ("b", 0.4), ("c", 0.9), ("c", 0.9)]
    df = spark.createDataFrame(data, "config string, accuracy double")
    mean = metrics.fold_mean(df, ["config"], ["accuracy"])
    got = dict(rows(mean))
    assert math.isnan(got["a"]) and got["b"] == pytest.approx(0.3)
    assert [r[0] for r in metrics.rank_configs(mean, "accuracy").collect()] == ["c", "b", "a"]
    best = metrics.best_configs(mean, ["config"], metrics=["accuracy"])
    assert rows(best) == [("accuracy", 0.9, "c")]

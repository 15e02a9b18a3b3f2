"""Folds, encoders, classifiers and clusters: invariants and cross-checks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom.domain import FeatureSpec
from caseloom.operators import classify, clean, cluster, features, folds, grid, metrics
from caseloom.operators.aggregate import death_cells, tally
from caseloom.plans import models as M
from caseloom.plans import reports as R
from registry.fixture import cohort

SPEC = D.DEATH_MODEL


def kept(df):
    """Cached while the module runs; other modules look at plans that read files."""
    yield df.persist()
    df.unpersist()


@pytest.fixture(scope="module")
def people(spark, data):
    yield from kept(cohort(spark, data))


@pytest.fixture(scope="module")
def kinds(people):
    yield from kept(features.feature_kinds(people, SPEC))


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


# --- splits and folds -----------------------------------------------------------


def test_random_parts_are_a_partition(people):
    rows = R.model_rows(people)
    parts = folds.split_random(rows)
    assert sum((multiset(p) for p in parts), Counter()) == multiset(rows)
    n = rows.count()
    assert all(abs(p.count() - n / 4) < 4 * np.sqrt(n * 3 / 16) for p in parts)


def test_weights_of_random_parts(spark):
    one, two = folds.split_random(spark.range(20000), (1.0, 3.0))
    assert abs(one.count() - 5000) < 300
    assert one.count() + two.count() == 20000


def test_stratified_folds_deal_every_kind_evenly(kinds):
    dealt = folds.stratified_folds(kinds)
    again = folds.stratified_folds(kinds.repartition(7))
    assert multiset(dealt) == multiset(again)
    total = {tuple(r)[:-1]: r["rows"] for r in kinds.collect()}
    got: dict[tuple, dict[int, int]] = {}
    for r in dealt.select(*SPEC.columns, "fold", "rows").collect():
        got.setdefault(tuple(r)[:-2], {})[r["fold"]] = r["rows"]
    for kind, rows in total.items():
        counts = [got[kind].get(i, 0) for i in range(D.FOLDS)]
        assert sum(counts) == rows and max(counts) - min(counts) <= 1
    sizes = {r["fold"]: r for r in folds.fold_sizes(dealt, "rows").collect()}
    n = sum(total.values())
    assert sum(r["test_rows"] for r in sizes.values()) == n
    assert all(r["test_rows"] + r["train_rows"] == n for r in sizes.values())
    assert max(r["test_rows"] for r in sizes.values()) < 0.27 * n


def test_one_hot_kind_is_dealt_without_its_rows(spark):
    df = spark.createDataFrame([("hot", 3_000_000_000_001), ("cold", 1)], "v string, rows bigint")
    got = folds.stratified_folds(df, 4).filter("v = 'hot'").agg(F.sum("rows"), F.max("rows"), F.min("rows")).first()
    assert tuple(got) == (3_000_000_000_001, 750_000_000_001, 750_000_000_000)


def test_key_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    assert multiset(folds.key_folds(df, ["id"])) == multiset(folds.key_folds(df.repartition(13), ["id"]))
    assert set(folds.key_folds(df, ["id"]).groupBy("fold").count().toPandas()["fold"]) == {0, 1, 2, 3}


def test_fold_pairs(spark):
    df = folds.random_folds(spark.range(400).withColumn("rows", F.lit(3).cast("bigint"))).persist()
    for i, train, test in folds.fold_pairs(df):
        assert multiset(train) + multiset(test) == multiset(df)
        assert {r["fold"] for r in test.collect()} == {i}


def test_heavy_rows_are_split_evenly(spark):
    df = spark.createDataFrame([("a", 10), ("b", 3), ("c", 1)], "v string, n bigint")
    got = folds.split_heavy(df, "n", 4)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3), ("a", 3), ("a", 4), ("b", 3), ("c", 1)]
    ones = folds.split_heavy(df, "n", 1)
    assert multiset(ones) == Counter({("a", 1): 10, ("b", 1): 3, ("c", 1): 1})


# --- features -------------------------------------------------------------------


def test_label_keeps_its_orientation(spark):
    data = [("a", "Yes")] * 5 + [("b", "Yes")] * 2 + [("b", "No")] * 2
    df = spark.createDataFrame(data, "v string, death_yn string")
    coded, encoder = features.encode_features(df, FeatureSpec("death_yn", ("v",)))
    assert encoder.levels == {"v": ["a", "b"]}
    assert {(r["death_yn"], r["label"]) for r in coded.collect()} == {("Yes", 1.0), ("No", 0.0)}
    assert {(r["v"], tuple(r["features"].toArray())) for r in coded.collect()} == {("a", (1.0,)), ("b", (0.0,))}


def test_too_many_levels_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("v"), F.lit("Yes").alias("death_yn"))
    kinds = features.feature_kinds(df, FeatureSpec("death_yn", ("v",)))
    with pytest.raises(ValueError, match="not categories"):
        features.fit_encoder(kinds, FeatureSpec("death_yn", ("v",)), max_levels=49)
    # The bound is on each feature, not on their mean.
    two = df.withColumn("w", F.lit("one"))
    spec = FeatureSpec("death_yn", ("v", "w"))
    with pytest.raises(ValueError, match="levels of v:"):
        features.fit_encoder(features.feature_kinds(two, spec), spec, max_levels=49)
    with pytest.raises(ValueError, match="not categories"):
        grid.fold_table(df, FeatureSpec("death_yn", ("v",)), max_levels=10)


def test_incomplete_rows_are_left_out(spark):
    df = spark.createDataFrame([("a", "Yes"), (None, "Yes"), ("b", None), ("b", "No")], "v string, death_yn string")
    coded, _ = features.encode_features(df, FeatureSpec("death_yn", ("v",)))
    assert coded.count() == 2


# --- classifiers ----------------------------------------------------------------


@pytest.fixture(scope="module")
def coded(people):
    rows, _ = features.encode_features(people, SPEC)
    yield from kept(rows.select("features", "label"))


@pytest.fixture(scope="module")
def weighted(kinds):
    encoder = features.fit_encoder(kinds, SPEC)
    table = encoder.transform(kinds).withColumn("cases", F.col("rows"))
    yield from kept(table.select("features", "label", "cases"))


def arrays(df):
    p = df.select(vector_to_array("features").alias("x"), "label", "cases").toPandas()
    return np.stack(p["x"].to_numpy()), p["label"].to_numpy(), p["cases"].to_numpy(dtype=float)


def test_logistic_finds_the_maximum_likelihood(weighted):
    x, y, w = arrays(weighted)
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design
        beta += np.linalg.lstsq(hessian, design.T @ (w * (y - p)), rcond=None)[0]
    loss = np.average(np.logaddexp(0, design @ beta) - y * (design @ beta), weights=w)
    model = classify.fit_logistic(weighted, 200, weight="cases")
    theta = np.append(model.coefficients.toArray(), model.intercept)
    ours = np.average(np.logaddexp(0, design @ theta) - y * (design @ theta), weights=w)
    assert ours == pytest.approx(loss, abs=1e-5)


@pytest.mark.parametrize("fit", [classify.fit_logistic, classify.fit_svc])
@pytest.mark.parametrize("max_iter", [1, 3, 10])
def test_counts_give_the_row_level_linear_model(coded, weighted, fit, max_iter):
    rows = fit(coded, max_iter)
    counts = fit(folds.split_heavy(weighted, "cases", 1), max_iter, weight="cases")
    assert np.allclose(rows.coefficients.toArray(), counts.coefficients.toArray(), atol=1e-6)
    assert rows.intercept == pytest.approx(counts.intercept, abs=1e-6)


def test_resolution_bounds_the_difference(coded, weighted):
    rows = classify.fit_logistic(coded, 3).coefficients.toArray()

    def off(heaviest):
        model = classify.fit_logistic(folds.split_heavy(weighted, "cases", heaviest), 3, weight="cases")
        return np.abs(model.coefficients.toArray() - rows).max()

    assert off(2) < 1e-3
    assert off(2) < off(50)


@pytest.mark.parametrize(("depth", "least"), [(3, 1), (5, 1), (20, 1), (3, 1000), (5, 2000), (20, 2000), (5, 4100), (5, 4200)])
def test_counts_give_the_row_level_tree(coded, weighted, depth, least):
    total = coded.count()
    rows = classify.fit_tree(coded, depth, least)
    counts = classify.fit_tree(weighted, depth, least, "cases", total)
    assert rows.numNodes == counts.numNodes and rows.depth == counts.depth
    x, _, _ = arrays(weighted)
    labels = [
        [r["prediction"] for r in m.transform(weighted).select("prediction").collect()] for m in (rows, counts)
    ]
    assert labels[0] == labels[1]


def test_tree_bound_is_met_exactly(spark):
    # 3 of 10 cases lie left: legal with at least 3, illegal with at least 4
    data = [("a", "Yes")] * 3 + [("b", "No")] * 7
    df = spark.createDataFrame(data, "v string, death_yn string")
    spec = FeatureSpec("death_yn", ("v",))
    kinds = features.feature_kinds(df, spec)
    table = features.fit_encoder(kinds, spec).transform(kinds)
    for least, nodes in ((1, 3), (3, 3), (4, 1), (6, 1)):
        assert classify.fit_tree(table, 5, least, "rows", 10).numNodes == nodes


# --- grid -----------------------------------------------------------------------

SMALL = grid.Grid(max_iters=(1, 3), min_instances=(1, 1000), max_depths=(3,))


@pytest.fixture(scope="module")
def fold_table(people):
    return grid.fold_table(people)


@pytest.fixture(scope="module")
def results(fold_table):
    fitted = grid.fit_grid(fold_table, SMALL)
    return fitted, grid.score_grid(fold_table, fitted, SMALL)


def test_threshold_on_scores_is_the_threshold_of_the_model(fold_table, results):
    fitted, scored = results
    by = {(r["family"], r["max_iter"], r["threshold"], r["fold"]): r for r in scored.collect()}
    for fit, model in fitted.items():
        if fit.family == grid.TREE:
            continue
        test = fold_table.table.filter(F.col("fold") == fit.fold)
        for t in SMALL.thresholds:
            own = model.copy().setThreshold(t).transform(test)
            counts = metrics.confusion(own, "label", "prediction", actual_values=(0.0, 1.0), weight="cases").first()
            got = by[fit.family, fit.first, t, fit.fold]
            assert tuple(counts) == tuple(got[c] for c in metrics.COUNTS)


def test_grid_covers_every_case_once_per_configuration(fold_table, results):
    _, scored = results
    n = F.col("tn") + F.col("fn") + F.col("fp") + F.col("tp")
    totals = scored.groupBy(*grid.CONFIG).agg(F.sum(n).alias("n"), F.count("fold").alias("k")).collect()
    assert len(totals) == 2 * 2 * 3 + 2
    assert all(r["n"] == fold_table.total and r["k"] == D.FOLDS for r in totals)


def test_metrics_of_grid_match_mllib_summary(fold_table, results):
    fitted, scored = results
    rows = metrics.metrics_weighted(metrics.metrics_positive(scored)).collect()
    for fit, model in fitted.items():
        if fit.family != grid.LOGISTIC:
            continue
        test = folds.split_heavy(fold_table.table.filter(F.col("fold") == fit.fold), "cases", 1)
        summary = model.evaluate(test)
        got = next(r for r in rows if (r["family"], r["max_iter"], r["fold"], r["threshold"]) == (fit.family, fit.first, fit.fold, 0.5))
        assert got["weighted_accuracy"] == pytest.approx(summary.accuracy)
        assert got["weighted_precision"] == pytest.approx(summary.weightedPrecision)
        assert got["weighted_recall"] == pytest.approx(summary.weightedRecall)
        assert got["weighted_f1"] == pytest.approx(summary.weightedFMeasure())


def test_compressed_and_row_level_search_agree(people):
    """The same drawn folds, once counted and once row by row."""
    drawn = R.model_rows(people).coalesce(1).persist()
    small = grid.Grid(max_iters=(3,), thresholds=(0.5,), min_instances=(1,), max_depths=(3,))
    order = [*grid.CONFIG, "fold"]
    found = [
        [tuple(r) for r in grid.grid_search(drawn, grid=small, how="random", compress=c).orderBy(*order).collect()]
        for c in (True, False)
    ]
    assert found[0] == found[1]


def test_folds_need_a_known_rule(people):
    with pytest.raises(ValueError):
        grid.fold_table(people, how="sorted")
    with pytest.raises(ValueError):
        grid.fold_table(people, how="stratified", compress=False)


def test_deaths_can_be_predicted(results):
    _, scored = results
    summary = grid.grid_summary(metrics.metrics_weighted(metrics.metrics_positive(scored)))
    best = M.classifier_best(summary).filter(F.col("metric") == "accuracy").collect()
    assert {r["family"] for r in best} == set(grid.FAMILIES)
    majority = 7203 / 8271  # share of "No" at sf0.01
    assert max(r["value"] for r in best) > majority


# --- clusters -------------------------------------------------------------------


def test_clusters(people):
    found = M.cluster_cells(people, 7, 3)
    cells = found.cells.persist()
    assert cells.count() == death_cells(people).count()
    assert found.profile.agg(F.sum("cell_count")).first()[0] == cells.count()
    points = [tuple(r)[1:] for r in found.centers.orderBy("cluster").collect()]
    nearest = cluster.assign_nearest(cells.withColumnRenamed("cluster", "given"), points)
    assert nearest.filter(F.col("given") != F.col("cluster")).count() == 0


def test_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 1), (1.0, 2), (3.0, 5)], "age_group_index double, death_count bigint")
    model = cluster.fit_kmeans(df, k=7)
    assert cluster.centers(model, df).count() == 3
    assert cluster.assign_clusters(model, df).select("cluster").distinct().count() == 3


def test_weighted_points_move_centers_like_rows(spark):
    data = [(0.0, 0)] * 6 + [(3.0, 10)] * 3
    rows = spark.createDataFrame(data, "age_group_index double, death_count bigint")
    counted = tally(rows, rows.columns, "n")
    both = [
        sorted(tuple(r)[1:] for r in cluster.centers(cluster.fit_kmeans(d, k=2, max_iter=5, weight=w), d).collect())
        for d, w in ((rows, None), (counted, "n"))
    ]
    assert both[0] == both[1] == [(0.0, 0.0), (3.0, 10.0)]


def test_limit_by_is_repeatable(people):
    first = clean.limit_by(people, 500, ["case_month", "case_id"])
    again = clean.limit_by(people.repartition(5), 500, ["case_month", "case_id"])
    assert multiset(first) == multiset(again)

"""Stacked scoring and the checks of fitted models against MLlib and plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom.operators import audit, classify, cluster, features, grid
from caseloom.operators.aggregate import death_cells
from registry.fixture import cohort

SPEC = D.DEATH_MODEL


@pytest.fixture(scope="module")
def training(spark, data):
    kinds = features.feature_kinds(cohort(spark, data), SPEC).persist()
    encoder = features.fit_encoder(kinds, SPEC)
    coded = encoder.transform(kinds, "levels").withColumnRenamed("rows", "cases").persist()
    yield kinds, coded, encoder, kinds.agg(F.sum("rows")).first()[0]
    coded.unpersist()
    kinds.unpersist()


def test_levels_number_the_slots(training):
    _, coded, encoder, _ = training
    for r in coded.select("features", "levels").limit(50).collect():
        vector = np.zeros(len(encoder.slots))
        for at, (feature, level) in enumerate(encoder.slots):
            vector[at] = r["levels"][feature] == level
        assert (r["features"].toArray() == vector).all()


@pytest.mark.parametrize("fit", [classify.fit_logistic, classify.fit_svc])
def test_margins_of_stacked_coefficients(training, fit):
    _, coded, encoder, _ = training
    model = fit(coded, 5, weight="cases")
    margin = F.expr(grid.margin_sql(encoder, model.coefficients.toArray(), model.intercept))
    both = model.transform(coded).select(vector_to_array("rawPrediction")[1], margin).collect()
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in both)


@pytest.mark.parametrize(("depth", "least"), [(0, 1), (1, 1), (3, 1000), (5, 1), (20, 1)])
def test_walks_of_stacked_trees(training, depth, least):
    _, coded, encoder, total = training
    trees = [classify.fit_tree(coded, d, n, "cases", total) for d, n in ((depth, least), (2, 1), (0, 1))]
    nodes = [classify.tree_nodes(t) for t in trees]
    assert [len(n) for n in nodes] == [t.numNodes for t in trees]
    walked = coded.withColumn("walked", F.expr(grid.stacked_trees(encoder, nodes)))
    for i, tree in enumerate(trees):
        assert tree.transform(walked).filter(F.col("prediction") != F.col("walked")[i]).count() == 0
    assert coded.select(F.expr(grid.stacked_trees(encoder, nodes[2:]))).distinct().count() == 1


def test_a_fold_is_scored_in_one_go(spark, data):
    table = grid.fold_table(cohort(spark, data))
    small = grid.Grid(max_iters=(1, 2), min_instances=(1, 500), max_depths=(3,))
    models = grid.fit_grid(table, small)
    context = spark.sparkContext
    context.setJobGroup("scoring", "scoring")
    scored = grid.score_grid(table, models, small)
    jobs = context.statusTracker().getJobIdsForGroup("scoring")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2 * D.FOLDS  # the two stages of one aggregate per fold
    assert scored.count() == D.FOLDS * (2 * 2 * 3 + 2)


def test_early_models_are_out_of_balance(training):
    _, coded, encoder, total = training
    rows = {}
    for n in (1, 300):
        model = classify.fit_logistic(grid.linear_rows(coded, total), n, weight="cases", tol=1e-12)
        rows[n] = audit.score_equations(coded, encoder, model).collect()
        p = model.transform(coded).select("levels", "cases", vector_to_array("probability")[1].alias("p")).toPandas()
        for r in rows[n]:
            at = SPEC.features.index(r["feature"])
            mine = [v[at] == encoder.levels[r["feature"]].index(r["level"]) for v in p["levels"]]
            assert r["expected"] == pytest.approx((p["cases"] * p["p"])[mine].sum(), rel=1e-9, abs=1e-9)

    def worst(found):
        return max(abs(r["expected"] - r["observed"]) / r["cases"] for r in found)

    assert worst(rows[1]) > 1e-2 > 1e-3 > worst(rows[300])


def test_gains_against_loops(training):
    kinds, _, _, total = training
    table = kinds.toPandas()
    n, d = table["rows"].sum(), table["rows"][table["death_yn"] == "Yes"].sum()

    def gini(n, d):
        return 2 * d / n * (1 - d / n) if n else 0.0

    got = {(r["feature"], r["level"]): r for r in audit.split_gains(kinds, SPEC).collect()}
    for c in SPEC.features:
        for level in set(table[c]):
            mine = table[c] == level
            a, b = table["rows"][mine].sum(), table["rows"][mine & (table["death_yn"] == "Yes")].sum()
            want = gini(n, d) - a / n * gini(a, b) - (n - a) / n * gini(n - a, d - b)
            assert got[c, level]["gain"] == pytest.approx(want, abs=1e-12)
    least = audit.split_gains(kinds, SPEC, least=1000).collect()
    assert {(r["feature"], r["level"]) for r in least} == {k for k, r in got.items() if 1000 <= r["in_rows"] <= total - 1000}


def test_hinge_objective_and_a_worse_plane(training):
    _, coded, encoder, total = training
    model = classify.fit_svc(grid.linear_rows(coded, total), 200, weight="cases", tol=1e-10)
    w, b = model.coefficients.toArray(), model.intercept
    planes = [(w, b), (w * 0.5, b), (-w, -b)]
    got = audit.hinge_objectives(coded, encoder, planes)
    p = coded.select(vector_to_array("features").alias("x"), "label", "cases").toPandas()
    x, sign = np.stack(p["x"].to_numpy()), 2 * p["label"].to_numpy() - 1
    for value, (c, i) in zip(got, planes, strict=True):
        assert value == pytest.approx(np.average(np.maximum(0, 1 - sign * (x @ c + i)), weights=p["cases"]), abs=1e-12)
    assert got[0] < got[1] and got[0] < got[2]
    assert len(audit.close_planes(w, b, 0.1)) == 1 + 2 * (len(w) + 1)


def test_points_stand_for_cells(spark, data):
    cells = death_cells(cohort(spark, data)).persist()
    points = cluster.weighted_points(cells).persist()
    assert points.agg(F.sum("cells")).first()[0] == cells.count() > 20 * points.count()
    at = [(0.0, 0.0), (2.0, 1.0), (3.0, 3.0)]
    rows = audit.means_of_nearest(cells, at, D.CLUSTER_FEATURES).orderBy("cluster").collect()
    counted = audit.means_of_nearest(points, at, D.CLUSTER_FEATURES, "cells").orderBy("cluster").collect()
    assert [tuple(r) for r in rows] == [pytest.approx(tuple(r)) for r in counted]
    model = cluster.fit_points(points, k=4, max_iter=100, tol=1e-12)
    profile = {r["cluster"]: tuple(r)[1:] for r in cluster.cluster_profile(cluster.assign_clusters(model, points), weight="cells").collect()}
    again = {r["cluster"]: tuple(r)[1:] for r in cluster.cluster_profile(cluster.assign_clusters(model, cells)).collect()}
    assert profile.keys() == again.keys() and all(profile[k] == pytest.approx(again[k]) for k in again)
    few = points.limit(3)
    assert cluster.centers(cluster.fit_points(few, k=5), few).count() == 3
    cells.unpersist()
    points.unpersist()

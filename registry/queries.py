"""One callable ``(spark, sf_dir) -> DataFrame`` per operator.

Doubles are rounded to ``DIGITS`` here, and only here, because two engines add in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom import functions as X
from caseloom.domain import FeatureSpec
from caseloom.operators import aggregate as A
from caseloom.operators import audit, classify, clean, cluster, correlate, features, folds, grid, metrics, order
from caseloom.plans import models as M
from caseloom.plans import reports as R
from caseloom.sources import read_cases, register_table, save_table
from caseloom.sources.sinks import stage_path, write_stage
from registry.fixture import STATE, cases, cohort, derive_cases
from registry.session import prepared

DIGITS = 6
TOP = 5000
CENTERS = ((0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (3.0, 1.0), (3.0, 2.0), (1.0, 2.0), (2.0, 3.0))
MODEL_COLUMNS = D.DEATH_MODEL.columns

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# --- sources and sinks --------------------------------------------------------


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_cases(spark, sf_dir)


def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "csv")
    save_table(cases(spark, sf_dir).drop("case_id"), path, format="csv")
    return read_cases(spark, path)


def src_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "parquet")
    save_table(cases(spark, sf_dir).drop("case_id"), path)
    return clean.clean_cohort(read_cases(spark, path, format="parquet"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.outcome_share(register_table(cohort(spark, sf_dir), "case_cohort")))


# --- projections and filters --------------------------------------------------


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_missing(cases(spark, sf_dir))


def cohort_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).agg(F.count(F.lit(1)).alias("cohort_rows"))


def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_rows(cohort(spark, sf_dir))


def encode_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_missing(cases(spark, sf_dir)).select(
        "case_id",
        X.ordinal("age_group", D.AGE_GROUPS, 1).alias("age_from_1"),
        X.ordinal("age_group", D.AGE_GROUPS, 0).alias("age_from_0"),
    )


def encode_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_missing(cases(spark, sf_dir)).select(
        "case_id",
        X.binary("hosp_yn").alias("hosp_yn_index"),
        X.binary("death_yn").alias("death_yn_index"),
        X.binary("symptom_status", D.SYMPTOMATIC, D.ASYMPTOMATIC).alias("symptom_status_index"),
        X.binary("underlying_conditions_yn").alias("underlying_conditions_yn_index"),
        X.yes_flag("icu_yn").alias("icu_flag"),
    )


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcome_rows(cohort(spark, sf_dir)).select("case_id", "outcome")


def threshold_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = X.ordinal("age_group", D.AGE_GROUPS)
    score = X.binary("hosp_yn") * 0.25 + X.binary("icu_yn") * 0.375 + age * 0.125
    scored = cohort(spark, sf_dir).select(score.alias("score"))
    return A.count_by(scored.withColumn("predicted_class", X.threshold_label("score")), ["score", "predicted_class"])


# --- counts, shares, months ---------------------------------------------------


def cases_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cases_by_age(cohort(spark, sf_dir))


def cases_by_age_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cases_by_age_in_order(cohort(spark, sf_dir))


def icu_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.icu_by_age(cohort(spark, sf_dir))


def cases_by_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_by(cohort(spark, sf_dir), ["race"], "count")


def cases_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_by(cohort(spark, sf_dir), ["sex"], "count")


def cases_by_age_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cases_by_age_sex(cohort(spark, sf_dir))


def race_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.share_of_cases(cohort(spark, sf_dir), "race"))


def sex_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.share_of_cases(cohort(spark, sf_dir), "sex"))


def monthly_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.monthly_state(cohort(spark, sf_dir), STATE).withColumn(
        "month_start", F.col("month_start").cast("string")
    )


def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.state_spine(cohort(spark, sf_dir), STATE).select(F.col("month_start").cast("string"))


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = A.date_range(cohort(spark, sf_dir), X.month_start("case_month"))
    return span.select(*[F.col(c).cast("string") for c in span.columns])


def outcome_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.outcome_share(cohort(spark, sf_dir)))


def outcome_share_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.outcome_share(R.cohort_tally(cohort(spark, sf_dir)), weight="rows"))


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.outcome_contingency(cohort(spark, sf_dir)))


def topn_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.limit_by(cohort(spark, sf_dir), TOP, ["case_month", "case_id"]).select(
        "case_id", "case_month", "res_state"
    )


def topn_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``topn_ordered`` without a place where they are merged."""
    rows = cohort(spark, sf_dir).select("case_id", "case_month", "res_state")
    return order.first_n(rows, TOP, ["case_month", "case_id"], rows_per_range=2000)


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every case of the cohort, the latest month first."""
    rows = cohort(spark, sf_dir).select("case_id", "case_month")
    return order.with_position(rows, [F.desc("case_month"), "case_id"], rows_per_range=2000)


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the sorted reports with their place in it: months upwards, age groups downwards,
    age groups by cases, age groups from young to old."""
    people = cohort(spark, sf_dir)
    ages = R.cases_by_age(people)
    orders = {
        "months": (A.count_by_month(people), "case_month", ["case_month"]),
        "ages_down": (ages, "age_group", [F.desc("age_group")]),
        "ages_by_cases": (R.icu_by_age(people), "age_group", [F.desc("case_count"), "age_group"]),
        "ages_up": (ages, "age_group", [F.asc_nulls_last("age_rank"), "age_group"]),
    }
    return clean.bind_rows(
        *[
            order.with_position(rows, by).select(F.lit(name).alias("report"), F.col(key).alias("level"), "case_count", "position")
            for name, (rows, key, by) in orders.items()
        ]
    )


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ReportSet.of(cohort(spark, sf_dir)).counts


def set_outcome_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.ReportSet.of(cohort(spark, sf_dir)).outcome_share())


def set_icu_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ReportSet.of(cohort(spark, sf_dir)).icu_by_age()


def set_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.ReportSet.of(cohort(spark, sf_dir)).contingency())


def set_race_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.ReportSet.of(cohort(spark, sf_dir)).share_of_cases("race"))


def set_monthly_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.ReportSet.of(cohort(spark, sf_dir)).monthly_state(STATE)
    return found.withColumn("month_start", F.col("month_start").cast("string"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profile(cohort(spark, sf_dir), R.REPORT_COLUMNS)


# --- descriptions, correlation, cells ----------------------------------------


def describe_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.interval_description(cohort(spark, sf_dir)))


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.correlation(cohort(spark, sf_dir)))


def correlation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlate.correlation_matrix(correlate.correlation_codes(cohort(spark, sf_dir))))


def correlation_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against balances of their customers, weighted, far from zero."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        (F.col("o_totalprice").cast("double") + 1e6).alias("price"),
        (F.col("c_acctbal").cast("double") + 1e6).alias("balance"),
        (F.col("o_orderkey") % 5 + 1).alias("w"),
    )
    return rounded(correlate.correlation_matrix(rows, ["price", "balance"], weight="w"))


def death_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.death_cells(cohort(spark, sf_dir))


def death_cells_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.death_cells(R.cohort_tally(cohort(spark, sf_dir)), weight="rows")


# --- splits and folds ---------------------------------------------------------


def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = folds.split_random(R.model_rows(cohort(spark, sf_dir)))
    sizes = [p.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return clean.bind_rows(*sizes)


def split_random_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.bind_rows(*folds.split_random(R.model_rows(cohort(spark, sf_dir))))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_kinds(cohort(spark, sf_dir), D.DEATH_MODEL)


def folds_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(folds.random_folds(_kinds(spark, sf_dir)), "rows", D.FOLDS)


def _fold_rows(dealt: DataFrame, rows: Column) -> DataFrame:
    return dealt.groupBy("fold").agg(rows.alias("rows"))


def _fold_properties(first: DataFrame, again: DataFrame, total: DataFrame) -> DataFrame:
    """Whether rows that lie elsewhere get the same folds, sizes are within five deviations of an
    even draw, and the folds together are all rows."""
    n = total.select(F.count(F.lit(1))).scalar()
    both = first.join(again.withColumnRenamed("rows", "rows_again"), "fold", "full")
    even = n / D.FOLDS
    spread = F.sqrt(even * (1 - 1 / D.FOLDS))
    return both.agg(
        F.bool_and(F.col("rows").eqNullSafe(F.col("rows_again"))).alias("same_elsewhere"),
        F.bool_and(F.abs(F.col("rows") - even) <= 5 * spread).alias("within_five_deviations"),
        (F.sum("rows") == n).alias("together_all_rows"),
    )


def folds_random_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    first, again = (
        _fold_rows(folds.random_folds(features.feature_kinds(rows, D.DEATH_MODEL)), F.sum("rows"))
        for rows in (people, people.repartition(7))
    )
    return _fold_properties(first, again, R.model_rows(people))


def folds_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(folds.key_folds(cohort(spark, sf_dir), ["case_id"]), k=D.FOLDS)


def folds_by_key_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    first, again = (
        _fold_rows(folds.key_folds(rows, ["case_id"]), F.count(F.lit(1))) for rows in (people, people.repartition(7))
    )
    return _fold_properties(first, again, people)


def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(_kinds(spark, sf_dir))


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(folds.stratified_folds(_kinds(spark, sf_dir)), "rows", D.FOLDS)


def fold_sizes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = write_stage(folds.stratified_folds(_kinds(spark, sf_dir)), "folds", ["fold"])
    count = F.sum("rows")
    sides = [
        side.agg(count.alias("rows")).withColumns({"fold": F.lit(i), "side": F.lit(name)})
        for i, train, test in folds.fold_pairs(dealt)
        for name, side in (("train", train), ("test", test))
    ]
    return clean.bind_rows(*sides)


def bind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = write_stage(folds.stratified_folds(_kinds(spark, sf_dir)), "folds", ["fold"])
    second, third, fourth = (dealt.filter(F.col("fold") == i).drop("fold") for i in (1, 2, 3))
    return clean.bind_rows(second, third.drop("race"), fourth.withColumn("part", F.lit("fourth")))


# --- confusion and metrics on given predictions -------------------------------


def _hosp_for_death(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame:
    rows = cohort(spark, sf_dir).withColumn("fold", F.col("case_id") % D.FOLDS)
    return metrics.confusion(rows, "death_yn", "hosp_yn", keys, predicted_values=(D.NO, D.YES))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosp_for_death(spark, sf_dir, ["res_state", "sex"])


def confusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return metrics.confusion(labels, "quality", "toxic", actual_values=(0, 1))


def metrics_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metrics_positive(_hosp_for_death(spark, sf_dir, ["res_state"])))


def metrics_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metrics_weighted(_hosp_for_death(spark, sf_dir, ["res_state"])))


def _by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _hosp_for_death(spark, sf_dir, ["res_state", "fold"])
    return metrics.fold_mean(metrics.metrics_positive(counts), ["res_state"], metrics.POSITIVE)


def fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_by_state(spark, sf_dir))


def rank_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states from best to worst by accuracy."""
    means = rounded(_by_state(spark, sf_dir))
    return metrics.rank_configs(means, "accuracy").select("res_state", "accuracy", "position")


def best_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rounded(_by_state(spark, sf_dir))
    return metrics.best_configs(means, ["res_state"], metrics=metrics.POSITIVE)


# --- features and classifiers -------------------------------------------------


def encode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = features.encode_features(cohort(spark, sf_dir), D.DEATH_MODEL)
    digits = F.transform(vector_to_array("features"), lambda v: v.cast("int").cast("string"))
    return coded.select(*MODEL_COLUMNS, "label", F.concat_ws("", digits).alias("slots"))


@dataclass(frozen=True)
class Training:
    """All complete cases, encoded, as distinct rows with their number in ``cases``."""

    kinds: DataFrame
    coded: DataFrame
    total: int
    encoder: features.Encoder

    @property
    def linear(self) -> DataFrame:
        return grid.packed(grid.linear_rows(self.coded, self.total), min(self.total, grid.RESOLUTION))


def _training(people: DataFrame, spec: FeatureSpec = D.DEATH_MODEL) -> Training:
    kinds = write_stage(features.feature_kinds(people, spec), "kinds")
    encoder = features.fit_encoder(kinds, spec)
    coded = encoder.transform(kinds, "levels").withColumnRenamed("rows", "cases")
    return Training(kinds, coded, kinds.agg(F.sum("rows")).first()[0], encoder)


def _predictions(model, coded: DataFrame) -> DataFrame:
    return classify.predict(model, coded).select(*MODEL_COLUMNS, "cases", "prediction")


def fit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(cohort(spark, sf_dir))
    return _predictions(classify.fit_logistic(t.linear, 10, 0.5, "cases"), t.coded)


def fit_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(cohort(spark, sf_dir))
    return _predictions(classify.fit_svc(t.linear, 10, 0.5, "cases"), t.coded)


def fit_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(cohort(spark, sf_dir))
    return _predictions(classify.fit_tree(t.coded, 5, 1, "cases", t.total), t.coded)


def fit_logistic_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and deaths per feature level, and whether the model at its optimum expects as many
    deaths, to a thousandth of the cases of the level."""
    t = _training(cohort(spark, sf_dir))
    model = classify.fit_logistic(t.linear, 300, 0.5, "cases", tol=1e-12)
    found = audit.score_equations(t.coded, t.encoder, model)
    balanced = F.abs(F.col("expected") - F.col("observed")) <= 1e-3 * F.col("cases")
    return found.select("feature", "level", "cases", F.col("observed").alias("deaths"), balanced.alias("balanced"))


def fit_tree_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tree of depth one tells apart, with at least 1 and 1000 cases on a side: the level,
    cases and deaths on both sides as the fitted tree sends them."""
    t = _training(cohort(spark, sf_dir))
    found = []
    for least in (1, 1000):
        model = classify.fit_tree(t.coded, 1, least, "cases", t.total)
        feature, level = audit.first_split(model, t.encoder)
        inside = F.col(feature) == level
        cases, deaths = F.col("cases"), F.col("cases") * F.col("label").cast("bigint")
        sides = {"in": inside, "out": ~inside}
        sums = [F.sum(F.when(c, x)).alias(f"{side}_{n}") for side, c in sides.items() for n, x in (("cases", cases), ("deaths", deaths))]
        names = {"min_instances": F.lit(least), "feature": F.lit(feature), "level": F.lit(level)}
        found.append(t.coded.agg(*sums).withColumns(names))
    return clean.bind_rows(*found)


def fit_tree_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gini gain of telling each level of each feature from the others."""
    kinds = features.feature_kinds(cohort(spark, sf_dir), D.DEATH_MODEL)
    return rounded(audit.split_gains(kinds, D.DEATH_MODEL))


def fit_svc_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no plane close to the fitted one has a smaller hinge loss."""
    t = _training(cohort(spark, sf_dir))
    model = classify.fit_svc(t.linear, 100, 0.0, "cases", tol=1e-8)
    planes = audit.close_planes(model.coefficients.toArray(), model.intercept, 0.05)
    fitted, *others = audit.hinge_objectives(t.coded, t.encoder, planes)
    return spark.range(1).select(F.lit(all(o >= fitted - 1e-4 for o in others)).alias("no_closer_plane_is_better"))


def fit_svc_determined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that one feature determines, predicted: cases and errors per label."""
    people = cohort(spark, sf_dir).withColumn("stay", F.col("hosp_yn"))
    spec = FeatureSpec("stay", ("age_group", "sex", "hosp_yn"))
    t = _training(people, spec)
    scored = classify.predict(classify.fit_svc(t.linear, 50, 0.0, "cases"), t.coded)
    wrong = F.sum(F.when(F.col("prediction") != F.col("label"), F.col("cases")).otherwise(0))
    return scored.groupBy("stay").agg(F.sum("cases").alias("cases"), wrong.alias("errors"))


def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classifier_summary(cohort(spark, sf_dir))


def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classifier_best(M.classifier_summary(cohort(spark, sf_dir)))


def grid_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases and deaths every configuration was tested on, per fold."""
    found = grid.grid_search(cohort(spark, sf_dir))
    n = F.col("tn") + F.col("fn") + F.col("fp") + F.col("tp")
    return found.select(*grid.CONFIG, "fold", n.alias("cases"), (F.col("fn") + F.col("tp")).alias("deaths"))


def grid_support_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over folds into which every case is drawn on its own."""
    found = grid.grid_search(cohort(spark, sf_dir), how="random")
    n = F.col("tn") + F.col("fn") + F.col("fp") + F.col("tp")
    return found.select(*grid.CONFIG, "fold", n.alias("cases"), (F.col("fn") + F.col("tp")).alias("deaths"))


# --- clusters -----------------------------------------------------------------


def fit_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_cells(cohort(spark, sf_dir), 7, 1).centers


def kmeans_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_runs(cohort(spark, sf_dir))


def kmeans_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether centers at convergence are the means of the points nearest to them, and these are
    all cells."""
    points = write_stage(cluster.weighted_points(A.death_cells(cohort(spark, sf_dir))), "points")
    model = cluster.fit_points(points, k=7, max_iter=200, tol=1e-12)
    found = cluster.centers(model, points)
    at = [tuple(r)[1:] for r in found.orderBy("cluster").collect()]  # seven centers
    means = audit.means_of_nearest(points, at, D.CLUSTER_FEATURES, "cells")
    off = [F.abs(F.col(c) - F.col(f"mean_{c}")) <= 1e-9 for c in D.CLUSTER_FEATURES]
    both = found.join(means.withColumnsRenamed({c: f"mean_{c}" for c in D.CLUSTER_FEATURES}), "cluster", "full")
    return both.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.bool_and(F.coalesce(off[0] & off[1], F.lit(False))).alias("fixed"),
        F.sum("points").cast("bigint").alias("cells"),
    )


def kmeans_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centers of as many clusters as there are distinct points."""
    points = write_stage(cluster.weighted_points(A.death_cells(cohort(spark, sf_dir))), "points")
    model = cluster.fit_points(points, k=points.count())
    return rounded(cluster.centers(model, points).select(*D.CLUSTER_FEATURES))


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign_nearest(A.death_cells(cohort(spark, sf_dir)), CENTERS)


def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.cluster_profile(assign_nearest(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    q.__name__: prepared(q)
    for q in (
        case_table,
        src_csv_roundtrip,
        src_parquet_roundtrip,
        flagship,
        clean_tokens,
        cohort_count,
        complete_cases,
        encode_ordinal,
        encode_binary,
        outcome_rows,
        threshold_label,
        cases_by_age,
        cases_by_age_in_order,
        icu_by_age,
        cases_by_race,
        cases_by_sex,
        cases_by_age_sex,
        race_share,
        sex_share,
        monthly_state,
        month_spine,
        date_range,
        outcome_share,
        outcome_share_tally,
        contingency,
        topn_ordered,
        topn_distributed,
        order_positions,
        report_order,
        report_counts,
        set_outcome_share,
        set_icu_by_age,
        set_contingency,
        set_race_share,
        set_monthly_state,
        profile,
        describe_intervals,
        correlation,
        correlation_rows,
        correlation_weighted,
        death_cells,
        death_cells_tally,
        split_random,
        split_random_union,
        folds_random,
        folds_random_properties,
        folds_by_key,
        folds_by_key_properties,
        folds_stratified,
        fold_sizes,
        fold_sizes_pairs,
        bind_rows,
        confusion,
        confusion_labels,
        metrics_positive,
        metrics_weighted,
        fold_mean,
        rank_configs,
        best_configs,
        encode_features,
        fit_logistic,
        fit_svc,
        fit_tree,
        fit_logistic_balance,
        fit_tree_split,
        fit_tree_gains,
        fit_svc_optimal,
        fit_svc_determined,
        grid_summary,
        grid_best,
        grid_support,
        grid_support_random,
        fit_kmeans,
        kmeans_profiles,
        kmeans_fixed_point,
        kmeans_distinct,
        assign_nearest,
        cluster_profile,
    )
}

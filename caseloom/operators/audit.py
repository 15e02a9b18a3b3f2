"""Checks of fitted models that hold whatever the solver did, each from one aggregate.

A logistic fit without a penalty is at its optimum exactly where, for every level of every
feature, expected and observed positives agree. The first split of a tree is the one of largest
gain among all levels. The plane of a linear SVM has no larger objective than planes close to it.
Centers of k-means at convergence are the means of the points nearest to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.domain import FeatureSpec
from caseloom.operators.classify import tree_nodes
from caseloom.operators.cluster import assign_nearest
from caseloom.operators.features import Encoder
from caseloom.operators.grid import margin_sql


def _levels_of(spec: FeatureSpec) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in spec.features])


def score_equations(coded: DataFrame, encoder: Encoder, model: Model, weight: str = "cases") -> DataFrame:
    """Per feature and level: cases, observed positives, and the positives that a logistic model
    expects. ``coded`` has the feature columns, ``levels``, ``label`` and the weight."""
    margin = F.expr(margin_sql(encoder, model.coefficients.toArray(), model.intercept))
    p = 1 / (1 + F.exp(-margin))
    rows = coded.withColumn("_p", p).select(F.inline(_levels_of(encoder.spec)), weight, "label", "_p")
    return rows.groupBy("feature", "level").agg(
        F.sum(weight).alias("cases"),
        F.sum(F.col(weight) * F.col("label").cast("bigint")).alias("observed"),
        F.sum(F.col(weight) * F.col("_p")).alias("expected"),
    )


def _impurity(rows: Column, positive: Column) -> Column:
    """Gini impurity times the rows."""
    return F.when(rows > 0, 2 * positive * (rows - positive) / rows).otherwise(0.0)


def split_gains(kinds: DataFrame, spec: FeatureSpec, rows: str = "rows", least: int = 1) -> DataFrame:
    """Weighted Gini gain of telling each level of each feature from the others: one aggregate over
    the counts. Splits that leave fewer than ``least`` cases on a side are left out."""
    label = F.when(F.col(spec.label) == spec.positive, F.col(rows)).otherwise(0)
    found = kinds.select(F.inline(_levels_of(spec)), F.col(rows).alias("_n"), label.alias("_d"))
    found = found.groupBy("feature", "level").agg(F.sum("_n").alias("in_rows"), F.sum("_d").alias("in_positive"))
    # The levels of any one feature hold every case once.
    first = found.filter(F.col("feature") == spec.features[0])
    total = first.agg(F.sum("in_rows")).scalar()
    positive = first.agg(F.sum("in_positive")).scalar()
    found = found.withColumns({"out_rows": total - F.col("in_rows"), "out_positive": positive - F.col("in_positive")})
    n, d = F.col("in_rows") + F.col("out_rows"), F.col("in_positive") + F.col("out_positive")
    parts = _impurity(F.col("in_rows"), F.col("in_positive")) + _impurity(F.col("out_rows"), F.col("out_positive"))
    gain = (_impurity(n, d) - parts) / n
    return found.withColumn("gain", gain).filter((F.col("in_rows") >= least) & (F.col("out_rows") >= least))


def first_split(model: Model, encoder: Encoder) -> tuple[str, str] | None:
    """The feature and level that a tree tells apart first; None for a lone leaf."""
    root = tree_nodes(model)[0]
    if root.slot is None:
        return None
    feature, level = encoder.slots[root.slot]
    name = encoder.spec.features[feature]
    return name, encoder.levels[name][level]


def hinge_objectives(
    coded: DataFrame, encoder: Encoder, planes: Sequence[tuple[Sequence[float], float]], weight: str = "cases"
) -> list[float]:
    """Mean hinge loss of each plane (coefficients, intercept), all in one aggregate."""
    sign = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    margins = [F.expr(margin_sql(encoder, c, b)).alias(f"m{i}") for i, (c, b) in enumerate(planes)]
    rows = coded.select(sign.alias("sign"), F.col(weight).alias("w"), *margins)
    losses = [F.sum(F.col("w") * F.greatest(F.lit(0.0), 1 - F.col("sign") * F.col(f"m{i}"))) for i in range(len(planes))]
    got = rows.agg(F.sum("w").alias("n"), *[x.alias(f"l{i}") for i, x in enumerate(losses)]).first()
    return [got[f"l{i}"] / got["n"] for i in range(len(planes))]


def close_planes(coefficients: Sequence[float], intercept: float, step: float) -> list[tuple[list[float], float]]:
    """The plane itself, then the planes a step away in each direction of each coefficient."""
    at = [float(c) for c in coefficients]
    planes = [(at, float(intercept))]
    for s in (-step, step):
        planes += [([*at[:i], c + s, *at[i + 1 :]], float(intercept)) for i, c in enumerate(at)]
        planes.append((at, float(intercept) + s))
    return planes


def means_of_nearest(
    points: DataFrame, centers: Sequence[Sequence[float]], columns: Sequence[str], weight: str | None = None
) -> DataFrame:
    """One step of k-means from given centers: weighted mean of the points nearest to each, as
    ``cluster``, the columns and the number of ``points``."""
    w = F.lit(1) if weight is None else F.col(weight)
    assigned = assign_nearest(points.select(*columns, w.alias("_w")), centers, columns)
    means = [(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in columns]
    return assigned.groupBy("cluster").agg(*means, F.sum("_w").alias("points"))

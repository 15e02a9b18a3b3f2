"""Confusion counts and the metrics that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom.functions import ratio

# (actual, predicted) -> name; 1 is the positive class
CELL_NAMES = {(0, 0): "tn", (1, 0): "fn", (0, 1): "fp", (1, 1): "tp"}
COUNTS = tuple(CELL_NAMES.values())
COMPARED_DIGITS = 12
POSITIVE = ("accuracy", "precision", "recall", "f1")
WEIGHTED = ("weighted_accuracy", "weighted_precision", "weighted_recall", "weighted_f1")


def confusion(
    df: DataFrame,
    actual: str,
    predicted: str,
    keys: Sequence[str] = (),
    actual_values: tuple = (D.NO, D.YES),
    predicted_values: tuple = (0, 1),
    weight: str | None = None,
) -> DataFrame:
    """The four counts per key. All four are always there; what was never seen is 0."""
    pair = df.select(
        *keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), *([weight] if weight else [])
    )
    cases = F.lit(1) if weight is None else F.col(weight)
    counts = []
    for (a, p), name in CELL_NAMES.items():
        seen = (F.col("actual") == actual_values[a]) & (F.col("predicted") == predicted_values[p])
        counts.append(F.coalesce(F.sum(F.when(seen, cases)).cast("bigint"), F.lit(0)).alias(name))
    return pair.groupBy(*keys).agg(*counts)


def _harmonic(p: Column, r: Column, undefined: Column) -> Column:
    """Harmonic mean: 0 if either part is 0, ``undefined`` if either is not a number."""
    return (
        F.when(F.isnan(p) | F.isnan(r), undefined)
        .when((p == 0) | (r == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) / (F.lit(1.0) / p + F.lit(1.0) / r))
    )


def metrics_positive(df: DataFrame) -> DataFrame:
    """Metrics of the positive class. A quotient 0/0 is NaN and stays NaN in a mean."""
    tn, fn, fp, tp = (F.col(c) for c in COUNTS)
    return (
        df.withColumn("accuracy", ratio(tn + tp, tn + fn + fp + tp))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", _harmonic(F.col("precision"), F.col("recall"), F.lit(float("nan"))))
    )


def metrics_weighted(df: DataFrame) -> DataFrame:
    """Metrics of both classes weighted by class size; a class never predicted has
    precision 0, as in MLlib's summaries."""
    tn, fn, fp, tp = (F.col(c) for c in COUNTS)
    n = tn + fn + fp + tp

    def both(positive: Column, negative: Column) -> Column:
        return ratio(positive * (tp + fn) + negative * (tn + fp), n)

    precisions = ratio(tp, tp + fp, 0.0), ratio(tn, tn + fn, 0.0)
    recalls = ratio(tp, tp + fn, 0.0), ratio(tn, tn + fp, 0.0)
    zero = F.lit(0.0)
    scores = [_harmonic(p, r, zero) for p, r in zip(precisions, recalls, strict=True)]
    return (
        df.withColumn("weighted_accuracy", ratio(tn + tp, n))
        .withColumn("weighted_precision", both(*precisions))
        .withColumn("weighted_recall", both(*recalls))
        .withColumn("weighted_f1", both(*scores))
    )


def fold_mean(df: DataFrame, config: Sequence[str], metrics: Sequence[str] = (*POSITIVE, *WEIGHTED)) -> DataFrame:
    """Mean of each metric over the folds of a configuration; NaN in one makes NaN."""
    return df.groupBy(*config).agg(*[F.avg(m).alias(m) for m in metrics])


def _comparable(metric: str) -> Column:
    """The value as it is compared: NULL for NaN (Spark would sort NaN above every
    number), and without the last digits, which depend on the order of a sum."""
    return F.round(F.nullif(F.col(metric), F.lit(float("nan"))), COMPARED_DIGITS)


def rank_configs(df: DataFrame, metric: str) -> DataFrame:
    """All configurations from best to worst with their ``position`` from 1; those without
    a value for the metric are last and equals are in the order of their other columns."""
    others = [c for c in df.columns if c not in (*POSITIVE, *WEIGHTED)]
    order = Window.partitionBy().orderBy(_comparable(metric).desc_nulls_last(), *others)  # a row per configuration
    return df.withColumn("position", F.row_number().over(order)).orderBy("position")


def best_configs(
    df: DataFrame, config: Sequence[str], within: Sequence[str] = (), metrics: Sequence[str] = (*POSITIVE, *WEIGHTED)
) -> DataFrame:
    """The best configuration for every metric, per group ``within``; between equals
    the first one in the order of the configuration columns. A metric that no
    configuration has a value for is NaN with NULL as its configuration."""
    named = [
        F.struct(F.lit(m).alias("metric"), (-_comparable(m)).alias("cost"), F.col(m).alias("value")) for m in metrics
    ]
    scored = df.select(*config, F.inline(F.array(*named))).withColumn("without", F.col("cost").isNull())
    best = scored.groupBy("metric", *within).agg(F.min(F.struct("without", "cost", *config, "value")).alias("best"))
    value = F.coalesce("best.value", F.lit(float("nan"))).alias("value")
    told = [F.col(f"best.{c}") if c in within else F.when(~F.col("best.without"), F.col(f"best.{c}")) for c in config]
    return best.select("metric", value, *[t.alias(c) for t, c in zip(told, config, strict=True)])

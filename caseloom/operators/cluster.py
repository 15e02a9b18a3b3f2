"""k-means over cells, and what each cluster looks like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom.operators.aggregate import row_count, tally


def fit_kmeans(
    df: DataFrame,
    columns: Sequence[str] = D.CLUSTER_FEATURES,
    k: int = 7,
    max_iter: int = 1,
    seed: int = D.SPLIT_SEED,
    weight: str | None = None,
    tol: float = 1e-4,
    init: str = "k-means||",
) -> PipelineModel:
    """k-means|| start, unscaled columns. With ``weight`` a row stands for that many."""
    vector = VectorAssembler(inputCols=list(columns), outputCol="_point")
    kmeans = KMeans(featuresCol="_point", predictionCol="cluster", k=k, maxIter=max_iter, initMode=init, seed=seed, tol=tol)
    if weight is not None:
        kmeans = kmeans.setWeightCol(weight)
    return Pipeline(stages=[vector, kmeans]).fit(df)


def weighted_points(df: DataFrame, columns: Sequence[str] = D.CLUSTER_FEATURES, name: str = "cells") -> DataFrame:
    """The distinct points and how many rows each stands for. k-means on them with that weight is
    k-means on the rows, and there are as many as the values combine, not as there are rows."""
    return tally(df, columns, name)


def fit_points(
    points: DataFrame,
    columns: Sequence[str] = D.CLUSTER_FEATURES,
    k: int = 7,
    max_iter: int = 1,
    seed: int = D.SPLIT_SEED,
    weight: str = "cells",
    tol: float = 1e-4,
) -> PipelineModel:
    """k-means on weighted distinct points. With as many clusters as points, or more, every point
    is a start, so that none is left without a cluster of its own."""
    every = points.limit(k + 1).count() <= k
    return fit_kmeans(points, columns, k, max_iter, seed, weight, tol, "random" if every else "k-means||")


def assign_clusters(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Each row with its cluster: one job, no matching of two results by position."""
    return model.transform(df).drop("_point")


def centers(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The k centers as rows: cluster number and one column per clustered column."""
    vector, kmeans = model.stages
    names = vector.getInputCols()
    rows = [(i, *[float(v) for v in c]) for i, c in enumerate(kmeans.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, ["cluster", *names]).withColumn("cluster", F.col("cluster").cast("int"))


def assign_nearest(
    df: DataFrame, points: Sequence[Sequence[float]], columns: Sequence[str] = D.CLUSTER_FEATURES
) -> DataFrame:
    """Cluster by given centers: squared distance, the lower number between equals."""
    def distance(point: Sequence[float]):
        return sum(
            ((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, point, strict=True)),
            F.lit(0.0),
        )

    options = [F.struct(distance(p).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(points)]
    return df.withColumn("cluster", F.array_min(F.array(*options))["i"])


def cluster_profile(df: DataFrame, cluster: str = "cluster", weight: str | None = None) -> DataFrame:
    """Means and number of cells per cluster, of cells or of :func:`weighted_points`."""

    def mean(c: str) -> Column:
        return F.avg(c) if weight is None else F.sum(F.col(c) * F.col(weight)) / F.sum(weight)

    return df.groupBy(cluster).agg(
        mean("death_count").alias("avg_death_count"),
        mean("age_group_index").alias("avg_age_group_index"),
        row_count(weight).alias("cell_count"),
    )

"""The modelling part of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom.operators.aggregate import death_cells
from caseloom.operators.clean import bind_rows
from caseloom.operators.cluster import assign_clusters, centers, cluster_profile, fit_points, weighted_points
from caseloom.operators.grid import CONFIG, grid_search, grid_summary, side_by_side
from caseloom.operators.metrics import best_configs
from caseloom.sources.sinks import write_stage


def classifier_summary(cohort: DataFrame, **options) -> DataFrame:
    """Fold means of both sets of metrics for all configurations of all families."""
    return grid_summary(grid_search(cohort, **options))


def classifier_best(summary: DataFrame) -> DataFrame:
    """The best configuration of each family for every metric."""
    return best_configs(summary, CONFIG, within=["family"]).select("metric", "value", *CONFIG)


@dataclass(frozen=True)
class Clustering:
    model: PipelineModel
    cells: DataFrame  # with the cluster of each cell
    centers: DataFrame
    profile: DataFrame


def cluster_cells(
    cohort: DataFrame, k: int = 7, max_iter: int = 1, seed: int = D.SPLIT_SEED, cells: DataFrame | None = None
) -> Clustering:
    """Deaths per demographic cell, clustered by age index and deaths. Cells are written once.
    The fit and the profile read their distinct points with a weight, a handful of rows; only
    the assignment goes over the cells."""
    cells = write_stage(death_cells(cohort), "cells") if cells is None else cells
    points = write_stage(weighted_points(cells), "points")
    model = fit_points(points, D.CLUSTER_FEATURES, k, max_iter, seed)
    profile = cluster_profile(assign_clusters(model, points), weight="cells")
    return Clustering(model, assign_clusters(model, cells), centers(model, cells), profile)


def cluster_runs(cohort: DataFrame) -> DataFrame:
    """Profiles for every (k, iterations) that is compared. The fits run side by side on the
    distinct points of the cells, which come straight from the cohort."""
    points = write_stage(weighted_points(death_cells(cohort)), "points")

    def run(setting: tuple[int, int]) -> DataFrame:
        k, n = setting
        model = fit_points(points, D.CLUSTER_FEATURES, k, n)
        profile = cluster_profile(assign_clusters(model, points), weight="cells")
        return profile.withColumns({"k": F.lit(k), "max_iter": F.lit(n)})

    return bind_rows(*side_by_side(run, D.KMEANS_RUNS, cohort.sparkSession))

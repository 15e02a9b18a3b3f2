"""Cross-validated grid over the three classifiers.

What makes 9 configurations x 4 folds x 3 families cheap at any size:

* Predictors are categories, so the table is first counted into distinct rows. That
  is one pass over the data and the only one; the fits read the counts.
* Folds are dealt from the counts, so no row is numbered and no kind is gathered.
* A decision threshold does not change a fit. It is applied to the scores, which
  leaves 2 x 3 x 4 linear fits and 9 x 4 tree fits.
* Fits are independent Spark jobs and run side by side.
* All models of a fold score its test rows in one job: coefficients and trees are stacked as
  arrays over the levels of a row, and one aggregate counts for every configuration.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from caseloom import domain as D
from caseloom.domain import FeatureSpec
from caseloom.operators import classify
from caseloom.operators.classify import TreeNode, tree_nodes
from caseloom.operators.features import MAX_LEVELS, Encoder, feature_kinds, fit_encoder
from caseloom.operators.folds import fold_pairs, random_folds, split_heavy, stratified_folds, unfold
from caseloom.operators.metrics import CELL_NAMES, COUNTS, fold_mean, metrics_positive, metrics_weighted
from caseloom.sources.sinks import write_stage

LOGISTIC, TREE, SVC = "logistic", "tree", "svc"
FAMILIES = (LOGISTIC, TREE, SVC)
CONFIG_TYPES = {
    "family": "string",
    "max_iter": "int",
    "threshold": "double",
    "min_instances": "int",
    "max_depth": "int",
}
CONFIG = tuple(CONFIG_TYPES)

T = TypeVar("T")
U = TypeVar("U")

# Rows a compressed table may be unfolded into for the linear fits. The deviation by
# which MLlib scales features has a factor that depends on the spread of weights; with
# this many rows it is within 1/RESOLUTION of the row-level one.
RESOLUTION = 100_000
ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class Grid:
    max_iters: Sequence[int] = D.MAX_ITERS
    thresholds: Sequence[float] = D.THRESHOLDS
    min_instances: Sequence[int] = D.MIN_INSTANCES
    max_depths: Sequence[int] = D.MAX_DEPTHS
    families: Sequence[str] = FAMILIES


@dataclass(frozen=True)
class Fit:
    """One model to be fitted: everything but the threshold."""

    fold: int
    family: str
    first: int  # max_iter, or min_instances for a tree
    second: int = 0  # max_depth for a tree


@dataclass(frozen=True)
class FoldTable:
    """Encoded rows with ``fold``, ``levels`` (numbers of the feature levels) and ``cases`` (how
    many cases a row stands for), the cases per fold, the number of rows and the most cases
    that a row stands for."""

    encoder: Encoder
    table: DataFrame
    sizes: dict[int, int]
    rows: int
    heaviest: int

    @property
    def total(self) -> int:
        return sum(self.sizes.values())


def fold_table(
    df: DataFrame,
    spec: FeatureSpec = D.DEATH_MODEL,
    k: int = D.FOLDS,
    how: str = "stratified",
    seed: int = D.SPLIT_SEED,
    compress: bool = True,
    max_levels: int = MAX_LEVELS,
) -> FoldTable:
    """Encode, assign folds and write the table the fits read.

    ``how="random"`` draws a fold for every case, ``"stratified"`` deals each kind of row
    evenly; both work on the counts of kinds. With ``compress=False`` every case becomes a row
    of its own again (random folds only). More than ``max_levels`` levels of a feature are refused.
    """
    if how not in ("random", "stratified"):
        raise ValueError(f"unknown fold assignment: {how}")
    if how == "stratified" and not compress:
        raise ValueError("stratified folds are dealt from counts; use how='random' to keep rows")
    kinds = write_stage(feature_kinds(df, spec), "kinds")
    folded = stratified_folds(kinds, k) if how == "stratified" else random_folds(kinds, k, seed)
    if not compress:
        folded = unfold(folded).withColumn("rows", F.lit(1).cast("bigint"))
    encoder = fit_encoder(kinds, spec, max_levels=max_levels)
    coded = encoder.transform(folded, "levels").select("fold", "levels", "features", "label", F.col("rows").alias("cases"))
    table = write_stage(coded, "folds", ["fold"])
    sums = (F.sum("cases").alias("cases"), F.count(F.lit(1)).alias("rows"), F.max("cases").alias("heaviest"))
    counts = table.groupBy("fold").agg(*sums).collect()
    sizes = dict.fromkeys(range(k), 0) | {r["fold"]: r["cases"] for r in counts}
    return FoldTable(encoder, table, sizes, sum(r["rows"] for r in counts), max((r["heaviest"] for r in counts), default=0))


def heaviest_row(total: int, resolution: int = RESOLUTION) -> int:
    return max(1, math.ceil(total / resolution))


def linear_rows(table: DataFrame, total: int, resolution: int = RESOLUTION) -> DataFrame:
    """Unfold heavy rows so that none stands for more than ``total / resolution`` cases.
    A table with fewer cases than that becomes one row per case."""
    return split_heavy(table, "cases", heaviest_row(total, resolution))


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows in as few partitions as hold ``ROWS_PER_TASK`` each: an
    iteration of a solver is one small job, and every task in it has its price."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK)))


def _fits(grid: Grid, folds: Sequence[int]) -> list[Fit]:
    linear = [f for f in grid.families if f != TREE]
    fits = [Fit(i, f, m) for f in linear for m in sorted(grid.max_iters, reverse=True) for i in folds]
    if TREE in grid.families:
        depths = sorted(grid.max_depths, reverse=True)
        fits += [Fit(i, TREE, m, d) for d in depths for m in grid.min_instances for i in folds]
    return fits


def side_by_side(fn: Callable[[T], U], items: Sequence[T], spark: SparkSession, parallelism: int = 8) -> list[U]:
    """Run independent Spark jobs from a few driver threads; order is kept."""
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items, chunksize=1)


def fit_grid(
    folds: FoldTable, grid: Grid = Grid(), resolution: int = RESOLUTION, parallelism: int = 8
) -> dict[Fit, Model]:
    """Fit every model of the grid on the training part of every fold, the longest fits first."""
    k = len(folds.sizes)
    table = packed(folds.table, folds.rows).persist()
    if folds.heaviest <= heaviest_row(folds.total, resolution):  # nothing to unfold
        linear = table
    else:
        unfolded = min(folds.total, folds.rows + resolution)
        linear = packed(linear_rows(folds.table, folds.total, resolution), unfolded).persist()
    tree_train = {i: train for i, train, _ in fold_pairs(table, k)}
    linear_train = {i: train for i, train, _ in fold_pairs(linear, k)}

    def run(fit: Fit) -> Model:
        if fit.family == TREE:
            size = folds.total - folds.sizes[fit.fold]
            return classify.fit_tree(tree_train[fit.fold], fit.second, fit.first, "cases", size)
        estimator = classify.fit_logistic if fit.family == LOGISTIC else classify.fit_svc
        return estimator(linear_train[fit.fold], fit.first, weight="cases")

    fits = _fits(grid, sorted(folds.sizes))
    try:
        models = side_by_side(run, fits, table.sparkSession, parallelism)
    finally:
        table.unpersist()
        linear.unpersist()
    return dict(zip(fits, models, strict=True))


def _configs(fit: Fit, grid: Grid) -> list[tuple]:
    """The configurations a fit serves: one for a tree, else one per threshold."""
    if fit.family == TREE:
        return [(TREE, None, None, fit.first, fit.second)]
    return [(fit.family, fit.first, t, None, None) for t in grid.thresholds]


def _log_odds(t: float) -> float:
    """As MLlib has it: 0 and 1 lie below and above every score."""
    if t <= 0.0:
        return -math.inf
    return math.inf if t >= 1.0 else math.log(t / (1.0 - t))


def _doubles(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def margin_sql(encoder: Encoder, coefficients: Sequence[float], intercept: float, levels: str = "levels") -> str:
    """The margin of a linear model as SQL over the level numbers: a look-up per feature."""
    parts = [f"{_doubles(part)}[{levels}[{i}]]" for i, part in enumerate(encoder.by_level(coefficients))]
    return " + ".join([f"{float(intercept)!r}D", *parts])


def stacked_trees(encoder: Encoder, trees: Sequence[Sequence[TreeNode]], levels: str = "levels") -> str:
    """The predictions of several trees as an array, in SQL. All nodes lie in the same four arrays;
    a row walks from each root, as many steps as the deepest tree has. A leaf leads to itself."""
    slots = encoder.slots
    feature, level, right, left, told, roots, depth = [], [], [], [], [], [], 0
    for nodes in trees:
        base = len(told)
        roots.append(base)
        below = [0] * len(nodes)
        for at in range(len(nodes) - 1, -1, -1):  # children come after their parent
            n = nodes[at]
            if n.slot is not None:
                below[at] = 1 + max(below[n.left], below[n.right])
        depth = max(depth, below[0])
        for at, n in enumerate(nodes):
            place = slots[n.slot] if n.slot is not None else (0, -1)
            feature.append(place[0])
            level.append(place[1])
            left.append(base + (n.left if n.slot is not None else at))
            right.append(base + (n.right if n.slot is not None else at))
            told.append(n.prediction)

    def ints(values: Sequence[int]) -> str:
        return f"array({', '.join(map(str, values))})"

    step = f"if({levels}[{ints(feature)}[n]] = {ints(level)}[n], {ints(right)}[n], {ints(left)}[n])"
    if depth == 0:
        return f"transform({ints(roots)}, n -> {_doubles(told)}[n])"
    walk = f"aggregate(sequence(1, {depth}), r, (n, i) -> {step}, n -> {_doubles(told)}[n])"
    return f"transform({ints(roots)}, r -> {walk})"


def predicted_labels(encoder: Encoder, models: Sequence[tuple[Fit, Model]], grid: Grid, test: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """The test rows with a 0/1 column per configuration, and the configurations in that order."""
    linear = [(f, m) for f, m in models if f.family != TREE]
    trees = [(f, m) for f, m in models if f.family == TREE]
    margins = [
        F.expr(margin_sql(encoder, m.coefficients.toArray(), m.intercept)).alias(f"margin_{i}") for i, (_, m) in enumerate(linear)
    ]
    walked = [F.expr(stacked_trees(encoder, [tree_nodes(m) for _, m in trees])).alias("walked")] if trees else []
    scored = test.select("label", "cases", *margins, *walked)
    labels, configs = [], []
    for i, (fit, _) in enumerate(linear):
        for config, t in zip(_configs(fit, grid), grid.thresholds, strict=True):
            # A probability is above t exactly where its log-odds are above those of t.
            bound = t if fit.family == SVC else _log_odds(t)
            labels.append(F.col(f"margin_{i}") > F.lit(float(bound)))
            configs.append(config)
    for i, (fit, _) in enumerate(trees):
        labels.append(F.col("walked")[i] > 0.5)
        configs += _configs(fit, grid)
    named = [c.alias(f"predicted_{i}") for i, c in enumerate(labels)]
    return scored.select("label", "cases", *named), configs


def score_grid(
    folds: FoldTable, models: dict[Fit, Model], grid: Grid = Grid(), parallelism: int = 8
) -> DataFrame:
    """Confusion counts of every configuration on every test fold, from one job per fold. What
    reaches the driver is two rows of sums per fold, whatever the table holds."""
    tests = {i: test for i, _, test in fold_pairs(folds.table, len(folds.sizes))}

    def count(fold: int) -> list[tuple]:
        own = [(f, m) for f, m in models.items() if f.fold == fold]
        scored, configs = predicted_labels(folds.encoder, own, grid, tests[fold])
        sums = [F.sum(F.when(F.col(f"predicted_{i}"), F.col("cases")).otherwise(0)).alias(f"yes_{i}") for i in range(len(configs))]
        found = scored.groupBy("label").agg(F.sum("cases").alias("cases"), *sums).collect()
        by = {int(r["label"]): r for r in found}
        rows = []
        for i, config in enumerate(configs):
            counts = dict.fromkeys(COUNTS, 0)
            for label, r in by.items():
                counts[CELL_NAMES[label, 1]] = r[f"yes_{i}"]
                counts[CELL_NAMES[label, 0]] = r["cases"] - r[f"yes_{i}"]
            rows.append((*config, fold, *counts.values()))
        return rows

    spark = folds.table.sparkSession
    rows = [r for found in side_by_side(count, sorted({f.fold for f in models}), spark, parallelism) for r in found]
    columns = [*[f"{c} {t}" for c, t in CONFIG_TYPES.items()], "fold int", *[f"{c} bigint" for c in COUNTS]]
    return spark.createDataFrame(rows, ", ".join(columns))


def grid_search(
    df: DataFrame,
    spec: FeatureSpec = D.DEATH_MODEL,
    grid: Grid = Grid(),
    k: int = D.FOLDS,
    how: str = "stratified",
    seed: int = D.SPLIT_SEED,
    compress: bool = True,
    resolution: int = RESOLUTION,
    parallelism: int = 8,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Confusion counts and both sets of metrics per configuration and fold."""
    folds = fold_table(df, spec, k, how, seed, compress, max_levels)
    models = fit_grid(folds, grid, resolution, parallelism)
    return metrics_weighted(metrics_positive(score_grid(folds, models, grid, parallelism)))


def grid_summary(results: DataFrame) -> DataFrame:
    """Mean over folds per configuration, on both scales for every family."""
    return fold_mean(results, CONFIG)

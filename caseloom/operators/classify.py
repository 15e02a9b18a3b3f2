"""The three classifiers. Solvers are MLlib's; input is ``features``, ``label`` and,
if rows stand for several cases, a ``weight`` column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.sql import DataFrame


def _weighted(estimator, weight: str | None):
    return estimator if weight is None else estimator.setWeightCol(weight)


def fit_logistic(
    df: DataFrame, max_iter: int = 100, threshold: float = 0.5, weight: str | None = None, tol: float = 1e-6
) -> LogisticRegressionModel:
    """Binomial logistic regression; ``threshold`` is on the probability of the positive class."""
    return _weighted(
        LogisticRegression(family="binomial", maxIter=max_iter, threshold=threshold, tol=tol), weight
    ).fit(df)


def fit_svc(
    df: DataFrame, max_iter: int = 100, threshold: float = 0.0, weight: str | None = None, tol: float = 1e-6
) -> LinearSVCModel:
    """Linear SVM; ``threshold`` is on the margin, so 0.5 here is not 0.5 above."""
    return _weighted(LinearSVC(maxIter=max_iter, threshold=threshold, tol=tol), weight).fit(df)


def fit_tree(
    df: DataFrame,
    max_depth: int = 5,
    min_instances: int = 1,
    weight: str | None = None,
    total: float | None = None,
) -> DecisionTreeClassificationModel:
    """Gini decision tree with at least ``min_instances`` cases in every child.

    MLlib counts rows for ``minInstancesPerNode``. With weighted rows the same bound
    is a share of ``total`` (the sum of weights); half a case below it keeps a child of
    exactly ``min_instances`` cases legal whatever the rounding. A bound no split of
    ``total`` can meet leaves the root alone.
    """
    tree = DecisionTreeClassifier(impurity="gini", maxDepth=max_depth)
    if weight is None:
        return tree.setMinInstancesPerNode(min_instances).fit(df)
    if total is None:
        raise ValueError("a weighted tree needs the total weight")
    if 2 * min_instances > total:
        tree = tree.setMaxDepth(0)
    else:
        tree = tree.setMinWeightFractionPerNode((min_instances - 0.5) / total)
    return tree.setWeightCol(weight).fit(df)


def predict(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df)


@dataclass(frozen=True)
class TreeNode:
    """A node of a tree over 0/1 slots. A leaf has no slot; elsewhere a row goes ``left`` if the
    slot is 0 and ``right`` if it is 1 (numbers of nodes, the root being 0)."""

    prediction: float = 0.0
    slot: int | None = None
    left: int = -1
    right: int = -1


_SPLIT = re.compile(r"\s*(If|Else) \(feature (\d+) (<=|>|in|not in) \{?([0-9.,]+)\}?\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def tree_nodes(model: DecisionTreeClassificationModel) -> list[TreeNode]:
    """The nodes of a fitted tree, read from its description: a few kilobytes, in one call."""
    lines = iter(line for line in model.toDebugString.split("\n")[1:] if line.strip())
    nodes: list[TreeNode] = []

    def branch() -> tuple[re.Match, int]:
        said = _SPLIT.match(next(lines))
        if said is None:
            raise ValueError("no split where one is expected")
        return said, read(next(lines))

    def read(line: str) -> int:
        at = len(nodes)
        leaf = _LEAF.match(line)
        if leaf:
            nodes.append(TreeNode(prediction=float(leaf.group(1))))
            return at
        said = _SPLIT.match(line)
        if said is None:
            raise ValueError(f"neither a split nor a leaf: {line}")
        nodes.append(TreeNode())
        first = read(next(lines))
        _, second = branch()
        # The first branch has the slot at most the bound, or in the set.
        zero_first = said.group(3) == "<=" or {float(v) for v in said.group(4).split(",")} == {0.0}
        left, right = (first, second) if zero_first else (second, first)
        nodes[at] = TreeNode(slot=int(said.group(2)), left=left, right=right)
        return at

    read(next(lines))
    return nodes

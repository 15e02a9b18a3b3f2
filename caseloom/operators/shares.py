"""Shares of counts. All of them start from counts, never from rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.aggregate import tally
from caseloom.operators.clean import complete_cases


def share_within(
    counts: DataFrame, groups: Sequence[str], count: str, name: str = "percent", scale: float = 100.0
) -> DataFrame:
    """Part of each count in the sum of its group. ``counts`` has one row per key,
    so a group is as large as the number of values it is split into."""
    total = F.sum(count).over(Window.partitionBy(*groups)).cast("double")
    return counts.withColumn(name, F.col(count).cast("double") / total * F.lit(scale))


def share_of_total(counts: DataFrame, count: str, name: str = "share", scale: float = 1.0) -> DataFrame:
    """Part of each count in the sum of all. The sum is a scalar subquery: no window
    over everything, and the counts stay spread."""
    total = counts.agg(F.sum(count).cast("double")).scalar()
    return counts.withColumn(name, F.col(count).cast("double") / total * F.lit(scale))


def contingency(
    df: DataFrame, x: str, y: str, fill: str, name: str = "rows", weight: str | None = None
) -> DataFrame:
    """Complete-case counts of ``x`` by ``y`` by ``fill`` with the share in all and
    the share of ``fill`` within ``(x, y)``."""
    extra = [] if weight is None else [weight]
    counts = tally(complete_cases(df, [x, y, fill, *extra]), [x, y, fill], name, weight)
    joint = share_of_total(counts, name, "share_total")
    return share_within(joint, [x, y], name, "share_fill", 1.0)

"""Pearson correlation of every pair of columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom import functions as X
from caseloom.operators.clean import complete_cases


def correlation_codes(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The five coded columns of the case table that are correlated."""
    return df.select(
        X.ordinal("age_group", D.AGE_GROUPS).alias("age_group_index"),
        X.binary("hosp_yn").alias("hosp_yn_index"),
        X.binary("death_yn").alias("death_yn_index"),
        X.binary("symptom_status", D.SYMPTOMATIC, D.ASYMPTOMATIC).alias("symptom_status_index"),
        X.binary("underlying_conditions_yn").alias("underlying_conditions_yn_index"),
        *keep,
    )


def _row_moments(columns: list[str]) -> dict[tuple[str, str], Column]:
    moments = {(c, c): F.var_pop(c) for c in columns}
    return moments | {(a, b): F.covar_pop(a, b) for a, b in combinations(columns, 2)}


def _centred(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """The columns less their weighted means, which leaves covariances as they are but
    keeps their sums from cancelling. The means are a scalar subquery of one row."""
    w = F.col(weight).cast("double")
    means = df.agg(F.struct(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns]).alias("means")).scalar()
    return df.select(*[(F.col(c) - means[c]).alias(c) for c in columns], weight)


def _weighted_moments(columns: list[str], weight: str) -> dict[tuple[str, str], Column]:
    w = F.col(weight).cast("double")
    total = F.nullif(F.sum(w), F.lit(0.0))
    weighted = {c: w * F.col(c) for c in columns}
    mean = {c: F.sum(weighted[c]) / total for c in columns}
    return {
        (a, b): F.sum(weighted[a] * F.col(b)) / total - mean[a] * mean[b]
        for a, b in combinations_with_replacement(columns, 2)
    }


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, weight: str | None = None, centre: bool = True
) -> DataFrame:
    """The whole matrix as rows ``(x, y, r)`` over complete cases, in one pass.

    Variances are shared by all pairs. The diagonal is 1; a pair with a constant
    column has no correlation and gives NULL. With ``weight`` the rows are a tally; its columns
    are centred by a scalar subquery, which small whole codes can do without.
    """
    columns = [c for c in (columns or df.columns) if c != weight]
    extra = [] if weight is None else [weight]
    moments = _row_moments(columns) if weight is None else _weighted_moments(columns, weight)
    rows = complete_cases(df, [*columns, *extra])
    if weight is not None and centre:
        rows = _centred(rows, columns, weight)
    wide = rows.agg(
        *[F.min(c).alias(f"{c}:min") for c in columns],
        *[F.max(c).alias(f"{c}:max") for c in columns],
        *[m.alias(f"{a}:{b}") for (a, b), m in moments.items()],
    )

    def deviation(c: str) -> Column:
        return F.when(F.col(f"`{c}:min`") < F.col(f"`{c}:max`"), F.sqrt(F.col(f"`{c}:{c}`")))

    deviations = wide.withColumns({f"{c}:dev": deviation(c) for c in columns})
    r = {(c, c): F.lit(1.0) for c in columns}
    for a, b in combinations(columns, 2):
        r[a, b] = r[b, a] = F.col(f"`{a}:{b}`") / (F.col(f"`{a}:dev`") * F.col(f"`{b}:dev`"))
    names = {c: F.lit(c) for c in columns}
    cells = [
        F.struct(names[a].alias("x"), names[b].alias("y"), r[a, b].alias("r")) for a in columns for b in columns
    ]
    return deviations.select(F.inline(F.array(*cells)))

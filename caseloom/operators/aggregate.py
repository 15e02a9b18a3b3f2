"""Counts, flag sums, descriptions, roll-ups.

Every aggregate is mergeable, so Spark combines before it shuffles and a key that
holds a third of all rows reaches its reducer as one row per map task.

Operators with a ``weight`` argument also take a :func:`tally` in place of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom import functions as X
from caseloom.operators.clean import complete_cases


def row_count(weight: str | None = None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def tally(df: DataFrame, columns: Sequence[str], name: str = "rows", weight: str | None = None) -> DataFrame:
    """Distinct rows over ``columns`` and how often each occurs; NULLs are values."""
    return df.groupBy(*columns).agg(row_count(weight).alias(name))


def count_by(
    df: DataFrame, keys: Sequence[str], name: str = "case_count", weight: str | None = None
) -> DataFrame:
    return tally(df, keys, name, weight)


def count_and_flag(
    df: DataFrame,
    keys: Sequence[str],
    flag: str | Column,
    name: str = "case_count",
    flag_name: str = "icu_count",
    weight: str | None = None,
) -> DataFrame:
    """Rows per key and how many of them carry the flag (see ``yes_flag``)."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    flagged = flag if weight is None else flag * F.col(weight)
    return df.groupBy(*keys).agg(
        row_count(weight).alias(name), F.sum(flagged).cast("bigint").alias(flag_name)
    )


def count_by_month(
    df: DataFrame, month: str = "case_month", name: str = "case_count", weight: str | None = None
) -> DataFrame:
    """Rows per month in order, with the month as a date beside its text."""
    counts = count_by(df, [month], name, weight)
    return counts.select(month, X.month_start(month).alias("month_start"), name).orderBy(month)


def date_range(df: DataFrame, column: str | Column) -> DataFrame:
    column = F.col(column) if isinstance(column, str) else column
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def month_spine(df: DataFrame, month: str = "case_month", step: int = D.SPINE_MONTHS) -> DataFrame:
    """Every ``step``-th month from the first to the last one; nothing if there is none."""
    span = date_range(df, X.month_start(month))
    return span.select(
        F.explode(F.sequence("first", "last", F.make_ym_interval(F.lit(0), F.lit(step)))).alias("month_start")
    )


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum, one row per column,
    from one pass. Text is read as numbers first; what is no number is left out."""
    read = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    measures = {
        "count": F.count,
        "mean": F.avg,
        "stddev": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    wide = read.agg(*[fn(c).alias(f"{c}:{m}") for c in columns for m, fn in measures.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}:{m}`").alias(m) for m in measures]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def valid_intervals(df: DataFrame, columns: Sequence[str] = D.INTERVALS) -> DataFrame:
    """Rows in which every interval is a number and not negative. Numeric columns are
    compared as they are, so that the filter reaches the scan; NaN is no number."""
    kinds = dict(df.dtypes)
    keep = F.lit(True)
    for c in columns:
        whole = kinds[c] in ("tinyint", "smallint", "int", "bigint") or kinds[c].startswith("decimal")
        real = kinds[c] in ("float", "double")
        number = F.col(c) if whole or real else F.col(c).try_cast("double")
        keep = keep & (number >= 0)
        if not whole:
            keep = keep & ~F.isnan(number)
    return df.filter(keep)


def profile(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Counts of every value of every column, ``(dimension, level, rows)``, from one
    scan. Rows are unfolded first, so that each task sends one row per level at most."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("level")) for c in columns])
    return (
        df.select(F.inline(pairs), *([] if weight is None else [weight]))
        .groupBy("dimension", "level")
        .agg(row_count(weight).alias("rows"))
    )


def death_cells(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Deaths per age index (from 0), sex, month, state and race, complete cases only."""
    coded = df.withColumn("age_group_index", X.ordinal("age_group", D.AGE_GROUPS, base=0))
    extra = [] if weight is None else [weight]
    whole = complete_cases(coded, [*D.CELL_KEYS, "death_yn", *extra])
    died = X.yes_flag("death_yn")
    return whole.groupBy(*D.CELL_KEYS).agg(
        F.sum(died if weight is None else died * F.col(weight)).cast("bigint").alias("death_count")
    )

"""Cleaning, the confirmed cohort, complete cases, row order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import domain as D
from caseloom import functions as X
from caseloom.operators.order import first_n

#: First rows that one task may merge.
MERGED_ROWS = 100_000


def across_strings(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every text column under its own name, in one projection."""
    text = (T.StringType, T.CharType, T.VarcharType)
    return df.select(
        *[
            fn(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, text) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def normalize_missing(df: DataFrame, tokens: Sequence[str] = D.MISSING_TOKENS) -> DataFrame:
    return across_strings(df, lambda c: X.missing_to_null(c, tokens))


def confirmed_cohort(
    df: DataFrame,
    required: Sequence[str] = D.REQUIRED,
    status: str = "current_status",
    confirmed: str = D.CONFIRMED,
    tokens: Sequence[str] = D.MISSING_TOKENS,
) -> DataFrame:
    """Confirmed cases with every required column present.

    The tests name the tokens themselves, so the filter keeps the same rows before
    and after :func:`normalize_missing`. Before it, it reaches the scan.
    """
    keep = F.col(status) == confirmed
    for name in required:
        keep = keep & X.none_missing(name, tokens)
    return df.filter(keep)


def clean_cohort(df: DataFrame) -> DataFrame:
    """Raw table to cohort: filter on raw columns first, then clear the tokens."""
    return normalize_missing(confirmed_cohort(df))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns of the rows that have a value in all of them."""
    return df.select(*columns).na.drop(subset=list(columns))


def limit_by(df: DataFrame, n: int, order: Sequence[str | Column], merged: int = MERGED_ROWS) -> DataFrame:
    """The first ``n`` rows in a stated order; the same rows on every run when the
    order decides between any two different rows. Up to ``merged`` rows each task keeps its
    first ones and they meet in one place; beyond it they are cut from ranges of the order."""
    return df.orderBy(*order).limit(n) if n <= merged else first_n(df, n, order)


def bind_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, matched by column name; absent columns are NULL."""
    bound = first
    for other in others:
        bound = bound.unionByName(other, allowMissingColumns=True)
    return bound

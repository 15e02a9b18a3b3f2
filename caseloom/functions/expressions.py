"""Row-wise expressions. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import domain as D


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: Column | str, tokens: Sequence[str] = D.MISSING_TOKENS) -> Column:
    """NULL where the text is exactly one of ``tokens``; no trimming, case matters."""
    c = _col(c)
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


def none_missing(c: Column | str, tokens: Sequence[str] = D.MISSING_TOKENS) -> Column:
    """True where the value is present. Written on the raw column, so that a
    Parquet or CSV scan can take it as a pushed filter."""
    c = _col(c)
    return c.isNotNull() & ~c.isin(*tokens)


def one_of(c: Column | str, values: Sequence[str]) -> Column:
    return _col(c).isin(*values)


def ordinal(c: Column | str, levels: Sequence[str], base: int = 1) -> Column:
    """Position of the value in ``levels`` counted from ``base``; NULL if not there."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return (F.nullif(place, F.lit(0)) + F.lit(base - 1)).cast("double")


def binary(c: Column | str, positive: str = D.YES, negative: str = D.NO) -> Column:
    """1.0 / 0.0 for the two named values, NULL for everything else."""
    c = _col(c)
    return F.when(c == positive, 1.0).when(c == negative, 0.0)


def yes_flag(c: Column | str, yes: str = D.YES) -> Column:
    """1 for ``yes``, 0 for any other value, NULL for NULL: a group with nothing
    but NULLs then sums to NULL and not to 0."""
    c = _col(c)
    return F.when(c == yes, 1).when(c.isNotNull(), 0)


def classify_outcome(
    hosp: Column | str = "hosp_yn",
    death: Column | str = "death_yn",
    symptoms: Column | str = "symptom_status",
    icu: Column | str = "icu_yn",
) -> Column:
    """Outcome of a case; the first rule that is true decides.

    An unknown ICU stay makes the mild rule unknown, so such a case is "Other".
    """
    hosp, death, symptoms, icu = _col(hosp), _col(death), _col(symptoms), _col(icu)
    not_severe = (hosp != D.YES) & (death != D.YES) & (icu != D.YES)
    return (
        F.when((hosp == D.YES) & (death != D.YES), D.OUTCOME_HOSPITALIZED)
        .when(death == D.YES, D.OUTCOME_DEATH)
        .when(symptoms == D.ASYMPTOMATIC, D.OUTCOME_ASYMPTOMATIC)
        .when((symptoms == D.SYMPTOMATIC) & not_severe, D.OUTCOME_MILD)
        .otherwise(D.OUTCOME_OTHER)
    )


def threshold_label(score: Column | str, cutoff: float = D.LABEL_CUTOFF) -> Column:
    """1 above the cutoff, 0 at or below it, NULL without a score."""
    score = _col(score)
    return F.when(score > cutoff, 1).when(score <= cutoff, 0)


def month_start(c: Column | str) -> Column:
    """First day of a ``YYYY-MM`` month; NULL where the text is no month."""
    return F.try_to_date(F.concat(_col(c), F.lit("-01")), "yyyy-MM-dd")


def ratio(numerator: Column, denominator: Column, empty: float = float("nan")) -> Column:
    """Quotient as double, ``empty`` where the denominator is 0 (ANSI would raise)."""
    num, den = numerator.cast("double"), denominator.cast("double")
    return F.when(den != 0, num / den).when(den == 0, F.lit(empty))

"""Column expressions. Each takes columns (or names) and returns a Column."""

from caseloom.functions.expressions import (
    binary,
    classify_outcome,
    missing_to_null,
    month_start,
    none_missing,
    one_of,
    ordinal,
    ratio,
    threshold_label,
    yes_flag,
)

__all__ = [
    "binary",
    "classify_outcome",
    "missing_to_null",
    "month_start",
    "none_missing",
    "one_of",
    "ordinal",
    "ratio",
    "threshold_label",
    "yes_flag",
]

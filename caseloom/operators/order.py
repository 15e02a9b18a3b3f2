"""Order as data: positions and first rows of a large table, without a place for all rows.

Rows are dealt to ranges of the order and written once, so that what is counted and what is cut
are the same ranges. Counts per range give every range its first position; inside a range rows
are numbered by a sort of that range alone. Rows that the order does not tell apart are spread
over ranges by a random number, so a value that a third of all rows share makes no large range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources.sinks import write_stage

ROWS_PER_RANGE = 500_000
#: Steps of rank at which a sketch is asked, and by how many of them a threshold lies beyond the
#: wanted rank: more than the error of the sketch.
STEPS, SLACK = 200, 4
#: Keys that Spark samples for the bounds of all ranges together, at most about.
SAMPLED_KEYS = 100_000
_SAMPLE_CONF = "spark.sql.execution.rangeExchange.sampleSizePerPartition"

_RANGE, _TIE, _BASE, _SIZE, _PLACE = "_range", "_tie", "_base", "_size", "_place"


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranged(df: DataFrame, order: Sequence[str | Column], rows: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows, written, with the number of their range of the order in ``_range`` and a random
    ``_tie`` that ends the order."""
    parts = max(1, math.ceil(rows / rows_per_range))
    dealt = df.withColumn(_TIE, F.rand(1)).repartitionByRange(parts, *_order(order), F.col(_TIE))
    # Spark samples a number of keys per range for the bounds, all sent to the driver; so many
    # keys in all, whatever the number of ranges. Counts, not the sample, give the positions.
    conf, was = df.sparkSession.conf, df.sparkSession.conf.get(_SAMPLE_CONF, None)
    conf.set(_SAMPLE_CONF, str(max(1, SAMPLED_KEYS // parts)))
    try:
        return write_stage(dealt.withColumn(_RANGE, F.spark_partition_id()), "ranges")
    finally:
        conf.unset(_SAMPLE_CONF) if was is None else conf.set(_SAMPLE_CONF, was)


def range_bases(stage: DataFrame) -> DataFrame:
    """Per range its rows in ``_size`` and the rows of all ranges before it in ``_base``. One row
    per range, so the window over all of them is small."""
    sizes = stage.groupBy(_RANGE).agg(F.count(F.lit(1)).alias(_SIZE))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(_BASE, F.coalesce(F.sum(_SIZE).over(before), F.lit(0)))


def with_position(
    df: DataFrame, order: Sequence[str | Column], name: str = "position", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add the position of each row in the order, from 1. Rows that the order does not tell apart
    get positions next to each other in any order."""
    stage = ranged(df, order, df.count(), rows_per_range)
    bases = range_bases(stage).select(_RANGE, _BASE)
    inside = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*_order(order), _TIE))
    placed = stage.withColumn(_PLACE, inside).join(bases, _RANGE)
    return placed.select(*df.columns, (F.col(_BASE) + F.col(_PLACE)).alias(name))


def monotone_key(df: DataFrame, column: str) -> Column | None:
    """A double that never falls where the column rises in ascending order; NULLs come first. None
    for types without one. Text is read by its first six bytes."""
    kind, col = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.NumericType,)):
        key = F.when(F.isnan(col.cast("double")), F.lit(math.inf)).otherwise(col.cast("double"))
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        key = F.unix_micros(col.cast("timestamp")).cast("double")
    elif type(kind) is T.StringType and kind.collation == "UTF8_BINARY":
        key = F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    else:
        return None
    return F.coalesce(key, F.lit(-math.inf))


def threshold(df: DataFrame, key: Column, n: int) -> float | None:
    """A value of the key that about ``n`` rows and some more do not exceed, from a mergeable
    quantile sketch; None where the table has hardly more rows than that."""
    finite = F.when(F.abs(key) < math.inf, key)
    found = df.agg(
        F.count(finite).alias("finite"), F.count(F.when(key == -math.inf, 1)).alias("lowest"),
        F.kll_sketch_agg_double(finite).alias("sketch"),
    )
    ranks = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    quantiles = F.when(F.col("finite") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))
    got = found.select("finite", "lowest", quantiles.alias("q")).first()  # one row
    if not got["finite"]:
        return None
    at = max(0, math.ceil(STEPS * (n - got["lowest"]) / got["finite"])) + SLACK
    return got["q"][at] if at < STEPS else None


def first_n(df: DataFrame, n: int, order: Sequence[str | Column], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The first ``n`` rows in the order, for any ``n``.

    If the order begins with the name of a column, a sketch of it gives a threshold, and only rows
    up to it are ordered at all. Ranges before the n-th row are taken whole and only the one that
    holds it is sorted. No task merges ``n`` rows.
    """
    if n <= 0:
        return df.limit(0)
    key = monotone_key(df, order[0]) if isinstance(order[0], str) else None
    bound = threshold(df, key, n) if key is not None else None
    rows = df if bound is None else df.filter(key <= bound)
    many = rows.count()
    if bound is not None and many < n:  # the sketch was off by more than the slack
        rows, many = df, df.count()
    if many <= n:
        return rows
    stage = ranged(rows, order, many, rows_per_range)
    cut = range_bases(stage).filter((F.col(_BASE) < n) & (F.col(_BASE) + F.col(_SIZE) >= n)).first()
    whole = stage.filter(F.col(_RANGE) < cut[_RANGE])
    place = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*_order(order), _TIE))
    part = stage.filter(F.col(_RANGE) == cut[_RANGE]).withColumn(_PLACE, place).filter(F.col(_PLACE) <= n - cut[_BASE])
    return whole.select(*df.columns).unionByName(part.select(*df.columns))

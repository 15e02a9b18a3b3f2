"""The case table as a DataFrame."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.domain import CASE_SCHEMA


def read_cases(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = CASE_SCHEMA,
    format: str = "csv",
) -> DataFrame:
    """Columns of ``schema``, found by name, from a file, directory or glob.

    CSV columns come as text under the names of the header line and are cast to
    the schema, so no inference pass reads the data twice, further columns of the
    file are never parsed and their order does not matter. A number that cannot
    be read becomes NULL. Files whose header differs from the first one raise.
    """
    if format == "csv":
        raw = (
            spark.read.option("header", True)
            .option("inferSchema", False)
            .option("enforceSchema", False)
            .csv(path)
        )
    else:
        raw = spark.read.format(format).load(path)
    absent = [f.name for f in schema if f.name not in raw.columns]
    if absent:
        raise ValueError(f"columns not in the source: {', '.join(absent)}")
    have = {f.name: f.dataType for f in raw.schema}
    return raw.select(
        *[
            F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def register_table(df: DataFrame, name: str) -> DataFrame:
    """Name the table for SQL in this session; returns the named table."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def cache_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep a table that several analyses read. Name the columns they use: what
    is cached can no longer be pruned at the source."""
    kept = df.select(*columns) if columns else df
    return kept.persist(StorageLevel.MEMORY_AND_DISK)

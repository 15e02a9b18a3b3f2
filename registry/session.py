"""What a session needs before registered queries run in it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from caseloom.sources.sinks import CHECKPOINT_CONF


def ensure_shared_folder(spark: SparkSession) -> None:
    """Name a folder for intermediate tables in a single-JVM session that has none."""
    if spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_shared_folder(spark)
        return query(spark, sf_dir)

    return run

"""Writing: results to where the caller says, intermediate tables to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextvars import ContextVar
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def save_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write a result where it lies. Nothing passes through the driver."""
    writer = df.write.format(format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    return folder.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Owns the intermediate tables that are written while it is open, and removes exactly those
    when it closes, also after an error::

        with Stages(spark):
            save_table(classifier_summary(cohort), "hdfs:///results/grid")

    What is still to be read from intermediate tables must be saved before the end. One opened
    inside another owns what is written inside it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Stages:
        self._token = _OPEN.set(self)
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        _OPEN.reset(self._token)
        try:
            self.close()
        except Exception:
            if error is None:  # else the first error is the one to be told
                raise

    def close(self) -> None:
        """Remove the tables. Every one is tried; the first failure is raised at the end."""
        failed: Exception | None = None
        while self.paths:
            try:
                remove_path(self.spark, self.paths.pop())
            except Exception as e:
                failed = failed or e
        if failed is not None:
            raise failed


_OPEN: ContextVar[Stages | None] = ContextVar("caseloom_stages", default=None)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. The open :class:`Stages` of this context, if any, owns
    it from here on, before a byte is written."""
    path = f"{shared_folder(spark)}/caseloom/{name}-{uuid.uuid4().hex}"
    owner = _OPEN.get()
    if owner is not None:
        owner.paths.append(path)
    return path


def write_stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Whoever reads the result sees one fixed table: a lost executor re-reads files
    and repeats neither the work above nor any random draw in it.
    """
    path = stage_path(df.sparkSession, name)
    save_table(df, path, partition_by=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)

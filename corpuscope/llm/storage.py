"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.plans.lineage import is_empty, materialise

__all__ = ["deal", "is_empty", "partitions", "read_table", "stored"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The shuffle files of the finished job are removed at once, so that the disk
    holds one stage's shuffle at a time.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return materialise(df)
    finally:
        conf.set(_CLEANUP, before)


def deal(df: DataFrame, bucket: str | Column) -> DataFrame:
    """Send each row to the partition that its ``bucket`` (0 .. partitions - 1) names."""
    column = F.col(bucket) if isinstance(bucket, str) else bucket
    return df.repartitionById(partitions(df), column.cast("int"))

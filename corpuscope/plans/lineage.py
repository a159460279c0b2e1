"""Lineage cuts that survive the loss of executors.

Intermediate results that are read more than once, or that end an iteration of
a loop, are written to the shared folder named by ``spark.checkpoint.dir`` and
read back.  A written table (rather than an RDD checkpoint) keeps column
pruning, filter pushdown and real size statistics for the joins that follow.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def ensure_shared_dir(spark: SparkSession) -> None:
    """Give a local session without ``spark.checkpoint.dir`` a folder of its own.

    Entry points, tests and the benchmark call this; a cluster has to name a folder
    that all its executors share.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="corpuscope-"))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read, private to this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = f"{base.rstrip('/')}/corpuscope-{spark.sparkContext.applicationId}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        fs.mkdirs(hadoop_path)
        fs.deleteOnExit(hadoop_path)
    return path


def scratch_path(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` in as many buckets of ``keys`` as a shuffle has partitions.

    Joins and groups by all the keys then read it where it lies, so a loop that meets a
    large table again and again only shuffles what it brings.
    """
    spark = df.sparkSession
    name = f"corpuscope_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(n, *keys)
    placed.write.bucketBy(n, *keys).option("path", scratch_path(spark)).saveAsTable(name)
    return spark.table(name)


def is_empty(df: DataFrame) -> bool:
    """True when ``df`` has no rows; stops at the first one."""
    return not df.take(1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` when the files give fewer tasks than there are cores.

    Small inputs in one file would otherwise be read by one task; a large input
    has more splits than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df

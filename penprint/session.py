"""Session settings, and the two helpers that depend on the cluster's layout."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "penprint", **conf: str) -> SparkSession:
    """A session with adaptive execution on. Keyword names use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="penprint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On one machine without that setting a local folder is made, which goes when Python
    ends. On a cluster executors could not see it, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so retries cannot collide."""
    return os.path.join(shared_dir(spark), "penprint", uuid.uuid4().hex, name)


def materialize(df: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several jobs start from the same result: the written table outlives
    lost executors and cuts the lineage. ``split_bytes`` asks for partitions of about
    that size, for jobs that pass over a table hundreds of times.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if not split_bytes:
        return table
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(hadoop_path).getLength()
    return table.coalesce(max(1, -(-size // split_bytes)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input that has fewer splits than the cluster has cores.

    Inputs with enough splits, which is every large one, are returned unchanged, so
    this adds no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)

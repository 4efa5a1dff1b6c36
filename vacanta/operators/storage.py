"""The folder that driver and executors share, and frames that are cut by writing them there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a cluster has to name one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def hadoop_path(spark: SparkSession, name: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def at_end(spark: SparkSession, name: str) -> str:
    """``name``, which is deleted when the driver ends, as results may be read until then."""
    path, fs = hadoop_path(spark, name)
    fs.deleteOnExit(path)
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so plans don't grow and a lost
    executor costs one re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(at_end(spark, path))

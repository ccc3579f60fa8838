"""The folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, a bare path on the default file system; only in local mode, where that is unset, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return qualified(spark, root or "file:///tmp/holdfold-shared")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: of a bare one, the cluster's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()

"""Intermediate tables in the folder that all executors share, and functions that executors get by value."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shipped(module_name: str) -> None:
    """Send a module's functions to the executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: a temporary folder, but only for a master that runs in this process; an error on a cluster."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tables-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def temporary_folder(spark: SparkSession) -> str:
    """A new folder for tables, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    hadoop, fs = _path(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table and go on from that: used more than once, it is made once; an aggregate that is stored joins as an exchange
    of its own, which adaptive execution splits where a key is hot (one that stands above its exchange it can't)."""
    path = path or temporary_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage by checkpoints in the folder the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session shares: spark.checkpoint.dir. Where that is unset and the master is a
    local one (tests), a temporary folder serves until the process ends; on a cluster it is required."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set")
            where = tempfile.mkdtemp(prefix="countweave-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same in columns, for many wide rows: about half the bytes. The files stay until the session's JVM ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), f"stored-{uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())

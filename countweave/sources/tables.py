"""Parquet tables of one directory, with the column types the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`<sf_dir>/<name>.parquet`; filters and projections on it reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

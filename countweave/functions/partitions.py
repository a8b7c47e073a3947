"""Helpers about partitioning that read the plan alone: none of them runs a job."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import DataFrame

UNIT = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}


def _bytes(text: str) -> int:
    n, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(n) * UNIT[unit]


def _sources(df: DataFrame) -> list[tuple[bool, int]]:
    """Of every source of df's plan: whether it is made of files, and its bytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        name = leaf.getClass().getSimpleName()
        out.append((name in ("LogicalRelation", "DataSourceV2ScanRelation"), int(str(leaf.stats().sizeInBytes()))))
    return out


def scan_partitions(df: DataFrame) -> int:
    """About how many partitions a scan of df's files gives, from their sizes and the settings of the
    session; sources that are not files count as one partition a core. An estimate: it may steer
    how work is spread, never what comes out."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    least = _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    n = 0
    for files, size in _sources(df):
        n += ceil(size / min(most, max(least, size / cores))) if files else cores
    return max(1, n)


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Redistribute a scan with fewer partitions than cores ahead of CPU-heavy Python work.

    A scan with about as many partitions as there are cores, or more, stays as it is, so large
    inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 4 * scan_partitions(df) >= 3 * cores:
        return df
    return df.repartition(cores * per_core, *keys)


def many(df: DataFrame) -> int:
    """Partitions for a shuffle of df whose number must be fixed ahead: twice the cores, the
    session's setting or as many as the scan has, whichever is most."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), scan_partitions(df))


def ahead_of_expansion(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys in a fixed number of partitions, ahead of a join that multiplies
    rows and an aggregate over keys that include these: the aggregate then needs no further
    shuffle, and adaptive coalescing, which knows the small side of the expansion only, does not
    pack it into a few tasks."""
    return df.repartition(many(df), *keys)

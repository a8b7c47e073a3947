"""Quality summaries and audits of hourly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(h: DataFrame) -> DataFrame:
    """Per device: span, hours of each kind, observed share of the span. One aggregate."""
    n = lambda c: F.count_if(c)
    c = F.col
    g = h.groupBy("standort_id").agg(
        F.min("site_id").alias("site_id"), F.min("ts_local").alias("first_hour"), F.max("ts_local").alias("last_hour"), F.count("*").alias("hours_present"), n(c("observed")).alias("hours_observed"), n(~c("complete")).alias("partial_hours"),
        n(c("dst_ambiguous")).alias("dst_ambiguous_hours"), n(c("zero_run")).alias("zero_run_hours"), n(c("outside_validity")).alias("outside_validity_hours"), n((c("raw_total") == 0) & c("observed")).alias("zero_hours_kept"),
    )
    days = F.datediff("last_hour", "first_hour") * 24 + F.hour("last_hour") - F.hour("first_hour") + 1
    return g.withColumn("coverage_of_span", F.round(c("hours_observed") / days, 3))


def totals(h: DataFrame) -> DataFrame:
    c = F.col
    return h.agg(F.count("*").alias("device_hours"), F.round(F.avg(c("observed").cast("double")), 4).alias("observed_share"), F.count_if(~c("complete")).alias("partial_hours"), F.count_if(c("dst_ambiguous")).alias("dst_ambiguous_hours"), F.count_if(c("zero_run")).alias("zero_run_hours"), F.countDistinct("site_id").alias("sites"), F.countDistinct("standort_id").alias("devices"))


def station_audit(rows: DataFrame, station: str, ts: str, value: str, part: str) -> DataFrame:
    """Per station: span, rows, parts (number and sorted names), missing values and share of zeros."""
    return rows.groupBy(station).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n_rows"), F.countDistinct(part).alias("n_parts"), F.array_join(F.array_sort(F.collect_set(F.col(part).cast("string"))), "|").alias("parts"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(F.coalesce(F.col(value) == 0, F.lit(False)).cast("double")).alias("zero_share"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows beyond the first of each key."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))

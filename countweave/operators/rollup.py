"""From raw interval counts to hourly rows: totals, completeness, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countweave.functions.calendar import autumn_repeat, naive_trunc, spring_skip

ZERO_RUN_HOURS = 48


def majority_direction(raw: DataFrame) -> DataFrame:
    """standort_id, has_out: more than half of a device's rows carry an outbound count."""
    return raw.groupBy("standort_id").agg((F.count("raw_out") > 0.5 * F.count("*")).alias("has_out"))


def active_ids(raw: DataFrame) -> DataFrame:
    """Distinct devices with any inbound count."""
    return raw.where(F.col("raw_in").isNotNull()).select("standort_id").distinct()


def hourly(raw: DataFrame) -> DataFrame:
    """standort_id, ts (quarter hours), raw_in, raw_out -> one row per device and hour.

    A sum over nulls alone is null. completeness: the share of the expected quarter rows present
    in every counted direction (8 in the repeated autumn hour), at most 1. raw_total adds the
    outbound count, null as 0, only where the device counts outbound. has_out comes from the
    hour counts, by a second aggregate of what is already grouped: raw rows shuffle once.
    """
    h = raw.groupBy("standort_id", naive_trunc("HOUR", F.col("ts")).alias("ts_local")).agg(
        F.sum("raw_in").alias("raw_in"), F.sum("raw_out").alias("raw_out"), F.count("raw_in").alias("n_q_in"), F.count("raw_out").alias("n_q_out"), F.count("*").alias("n_rows")
    )
    has = h.groupBy("standort_id").agg((F.sum("n_q_out") > 0.5 * F.sum("n_rows")).alias("has_out"))
    return completed(h.join(has, "standort_id").drop("n_rows"))


def completed(h: DataFrame) -> DataFrame:
    repeat = autumn_repeat(F.col("ts_local"))
    n = F.least("n_q_in", F.when(F.col("has_out"), F.col("n_q_out")).otherwise(F.col("n_q_in")))
    completeness = F.least(n / F.when(repeat, 8).otherwise(4), F.lit(1.0))
    total = F.col("raw_in") + F.when(F.col("has_out"), F.coalesce("raw_out", F.lit(0))).otherwise(0)
    return h.select("*", repeat.alias("dst_ambiguous"), completeness.alias("completeness"), (completeness >= 1).alias("complete"), total.alias("raw_total"))


def outside_validity(ts: Column, valid_from: Column, valid_to: Column) -> Column:
    """Before the day of valid_from, or after the day of valid_to; open ends never exclude."""
    before = F.coalesce(ts < naive_trunc("DAY", valid_from), F.lit(False))
    after = F.coalesce(ts >= naive_trunc("DAY", valid_to) + F.expr("INTERVAL 1 DAY"), F.lit(False))
    return before | after


def zero_runs(h: DataFrame, key: str = "standort_id", least: int = ZERO_RUN_HOURS) -> DataFrame:
    """h with zero_run: the row is 0 and belongs to `least` or more consecutive zero hours."""
    z = F.coalesce(F.col("raw_total") == 0, F.lit(False))
    w = Window.partitionBy(key).orderBy("ts_local")
    before = F.lag("ts_local").over(w)
    starts = before.isNull() | (F.col("ts_local") - before != F.expr("INTERVAL 1 HOUR")) | ~z | ~F.coalesce(F.lag(z).over(w), F.lit(False))
    h = h.withColumn("__z", z).withColumn("__s", starts.cast("int"))
    h = h.withColumn("__run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.sum(F.col("__z").cast("int")).over(Window.partitionBy(key, "__run"))
    return h.withColumn("zero_run", F.col("__z") & (n >= least)).drop("__z", "__s", "__run")


def observed(h: DataFrame) -> DataFrame:
    """h with observed and quality_flags, from complete, dst_ambiguous, zero_run, outside_validity."""
    c = F.col
    ok = c("complete") & ~c("dst_ambiguous") & ~c("zero_run") & ~c("outside_validity") & ~spring_skip(c("ts_local")) & c("raw_total").isNotNull()
    return h.withColumn("observed", ok).withColumn("quality_flags", flag_text(h))


def flag_text(h: DataFrame) -> Column:
    names = (("zero_run", F.col("zero_run")), ("dst_ambiguous", F.col("dst_ambiguous")), ("outside_metadata_validity", F.col("outside_validity")), ("partial_hour", ~F.col("complete")))
    return F.concat_ws("|", *[F.when(cond, F.lit(name)) for name, cond in names])


def single_direction(d: Column) -> Column:
    """No second direction is named: null, blank or dashes."""
    return d.isNull() | F.trim(d).isin("", "---")


def site_hours_last_device(h: DataFrame) -> DataFrame:
    """One row per site and hour: of simultaneous devices the one with the largest id."""
    rest = [c for c in h.columns if c not in ("site_id", "ts_local")]
    best = h.groupBy("site_id", "ts_local").agg(F.max_by(F.struct(*rest), "standort_id").alias("r"))
    return best.select("site_id", "ts_local", "r.*")


def lanes_hourly(lanes: DataFrame) -> DataFrame:
    """Second source: station, ts_local, lane, n -> per station and hour totals, with completeness
    against the station's usual number of lanes (the smallest mode)."""
    per = lanes.groupBy("station", "ts_local").agg(F.sum("n").alias("total"), F.count("n").alias("n_reported"), F.countDistinct("lane").alias("n_lanes"), F.count("*").alias("n_rows"))
    usual = per.groupBy("station").agg(F.mode("n_lanes", True).alias("expected_lanes"))
    return per.join(usual, "station").withColumn("completeness", F.least(F.col("n_reported") / F.col("expected_lanes"), F.lit(1.0)))


def lanes_to_wall(lanes_h: DataFrame, zone: str = "Europe/Zurich", east_hours: int = 1) -> DataFrame:
    """Hourly rows stamped at a fixed offset -> wall clock; the hours that fall together in autumn
    are added (null only if all are), flagged, and expected as often."""
    utc = F.col("ts_local") - F.expr(f"INTERVAL {east_hours} HOUR")
    wall = F.from_utc_timestamp(utc, zone).cast("timestamp_ntz")
    g = lanes_h.groupBy("station", wall.alias("ts_wall")).agg(F.sum("total").alias("total"), F.sum("n_reported").alias("n_reported"), F.count("*").alias("n_utc"), F.min("expected_lanes").alias("lanes"))
    return g.select("station", "ts_wall", "total", (F.col("n_utc") > 1).alias("dst_ambiguous"), F.least(F.col("n_reported") / (F.col("lanes") * F.col("n_utc")), F.lit(1.0)).alias("completeness"))

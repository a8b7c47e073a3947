"""Queries of the general training-data problems (p1 to p6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countweave.functions.zones import zone_table
from countweave.operators import asof, gridding, intervals, quantiles, spikes, timestamps
from countweave.sources.tables import table

ZONE = "Europe/Zurich"


# --- 1: implausible spikes -------------------------------------------------------------


def _ratio_readings(t: DataFrame, name: str, order: str, value: str) -> DataFrame:
    x = F.col(value)
    usable = (x > 0) & (x < float("inf"))
    return t.select(F.lit(name).alias("src_table"), F.col("site").alias("source"), F.col(order).cast("string").alias("ord"), "row_id", x.alias("raw"), F.when(usable, F.log(x)).alias("x"), (~usable).alias("impossible"))


def spike_readings(spark: SparkSession, d: str) -> DataFrame:
    """The readings of the three tables in one form."""
    hours = F.col("zero_run_hours").cast("double")
    dq = table(spark, d, "data_quality").select(F.lit("data_quality").alias("src_table"), F.col("standort_id").cast("string").alias("source"), F.col("vintage").alias("ord"), "row_id", hours.alias("raw"), hours.alias("x"), ((hours < 0) | F.coalesce(hours > F.col("hours_present"), F.lit(False))).alias("impossible"))
    jumps = _ratio_readings(table(spark, d, "level_jumps"), "level_jumps", "to_year", "rel_step_x")
    swaps = _ratio_readings(table(spark, d, "device_swap_steps"), "device_swap_steps", "swap", "step_x")
    return jumps.unionByName(swaps).unionByName(dq)


def _spikes(readings: DataFrame) -> DataFrame:
    hours = F.col("src_table") == "data_quality"
    rules = spikes.Rules(flat=F.when(hours, F.lit(100.0)), zero_runs_normal=hours)
    return spikes.flag(readings, ["src_table", "source"], ["ord", "row_id"], "x", F.col("impossible"), rules, stretch=F.substring("ord", 1, 4), fine=F.col("row_id"))


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null reading of the three tables with its flags: tails by the cutoff alone, on
    residuals from the quarter's or the month's usual level where a source has eight of each."""
    quarter, month = F.substring("ord", 6, 2), F.substring("ord", 6, 2)
    phase = F.when(F.col("src_table") == "data_quality", quarter).when(F.col("src_table") == "device_swap_steps", month)
    return _spikes(spikes.deseasonalised(spike_readings(spark, d), ["src_table", "source"], phase, "x"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The cases as stated: readings compared with the source's others of any season; the tail's
    candidates are held against five spreads."""
    x = _spikes(spike_readings(spark, d))
    return x.where("impossible OR stuck OR (tail AND far)").select("src_table", "row_id")


P1_SQL = """
WITH r AS (
  SELECT 'level_jumps' AS src_table, site AS source, CAST(to_year AS VARCHAR) AS ord, row_id, rel_step_x AS raw, 1 AS ratio, NULL AS cap FROM level_jumps WHERE rel_step_x IS NOT NULL
  UNION ALL SELECT 'device_swap_steps', site, CAST(swap AS VARCHAR), row_id, step_x, 1, NULL FROM device_swap_steps WHERE step_x IS NOT NULL
  UNION ALL SELECT 'data_quality', CAST(standort_id AS VARCHAR), vintage, row_id, CAST(zero_run_hours AS DOUBLE), 0, hours_present FROM data_quality WHERE zero_run_hours IS NOT NULL),
k AS (
  SELECT *, CASE WHEN ratio = 1 THEN NOT (isfinite(raw) AND raw > 0) ELSE raw < 0 OR coalesce(raw > cap, false) END AS impossible,
    CASE WHEN raw = lag(raw) OVER w THEN 0 ELSE 1 END AS starts FROM r WINDOW w AS (PARTITION BY src_table, source ORDER BY ord, row_id)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY src_table, source ORDER BY ord, row_id) AS run FROM k),
s AS (SELECT *, count(*) OVER (PARTITION BY src_table, source, run) >= 4 AND (ratio = 1 OR raw <> 0) AS stuck FROM n),
o AS (SELECT *, CASE WHEN ratio = 1 THEN ln(raw) ELSE raw END AS x FROM s WHERE NOT impossible AND NOT stuck),
c AS (SELECT a.src_table, a.source, a.row_id, a.ratio, a.x, median(b.x) AS centre FROM o a JOIN o b ON a.src_table = b.src_table AND a.source = b.source AND a.row_id <> b.row_id GROUP BY ALL),
m AS (SELECT c.src_table, c.row_id, c.ratio, abs(c.x - c.centre) AS off, 1.4826 * median(abs(b.x - c.centre)) AS spread FROM c JOIN o b ON c.src_table = b.src_table AND c.source = b.source AND c.row_id <> b.row_id GROUP BY c.src_table, c.source, c.row_id, c.ratio, c.x, c.centre)
SELECT src_table, row_id FROM s WHERE impossible OR stuck
UNION ALL SELECT src_table, row_id FROM m WHERE (spread > 0 AND off > 5 * spread) OR (spread = 0 AND ratio = 0 AND off > 100)
"""


# --- 2: percentiles ----------------------------------------------------------------------

P2_QS, P2_EPS = (0.5, 0.9, 0.99), 0.005


def p2_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Per (site_id, year), and per site_id with year null from merging the years' summaries."""
    years = quantiles.summaries(table(spark, d, "daily_panel"), ["site_id", "year"], "total", P2_EPS / 2)
    sites = quantiles.merge_summaries(years, ["site_id"])
    cols = ["site_id", "year", "q", "value", "n", "rank", "rank_lo", "rank_hi", "rank_error"]
    whole = quantiles.read_off(sites, ["site_id"], P2_QS).withColumn("year", F.lit(None).cast("int"))
    return quantiles.read_off(years, ["site_id", "year"], P2_QS).select(cols).unionByName(whole.select(cols))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The same from partial results made on separate pieces of the table (one per month)."""
    t = table(spark, d, "daily_panel")
    pieces = quantiles.summaries(t, ["site_id", "year", "month"], "total", P2_EPS / 4)
    years = quantiles.merge_summaries(pieces, ["site_id", "year"])
    return quantiles.read_off(years, ["site_id", "year"], P2_QS)


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every percentile of p2_quantiles and p2_pieces held against the rows: whether the value's true ranks
    reach the rank asked for within the stated error, and that within eps."""
    t = table(spark, d, "daily_panel").where("total IS NOT NULL").select("site_id", "year", F.col("total").cast("double").alias("x"))
    cols = ["site_id", "year", "q", "value", "n", "rank", "rank_error"]
    q = p2_quantiles(spark, d).select(F.lit("whole").alias("made"), *cols).unionByName(p2_pieces(spark, d).select(F.lit("pieces").alias("made"), *cols))
    # equal values fold first, so a percentile meets a group's distinct values alone
    v = t.groupBy("site_id", "year", "x").agg(F.count("*").alias("k"))
    on = F.col("v.site_id").eqNullSafe(F.col("q.site_id")) & (F.col("q.year").isNull() | F.col("v.year").eqNullSafe(F.col("q.year")))
    j = q.alias("q").join(v.alias("v"), on).groupBy("made", "q.site_id", "q.year", "q.q", "value", "n", "rank", "rank_error")
    j = j.agg(F.sum(F.when(F.col("x") < F.col("value"), F.col("k")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto"))
    off = F.greatest(F.lit(0), F.col("below") + 1 - F.col("rank"), F.col("rank") - F.col("upto"))
    ok = (off <= F.col("rank_error")) & (F.col("rank_error") <= F.ceil(P2_EPS * F.col("n"))) & (F.col("upto") > F.col("below"))
    return j.select("made", "site_id", "year", "q", "n", "rank", ok.alias("within"))


_P2 = "SELECT {made} AS made, site_id, {year} AS year, q, count(*) AS n, CAST(greatest(1, ceil(q * count(*) - 1e-9)) AS BIGINT) AS rank, true AS within FROM daily_panel, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(q) WHERE total IS NOT NULL GROUP BY site_id, q{by}"
P2_SQL = " UNION ALL ".join(_P2.format(made=m, year=y, by=b) for m, y, b in (("'whole'", "year", ", year"), ("'pieces'", "year", ", year"), ("'whole'", "NULL", "")))


# --- 3: intervals --------------------------------------------------------------------------


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "site_devices"), "standort_id", "valid_from", "valid_to")


P3_SQL = """
WITH d AS (
  SELECT standort_id, CAST(valid_from AS DATE) AS b, coalesce(CAST(valid_to AS DATE), DATE '9999-12-31') AS e FROM site_devices WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to >= valid_from)),
m AS (SELECT *, max(e) OVER (PARTITION BY standort_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR date_diff('day', top, b) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY standort_id ORDER BY b, e) AS run FROM m),
p AS (SELECT standort_id, run, min(b) AS b, max(e) AS e FROM g GROUP BY ALL),
q AS (SELECT *, lead(b) OVER (PARTITION BY standort_id ORDER BY b) AS nxt FROM p)
SELECT standort_id, 'period' AS kind, strftime(b, '%Y-%m-%d') AS day_from, CASE WHEN e = DATE '9999-12-31' THEN 'open' ELSE strftime(e, '%Y-%m-%d') END AS day_to FROM q
UNION ALL SELECT standort_id, 'gap', strftime(CAST(e + INTERVAL 1 DAY AS DATE), '%Y-%m-%d'), strftime(CAST(nxt - INTERVAL 1 DAY AS DATE), '%Y-%m-%d') FROM q WHERE nxt IS NOT NULL
"""


# --- 4: attributes as known ------------------------------------------------------------------


def factors_at_reading(spark: SparkSession, d: str) -> DataFrame:
    """row_id with the revision known at ts_local (`known`) and the one that hindsight gives (`later`)."""
    rev = table(spark, d, "factor_revisions")
    rank = F.struct("valid_from", "recorded_at", "rev_id", F.upper("device_id").alias("device_id"), "correction_factor").alias("__rank")
    changes = rev.where(F.col("valid_from").isNotNull()).select(F.col("standort_id").alias("__k"), rank)
    valid, recorded = F.col("__rank.valid_from"), F.col("__rank.recorded_at")
    known = F.when(recorded.isNotNull(), F.greatest(valid, recorded))
    events = table(spark, d, "panel_long").select(F.col("dev").alias("__k"), F.col("ts_local").alias("__t"), "row_id")
    return asof.carried(events, changes, [("known", known), ("later", valid)]).select("row_id", F.col("__k").alias("dev"), "known", "later")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    x = factors_at_reading(spark, d)
    known, later = (F.coalesce(F.col(f"{c}.rev_id"), F.lit(-1).cast("long")) for c in ("known", "later"))
    return x.where(known != later).select("row_id", known.alias("rev_id"))


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with the device and factor known then; null where none was."""
    x = factors_at_reading(spark, d)
    return x.select("row_id", F.coalesce("known.rev_id", F.lit(-1).cast("long")).alias("rev_id"), F.col("known.device_id").alias("device_id"), F.col("known.correction_factor").alias("correction_factor"))


_P4 = """
WITH v AS (SELECT DISTINCT * FROM factor_revisions),
j AS (
  SELECT p.row_id, r.rev_id, upper(r.device_id) AS device_id, r.correction_factor, coalesce(r.recorded_at <= p.ts_local, false) AS seen,
    row_number() OVER (PARTITION BY p.row_id, coalesce(r.recorded_at <= p.ts_local, false) ORDER BY r.valid_from DESC, r.recorded_at DESC NULLS LAST, r.rev_id DESC) AS among,
    row_number() OVER (PARTITION BY p.row_id ORDER BY r.valid_from DESC, r.recorded_at DESC NULLS LAST, r.rev_id DESC) AS place
  FROM panel_long p JOIN v r ON r.standort_id = p.dev AND r.valid_from <= p.ts_local),
a AS (SELECT * FROM j WHERE seen AND among = 1),
b AS (SELECT * FROM j WHERE place = 1)
"""
P4_FOUND_SQL = _P4 + "SELECT b.row_id, coalesce(a.rev_id, -1) AS rev_id FROM b LEFT JOIN a ON a.row_id = b.row_id WHERE a.rev_id IS DISTINCT FROM b.rev_id"
P4_ATTRIBUTES_SQL = _P4 + "SELECT p.row_id, coalesce(a.rev_id, -1) AS rev_id, a.device_id, a.correction_factor FROM panel_long p LEFT JOIN a ON a.row_id = p.row_id"


# --- 5: regular grid ---------------------------------------------------------------------------


def grid_readings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "panel_long").select(F.lit("panel_long").alias("src"), "dev", F.col("ts_local").alias("ts"), F.col("Y").alias("y"), (F.coalesce("M", F.lit(False)) & F.col("Y").isNotNull()).alias("usable"))
    c = table(spark, d, "counts_hourly").select(F.lit("counts_hourly").alias("src"), F.col("standort_id").alias("dev"), F.col("ts_local").alias("ts"), F.col("raw_total").alias("y"), F.col("raw_total").isNotNull().alias("usable"))
    return p.unionByName(c)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = gridding.hourly_grid(grid_readings(spark, d), zone=ZONE).where("missing")
    return g.select(F.col("src").alias("src_table"), F.col("dev").alias("standort_id"), gridding.hour_text(F.col("hour")).alias("hour_local"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with estimate, support and missing mark."""
    g = gridding.hourly_grid(grid_readings(spark, d), zone=ZONE)
    return g.select(F.col("src").alias("src_table"), F.col("dev").alias("standort_id"), gridding.hour_text(F.col("hour")).alias("hour_local"), F.col("usable").alias("n_usable"), F.round("support", 4).alias("support"), F.round("estimate", 4).alias("estimate"), "missing")


_P5 = """
WITH r AS (
  SELECT 'panel_long' AS src_table, dev AS standort_id, date_trunc('hour', ts_local) AS h, coalesce(M, false) AND Y IS NOT NULL AS usable FROM panel_long WHERE ts_local IS NOT NULL
  UNION ALL SELECT 'counts_hourly', standort_id, date_trunc('hour', ts_local), raw_total IS NOT NULL FROM counts_hourly WHERE ts_local IS NOT NULL),
b AS (SELECT src_table, standort_id, min(h) AS lo, max(h) AS hi FROM r GROUP BY ALL),
g AS (SELECT src_table, standort_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM b),
f AS (SELECT * FROM g WHERE NOT (month(h) = 3 AND hour(h) = 2 AND day(h) >= 25 AND dayofweek(h) = 0)),
u AS (SELECT src_table, standort_id, h, count(*) FILTER (WHERE usable) AS n FROM r GROUP BY ALL)
"""
P5_SQL = _P5 + "SELECT f.src_table, f.standort_id, strftime(f.h, '%Y-%m-%dT%H:00') AS hour_local FROM f LEFT JOIN u USING (src_table, standort_id, h) WHERE coalesce(u.n, 0) = 0"


# --- 6: timestamps -----------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    q = timestamps.normalise_texts(table(spark, d, "quarter_counts").select("row_id", "DATUM"), "DATUM", ZONE).where(~F.col("canonical"))
    q = q.select(F.lit("quarter_counts").alias("src_table"), "row_id", timestamps.utc_text("utc_us").alias("utc"))
    return q.unionByName(p6_pairs(spark, d))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The cases of counts_hourly alone."""
    t = table(spark, d, "counts_hourly").select("row_id", "ts_local", "ts_utc")
    c = timestamps.normalise_pairs(t, "ts_local", "ts_utc", ZONE).where(~F.col("agrees"))
    return c.select(F.lit("counts_hourly").alias("src_table"), "row_id", timestamps.utc_text("utc_us").alias("utc"))


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every DATUM with its instant, or `invalid`, and the zone database's version that it rests on."""
    q = timestamps.normalise_texts(table(spark, d, "quarter_counts").select("row_id", "DATUM"), "DATUM", ZONE)
    return q.select("row_id", timestamps.utc_text("utc_us").alias("utc"), "canonical", F.lit(zone_table(ZONE).version).alias("zone_version"))


P6_PAIRS_SQL = """
WITH t AS (
  SELECT row_id, ts_local, ts_utc AT TIME ZONE 'UTC' AS u,
    make_date(year(ts_local), 3, 31) - CAST(dayofweek(make_date(year(ts_local), 3, 31)) AS INTEGER) AS spring,
    make_date(year(ts_local), 10, 31) - CAST(dayofweek(make_date(year(ts_local), 10, 31)) AS INTEGER) AS autumn FROM counts_hourly),
x AS (
  SELECT row_id, u, CASE WHEN ts_local >= CAST(spring AS TIMESTAMP) + INTERVAL 2 HOUR AND ts_local < CAST(spring AS TIMESTAMP) + INTERVAL 3 HOUR THEN CAST(spring AS TIMESTAMP) + INTERVAL 1 HOUR
    WHEN ts_local >= CAST(spring AS TIMESTAMP) + INTERVAL 3 HOUR AND ts_local < CAST(autumn AS TIMESTAMP) + INTERVAL 3 HOUR THEN ts_local - INTERVAL 2 HOUR ELSE ts_local - INTERVAL 1 HOUR END AS w FROM t)
SELECT 'counts_hourly' AS src_table, row_id, strftime(w, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM x WHERE u IS DISTINCT FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_flags, p2_quantiles, p2_pieces, p2_checked, p3_found, p4_found, p4_attributes, p5_found, p5_grid, p6_found, p6_pairs, p6_instants)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p2_checked": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_FOUND_SQL, "p4_attributes": P4_ATTRIBUTES_SQL, "p5_found": P5_SQL, "p6_pairs": P6_PAIRS_SQL}

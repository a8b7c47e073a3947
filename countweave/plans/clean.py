"""Raw counts to canonical tables: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countweave.functions import calendar as cal
from countweave.operators import quality, rollup, timestamps, weather
from countweave.plans.registry import Registry
from countweave.sources.tables import table

R = Registry()


def raw_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Quarter-hour rows whose DATUM is a canonical time."""
    q = table(spark, d, "quarter_counts")
    ts = F.when(F.col("DATUM").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"), F.expr("try_cast(DATUM AS timestamp_ntz)"))
    return q.select(F.col("FK_STANDORT").alias("standort_id"), ts.alias("ts"), F.col("VELO_IN").alias("raw_in"), F.col("VELO_OUT").alias("raw_out")).where("ts IS NOT NULL")


def every_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Quarter-hour rows in any notation that p6 reads, at wall-clock time; a canonical text stays as it is."""
    q = table(spark, d, "quarter_counts").select(F.col("FK_STANDORT").alias("standort_id"), "DATUM", F.col("VELO_IN").alias("raw_in"), F.col("VELO_OUT").alias("raw_out"))
    x = timestamps.normalise_texts(q, "DATUM")
    written = F.when(F.col("DATUM").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"), F.expr("try_cast(DATUM AS timestamp_ntz)"))
    wall = F.from_utc_timestamp(F.timestamp_micros("utc_us"), "Europe/Zurich").cast("timestamp_ntz")
    return x.select("standort_id", F.coalesce(written, wall).alias("ts"), "raw_in", "raw_out").where("ts IS NOT NULL")


RAW = "raw AS (SELECT FK_STANDORT AS standort_id, try_strptime(DATUM, '%Y-%m-%dT%H:%M') AS ts, VELO_IN AS raw_in, VELO_OUT AS raw_out FROM quarter_counts WHERE regexp_full_match(DATUM, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}') AND try_strptime(DATUM, '%Y-%m-%dT%H:%M') IS NOT NULL)"
REPEAT = "(month({0}) = 10 AND dayofweek({0}) = 0 AND day({0}) >= 25 AND hour({0}) = 2)"
SKIP = "(month({0}) = 3 AND dayofweek({0}) = 0 AND day({0}) >= 25 AND hour({0}) = 2)"
HOURLY = f"""
{RAW},
dirs AS (SELECT standort_id, count(raw_out) > 0.5 * count(*) AS has_out FROM raw GROUP BY 1),
hh AS (SELECT standort_id, date_trunc('hour', ts) AS ts_local, sum(raw_in) AS raw_in, sum(raw_out) AS raw_out, count(raw_in) AS n_q_in, count(raw_out) AS n_q_out FROM raw GROUP BY 1, 2),
h AS (SELECT hh.*, has_out, {REPEAT.format("ts_local")} AS dst_ambiguous,
  least(least(n_q_in, CASE WHEN has_out THEN n_q_out ELSE n_q_in END) / CAST(CASE WHEN {REPEAT.format("ts_local")} THEN 8 ELSE 4 END AS DOUBLE), 1.0) AS completeness,
  raw_in + CASE WHEN has_out THEN coalesce(raw_out, 0) ELSE 0 END AS raw_total FROM hh JOIN dirs USING (standort_id))
"""


@R(f"WITH {HOURLY} SELECT standort_id, CAST(ts_local AS VARCHAR) AS ts_local, CAST(raw_in AS BIGINT) AS raw_in, CAST(raw_out AS BIGINT) AS raw_out, n_q_in, n_q_out, has_out, dst_ambiguous, completeness, completeness >= 1 AS complete, CAST(raw_total AS BIGINT) AS raw_total FROM h")
def hourly_rollup_canonical(spark: SparkSession, d: str) -> DataFrame:
    h = rollup.hourly(raw_quarters(spark, d))
    return h.withColumn("ts_local", F.col("ts_local").cast("string"))


@R(f"WITH {RAW} SELECT standort_id, count(raw_out) > 0.5 * count(*) AS has_out FROM raw GROUP BY 1")
def majority_direction_canonical(spark: SparkSession, d: str) -> DataFrame:
    return rollup.majority_direction(raw_quarters(spark, d))


@R(f"WITH {RAW} SELECT DISTINCT standort_id FROM raw WHERE raw_in IS NOT NULL")
def active_ids_canonical(spark: SparkSession, d: str) -> DataFrame:
    return rollup.active_ids(raw_quarters(spark, d))


@R("SELECT DISTINCT q.FK_STANDORT AS standort_id FROM quarter_counts q ANTI JOIN (SELECT standort_id FROM site_devices WHERE status = 'aktuell') s ON s.standort_id = q.FK_STANDORT")
def ids_without_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Devices with counts but without a current metadata record."""
    have = table(spark, d, "site_devices").where("status = 'aktuell'").select("standort_id")
    return table(spark, d, "quarter_counts").select(F.col("FK_STANDORT").alias("standort_id")).join(have, "standort_id", "left_anti").distinct()


@R("SELECT count(*) AS n, CAST(sum(VELO_IN) AS BIGINT) AS total_in FROM quarter_counts WHERE FK_STANDORT IN (SELECT standort_id FROM site_devices WHERE coverage_type = 'full')")
def semi_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    """Scan restricted to listed devices."""
    ids = table(spark, d, "site_devices").where("coverage_type = 'full'").select(F.col("standort_id").alias("FK_STANDORT"))
    return table(spark, d, "quarter_counts").join(ids, "FK_STANDORT", "left_semi").agg(F.count("*").alias("n"), F.sum("VELO_IN").alias("total_in"))


def first_device(spark: SparkSession, d: str) -> DataFrame:
    """One metadata record per device: the earliest by (valid_from, rec_id), nulls last."""
    dev = table(spark, d, "site_devices").where("valid_from IS NOT NULL")
    return dev.groupBy("standort_id").agg(F.min_by(F.struct("valid_from", "valid_to", "site_id", "correction_factor"), F.struct("valid_from", "rec_id")).alias("m")).select("standort_id", "m.*")


DEVICE = "dev AS (SELECT standort_id, valid_from, valid_to, site_id, correction_factor FROM (SELECT *, row_number() OVER (PARTITION BY standort_id ORDER BY valid_from, rec_id) AS k FROM site_devices WHERE valid_from IS NOT NULL) WHERE k = 1)"
RUNS = f"""
runs AS (SELECT *, sum(s) OVER (PARTITION BY standort_id ORDER BY ts_local) AS run FROM (
  SELECT *, CASE WHEN lag(ts_local) OVER w IS NULL OR ts_local - lag(ts_local) OVER w <> INTERVAL 1 HOUR OR NOT coalesce(raw_total = 0, false) OR NOT coalesce(lag(coalesce(raw_total = 0, false)) OVER w, false) THEN 1 ELSE 0 END AS s
  FROM h WINDOW w AS (PARTITION BY standort_id ORDER BY ts_local))),
zr AS (SELECT *, coalesce(raw_total = 0, false) AND sum(CASE WHEN raw_total = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY standort_id, run) >= 6 AS zero_run FROM runs),
fl AS (SELECT zr.*, coalesce(ts_local < date_trunc('day', valid_from), false) OR coalesce(ts_local >= date_trunc('day', valid_to) + INTERVAL 1 DAY, false) AS outside_validity, completeness >= 1 AS complete FROM zr LEFT JOIN dev USING (standort_id))
"""


@R(f"""WITH {HOURLY}, {DEVICE}, {RUNS}
SELECT standort_id, CAST(ts_local AS VARCHAR) AS ts_local, outside_validity, zero_run,
  complete AND NOT dst_ambiguous AND NOT zero_run AND NOT outside_validity AND NOT {SKIP.format("ts_local")} AND raw_total IS NOT NULL AS observed,
  concat_ws('|', CASE WHEN zero_run THEN 'zero_run' END, CASE WHEN dst_ambiguous THEN 'dst_ambiguous' END, CASE WHEN outside_validity THEN 'outside_metadata_validity' END, CASE WHEN NOT complete THEN 'partial_hour' END) AS quality_flags FROM fl""")
def observed_mask_flags_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Validity, zero runs (6 hours here), the observed mask and flag text."""
    return _masked(raw_quarters(spark, d), spark, d)


def _masked(raw: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    h = rollup.zero_runs(rollup.hourly(raw), least=6)
    h = h.join(first_device(spark, d), "standort_id", "left")
    h = rollup.observed(h.withColumn("outside_validity", rollup.outside_validity(F.col("ts_local"), F.col("valid_from"), F.col("valid_to"))))
    return h.select("standort_id", F.col("ts_local").cast("string").alias("ts_local"), "outside_validity", "zero_run", "observed", "quality_flags")


# The same over every readable row. DuckDB cannot read all notations, so the four above, which have
# SQL, check the operators on the canonical ones.


def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    h = rollup.hourly(every_quarter(spark, d))
    return h.withColumn("ts_local", F.col("ts_local").cast("string"))


R()(hourly_rollup)


def majority_direction(spark: SparkSession, d: str) -> DataFrame:
    return rollup.majority_direction(every_quarter(spark, d))


R()(majority_direction)


def active_ids(spark: SparkSession, d: str) -> DataFrame:
    return rollup.active_ids(every_quarter(spark, d))


R()(active_ids)


def observed_mask_flags(spark: SparkSession, d: str) -> DataFrame:
    return _masked(every_quarter(spark, d), spark, d)


R()(observed_mask_flags)


CH = "ch AS (SELECT standort_id, ts_local, max(raw_total) AS raw_total FROM counts_hourly GROUP BY 1, 2)"


@R(f"""WITH {CH}, s AS (SELECT *, CASE WHEN lag(ts_local) OVER w IS NULL OR ts_local - lag(ts_local) OVER w <> INTERVAL 1 HOUR OR NOT coalesce(raw_total = 0, false) OR NOT coalesce(lag(coalesce(raw_total = 0, false)) OVER w, false) THEN 1 ELSE 0 END AS s FROM ch WINDOW w AS (PARTITION BY standort_id ORDER BY ts_local)),
r AS (SELECT *, sum(s) OVER (PARTITION BY standort_id ORDER BY ts_local) AS run FROM s),
z AS (SELECT *, raw_total = 0 AND sum(CASE WHEN raw_total = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY standort_id, run) >= 48 AS zero_run FROM r)
SELECT standort_id, count(*) FILTER (WHERE zero_run) AS zero_run_hours, count(*) AS n_hours FROM z GROUP BY 1""")
def zero_run_islands(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "counts_hourly").groupBy("standort_id", "ts_local").agg(F.max("raw_total").alias("raw_total"))
    return rollup.zero_runs(h).groupBy("standort_id").agg(F.count_if("zero_run").alias("zero_run_hours"), F.count("*").alias("n_hours"))


@R("""SELECT standort_id, min(site_id) AS site_id, CAST(min(ts_local) AS VARCHAR) AS first_hour, CAST(max(ts_local) AS VARCHAR) AS last_hour, count(*) AS hours_present, count(*) FILTER (WHERE observed) AS hours_observed, count(*) FILTER (WHERE NOT complete) AS partial_hours, count(*) FILTER (WHERE dst_ambiguous) AS dst_ambiguous_hours,
  count(*) FILTER (WHERE zero_run) AS zero_run_hours, count(*) FILTER (WHERE outside_validity) AS outside_validity_hours, count(*) FILTER (WHERE raw_total = 0 AND observed) AS zero_hours_kept, round(count(*) FILTER (WHERE observed) / CAST(date_diff('hour', min(ts_local), max(ts_local)) + 1 AS DOUBLE), 3) AS coverage_of_span FROM counts_hourly GROUP BY 1""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    q = quality.summary(table(spark, d, "counts_hourly"))
    return q.withColumn("first_hour", F.col("first_hour").cast("string")).withColumn("last_hour", F.col("last_hour").cast("string"))


@R("SELECT count(*) AS device_hours, round(avg(CAST(observed AS DOUBLE)), 4) AS observed_share, count(*) FILTER (WHERE NOT complete) AS partial_hours, count(*) FILTER (WHERE dst_ambiguous) AS dst_ambiguous_hours, count(*) FILTER (WHERE zero_run) AS zero_run_hours, count(DISTINCT site_id) AS sites, count(DISTINCT standort_id) AS devices FROM counts_hourly")
def global_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.totals(table(spark, d, "counts_hourly"))


@R("SELECT site_id, CAST(min(ts_local) AS VARCHAR) AS first, CAST(max(ts_local) AS VARCHAR) AS last, count(*) AS n_rows, count(DISTINCT standort_id) AS n_parts, array_to_string(list_sort(list(DISTINCT CAST(standort_id AS VARCHAR))), '|') AS parts, count(*) FILTER (WHERE raw_total IS NULL) AS missing, round(avg(CASE WHEN raw_total = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM counts_hourly GROUP BY 1")
def station_audit(spark: SparkSession, d: str) -> DataFrame:
    a = quality.station_audit(table(spark, d, "counts_hourly"), "site_id", "ts_local", "raw_total", "standort_id")
    return a.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string")).withColumn("zero_share", F.round("zero_share", 6))


@R("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM counts_hourly GROUP BY standort_id, ts_local HAVING count(*) > 1)")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "counts_hourly"), ["standort_id", "ts_local"])


@R("SELECT site_id, CAST(ts_local AS VARCHAR) AS ts_local, max(standort_id) AS standort_id, max(r) FILTER (WHERE k = 1) AS raw_total FROM (SELECT site_id, ts_local, standort_id, r, row_number() OVER (PARTITION BY site_id, ts_local ORDER BY standort_id DESC) AS k FROM (SELECT site_id, ts_local, standort_id, max(raw_total) AS r FROM counts_hourly GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def site_hours_last_device(spark: SparkSession, d: str) -> DataFrame:
    """Two devices in one site-hour, the larger id wins."""
    h = table(spark, d, "counts_hourly").groupBy("site_id", "ts_local", "standort_id").agg(F.max("raw_total").alias("raw_total"))
    return rollup.site_hours_last_device(h).withColumn("ts_local", F.col("ts_local").cast("string"))


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """Each device of a site as a lane of that station."""
    return table(spark, d, "counts_hourly").select(F.col("site_id").alias("station"), "ts_local", F.col("standort_id").alias("lane"), F.col("raw_total").alias("n"))


LANES = """per AS (SELECT site_id AS station, ts_local, sum(raw_total) AS total, count(raw_total) AS n_reported, count(DISTINCT standort_id) AS n_lanes, count(*) AS n_rows FROM counts_hourly GROUP BY 1, 2),
usual AS (SELECT station, min(n_lanes) AS expected_lanes FROM (SELECT station, n_lanes, rank() OVER (PARTITION BY station ORDER BY count(*) DESC) AS k FROM per GROUP BY 1, 2) WHERE k = 1 GROUP BY 1)"""


@R(f"WITH {LANES} SELECT station, CAST(ts_local AS VARCHAR) AS ts_local, total, n_reported, n_lanes, n_rows, expected_lanes, least(n_reported / CAST(expected_lanes AS DOUBLE), 1.0) AS completeness FROM per JOIN usual USING (station)")
def lane_completeness_mode(spark: SparkSession, d: str) -> DataFrame:
    return rollup.lanes_hourly(lanes(spark, d)).withColumn("ts_local", F.col("ts_local").cast("string"))


@R(f"""WITH {LANES}, j AS (SELECT per.*, expected_lanes, ts_local - INTERVAL 1 HOUR AS u FROM per JOIN usual USING (station)),
z AS (SELECT *, make_date(year(u), 3, 31) - CAST(dayofweek(make_date(year(u), 3, 31)) AS INTEGER) AS a, make_date(year(u), 10, 31) - CAST(dayofweek(make_date(year(u), 10, 31)) AS INTEGER) AS b FROM j),
w AS (SELECT *, CASE WHEN u >= CAST(a AS TIMESTAMP) + INTERVAL 1 HOUR AND u < CAST(b AS TIMESTAMP) + INTERVAL 1 HOUR THEN u + INTERVAL 2 HOUR ELSE u + INTERVAL 1 HOUR END AS t FROM z)
SELECT station, CAST(t AS VARCHAR) AS ts_wall, sum(total) AS total, count(*) > 1 AS dst_ambiguous, least(CAST(sum(n_reported) AS DOUBLE) / (min(expected_lanes) * count(*)), 1.0) AS completeness FROM w GROUP BY 1, 2""")
def lanes_to_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    """A second source at a fixed offset, shifted to wall-clock time and re-aggregated."""
    return rollup.lanes_to_wall(rollup.lanes_hourly(lanes(spark, d))).withColumn("ts_wall", F.col("ts_wall").cast("string"))


@R(f"SELECT row_id, {REPEAT.format('ts_local')} AS autumn_repeat, {SKIP.format('ts_local')} AS spring_skip FROM panel_long")
def dst_flags(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts_local")
    return table(spark, d, "panel_long").select("row_id", cal.autumn_repeat(ts).alias("autumn_repeat"), cal.spring_skip(ts).alias("spring_skip"))


# --- calendar ----------------------------------------------------------------------

HOLIDAYS = ["2023-01-01", "2023-04-07", "2023-05-01", "2023-08-01", "2023-12-25"]
SCHOOL = [("2023-04-24", "2023-05-06", "Frühlingsferien"), ("2023-07-17", "2023-08-19", "Sommerferien"), ("2023-05-19", "2023-05-19", "Schulfrei nach Auffahrt"), ("2023-09-11", "2023-09-12", "Knabenschiessen"), ("2023-12-25", "2023-12-20", "schulfreier Tag")]


def year_calendar(spark: SparkSession) -> DataFrame:
    ph = spark.createDataFrame([(x,) for x in HOLIDAYS], "day string").select(F.to_date("day").alias("day"))
    sc = spark.createDataFrame(SCHOOL, "a string, b string, summary string").select(F.to_date("a").alias("start_day"), F.to_date("b").alias("end_day"), "summary")
    return cal.calendar(cal.hour_spine(spark, "2023-01-01 00:00:00", "2024-01-01 00:00:00"), ph, sc)


_SCHOOL_SQL = ", ".join(f"(DATE '{a}', DATE '{b}', '{s}')" for a, b, s in SCHOOL)
CALENDAR = f"""sp AS (SELECT unnest(generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '2023-12-31 23:00:00', INTERVAL 1 HOUR)) AS ts_local),
sc AS (SELECT *, lower(s) LIKE '%ferien%' AS hol, lower(s) NOT LIKE '%ferien%' AND lower(s) LIKE '%schulfrei%' AS free, CASE WHEN b > a THEN b ELSE CAST(a + INTERVAL 1 DAY AS DATE) END AS e FROM (VALUES {_SCHOOL_SQL}) AS v(a, b, s)),
cal AS (SELECT ts_local, hour(ts_local) AS hour, CAST((dayofweek(ts_local) + 6) % 7 AS INTEGER) AS dow, month(ts_local) AS month, year(ts_local) AS year, CAST(ts_local AS DATE) IN ({", ".join(f"DATE '{x}'" for x in HOLIDAYS)}) AS public_holiday,
  coalesce((SELECT bool_or(hol) FROM sc WHERE CAST(ts_local AS DATE) >= a AND CAST(ts_local AS DATE) < e), false) AS school_holiday, coalesce((SELECT bool_or(free) FROM sc WHERE CAST(ts_local AS DATE) >= a AND CAST(ts_local AS DATE) < e), false) AS school_free_day,
  sin(2 * pi() * dayofyear(ts_local) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(ts_local) / 365.25) AS doy_cos FROM sp),
c2 AS (SELECT *, dow >= 5 AS is_weekend, NOT (dow >= 5) AND NOT public_holiday AS workday FROM cal)"""


@R(f"WITH {CALENDAR} SELECT CAST(ts_local AS VARCHAR) AS ts_local, hour, dow, month, year, public_holiday, school_holiday, school_free_day, is_weekend, workday, workday AND hour IN (7, 8, 16, 17, 18) AS peak, round(doy_sin, 6) AS doy_sin, round(doy_cos, 6) AS doy_cos FROM c2")
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    """J07 J08 and the calendar columns over one year of hours."""
    c = year_calendar(spark).drop("sun_elev")
    return c.withColumn("ts_local", F.col("ts_local").cast("string")).withColumn("doy_sin", F.round("doy_sin", 6)).withColumn("doy_cos", F.round("doy_cos", 6))


@R("""WITH u AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events),
x AS (SELECT t, radians(23.44) * sin(2 * pi() * (284 + dayofyear(t + INTERVAL 30 MINUTE)) / 365) AS decl, radians(15 * (hour(t + INTERVAL 30 MINUTE) + minute(t + INTERVAL 30 MINUTE) / 60.0 - 12) + 8.54) AS ang, radians(47.37) AS la FROM u)
SELECT CAST(t AS VARCHAR) AS ts_utc, round(degrees(asin(sin(la) * sin(decl) + cos(la) * cos(decl) * cos(ang))), 4) AS sun_elev FROM x""")
def solar_elevation(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select(cal.naive_trunc("HOUR", F.col("ts")).alias("t")).distinct()
    return u.select(F.col("t").cast("string").alias("ts_utc"), F.round(cal.solar_elevation(F.col("t")), 4).alias("sun_elev"))


COVID = [("2021-01-18", "2021-05-31"), ("2021-12-20", "2022-02-03")]


@R("SELECT year(ts_local) AS year, count(*) FILTER (WHERE (ts_local >= TIMESTAMP '2021-01-18' AND ts_local < TIMESTAMP '2021-05-31') OR (ts_local >= TIMESTAMP '2021-12-20' AND ts_local < TIMESTAMP '2022-02-03')) AS n_in FROM panel_long GROUP BY 1")
def dated_interval_flags(spark: SparkSession, d: str) -> DataFrame:
    """Membership in dated ranges."""
    t = table(spark, d, "panel_long").select(F.year("ts_local").alias("year"), cal.in_any(F.col("ts_local"), COVID).alias("hit"))
    return t.groupBy("year").agg(F.count_if("hit").alias("n_in"))


# --- weather-like series (events averaged by hour) --------------------------------------


def two_files(spark: SparkSession, d: str) -> list[DataFrame]:
    e = table(spark, d, "events")
    hour = cal.naive_trunc("HOUR", F.col("ts")).alias("ts")
    first = e.where("event_type IN ('view', 'click')").groupBy(hour).agg(F.avg("value").alias("temp"))
    second = e.where("event_type = 'purchase'").groupBy(hour).agg(F.avg("value").alias("temp"), F.max("value").alias("wind"))
    return [first, second]


FILES = """f AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS temp, NULL AS wind, 0 AS rk FROM events WHERE event_type IN ('view', 'click') GROUP BY 1
  UNION ALL SELECT date_trunc('hour', ts), avg(value), max(value), 1 FROM events WHERE event_type = 'purchase' GROUP BY 1),
m AS (SELECT ts, temp, wind FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY rk DESC) AS k FROM f) WHERE k = 1)"""


@R(f"WITH {FILES} SELECT CAST(ts AS VARCHAR) AS ts, round(temp, 6) AS temp, wind FROM m")
def last_file_wins(spark: SparkSession, d: str) -> DataFrame:
    """Union by name, keep the last file's row."""
    m = weather.last_file_wins(two_files(spark, d), "ts")
    return m.select(F.col("ts").cast("string").alias("ts"), F.round("temp", 6).alias("temp"), "wind")


DENSE = """c AS (SELECT standort_id, ts_local AS ts, max(raw_total) AS n FROM counts_hourly GROUP BY 1, 2),
sp AS (SELECT standort_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM c GROUP BY 1),
s AS (SELECT standort_id, ts, n FROM sp LEFT JOIN c USING (standort_id, ts))"""


def device_series(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every device on its hours from first to last: standort_id, ts, n, filled."""
    c = table(spark, d, "counts_hourly").groupBy("standort_id", F.col("ts_local").alias("ts")).agg(F.max("raw_total").alias("n"))
    span = c.groupBy("standort_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = span.select("standort_id", F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("ts"))
    return weather.on_spine(spine, c, ["standort_id", "ts"], ["n"])


@R(f"WITH {DENSE} SELECT standort_id, CAST(ts AS VARCHAR) AS ts, n, n IS NULL AS filled FROM s")
def spine_left_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every device's dense hours with what was counted."""
    return device_series(spark, d).withColumn("ts", F.col("ts").cast("string"))


@R(f"""WITH {DENSE}, i AS (SELECT *, row_number() OVER (PARTITION BY standort_id ORDER BY ts) AS i FROM s),
n AS (SELECT *, last_value(n IGNORE NULLS) OVER b AS v0, first_value(n IGNORE NULLS) OVER f AS v1, last_value(CASE WHEN n IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN n IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1 FROM i
  WINDOW b AS (PARTITION BY standort_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY standort_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT standort_id, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN n IS NOT NULL THEN n WHEN i - i0 <= 3 AND i1 IS NOT NULL THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS n FROM n""")
def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """The first three hours of every interior gap of each device."""
    x = weather.interpolated(device_series(spark, d), "ts", "n", 3, "standort_id")
    return x.select("standort_id", F.col("ts").cast("string").alias("ts"), F.round("n", 6).alias("n"))

"""Daily panel, indices and anomalies: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countweave.functions import calendar as cal
from countweave.operators import anomalies, panel
from countweave.plans import clean
from countweave.plans.registry import Registry
from countweave.sources.tables import table

R = Registry()
BASE, TARGET, DAYS = 2021, 2022, 60
# The published yearly index of the analysed vintage.
OFFICIAL = {2012: 100.0, 2019: 156.6, 2020: 169.9, 2021: 163.5, 2022: 184.4, 2023: 188.0, 2024: 193.4, 2025: 207.6}


def daily(spark: SparkSession, d: str) -> DataFrame:
    """daily_panel without its repeated and null days: one row per site, device and day."""
    t = table(spark, d, "daily_panel").where("total IS NOT NULL")
    return t.groupBy("site_id", "standort_id", F.to_date("day").alias("day")).agg(F.max("total").cast("double").alias("total"), F.max("corrected").alias("corrected"), F.max("cf").alias("cf"), F.max("coverage_id").alias("coverage_id"), F.max("year").alias("year"), F.max("month").alias("month"))


DAILY = "d AS (SELECT site_id, standort_id, CAST(day AS DATE) AS day, CAST(max(total) AS DOUBLE) AS total, max(corrected) AS corrected, max(cf) AS cf, max(coverage_id) AS coverage_id, max(year) AS year, max(month) AS month FROM daily_panel WHERE total IS NOT NULL GROUP BY 1, 2, 3)"
SY = "sy AS (SELECT site_id, year, avg(total) AS raw, avg(corrected) AS corrected, count(*) AS days FROM d GROUP BY 1, 2)"
SYD = f"{DAILY}, {SY}, sd AS (SELECT * FROM sy WHERE days >= {DAYS})"


@R("""WITH g AS (SELECT site_id, standort_id, CAST(ts_local AS DATE) AS day, sum(raw_total) AS total, count(*) AS n, count(*) FILTER (WHERE observed) AS o FROM counts_hourly GROUP BY 1, 2, 3)
SELECT site_id, standort_id, CAST(day AS VARCHAR) AS day, total FROM g WHERE n = 24 AND o = 24""")
def full_day_totals(spark: SparkSession, d: str) -> DataFrame:
    return panel.full_days(table(spark, d, "counts_hourly")).withColumn("day", F.col("day").cast("string"))


_COVER = """cov AS (SELECT *, sum(new) OVER (PARTITION BY site_id ORDER BY valid_from, rec_id ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, CASE WHEN lag(cf) OVER w IS NULL OR lag(cf) OVER w <> cf THEN 1 ELSE 0 END AS new FROM (SELECT *, coalesce(correction_factor, 1.0) AS cf FROM site_devices WHERE valid_from IS NOT NULL) WINDOW w AS (PARTITION BY site_id ORDER BY valid_from, rec_id)))"""


def covered(spark: SparkSession, d: str) -> DataFrame:
    dev = table(spark, d, "site_devices").where("valid_from IS NOT NULL")
    # records have no unique device id here: rec_id breaks ties
    return panel.coverage_periods(dev.withColumn("device", F.col("standort_id")).withColumn("standort_id", F.col("rec_id")))


@R(f"WITH {_COVER} SELECT rec_id, cf, site_id || '#' || CAST(k AS VARCHAR) AS coverage_id FROM cov")
def coverage_periods(spark: SparkSession, d: str) -> DataFrame:
    """Run ids over changes of the factor."""
    return covered(spark, d).select("rec_id", "cf", "coverage_id")


@R("SELECT site_id, rec_id FROM (SELECT site_id, rec_id, row_number() OVER (PARTITION BY site_id ORDER BY valid_from DESC, rec_id DESC) AS k FROM site_devices WHERE valid_from IS NOT NULL) WHERE k = 1")
def latest_device(spark: SparkSession, d: str) -> DataFrame:
    """The latest record per site."""
    t = table(spark, d, "site_devices").where("valid_from IS NOT NULL")
    return t.groupBy("site_id").agg(F.max_by("rec_id", F.struct("valid_from", "rec_id")).alias("rec_id"))


@R("SELECT site_id, CAST(CAST(valid_from AS DATE) AS VARCHAR) AS swap, device_id, cf_before, cf_after FROM (SELECT *, lag(cf) OVER w AS cf_before, cf AS cf_after, row_number() OVER w AS k FROM (SELECT *, coalesce(correction_factor, 1.0) AS cf FROM site_devices WHERE valid_from IS NOT NULL) WINDOW w AS (PARTITION BY site_id ORDER BY valid_from, rec_id)) WHERE k > 1")
def device_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive devices of a site."""
    dev = table(spark, d, "site_devices").where("valid_from IS NOT NULL").withColumn("standort_id", F.col("rec_id"))
    return anomalies.device_pairs(dev).withColumn("swap", F.col("swap").cast("string"))


@R("WITH g AS (SELECT site_id, count(DISTINCT standort_id) AS n_devices, arg_max(x, valid_from * 1) AS lx FROM (SELECT site_id, standort_id, x, y, epoch(valid_from) * 1000000 + rec_id AS valid_from FROM site_devices WHERE valid_from IS NOT NULL) GROUP BY 1), l AS (SELECT site_id, arg_max(x, k) AS lx, arg_max(y, k) AS ly, count(DISTINCT standort_id) AS n_devices FROM (SELECT *, epoch(valid_from) * 1000000 + rec_id AS k FROM site_devices WHERE valid_from IS NOT NULL) GROUP BY 1) SELECT l.site_id, n_devices, round(max(sqrt((s.x - lx) ** 2 + (s.y - ly) ** 2)), 3) AS max_relocation_m FROM l JOIN site_devices s ON s.site_id = l.site_id AND s.valid_from IS NOT NULL GROUP BY 1, 2")
def relocation_spread(spark: SparkSession, d: str) -> DataFrame:
    """Devices per site and the largest distance to its latest position."""
    t = table(spark, d, "site_devices").where("valid_from IS NOT NULL")
    last = t.groupBy("site_id").agg(F.max_by(F.struct("x", "y"), F.struct("valid_from", "rec_id")).alias("l"), F.countDistinct("standort_id").alias("n_devices"))
    return t.join(last, "site_id").groupBy("site_id").agg(F.first("n_devices").alias("n_devices"), F.round(F.max(F.hypot(F.col("x") - F.col("l.x"), F.col("y") - F.col("l.y"))), 3).alias("max_relocation_m"))


@R("SELECT rec_id, dir_out IS NULL OR trim(dir_out) IN ('', '---') AS one_direction FROM site_devices")
def single_direction(spark: SparkSession, d: str) -> DataFrame:
    from countweave.operators.rollup import single_direction as one

    return table(spark, d, "site_devices").select("rec_id", one(F.col("dir_out")).alias("one_direction"))


_ENRICH = f"""{clean.CALENDAR}, {DAILY},
w AS (SELECT CAST(u AS DATE) AS day, avg(value) AS temp, coalesce(sum(CASE WHEN value > 20 THEN value END), 0) AS precip FROM (
  SELECT value, CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 1 HOUR END - INTERVAL 365 DAY AS u FROM events) GROUP BY 1),
cd AS (SELECT CAST(ts_local AS DATE) AS day, min(dow) AS dow, bool_or(public_holiday) AS holiday, bool_or(school_holiday) AS school FROM c2 GROUP BY 1)"""


@R(f"WITH {_ENRICH} SELECT d.site_id, d.standort_id, CAST(d.day AS VARCHAR) AS day, total, round(temp, 6) AS temp, round(precip, 4) AS precip, dow, holiday, school, isoyear(d.day) || '-' || lpad(CAST(weekofyear(d.day) AS VARCHAR), 2, '0') AS week FROM d JOIN w USING (day) JOIN cd USING (day)")
def daily_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Daily panel with weather of local days and calendar of days."""
    e = table(spark, d, "events")
    local = F.to_date(F.from_utc_timestamp("ts", "Europe/Zurich") - F.expr("INTERVAL 365 DAY"))
    w = e.groupBy(local.alias("day")).agg(F.avg("value").alias("temp"), F.coalesce(F.sum(F.when(F.col("value") > 20, F.col("value"))), F.lit(0.0)).alias("precip"))
    c = panel.daily_calendar(clean.year_calendar(spark)).drop("month")
    x = daily(spark, d).join(w, "day").join(c, "day")
    return x.select("site_id", "standort_id", F.col("day").cast("string").alias("day"), "total", F.round("temp", 6).alias("temp"), F.round("precip", 4).alias("precip"), "dow", "holiday", "school", cal.iso_week_text(F.col("day")).alias("week"))


@R(f"WITH {SYD} SELECT site_id, year, round(raw, 4) AS raw, round(corrected, 4) AS corrected, days FROM sd")
def site_years(spark: SparkSession, d: str) -> DataFrame:
    return panel.site_years(daily(spark, d), DAYS).withColumn("raw", F.round("raw", 4)).withColumn("corrected", F.round("corrected", 4))


_VAR = ["pooled_raw", "pooled_corrected"] + [f"{n}_of_site_means_{c}{s}" for c in ("raw", "corrected") for s in ("", "_min") for n in ("mean", "median")]
_VAR_SQL = f"""{SYD},
po AS (SELECT year, avg(total) AS pooled_raw, avg(corrected) AS pooled_corrected FROM d GROUP BY 1),
ms AS (SELECT year, {", ".join(f"{'avg' if n == 'mean' else 'median'}({c}) {'FILTER (WHERE days >= %d)' % DAYS if s else ''} AS {n}_of_site_means_{c}{s}" for c in ("raw", "corrected") for s in ("", "_min") for n in ("mean", "median"))}, count(*) AS n_sites, count(*) FILTER (WHERE days >= {DAYS}) AS n_sites_min FROM sy GROUP BY 1),
v AS (SELECT * FROM po JOIN ms USING (year)), b AS (SELECT * FROM v WHERE year = {BASE}),
ix AS (SELECT v.year, {", ".join(f"100 * v.{c} / b.{c} AS {c}" for c in _VAR)}, v.n_sites, v.n_sites_min FROM v, b)"""


@R(f"WITH {_VAR_SQL} SELECT year, {', '.join(f'round({c}, 4) AS {c}' for c in _VAR)}, n_sites, n_sites_min FROM ix")
def index_variants(spark: SparkSession, d: str) -> DataFrame:
    """Ten variants of the annual index."""
    x = panel.variants(daily(spark, d), BASE, DAYS)
    return x.select("year", *[F.round(c, 4).alias(c) for c in _VAR], "n_sites", "n_sites_min")


@R(f"WITH {_VAR_SQL} SELECT year, round(median_of_site_means_raw, 4) AS median_index FROM ix")
def median_index(spark: SparkSession, d: str) -> DataFrame:
    """The headline: median of site means, rebased."""
    sy = panel.site_years(daily(spark, d), 1)
    m = sy.groupBy("year").agg(F.median("raw").alias("m"))
    return panel.rebased(m, ["m"], BASE).select("year", F.round("m", 4).alias("median_index"))


_OFF = ", ".join(f"({y}, {v})" for y, v in OFFICIAL.items())


@R(f"WITH {_VAR_SQL}, o AS (SELECT * FROM (VALUES {_OFF}) AS t(year, official)), l AS (UNPIVOT (SELECT year, {', '.join(_VAR)} FROM ix) ON {', '.join(_VAR)} INTO NAME variant VALUE value) SELECT variant, round(sqrt(avg((value - official) ** 2)), 4) AS rmse FROM l JOIN o USING (year) GROUP BY 1")
def index_rmse_rank(spark: SparkSession, d: str) -> DataFrame:
    """Root mean squared difference of every variant from a published series."""
    o = spark.createDataFrame(list(OFFICIAL.items()), "year int, official double")
    return panel.rmse_rank(panel.variants(daily(spark, d), BASE, DAYS), o, _VAR).withColumn("rmse", F.round("rmse", 4))


@R(f"WITH {_VAR_SQL}, o AS (SELECT * FROM (VALUES {_OFF}) AS t(year, official)), l AS (UNPIVOT (SELECT year, {', '.join(_VAR)} FROM ix) ON {', '.join(_VAR)} INTO NAME variant VALUE value), r AS (SELECT variant, sqrt(avg((value - official) ** 2)) AS rmse FROM l JOIN o USING (year) GROUP BY 1) SELECT variant, round(rmse, 4) AS rmse FROM r ORDER BY round(rmse, 9), variant LIMIT 1")
def best_variant(spark: SparkSession, d: str) -> DataFrame:
    """The variant closest to the published series."""
    o = spark.createDataFrame(list(OFFICIAL.items()), "year int, official double")
    r = panel.rmse_rank(panel.variants(daily(spark, d), BASE, DAYS), o, _VAR)
    return panel.best(r, "variant", "rmse").withColumn("rmse", F.round("rmse", 4))


_FIXED = f"fp AS (SELECT a.site_id FROM sd a JOIN sd b ON a.site_id = b.site_id WHERE a.year = {BASE} AND b.year = {TARGET})"


@R(f"WITH {SYD}, {_FIXED} SELECT * FROM fp")
def fixed_panel_members(spark: SparkSession, d: str) -> DataFrame:
    return panel.fixed_panel(daily(spark, d), BASE, TARGET, DAYS)


@R(f"WITH {SYD} SELECT site_id FROM sd WHERE year BETWEEN 2021 AND 2022 GROUP BY 1 HAVING count(*) = 2")
def stable_panel(spark: SparkSession, d: str) -> DataFrame:
    """Relational division."""
    return panel.stable_panel(daily(spark, d), 2021, 2022, DAYS)


_RATIO = f"{SYD}, {_FIXED}, ra AS (SELECT site_id, avg(total) FILTER (WHERE year = {BASE}) AS a, avg(total) FILTER (WHERE year = {TARGET}) AS b FROM d WHERE site_id IN (SELECT site_id FROM fp) GROUP BY 1)"


@R(f"WITH {_RATIO} SELECT site_id, round(a, 4) AS a, round(b, 4) AS b, round(b / a, 5) AS ratio FROM ra")
def per_site_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d)
    return panel.ratios(x, panel.fixed_panel(x, BASE, TARGET, DAYS), BASE, TARGET).select("site_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("ratio", 5).alias("ratio"))


@R(f"WITH {_RATIO} SELECT round(sum(b) / sum(a), 5) AS ratio, count(*) AS n_sites FROM ra")
def unadjusted_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d)
    return panel.summed_ratio(panel.ratios(x, panel.fixed_panel(x, BASE, TARGET, DAYS), BASE, TARGET)).withColumn("ratio", F.round("ratio", 5))


@R(f"""WITH {SYD}, g AS (SELECT site_id, max(corrected) FILTER (WHERE year = {BASE}) AS a, max(corrected) FILTER (WHERE year = {TARGET}) AS b FROM sd WHERE year IN ({BASE}, {TARGET}) GROUP BY 1),
x AS (SELECT avg(a) AS aa, avg(b) AS ba, avg(a) FILTER (WHERE b IS NOT NULL) AS sa, avg(b) FILTER (WHERE a IS NOT NULL) AS sb, count(a) AS n_base, count(b) AS n_target, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_stayers, count(*) FILTER (WHERE b IS NULL) AS n_leavers, count(*) FILTER (WHERE a IS NULL) AS n_entrants FROM g)
SELECT round(ba / aa, 6) AS "all", round(sb / sa, 6) AS stayers, round((ba / sb) / (aa / sa), 6) AS mix, n_base, n_target, n_stayers, n_leavers, n_entrants FROM x""")
def composition_split(spark: SparkSession, d: str) -> DataFrame:
    """A26 O06 O07."""
    c = panel.composition(panel.site_years(daily(spark, d), DAYS), BASE, TARGET)
    return c.select(*[F.round(k, 6).alias(k) for k in ("all", "stayers", "mix")], "n_base", "n_target", "n_stayers", "n_leavers", "n_entrants")


@R(f"""WITH {SYD}, y AS (SELECT * FROM sd WHERE year IN ({BASE}, {TARGET})), s AS (SELECT DISTINCT site_id FROM y)
SELECT s.site_id AS left_out, round(median(corrected) FILTER (WHERE year = {TARGET}) / median(corrected) FILTER (WHERE year = {BASE}), 6) AS ratio FROM s JOIN y ON y.site_id <> s.site_id GROUP BY 1""")
def loo_median(spark: SparkSession, d: str) -> DataFrame:
    """Without pairs of sites."""
    return panel.loo_median_ratio(panel.site_years(daily(spark, d), DAYS), BASE, TARGET).withColumn("ratio", F.round("ratio", 6))


@R(f"""WITH {DAILY}, m AS (SELECT site_id, year(day) || 'Q' || quarter(day) AS quarter, avg(total) AS m FROM d GROUP BY 1, 2)
SELECT quarter, round(max(m) FILTER (WHERE site_id = 'VZS_HUB') / median(m), 5) AS relative FROM m GROUP BY 1 HAVING max(m) FILTER (WHERE site_id = 'VZS_HUB') IS NOT NULL""")
def quarterly_relative(spark: SparkSession, d: str) -> DataFrame:
    return panel.quarterly_relative(daily(spark, d), "VZS_HUB").withColumn("relative", F.round("relative", 5))


@R(f"WITH {DAILY} SELECT year, round(avg(total) FILTER (WHERE dayofweek(day) IN (0, 6)) / avg(total), 6) AS weekend_share FROM d GROUP BY 1")
def weekend_share(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d).withColumn("weekend", cal.dow(F.col("day")) >= 5)
    return panel.weekend_share(x).withColumn("weekend_share", F.round("weekend_share", 6))


@R("SELECT year(ts_local) AS year, round(sum(raw_total) FILTER (WHERE hour(ts_local) IN (7, 8, 16, 17, 18) AND dayofweek(ts_local) NOT IN (0, 6)) / sum(raw_total), 6) AS peak_share FROM counts_hourly WHERE observed GROUP BY 1")
def peak_share(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts_local")
    h = table(spark, d, "counts_hourly").where("observed").select(F.year(ts).alias("year"), "raw_total", (F.hour(ts).isin(*cal.PEAK_HOURS) & (cal.dow(ts) < 5)).alias("peak"))
    return panel.peak_share(h).withColumn("peak_share", F.round("peak_share", 6))


@R(f"""WITH {SYD}, l AS (SELECT a.year AS from_year, sum(b.raw) / sum(a.raw) AS ratio, count(*) AS n_sites FROM sd a JOIN sd b ON a.site_id = b.site_id AND b.year = a.year + 1 GROUP BY 1)
SELECT from_year, from_year + 1 AS to_year, n_sites, round(ratio, 6) AS ratio, round(exp(sum(ln(ratio)) OVER (ORDER BY from_year)), 5) AS cumulative FROM l""")
def chain_product(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative product of yearly links."""
    return panel.chain(daily(spark, d), DAYS).withColumn("ratio", F.round("ratio", 6)).withColumn("cumulative", F.round("cumulative", 5))


@R(f"""WITH {SYD}, m AS (SELECT year, median(ln(raw)) AS m FROM sd GROUP BY 1), r AS (SELECT site_id, sd.year, ln(raw) - m AS rel FROM sd JOIN m USING (year) WHERE true),
x AS (SELECT site_id, lag(year) OVER w AS from_year, year AS to_year, lag(rel) OVER w AS was, rel, lead(rel) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY site_id ORDER BY year))
SELECT site_id, from_year, to_year, round(exp(rel - was), 5) AS rel_step_x, coalesce(abs(nxt - was) < ln(1.15), false) AS reverts_next_year FROM x WHERE abs(rel - was) > ln(1.25)""")
def level_jump_scan(spark: SparkSession, d: str) -> DataFrame:
    """W06 M26."""
    return anomalies.level_jumps(panel.site_years(daily(spark, d), DAYS)).withColumn("rel_step_x", F.round("rel_step_x", 5))


def swaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "device_swap_steps").select(F.col("site").alias("site_id"), F.col("swap").cast("date").alias("swap"), "row_id")


@R(f"""WITH {DAILY}, o AS (SELECT site_id, day, sum(ln(1 + total)) AS s, count(total) AS n FROM d GROUP BY 1, 2), sw AS (SELECT DISTINCT site AS own, CAST(swap AS DATE) AS swap FROM device_swap_steps),
g AS (SELECT own, swap, site_id, sum(CASE WHEN day < swap THEN s ELSE 0 END) AS sa, sum(CASE WHEN day < swap THEN n ELSE 0 END) AS na, sum(CASE WHEN day >= swap THEN s ELSE 0 END) AS sb, sum(CASE WHEN day >= swap THEN n ELSE 0 END) AS nb FROM sw JOIN o ON day >= swap - 120 AND day < swap + 120 GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN na > 0 AND nb > 0 THEN sb / nb - sa / na END AS ch FROM g),
r AS (SELECT own, swap, max(ch) FILTER (WHERE site_id = own) AS self, max(least(na, nb)) FILTER (WHERE site_id = own) AS n, median(ch) FILTER (WHERE site_id <> own) AS others FROM c GROUP BY 1, 2)
SELECT row_id, round(CASE WHEN n >= 30 THEN exp(self - others) END, 5) AS step_x, coalesce(n >= 30, false) AS testable FROM device_swap_steps t LEFT JOIN r ON r.own = t.site AND r.swap = CAST(t.swap AS DATE)""")
def device_swap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Before and after windows around a swap against the median of the other sites."""
    return anomalies.swap_steps(daily(spark, d), swaps(spark, d)).select("row_id", F.round("step_x", 5).alias("step_x"), "testable")


_EXCLUDE = [("years 2020 and 2021 dropped", "year NOT IN (2020, 2021)"), ("one site dropped", "site_id <> 'VZS_HUB'"), ("site-year dropped", f"NOT (site_id = 'VZS_HUB' AND year = {TARGET})"), ("all kept", "true")]


@R(f"WITH {DAILY}, " + ", ".join(f"v{i} AS (SELECT '{n}' AS anomaly, median(raw) FILTER (WHERE year = {TARGET}) / median(raw) FILTER (WHERE year = {BASE}) AS ratio FROM (SELECT site_id, year, avg(total) AS raw FROM d WHERE {c} GROUP BY 1, 2 HAVING count(*) >= {DAYS}))" for i, (n, c) in enumerate(_EXCLUDE)) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(len(_EXCLUDE))) + ") SELECT u.anomaly, round(u.ratio, 6) AS ratio, round(100 * (u.ratio / v3.ratio - 1), 4) AS change_pct, CASE WHEN u.ratio IS NULL THEN 'city-style figure only' WHEN (u.ratio >= 1.8) <> (v3.ratio >= 1.8) OR abs(u.ratio - 1.8) < 0.01 THEN 'yes' ELSE 'no' END AS changes_verdict FROM u, v3")
def anomaly_variants(spark: SparkSession, d: str) -> DataFrame:
    """What handling each anomaly otherwise changes."""
    x = daily(spark, d)

    def one(name: str, cond: str) -> DataFrame:
        sy = panel.site_years(x.where(cond), DAYS)
        at = lambda y: F.median(F.when(F.col("year") == y, F.col("raw")))
        return sy.agg((at(TARGET) / at(BASE)).alias("ratio")).select(F.lit(name).alias("anomaly"), "ratio")

    cases = None
    for n, c in _EXCLUDE:
        cases = one(n, c) if cases is None else cases.unionByName(one(n, c))
    base = one("base", "true").select(F.col("ratio").alias("base_ratio"))
    return anomalies.impacts(cases, base).select("anomaly", F.round("ratio", 6).alias("ratio"), F.round("change_pct", 4).alias("change_pct"), "changes_verdict")


@R(f"WITH {DAILY}, x AS (SELECT site_id, day, sum(total) AS total FROM d GROUP BY 1, 2) SELECT site_id, max(seg) + 1 AS n_segments FROM (SELECT site_id, sum(n) OVER (PARTITION BY site_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT site_id, day, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY site_id ORDER BY day), day) > 110 THEN 1 ELSE 0 END AS n FROM x)) GROUP BY 1")
def plot_segments(spark: SparkSession, d: str) -> DataFrame:
    """A series breaks where days are missing for long."""
    x = daily(spark, d).groupBy("site_id", F.unix_date("day").alias("at")).agg(F.sum("total").alias("total"))
    return panel.segments(x, "site_id", "at", 110).groupBy("site_id").agg((F.max("segment") + 1).alias("n_segments"))


@R(f"WITH {DAILY} SELECT site_id, coverage_id || '|b' || CAST(CASE WHEN day >= DATE '2019-03-14' THEN 1 ELSE 0 END + CASE WHEN day >= DATE '2020-10-11' THEN 1 ELSE 0 END AS VARCHAR) AS coverage_id, count(*) AS n FROM d WHERE site_id = 'VZS_HUB' GROUP BY 1, 2 UNION ALL SELECT site_id, coverage_id, count(*) FROM d WHERE site_id <> 'VZS_HUB' GROUP BY 1, 2")
def dated_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Coverage ids with dated breaks."""
    x = panel.with_breaks(daily(spark, d), {"VZS_HUB": ["2019-03-14", "2020-10-11"]})
    return x.groupBy("site_id", "coverage_id").agg(F.count("*").alias("n"))

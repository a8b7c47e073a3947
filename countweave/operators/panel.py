"""Daily panels and annual indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countweave.functions.calendar import iso_week_text

MIN_DAYS = 250


def full_days(h: DataFrame) -> DataFrame:
    """site_id, standort_id, day, total of days with exactly 24 rows, all observed."""
    g = h.groupBy("site_id", "standort_id", F.to_date("ts_local").alias("day")).agg(F.sum("raw_total").alias("total"), F.count_if("observed").alias("n_obs"), F.count("*").alias("n"))
    return g.where("n_obs = 24 AND n = 24").drop("n_obs", "n")


def coverage_periods(devices: DataFrame) -> DataFrame:
    """devices with cf (a null factor is 1) and coverage_id: site#k, k counting changes of the
    factor in the order of valid_from (ties: standort_id)."""
    w = Window.partitionBy("site_id").orderBy("valid_from", "standort_id")
    cf = F.coalesce("correction_factor", F.lit(1.0))
    x = devices.withColumn("cf", cf)
    new = F.when(F.lag("cf").over(w).isNull() | (F.lag("cf").over(w) != F.col("cf")), 1).otherwise(0)
    x = x.withColumn("__n", new).withColumn("__k", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("coverage_id", F.concat("site_id", F.lit("#"), F.col("__k").cast("string"))).drop("__n", "__k")


def with_breaks(daily: DataFrame, breaks: dict[str, Sequence[str]]) -> DataFrame:
    """coverage_id of the named sites gets `|b<k>`, k the number of break dates up to the day."""
    out = F.col("coverage_id")
    for site, dates in breaks.items():
        k = sum((F.col("day") >= F.lit(x).cast("date")).cast("int") for x in dates)
        out = F.when(F.col("site_id") == site, F.concat("coverage_id", F.lit("|b"), k.cast("string"))).otherwise(out)
    return daily.withColumn("coverage_id", out)


def daily_weather(weather: DataFrame, zone: str = "Europe/Zurich") -> DataFrame:
    """ts_utc hours -> local days: mean temperature, summed precipitation and sunshine (a day
    without readings sums to 0)."""
    day = F.to_date(F.from_utc_timestamp("ts_utc", zone))
    return weather.groupBy(day.alias("day")).agg(F.avg("temp").alias("temp"), F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip"), F.coalesce(F.sum("sun"), F.lit(0.0)).alias("sun"))


def daily_calendar(cal: DataFrame) -> DataFrame:
    return cal.groupBy(F.to_date("ts_local").alias("day")).agg(F.first("dow").alias("dow"), F.bool_or("public_holiday").alias("holiday"), F.bool_or("school_holiday").alias("school"), F.first("month").alias("month"))


def enriched(daily: DataFrame, devices: DataFrame, weather: DataFrame, cal: DataFrame) -> DataFrame:
    """Full days with factor and coverage, daily weather and calendar; days without either drop out."""
    d = daily.join(devices.select("standort_id", "cf", "coverage_id"), "standort_id", "left")
    d = d.join(weather, "day").join(cal, "day")
    return d.select("*", (F.col("total") * F.col("cf")).alias("corrected"), F.year("day").alias("year"), iso_week_text(F.col("day")).alias("week"))


def site_years(d: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """site_id, year, raw, corrected (means) and days, of site-years with enough days."""
    g = d.groupBy("site_id", "year").agg(F.avg("total").alias("raw"), F.avg("corrected").alias("corrected"), F.count("*").alias("days"))
    return g.where(F.col("days") >= min_days)


def variants(d: DataFrame, base: int, min_days: int = MIN_DAYS) -> DataFrame:
    """year and ten index variants, 100 in the base year: pooled means; means and medians of site
    means, raw and corrected, of all sites and of those with enough days; numbers of sites.

    Site means are condensed once; both eligibility rules read that. The index has one row a year.
    """
    pooled = d.groupBy("year").agg(F.avg("total").alias("pooled_raw"), F.avg("corrected").alias("pooled_corrected"))
    sy = site_years(d, 1)
    ok = F.col("days") >= min_days
    some = lambda c: F.when(ok, F.col(c))
    sites = sy.groupBy("year").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("raw", "corrected") for n, f in (("mean_of_site_means", F.avg), ("median_of_site_means", F.median))],
        *[f(some(c)).alias(f"{n}_{c}_min") for c in ("raw", "corrected") for n, f in (("mean_of_site_means", F.avg), ("median_of_site_means", F.median))],
        F.count("*").alias("n_sites"), F.count_if(ok).alias("n_sites_min"),
    )
    x = pooled.join(sites, "year")
    names = [c for c in x.columns if c not in ("year", "n_sites", "n_sites_min")]
    return rebased(x, names, base)


def rebased(x: DataFrame, names: Sequence[str], base: int) -> DataFrame:
    """Columns divided by their value in the base year, times 100. x has one row a year."""
    w = Window.partitionBy(F.lit(0))
    return x.select(*[(100 * F.col(c) / F.max(F.when(F.col("year") == base, F.col(c))).over(w)).alias(c) if c in names else F.col(c) for c in x.columns])


def rmse_rank(x: DataFrame, official: DataFrame, names: Sequence[str]) -> DataFrame:
    """variant, rmse against official (year, official), best first."""
    long = x.unpivot(["year"], list(names), "variant", "value").join(official, "year")
    return long.groupBy("variant").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("official"), 2))).alias("rmse"))


def best(ranked: DataFrame, key: str, by: str) -> DataFrame:
    return ranked.agg(F.min_by(key, F.struct(F.round(by, 9), key)).alias(key), F.min(by).alias(by))


def fixed_panel(d: DataFrame, base: int, target: int, min_days: int = MIN_DAYS) -> DataFrame:
    """Sites with enough days in both years."""
    g = d.where(F.col("year").isin(base, target)).groupBy("site_id").agg(F.count_if(F.col("year") == base).alias("a"), F.count_if(F.col("year") == target).alias("b"))
    return g.where((F.col("a") >= min_days) & (F.col("b") >= min_days)).select("site_id")


def stable_panel(d: DataFrame, first: int, last: int, min_days: int = MIN_DAYS) -> DataFrame:
    """Sites with enough days in every year of a range: relational division."""
    g = site_years(d.where(F.col("year").between(first, last)), min_days)
    return g.groupBy("site_id").agg(F.count("*").alias("n_years")).where(F.col("n_years") == last - first + 1).select("site_id")


def ratios(d: DataFrame, sites: DataFrame, base: int, target: int) -> DataFrame:
    """Per site: mean of the target year over mean of the base year, unadjusted."""
    p = d.join(sites, "site_id", "left_semi").where(F.col("year").isin(base, target))
    at = lambda y: F.avg(F.when(F.col("year") == y, F.col("total")))
    g = p.groupBy("site_id").agg(at(base).alias("a"), at(target).alias("b"))
    return g.select("site_id", "a", "b", (F.col("b") / F.col("a")).alias("ratio"))


def summed_ratio(r: DataFrame) -> DataFrame:
    return r.agg((F.sum("b") / F.sum("a")).alias("ratio"), F.count("*").alias("n_sites"))


def composition(sy: DataFrame, base: int, target: int, value: str = "corrected") -> DataFrame:
    """all = stayers * mix: growth of the mean of site means, of the sites in both years, and
    what the change of the set of sites adds."""
    g = sy.where(F.col("year").isin(base, target)).groupBy("site_id").agg(F.max(F.when(F.col("year") == base, F.col(value))).alias("a"), F.max(F.when(F.col("year") == target, F.col(value))).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    x = g.agg(F.avg("a").alias("a_all"), F.avg("b").alias("b_all"), F.avg(F.when(both, F.col("a"))).alias("a_stay"), F.avg(F.when(both, F.col("b"))).alias("b_stay"), F.count("a").alias("n_base"), F.count("b").alias("n_target"), F.count_if(both).alias("n_stayers"), F.count_if(F.col("b").isNull()).alias("n_leavers"), F.count_if(F.col("a").isNull()).alias("n_entrants"))
    c = F.col
    return x.select((c("b_all") / c("a_all")).alias("all"), (c("b_stay") / c("a_stay")).alias("stayers"), ((c("b_all") / c("b_stay")) / (c("a_all") / c("a_stay"))).alias("mix"), "n_base", "n_target", "n_stayers", "n_leavers", "n_entrants")


def loo_median_ratio(sy: DataFrame, base: int, target: int, value: str = "corrected") -> DataFrame:
    """left_out, ratio of the medians over the other sites. Two order statistics around each
    year's median say what leaving one value out does, so no pairs of sites are formed."""
    y = sy.where(F.col("year").isin(base, target)).select("site_id", "year", F.col(value).alias("v"))
    w = Window.partitionBy("year").orderBy("v", "site_id")
    y = y.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("year")))
    per = y.groupBy("year").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.abs(F.col("i") - (F.col("n") + 1) / 2) <= 1.5, F.struct("i", "v")))).alias("mid"), F.median("v").alias("m"))
    at = lambda k: F.aggregate("mid", F.lit(None).cast("double"), lambda acc, x: F.when(x["i"] == k, x["v"]).otherwise(acc))
    half = F.floor(F.col("n") / 2)
    odd = F.col("n") % 2 == 1
    low, mid, high = at(half), at(half + 1), at(half + 2)
    # odd n, the k-th in the middle: leaving out one below, the middle, one above
    per = per.select("year", "n", "m", half.alias("half"), F.when(odd, (mid + high) / 2).otherwise(mid).alias("if_low"), F.when(odd, (low + high) / 2).alias("if_mid"), F.when(odd, (low + mid) / 2).otherwise(low).alias("if_high"))
    sites = y.groupBy("site_id").agg(F.max(F.when(F.col("year") == base, F.col("i"))).alias("ia"), F.max(F.when(F.col("year") == target, F.col("i"))).alias("ib"))

    def one(y0: int, i: str) -> tuple[DataFrame, Column]:
        p = per.where(F.col("year") == y0).select(*[F.col(c).alias(f"{c}_{i}") for c in ("n", "m", "half", "if_low", "if_mid", "if_high")])
        k, h, n = F.col(i), F.col(f"half_{i}"), F.col(f"n_{i}")
        lowside = F.when(n % 2 == 1, k <= h).otherwise(k <= h)
        mid_ = (n % 2 == 1) & (k == h + 1)
        return p, F.when(k.isNull(), F.col(f"m_{i}")).when(mid_, F.col(f"if_mid_{i}")).when(lowside, F.col(f"if_low_{i}")).otherwise(F.col(f"if_high_{i}"))

    pa, a = one(base, "ia")
    pb, b = one(target, "ib")
    x = sites.withColumn("__j", F.lit(1)).join(F.broadcast(pa.withColumn("__j", F.lit(1))), "__j").join(F.broadcast(pb.withColumn("__j", F.lit(1))), "__j")  # one row each
    return x.select(F.col("site_id").alias("left_out"), (b / a).alias("ratio"))


def quarterly_relative(d: DataFrame, site: str) -> DataFrame:
    """quarter, the site's mean over the median of all sites' means in that quarter."""
    q = F.concat(F.year("day").cast("string"), F.lit("Q"), F.quarter("day").cast("string"))
    m = d.groupBy("site_id", q.alias("quarter")).agg(F.avg("total").alias("m"))
    g = m.groupBy("quarter").agg(F.max(F.when(F.col("site_id") == site, F.col("m"))).alias("site_mean"), F.median("m").alias("median_mean"))
    return g.where("site_mean IS NOT NULL").select("quarter", (F.col("site_mean") / F.col("median_mean")).alias("relative"))


def weekend_share(d: DataFrame) -> DataFrame:
    """Mean of weekend and holiday days over the mean of all days (a ratio of means), per year."""
    return d.groupBy("year").agg((F.avg(F.when(F.col("weekend"), F.col("total"))) / F.avg("total")).alias("weekend_share"))


def peak_share(h: DataFrame) -> DataFrame:
    return h.groupBy("year").agg((F.sum(F.when(F.col("peak"), F.col("raw_total"))) / F.sum("raw_total")).alias("peak_share"))


def chain(d: DataFrame, min_days: int) -> DataFrame:
    """Chain-linked index without adjustment: per pair of consecutive years the ratio of the summed
    means of the sites eligible in both, and its cumulative product."""
    sy = site_years(d, min_days).select("site_id", "year", "raw")
    nxt = sy.select("site_id", (F.col("year") - 1).alias("year"), F.col("raw").alias("next"))
    link = sy.join(nxt, ["site_id", "year"]).groupBy(F.col("year").alias("from_year")).agg((F.sum("next") / F.sum("raw")).alias("ratio"), F.count("*").alias("n_sites"))
    w = Window.partitionBy(F.lit(0)).orderBy("from_year").rowsBetween(Window.unboundedPreceding, 0)  # one row a year
    return link.select("from_year", (F.col("from_year") + 1).alias("to_year"), "n_sites", "ratio", F.exp(F.sum(F.log("ratio")).over(w)).alias("cumulative"))


def segments(x: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Segment number per key: a new one where the step in `at` exceeds gap."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return x.withColumn("__n", new).withColumn("segment", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")

"""Steps in level: between years, across device swaps, and what leaving them out changes."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_FLAG, REVERT = 1.25, 1.15


def level_jumps(sy: DataFrame, flag: float = STEP_FLAG, revert: float = REVERT) -> DataFrame:
    """Steps of a site's log level relative to the median site, between its consecutive available
    years; those beyond the flag, with whether the next year is back at the old level."""
    med = sy.groupBy("year").agg(F.median(F.log("raw")).alias("m"))
    rel = sy.join(med, "year").select("site_id", "year", (F.log("raw") - F.col("m")).alias("rel"))
    w = Window.partitionBy("site_id").orderBy("year")
    x = rel.select("site_id", F.lag("year").over(w).alias("from_year"), F.col("year").alias("to_year"), F.lag("rel").over(w).alias("was"), "rel", F.lead("rel").over(w).alias("next"))
    x = x.withColumn("step", F.col("rel") - F.col("was")).where(F.abs("step") > log(flag))
    back = F.coalesce(F.abs(F.col("next") - F.col("was")) < log(revert), F.lit(False))
    return x.select("site_id", "from_year", "to_year", F.exp("step").alias("rel_step_x"), back.alias("reverts_next_year"))


def device_pairs(devices: DataFrame) -> DataFrame:
    """Each device from a site's second on, with the factor before it."""
    w = Window.partitionBy("site_id").orderBy("valid_from", "standort_id")
    x = devices.withColumn("cf", F.coalesce("correction_factor", F.lit(1.0)))
    x = x.select("site_id", F.to_date("valid_from").alias("swap"), "device_id", F.lag("cf").over(w).alias("cf_before"), F.col("cf").alias("cf_after"), F.row_number().over(w).alias("k"))
    return x.where("k > 1").drop("k")


def changes_at(daily: DataFrame, dates: DataFrame, days: int) -> DataFrame:
    """swap, site_id, na, nb, change: mean log count of the `days` days from each date on minus that
    of the `days` days ahead of it, for every site with rows on both sides.

    Per site a running sum over its days answers any window by two look-ups, so each date adds
    three probes to a site's rows instead of a join with its days. Probes are made only within
    reach of the site's own span.
    """
    one = daily.groupBy("site_id", F.unix_date("day").alias("at")).agg(F.sum(F.log1p("total")).alias("s"), F.count("total").alias("n"))
    span = one.groupBy("site_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    near = span.select("site_id", F.explode(F.sequence(F.col("lo") - days, F.col("hi") + days)).alias("swap"))
    near = near.join(dates.select(F.unix_date("swap").alias("swap")).distinct(), "swap", "left_semi")
    probe = near.select("site_id", "swap", F.posexplode(F.array(F.col("swap") - days, F.col("swap"), F.col("swap") + days)).alias("which", "at"))
    none = F.lit(None)
    rows = one.select("site_id", "at", F.lit(1).alias("p"), none.cast("int").alias("swap"), none.cast("int").alias("which"), "s", "n")
    rows = rows.unionByName(probe.select("site_id", "at", F.lit(0).alias("p"), "swap", "which", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")))
    # a probe sorts ahead of its own day: it sees the days before
    w = Window.partitionBy("site_id").orderBy("at", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.select("site_id", "swap", "which", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n")).where("swap IS NOT NULL")
    at = lambda c, i: F.max(F.when(F.col("which") == i, F.col(c)))
    g = seen.groupBy("site_id", "swap").agg(*[at(c, i).alias(f"{c}{i}") for c in ("s", "n") for i in range(3)])
    g = g.select("site_id", F.date_from_unix_date("swap").alias("swap"), (F.col("n1") - F.col("n0")).alias("na"), (F.col("n2") - F.col("n1")).alias("nb"), (F.col("s1") - F.col("s0")).alias("sa"), (F.col("s2") - F.col("s1")).alias("sb"))
    return g.where("na > 0 AND nb > 0").select("swap", "site_id", "na", "nb", (F.col("sb") / F.col("nb") - F.col("sa") / F.col("na")).alias("change"))


def median_of_others(df: DataFrame, group: str, ident: str, value: str) -> DataFrame:
    """df with `others`: the median of the group's other values, from its middle order statistics."""
    w = Window.partitionBy(group)
    x = df.withColumn("__i", F.row_number().over(w.orderBy(value, ident))).withColumn("__n", F.count("*").over(w)).withColumn("__h", F.floor(F.col("__n") / 2))
    at = lambda k: F.max(F.when(F.col("__i") == F.col("__h") + k, F.col(value))).over(w)
    x = x.select("*", at(0).alias("__a"), at(1).alias("__b"), at(2).alias("__c"))
    i, h, a, b, c = (F.col(f"__{k}") for k in ("i", "h", "a", "b", "c"))
    odd = F.when(i <= h, (b + c) / 2).when(i == h + 1, (a + c) / 2).otherwise((a + b) / 2)
    even = F.when(i <= h, b).otherwise(a)
    return x.withColumn("others", F.when(F.col("__n") % 2 == 1, odd).otherwise(even)).drop("__i", "__n", "__h", "__a", "__b", "__c")


def swap_steps(daily: DataFrame, swaps: DataFrame, days: int = 120, least: int = 30) -> DataFrame:
    """Step of the site's mean log count across each swap, relative to the median change of the
    other sites present on both sides; not testable below `least` days on either side."""
    g = median_of_others(changes_at(daily, swaps, days), "swap", "site_id", "change")
    enough = F.least("na", "nb") >= least
    r = g.select("site_id", "swap", F.when(enough, F.exp(F.col("change") - F.col("others"))).alias("step_x"), enough.alias("testable"))
    return swaps.join(r, ["site_id", "swap"], "left").fillna(False, ["testable"])


def verdict(ratio: Column, base: Column, threshold: float = 1.8) -> Column:
    """Whether a ratio falls on the other side of the threshold than the base, or next to it."""
    crosses = ((ratio >= threshold) != (base >= threshold)) | (F.abs(ratio - threshold) < 0.01)
    return F.when(ratio.isNull(), "city-style figure only").when(crosses, "yes").otherwise("no")


def impacts(cases: DataFrame, base: DataFrame, threshold: float = 1.8) -> DataFrame:
    """cases (anomaly, ratio) against base (one row: base_ratio): change in percent and verdict."""
    x = cases.withColumn("__j", F.lit(1)).join(F.broadcast(base.withColumn("__j", F.lit(1))), "__j")  # base is one row
    return x.select("anomaly", "ratio", (100 * (F.col("ratio") / F.col("base_ratio") - 1)).alias("change_pct"), verdict(F.col("ratio"), F.col("base_ratio"), threshold).alias("changes_verdict"))

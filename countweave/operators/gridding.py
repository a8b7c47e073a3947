"""Irregular readings onto a regular hourly grid, with missing hours marked.

Each grid hour g gets a local linear fit over the readings within `reach` hours of g, weighted
by the compact Epanechnikov kernel 1 - (d / reach)^2. Because the kernel is a polynomial in d,
a reading's part in every fit follows from power sums of its offset within its own hour, so
readings are first condensed to one row of power sums per source, device and hour; the fit at
g then combines the rows of hours g - reach ... g + reach - 1, found by their index in the
sorted grid. Nothing is looked up by scanning readings and no Python runs.

One exchange of slim rows: readings and one row per device and stretch of the grid travel
together, keyed by (source, device, stretch of BLOCK hours), so a hot device spreads over its
stretches. Readings near a stretch's edge are sent to both neighbours.

Distances are elapsed time: across a clock change the hours beside it are one nearer or farther than
their names say. Hours that the zone skips are no part of the grid, and readings stamped in them
have no part in any fit. Times count to the microsecond.

Outputs per grid hour: `usable` readings that fall in it, `here` (their effective number by the
kernel's weights, (sum w)^2 / sum w^2: 0 without any, 1 for one, up to their count), `support` (the
same over all readings in the fit), `estimate` (null without support) and `missing`: `here` is below
`least_here` or `support` below `least`.

The grid of a device runs from the hour of its first row to that of its last, any row with a
time counting. Rows without a time or a device count for nothing. A device without rows has no
grid. Repeated rows count twice in a fit.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countweave.functions.zones import zone_table

BLOCK = 720
NEVER = -(2**31)  # no hour


def hour_index(ts: Column) -> Column:
    """Wall-clock hours since 1970-01-01T00, whatever the session's zone."""
    return (F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)).cast("int")


def hour_text(h: Column) -> Column:
    return F.concat(F.date_from_unix_date(F.floor(h / 24).cast("int")).cast("string"), F.lit("T"), F.lpad(F.pmod(h, F.lit(24)).cast("string"), 2, "0"), F.lit(":00"))


def _block(h: Column) -> Column:
    return F.floor(h / BLOCK).cast("int")


def hourly_grid(readings: DataFrame, reach: int = 2, zone: str = "Europe/Zurich", least_here: float = 1.0, least: float = 0.0) -> DataFrame:
    """readings: src, dev, ts, y, usable. Result: src, dev, hour, usable, here, support, estimate, missing."""
    ts = F.col("ts")
    u = F.minute(ts) / 60 + F.extract(F.lit("SECOND"), ts).cast("double") / 3600
    clock = zone_table(zone)
    r = readings.where(ts.isNotNull() & F.col("dev").isNotNull())
    r = r.select("src", "dev", hour_index(ts).alias("h"), u.cast("double").alias("u"), F.when(F.col("usable"), F.col("y").cast("double")).alias("y"))
    span = r.groupBy("src", "dev").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    span = span.select("src", "dev", "lo", "hi", F.explode(F.sequence(_block(F.col("lo")), _block(F.col("hi")))).alias("blk"))
    none = lambda kind: F.lit(None).cast(kind)
    lo = F.greatest("lo", F.col("blk") * BLOCK)
    hi = F.least("hi", F.col("blk") * BLOCK + BLOCK - 1)
    spine = span.select("src", "dev", "blk", lo.alias("h"), hi.alias("to"), none("double").alias("u"), none("double").alias("y"))
    # hours g that use hour h: h - reach + 1 ... h + reach, one more beside a skipped hour
    edges = F.array_distinct(F.array(_block(F.col("h")), _block(F.col("h") - reach), _block(F.col("h") + reach + 1)))
    inner = F.pmod(F.col("h"), F.lit(BLOCK)).between(reach, BLOCK - 2 - reach)
    near = F.when(inner, F.array(_block(F.col("h")))).otherwise(edges)
    rows = r.select("src", "dev", F.explode(near).alias("blk"), "h", none("int").alias("to"), "u", "y")
    both = rows.unionByName(spine).repartition("src", "dev", "blk")
    hours = F.when(F.col("to").isNotNull(), F.sequence("h", "to")).otherwise(F.array("h"))
    both = both.select("src", "dev", "blk", F.col("to").isNotNull().alias("grid"), "u", "y", F.explode(hours).alias("h"))
    ud = F.when(F.col("y").isNotNull(), F.col("u").cast("double"))
    power = lambda j: F.lit(1.0) if j == 0 else (ud if j == 1 else ud * power(j - 1))
    sums = [F.sum(F.when(F.col("y").isNotNull(), power(j))).alias(f"s{j}") for j in range(5)]
    sums += [F.sum(F.col("y") * power(j)).alias(f"t{j}") for j in range(4)]
    per = both.groupBy("src", "dev", "blk", "h").agg(F.max("grid").alias("grid"), F.count("y").alias("usable"), *sums)
    per = per.where(f"h NOT IN ({', '.join(map(str, [NEVER, *clock.skipped_hours()]))})")
    per = per.withColumn("t", F.col("h") - clock.hours_east(F.col("h")))  # elapsed hours
    # neighbours by position in the sorted grid, taken for what their own hour says
    w = Window.partitionBy("src", "dev", "blk").orderBy("h")
    at = F.when(F.col("usable") > 0, F.struct("t", *[f"s{j}" for j in range(5)], *[f"t{j}" for j in range(4)]))
    per = per.withColumn("x", at)
    steps = [*range(-reach, 0), *range(1, reach)]
    b2 = float(reach * reach)
    sum_of = lambda j: F.coalesce(F.col(f"s{j}"), F.lit(0.0))
    w_here, ww_here = sum_of(0) - sum_of(2) / b2, sum_of(0) - 2 * sum_of(2) / b2 + sum_of(4) / (b2 * b2)
    here = F.when(F.col("usable") > 0, w_here * w_here / ww_here).otherwise(0.0)
    per = per.select("src", "dev", "h", "t", "usable", "grid", here.alias("here"), F.col("x").alias("x0"), *[F.lag("x", -k).over(w).alias(f"x{k}") for k in steps]).where("grid")

    def moment(name: str, j: int) -> Column:
        def term(x: Column) -> Column:
            k = (x["t"] - F.col("t")).cast("double")
            total, power_k = x[f"{name}{j}"], F.lit(1.0)
            for i in range(j - 1, -1, -1):
                power_k = power_k * k
                total = total + F.lit(float(comb(j, i))) * power_k * x[f"{name}{i}"]
            return F.coalesce(F.when(k.between(-reach, reach - 1), total), F.lit(0.0))

        return sum((term(F.col(f"x{k}")) for k in [0, *steps][1:]), term(F.col("x0")))

    d = [F.col(f"d{j}") for j in range(5)]
    e = [F.col(f"e{j}") for j in range(4)]
    per = per.select("src", "dev", "h", "usable", "here", *[moment("s", j).alias(f"d{j}") for j in range(5)], *[moment("t", j).alias(f"e{j}") for j in range(4)])
    w0, w1, w2 = d[0] - d[2] / b2, d[1] - d[3] / b2, d[2] - d[4] / b2
    y0, y1 = e[0] - e[2] / b2, e[1] - e[3] / b2
    ww = d[0] - 2 * d[2] / b2 + d[4] / (b2 * b2)
    per = per.select("src", "dev", F.col("h").alias("hour"), "usable", "here", w0.alias("w0"), w1.alias("w1"), w2.alias("w2"), y0.alias("y0"), y1.alias("y1"), ww.alias("ww"))
    det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    linear = (F.col("w2") * F.col("y0") - F.col("w1") * F.col("y1")) / det
    some = F.col("w0") > 1e-9
    estimate = F.when(some & (det > 1e-6 * F.col("w0") * F.col("w0")), linear).when(some, F.col("y0") / F.col("w0"))
    support = F.when(some, F.col("w0") * F.col("w0") / F.col("ww")).otherwise(F.lit(0.0))
    short = F.col("here") < least_here - 1e-9
    missing = short if least <= 0 else short | (support < least)
    return per.select("src", "dev", "hour", "usable", "here", support.alias("support"), estimate.alias("estimate"), missing.alias("missing"))

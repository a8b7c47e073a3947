"""Calendar, daylight-saving and solar expressions on naive wall-clock times."""

from __future__ import annotations

from datetime import date, timedelta
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PEAK_HOURS = (7, 8, 16, 17, 18)  # on workdays
LAT, LON = 47.37, 8.54


def naive_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def dow(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def autumn_repeat(ts: Column) -> Column:
    """The hour from 02:00 on the last Sunday of October, which occurs twice."""
    return (F.month(ts) == 10) & (dow(ts) == 6) & (F.dayofmonth(ts) >= 25) & (F.hour(ts) == 2)


def spring_skip(ts: Column) -> Column:
    """The hour from 02:00 on the last Sunday of March, which does not exist."""
    return (F.month(ts) == 3) & (dow(ts) == 6) & (F.dayofmonth(ts) >= 25) & (F.hour(ts) == 2)


def to_utc(ts: Column, zone: str = "Europe/Zurich") -> Column:
    """Wall clock -> naive UTC: the first pass of a repeated hour, skipped times shift forward."""
    return F.to_utc_timestamp(ts, zone).cast("timestamp_ntz")


def iso_week_text(day: Column) -> Column:
    """ISO year and week as YYYY-WW."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def day_of_year_waves(ts: Column) -> tuple[Column, Column]:
    x = 2 * pi * F.dayofyear(ts) / 365.25
    return F.sin(x), F.cos(x)


def solar_elevation(ts_utc: Column, lat: float = LAT, lon: float = LON) -> Column:
    """Degrees above the horizon half an hour after ts_utc, the middle of the hour that starts then:
    Cooper's declination, hour angle from UTC and longitude."""
    t = ts_utc + F.expr("INTERVAL 30 MINUTES")
    decl = F.radians(F.lit(23.44)) * F.sin(2 * pi * (F.dayofyear(t) + 284) / 365)
    angle = F.radians((F.hour(t) + F.minute(t) / 60 - 12) * 15 + lon)
    la = F.radians(F.lit(lat))
    return F.degrees(F.asin(F.sin(la) * F.sin(decl) + F.cos(la) * F.cos(decl) * F.cos(angle)))


def in_any(ts: Column, ranges: list[tuple[str, str]]) -> Column:
    """ts lies in one of the half-open ranges of dates."""
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | ((ts >= F.lit(a).cast("timestamp_ntz")) & (ts < F.lit(b).cast("timestamp_ntz")))
    return hit


def hour_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """ts_local: every hour from start to end, excluded."""
    return spark.sql(f"SELECT explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts_local")


def easter(year: int) -> date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return date(year, m // 31, m % 31 + 1)


def public_holidays(year: int) -> list[date]:
    """Days off in Zurich by their rules."""
    e = easter(year)
    return [date(year, m, x) for m, x in ((1, 1), (1, 2), (5, 1), (8, 1), (12, 25), (12, 26))] + [e + timedelta(days=k) for k in (-2, 1, 39, 50)]


def holiday_table(spark: SparkSession, first: int = 1990, last: int = 2060) -> DataFrame:
    """day: the days off of some years, ten a year."""
    return spark.createDataFrame([(x,) for y in range(first, last + 1) for x in public_holidays(y)], "day date")


def evaluation_classes(rows: DataFrame, ts: str, holidays: DataFrame, opened: str) -> DataFrame:
    """rows with the classes that errors are told by: season, daytype (workday or weekend/holiday), peak
    (the peak hours of workdays) and stage, before or after the day something opened."""
    t = F.col(ts)
    m = F.month(t)
    h = F.broadcast(holidays.select(F.col("day").alias("__day"), F.lit(True).alias("__off")))  # ten days a year
    x = rows.join(h, F.to_date(t) == F.col("__day"), "left")
    workday = (dow(t) < 5) & F.col("__off").isNull()
    return x.withColumns({
        "season": F.when(m.isin(12, 1, 2), "winter").when(m.isin(6, 7, 8), "summer").otherwise("spring/autumn"),
        "daytype": F.when(workday, "workday").otherwise("weekend/holiday"),
        "peak": F.when(workday & F.hour(t).isin(*PEAK_HOURS), "peak").otherwise("off-peak"),
        "stage": F.when(t >= F.lit(opened).cast("timestamp_ntz"), "after").otherwise("before"),
    }).drop("__day", "__off")


def calendar(hours: DataFrame, public_holidays: DataFrame, school: DataFrame) -> DataFrame:
    """One row per hour with calendar features.

    public_holidays: day. school: start_day, end_day, summary; its interval is half-open, one day
    if it does not end after its start, holidays if the text says `ferien`, else free days if it
    says `schulfrei`, else nothing. Intervals unfold to days, so the join is an equi-join on days.
    """
    last = F.when(F.col("end_day") > F.col("start_day"), F.date_sub("end_day", 1)).otherwise(F.col("start_day"))
    text = F.lower("summary")
    days = school.select(F.explode(F.sequence("start_day", last)).alias("day"), text.contains("ferien").alias("hol"), (~text.contains("ferien") & text.contains("schulfrei")).alias("free"))
    flags = days.groupBy("day").agg(F.bool_or("hol").alias("school_holiday"), F.bool_or("free").alias("school_free_day"))
    ph = public_holidays.select("day").distinct().withColumn("public_holiday", F.lit(True))
    ts = F.col("ts_local")
    c = hours.withColumn("day", F.to_date(ts)).join(ph, "day", "left").join(flags, "day", "left").fillna(False, ["public_holiday", "school_holiday", "school_free_day"])
    waves = day_of_year_waves(ts)
    c = c.select("ts_local", F.hour(ts).alias("hour"), dow(ts).alias("dow"), F.month(ts).alias("month"), F.year(ts).alias("year"), "public_holiday", "school_holiday", "school_free_day", (dow(ts) >= 5).alias("is_weekend"), waves[0].alias("doy_sin"), waves[1].alias("doy_cos"))
    c = c.withColumn("workday", ~F.col("is_weekend") & ~F.col("public_holiday"))
    return c.withColumn("peak", F.col("workday") & F.col("hour").isin(*PEAK_HOURS)).withColumn("sun_elev", solar_elevation(to_utc(ts)))

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from countweave.functions.zones import zone_table
from countweave.operators import timestamps as ts

CASES = {
    "2021-07-01T10:15": "2021-07-01T08:15:00Z", "2021-01-01T10:15": "2021-01-01T09:15:00Z", " 2021-01-01T10:15 ": "2021-01-01T09:15:00Z",
    "2015-10-24T10:45:00+01": "2015-10-24T09:45:00Z", "22.02.2022 12:15 MEZ": "2022-02-22T11:15:00Z", "28.10.2023 03:45 MESZ": "2023-10-28T01:45:00Z",
    "1332640837": "2012-03-25T02:00:37Z", "1477728920266": "2016-10-29T08:15:20Z", "2012-03-27 09:45:00.731": "2012-03-27T07:45:00Z",
    "Tue, 16 Nov 2021 07:45:00 +0100": "2021-11-16T06:45:00Z", "28.10.2012 23:45": "2012-10-28T22:45:00Z", "20130330T074500Z": "2013-03-30T07:45:00Z",
    "13. November 2021, 04.00 Uhr": "2021-11-13T03:00:00Z", "2. März 2020, 20.30 Uhr": "2020-03-02T19:30:00Z", "2016-11-01T07:30:00.778417-08:00": "2016-11-01T15:30:00Z", "2021-10-16T22:15:00.563417+09:30": "2021-10-16T12:45:00Z",
    "2021-10-31T02:30": "2021-10-31T00:30:00Z", "2021-03-28T02:30": "2021-03-28T01:00:00Z", "2020-02-29T00:00Z": "2020-02-29T00:00:00Z",
    "2021-13-04T12:30": "invalid", "2021-02-30T11:15": "invalid", "2021-05-07T07:75": "invalid", "0000-00-00T00:00": "invalid", "31.06.2020 03:00": "invalid", "2022-09-xxT13:00": "invalid", "gestern 20:15": "invalid", "----": "invalid", "n/a": "invalid", "": "invalid", "x" * 5000: "invalid", "12345": "invalid", "2021-01-01Q10:15": "invalid", "1. Foo 2020, 10.00 Uhr": "invalid",
    "2021-07-01T10:15:00." + "7" * 300: "2021-07-01T08:15:00Z", "2021-07-01" + " " * 5000 + "10:15": "2021-07-01T08:15:00Z", "2021-07-01T10:15:00." + "7" * 70 + "x": "invalid",
    "2107-07-01T10:15": "2107-07-01T08:15:00Z", "2107-01-01T10:15": "2107-01-01T09:15:00Z", "9999-07-01T10:15": "9999-07-01T08:15:00Z", "9999-12-31T10:15": "9999-12-31T09:15:00Z",
}


def test_notations(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(999, None)]
    df = spark.createDataFrame(rows, "row_id int, d string").withColumn("utc_us", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = {r["row_id"]: (r["utc"], r["canonical"]) for r in ts.normalise_texts(df, "d").select("row_id", ts.utc_text("utc_us").alias("utc"), "canonical").collect()}
    for i, (t, want) in enumerate(CASES.items()):
        assert got[i][0] == want, t
    assert got[999] == ("invalid", False)
    assert got[0][1] and not got[2][1] and got[list(CASES).index("2021-03-28T02:30")][1]


def test_pairs_and_empty(spark):
    df = spark.createDataFrame([(1, datetime(2021, 7, 1, 10), datetime(2021, 7, 1, 8, tzinfo=UTC)), (2, datetime(2021, 7, 1, 10), None), (3, None, None)], "row_id int, l timestamp_ntz, u timestamp")
    got = {r["row_id"]: (r["utc"], r["agrees"]) for r in ts.normalise_pairs(df, "l", "u").select("row_id", ts.utc_text("utc_us").alias("utc"), "agrees").collect()}
    assert got == {1: ("2021-07-01T08:00:00Z", True), 2: ("2021-07-01T08:00:00Z", False), 3: ("invalid", False)}
    assert ts.normalise_texts(spark.createDataFrame([], "d string"), "d").count() == 0


@pytest.mark.parametrize("zone", ["Europe/Zurich", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata"])
def test_zone_tables(zone):
    t, z = zone_table(zone), ZoneInfo(zone)
    rng = np.random.default_rng(0)
    for s in rng.integers(-(10**9), 4 * 10**9, 400):
        utc = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=int(s))
        off = z.utcoffset(utc.astimezone(z)) // timedelta(microseconds=1)
        wall = t.to_wall(np.array([int(s) * 10**6]))[0]
        assert wall == int(s) * 10**6 + off
        back = t.to_utc(np.array([wall]))[0]
        assert back == int(s) * 10**6 or utc.astimezone(z).fold == 1


def test_rules_repeat_beyond_the_table():
    t, z = zone_table("Europe/Zurich"), ZoneInfo("Europe/Zurich")
    for year in (2499, 2500, 2501, 3333, 9998):
        for month in (1, 3, 7, 10, 12):
            wall = datetime(year, month, 15, 12)
            us = (wall - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            want = us - z.utcoffset(wall) // timedelta(microseconds=1)
            assert t.to_utc(np.array([us]))[0] == want


def test_offsets_by_look_up(spark):
    from pyspark.sql import functions as F

    t = zone_table("Europe/Zurich")
    hours = [int(h) for h in np.random.default_rng(1).integers(-50_000, 1_400_000, 500)] + [448_874 + k for k in range(-3, 4)]
    got = {r["h"]: r["e"] for r in spark.createDataFrame([(h,) for h in hours], "h int").select("h", t.hours_east(F.col("h")).alias("e")).collect()}
    for h, e in got.items():
        us = h * 3_600_000_000
        east = us - t._to_utc(np.array([us]))[0]
        skipped = h in set(t.skipped_hours())
        assert skipped or e * 3_600_000_000 == (east if h >= 0 else t.offset[np.searchsorted(t.at[:-1], 0, "right")])

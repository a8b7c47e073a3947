"""Year effects beside weather and calendar, against fits with all indicators by brute force."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countweave.functions import calendar as cal
from countweave.operators import bootstrap, glm

NUMBERS = ("temp", "temp2", "log_precip", "sun", "holiday")


def days_of(seed=0, sites=3):
    """2021 holds mostly workdays in the cold, 2022 mostly warm weekends; the true ratio is 1.4."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sites):
        for y in (2021, 2022):
            for k in range(0, 365, 2):
                day = date(y, 1, 1) + timedelta(days=k)
                if (day.weekday() >= 5) != (y == 2022) and rng.random() < 0.7:
                    continue
                temp = 10 - 10 * np.cos(k / 58) + (4 if y == 2022 else 0) + rng.normal()
                mean = 200 * (s + 1) * (1.4 if y == 2022 else 1) * np.exp(0.03 * temp - (0.8 if day.weekday() >= 5 else 0))
                rows.append((f"s{s}", s, day, float(rng.poisson(mean)), f"s{s}#{1 + (k > 200 and s == 0)}", y, temp, float(rng.exponential(2)), float(rng.uniform(0, 500)), float(rng.random() < 0.03)))
    return pd.DataFrame(rows, columns=["site_id", "standort_id", "day", "total", "coverage_id", "year", "temp", "precip", "sun", "holiday"])


def full(p, w=None, entity="coverage_id"):
    """Design with every indicator, fit and HC1 covariance."""
    t = pd.to_datetime(p["day"])
    z = lambda v: (v - v.mean()) / v.std()
    x = np.column_stack([np.ones(len(p)), p["year"] == 2022, glm.dummies(p[entity].to_numpy())[0], z(p["temp"]), z(p["temp"] ** 2), z(np.log1p(p["precip"])), z(p["sun"]), p["holiday"], glm.dummies(t.dt.weekday.to_numpy())[0], glm.dummies(t.dt.month.to_numpy())[0]]).astype(float)
    y = p["total"].to_numpy()
    b = glm.poisson_irls(x, y, w)
    mu = np.exp(x @ b)
    bread = np.linalg.inv(x.T @ (x * mu[:, None]))
    cov = bread @ (x.T @ (x * ((y - mu) ** 2)[:, None])) @ bread * len(y) / (len(y) - x.shape[1])
    return b[1], np.sqrt(cov[1, 1])


@pytest.fixture(scope="module")
def both(spark):
    p = days_of()
    d = spark.createDataFrame(p)
    day = d.select("day", "site_id", "temp", "precip", "sun", "holiday")
    d = glm.with_days(d.select("site_id", "standort_id", "day", "total", "coverage_id", "year", "temp", "holiday", F.log1p("precip").alias("log_precip"), "sun", (F.col("temp") ** 2).alias("temp2")))
    assert day.count() == d.count()
    return p, d


def test_adjusted_ratio_is_that_of_the_full_fit(both):
    p, d = both
    e, _ = full(p)
    got = glm.panel_ratio(d, 2021, 2022, numbers=NUMBERS, factors=glm.FACTORS).collect()[0][0]
    assert got == pytest.approx(np.exp(e), rel=1e-6) and got == pytest.approx(1.4, rel=0.02)
    assert glm.panel_ratio(d, 2021, 2022).collect()[0][0] < 1.2  # unadjusted
    c = glm.chain(d, 30, NUMBERS, glm.FACTORS).collect()[0]
    assert c["ratio"] == pytest.approx(np.exp(e), rel=1e-6) and c["n_sites"] == 3
    loo = {r[0]: r[1] for r in glm.leave_one_out(d, 2021, 2022, "coverage_id", NUMBERS, glm.FACTORS).collect()}
    assert loo["s1"] == pytest.approx(np.exp(full(p[p["site_id"] != "s1"].reset_index(drop=True))[0]), rel=1e-6)
    one = {(r[0], r[1]): r[2] for r in glm.per_site(d, 30, NUMBERS, glm.FACTORS).collect()}
    assert one[("s0", 2022)] == pytest.approx(np.exp(full(p[p["site_id"] == "s0"].reset_index(drop=True))[0]), rel=1e-6)
    spark_fit = {r[0]: r[1] for r in glm.ratios_to(glm.year_effects(d, "total", "coverage_id", NUMBERS, glm.FACTORS), 2021).collect()}
    assert spark_fit[2022] == pytest.approx(np.exp(e), rel=1e-5)


def test_robust_interval_is_that_of_the_full_fit(both):
    p, d = both
    e, sd = full(p)
    r = {x["year"]: x for x in glm.robust_index(d, 2021, NUMBERS, glm.FACTORS).collect()}[2022]
    assert (r["adjusted_index"], r["ci_lo"], r["ci_hi"]) == pytest.approx(tuple(100 * np.exp(e + k * sd) for k in (0, -1.96, 1.96)), rel=1e-5)


def test_draws_are_fits_of_repeated_rows(both):
    p, d = both
    got = {r[0]: r[1] for r in bootstrap.fixed_panel_draws(d, 2021, 2022, 3, 7, NUMBERS, glm.FACTORS).collect()}
    linked = {r[0]: r[1] for r in bootstrap.chain_draws(d, 10, 3, 7, NUMBERS, glm.FACTORS).collect()}
    h = {r[0]: r[1] for r in d.select("site_id", F.xxhash64("site_id")).distinct().collect()}
    sites = np.array(sorted(h, key=h.get))
    iso = pd.to_datetime(p["day"]).dt.isocalendar()
    week = (iso["year"] * 100 + iso["week"]).to_numpy()
    for i in range(3):
        ks, kw = bootstrap.multiplicities(sites, np.unique(week), np.random.default_rng([7, i]))
        times = kw[np.searchsorted(np.unique(week), week)]
        copies = [p[p["site_id"] == s].assign(coverage_id=lambda q, k=k: q["coverage_id"] + f"~{k}", w=times[(p["site_id"] == s).to_numpy()]) for s, n in zip(sites, ks) for k in range(n)]
        b = pd.concat(copies, ignore_index=True)
        b = b.loc[b.index.repeat(b["w"])].reset_index(drop=True)
        want = np.exp(full(b)[0])
        assert got[i] == pytest.approx(want, rel=1e-6) and linked[i] == pytest.approx(want, rel=1e-6)


def test_years_that_follow_from_the_month_have_no_ratio(spark):
    rows = [("a", 1, date(2021 + m // 7, m, k), float(50 + k), "a#1", 2021 + m // 7) for m in (3, 9) for k in range(1, 28)]
    d = glm.with_days(spark.createDataFrame(rows, "site_id string, standort_id int, day date, total double, coverage_id string, year int"))
    assert glm.panel_ratio(d, 2021, 2022, factors=glm.FACTORS).collect()[0][0] is None  # not a number


def test_holidays_by_rule():
    assert cal.easter(2023) == date(2023, 4, 9) and cal.easter(2024) == date(2024, 3, 31)
    assert {date(2023, 4, 7), date(2023, 4, 10), date(2023, 5, 18), date(2023, 5, 29), date(2023, 8, 1)} <= set(cal.public_holidays(2023))


def test_bootstraps_and_robust_index_use_all_years(spark, tmp_path):
    """Years outside 2018 to 2022 count: 2011 to 2012 doubles, then 2021 to 2022 stays."""
    from countweave.plans import recon

    rng = np.random.default_rng(0)
    rows = []
    for s in range(3):
        for y, level in ((2011, 100), (2012, 200), (2021, 150), (2022, 150)):
            for k in range(360):
                day = date(y, 1, 1) + timedelta(days=k)
                n = int(rng.poisson(level))
                rows.append((f"s{s}", s, day, n, 1.0, f"s{s}#1", float(n), day.month, y, ""))
    x = spark.createDataFrame(rows, "site_id string, standort_id int, day date, total int, cf double, coverage_id string, corrected double, month int, year int, week string")
    x.withColumn("day", F.col("day").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/daily_panel.parquet")
    assert {r["year"] for r in recon.robust_year_index(spark, str(tmp_path)).collect()} == {2011, 2012, 2021, 2022}
    b = recon.chain_bootstrap(spark, str(tmp_path)).collect()[0]
    assert b["n"] + b["failed"] == 500 and b["median"] == pytest.approx(2.0, rel=0.03)
    c = recon.cluster_bootstrap(spark, str(tmp_path)).collect()[0]
    assert c["n"] + c["failed"] == 1000 and c["median"] == pytest.approx(1.0, rel=0.03)


def test_links_of_a_chain_travel_by_their_years(spark):
    """A link's task holds its two years alone; a draw fails that takes no site of some link."""
    rows = [(s, i, date(y, 1, 1) + timedelta(days=k), float(50 + k % 9 + 30 * (y == 2022)), f"{s}#1", y) for i, (s, years) in enumerate((("a", (2021, 2022)), ("b", (2022, 2023)))) for y in years for k in range(0, 360, 3)]
    d = glm.with_days(spark.createDataFrame(rows, "site_id string, standort_id int, day date, total double, coverage_id string, year int"))
    draws = bootstrap.chain_draws(d, 10, 12, 7, (), ("dow",))
    step = [x for x in draws._jdf.queryExecution().optimizedPlan().toString().split("\n") if "InPandas" in x]
    assert len(step) == 1 and "FlatMapCoGroupsInPandas" in step[0] and "from_year#" in step[0]
    got = {r[0]: r[1] for r in draws.collect()}
    h = {r[0]: r[1] for r in d.select("site_id", F.xxhash64("site_id")).distinct().collect()}
    weeks = np.unique([x[2].isocalendar()[0] * 100 + x[2].isocalendar()[1] for x in rows])
    taken = [bootstrap.multiplicities(np.array(sorted(h.values())), weeks, np.random.default_rng([7, i]))[0] for i in range(12)]
    assert {i for i in got if got[i] is None or np.isnan(got[i])} == {i for i, k in enumerate(taken) if not k.all()} and 0 < sum(k.all() for k in taken) < 12

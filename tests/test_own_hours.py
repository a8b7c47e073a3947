"""Sums over neighbours of the site-hours that have a count, against brute force; plans that stay narrow."""

import math
import os
import random
import re
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from countweave.operators import reconstruct

DATA = os.environ.get("COUNTWEAVE_TESTDATA", "/root/testdata/sf0.001")
START = datetime(2022, 3, 1)


@pytest.fixture(scope="module")
def world():
    r = random.Random(4)
    at = {f"s{i}": (r.uniform(0, 3000), r.uniform(0, 3000)) for i in range(12)}
    at["twin"] = at["s0"]
    seen = {(s, START + timedelta(hours=h)): float(r.randrange(40)) for s in at for h in range(400) if r.random() < 0.3}
    return at, seen


@pytest.mark.parametrize("cells", [5, 2_000_000])
def test_own_hour_sums(spark, world, monkeypatch, cells):
    monkeypatch.setattr(reconstruct, "CELLS", cells)
    at, seen = world
    c = spark.createDataFrame([(s, t, y) for (s, t), y in seen.items()], "site string, ts timestamp_ntz, y double")
    places = c.select("site", reconstruct.hour_block("ts").alias("block")).distinct().join(spark.createDataFrame([(s, x, y) for s, (x, y) in at.items()], "site string, x double, y double"), "site")
    means = {s: 0.1 * i for i, s in enumerate(at)}
    mean = spark.createDataFrame(list(means.items()), "site string, mean_log double")
    wanted = c.where("y > 20").select("site", "ts")
    plain = {(r["site"], r["ts"]): r for r in reconstruct.own_hour_sums(c, places, 1500.0, 4.0, (120.0, 300.0)).collect()}
    logs = {(r["site"], r["ts"]): r for r in reconstruct.own_hour_sums(c, places, 1500.0, 4.0, (300.0,), mean, wanted).collect()}
    want = {}
    for s, t in seen:
        near = [(round(math.dist(at[s], at[o]) / 4.0, 6), o) for o in at if o != s and (o, t) in seen and math.dist(at[s], at[o]) <= 1500]
        if near:
            want[s, t] = sorted(near)
    assert plain.keys() == want.keys() and logs.keys() == {k for k in want if seen[k] > 20} and len(want) > 500
    for (s, t), near in want.items():
        r = plain[s, t]
        w = {tau: [math.exp(-cost / tau) for cost, _ in near] for tau in (120.0, 300.0)}
        y = [seen[o, t] for _, o in near]
        assert (r["y"], r["available"], r["total"]) == (seen[s, t], len(near), sum(y))
        for tau in w:
            assert (r[f"w{int(tau)}"], r[f"s{int(tau)}"]) == pytest.approx((sum(w[tau]), sum(a * b for a, b in zip(w[tau], y))))
        if (s, t) in logs:
            r, l = logs[s, t], [math.log1p(v) for v in y]
            assert (r["s300"], r["anomaly"]) == pytest.approx((sum(a * b for a, b in zip(w[300.0], l)), sum(a * (b - means[o]) for a, b, (_, o) in zip(w[300.0], l, near))))
            assert (r["near"], r["near_cost"]) == pytest.approx((l[0], near[0][0]))


def joins(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.split("\n") if "Join " in x]


# nothing is joined by hours, and no pairs of sites are listed (a join of grid cells)
NARROW = ["tau_grid", "metrics_daily", "metrics_pooled", "paired_bootstrap", "metrics_by_group", "week_block_bootstrap", "decision_by_interval", "metrics_wide", "paired_draws", "decision_rule", "interval_coverage", "metrics_per_site", "worst_sites"]


@pytest.mark.parametrize("name", NARROW)
def test_no_join_of_hours_or_pairs(spark, name):
    assert not [x for x in joins(spark, name) if re.search(r"\(ts#\d+ = ts#", x) or "cx#" in x or "src#" in x or "dst#" in x]


def test_common_rows_are_those_that_all_models_have(spark):
    from countweave.operators import metrics

    wide = spark.createDataFrame([("a", START, 1.0, 2.0, 3.0), ("b", START, 1.0, None, 3.0), ("c", START, 1.0, 2.0, None)], "site string, ts timestamp_ntz, y double, m double, n double")
    long = wide.unpivot(["site", "ts", "y"], ["m", "n"], "model", "pred").where("pred IS NOT NULL")
    assert sorted(map(tuple, metrics.common_rows(wide, ["m", "n"]).collect())) == sorted(map(tuple, metrics.common(long, 2).select("site", "ts", "y", "model", "pred").collect()))


@pytest.mark.parametrize("name", ["paired_bootstrap"])
def test_site_hours_are_not_grouped_again(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Aggregate [site#" in x and "ts#" in x and "pred#" in x]


@pytest.mark.parametrize("n", [1, 40, 299, 300, 1000])
def test_subsample_of_many_rows(spark, monkeypatch, n):
    df = spark.range(300)
    plain = reconstruct.subsample(df, ["id"], 3, n).collect()
    monkeypatch.setattr(reconstruct, "MANY", 0)
    assert reconstruct.subsample(df.repartition(5), ["id"], 3, n).collect() == plain and len(plain) == min(n, 300)


def test_design_is_narrow_and_cut_once(spark, monkeypatch):
    from countweave.plans import recon

    cuts = []
    monkeypatch.setattr(recon, "cut", lambda df: cuts.append(df) or df)
    plan = recon._design(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(cuts) == 1 and {"x_km5", "city"} <= set(cuts[0].columns)  # no exchange is left to a fit's passes
    assert not [x for x in plan.split("\n") if "Join " in x and (re.search(r"\(ts#\d+ = ts#", x) or "src#" in x or "dst#" in x or "cx#" in x)]


@pytest.mark.parametrize("name", ["prediction_intervals"])
def test_rows_are_not_exchanged_by_model(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert all("broadcast" in x for x in plan.split("\n") if "Join " in x and "model#" in x)

"""Sums over neighbours of every site and hour, against `neighbour_sums` over a table of pairs; no such table travels."""

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
    r = random.Random(8)
    at = {f"s{i}": (r.uniform(-2500, 3500), r.uniform(0, 3000)) for i in range(30)}
    at |= {"twin": at["s0"], "edge": (0.0, 1500.0), "edge2": (1500.0, 1500.0), "far": (90_000.0, 0.0)}
    seen = {(s, START + timedelta(hours=h)): float(r.randrange(40)) for s in [*at, "nowhere"] if s != "s5" for h in range(400) if r.random() < 0.2}
    return at, seen


@pytest.mark.parametrize("log", [False, True])
@pytest.mark.parametrize("cells", [20, 2_000_000])
def test_every_hour_sums(spark, world, monkeypatch, cells, log):
    monkeypatch.setattr(reconstruct, "CELLS", cells)
    at, seen = world
    c = spark.createDataFrame([(s, t, y) for (s, t), y in seen.items()], "site string, ts timestamp_ntz, y double")
    places = spark.createDataFrame([(s, x, y) for s, (x, y) in at.items()], "site string, x double, y double")
    pairs = [(a, b, round(d / 4.0, 6)) for a in at for b in at if a != b and (d := math.dist(at[a], at[b])) <= 1500]
    mean = spark.createDataFrame([(s, 0.1 * i) for i, s in enumerate(at)], "site string, mean_log double") if log else None
    t = spark.createDataFrame(pairs, "src string, dst string, cost double")
    want = {(r["site"], r["ts"]): r for r in reconstruct.neighbour_sums(c, t, places.select("site"), (120.0, 300.0), mean).collect()}
    got = reconstruct.every_hour_sums(c, places, 1500.0, 4.0, (120.0, 300.0), mean).collect()
    assert len(got) == len(want) > 5000 and ("edge", "edge2") in {p[:2] for p in pairs}
    for r in got:
        assert r[2:] == pytest.approx(want[r["site"], r["ts"]][2:], rel=1e-9, abs=1e-9)


def test_no_counts_or_no_places(spark, world):
    at, seen = world
    c = spark.createDataFrame([(s, t, y) for (s, t), y in seen.items()], "site string, ts timestamp_ntz, y double")
    places = spark.createDataFrame([(s, x, y) for s, (x, y) in at.items()], "site string, x double, y double")
    assert not reconstruct.every_hour_sums(c.limit(0), places, 1500.0, 4.0, (120.0,)).collect()
    assert not reconstruct.every_hour_sums(c, places.limit(0), 1500.0, 4.0, (120.0,)).collect()


def test_neighbour_features_lists_no_pairs(spark):
    plan = entry.queries()["neighbour_features"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Join " in x and re.search("cx#|src#|dst#", x)]

import math

import numpy as np
import pytest

from countweave.operators import quantiles as q


def rank_range(values, v):
    s = np.sort(values)
    return np.searchsorted(s, v, "left") + 1, np.searchsorted(s, v, "right")


def check(values, s, eps):
    for x in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        v, r, lo, hi = q.query(s, x)
        a, b = rank_range(values, v)
        assert lo <= b and hi >= a, "the interval holds a rank of the value"
        dist = max(a - r, r - b, 0)
        assert dist <= max(r - lo, hi - r) <= eps * len(values) + 1


@pytest.mark.parametrize("seed", range(4))
def test_merge_and_prune_keep_their_bounds(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 50, rng.integers(1, 2000)) if k % 2 else rng.lognormal(size=rng.integers(1, 2000)) for k in range(9)]
    width = 100
    s = q.merge_all([q.prune(q.of_values(p), width) for p in parts])
    check(np.concatenate(parts), s, 1 / (2 * width) * 1.2)
    check(np.concatenate(parts), q.prune(s, width), 2.3 / (2 * width))


def test_exact_merge_equals_sorting():
    a, b = q.of_values(np.array([1, 1, 1, 3.0])), q.of_values(np.array([0, 1, 5.0]))
    s = q.merge(a, b)
    assert s[3] == 7 and (np.diff(s[0]) >= 0).all()
    assert q.query(s, 0.5)[0] == 1.0 and q.query(s, 1.0)[0] == 5.0


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 3}" if i % 7 else None, float(v) if i % 11 else None, "extra") for i, v in enumerate(rng.lognormal(size=30_000) * 100)] + [("nan", float("nan"), "x"), ("one", 4.0, "x")]
    df = spark.createDataFrame(rows, "k string, value double, n string").repartition(6)
    out = q.quantiles(df, ["k"], "value", (0.5, 0.9, 0.99), eps=0.01).collect()
    groups = {}
    for k, v, _ in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    assert {r["k"] for r in out} == set(groups)
    for r in out:
        vals = groups[r["k"]]
        a, b = rank_range(vals, r["value"])
        assert r["n"] == len(vals) and r["rank_error"] <= 0.01 * len(vals)
        assert max(a - r["rank"], r["rank"] - b, 0) <= r["rank_error"]


def test_pieces_merge_like_the_whole(spark):
    df = spark.range(5000).selectExpr("id % 4 AS piece", "cast(id as double) AS v", "'a' AS k")
    whole = q.merge_summaries(q.summaries(df, ["k", "piece"], "v", 0.005), ["k"])
    r = q.read_off(whole, ["k"], [0.5]).collect()[0]
    assert r["n"] == 5000 and abs(r["value"] - 2499) <= 0.005 * 5000 + 1


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert q.quantiles(df, ["k"], "v").count() == 0


def test_exact_quantiles(spark):
    """Interpolated quantiles of groups far larger than a summary, with ties, nulls and a null key."""
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in np.round(rng.normal(0, 1, 6000), 2)] + [(None, float(x)) for x in rng.gamma(2, 2, 3000)] + [("c", 7.0), ("d", None), ("e", float("nan"))] + [("f", 1.0), ("f", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    qs = (0.9, 0.05, 0.5, 1.0, 0.0)
    got = {(r["k"], r["q"]): r["value"] for r in q.exact_quantiles(df, ["k"], "x", qs, eps=0.02).collect()}
    for k in ("a", None, "c", "f"):
        v = [x for key, x in rows if key == k]
        for at in qs:
            assert got[k, at] == pytest.approx(np.quantile(v, at)), (k, at)
    assert len(got) == 4 * len(qs)

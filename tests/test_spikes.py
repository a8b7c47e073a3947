import numpy as np
from pyspark.sql import functions as F

from countweave.operators import spikes


def brute(rows, rules):
    """row ids flagged by the plain definition."""
    out = set()
    by = {}
    for s, o, i, raw, bad in rows:
        if raw is not None:
            by.setdefault(s, []).append((o, i, raw, bad))
    for s, rs in by.items():
        rs.sort(key=lambda r: (r[0], r[1]))
        stuck = [False] * len(rs)
        a = 0
        while a < len(rs):
            b = a
            while b < len(rs) and rs[b][2] == rs[a][2]:
                b += 1
            if b - a >= rules.stuck:
                stuck[a:b] = [True] * (b - a)
            a = b
        own = [(r[1], r[2]) for r, k in zip(rs, stuck) if not r[3] and not k]
        out |= {r[1] for r, k in zip(rs, stuck) if r[3] or k}
        for n, (i, v) in enumerate(own):
            rest = np.array([w for m, (_, w) in enumerate(own) if m != n])
            if not len(rest):
                continue
            c = np.median(rest)
            sp = spikes.MAD_SCALE * np.median(np.abs(rest - c))
            if sp > 0 and abs(v - c) > rules.limit * sp or sp == 0 and rules.flat is not None and abs(v - c) > rules.flat:
                out.add(i)
    return out


def run(spark, rows, rules, stretch=None):
    df = spark.createDataFrame(rows, "s string, o long, i long, raw double, bad boolean").withColumn("x", F.when(~F.col("bad"), F.col("raw"))).withColumn("cut", F.lit("clash"))
    got = spikes.flag(df, ["s"], ["o", "i"], "x", F.col("bad"), rules, stretch, F.col("i"))
    return {r["i"] for r in got.where("impossible OR stuck OR far").collect()}


def some_sources():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for s in range(60):
        n = int(rng.integers(1, 22))
        v = np.round(rng.normal(10 * s, 1 + s % 5, n), 3)
        for k in range(n):
            x = v[k]
            if rng.random() < 0.06:
                x += 40 * (1 + s % 5)
            rows.append((f"s{s}" if s else None, k, i, None if rng.random() < 0.05 else float(x), bool(rng.random() < 0.03)))
            i += 1
    rows += [("stuck", k, 10_000 + k, 7.0 if k < 5 else float(k), False) for k in range(12)]
    rows += [("flat", k, 20_000 + k, 5.0 + (150 if k == 3 else 0) + (k % 2) * 0.0, False) for k in (0, 3, 6)]
    return rows


def test_against_brute_force(spark):
    rows, rules = some_sources(), spikes.Rules(flat=100.0)
    assert run(spark, rows, rules) == brute(rows, rules)


def test_hot_sources_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spikes, "PART", 3)  # parts shorter and longer than a run
    rows, rules = some_sources(), spikes.Rules(flat=100.0, hot=4)
    assert run(spark, rows, rules, F.floor(F.col("o") / 5)) == brute(rows, rules)


def test_large_source_is_exact(spark):
    """Beyond the width of a summary, with readings right at the limit and many ties."""
    rng = np.random.default_rng(8)
    v = np.round(np.concatenate([rng.normal(0, 1, 9000), rng.uniform(-9, 9, 3000)]), 2)
    rows = [("hot", k, k, float(x), False) for k, x in enumerate(rng.permutation(v))]
    rules = spikes.Rules(hot=1000)
    df = spark.createDataFrame(rows, "s string, o long, i long, raw double, bad boolean").withColumn("x", F.col("raw"))
    order = np.sort(v)

    def others(sorted_, one):
        k = int(np.searchsorted(sorted_, one))
        return np.delete(sorted_, k)

    want = set()
    for _, _, i, r, _ in rows:
        if abs(r) < 5:  # nowhere near the limit
            continue
        rest = others(order, r)
        c = np.median(rest)
        if abs(r - c) > 5 * spikes.MAD_SCALE * np.median(np.abs(rest - c)):
            want.add(i)
    got = {r["i"] for r in spikes.flag(df, ["s"], ["o", "i"], "x", F.col("bad"), rules, None, F.col("i")).where("far").collect()}
    assert got == want and len(want) > 50


def test_needed_values_hold_all_the_medians():
    from countweave.operators import quantiles

    rng = np.random.default_rng(1)
    for n in (2, 3, 8, 501, 4000):
        v = np.sort(np.round(rng.gamma(2, 3, n), rng.integers(0, 4)))
        s = quantiles.prune(quantiles.of_values(v), 60)
        e = spikes.needed(s)
        inside = np.zeros(n, bool)
        for a, b in ((0, 1), (2, 3), (4, 5)):
            inside |= (v >= e[a]) & (v <= e[b])
        gaps = np.select([v < e[0], v < e[2], v < e[4]], [e[0] - 1, (e[1] + e[2]) / 2, (e[3] + e[4]) / 2], e[5] + 1)
        u, w = np.unique(np.where(inside, v, gaps), return_counts=True)
        assert spikes.profile(u, w) == spikes.profile(v, np.ones(n, int))


def test_cutoff_decides_by_itself(spark):
    """Neither capped by the limit nor equal to it: a light tail is cut earlier, a heavy one later."""
    rng = np.random.default_rng(5)
    light, heavy = rng.uniform(-1, 1, 400), rng.standard_t(1.5, 400)
    rows = [(s, k, 1000 * j + k, float(x), False) for j, (s, v) in enumerate((("light", light), ("heavy", heavy))) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "s string, o long, i long, raw double, bad boolean").withColumn("x", F.col("raw"))
    cut = {r["s"]: r["c"] for r in spikes.flag(df, ["s"], ["o", "i"], "x", F.col("bad"), spikes.Rules(risk=0.001)).groupBy("s").agg(F.max("cut").alias("c")).collect()}
    assert cut["light"] < 2.5 and cut["heavy"] > 5


def test_seasons(spark):
    """A reading that is usual in another season is a tail only when seasons are taken out."""
    rng = np.random.default_rng(6)
    rows = [(s, k, 100 * j + k, float((100 if k % 4 == 3 and s == "seasonal" else 0) + rng.normal()), False) for j, s in enumerate(("seasonal", "short")) for k in range(60 if s == "seasonal" else 20)]
    rows[20] = ("seasonal", 20, 20, 100.0, False)  # the first quarter is never so high
    df = spark.createDataFrame(rows, "s string, o long, i long, raw double, bad boolean").withColumn("x", F.col("raw"))
    plain = {r["i"] for r in spikes.flag(df, ["s"], ["o", "i"], "x", F.col("bad")).where("far").collect()}
    adjusted = spikes.deseasonalised(df, ["s"], F.col("o") % 4, "x")
    assert adjusted.where("s = 'short' AND x <> raw").count() == 0
    got = {r["i"] for r in spikes.flag(adjusted, ["s"], ["o", "i"], "x", F.col("bad")).where("far").collect()}
    assert got == {20} and len(plain) > 10


def test_nulls_ties_and_empty(spark):
    rules = spikes.Rules()
    assert run(spark, [], rules) == set()
    assert run(spark, [("a", None, 1, None, False), ("a", 1, 2, 3.0, False)], rules) == set()
    same = [("a", 1, k, 2.0, False) for k in range(3)]
    assert run(spark, same, rules) == set()
    assert run(spark, same + [("a", 1, 9, 2.0, False)], rules) == {0, 1, 2, 9}


def test_pareto_tail_of_an_exponential():
    e = np.sort(np.random.default_rng(0).exponential(2.0, 5000))
    shape, scale = spikes.pareto_fit(e)
    assert abs(shape[0]) < 0.05 and abs(scale[0] - 2) < 0.15
    # weighted tuples give the fit of the rows they stand for
    v, w = np.unique(np.round(e, 1), return_counts=True)
    a, b = spikes.pareto_fit(v, w), spikes.pareto_fit(np.repeat(v, w))
    assert abs(a[0] - b[0])[0] < 1e-9 and abs(a[1] - b[1])[0] < 1e-9

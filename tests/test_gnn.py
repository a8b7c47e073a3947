"""The graph network: gradients by differences, and counts that only neighbours tell."""

from datetime import datetime, timedelta

import numpy as np

from countweave.operators import gnn


def test_gradients():
    rng = np.random.default_rng(0)
    src, dst, decay = np.array([0, 1, 2, 2]), np.array([1, 2, 0, 1]), rng.uniform(0.2, 1, 4)
    x = rng.normal(size=(2, 6, 3, 9)).astype(np.float64)
    p = {k: w.astype(np.float64) for k, w in gnn.start(9, 4, 2, 1).items()}

    def value(p):
        return float((gnn.forward({k: gnn.Node(w) for k, w in p.items()}, x, src, dst, decay).x ** 2).sum())

    nodes = {k: gnn.Node(w) for k, w in p.items()}
    out = gnn.forward(nodes, x, src, dst, decay)
    gnn.backward(gnn.Node(np.array((out.x**2).sum()), [(out, lambda g: 2 * out.x * g)]))
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        hi, lo = ({**p, k: p[k].copy()} for _ in range(2))
        hi[k][i] += 1e-5
        lo[k][i] -= 1e-5
        want = (value(hi) - value(lo)) / 2e-5
        assert abs(nodes[k].g[i] - want) < 1e-4 * (1 + abs(want)), k


def test_memory_is_that_of_one_window(monkeypatch):
    """However many windows a batch has, one is worked on at a time; without gradients nothing is kept."""
    rng, seen, forward = np.random.default_rng(0), [], gnn.forward
    monkeypatch.setattr(gnn, "forward", lambda p, x, *a: seen.append(len(x)) or forward(p, x, *a))
    y, calendar, place = rng.poisson(20, (6, 48, 3)).astype(float), rng.normal(size=(6, 48, 5)), rng.normal(size=(3, 2))
    src, dst, decay = np.array([0, 1, 2]), np.array([1, 2, 0]), np.ones(3)
    gnn.train(y, calendar, place, np.ones(3, bool), src, dst, decay, rounds=2, batch=4)
    assert set(seen) == {1}
    fixed = {k: gnn.Node(w, live=False) for k, w in gnn.start(9, 8, 2, 0).items()}
    assert forward(fixed, rng.normal(size=(1, 48, 3, 9)).astype(np.float32), src, dst, decay).back == ()


def test_held_out_sites_follow_their_neighbours(spark):
    """Two districts with days of their own: a held-out site is told by the sites linked to it."""
    rng = np.random.default_rng(2)
    rows, sites, edges = [], [], []
    names = [f"{a}{k}" for a in "ab" for k in range(4)]
    for n in names:
        sites.append((n, 0.0 if n[0] == "a" else 1.0, float(n[1]), n in ("a3", "b3")))
        edges += [(n, m, 0.8) for m in names if m[0] == n[0] and m != n]
    for day in range(40):
        level = {"a": rng.choice([5, 80]), "b": rng.choice([5, 80])}
        rows += [(n, datetime(2022, 1, 1) + timedelta(days=day, hours=h), float(rng.poisson(level[n[0]]))) for n in names for h in range(24)]
    c = spark.createDataFrame(rows, "site string, ts timestamp_ntz, y double")
    s = spark.createDataFrame(sites, "site string, x double, y double, held boolean")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {(r["site"], r["ts"]): r["pred"] for r in gnn.predictions(c, s, e, 30, 1, d=16, rounds=25, patience=6, rate=5e-3).collect()}
    truth = {(n, t): y for n, t, y in rows}
    keys = [k for k in got if k in truth]
    assert {k[0] for k in keys} == {"a3", "b3"} and len(keys) == len(got) == 2 * 24 * 40
    mae = np.mean([abs(got[k] - truth[k]) for k in keys])
    flat = np.mean([abs(truth[k] - 42) for k in keys])
    assert mae < flat / 2, (mae, flat)
    assert gnn.predictions(c.limit(0), s, e, 3).count() == 0

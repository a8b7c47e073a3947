"""Network operators against plain algorithms on small random graphs."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from countweave.operators import network, spatial


def graph(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, cost double")


def dijkstra(edges, source):
    out, heap, near = {}, [(0.0, source)], {}
    for u, v, c in edges:
        near.setdefault(u, []).append((v, c))
    while heap:
        d, u = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = d
        for v, c in near.get(u, []):
            if v not in out:
                heapq.heappush(heap, (d + c, v))
    return out


def random_edges(n, m, seed, whole=False):
    r = random.Random(seed)
    return [(a, b, float(r.randint(1, 6)) if whole else round(r.uniform(1, 9), 3)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b]


def test_paths_of_any_number_of_edges(spark):
    """A way of many edges is found; routes lead back to their source."""
    line = [(k, k + 1, 1.0) for k in range(24)] + [(0, 24, 30.0)]
    t = network.shortest_paths(graph(spark, line), spark.createDataFrame([(0,)], "node long"), 1e9)
    assert {r["node"]: r["cost"] for r in t.collect()} == {k: float(k) for k in range(25)}
    on = network.path_edges(t, t.select("source", "node").where("node = 24"))
    assert sorted((r["u"], r["v"]) for r in on.collect()) == [(k, k + 1) for k in range(24)]
    with pytest.raises(ValueError):
        network.shortest_paths(graph(spark, [(0, 1, -1.0)]), spark.createDataFrame([(0,)], "node long"), 9.0)


def test_cells_have_one_label_a_node(spark):
    edges = random_edges(40, 90, 2)
    sources = [0, 7, 21]
    both = edges + [(b, a, c) for a, b, c in edges]
    d = {s: dijkstra(both, s) for s in sources}
    want = {n: min((d[s][n], s) for s in sources if n in d[s]) for n in range(40) if any(n in d[s] for s in sources)}
    got = network.nearest_source(network.undirected(graph(spark, edges)), spark.createDataFrame([(s,) for s in sources], "node long")).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["cost"] == pytest.approx(want[r["node"]][0]) and d[r["source"]][r["node"]] == pytest.approx(r["cost"])


def betweenness(edges, sources):
    """Brandes by hand, one source after another."""
    best = {}
    for a, b, c in edges:
        for k in ((a, b), (b, a)):
            best[k] = min(c, best.get(k, 1e99))
    near = {}
    for (a, b), c in best.items():
        near.setdefault(a, []).append((b, c))
    out = {k: 0.0 for k in best if k[0] < k[1]}
    for s in sources:
        d = dijkstra([(a, b, c) for (a, b), c in best.items()], s)
        order = sorted(d, key=d.get)
        ways = {v: 0.0 for v in order}
        ways[s] = 1.0
        for u in order:
            for v, c in near.get(u, []):
                if v in d and abs(d[u] + c - d[v]) < 1e-9:
                    ways[v] += ways[u]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u, c in near.get(v, []):
                if u in d and abs(d[u] + c - d[v]) < 1e-9:
                    x = ways[u] / ways[v] * (1 + delta[v])
                    delta[u] += x
                    out[min(u, v), max(u, v)] += x
    return out


def test_edge_betweenness(spark):
    edges = random_edges(14, 26, 4, whole=True)  # whole costs: many ways are equally cheap
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    want = betweenness(edges, nodes)
    n = len(nodes)
    got = {(r["u"], r["v"]): r["betweenness"] for r in network.edge_betweenness(graph(spark, edges), 100).collect()}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x / (n * (n - 1)))


def test_betweenness_runs_in_one_pass(spark, monkeypatch):
    """However long the ways: nothing is written round by round, and drawn nodes share the work."""
    cuts = []
    monkeypatch.setattr(network, "cut", lambda df: cuts.append(df) or df)
    edges = [(k, k + 1, 1.0) for k in range(40)]
    got = {(r["u"], r["v"]): r["betweenness"] for r in network.edge_betweenness(graph(spark, edges), 100).collect()}
    assert got == pytest.approx({(k, k + 1): 2 * (k + 1) * (40 - k) / (41 * 40) for k in range(40)}) and len(cuts) == 1


def greedy(rows, apart, most):
    out = []
    for i, x, y, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(out) < most and all((x - a) ** 2 + (y - b) ** 2 >= apart * apart for _, a, b in out):
            out.append((i, x, y))
    return out


def test_spacing_is_exact_beyond_a_pool(spark):
    """The best candidates crowd in one place; those that count come after more than a pool of them."""
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.uniform(0, 5)), float(rng.uniform(0, 5)), 1000.0 - k) for k in range(60)]
    rows += [(1000 + k, 100.0 * k, 50.0, 10.0 + k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, y double, score double")
    assert network.spaced(df, 90.0, 20, pool=7) == greedy(rows, 90.0, 20)
    assert network.spaced(df.limit(0), 90.0, 20) == []


def test_nearest_however_far(spark):
    rng = np.random.default_rng(1)
    a = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1000, (40, 2)))] + [(99, 50_000.0, 50_000.0)]
    b = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1000, (5, 2)))]
    mk = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["a_id"]: r["b_id"] for r in spatial.nearest_any(mk(a), mk(b), 10.0).collect()}
    assert got == {i: min(b, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[0] for i, x, y in a}
    assert {r["b_id"] for r in spatial.nearest_any(mk(a), mk([]), 10.0).collect()} == {None}


def test_components_of_a_long_line(spark):
    n = 70
    nodes = spark.createDataFrame([(k,) for k in range(n)], "id long")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n - 1) if k != 40], "a_id long, b_id long")
    got = {r["id"]: r["root"] for r in spatial.components(nodes, pairs).collect()}
    assert got == {k: 0 if k <= 40 else 41 for k in range(n)}


def test_unordered_candidates_and_tags(spark):
    t = spark.createDataFrame([(1, 2, 5.0), (1, 3, 4.0), (2, 1, 5.0), (3, 1, 4.0), (2, 3, 9.0), (3, 2, 9.0), (1, 1, 0.0), (2, 3, None)], "src int, dst int, cost double")
    assert sorted(map(tuple, spatial.candidate_pairs(t, 1).collect())) == [(1, 2, 5.0), (1, 3, 4.0)]
    w = spark.createDataFrame([({"highway": "x", "cycleway:left": "lane"},), ({"highway": "cycleway"},), ({"cycleway": "no", "oneway:bicycle": "no"},), ({"highway": "x"},)], "t map<string,string>")
    got = [tuple(r) for r in w.select(network.tagged(F.col("t"), network.FACILITY), network.tagged(F.col("t"), network.TWO_WAY), network.lookup(F.col("t")["highway"], network.ROAD_RANK, network.OTHER_ROAD)).collect()]
    assert got == [(True, False, 0), (True, False, -1), (False, True, 0), (False, False, 0)]

"""Directed networks as edge tables (u, v, cost)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countweave.functions.checkpoints import cut
from countweave.operators.spatial import segment_distance

# Ranks of road classes (any other class has rank 0), cost factors of planned-network
# ranks, and which values of which way tags say that there is a facility or two-way riding.
ROAD_RANK = {"trunk": 5, "trunk_link": 5, "primary": 4, "primary_link": 4, "secondary": 3, "secondary_link": 3, "tertiary": 2, "tertiary_link": 2, "unclassified": 1, "residential": 1, "living_street": 0, "service": 0, "cycleway": -1, "path": -1, "track": -1, "footway": -1, "pedestrian": -1, "bridleway": -1}
OTHER_ROAD = 0
PLANNED_FACTOR = {3: 0.8, 2: 0.9, 1: 1.0, 0: 1.2}
FACILITY = {"highway": "=cycleway", "bicycle": "=designated", "cycleway": "lane", "cycleway:left": "lane", "cycleway:right": "lane", "cycleway:both": "lane"}
TWO_WAY = {"oneway:bicycle": "=no", "cycleway": "opposite*", "cycleway:left": "opposite*", "cycleway:right": "opposite*"}
NO_LANE = ("", "no", "none", "nan", "separate", "shared_lane")


def lookup(c: Column, table: dict, default) -> Column:
    """Dictionary mapping with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def tagged(tags: Column, rules: dict[str, str]) -> Column:
    """Any rule of a tag table holds for a map of way tags: `=x` the value is x, `x*` it begins with x,
    `lane` it names a lane in use. A missing tag is an empty value."""

    def holds(key: str, rule: str) -> Column:
        value = F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))
        if rule == "lane":
            return ~value.isin(*NO_LANE)
        return value == rule[1:] if rule[0] == "=" else value.startswith(rule[:-1])

    return reduce(or_, (holds(*r) for r in rules.items()))


def min_parallel(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.min("cost").alias("cost"))


def add_contraflow(edges: DataFrame, allowed: str) -> DataFrame:
    """Adds the reverse of edges marked `allowed` where no such edge exists."""
    back = edges.where(allowed).select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")
    new = back.join(edges.select("u", "v"), ["u", "v"], "left_anti")
    return edges.select("u", "v", "cost").unionByName(new)


def symmetrised(t: DataFrame) -> DataFrame:
    """Mean of both directions, or the one that exists."""
    back = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cost").alias("back"))
    j = t.join(back, ["src", "dst"], "full")
    return j.select("src", "dst", ((F.coalesce("cost", "back") + F.coalesce("back", "cost")) / 2).alias("cost"))


def bypassed(edges: DataFrame, removed: Sequence) -> DataFrame:
    """Edges without the removed nodes: one node at a time, its in-edges times its out-edges become
    shortcuts where they are cheaper. The number of removed nodes bounds the plan."""
    e = min_parallel(edges)
    for x in removed:
        ins = e.where((F.col("v") == x) & (F.col("u") != x)).select("u", F.col("cost").alias("c1"), F.lit(1).alias("__j"))
        outs = e.where((F.col("u") == x) & (F.col("v") != x)).select("v", F.col("cost").alias("c2"), F.lit(1).alias("__j"))
        short = ins.join(outs, "__j").where("u <> v").select("u", "v", (F.col("c1") + F.col("c2")).alias("cost"))
        e = min_parallel(e.where((F.col("u") != x) & (F.col("v") != x)).unionByName(short))
    return e


def _relaxed(edges: DataFrame, best: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """best (keys, cost, via) relaxed over edges to its fixed point: rounds from what improved last,
    lineage cut each round. A new entry takes the keys of the one it came from, but for `node`. The
    least (cost, via) wins. Costs must not be negative, so no way has more edges than there are nodes."""
    e = cut(min_parallel(edges))
    if e.where("cost < 0").head(1):
        raise ValueError("negative cost")
    rest = [k for k in keys if k != "node"]
    front = best = cut(best)
    e = e.withColumnRenamed("cost", "c")
    while True:
        step = front.join(e, front["node"] == e["u"]).select(*rest, F.col("v").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), _via(front, e).alias("via")).where(F.col("cost") <= cutoff)
        step = step.groupBy(*keys).agg(F.min(F.struct("cost", "via")).alias("m")).select(*keys, F.col("m.cost").alias("cost"), F.col("m.via").alias("via"))
        old = best.select(*keys, F.col("cost").alias("was"), F.col("via").alias("was_via"))
        j = cut(old.join(step, keys, "full").withColumn("better", F.coalesce(F.col("cost") < F.col("was"), F.col("was").isNull())))
        best = j.select(*keys, *[F.when(F.col("better"), F.col(c)).otherwise(F.col(w)).alias(c) for c, w in (("cost", "was"), ("via", "was_via"))])
        front = j.where("better").select(*keys, "cost", "via")
        if not front.head(1):
            return best


def _via(front: DataFrame, e: DataFrame) -> Column:
    """What is carried along: the predecessor where entries have a source of their own, else the source."""
    return e["u"] if "source" in front.columns else front["via"]


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """source, node, cost, prev: cheapest directed ways up to the cutoff, of any number of edges; ties
    take the smaller predecessor."""
    first = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"), F.col("node").alias("via"))
    return _relaxed(edges, first, ["source", "node"], cutoff).withColumnRenamed("via", "prev")


def nearest_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, cost, source: each node's nearest source by directed ways (ties: the smaller), one label a
    node; nodes that no source reaches have no row."""
    first = sources.select("node", F.lit(0.0).alias("cost"), F.col("node").alias("via"))
    return _relaxed(edges, first, ["node"], float("inf")).withColumnRenamed("via", "source")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge at its cheaper cost."""
    return min_parallel(edges.select("u", "v", "cost").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")))


def voronoi_adjacency(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """Retained nodes whose cells (undirected nearest source) touch, with the directed cost, up to
    the cutoff."""
    cell = nearest_source(undirected(edges), sources).select("node", F.col("source").alias("cell"))
    e = edges.join(cell.select(F.col("node").alias("u"), F.col("cell").alias("cu")), "u").join(cell.select(F.col("node").alias("v"), F.col("cell").alias("cv")), "v").where("cu <> cv")
    pair = e.select(F.col("cu").alias("src"), F.col("cv").alias("dst")).unionByName(e.select(F.col("cv").alias("src"), F.col("cu").alias("dst"))).distinct()
    t = shortest_paths(edges, sources, cutoff).select(F.col("source").alias("src"), F.col("node").alias("dst"), "cost")
    return pair.join(t, ["src", "dst"])


def path_edges(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, node, u, v: the edges on the ways to the wanted (source, node), back along prev to the
    source."""
    at = cut(wanted.select("source", "node", F.col("node").alias("v")))
    prev = paths.select("source", F.col("node").alias("v"), F.col("prev").alias("u")).where("u <> v")
    out = None
    while True:
        step = cut(at.join(prev, ["source", "v"]).select("source", "node", "u", "v"))
        if not step.head(1):
            return out if out is not None else step
        out = step if out is None else out.unionByName(step)
        at = step.select("source", "node", F.col("u").alias("v"))


def _over_edges(u: np.ndarray, v: np.ndarray, c: np.ndarray, n: int, sources: Iterable[int]) -> np.ndarray:
    """Sums over the sources of each directed edge's share of the cheapest ways (Brandes 2001): the nodes
    are 0 ... n - 1, the edges sorted by u. Equally cheap ways share."""
    first, to, costs = np.searchsorted(u, np.arange(n + 1)).tolist(), v.tolist(), c.tolist()
    out = np.zeros(len(u))
    for source in sources:
        dist, heap = [math.inf] * n, [(0.0, source)]
        dist[source] = 0.0
        while heap:
            at, x = heapq.heappop(heap)
            if at > dist[x]:
                continue
            for k in range(first[x], first[x + 1]):
                new = at + costs[k]
                if new < dist[to[k]]:
                    dist[to[k]] = new
                    heapq.heappush(heap, (new, to[k]))
        d = np.array(dist)
        du, dv = d[u], d[v]
        k = np.flatnonzero(np.isfinite(du))
        k = k[(np.abs(du[k] + c[k] - dv[k]) <= 1e-9 * np.maximum(1.0, dv[k])) & (dv[k] > du[k])]
        k = k[np.argsort(du[k], kind="stable")]  # what leads to a node comes ahead of what leaves it
        us, vs = u[k].tolist(), v[k].tolist()
        ways, delta, x = [0.0] * n, [0.0] * n, [0.0] * len(us)
        ways[source] = 1.0
        for p, q in zip(us, vs):
            ways[q] += ways[p]
        if not all(ways[q] for q in vs):
            raise ValueError("cost not above 0")  # a node reached by an edge without length alone
        for i in range(len(us) - 1, -1, -1):
            p, q = us[i], vs[i]
            x[i] = ways[p] / ways[q] * (1 + delta[q])
            delta[p] += x[i]
        out[k] += x
    return out


def edge_betweenness(edges: DataFrame, samples: int, seed: int = 0, blocks: int = 24) -> DataFrame:
    """u, v (u < v), betweenness of undirected edges by cost: the share of cheapest ways over an edge,
    from `samples` nodes drawn by a seeded hash (all of them where there are no more), scaled to all
    pairs. Equally cheap ways share. Costs must be above 0. The drawn nodes go in `blocks` to tasks that
    hold the graph, some 100 bytes an edge; nothing travels for each node and source."""
    e = cut(undirected(edges.where("u <> v")))
    kind = e.schema["u"].dataType.simpleString()
    nodes = e.select(F.col("u").alias("node")).distinct()
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(samples)
    drawn = drawn.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    graph = e.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([right["u"].to_numpy(), right["v"].to_numpy()]), return_inverse=True)
        u, v = np.split(codes, 2)
        if (right["cost"] < 0).any():
            raise ValueError("negative cost")
        order = np.lexsort([v, u])
        u, v = u[order], v[order]
        x = _over_edges(u, v, right["cost"].to_numpy(float)[order], len(names), np.searchsorted(names, left["node"].to_numpy()).tolist())
        on = x > 0
        return pd.DataFrame({"u": names[u[on]], "v": names[v[on]], "x": x[on]})

    on = drawn.groupBy("block").cogroup(graph.groupBy("block")).applyInPandas(work, f"u {kind}, v {kind}, x double")
    sums = on.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("x").alias("x"))
    every = e.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")).join(sums, ["a", "b"], "left")
    n = nodes.agg(F.count("*").cast("double").alias("n"), F.lit(1).alias("__j"))
    k = F.least(F.lit(float(samples)), F.col("n"))
    x = every.withColumn("__j", F.lit(1)).join(F.broadcast(n), "__j")  # one row
    return x.select(F.col("a").alias("u"), F.col("b").alias("v"), (F.coalesce("x", F.lit(0.0)) / (F.col("n") - 1) / k).alias("betweenness"))


def route_shares(on_path: DataFrame, edges: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Length-weighted share of each flag along every route."""
    j = on_path.join(edges, ["u", "v"])
    return j.groupBy("source", "node").agg(F.sum("length").alias("length"), *[(F.sum(F.col("length") * F.col(f).cast("double")) / F.sum("length")).alias(f"{f}_share") for f in flags])


def conflated(edges: DataFrame, planned: DataFrame, sample: float = 10.0, match: float = 15.0, share: float = 0.6) -> DataFrame:
    """edge_id, rank, factor: points every `sample` metres along an edge (edge_id, x1, y1, x2, y2)
    are matched to planned lines (rank, x1, ...) within `match`; the edge takes the highest rank r
    that at least `share` of its points reach."""
    n = F.greatest(F.lit(2), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / sample) + 1).cast("int")
    p = edges.withColumn("n", n).select("edge_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "x1", "y1", "x2", "y2")
    f = F.col("i") / (F.col("n") - 1)
    p = p.select("edge_id", "i", "n", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y"))
    size = match * 4
    p = p.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((F.least(lo, hi) - match) / size), F.floor((F.greatest(lo, hi) + match) / size)))
    q = planned.select("*", cells("x1", "x2").alias("cx")).select("*", cells("y1", "y2").alias("cy"))
    hit = p.join(q, ["cx", "cy"]).where(segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= match).groupBy("edge_id", "i").agg(F.max("rank").alias("r"))
    pts = p.select("edge_id", "i", "n").join(hit, ["edge_id", "i"], "left").fillna(0, ["r"])
    g = pts.groupBy("edge_id").agg(*[(F.avg((F.col("r") >= k).cast("double")) >= share).alias(f"r{k}") for k in (1, 2, 3)])
    rank = F.when(F.col("r3"), 3).when(F.col("r2"), 2).when(F.col("r1"), 1).otherwise(0)
    return g.select("edge_id", rank.alias("rank"), lookup(rank, PLANNED_FACTOR, 1.0).alias("factor"))


def lengths_by_class(on_path: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """source, node, the class and its kilometres along every route."""
    return on_path.join(edges, ["u", "v"]).groupBy("source", "node", kind).agg((F.sum("length") / 1000).alias("km"))


def spaced(candidates: DataFrame, apart: float, most: int, pool: int = 5000) -> list[tuple]:
    """Greedy choice of at most `most` candidates (id, x, y, score), best first (ties: smaller id), each
    at least `apart` from those chosen. Sequential by nature, so `pool` candidates come to the driver
    at a time: the best of those that are far enough from all chosen so far, until none is left. A
    round chooses one at least. Candidates without a score or place do not count."""
    ok = candidates.where("x IS NOT NULL AND y IS NOT NULL AND score IS NOT NULL")
    out: list[tuple] = []
    while len(out) < most:
        clear = [(F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) >= apart * apart for _, x, y in out]
        w = (ok.where(reduce(and_, clear)) if clear else ok).orderBy(F.desc("score"), "id").limit(pool).collect()
        if not w:
            break
        chosen = {r[0] for r in out}
        for r in w:
            if len(out) < most and r["id"] not in chosen and all((r["x"] - x) ** 2 + (r["y"] - y) ** 2 >= apart * apart for _, x, y in out):
                out.append((r["id"], r["x"], r["y"]))
        if len(out) == len(chosen):
            break
    return out


def radius_shares(nodes: DataFrame, lines: DataFrame, r: float) -> DataFrame:
    """id, km, share: length of lines with a midpoint within r of a node, and the share with facility."""
    from countweave.operators.spatial import within

    mid = lines.select(F.col("edge_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    size = lines.select(F.col("edge_id").alias("b_id"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"), "facility")
    g = within(nodes, mid, r).join(size, "b_id").groupBy(F.col("a_id").alias("id"))
    return g.agg((F.sum("length") / 1000).alias("km"), (F.sum(F.when(F.col("facility"), F.col("length")).otherwise(0.0)) / F.sum("length")).alias("share"))


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))

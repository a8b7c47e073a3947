"""Points in metres: distances, nearest neighbours, snapping, clusters, hulls.

Distance joins meet on grid cells of the search radius (each point looks into its 3 x 3 cells),
so their cost follows the number of near pairs, not of all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countweave.functions.checkpoints import cut


def latest_positions(devices: DataFrame, order: list[str]) -> DataFrame:
    """site_id, x, y of each site's latest record with a position."""
    d = devices.where("x IS NOT NULL AND y IS NOT NULL")
    return d.groupBy("site_id").agg(F.max_by(F.struct("x", "y"), F.struct(*order)).alias("p")).select("site_id", "p.x", "p.y")


def within(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """a_id, b_id, dist of points of a and b (id, x, y) at most r apart."""
    cell = lambda v: F.floor(F.col(v) / r)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    pa = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    pb = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("kx"), cell("y").alias("ky"))
    pb = pb.withColumn("dx", around).select("*", around.alias("dy")).withColumn("cx", F.col("kx") + F.col("dx")).withColumn("cy", F.col("ky") + F.col("dy"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return pa.join(pb, ["cx", "cy"]).select("a_id", "b_id", d.alias("dist")).where(F.col("dist") <= r)


def nearest(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """Every a_id with its nearest b_id within r (ties: smaller id), null beyond."""
    n = within(a, b, r).groupBy("a_id").agg(F.min(F.struct("dist", "b_id")).alias("m"))
    return a.select(F.col("id").alias("a_id")).join(n, "a_id", "left").select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.dist").alias("dist"))


def nearest_any(a: DataFrame, b: DataFrame, start: float) -> DataFrame:
    """Every a_id with its nearest b_id however far (ties: smaller id), null only where b is empty.

    The radius doubles from `start` for the points that have found none yet, so dense regions meet in
    small cells; when a radius covers the extent of all points, every point has found one. Points
    without coordinates are not matched."""
    pts = lambda d: d.where("x IS NOT NULL AND y IS NOT NULL")
    both = pts(a).select("x", "y").unionByName(pts(b).select("x", "y"))
    box = both.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    span = max(box[1] - box[0], box[3] - box[2]) * 1.5 if box[0] is not None else 0.0
    left, found, r = cut(pts(a).select("id", "x", "y")), None, start
    while left.head(1):
        n = cut(within(left, pts(b), r).groupBy("a_id").agg(F.min(F.struct("dist", "b_id")).alias("m")))
        found = n if found is None else found.unionByName(n)
        if r > span:
            break
        left = cut(left.join(n.select(F.col("a_id").alias("id")), "id", "left_anti"))
        r *= 2
    ids = a.select(F.col("id").alias("a_id"))
    if found is None:
        return ids.select("a_id", F.lit(None).cast(b.schema["id"].dataType).alias("b_id"), F.lit(None).cast("double").alias("dist"))
    return ids.join(found, "a_id", "left").select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.dist").alias("dist"))


def candidate_pairs(t: DataFrame, k: int) -> DataFrame:
    """src < dst, cost: unordered pairs in which one is among the other's k cheapest (by the symmetric
    cost t: src, dst, cost). Ties go by dst. Nulls and self pairs do not count."""
    w = Window.partitionBy("src").orderBy("cost", "dst")
    top = t.where("src <> dst AND cost IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    return top.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("cost").alias("cost"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / l2))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def snap(points: DataFrame, segments: DataFrame, r: float) -> DataFrame:
    """a_id, seg_id, dist: the nearest segment (seg_id, x1, y1, x2, y2) of each point within r.
    A segment is entered into every cell of its bounding box widened by r."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((F.least(lo, hi) - r) / r), F.floor((F.greatest(lo, hi) + r) / r)))
    s = segments.select("*", cells("x1", "x2").alias("cx")).select("*", cells("y1", "y2").alias("cy"))
    p = points.select(F.col("id").alias("a_id"), "x", "y", F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy"))
    d = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    j = p.join(s, ["cx", "cy"]).select("a_id", "seg_id", d.alias("dist")).where(F.col("dist") <= r)
    return j.groupBy("a_id").agg(F.min(F.struct("dist", "seg_id")).alias("m")).select("a_id", F.col("m.seg_id").alias("seg_id"), F.col("m.dist").alias("dist"))


def knn_edges(t: DataFrame, k: int, tau: float) -> DataFrame:
    """t (src, dst, cost) -> symmetric edges of each row's k cheapest others, with minutes and
    weight exp(-cost / tau). Ties go by dst. Nulls and self pairs do not count."""
    w = Window.partitionBy("src").orderBy("cost", "dst")
    top = t.where("src <> dst AND cost IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("src", "dst", "cost")
    both = top.unionByName(top.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    e = both.groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    return e.select("src", "dst", (F.col("cost") / 60).alias("minutes"), F.exp(-F.col("cost") / tau).alias("weight"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, root: the smallest id of each node's connected component.

    Rounds of taking the least root among neighbours, then jumping to the root's root; the number
    of rounds grows with the logarithm of a component's length. Lineage is cut by checkpoints.
    """
    e = pairs.select(F.col("a_id").alias("s"), F.col("b_id").alias("d"))
    e = cut(e.unionByName(e.select(F.col("d").alias("s"), F.col("s").alias("d"))).where("s <> d").distinct())
    lab = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = e.join(lab.withColumnRenamed("id", "d"), "d").groupBy(F.col("s").alias("id")).agg(F.min("root").alias("n"))
        new = lab.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("n", "root")).alias("root"))
        up = new.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = cut(new.join(up, "root").select("id", "old", F.least("root", "up").alias("root")))
        lab = new.select("id", "root")
        if not new.where("old <> root").head(1):
            return lab


def cluster_labels(points: DataFrame, r: float, distinct_only: bool = True) -> DataFrame:
    """id, label: ids of the single-linkage cluster (distance < r) joined by `+`. With
    distinct_only, points at distance 0 are not linked."""
    p = within(points, points, r).where((F.col("a_id") < F.col("b_id")) & (F.col("dist") < r))
    p = p.where("dist > 0") if distinct_only else p
    c = components(points, p)
    lab = c.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("id")), "+").alias("label"))
    return c.join(lab, "root").select("id", "label")


def _hull(xy: np.ndarray) -> np.ndarray:
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def hull(points: DataFrame) -> DataFrame:
    """Corners (i, x, y) of the convex hull, anticlockwise: hulls of partitions, then of their corners."""

    def part(it):
        got = None
        for pdf in it:
            xy = pdf[["x", "y"]].dropna().to_numpy(float)
            got = _hull(xy if got is None else np.vstack([got, xy]))
        if got is not None and len(got):
            yield pd.DataFrame({"i": np.arange(len(got)), "x": got[:, 0], "y": got[:, 1]})

    schema = "i long, x double, y double"
    return points.select("x", "y").mapInPandas(part, schema).repartition(1).mapInPandas(part, schema)  # corners alone meet


def near_hull(points: DataFrame, corners: DataFrame, r: float) -> DataFrame:
    """id, dist, of points inside the hull (dist 0) or within r of it. Corners become edges held
    as one array row, which is as small as the hull."""
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    c = corners.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(w))).withColumn("ny", F.coalesce(F.lead("y").over(w), F.first("y").over(w)))
    one = c.agg(F.collect_list(F.struct("x", "y", "nx", "ny")).alias("e")).withColumn("__j", F.lit(1))
    j = points.withColumn("__j", F.lit(1)).join(F.broadcast(one), "__j")  # one row
    inside = F.forall("e", lambda s: (s["nx"] - s["x"]) * (F.col("y") - s["y"]) - (s["ny"] - s["y"]) * (F.col("x") - s["x"]) >= 0)
    d = F.array_min(F.transform("e", lambda s: segment_distance(F.col("x"), F.col("y"), s["x"], s["y"], s["nx"], s["ny"])))
    return j.select("id", F.when(inside, 0.0).otherwise(d).alias("dist")).where(F.col("dist") <= r)

"""Spatial and network operators: queries and SQL. Positions are those of site_devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countweave.functions.settings import DEFAULT
from countweave.operators import network, spatial
from countweave.plans.registry import Registry
from countweave.sources.tables import table

R = Registry()
NEAR = 1500.0  # metres
SPEED = 16 / 3.6  # metres a second


def sites(spark: SparkSession, d: str) -> DataFrame:
    return spatial.latest_positions(table(spark, d, "site_devices").where("valid_from IS NOT NULL"), ["valid_from", "rec_id"]).select(F.col("site_id").alias("id"), "x", "y")


SITES = "s AS (SELECT site_id AS id, x, y FROM (SELECT site_id, x, y, row_number() OVER (PARTITION BY site_id ORDER BY valid_from DESC, rec_id DESC) AS k FROM site_devices WHERE valid_from IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL) WHERE k = 1)"
PAIR = f"{SITES}, w AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM s a JOIN s b ON abs(a.x - b.x) <= {NEAR} AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {NEAR})"
TIMES = f"{PAIR}, t AS (SELECT a_id AS src, b_id AS dst, round(dist / {SPEED}, 6) AS cost FROM w WHERE a_id <> b_id)"


def times(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, cost: seconds between sites closer than NEAR."""
    s = sites(spark, d)
    return spatial.within(s, s, NEAR).where("a_id <> b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.round(F.col("dist") / SPEED, 6).alias("cost"))


@R(f"WITH {PAIR} SELECT a_id, b_id, round(dist, 4) AS dist FROM w WHERE a_id < b_id")
def within_distance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sites within a distance, over grid cells."""
    s = sites(spark, d)
    return spatial.within(s, s, NEAR).where("a_id < b_id").withColumn("dist", F.round("dist", 4))


def customers_at(spark: SparkSession, d: str) -> DataFrame:
    """Points spread over the sites' area, from customer keys."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (2673000 + F.pmod(k * 7919, F.lit(19200))).cast("double").alias("x"), (1239500 + F.pmod(k * 104729, F.lit(16500))).cast("double").alias("y"))


PTS = "p AS (SELECT c_custkey AS id, CAST(2673000 + (c_custkey * 7919) % 19200 AS DOUBLE) AS x, CAST(1239500 + (c_custkey * 104729) % 16500 AS DOUBLE) AS y FROM customer)"


@R(f"WITH {SITES}, {PTS}, j AS (SELECT p.id AS a_id, s.id AS b_id, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist FROM p JOIN s ON abs(p.x - s.x) <= 1000 AND sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 1000), r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS k FROM j) SELECT p.id AS a_id, r.b_id, round(r.dist, 4) AS dist FROM p LEFT JOIN r ON r.a_id = p.id AND k = 1")
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbour with a largest distance."""
    return spatial.nearest(customers_at(spark, d), sites(spark, d), 1000.0).withColumn("dist", F.round("dist", 4))


def links(spark: SparkSession, d: str) -> DataFrame:
    """A network: each site to its three nearest, with end points."""
    e = spatial.knn_edges(times(spark, d), 3, 300.0)
    s = sites(spark, d)
    e = e.join(s.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(s.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    return e.withColumn("edge_id", F.concat("src", F.lit(">"), "dst"))


KNN = f"{TIMES}, top AS (SELECT src, dst, cost FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cost, dst) AS k FROM t) WHERE k <= 3), bo AS (SELECT src, dst, cost FROM top UNION ALL SELECT dst, src, cost FROM top), knn AS (SELECT src, dst, min(cost) AS cost FROM bo GROUP BY 1, 2)"
LINKS = f"{KNN}, ln AS (SELECT src || '>' || dst AS edge_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, src, dst, cost FROM knn JOIN s a ON a.id = src JOIN s b ON b.id = dst)"
SEG = "sqrt((p.x - (x1 + greatest(0, least(1, CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 0 THEN ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) ELSE 0 END)) * (x2 - x1))) ** 2 + (p.y - (y1 + greatest(0, least(1, CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 0 THEN ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) ELSE 0 END)) * (y2 - y1))) ** 2)"


@R(f"WITH {KNN} SELECT src, dst, round(cost / 60, 5) AS minutes, round(exp(-cost / 300), 6) AS weight FROM knn")
def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric k nearest."""
    return spatial.knn_edges(times(spark, d), 3, 300.0).select("src", "dst", F.round("minutes", 5).alias("minutes"), F.round("weight", 6).alias("weight"))


@R(f"WITH {LINKS}, {PTS}, j AS (SELECT p.id AS a_id, {SEG} AS dist FROM p JOIN (SELECT * FROM ln WHERE src < dst) l ON p.x BETWEEN least(x1, x2) - 200 AND greatest(x1, x2) + 200 AND p.y BETWEEN least(y1, y2) - 200 AND greatest(y1, y2) + 200) SELECT a_id, round(min(dist), 3) AS dist FROM j WHERE dist <= 200 GROUP BY 1")
def snap_to_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nearest edge of a network."""
    seg = links(spark, d).where("src < dst").select(F.col("edge_id").alias("seg_id"), "x1", "y1", "x2", "y2")
    return spatial.snap(customers_at(spark, d), seg, 200.0).select("a_id", F.round("dist", 3).alias("dist"))


@R(f"""WITH RECURSIVE {SITES}, q AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 800 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 0),
r AS (SELECT id, id AS root FROM s UNION SELECT q.b, r.root FROM r JOIN q ON q.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT m.id, (SELECT string_agg(n.id, '+' ORDER BY n.id) FROM m n WHERE n.root = m.root) AS label FROM m""")
def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    """Single-linkage clusters."""
    return spatial.cluster_labels(sites(spark, d), 800.0)


def near_area(spark: SparkSession, d: str) -> DataFrame:
    """Points within 500 m of the convex hull of the sites."""
    return spatial.near_hull(customers_at(spark, d), spatial.hull(sites(spark, d)), 500.0).withColumn("dist", F.round("dist", 3))


R()(near_area)


@R(f"WITH {SITES}, {PTS}, j AS (SELECT p.id AS a_id, s.id AS b_id, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), s.id) AS k FROM p, s) SELECT a_id, b_id, round(dist, 4) AS dist FROM j WHERE k = 1")
def nearest_site_any(spark: SparkSession, d: str) -> DataFrame:
    """J18 without a largest distance."""
    return spatial.nearest_any(customers_at(spark, d), sites(spark, d), 500.0).withColumn("dist", F.round("dist", 4))


@R(f"WITH {SITES}, {PTS} SELECT p.id AS a_id, w.b_id, round(w.dist, 4) AS dist FROM p LEFT JOIN (SELECT p.id AS a_id, s.id AS b_id, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist FROM p JOIN s ON abs(p.x - s.x) <= 400 AND sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 400) w ON w.a_id = p.id")
def within_distance_left(spark: SparkSession, d: str) -> DataFrame:
    """J17 as a left join: points without a site nearby stay, with nulls."""
    p = customers_at(spark, d)
    w = spatial.within(p, sites(spark, d), 400.0)
    return p.select(F.col("id").alias("a_id")).join(w, "a_id", "left").withColumn("dist", F.round("dist", 4))


@R(f"WITH {TIMES}, k AS (SELECT src, dst, cost, row_number() OVER (PARTITION BY src ORDER BY cost, dst) AS k FROM t) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(cost), 5) AS cost FROM k WHERE k <= 10 GROUP BY 1, 2")
def route_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of each site and its ten nearest."""
    return spatial.candidate_pairs(times(spark, d), 10).withColumn("cost", F.round("cost", 5))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """A directed network with parallel edges, from all of lineitem: from each part to the next of its
    order, at the line's price."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.lead("l_partkey").over(w).alias("v"), F.col("l_extendedprice").alias("cost")).where("v IS NOT NULL AND u <> v")


def depots(spark: SparkSession, d: str) -> DataFrame:
    """Sources of ways: the nodes numbered as suppliers are."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


REACH = 6000.0
OE = "e AS (SELECT * FROM (SELECT l_partkey AS u, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS v, l_extendedprice AS cost FROM lineitem) WHERE v IS NOT NULL AND u <> v), me AS (SELECT u, v, min(cost) AS cost FROM e GROUP BY 1, 2)"


@R(f"WITH {OE} SELECT u, v, cost FROM me")
def min_parallel_edge(spark: SparkSession, d: str) -> DataFrame:
    """G02."""
    return network.min_parallel(order_edges(spark, d))


@R(f"WITH {OE} SELECT u, v, cost FROM me UNION ALL SELECT a.v, a.u, a.cost FROM me a ANTI JOIN me b ON b.u = a.v AND b.v = a.u WHERE a.u < a.v")
def contraflow_edges(spark: SparkSession, d: str) -> DataFrame:
    """Reverse edges where allowed and absent."""
    return network.add_contraflow(network.min_parallel(order_edges(spark, d)), "u < v")


@R(f"WITH {OE} SELECT coalesce(a.u, b.v) AS src, coalesce(a.v, b.u) AS dst, (coalesce(a.cost, b.cost) + coalesce(b.cost, a.cost)) / 2 AS cost FROM me a FULL JOIN me b ON b.u = a.v AND b.v = a.u")
def symmetrised_cost(spark: SparkSession, d: str) -> DataFrame:
    """G05."""
    t = network.min_parallel(order_edges(spark, d)).select(F.col("u").alias("src"), F.col("v").alias("dst"), "cost")
    return network.symmetrised(t)


def _bypass_sql() -> str:
    out, last = OE, "me"
    for x in (3, 7):
        out += f", x{x} AS (SELECT u, v, min(cost) AS cost FROM (SELECT * FROM {last} WHERE u <> {x} AND v <> {x} UNION ALL SELECT i.u, o.v, i.cost + o.cost FROM {last} i JOIN {last} o ON i.v = {x} AND o.u = {x} AND i.u <> o.v AND i.u <> {x} AND o.v <> {x}) GROUP BY 1, 2)"
        last = f"x{x}"
    return f"WITH {out} SELECT u, v, round(cost, 4) AS cost FROM {last}"


@R(_bypass_sql())
def node_bypass(spark: SparkSession, d: str) -> DataFrame:
    """Shortcuts past removed nodes."""
    return network.bypassed(order_edges(spark, d), [3, 7]).withColumn("cost", F.round("cost", 4))


_WAYS = f"""WITH RECURSIVE {OE}, p AS (SELECT s_suppkey AS source, s_suppkey AS node, 0.0::DOUBLE AS cost, 0 AS n FROM supplier UNION ALL SELECT source, v, min(p.cost + me.cost), any_value(n + 1) FROM p JOIN me ON me.u = p.node WHERE p.cost + me.cost <= {REACH} AND n < 40 GROUP BY source, v, n)"""


@R(f"{_WAYS} SELECT source, node, round(min(cost), 4) AS cost FROM p GROUP BY 1, 2")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Directed multi-source shortest paths up to a cutoff."""
    return network.shortest_paths(order_edges(spark, d), depots(spark, d), REACH).select("source", "node", F.round("cost", 4).alias("cost"))


def voronoi_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Retained nodes whose cells touch."""
    return network.voronoi_adjacency(order_edges(spark, d), depots(spark, d), REACH).withColumn("cost", F.round("cost", 4))


R()(voronoi_adjacency)


def nearest_depot(spark: SparkSession, d: str) -> DataFrame:
    """Each node's cell, by undirected ways."""
    return network.nearest_source(network.undirected(order_edges(spark, d)), depots(spark, d)).select("node", F.round("cost", 4).alias("cost"), "source")


R()(nearest_depot)


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = network.min_parallel(order_edges(spark, d)).withColumn("length", F.col("cost"))
    t = network.shortest_paths(e, depots(spark, d), REACH)
    on = network.path_edges(t, t.select("source", "node").where("source <> node"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("v"), (F.col("p_size") <= 25).alias("small"), F.substring("p_brand", 1, 7).alias("kind"))
    return on, e.join(part, "v").select("u", "v", "length", "small", "kind")


def route_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Edges along routes and length-weighted shares."""
    return network.route_shares(*_routes(spark, d), ["small"]).select("source", "node", F.round("length", 4).alias("length"), F.round("small_share", 6).alias("small_share"))


R()(route_rollup)


def route_km_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kilometres of each class along every route."""
    return network.lengths_by_class(*_routes(spark, d), "kind").withColumn("km", F.round("km", 6))


R()(route_km_by_kind)


def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Sampled betweenness of the site network's edges."""
    e = links(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("minutes").alias("cost"))
    return network.edge_betweenness(e, DEFAULT.betweenness_samples, DEFAULT.seed).withColumn("betweenness", F.round("betweenness", 8))


R()(edge_betweenness)


def planned_match(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The edges, and planned lines beside some of them: ranks by the length of the way."""
    e = links(spark, d).where("src < dst").select("edge_id", "x1", "y1", "x2", "y2", "minutes")
    rank = F.when(F.col("minutes") < 2, 3).when(F.col("minutes") < 3, 1)
    planned = e.select(rank.alias("rank"), F.col("x1") + 5, F.col("y1") + 5, F.col("x2") + 5, F.col("y2") + 5).toDF("rank", "x1", "y1", "x2", "y2").where("rank IS NOT NULL")
    return e.drop("minutes"), planned


def conflation(spark: SparkSession, d: str) -> DataFrame:
    """Edges matched to planned lines by sampled points."""
    return network.conflated(*planned_match(spark, d)).withColumn("factor", F.round("factor", 2))


R()(conflation)


def planned_km(spark: SparkSession, d: str) -> DataFrame:
    """Kilometres of the network by planned rank."""
    e, planned = planned_match(spark, d)
    length = e.select("edge_id", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("m"))
    return network.conflated(e, planned).join(length, "edge_id").groupBy("rank").agg(F.round(F.sum("m") / 1000, 4).alias("km"))


R()(planned_km)


@R(f"WITH {LINKS}, g AS (SELECT s.id, l.cost, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM s JOIN (SELECT * FROM ln WHERE src < dst) l ON sqrt(((x1 + x2) / 2 - s.x) ** 2 + ((y1 + y2) / 2 - s.y) ** 2) <= 1000) SELECT id, round(sum(len) / 1000, 4) AS km, round(sum(CASE WHEN cost < 200 THEN len ELSE 0.0 END) / sum(len), 5) AS share FROM g GROUP BY 1")
def radius_shares(spark: SparkSession, d: str) -> DataFrame:
    """Kilometres of edges near a node and the share with a property."""
    e = links(spark, d).where("src < dst").select("edge_id", "x1", "y1", "x2", "y2", (F.col("minutes") * 60 < 200).alias("facility"))
    return network.radius_shares(sites(spark, d), e, 1000.0).select("id", F.round("km", 4).alias("km"), F.round("share", 5).alias("share"))


def spaced_sites(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of sites at least 3 km apart, by number of records; a top-k report."""
    n = table(spark, d, "site_devices").groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("score"))
    got = network.spaced(sites(spark, d).join(n, "id"), 3000.0, 20)
    return spark.createDataFrame(got, "id string, x double, y double")


R()(spaced_sites)


def spaced_junctions(spark: SparkSession, d: str) -> DataFrame:
    """W11 as a choice of junctions: within 1 000 m of the sites' hull, at least 150 m from any site and
    400 m from each other, best first; a top-k report."""
    p, s = customers_at(spark, d), sites(spark, d)
    inside = spatial.near_hull(p, spatial.hull(s), 1000.0).select("id")
    taken = spatial.within(p, s, DEFAULT.holdout_m).where(F.col("dist") < DEFAULT.holdout_m).select(F.col("a_id").alias("id"))
    score = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    c = p.join(inside, "id", "left_semi").join(taken, "id", "left_anti").join(score, "id")
    return spark.createDataFrame(network.spaced(c, DEFAULT.junction_m, DEFAULT.junctions), "id long, x double, y double")


R()(spaced_junctions)

"""Source, scalar and report operators: queries and SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countweave.functions.checkpoints import shared_folder
from countweave.operators import network, panel, reporting
from countweave.plans import index
from countweave.plans.registry import Registry
from countweave.sources import files
from countweave.sources.tables import table

R = Registry()
LEDGER = [("e1", "2015", "physical", "VZS_A|VZS_B"), ("e2", "2021-03", "policy", ""), ("e3", "2021/2022-03", "physical", "VZS_C"), ("e4", "unknown", "physical", "VZS_D"), ("e5", "2020-05-01", "data", "VZS_E")]
_LEDGER = ", ".join(f"('{a}', '{b}', '{c}', '{s}')" for a, b, c, s in LEDGER)


@R(f"SELECT event_id, CAST(substr(effective_date, 1, 4) AS INTEGER) AS year, type, CASE WHEN sites = '' THEN 0 ELSE len(string_split(sites, '|')) END AS n_sites FROM (VALUES {_LEDGER}) AS t(event_id, effective_date, type, sites) WHERE type IN ('physical', 'policy') AND try_cast(substr(effective_date, 1, 4) AS INTEGER) IS NOT NULL")
def ledger_parse(spark: SparkSession, d: str) -> DataFrame:
    """S20."""
    x = files.ledger(spark.createDataFrame(LEDGER, "event_id string, effective_date string, type string, affected_sites string"))
    return x.select("event_id", "year", "type", F.size("sites").alias("n_sites"))


# --- files: tables written in a form and read back ------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/forms/{uuid4().hex}/{name}"


@R("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS v, 'Zürich ' || s_name AS place FROM supplier")
def csv_semicolon_latin1(spark: SparkSession, d: str) -> DataFrame:
    """Separator `;`, ISO-8859-1."""
    to = _folder(spark, "s")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.concat(F.lit("Zürich "), "s_name").alias("place")).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(to)
    return files.csv(spark, to, "k long, name string, v double, place string", ";", "ISO-8859-1")


@R("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
def csv_plain(spark: SparkSession, d: str) -> DataFrame:
    """A report as one CSV file, read again."""
    to = _folder(spark, "n")
    files.write_report_csv(table(spark, d, "nation"), to)
    return files.csv(spark, to, "k int, name string, r int")


@R("SELECT r_regionkey AS k, r_name AS a, NULL::INTEGER AS b FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def csv_files_united(spark: SparkSession, d: str) -> DataFrame:
    """Files of different columns united by name, types given."""
    one, two = _folder(spark, "r"), _folder(spark, "n")
    table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("a")).write.option("header", True).csv(one)
    table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("b")).write.option("header", True).csv(two)
    return files.csv_union(spark, [(one, "k int, a string"), (two, "k int, b int")])


@R("SELECT n_name AS k0, 'key' AS metric, 'a' AS model, CAST(n_nationkey AS DOUBLE) AS value FROM nation UNION ALL SELECT n_name, 'key', 'b', n_nationkey + 0.5 FROM nation UNION ALL SELECT n_name, 'region', 'a', n_regionkey FROM nation")
def csv_two_headers(spark: SparkSession, d: str) -> DataFrame:
    """Two header lines, metric and model."""
    to = _folder(spark, "t")
    n = table(spark, d, "nation")
    text = n.select(F.lit(1).alias("o"), F.concat_ws(",", "n_name", "n_nationkey", F.col("n_nationkey") + 0.5, "n_regionkey").alias("t"))
    head = spark.createDataFrame([(0, ",key,key,region\nmodel,a,b,a")], "o int, t string")
    head.unionByName(text).repartition(1).sortWithinPartitions("o").select("t").write.text(to)
    return files.csv_two_level(spark, to, 1)


@R("SELECT year, CAST(n AS DOUBLE) AS value FROM (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1)")
def labelled_row(spark: SparkSession, d: str) -> DataFrame:
    """A row found by its label under a row of years, from the cells of a sheet."""
    n = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    col = F.col("year") - 1990
    cell = lambda row, col, text: F.struct(F.lit(row).alias("row"), col.alias("col"), text.cast("string").alias("text"))
    cells = n.select(F.explode(F.array(cell(4, col, F.col("year")), cell(7, col, F.col("n")))).alias("c")).select("c.*")
    names = spark.createDataFrame([(0, 0, "Title"), (4, 0, " Year "), (7, 0, "Orders"), (8, 0, "Orders")], files.CELLS)
    return files.row_by_label(cells.unionByName(names), "Year", "Orders")


@R("WITH n AS (SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) SELECT year, CAST(n AS DOUBLE) AS live, CAST(f AS DOUBLE) AS recorded, 'changed' AS kind FROM n WHERE n <> f AND year > 1995 UNION ALL SELECT year, n, NULL, 'new' FROM n WHERE year = 1995")
def vintage_drift(spark: SparkSession, d: str) -> DataFrame:
    """A live series against a recorded one."""
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"))
    live = o.agg(F.count("*").cast("double").alias("value"))
    recorded = o.agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("value")).where("year > 1995")
    return files.drift(live, recorded)


@R("SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def geojson_points(spark: SparkSession, d: str) -> DataFrame:
    """Point features with properties, degrees turned to metres; a point outside the country fails the
    check and has no row."""
    to = _folder(spark, "g")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (8.3 + F.pmod(F.col("c_custkey") * 7919, F.lit(4000)) / 10000).alias("lon"), (47.2 + F.pmod(F.col("c_custkey") * 104729, F.lit(4000)) / 10000).alias("lat"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("id", "nation")), F.lit(',"geometry":{"type":"Point","coordinates":['), F.col("lon"), F.lit(","), F.col("lat"), F.lit("]}}"))
    # many files of up to some hundred features
    g = c.withColumn("f", feature).groupBy(F.pmod(F.xxhash64("id"), F.lit(64)).alias("k")).agg(F.concat(F.lit('{"features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("t"))
    g.select("t").repartition(64, "t").write.option("maxRecordsPerFile", 1).text(to)
    p = files.geojson_points(spark, to)
    east, north = files.to_swiss(F.col("x"), F.col("y"))
    return p.where(east.between(2.48e6, 2.84e6) & north.between(1.07e6, 1.3e6)).select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["nation"].alias("nation"))


@R("SELECT n_nationkey AS u, n_regionkey + 100 AS v, n_name AS name, (SELECT count(*) FROM nation) AS n_nodes FROM nation")
def graphml_cache(spark: SparkSession, d: str) -> DataFrame:
    """A network written as GraphML and read again."""
    to = _folder(spark, "m")
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name")).alias("data"))
    edges = n.select(F.col("n_nationkey").alias("u"), (F.col("n_regionkey") + 100).alias("v"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("length"), F.lit("1.5")).alias("data"))
    files.write_graphml(nodes, edges, to)
    a, b = files.graphml(spark, to)
    count = a.agg(F.count("*").alias("n_nodes"))
    return b.select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col("data")["name"].alias("name")).crossJoin(F.broadcast(count))  # one row


@R("SELECT o_orderstatus AS status, count(*) * 2 AS n FROM orders GROUP BY 1")
def jsonl_appended(spark: SparkSession, d: str) -> DataFrame:
    """A log appended twice and read."""
    to = _folder(spark, "j")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for _ in range(2):
        files.append_jsonl(o, to)
    return files.jsonl(spark, to, "o_orderkey long, o_orderstatus string").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@R("SELECT r_regionkey AS k, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS doc FROM region")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Columns as a JSON document."""
    return table(spark, d, "region").select(F.col("r_regionkey").alias("k"), files.document(["r_regionkey", "r_name"]).alias("doc"))


@R("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def parquet_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Partitions written by value; a resumed run writes those that are missing."""
    to = _folder(spark, "p")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    wanted = sorted(r["year"] for r in o.select("year").distinct().collect())  # one a year
    files.write_parquet(o.where(F.col("year").isin(wanted[:2])), to, ["year"])
    for y in files.missing_parts(spark, to, "year", wanted):
        files.write_parquet(o.where(F.col("year") == y), to, ["year"])
    return spark.read.parquet(to).groupBy("year").agg(F.count("*").alias("n"))


@R("SELECT r_regionkey + 2 AS line, '| ' || r_regionkey || ' | ' || r_name || ' |' AS text FROM region UNION ALL SELECT 0, '| r_regionkey | r_name |' UNION ALL SELECT 1, '|---|---|'")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A report as a Markdown table, line by line."""
    text = files.markdown(table(spark, d, "region").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


@R("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def nested_log(spark: SparkSession, d: str) -> DataFrame:
    """Typed fields of JSON documents."""
    x = table(spark, d, "events").select("event_type", F.from_json("props", "struct<k:bigint>").alias("p"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


def table_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Size and hash of the star schema's small files."""
    return files.manifest(spark, d, "{region,nation,supplier,customer}.parquet").select("name", "bytes", "sha256")


R()(table_manifest)


@R("SELECT row_id, CASE WHEN quality_flags = '' THEN 0 ELSE len(string_split(quality_flags, '|')) END AS n_flags, contains(quality_flags, 'partial_hour') AS is_partial FROM counts_hourly")
def flag_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The flag text as an array."""
    a = F.filter(F.split("quality_flags", r"\|"), lambda x: x != "")
    return table(spark, d, "counts_hourly").select("row_id", F.size(a).alias("n_flags"), F.array_contains(a, "partial_hour").alias("is_partial"))


@R("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 ELSE -9 END AS rank FROM orders")
def dictionary_mapping(spark: SparkSession, d: str) -> DataFrame:
    """P10: lookup with a default."""
    return table(spark, d, "orders").select("o_orderkey", network.lookup(F.col("o_orderpriority"), {"1-URGENT": 5, "2-HIGH": 4}, -9).alias("rank"))


# Ways of all classes and lane tags, told from the parts: what a way table would hold.
_CLASS = ["motorway", *network.ROAD_RANK]
_TAGS = [("cycleway", "lane"), ("cycleway:left", "no"), ("cycleway:right", "opposite_lane"), ("cycleway:both", "separate"), ("bicycle", "designated"), ("oneway:bicycle", "no"), ("surface", "asphalt")]


def ways(spark: SparkSession, d: str) -> DataFrame:
    """way, tags: a class by the part's key and one more tag by its size."""
    k, z = F.pmod("p_partkey", F.lit(len(_CLASS))), F.pmod("p_size", F.lit(len(_TAGS)))
    at = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    tags = F.map_from_arrays(F.array(F.lit("highway"), at([t for t, _ in _TAGS], z)), F.array(at(_CLASS, k), at([v for _, v in _TAGS], z)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("way"), tags.alias("tags"))


_RANKS = ", ".join(f"({k}, '{c}')" for k, c in enumerate(_CLASS))
_KINDS = ", ".join(f"({k}, '{t}', '{v}')" for k, (t, v) in enumerate(_TAGS))


@R(f"""WITH w AS (SELECT p_partkey AS way, c.name, t.tag, t.val FROM part JOIN (VALUES {_RANKS}) c(k, name) ON c.k = p_partkey % {len(_CLASS)} JOIN (VALUES {_KINDS}) t(k, tag, val) ON t.k = p_size % {len(_TAGS)})
SELECT way, name = 'cycleway' OR (tag = 'bicycle' AND val = 'designated') OR (tag LIKE 'cycleway%' AND val NOT IN ('', 'no', 'none', 'nan', 'separate', 'shared_lane')) AS facility,
  (tag = 'oneway:bicycle' AND val = 'no') OR (tag IN ('cycleway', 'cycleway:left', 'cycleway:right') AND val LIKE 'opposite%') AS contraflow,
  CASE WHEN name LIKE 'trunk%' THEN 5 WHEN name LIKE 'primary%' THEN 4 WHEN name LIKE 'secondary%' THEN 3 WHEN name LIKE 'tertiary%' THEN 2 WHEN name IN ('unclassified', 'residential') THEN 1 WHEN name IN ('motorway', 'living_street', 'service') THEN 0 ELSE -1 END AS rank FROM w""")
def facility_flags(spark: SparkSession, d: str) -> DataFrame:
    """P10: facility, contraflow and road rank of tagged ways."""
    tags = F.col("tags")
    rank = network.lookup(tags["highway"], network.ROAD_RANK, network.OTHER_ROAD)
    return ways(spark, d).select("way", network.tagged(tags, network.FACILITY).alias("facility"), network.tagged(tags, network.TWO_WAY).alias("contraflow"), rank.alias("rank"))


@R(f"WITH {index._VAR_SQL} SELECT 'index.' || CAST(year AS VARCHAR) AS key, '×' || printf('%.2f', median_of_site_means_raw / 100) AS value FROM ix")
def summary_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The flat number table of a report."""
    sy = panel.site_years(index.daily(spark, d), 1).groupBy("year").agg(F.median("raw").alias("m"))
    x = panel.rebased(sy, ["m"], index.BASE)
    return reporting.numbers(x, "index", "year", reporting.times(F.col("m") / 100))


@R("SELECT r_name AS id, 'region ' || CAST(r_regionkey AS VARCHAR) || ' is ' || r_name AS text, 0 AS n_unknown FROM region")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    """Slots filled from a key/value table, unknown keys reported."""
    r = table(spark, d, "region")
    slot = lambda k: F.concat(F.lit("{{"), F.col("r_name"), F.lit(f".{k}}}}}"))
    t = r.select(F.col("r_name").alias("id"), F.concat(F.lit("region "), slot("key"), F.lit(" is "), slot("name")).alias("text"))
    v = r.select(F.concat("r_name", F.lit(".key")).alias("key"), F.col("r_regionkey").cast("string").alias("value")).unionByName(r.select(F.concat("r_name", F.lit(".name")).alias("key"), F.col("r_name").alias("value")))
    return reporting.filled(t, v).select("id", "text", F.size("unknown").alias("n_unknown"))

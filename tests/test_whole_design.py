"""Models of held-out sites: all site-hours that have a neighbour train and test them, whatever their number."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from countweave.operators import glm, reconstruct
from countweave.plans import geo, recon

N, HOURS = 8, 40


@pytest.fixture
def design(spark, monkeypatch):
    """Rows handed to the models, of sites that all see each other in all hours; MOST_ROWS once capped them."""
    r = random.Random(6)
    start = datetime(2022, 3, 1)
    c = spark.createDataFrame([(f"s{i}", start + timedelta(hours=h), float(r.randrange(40))) for i in range(N) for h in range(HOURS)], "site string, ts timestamp_ntz, y double").withColumn("block", reconstruct.hour_block("ts"))
    at = spark.createDataFrame([(f"s{i}", r.uniform(0, 900), r.uniform(0, 900)) for i in range(N)], "id string, x double, y double")
    monkeypatch.setattr(recon, "counts", lambda spark, d: c)
    monkeypatch.setattr(geo, "sites", lambda spark, d: at)
    monkeypatch.setattr(recon, "_places", lambda spark, d: c.select("site", "block").distinct().join(at.withColumnRenamed("id", "site"), "site"))
    monkeypatch.setattr(recon, "MOST_ROWS", 50, raising=False)
    rows = []
    monkeypatch.setattr(recon, "cut", lambda df: rows.append(df) or df)
    return rows


def held_out(rows):
    return {r["site"]: r["count"] for r in rows.where(F.pmod(F.xxhash64("site"), F.lit(4)) == 0).groupBy("site").count().collect()}


def test_alpha_grid_takes_all_site_hours(spark, design):
    r = entry.queries()["alpha_grid"](spark, "").collect()
    assert sorted(x["alpha"] for x in r) == [1e-4, 1e-3, 1e-2] and all(x["mae"] > 0 for x in r)
    rows = design[0].collect()
    place = {x["id"]: ((x["x"] - 2_683_000) / 5000, (x["y"] - 1_248_000) / 5000) for x in geo.sites(spark, "").collect()}
    assert len(rows) == N * HOURS and all((x["x_km5"], x["y_km5"]) == pytest.approx(place[x["site"]]) for x in rows)


@pytest.mark.parametrize("name", ["gradient_boosting", "ridge_poisson"])
def test_all_held_out_site_hours_are_scored(spark, design, name):
    r = {x["site"]: x["n"] for x in entry.queries()[name](spark, "").collect()}
    assert design[0].count() == N * HOURS and r == held_out(design[0])


def test_ridges_are_those_of_sparks_regression(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    r = random.Random(3)
    x = [(f"s{i % 9}", a := r.gauss(0, 1), 40 + 9 * r.random() + a, 0.1, float(r.random() < 0.2), float(int(r.expovariate(1) * 8 * 2.7 ** (0.4 * a))), i % 9 in (2, 5)) for i in range(700)]
    rows = spark.createDataFrame(x, "site string, a double, b double, same double, c double, y double, is_val boolean").repartition(5)
    columns, alphas = ["a", "b", "same", "c"], [1e-4, 1e-2, 1.0]
    got = {row["site"]: row for row in glm.ridges(rows, columns, alphas).collect()}
    for i, alpha in enumerate(alphas):
        p = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", featuresCol="features", regParam=alpha)])
        want = glm._scored(p.fit(rows.where("NOT is_val")), rows.where("is_val"), F.col("prediction")).collect()
        assert {w["site"] for w in want} == got.keys() == {"s2", "s5"}
        for w in want:
            assert (got[w["site"]][f"mae{i}"], got[w["site"]]["n"]) == (pytest.approx(w["mae"], rel=1e-6), w["n"])


def test_ridges_without_training_rows_say_nothing(spark):
    rows = spark.createDataFrame([("s", 1.0, 2.0, True)], "site string, a double, y double, is_val boolean")
    assert [tuple(r) for r in glm.ridges(rows, ["a"], [0.1]).collect()] == [("s", 1, None)]

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countweave.functions import calendar as cal
from countweave.operators import anomalies, bootstrap, glm, metrics, network, panel, quality, reconstruct, reporting, rollup, spatial, weather
from countweave.sources import files


def quarters(spark, rows):
    return spark.createDataFrame(rows, "standort_id int, ts timestamp_ntz, raw_in int, raw_out int")


def test_hourly_completeness_and_autumn(spark):
    t = datetime(2021, 10, 31, 2)
    rows = [(1, datetime(2021, 5, 1, 8, m), 2, 1) for m in (0, 15, 30, 45)] + [(1, datetime(2021, 5, 1, 9, m), 1, 1) for m in (0, 15, 30)]
    rows += [(1, t + timedelta(minutes=m), 1, 1) for m in (0, 15, 30, 45)] * 2 + [(1, datetime(2021, 5, 1, 10, m), None, 1) for m in (0, 15, 30, 45)]
    rows += [(2, datetime(2021, 5, 1, 8, m), 3, None) for m in (0, 15, 30)] + [(2, datetime(2021, 5, 1, 8, 45), 3, 9)]
    got = {(r["standort_id"], r["ts_local"]): r for r in rollup.hourly(quarters(spark, rows)).collect()}
    full, part, repeat, null = (got[(1, x)] for x in (datetime(2021, 5, 1, 8), datetime(2021, 5, 1, 9), t, datetime(2021, 5, 1, 10)))
    assert full["raw_total"] == 12 and full["complete"] and part["completeness"] == 0.75
    assert repeat["dst_ambiguous"] and repeat["complete"] and null["raw_in"] is None and null["raw_total"] is None
    stray = got[(2, datetime(2021, 5, 1, 8))]
    assert not stray["has_out"] and stray["raw_total"] == 12 and stray["raw_out"] == 9


def test_zero_runs(spark):
    h0 = datetime(2021, 1, 1)

    def series(dev, values, gap_at=None):
        return [(dev, h0 + timedelta(hours=i + (1 if gap_at is not None and i >= gap_at else 0)), v) for i, v in enumerate(values)]

    rows = series(1, [5.0] + [0.0] * 47 + [5.0]) + series(2, [5.0] + [0.0] * 48 + [5.0]) + series(3, [0.0] * 48, gap_at=20) + series(4, [0.0] * 30 + [None] + [0.0] * 30)
    h = spark.createDataFrame(rows, "standort_id int, ts_local timestamp_ntz, raw_total double")
    got = {r["standort_id"]: r["n"] for r in rollup.zero_runs(h).groupBy("standort_id").agg(F.count_if("zero_run").alias("n")).collect()}
    assert got == {1: 0, 2: 48, 3: 0, 4: 0}


def test_validity_flags_and_single_direction(spark):
    d = datetime(2021, 1, 10, 15)
    x = spark.createDataFrame([(datetime(2021, 1, 9, 23), d, None), (datetime(2021, 1, 10, 0), d, None), (datetime(2021, 1, 10, 23), None, d), (datetime(2021, 1, 11, 0), None, d)], "ts timestamp_ntz, vf timestamp_ntz, vt timestamp_ntz")
    assert [r[0] for r in x.select(rollup.outside_validity(F.col("ts"), F.col("vf"), F.col("vt"))).collect()] == [True, False, False, True]
    y = spark.createDataFrame([(None,), ("---",), (" ",), ("Nord",)], "d string")
    assert [r[0] for r in y.select(rollup.single_direction(F.col("d"))).collect()] == [True, True, True, False]


def test_spring_skip_round_trip(spark):
    x = spark.sql("SELECT timestamp_ntz'2021-03-28 02:00:00' AS t UNION ALL SELECT timestamp_ntz'2021-10-31 02:00:00'")
    got = x.select(cal.spring_skip(F.col("t")), cal.autumn_repeat(F.col("t")), cal.to_utc(F.col("t"))).collect()
    assert tuple(got[0]) == (True, False, datetime(2021, 3, 28, 1)) and tuple(got[1]) == (False, True, datetime(2021, 10, 31, 0))


def test_interpolation_fills_three_of_every_inner_gap(spark):
    v = [None, 1.0, None, None, 4.0, None, None, None, None, None, 10.0, None]
    df = spark.createDataFrame(list(enumerate(v)), "i int, x double")
    got = [r["x"] for r in weather.interpolated(df, "i", "x").orderBy("i").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None, None, 10.0, None]


def test_last_file_wins_and_holidays(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ts int, x double")
    b = spark.createDataFrame([(2, 9.0, "s")], "ts int, x double, y string")
    assert sorted(map(tuple, weather.last_file_wins([a, b], "ts").collect())) == [(1, 1.0, None), (2, 9.0, "s")]
    school = spark.createDataFrame([(date(2021, 1, 2), date(2021, 1, 4), "Winterferien"), (date(2021, 1, 6), date(2021, 1, 6), "Schulfrei"), (date(2021, 1, 7), date(2021, 1, 5), "other")], "start_day date, end_day date, summary string")
    ph = spark.createDataFrame([(date(2021, 1, 1),)], "day date")
    c = cal.calendar(cal.hour_spine(spark, "2021-01-01 00:00:00", "2021-01-09 00:00:00"), ph, school).where("hour = 8")
    got = {r["ts_local"].day: (r["public_holiday"], r["school_holiday"], r["school_free_day"], r["peak"]) for r in c.collect()}
    assert got[1] == (True, False, False, False) and got[2][1] and got[3][1] and not got[4][1] and got[6] == (False, False, True, True) and not got[7][2] and not got[5][1]


def toy(spark, ratio=2.0):
    rows = []
    for s in range(3):
        for y in (2012, 2024):
            for k in range(28):
                n = (s + 1) * 100 * (ratio if y == 2024 else 1)
                rows.append((f"s{s}", s, date(y, 1, 2) + timedelta(days=k), float(n), float(n), f"s{s}#1", y))
    return spark.createDataFrame(rows, "site_id string, standort_id int, day date, total double, corrected double, coverage_id string, year int")


def test_composition_identity(spark):
    sy = spark.createDataFrame([("a", 2012, 100.0), ("b", 2012, 200.0), ("q", 2012, 50.0), ("a", 2024, 180.0), ("b", 2024, 350.0), ("n", 2024, 900.0)], "site_id string, year int, corrected double")
    c = panel.composition(sy, 2012, 2024).collect()[0]
    assert c["all"] == pytest.approx(c["stayers"] * c["mix"]) and c["stayers"] == pytest.approx(530 / 300) and (c["n_leavers"], c["n_entrants"]) == (1, 1)


def test_poisson_closed_form_and_draws(spark):
    d = toy(spark)
    r = {x["year"]: x["ratio"] for x in glm.ratios_to(glm.year_effects(d, "total", "site_id"), 2012).collect()}
    assert r[2024] == pytest.approx(2.0, rel=1e-4)
    x = bootstrap.fixed_panel_draws(d, 2012, 2024, 12, 1)
    s = bootstrap.summarised(x, (1.5, 1.8)).collect()[0]
    assert s["n"] + s["failed"] == 12 and s["n"] >= 9 and s["median"] == pytest.approx(2.0) and s["p_ge_1_8"] == 1.0
    h = glm.robust_index(d, 2012).orderBy("year").collect()
    assert h[1]["adjusted_index"] == pytest.approx(200) and h[1]["ci_lo"] == pytest.approx(200, abs=0.1)


def test_draws_of_sites_and_weeks():
    sites, weeks = np.array(["a", "b", "c"]), np.arange(20)
    site, week = bootstrap.multiplicities(sites, weeks, np.random.default_rng(0))
    assert site.sum() == 3 and week.sum() == 20 and len(site) == 3 and len(week) == 20
    again = bootstrap.multiplicities(sites, weeks, np.random.default_rng(0))
    assert (site == again[0]).all() and (week == again[1]).all()


def test_poisson_fit_of_a_deficient_design_is_nan():
    x = np.column_stack([np.ones(4), np.ones(4)])
    assert np.isnan(glm.poisson_irls(x, np.array([1.0, 2, 3, 4]))).all()


def test_knn_symmetric_nearest_and_weights(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 1000, (12, 2))
    t = [(f"n{i:02}", f"n{j:02}", float(np.hypot(*(p[i] - p[j])))) for i in range(12) for j in range(12)]
    e = {(r["src"], r["dst"]): r["weight"] for r in spatial.knn_edges(spark.createDataFrame(t, "src string, dst string, cost double"), 3, 300.0).collect()}
    assert all((b, a) in e and 0 < w <= 1 for (a, b), w in e.items())
    for i in range(12):
        near = sorted((c, d) for s, d, c in t if s == f"n{i:02}" and d != s)[:3]
        assert all((f"n{i:02}", d) in e for _, d in near)


def test_clusters_hull_and_snap(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 200.0, 0.0), ("d", 900.0, 0.0), ("e", 900.0, 0.0)], "id string, x double, y double")
    got = dict(map(tuple, spatial.cluster_labels(pts, 150.0).collect()))
    assert got == {"a": "a+b+c", "b": "a+b+c", "c": "a+b+c", "d": "d", "e": "e"}
    square = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (5.0, 5.0)], "x double, y double")
    near = spatial.near_hull(spark.createDataFrame([("in", 5.0, 5.0), ("out", 13.0, 5.0), ("far", 40.0, 5.0)], "id string, x double, y double"), spatial.hull(square), 5.0)
    assert dict(map(tuple, near.collect())) == {"in": 0.0, "out": 3.0}
    seg = spark.createDataFrame([("s", 0.0, 0.0, 100.0, 0.0)], "seg_id string, x1 double, y1 double, x2 double, y2 double")
    assert spatial.snap(pts.where("id = 'b'"), seg, 25.0).collect()[0]["dist"] == 0.0


def test_networks(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "d", 1.0)], "u string, v string, cost double")
    t = {(r["source"], r["node"]): r["cost"] for r in network.shortest_paths(e, spark.createDataFrame([("a",)], "node string"), 10.0).collect()}
    assert t == {("a", "a"): 0.0, ("a", "b"): 1.0, ("a", "c"): 2.0, ("a", "d"): 3.0}
    assert {tuple(r) for r in network.bypassed(e, ["b", "c"]).collect()} == {("a", "d", 3.0)}
    s = network.symmetrised(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("a", "c", 4.0)], "src string, dst string, cost double"))
    assert {tuple(r) for r in s.collect()} == {("a", "b", 2.0), ("b", "a", 2.0), ("a", "c", 4.0), ("c", "a", 4.0)}
    adj = network.voronoi_adjacency(e, spark.createDataFrame([("a",), ("d",)], "node string"), 10.0).collect()
    assert [tuple(r) for r in adj] == [("a", "d", 3.0)]


def test_swaps_need_thirty_days_on_each_side(spark):
    d0 = date(2020, 6, 1)
    rows = []
    for site, before, after in (("x", 29, 40), ("y", 30, 30), ("z", 60, 60), ("w", 60, 60)):
        for k in range(1, before + 1):
            rows.append((site, 1, d0 - timedelta(days=k), 99.0))
        for k in range(after):
            rows.append((site, 1, d0 + timedelta(days=k), 199.0 if site == "y" else 99.0))
    daily = spark.createDataFrame(rows, "site_id string, standort_id int, day date, total double")
    sw = spark.createDataFrame([("x", d0), ("y", d0), ("nowhere", d0)], "site_id string, swap date")
    got = {r["site_id"]: (r["testable"], r["step_x"]) for r in anomalies.swap_steps(daily, sw).collect()}
    assert got["x"] == (False, None) and got["nowhere"] == (False, None) and got["y"][0] and got["y"][1] == pytest.approx(2.0)


def test_identical_runs_differ_by_nothing(spark):
    rows = [(f"s{i % 3}", datetime(2021, 1, 1) + timedelta(hours=i), float(i % 7), float(i % 5)) for i in range(1440)]
    r = spark.createDataFrame(rows, "site string, ts timestamp_ntz, y double, pred double")
    week = metrics.weekly_difference(metrics.paired(r, r))
    got = metrics.paired_bootstrap(week, 20, 1).collect()[0]
    assert (got["diff"], got["lo"], got["hi"], got["wins"]) == (0.0, 0.0, 0.0, 0)


def test_split_and_sample_do_not_depend_on_partitioning(spark):
    g = spark.range(40).selectExpr("cast(id as string) AS id", "cast(id % 13 as string) AS label")
    a, b = reconstruct.validation_split(g, 3).collect(), reconstruct.validation_split(g.repartition(7), 3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and sum(r["is_val"] for r in a) == 3
    s = reconstruct.subsample(g, ["id"], 1, 5)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, reconstruct.subsample(g.repartition(5), ["id"], 1, 5).collect()))


def test_audit_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert quality.duplicate_keys(df, ["a", "b"]).collect()[0][0] == 1 and quality.duplicate_keys(df.limit(0), ["a"]).collect()[0][0] == 0
    assert reporting.fill("x {{a.b}}", {"a.b": "1"}) == "x 1"
    with pytest.raises(KeyError):
        reporting.fill("{{nope}}", {})
    t = spark.createDataFrame([(1, "v {{k}} {{z}}"), (2, "plain")], "id int, text string")
    got = {r["id"]: (r["text"], r["unknown"]) for r in reporting.filled(t, spark.createDataFrame([("k", "7")], "key string, value string")).collect()}
    assert got == {1: ("v 7 {{z}}", ["z"]), 2: ("plain", [])}
    assert files.markdown(df.limit(1)).startswith("| a | b |")


def test_file_sources(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_bytes("stamp;temp;ort\n1;2,5;Zürich\n".encode("latin-1"))
    assert files.csv(spark, str(p), "stamp int, temp string, ort string", ";", "ISO-8859-1").collect()[0]["ort"] == "Zürich"
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n3,4\n")
    assert sorted(map(tuple, files.csv_union(spark, [(str(tmp_path / "a.csv"), "x int, y int"), (str(tmp_path / "b.csv"), "x int, z int")]).collect())) == [(1, 2, None), (3, None, 4)]
    (tmp_path / "two.csv").write_text(",mae,mae,rmse\nmodel,idw,gbt,idw\nseason,,,\nwinter,1.5,2.5,3.5\n")
    assert {tuple(r) for r in files.csv_two_level(spark, str(tmp_path / "two.csv"), 1).collect()} == {("winter", "mae", "idw", 1.5), ("winter", "mae", "gbt", 2.5), ("winter", "rmse", "idw", 3.5)}
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"n":"a"},"geometry":{"type":"Point","coordinates":[1.5,2]}}]}')
    assert files.geojson_points(spark, str(tmp_path / "g.json")).collect()[0]["x"] == 1.5
    log = spark.createDataFrame([(1, ["a", "b"], {"t": 1.0})], "fold int, holdout array<string>, params map<string,double>")
    files.append_jsonl(log, str(tmp_path / "log"))
    files.append_jsonl(log, str(tmp_path / "log"))
    assert files.jsonl(spark, str(tmp_path / "log"), "fold int, holdout array<string>, params map<string,double>").count() == 2
    files.write_parquet(log, str(tmp_path / "pq"), ["fold"])
    assert files.missing_parts(spark, str(tmp_path / "pq"), "fold", [1, 2]) == [2]
    (tmp_path / "sheet.csv").write_text("x,,\n Head ,2012,2013,sum\nRow,100.0,104.0,204\nRow,1,2,3\n")
    live = files.row_by_label(files.sheet_cells(spark, str(tmp_path / "sheet.csv")), "Head", "Row")
    assert sorted(map(tuple, live.collect())) == [(2012, 100.0), (2013, 104.0)]
    recorded = spark.createDataFrame([(2012, 100.04), (2013, 105.0), (2014, 110.0)], "year int, value double")
    assert sorted((r["year"], r["kind"]) for r in files.drift(live, recorded).collect()) == [(2013, "changed"), (2014, "gone")]
    assert files.manifest(spark, str(tmp_path), "a.csv").collect()[0]["bytes"] == 8


def test_streaming_rollup(spark, tmp_path):
    from countweave.streaming.rollup import hourly_stream, sink

    rows = [(1, datetime(2021, 1, 1, 8, m), 1, None) for m in (0, 15, 30, 45)] + [(1, datetime(2021, 1, 2), 1, 1)]
    quarters(spark, rows).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("standort_id int, ts timestamp_ntz, raw_in int, raw_out int").parquet(str(tmp_path / "in"))
    q = sink(hourly_stream(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["ts_local"], r["raw_in"], r["n_q_out"]) for r in got] == [(datetime(2021, 1, 1, 8), 4, 0)]

"""Hourly rows from times in several notations, counted by hand."""

from countweave.plans import clean

COLUMNS = "row_id long, FK_STANDORT int, DATUM string, VELO_IN int, VELO_OUT int"


def test_all_readable_rows_count(spark, tmp_path):
    texts = ["2021-05-01T08:00", "2021-05-01 08:15:00", "2021-05-01T06:30:00Z", "2021-05-01T08:45+02:00"]
    rows = [(k, 1, t, 10**k, 1) for k, t in enumerate(texts)] + [(9, 1, "no time", 5, 5), (10, 2, "2021-05-01T06:30:00Z", 3, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/quarter_counts.parquet")
    h = {r["standort_id"]: r for r in clean.hourly_rollup(spark, str(tmp_path)).collect()}
    assert h[1]["ts_local"] == "2021-05-01 08:00:00" and (h[1]["raw_in"], h[1]["n_q_in"], h[1]["raw_total"]) == (1111, 4, 1115) and h[1]["complete"]
    assert h[2]["ts_local"] == "2021-05-01 08:00:00" and h[2]["completeness"] == 0.25
    assert {r[0]: r[1] for r in clean.majority_direction(spark, str(tmp_path)).collect()} == {1: True, 2: False}
    assert {r[0] for r in clean.active_ids(spark, str(tmp_path)).collect()} == {1, 2}

"""What happens before an action: nothing but reading the tables' schemas."""

import os

import pytest

from countweave.plans import catalogue
from countweave.sources import tables

D = os.environ.get("COUNTWEAVE_TESTDATA", "/root/testdata/sf0.001")
LAZY = ["p1_found", "p1_flags", "p2_quantiles", "p2_pieces", "p3_found", "p4_found", "p4_attributes", "p5_found", "p5_grid", "p6_found", "p6_instants", "idw_predict", "neighbour_features", "tau_grid", "metrics_by_group", "prediction_intervals", "week_block_draws", "paired_draws", "decision_by_interval", "poisson_fixed_panel", "adjusted_chain", "anomaly_table"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", LAZY)
def test_no_job_before_an_action(spark, monkeypatch, name):
    schemas = {}

    def known(s, d, table):  # a schema that is given needs no look into the files
        if table not in schemas:
            schemas[table] = s.read.parquet(f"{d}/{table}.parquet").schema
        return s.read.schema(schemas[table]).parquet(f"{d}/{table}.parquet")

    q = catalogue.queries()[name]
    for module in ("clean", "geo", "index", "problems", "recon", "sources"):
        monkeypatch.setattr(f"countweave.plans.{module}.table", known)
    q(spark, D)
    seen = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    q(spark, D)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == seen
    assert tables

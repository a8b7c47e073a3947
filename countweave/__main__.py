"""python -m countweave COMMAND --data DIR --out DIR: runs the queries of a stage and writes them.

Stages: clean, graph, backtest, evaluate, history, audit, claims, problems, all; or `query NAME...`.
Each result becomes DIR/NAME as Parquet (or one CSV with --format csv). `--resume` skips results
that are there.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from countweave.plans import catalogue
from countweave.sources import files

STAGES = {
    "clean": ["hourly_rollup", "observed_mask_flags", "quality_summary", "global_quality", "calendar_features", "gap_interpolation", "cluster_components"],
    "graph": ["knn_edges", "snap_to_edges", "shortest_paths", "voronoi_adjacency", "route_rollup", "conflation", "radius_shares", "spaced_sites"],
    "backtest": ["eligible_sites", "holdout_folds", "validation_split", "idw_predict", "neighbour_features", "tau_grid", "blend_grid", "prediction_intervals", "gradient_boosting", "ridge_poisson"],
    "evaluate": ["metrics_pooled", "metrics_per_site", "metrics_macro", "metrics_by_group", "metrics_wide", "metrics_daily", "interval_coverage", "week_block_draws", "paired_draws", "decision_by_interval", "worst_sites", "corrected_layer"],
    "history": ["stable_panel", "weekend_share", "peak_share", "robust_year_index", "per_site_index"],
    "audit": ["station_audit", "duplicate_keys", "nearest_site"],
    "claims": ["index_variants", "index_rmse_rank", "best_variant", "fixed_panel_members", "per_site_ratio", "unadjusted_ratio", "poisson_fixed_panel", "leave_one_out_panel", "adjusted_chain", "device_swap_scan", "level_jump_scan", "anomaly_variants", "composition_split", "loo_median", "quarterly_relative", "cluster_bootstrap", "chain_bootstrap", "scenarios"],
    "problems": ["p1_found", "p2_quantiles", "p3_found", "p4_attributes", "p5_grid", "p6_instants"],
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="countweave")
    p.add_argument("command", choices=[*STAGES, "all", "query"])
    p.add_argument("names", nargs="*")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    p.add_argument("--resume", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("countweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    q = catalogue.queries()
    names = a.names if a.command == "query" else [n for s in STAGES.values() for n in s] if a.command == "all" else STAGES[a.command]
    for n in names:
        to = os.path.join(a.out, n)
        if a.resume and os.path.exists(os.path.join(to, "_SUCCESS")):
            continue
        df = q[n](spark, a.data)
        (files.write_report_csv if a.format == "csv" else files.write_parquet)(df, to)
        print(n, "->", to)


if __name__ == "__main__":
    main()

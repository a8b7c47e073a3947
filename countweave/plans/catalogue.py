"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from countweave.plans import clean, geo, index, problems, recon, sources

REGISTRIES = [clean.R, index.R, geo.R, recon.R, sources.R]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**problems.queries(), **{k: f for r in REGISTRIES for k, f in r.q.items()}}


def oracle_sql() -> dict[str, str]:
    return {**problems.oracle_sql(), **{k: s for r in REGISTRIES for k, s in r.sql.items()}}

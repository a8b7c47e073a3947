"""Queries of the llm problems (p7 to p9) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from countweave.llm import bpe, mixing, pii
from countweave.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_list"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_list"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_ids, p8_mix, p8_report, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    return {}

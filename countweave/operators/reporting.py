"""Flat number tables and strict template filling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = re.compile(r"\{\{([^{}]+)\}\}")


def times(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"×%.{digits}f", c)


def percent(c: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def numbers(df: DataFrame, prefix: str, key: str, value: Column) -> DataFrame:
    """key, value rows `prefix.<key>`."""
    return df.select(F.concat(F.lit(f"{prefix}."), F.col(key).cast("string")).alias("key"), value.alias("value"))


def fill(text: str, values: dict[str, str]) -> str:
    """Replaces every {{key}}; an unknown key is an error."""
    unknown = sorted({k.strip() for k in SLOT.findall(text)} - set(values))
    if unknown:
        raise KeyError(", ".join(unknown))
    return SLOT.sub(lambda m: values[m[1].strip()], text)


def filled(templates: DataFrame, values: DataFrame) -> DataFrame:
    """id, text with its slots filled, and the keys that are unknown: templates of any number,
    values joined by key."""
    slots = templates.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)))).alias("key"))
    j = slots.join(values, "key", "left").groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "value")))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("key")))).alias("unknown"))
    x = templates.join(j, "id", "left")
    parts = F.map_entries("m")
    done = F.aggregate(parts, F.col("text"), lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))
    return x.select("id", F.coalesce(done, "text").alias("text"), F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))

"""Hourly weather: several files into one series, later files winning, gaps filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_file_wins(files: Sequence[DataFrame], key: str) -> DataFrame:
    """Union by name; of rows with one key the one from the last file is kept."""
    ranked = None
    for i, f in enumerate(files):
        one = f.withColumn("__rank", F.lit(i))
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "__rank")]
    return ranked.groupBy(key).agg(F.max_by(F.struct(*rest), "__rank").alias("r")).select(key, "r.*")


def on_spine(spine: DataFrame, rows: DataFrame, key: str | Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join to the dense spine; `filled` marks hours in which any value is missing."""
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull()
    return spine.join(rows, [key] if isinstance(key, str) else list(key), "left").withColumn("filled", missing)


def interpolated(df: DataFrame, order: str, value: str, limit: int = 3, part: str | None = None) -> DataFrame:
    """value filled linearly inside gaps, at most the first `limit` hours of each; never at the ends.

    `part`, where given, splits the series into independent ones. Without it the series is one
    ordered sequence, as weather of one station is; its length is bounded by the calendar.
    """
    w = Window.partitionBy(part if part else F.lit(0)).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("__i"))
    x = df.withColumn("__i", F.row_number().over(w))
    x = x.withColumn("__p", F.last(at, True).over(back)).withColumn("__n", F.first(at, True).over(ahead)).withColumn("__a", F.last(value, True).over(back)).withColumn("__b", F.first(value, True).over(ahead))
    step = F.col("__i") - F.col("__p")
    line = F.col("__a") + (F.col("__b") - F.col("__a")) * step / (F.col("__n") - F.col("__p"))
    fill = F.when(F.col(value).isNotNull(), F.col(value)).when((step <= limit) & F.col("__n").isNotNull(), line)
    return x.withColumn(value, fill).drop("__i", "__p", "__n", "__a", "__b")

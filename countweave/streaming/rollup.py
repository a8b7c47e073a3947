"""Streaming form of the hourly roll-up: an extension, not part of the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_stream(raw: DataFrame, late: str = "2 hours") -> DataFrame:
    """standort_id, ts, raw_in, raw_out -> hourly sums; rows later than the watermark are dropped,
    as any bounded state must. Append mode emits an hour once the watermark has passed it."""
    r = raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = r.groupBy("standort_id", F.window("ts", "1 hour").alias("w")).agg(F.sum("raw_in").alias("raw_in"), F.sum("raw_out").alias("raw_out"), F.count("raw_in").alias("n_q_in"), F.count("raw_out").alias("n_q_out"))
    return g.select("standort_id", F.col("w.start").cast("timestamp_ntz").alias("ts_local"), "raw_in", "raw_out", "n_q_in", "n_q_out")


def sink(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once through the checkpoint; works off what is there, then ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Attributes as known at event time.

Events and attribute changes are united, sorted by entity and time with changes ahead of
events of the same moment, and the best change so far is carried forward. A change is placed
at the moment it became available: the later of taking effect and being recorded. Among the
changes available, the one with the greatest `rank` wins; a running maximum carries it, so one
pass serves changes that arrive early, late and out of order.

An entity's timeline is cut into calendar buckets that run as separate window groups, so a hot
entity spreads over many tasks: the best change before each bucket (from partial aggregates of
the changes alone) enters it as one row. Window frames from the start to the current row stream
and spill; no group is collected.

Nulls: an event without entity or time knows nothing (-1/null attributes); a change without
entity or effective time never applies, one without recorded time is never known. A null
attribute is a value. Repeated changes and events change nothing; each event yields one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(events: DataFrame, changes: DataFrame, out: Sequence[tuple[str, Column]], bucket: str = "quarter") -> DataFrame:
    """events (`__k` entity, `__t` time, payload) with, for each (name, available) of `out`, the
    struct `__rank` of the best change available by then (`available` null: never).

    changes has `__k` and `__rank`, a struct ordered by preference.
    """
    payload = [c for c in events.columns if c not in ("__k", "__t")]
    names = [n for n, _ in out]
    best = [f"__b_{n}" for n in names]
    kind = changes.schema["__rank"].dataType.simpleString()
    start = lambda c: F.date_trunc(bucket, c).cast("timestamp_ntz")
    none = F.lit(None).cast(kind)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), a.cast("timestamp_ntz").alias("t")) for i, (_, a) in enumerate(out)]))
    moved = changes.select("__k", "__rank", at.alias("a")).where(F.col("a.t").isNotNull() & F.col("__k").isNotNull())
    moved = moved.select("__k", F.col("a.t").alias("__t"), *[F.when(F.col("a.i") == i, F.col("__rank")).alias(b) for i, b in enumerate(best)])
    # state at the start of each bucket that holds events
    touched = events.where(F.col("__t").isNotNull() & F.col("__k").isNotNull()).select("__k", start(F.col("__t")).alias("__bucket")).distinct()
    per = moved.groupBy("__k", start(F.col("__t")).alias("__bucket")).agg(*[F.max(b).alias(b) for b in best])
    timeline = per.withColumn("__has", F.lit(False)).unionByName(touched.select("__k", "__bucket", *[none.alias(b) for b in best], F.lit(True).alias("__has")))
    # one row per bucket that holds events carries the maximum of all earlier buckets
    order = Window.partitionBy("__k").orderBy("__bucket", F.col("__has").desc()).rowsBetween(Window.unboundedPreceding, -1)
    state = timeline.select("__k", "__bucket", "__has", *[F.max(b).over(order).alias(b) for b in best]).where("__has").drop("__has")
    nothing = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in payload]
    rows = events.select("__k", F.col("__t").cast("timestamp_ntz").alias("__t"), start(F.col("__t")).alias("__bucket"), F.lit(2).alias("__p"), *payload, *[none.alias(b) for b in best])
    rows = rows.unionByName(moved.select("__k", "__t", start(F.col("__t")).alias("__bucket"), F.lit(1).alias("__p"), *nothing, *best))
    rows = rows.unionByName(state.select("__k", F.col("__bucket").alias("__t"), "__bucket", F.lit(0).alias("__p"), *nothing, *best))
    known = F.col("__k").isNotNull() & F.col("__t").isNotNull()
    # events that can know nothing are spread out instead of meeting in the null group
    salt = F.when(~known, F.pmod(F.xxhash64("__k", "__t", *payload), F.lit(1024)))
    run = Window.partitionBy("__k", "__bucket", salt).orderBy("__t", "__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.select("__k", "__t", "__p", *payload, *[F.when(known, F.max(b).over(run)).alias(n) for b, n in zip(best, names)])
    return filled.where(F.col("__p") == 2).drop("__p")

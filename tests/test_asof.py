from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from countweave.operators import asof

T0 = datetime(2020, 1, 1)


def best(revs, k, t, limit):
    ok = [r for r in revs if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t and (not limit or (r[2] is not None and r[2] <= t))]
    return max(ok, key=lambda r: (r[1], r[2] or datetime.min, r[3]))[3] if ok else None


def run(spark, events, revs):
    e = spark.createDataFrame(events, "__k int, __t timestamp_ntz, row_id long")
    c = spark.createDataFrame(revs, "__k int, vf timestamp_ntz, rec timestamp_ntz, rev long").where("vf IS NOT NULL").select("__k", F.struct("vf", "rec", "rev").alias("__rank"))
    known = F.when(F.col("__rank.rec").isNotNull(), F.greatest("__rank.vf", "__rank.rec"))
    out = asof.carried(e, c, [("known", known), ("later", F.col("__rank.vf"))], bucket="month").collect()
    return sorted((r["row_id"], r["known"] and r["known"]["rev"], r["later"] and r["later"]["rev"]) for r in out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    when = lambda: T0 + timedelta(hours=int(rng.integers(0, 4000)))
    revs = [(int(rng.integers(0, 5)), when(), None if rng.random() < 0.1 else when(), n) for n in range(80)]
    revs += revs[:5]
    events = [(None if rng.random() < 0.03 else int(rng.integers(0, 6)), None if rng.random() < 0.03 else when(), n) for n in range(600)]
    events += [(r[0], r[1], 1000 + n) for n, r in enumerate(revs[:30])] + [(r[0], r[2], 2000 + n) for n, r in enumerate(revs[:30]) if r[2]]
    want = sorted((i, best(revs, k, t, True), best(revs, k, t, False)) for k, t, i in events)
    assert run(spark, events, revs) == want


def test_empty_sides(spark):
    assert run(spark, [], [(1, T0, T0, 1)]) == []
    assert run(spark, [(1, T0, 7)], []) == [(7, None, None)]
    assert run(spark, [(1, T0, 7), (1, T0, 7)], [(1, T0, T0, 4)]) == [(7, 4, 4), (7, 4, 4)]

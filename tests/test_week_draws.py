"""Week bootstraps against draws by brute force."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from countweave.operators import metrics


def test_week_bootstraps_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("a", "b", "c"):
        for k in range(0, 24 * 140, 7):
            y = float(rng.poisson(30))
            rows += [(m, s, datetime(2022, 1, 3) + timedelta(hours=k), y, y + rng.normal(0, sd)) for m, sd in (("idw", 9.5), ("mean", 10))]
    p = pd.DataFrame(rows, columns=["model", "site", "ts", "y", "pred"])
    df = spark.createDataFrame(p, "model string, site string, ts timestamp_ntz, y double, pred double")
    p["e"], p["week"] = (p["pred"] - p["y"]).abs(), p["ts"].dt.isocalendar()["week"].astype(int)
    w = p.pivot_table(index="week", columns="model", values="e", aggfunc="sum")
    n = p[p["model"] == "idw"].groupby("week").size().to_numpy()
    diff, weeks = (w["idw"] - w["mean"]).to_numpy(), w.index.to_numpy()
    picks = [np.random.default_rng([5, i]).integers(0, len(weeks), len(weeks)) for i in range(300)]
    want = [diff[i].sum() / n[i].sum() for i in picks]
    week = metrics.weekly(df)
    assert len({round(x, 9) for x in want}) > 290
    b = metrics.block_bootstrap(week, "idw", "mean", 300, 5).collect()[0]
    ends = np.quantile(want, [0.025, 0.975])
    assert (b["diff"], b["lo"], b["hi"]) == pytest.approx((diff.sum() / n.sum(), *ends))
    pair = metrics.paired_bootstrap(metrics.weekly_difference(metrics.side_by_side(df, "mean", "idw")), 300, 5).collect()[0]
    assert (pair["lo"], pair["hi"]) == pytest.approx(tuple(ends))
    for hi in (-0.1, 0.1):  # the interval decides, not a site's difference
        got = metrics.decided(metrics.per_site(df), spark.createDataFrame([(hi,)], "hi double"), "idw", "mean").collect()[0]
        site = p.groupby(["site", "model"])["e"].mean().unstack()
        assert got["wins"] == (site["idw"] < site["mean"]).sum() and got["chosen"] == (hi < 0 and site["idw"].mean() < site["mean"].mean() and 2 * got["wins"] >= 3)

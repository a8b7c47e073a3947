from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from countweave.operators import gridding

SCHEMA = "src string, dev int, ts timestamp_ntz, y double, usable boolean"


def index(t):
    return (t - datetime(1970, 1, 1)) // timedelta(hours=1)


def elapsed(t):
    """Hours of elapsed time since 1970, a wall-clock time of the repeated hour being its first pass."""
    return t.replace(tzinfo=ZoneInfo("Europe/Zurich")).timestamp() / 3600


def local_linear(rows, g, reach=2):
    at = elapsed(datetime(1970, 1, 1) + timedelta(hours=g))
    d = np.array([elapsed(t) - at for _, _, t, y, ok in rows if ok and y is not None])
    y = np.array([y for _, _, t, y, ok in rows if ok and y is not None])
    hours = np.floor(d + g + 1e-9) - g
    near = (hours >= -reach) & (hours <= reach - 1)
    d, y = d[near], y[near]
    w = 1 - (d / reach) ** 2
    if w.sum() < 1e-9:
        return None, 0.0
    a, b, c = w.sum(), (w * d).sum(), (w * d * d).sum()
    det = a * c - b * b
    est = (c * (w * y).sum() - b * (w * d * y).sum()) / det if det > 1e-6 * a * a else (w * y).sum() / a
    return est, a * a / (w * w).sum()


@pytest.mark.parametrize("start, n", [(datetime(2021, 1, 30), 250), (datetime(2021, 3, 27, 20), 40), (datetime(2021, 10, 30, 20), 40), (datetime(1961, 3, 1), 30)])
def test_against_direct_fits(spark, monkeypatch, start, n):
    monkeypatch.setattr(gridding, "BLOCK", 7 if n == 40 else 720)  # edges of stretches beside the clock change
    rng = np.random.default_rng(4)
    rows = []
    for dev in (1, 2):
        t = start
        for _ in range(n):
            t += timedelta(minutes=int(rng.choice([5, 30, 60, 61, 200])))
            if (t.month, t.day, t.hour) == (3, 28, 2):
                continue
            rows.append(("s", dev, t + timedelta(microseconds=int(rng.integers(0, 10**6))), None if rng.random() < 0.1 else float(rng.integers(0, 50)), bool(rng.random() < 0.95)))
    got = gridding.hourly_grid(spark.createDataFrame(rows, SCHEMA)).collect()
    for dev in (1, 2):
        mine = [r for r in rows if r[1] == dev]
        hours = [index(r[2]) for r in mine]
        grid = {r["hour"]: r for r in got if r["dev"] == dev}
        assert set(grid) == set(range(min(hours), max(hours) + 1)) - {index(datetime(2021, 3, 28, 2))}
        for g, r in grid.items():
            n = sum(1 for x in mine if x[4] and x[3] is not None and index(x[2]) == g)
            est, sup = local_linear(mine, g)
            assert r["usable"] == n and r["missing"] == (n == 0)
            assert 1 - 1e-9 <= r["here"] <= n + 1e-9 if n else r["here"] == 0
            assert abs(r["support"] - sup) < 1e-6
            assert (est is None) == (r["estimate"] is None) and (est is None or abs(est - r["estimate"]) < 1e-6 * (1 + abs(est)))


def test_spring_hour_nulls_and_empty(spark):
    a, b = datetime(2021, 3, 28, 0, 10), datetime(2021, 3, 28, 4, 0)
    rows = [("s", 1, a, 1.0, True), ("s", 1, b, None, False), ("s", None, a, 1.0, True), ("s", 1, None, 1.0, True), ("s", 2, a, None, False)]
    got = {(r["dev"], gridding_text(r["hour"])): r["missing"] for r in gridding.hourly_grid(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "00"): False, (1, "01"): True, (1, "03"): True, (1, "04"): True, (2, "00"): True}
    assert gridding.hourly_grid(spark.createDataFrame([], SCHEMA)).count() == 0


def test_thresholds(spark):
    rows = [("s", 1, datetime(2021, 5, 1, h, m), 1.0, True) for h, m in ((0, 0), (0, 30), (1, 0), (3, 0), (3, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    missing = lambda **k: sorted(r["hour"] % 24 for r in gridding.hourly_grid(df, **k).where("missing").collect())
    assert missing() == [2] and missing(least_here=1.5) == [1, 2] and missing(least=2.5) == [2, 3]


def gridding_text(h):
    return f"{h % 24:02}"

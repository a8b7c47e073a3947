from datetime import date, datetime, timedelta

import numpy as np

from countweave.operators import intervals

D0 = date(2020, 1, 1)


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        days, top = set(), date(2023, 1, 1)
        open_from = None
        for _, a, b in (r for r in rows if r[0] == k):
            if a is None or (b is not None and b < a):
                continue
            if b is None:
                open_from = min(open_from or a.date(), a.date())
                continue
            d = a.date()
            while d <= b.date():
                days.add(d)
                d += timedelta(1)
        if open_from:
            d = open_from
            while d <= top:
                days.add(d)
                d += timedelta(1)
        runs = []
        for d in sorted(days):
            if runs and runs[-1][1] + timedelta(1) == d:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        for n, (a, b) in enumerate(runs):
            out.append((k, "period", str(a), "open" if open_from and b == top else str(b)))
            if n:
                out.append((k, "gap", str(runs[n - 1][1] + timedelta(1)), str(a - timedelta(1))))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "id int, a timestamp_ntz, b timestamp_ntz")
    df = df.withColumn("e", df.id)  # clashes with the names inside
    return sorted(map(tuple, intervals.periods_and_gaps(df, "id", "a", "b").collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        for _ in range(int(rng.integers(1, 12))):
            a = datetime(2020, 1, 1) + timedelta(hours=int(rng.integers(0, 9000)))
            b = a + timedelta(hours=int(rng.integers(-200, 1500)))
            rows.append((k, None if rng.random() < 0.05 else a, None if rng.random() < 0.06 else b))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    d = datetime(2020, 5, 1)
    assert run(spark, []) == []
    assert run(spark, [(1, None, d), (2, d, d - timedelta(1))]) == []
    assert run(spark, [(None, d, d)]) == [(None, "period", "2020-05-01", "2020-05-01")]
    assert run(spark, [(1, d, d), (1, d + timedelta(1), None)]) == [(1, "period", "2020-05-01", "open")]


def test_any_partitioning_and_pieces(spark, monkeypatch):
    """Lists of many pieces combine to the same, a hot entity among them."""
    rng = np.random.default_rng(9)
    rows = []
    for n in range(1500):
        a = datetime(1960, 1, 1) + timedelta(days=int(rng.integers(0, 12_000)))
        rows.append((int(rng.integers(0, 3)) * int(rng.integers(0, 2)), a, a + timedelta(days=int(rng.integers(0, 9)))))
    df = spark.createDataFrame(rows, "id int, a timestamp_ntz, b timestamp_ntz")
    want = sorted(map(tuple, intervals.periods_and_gaps(df.coalesce(1), "id", "a", "b").collect()), key=str)
    assert want == brute(rows)
    monkeypatch.setattr(intervals, "PIECE", 50)
    monkeypatch.setattr(intervals, "FAN", 3)
    monkeypatch.setattr(intervals, "levels", lambda n: 3)
    assert sorted(map(tuple, intervals.periods_and_gaps(df.repartition(23), "id", "a", "b").collect()), key=str) == want


def test_pairwise_merge():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        group = np.sort(rng.integers(0, 3, n))
        _, group = np.unique(group, return_inverse=True)
        lists = [sorted((int(b), int(b + rng.integers(0, 4))) for b in rng.integers(-40, 40, rng.integers(1, 6))) for _ in range(n)]
        flat = [(k, b, e) for k, one in enumerate(lists) for b, e in one]
        k, b, e = (np.array(x, dtype=np.int64) for x in zip(*flat))
        got = intervals.reduced(group, intervals.joined(k, b, e))
        want = []
        for g in range(group.max() + 1):
            days = sorted({d for i in np.flatnonzero(group == g) for b_, e_ in lists[i] for d in range(b_, e_ + 1)})
            for d in days:
                if want and want[-1][0] == g and want[-1][2] + 1 == d:
                    want[-1][2] = d
                else:
                    want.append([g, d, d])
        assert [list(map(int, r)) for r in zip(*got)] == want

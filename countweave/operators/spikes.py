"""Implausible spikes in measurements: flags per source, relative to that source's own behaviour.

1. Plausibility: the caller's rule marks impossible readings.
2. Stuck values: a reading belongs to a run of `stuck` or more equal consecutive readings.
3. Tails: the readings left are ordinary. Each is held against the median (centre) and the scaled
   median absolute deviation (spread) of its source's *other* ordinary readings; its residual is
   the distance in spreads. Peaks over threshold: the source's residuals above their own upper
   quartile get a generalised Pareto fit, whose cutoff is exceeded with probability `risk`. What
   lies beyond `limit` spreads is no part of the ordinary tail and stays out of the fit. Each
   source's shape is shrunk to no tail weight by its number of peaks.
   A residual above the cutoff is a `tail`: the candidates. `far` is the exact check that may
   follow: more than `limit` spreads off. Nothing ties the cutoff to `limit`.
4. Seasons: `deseasonalised` takes the median of a reading's phase (quarter, hour of the week) off
   its value where the source has enough readings in every phase; elsewhere values stay.

Sources of up to `hot` rows meet in one task each, many at a time: runs, order statistics and fits
are array operations over all of a batch's sources of one size. Larger sources never do:
* their sequence is cut into parts (by `stretch`, and by `fine` into about PART rows) whose runs are
  decided apart; each part gets the last readings ahead of it and the first after it from a table
  of the parts' ends;
* a mergeable rank summary (operators.quantiles) gives the tail fit, weighted by what its tuples
  stand for, and says which few values the medians can depend on; these are counted one by one,
  all others only between them, and the counts give the medians exactly.
At most one source in `hot` rows is of this kind: their list is counted, and small enough to be sent
to all tasks.

Null readings are skipped: never flagged, part of no run. A source whose other readings do not vary
uses the `flat` rule: a reading is a tail, and far, if it differs from them by more than `flat`
(never where flat is null). A source's only ordinary reading is no tail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countweave.functions.partitions import many
from countweave.operators import quantiles

MAD_SCALE = 1.4826  # makes the median absolute deviation of a normal sample its deviation
PART = 20_000  # rows of a part of a hot source's sequence, about
RESULT = ("impossible", "stuck", "residual", "cut", "tail", "far", "flagged")


@dataclass(frozen=True)
class Rules:
    stuck: int = 4
    limit: float = 5.0
    risk: float = 0.01
    flat: Column | float | None = None
    zero_runs_normal: Column | bool = False
    hot: int = 50_000


# --- tail fit ------------------------------------------------------------------------------


def pareto_fit(excess: np.ndarray, weight: np.ndarray | None = None, prior: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of generalised Pareto tails by probability-weighted moments (Hosking and
    Wallis 1987), one fit per row of ascending excesses; entries of weight 0 do not count. The
    shape is shrunk towards 0 as by `prior` further peaks."""
    e = np.atleast_2d(np.asarray(excess, dtype=float))
    w = np.ones_like(e) if weight is None else np.atleast_2d(np.asarray(weight, dtype=float))
    n = w.sum(1)
    some = np.maximum(n, 1)
    b0 = (w * e).sum(1) / some
    # a tuple of weight w stands for w equal peaks, whose places from the top average to this
    above = n[:, None] - np.cumsum(w, 1) + (w - 1) / 2
    b1 = (w * e * above).sum(1) / (some * np.maximum(n - 1, 1))
    wide = b0 > 2 * b1
    shape = np.where(wide & (n > 1), np.clip(2 - b0 / np.where(wide, np.maximum(b0 - 2 * b1, 1e-12), 1.0), -0.5, 0.9), 0.0) * n / (n + prior)
    return shape, np.maximum(b0 * (1 - shape), 1e-12)


def tail_cut(z: np.ndarray, weight: np.ndarray, limit: float, risk: float) -> np.ndarray:
    """Cutoff of each row of ascending residuals with their weights; nan for rows without any."""
    w = np.where(z <= limit, weight, 0.0)
    total = w.sum(1)
    rank = np.cumsum(w, 1)
    at = (rank >= np.ceil(0.75 * total)[:, None]).argmax(1)
    u = z[np.arange(len(z)), at]
    over = (w > 0) & (z > u[:, None])
    peaks = np.where(over, w, 0.0).sum(1)
    shape, scale = pareto_fit(np.where(over, np.where(over, z, 0.0) - u[:, None], 0.0), np.where(over, w, 0.0))
    ratio = risk * total / np.maximum(peaks, 1)
    flat = np.abs(shape) < 1e-9
    grown = np.where(flat, -np.log(np.maximum(ratio, 1e-300)), (np.maximum(ratio, 1e-300) ** -shape - 1) / np.where(flat, 1.0, shape))
    cut = np.where(peaks > 0, u + np.where(ratio < 1, scale * grown, 0.0), np.maximum(u, 1.0))
    return np.where(total > 0, cut, np.nan)


# --- sources of bounded size ----------------------------------------------------------------


def _others(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Median of each row of ascending v without one entry equal to own (same shape)."""
    n = v.shape[1]
    at = lambda k: np.where(own > v[:, k : k + 1], v[:, k : k + 1], v[:, k + 1 : k + 2])
    return at((n - 2) // 2) if n % 2 == 0 else (at((n - 3) // 2) + at((n - 1) // 2)) / 2


def residuals(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sources of one size (rows of ascending v, two or more): each reading's distance from the
    median of the others, their spread, and the residual (inf where only the reading varies, nan
    where nothing does)."""
    centre = _others(v, v)
    d = np.abs(v - centre)
    spread = np.empty_like(v)
    # the centre takes at most three values in a row: with a reading below, in or above the middle
    for k in {0, v.shape[1] // 2, v.shape[1] - 1}:
        c = centre[:, k : k + 1]
        off = np.abs(v - c)
        here = centre == c
        spread[here] = _others(np.sort(off, 1), off)[here]
    spread *= MAD_SCALE
    with np.errstate(divide="ignore", invalid="ignore"):
        return d, spread, d / spread


def _bounds(change: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(change), len(change))


def flag_sources(source: np.ndarray, raw: np.ndarray, x: np.ndarray, impossible: np.ndarray, flat: np.ndarray, normal: np.ndarray, rules: tuple[int, float, float]) -> dict[str, np.ndarray]:
    """Flags of whole sources, in order: source numbers (ascending), readings, values compared."""
    stuck_n, limit, risk = rules
    new = np.r_[True, source[1:] != source[:-1]]
    same = (raw[1:] == raw[:-1]) | (np.isnan(raw[1:]) & np.isnan(raw[:-1]))
    runs = _bounds(new | np.r_[True, ~same])
    stuck = np.repeat(np.diff(runs) >= stuck_n, np.diff(runs)) & ~(normal & (raw == 0))
    own = np.flatnonzero(~impossible & ~stuck & ~np.isnan(x))
    own = own[np.lexsort([x[own], source[own]])]
    residual, cut = np.full(len(raw), np.nan), np.full(len(raw), np.nan)
    tail, far = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(own):
        starts = _bounds(np.r_[True, source[own][1:] != source[own][:-1]])
        sizes = np.diff(starts)
        for n in np.unique(sizes[sizes > 1]):
            at = own[starts[:-1][sizes == n][:, None] + np.arange(n)]
            d, spread, z = residuals(x[at])
            order = np.argsort(np.where(np.isfinite(z), z, np.inf), 1, kind="stable")
            zs = np.take_along_axis(np.where(np.isfinite(z), z, np.inf), order, 1)
            c = np.broadcast_to(tail_cut(zs, np.ones_like(zs), limit, risk)[:, None], z.shape)
            off = (spread == 0) & (d > np.where(np.isnan(flat[at]), np.inf, flat[at]))
            residual[at] = np.where(spread > 0, z, np.nan)
            cut[at], tail[at], far[at] = c, off | ((spread > 0) & (z > c)), off | ((spread > 0) & (z > limit))
    return {"stuck": stuck, "residual": residual, "cut": cut, "tail": tail, "far": far}


def _flag_bounded(df: DataFrame, keys: list[str], order: list[str], value: str, rules: Rules) -> DataFrame:
    """df with its flags; every source has a bounded number of rows and comes whole to one task."""
    keep = [c for c in df.columns if not c.startswith("__")]
    bools, doubles = T.BooleanType(), T.DoubleType()
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, doubles if n in ("residual", "cut") else bools) for n in ("stuck", "residual", "cut", "tail", "far"))])
    names = schema.names
    numbers = (rules.stuck, rules.limit, rules.risk)

    def flags(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first = quantiles._starts([quantiles._codes(t.column(k)) for k in keys])
        source = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
        real = lambda c: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        truth = lambda c: t.column(c).to_numpy(zero_copy_only=False).astype(bool)
        out = flag_sources(source, real("raw"), real(value), truth("__impossible"), real("__flat"), truth("__normal"), numbers)
        cols = [pa.array(a, mask=np.isnan(a)) if a.dtype == float else pa.array(a) for a in out.values()]
        return pa.table([*t.select(keep).columns, *cols], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            last = int(quantiles._starts([quantiles._codes(t.column(k)) for k in keys])[-1])
            if last:
                yield from flags(t.slice(0, last)).to_batches()
                held = t.slice(last).to_batches()
        if held and sum(h.num_rows for h in held):
            yield from flags(pa.Table.from_batches(held)).to_batches()

    return df.repartition(many(df), *keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


# --- hot sources ------------------------------------------------------------------------------


def _same(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _with_neighbours(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """df with `__ahead`, the k values of `raw` before each row's part, and `__after`, the k after it
    (fewer at the ends). Per part at most 2 k values leave its task."""
    part = [*keys, "__part"]
    w = Window.partitionBy(*part)
    item = F.struct(*order, "raw")
    ends = df.select(*part, item.alias("r"), F.row_number().over(w.orderBy(*order)).alias("i"), F.row_number().over(w.orderBy(*[F.desc(c) for c in order])).alias("j")).where((F.col("i") <= k) | (F.col("j") <= k))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= k, F.col("r")))), lambda r: r["raw"])
    ends = ends.groupBy(*part).agg(pick("i").alias("first"), pick("j").alias("last"))
    # k parts on either side hold k values, as none is empty
    s = Window.partitionBy(*keys).orderBy("__part")
    none = F.array().cast("array<double>")
    ahead = F.concat(*[F.coalesce(F.lag("last", i).over(s), none) for i in range(k, 0, -1)])
    after = F.concat(*[F.coalesce(F.lead("first", i).over(s), none) for i in range(1, k + 1)])
    ends = ends.select(*part, ahead.alias("ahead"), after.alias("after"))
    ends = ends.select(*part, F.slice("ahead", F.greatest(F.lit(1), F.size("ahead") - k + 1), k).alias("__ahead"), F.slice("after", 1, k).alias("__after"))
    return df.alias("a").join(ends.alias("b"), _same("a", "b", part), "left").select("a.*", "b.__ahead", "b.__after")


def _in_run(keys: list[str], order: list[str], stuck: int) -> Column:
    """The row belongs to `stuck` or more equal neighbours, across the ends of its part."""
    w = Window.partitionBy(*keys, "__part").orderBy(*order)
    i = F.row_number().over(w)
    j = F.count("*").over(Window.partitionBy(*keys, "__part")) - i
    raw = F.col("raw")
    before = lambda n: F.when(i > n, F.lag(raw, n).over(w)).otherwise(F.get("__ahead", (F.size("__ahead") + i - n - 1).cast("int")))
    behind = lambda n: F.when(j >= n, F.lead(raw, n).over(w)).otherwise(F.get("__after", (F.lit(n) - j - 1).cast("int")))
    equal = lambda c: F.coalesce(c == raw, F.lit(False))
    same = [equal(before(n)) for n in range(stuck - 1, 0, -1)] + [F.lit(True)] + [equal(behind(n)) for n in range(1, stuck)]
    out = F.lit(False)
    for a in range(stuck):
        whole = F.lit(True)
        for x in same[a : a + stuck]:
            whole = whole & x
        out = out | whole
    return out


def _middle(a: Column, n: Column) -> list[Column]:
    """Medians of n values without one below, in and above the middle, from the order statistics a
    of ranks n // 2, n // 2 + 1, n // 2 + 2."""
    odd = n % 2 == 1
    return [F.when(odd, (a[1] + a[2]) / 2).otherwise(a[1]), F.when(odd, (a[0] + a[2]) / 2).otherwise(a[0]), F.when(odd, (a[0] + a[1]) / 2).otherwise(a[0])]


def _left_out(v: Column, a: Column, n: Column) -> Column:
    """0, 1 or 2: v is below, in or above the middle that the order statistics a stand for."""
    odd = n % 2 == 1
    return F.when(odd, F.when(v <= a[0], 0).when(v >= a[2], 2).otherwise(1)).otherwise(F.when(v <= a[0], 0).otherwise(2))


def _middle_ranks(n: int) -> np.ndarray:
    return np.clip(n // 2 + np.arange(3), 1, n)


def _medians(a: np.ndarray, n: int) -> list[float]:
    return [(a[1] + a[2]) / 2, (a[0] + a[2]) / 2, (a[0] + a[1]) / 2] if n % 2 else [a[1], a[0], a[0]]


def needed(s: quantiles.Summary) -> list[float]:
    """Ends of three intervals (ascending, touching or apart) that hold all values which the medians of
    a source and of its distances from them can depend on, by a summary of its values."""
    v, lo, hi, n = s
    k = _middle_ranks(n)
    # how many values are <= x or < x: at most, at least
    most = lambda x, side: np.r_[hi - 1, n][np.searchsorted(v, x, side)]
    least = lambda x, side: np.r_[0, lo][np.searchsorted(v, x, side)]
    a, b = v[max(0, np.searchsorted(hi, k[0], side="right") - 1)], v[min(len(v) - 1, np.searchsorted(lo, k[-1], side="left"))]
    if hi[0] > k[0]:
        a = v[0]
    t = np.unique(np.abs(np.concatenate([v - a, v - b])))
    few = most(b + t, "right") - least(a - t, "left")  # no centre has more values so near
    many_ = least(a + t, "right") - most(b - t, "left")  # each has as many
    short, long = np.flatnonzero(few < k[0]), np.flatnonzero(many_ >= k[-1])
    t0, t1 = (t[short[-1]] if len(short) else 0.0), (t[long[0]] if len(long) else t[-1])
    ends = [a - t1, b - t0, a, b, a + t0, b + t1]
    # rounding of the sums: a hair wider
    pad = 1e-12 * max(abs(x) for x in (*ends, v[0], v[-1]))
    ends = [x - pad if i % 2 == 0 else x + pad for i, x in enumerate(ends)]
    ends[2], ends[4] = max(ends[1], ends[2]), max(ends[3], ends[4])
    return [float(x) for x in np.maximum.accumulate(ends)]


def profile(v: np.ndarray, w: np.ndarray) -> tuple[list[float], list[list[float]]]:
    """Order statistics around the middle of ascending values with weights, and of their distances
    from the three medians that leaving one value out gives."""
    n = int(w.sum())
    at = lambda x, c: x[np.searchsorted(np.cumsum(c), _middle_ranks(n))]
    a = at(v, w)
    out = []
    for c in _medians(a, n):
        d = np.abs(v - c)
        order = np.argsort(d, kind="stable")
        out.append([float(x) for x in at(d[order], w[order])])
    return [float(x) for x in a], out


def _profiles(ordinary: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """keys, n, a, b (order statistics of values and distances, exact) and cut of each source.

    The summary says which values the medians can depend on, a share of the rows of about its error;
    these are counted one by one, all others only between them, and a source's counts meet.
    """
    s = quantiles.summaries(ordinary, keys, "__x", 0.0002)
    limit, risk = rules.limit, rules.risk
    ends = [f"e{i}" for i in range(6)]
    kind = lambda *more: T.StructType([*(ordinary.schema[k] for k in keys), *more])
    real = lambda n: T.StructField(n, T.DoubleType())

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, n, v, lo, hi in pdf[[*keys, "n", "v", "rmin", "rmax"]].itertuples(index=False):
                if n < 2:
                    continue
                v, lo, hi = np.asarray(v), np.asarray(lo), np.asarray(hi)
                w = np.diff(np.r_[0, hi])
                a, b = profile(v, w)
                d = np.abs(v - _medians(a, n)[1])
                order = np.argsort(d, kind="stable")
                spread = MAD_SCALE * _medians(b[1], n)[1]
                cut = tail_cut(d[order][None] / spread, w[order][None].astype(float), limit, risk)[0] if spread > 0 else np.nan
                rows.append((*key, *needed((v, lo, hi, int(n))), float(cut)))
            yield pd.DataFrame(rows, columns=[*keys, *ends, "cut"])

    e = s.mapInPandas(bounds, kind(*map(real, ends), real("cut")))
    j = ordinary.alias("r").join(e.alias("e"), _same("r", "e", keys)).select("r.*", *[f"e.{c}" for c in (*ends, "cut")])
    stands = quantiles.stand_in(F.col("__x"), [F.col(c) for c in ends])
    counts = j.groupBy(*keys, stands.alias("v")).agg(F.count("*").alias("w"), F.first("cut").alias("cut"))

    def exact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        a, b = profile(pdf["v"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame([(*key, int(pdf["w"].sum()), a, b, pdf["cut"].iloc[0])], columns=[*keys, "n", "a", "b", "cut"])

    out = T._parse_datatype_string("n long, a array<double>, b array<array<double>>, cut double").fields
    return counts.groupBy(*keys).applyInPandas(exact, kind(*out))


def _flag_hot(df: DataFrame, keys: list[str], order: list[str], value: str, rules: Rules) -> DataFrame:
    """The same for sources of any size, cut into `__part`s."""
    keep = [c for c in df.columns if not c.startswith("__")]
    run = _in_run(keys, order, rules.stuck) & ~(F.col("__normal") & (F.col("raw") == 0))
    marked = _with_neighbours(df, keys, order, rules.stuck - 1).withColumn("stuck", run).drop("__part", "__ahead", "__after")
    own = ~F.col("__impossible") & ~F.col("stuck") & F.col(value).isNotNull()
    p = _profiles(marked.where(own).select(*keys, F.col(value).cast("double").alias("__x")), keys, rules)
    j = marked.alias("r").join(p.alias("p"), _same("r", "p", keys), "left")
    x, n = F.col(f"r.{value}").cast("double"), F.col("p.n")
    j = j.withColumn("__w", _left_out(x, F.col("p.a"), n))
    j = j.withColumn("__d", F.abs(x - F.get(F.array(*_middle(F.col("p.a"), n)), F.col("__w")))).withColumn("__b", F.get("p.b", F.col("__w")))
    spread = MAD_SCALE * F.get(F.array(*_middle(F.col("__b"), n)), _left_out(F.col("__d"), F.col("__b"), n))
    j = j.withColumn("__s", F.when(own, spread))
    off = (F.col("__s") == 0) & (F.col("__d") > F.col("r.__flat"))
    z = F.when(F.col("__s") > 0, F.col("__d") / F.col("__s"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    cut = F.nanvl(F.when(F.col("__s").isNotNull(), F.col("p.cut")), F.lit(None))
    return j.select(*[F.col(f"r.{c}") for c in keep], F.col("r.stuck"), z.alias("residual"), cut.alias("cut"), (yes(off) | yes(z > cut)).alias("tail"), (yes(off) | yes(z > rules.limit)).alias("far"))


def deseasonalised(df: DataFrame, keys: list[str], phase: Column, value: str, least: int = 8) -> DataFrame:
    """df with `value` less its phase's median, plus the source's: for sources with `least` or more
    values in each of their phases, of which there are at least two. Others stay. A null phase is
    one; null values stay null. Medians come from bounded sketches of relative accuracy 1e-4."""
    x = df.withColumn("__phase", phase)
    per = x.groupBy(*keys, "__phase").agg(F.percentile_approx(value, 0.5, 10_000).alias("__m"), F.count(value).alias("__n"))
    whole = x.groupBy(*keys).agg(F.percentile_approx(value, 0.5, 10_000).alias("__all"))
    full = per.groupBy(*keys).agg((F.min("__n") >= least).alias("__full"), F.count("*").alias("__k")).where("__full AND __k > 1")
    shift = per.alias("a").join(full.alias("b"), _same("a", "b", keys)).join(whole.alias("c"), _same("a", "c", keys)).select("a.*", (F.col("c.__all") - F.col("a.__m")).alias("__shift"))
    j = x.alias("a").join(shift.alias("b"), _same("a", "b", [*keys, "__phase"]), "left")
    return j.select(*[(F.col(f"a.{c}") + F.coalesce("b.__shift", F.lit(0.0))).alias(c) if c == value else F.col(f"a.{c}") for c in df.columns])


def flag(df: DataFrame, keys: list[str], order: list[str], value: str, impossible: Column, rules: Rules = Rules(), stretch: Column | None = None, fine: Column | None = None) -> DataFrame:
    """df's non-null readings with `impossible`, `stuck`, `residual` (spreads off the source's
    other readings), `cut` (the tail cutoff), `tail`, `far` and `flagged` (impossible, stuck or tail).
    Columns of df with these names give way.

    `value` must be on the scale in which readings are compared (log for ratios); it may be
    null where the reading is impossible. `raw`, a column of df, is compared for equality.
    Ties in `order` are broken by the order columns the caller adds. An empty table gives none.
    `stretch` never decreases along `order` (a year, say); `fine` is a whole number that never
    decreases along the rows of one stretch. Both only matter for sources of more than `hot` rows.
    """
    out = [c for c in df.columns if c not in RESULT]
    normal = rules.zero_runs_normal if isinstance(rules.zero_runs_normal, Column) else F.lit(rules.zero_runs_normal)
    flat = rules.flat if isinstance(rules.flat, Column) else F.lit(rules.flat)
    usable = df.where(F.col("raw").isNotNull()).withColumns({"__impossible": F.coalesce(impossible, F.lit(True)), "__flat": flat.cast("double"), "__normal": F.coalesce(normal, F.lit(False)), "__stretch": stretch if stretch is not None else F.lit(0), "__fine": (fine if fine is not None else F.lit(0)).cast("long")})
    usable = usable.select(*out, "__impossible", "__flat", "__normal", "__stretch", "__fine")
    count = usable.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__fine").alias("__lo"), F.max("__fine").alias("__hi"), F.approx_count_distinct("__stretch").alias("__k"))
    hot = F.broadcast(count.where(F.col("__n") > rules.hot))  # at most one in `hot` rows
    cold = usable.alias("r").join(hot.alias("h"), _same("r", "h", keys), "left_anti").drop("__stretch", "__fine")
    wide = F.greatest(F.lit(1.0), (F.col("h.__hi") - F.col("h.__lo") + 1.0) * F.col("h.__k") * PART / F.col("h.__n"))
    part = F.struct("r.__stretch", F.floor((F.col("r.__fine") - F.col("h.__lo")) / wide).alias("f"))
    large = usable.alias("r").join(hot.alias("h"), _same("r", "h", keys)).select("r.*", part.alias("__part")).drop("__stretch", "__fine")
    both = _flag_bounded(cold.withColumn("impossible", F.col("__impossible")), keys, order, value, rules)
    both = both.unionByName(_flag_hot(large.withColumn("impossible", F.col("__impossible")), keys, order, value, rules))
    return both.select(*out, *RESULT[:-1], (F.col("impossible") | F.col("stuck") | F.col("tail")).alias("flagged"))

"""Percentiles of very large numeric columns from mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (value, rmin, rmax): the value's rank
among all n lies in [rmin, rmax]. Summaries of separate pieces merge without another look
at the rows (Greenwald and Khanna 2001, 2004), so pieces may be partitions, days or files.

* Each scan partition summarises its own rows (no shuffle of rows), holding at most
  `buffer` values at a time.
* Summaries merge in a tree of fan-in `FAN`; each level prunes to `width` tuples, which adds
  n / (2 * width) to the rank error, so `width` is set from the wished error and the levels.
* The error returned is the one reached, from the tuples' own intervals: never more than the
  wished `eps * n`, and 0 where nothing had to be pruned (groups of up to `width` values).

Null and NaN values are skipped; a group without any other value yields no row. Group keys
may be null and form their own group. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countweave.functions.partitions import scan_partitions

FAN = 64
SUMMARY = "n long, v array<double>, rmin array<long>, rmax array<long>"

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def of_values(values: np.ndarray) -> Summary:
    """Exact summary of a piece: sorted, equal values folded into one rank interval each."""
    v, counts = np.unique(np.asarray(values, dtype=np.float64), return_counts=True)
    last = np.cumsum(counts)
    first = last - counts + 1
    # a run of equal values needs its first and last rank only
    lo = np.repeat(v, np.where(counts > 1, 2, 1))
    ranks = np.concatenate([[f] if c == 1 else [f, e] for f, e, c in zip(first, last, counts)]) if (counts > 1).any() else first
    ranks = np.asarray(ranks, dtype=np.int64)
    return lo, ranks, ranks.copy(), int(last[-1]) if len(last) else 0


def merge(a: Summary, b: Summary) -> Summary:
    """Summary of the union; no tuple is dropped, so no error is added to the parts' sum."""
    if not a[3]:
        return b
    if not b[3]:
        return a

    def shifted(x: Summary, y: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y[0], x[0], side=side)  # y's tuples that sort before x's
        below = np.concatenate([[0], y[1]])[at]
        above = np.concatenate([y[2] - 1, [y[3]]])[at]
        return x[1] + below, x[2] + above

    lo_a, hi_a = shifted(a, b, "left")
    lo_b, hi_b = shifted(b, a, "right")
    v = np.concatenate([a[0], b[0]])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([lo_a, lo_b])[order], np.concatenate([hi_a, hi_b])[order], a[3] + b[3]


def merge_all(parts: list[Summary]) -> Summary:
    """Pairwise reduction tree."""
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def prune(s: Summary, width: int) -> Summary:
    """At most width + 1 tuples: for each of the evenly spaced ranks the closest tuple."""
    v, lo, hi, n = s
    if len(v) <= width + 1:
        return s
    keep = np.unique(np.concatenate([[0, len(v) - 1], closest(s, np.ceil(np.arange(1, width) * n / width))]))
    return v[keep], lo[keep], hi[keep], n


def closest(s: Summary, ranks: np.ndarray) -> np.ndarray:
    """Index of the tuple whose interval deviates least from each rank."""
    _, lo, hi, _ = s
    # lo and hi are non-decreasing: the least of max(r - lo, hi - r) is where (lo + hi) / 2 crosses r
    at = np.searchsorted(lo + hi, 2 * np.asarray(ranks))
    at = np.clip(at, 0, len(lo) - 1)
    before = np.maximum(at - 1, 0)
    worst = lambda i: np.maximum(ranks - lo[i], hi[i] - ranks)
    return np.where(worst(before) <= worst(at), before, at)


def query(s: Summary, q: float) -> tuple[float, int, int, int]:
    """Value for quantile q, the rank asked for (1-based, ceil(q n)) and its rank interval."""
    r = max(1, math.ceil(q * s[3] - 1e-9))
    i = int(closest(s, np.array([r]))[0])
    return float(s[0][i]), r, int(s[1][i]), int(s[2][i])


def error(s: Summary) -> int:
    """Largest rank error that any query of this summary can have."""
    v, lo, hi, n = s
    if not n:
        return 0
    inner = np.ceil((hi[1:] - lo[:-1]) / 2).max() if len(v) > 1 else 0
    return int(max(inner if (hi > lo).any() or len(v) < n else 0, hi[0] - 1, n - lo[-1]))


def _starts(codes: list[np.ndarray]) -> np.ndarray:
    """First rows of the runs of equal codes, all arrays together."""
    change = np.zeros(len(codes[0]), dtype=bool)
    change[:1] = True
    for c in codes:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _codes(column: pa.Array) -> np.ndarray:
    d = (column if isinstance(column, pa.Array) else column.combine_chunks()).dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _lists(offsets: np.ndarray, *flat: np.ndarray) -> list[pa.Array]:
    o = pa.array(offsets, type=pa.int32())
    return [pa.ListArray.from_arrays(o, pa.array(f)) for f in flat]


def summarise_rows(t: pa.Table, keys: list[str], width: int) -> pa.Table:
    """Pruned summaries of a piece's rows (keys and `__x`, no null): one sort, no loop over groups."""
    codes = [_codes(t.column(k)) for k in keys]
    x = t.column("__x").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.lexsort([x, *codes])
    first = _starts([c[order] for c in codes])
    sizes = np.diff(np.append(first, len(x)))
    group = np.repeat(np.arange(len(first)), sizes)
    rank = np.arange(len(x)) - first[group] + 1
    n = sizes[group]
    # of a large group: the ranks ceil(i n / width), and the first
    cell = (rank * width) // n
    keep = (n <= width) | (rank == 1) | (cell != ((rank - 1) * width) // n)
    rank = rank[keep].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=len(first)))])
    lists = _lists(offsets, x[order][keep], rank, rank)
    head = t.select(keys).take(pa.array(order[first]))
    return pa.table([*head.columns, pa.array(sizes.astype(np.int64)), *lists], names=[*keys, "n", "v", "rmin", "rmax"])


def merge_rows(t: pa.Table, keys: list[str], width: int | None) -> pa.Table:
    """One summary per run of equal keys. Groups of exact summaries merge by one sort together;
    others by the interval merge, one after another."""
    t = t.combine_chunks()
    first = _starts([_codes(t.column(k)) for k in keys])
    bounds = np.append(first, t.num_rows)
    parts = [t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0) for c in ("n", "v", "rmin", "rmax")]
    n = parts[0].to_numpy(zero_copy_only=False)
    at = parts[1].offsets.to_numpy(zero_copy_only=False)
    v, lo, hi = (p.values.to_numpy(zero_copy_only=False) for p in parts[1:])
    total = np.add.reduceat(n, first)
    lengths = np.diff(at)
    exact = np.add.reduceat(lengths, first) == total
    if width:
        exact &= total <= width + 1
    row_group = np.repeat(np.arange(len(first)), np.diff(bounds))
    group = np.repeat(row_group, lengths)
    flat = v[at[0] : at[-1]]
    order = np.lexsort([flat, group])
    group, flat = group[order], flat[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
    rank = np.arange(len(flat)) - start[group] + 1
    vs, los, his, lens = [], [], [], np.diff(start)
    done = 0
    for g in np.flatnonzero(~exact):
        vs.append(flat[start[done] : start[g]]); los.append(rank[start[done] : start[g]]); his.append(los[-1])
        rows = range(bounds[g], bounds[g + 1])
        s = merge_all([(v[at[r] : at[r + 1]], lo[at[r] : at[r + 1]], hi[at[r] : at[r + 1]], int(n[r])) for r in rows])
        s = prune(s, width) if width else s
        vs.append(s[0]); los.append(s[1]); his.append(s[2])
        lens[g] = len(s[0])
        done = g + 1
    vs.append(flat[start[done] :]); los.append(rank[start[done] :]); his.append(los[-1])
    join = lambda xs, kind: np.concatenate(xs).astype(kind)
    lists = _lists(np.concatenate([[0], np.cumsum(lens)]), join(vs, np.float64), join(los, np.int64), join(his, np.int64))
    head = t.select(keys).take(pa.array(first))
    return pa.table([*head.columns, pa.array(total.astype(np.int64)), *lists], names=[*keys, "n", "v", "rmin", "rmax"])


def levels(partitions: int) -> int:
    """Merge levels above the scan for so many partial summaries of one group."""
    return max(1, math.ceil(math.log(max(2, partitions), FAN)))


def width_for(eps: float, n_levels: int) -> int:
    """Tuples to keep so that one pruning per level and one at the scan stay within eps."""
    return math.ceil((n_levels + 1) / (2 * eps))


def summaries(df: DataFrame, keys: Sequence[str], value: str, eps: float = 0.005, buffer: int = 2_000_000) -> DataFrame:
    """One summary per group: keys and SUMMARY. Its rank error is at most eps * n.

    Rows never leave their scan partition; what is shuffled are at most `width` tuples per
    group and partition. A group's summaries meet in one task only FAN at a time.
    """
    keys = list(keys)
    parts = scan_partitions(df)
    n_levels = levels(parts)
    width = width_for(eps, n_levels)
    x = F.col(value).cast("double")
    slim = df.select(*keys, x.alias("__x")).where(x.isNotNull() & ~F.isnan(x))
    schema = T.StructType([*(slim.schema[k] for k in keys), T.StructField("__p", T.LongType()), *T._parse_datatype_string(SUMMARY).fields])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out = summarise_rows(pa.Table.from_batches(held), keys, width)
            out = out.add_column(len(keys), "__p", pa.array(np.full(out.num_rows, pid, dtype=np.int64)))
            yield from out.to_batches(max_chunksize=max(1, 2_000_000 // width))

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= buffer:
                yield from flush()
                held = []
        if held:
            yield from flush()

    out = slim.mapInArrow(partial, schema)
    for level in range(n_levels, 0, -1):
        if level > 1:
            out = out.withColumn("__p", F.floor(F.col("__p") / FAN))
        out = merge_summaries(out, [*keys, "__p"] if level > 1 else keys, width)
    return out


def merge_summaries(df: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Merge rows of summaries by keys; prune to width where given. Day or file pieces included.

    The rows of a key come sorted one after another, so a task holds one key's parts and one
    batch of others at a time.
    """
    keys = list(keys)
    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(SUMMARY).fields])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(_starts([_codes(t.column(k)) for k in keys])[-1])
            held = t.slice(last)
            if last:
                yield from merge_rows(t.slice(0, last), keys, width).to_batches()
        if held is not None and held.num_rows:
            yield from merge_rows(held, keys, width).to_batches()

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)


def read_off(df: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """keys, q, value, n, the rank asked for, its interval and the error bound, per quantile.

    JVM-only: the tuple whose interval deviates least from rank ceil(q n), the first on a tie.
    """
    one = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    r = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9)).cast("long")
    dev = F.transform(F.arrays_zip("v", "rmin", "rmax"), lambda t: F.struct(F.greatest(F.col("rank") - t["rmin"], t["rmax"] - F.col("rank")).alias("e"), t["rmin"].alias("lo"), t["v"].alias("v"), t["rmax"].alias("hi")))
    out = df.select(*keys, "n", "v", "rmin", "rmax", one.alias("q")).withColumn("rank", r).withColumn("b", F.array_min(dev))
    return out.select(*keys, "q", F.col("b.v").alias("value"), "n", "rank", F.col("b.lo").alias("rank_lo"), F.col("b.hi").alias("rank_hi"), F.col("b.e").alias("rank_error"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = (0.5, 0.9, 0.99), eps: float = 0.005) -> DataFrame:
    """Percentiles per group with their rank error; see the module's text."""
    return read_off(summaries(df, keys, value, eps), keys, qs)


def stand_in(x: Column, ends: Sequence[Column]) -> Column:
    """x itself inside the intervals ends[0] ... ends[1], ends[2] ... ends[3] and so on (ascending); outside,
    one value for each stretch between them, which keeps the order of all."""
    out, n = None, len(ends)
    for i in range(0, n, 2):
        left = ends[0] - 1 if i == 0 else (ends[i - 1] + ends[i]) / 2
        out = F.when(x < ends[i], left) if out is None else out.when(x < ends[i], left)
        out = out.when(x <= ends[i + 1], x)
    return out.otherwise(ends[n - 1] + 1)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], eps: float = 0.001, few: bool = False) -> DataFrame:
    """keys, q, value: the interpolated quantile at place q (n - 1) of each group, exactly, for groups of
    any size. A summary brackets the ranks; values inside the brackets (a share of about eps per
    quantile) are counted one by one, all others only between them, and a group's counts meet. `few`:
    there are few groups (models, not sites), so that their brackets, a row each, go to the rows."""
    keys = list(keys)
    m = 2 * len(qs)
    ends = [f"__e{i}" for i in range(m)]
    order = sorted(qs)
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("__x")).where(x.isNotNull() & ~F.isnan(x))
    key_fields = [rows.schema[k] for k in keys]
    limits = T.StructType([*key_fields, *(T.StructField(c, T.DoubleType()) for c in ends)])

    def bounds(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for *key, n, v, lo, hi in pdf[[*keys, "n", "v", "rmin", "rmax"]].itertuples(index=False):
                v, lo, hi = np.asarray(v), np.asarray(lo), np.asarray(hi)
                e: list[float] = []
                for q in order:
                    low = math.floor(q * (n - 1) + 1e-9) + 1
                    under, over = np.searchsorted(hi, low, "right") - 1, np.searchsorted(lo, min(n, low + 1), "left")
                    e += [float(v[max(0, under)]), float(v[min(len(v) - 1, over)])]
                out.append((*key, *np.maximum.accumulate(e)))
            yield pd.DataFrame(out, columns=[*keys, *ends])

    b = summaries(rows, keys, "__x", eps).mapInPandas(bounds, limits)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = rows.alias("r").join((F.broadcast(b) if few else b).alias("b"), on).select("r.*", *[f"b.{c}" for c in ends])
    counts = j.groupBy(*keys, stand_in(F.col("__x"), [F.col(c) for c in ends]).alias("__v")).agg(F.count("*").alias("__w"))

    def read(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("__v")
        v, top = pdf["__v"].to_numpy(), np.cumsum(pdf["__w"].to_numpy())
        out = []
        for q in qs:
            at = q * (top[-1] - 1)
            i = math.floor(at + 1e-9)
            a, c = (v[np.searchsorted(top, min(top[-1], i + d))] for d in (1, 2))
            out.append((*key, q, float(a + (c - a) * max(0.0, at - i))))
        return pd.DataFrame(out, columns=[*keys, "q", "value"])

    result = T.StructType([*key_fields, T.StructField("q", T.DoubleType()), T.StructField("value", T.DoubleType())])
    return counts.groupBy(*keys).applyInPandas(read, result)

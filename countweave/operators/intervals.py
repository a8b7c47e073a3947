"""Overlapping and gapped validity intervals: continuous periods per entity and their gaps.

A mergeable aggregate holds, per entity, the sorted list of disjoint and non-adjacent runs of days.

* Each scan partition builds such lists from its own rows, a bounded piece at a time: rows never
  leave their partition, only lists do.
* Lists combine in a reduction tree: partitions merge in groups of FAN, then groups, and within a
  task two and two. Two lists merge linearly: each knows where its runs fall in the other, one
  sweep over the interleaved runs joins what touches or overlaps. All pairs of a task go through one
  sweep (arrays), whatever their number.

Days are the unit, so an entity's list is bounded by the calendar, never by its rows. Records without
a start, or ending before it, cover nothing; a null end is open. An entity without any usable record
yields no row; a null entity is one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countweave.functions.partitions import scan_partitions
from countweave.operators.quantiles import FAN, _codes, _starts, levels

OPEN = 2**30  # a day number beyond any date: no end
STEP = 2**32  # apart by more than any two days
PIECE = 1_000_000  # rows that a partition folds at a time

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # list number (ascending), first day, last day


def joined(k: np.ndarray, b: np.ndarray, e: np.ndarray) -> Runs:
    """One sweep over runs sorted by (list, first day): what touches or overlaps becomes one run."""
    if not len(k):
        return k, b, e
    top = np.maximum.accumulate(k * STEP + e)  # a later list starts above all that came before
    new = np.r_[True, (k[1:] != k[:-1]) | (k[1:] * STEP + b[1:] > top[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(k)] - 1
    return k[first], b[first], top[last] - k[first] * STEP


def merge(x: Runs, y: Runs) -> Runs:
    """Lists of equal numbers merge in pairs, all at once."""
    a, c = x[0] * STEP + x[1], y[0] * STEP + y[1]
    at_x = np.arange(len(a)) + np.searchsorted(c, a, "left")
    at_y = np.arange(len(c)) + np.searchsorted(a, c, "right")
    out = []
    for u, v in zip(x, y):
        z = np.empty(len(u) + len(v), dtype=np.int64)
        z[at_x], z[at_y] = u, v
        out.append(z)
    return joined(*out)


def reduced(group: np.ndarray, lists: Runs) -> Runs:
    """Lists 0, 1, ... (ascending) of groups (ascending) merged two and two until a group has one; the
    result is numbered by group."""
    k, b, e = lists
    while len(group) > 1 and (group[1:] == group[:-1]).any():
        place = np.arange(len(group)) - np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1][np.cumsum(np.r_[0, group[1:] != group[:-1]])]
        pair = np.cumsum(place % 2 == 0) - 1  # neighbours of a group share a number
        odd = place[k] % 2 == 1
        k, b, e = merge((pair[k[~odd]], b[~odd], e[~odd]), (pair[k[odd]], b[odd], e[odd]))
        group = group[place % 2 == 0]
    return k, b, e


def merged(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """entity, b, e: arrays of the first and last days (since 1970) of its runs, sorted and disjoint."""
    b = F.unix_date(F.to_date(start))
    e = F.coalesce(F.unix_date(F.to_date(end)), F.lit(OPEN))
    rows = df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start)))).select(F.col(entity).alias("entity"), b.alias("b"), e.alias("e"))
    days = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("entity", df.schema[entity].dataType), T.StructField("part", T.LongType()), T.StructField("b", days), T.StructField("e", days)])

    def table(entities: pa.Array, part: np.ndarray, n: int, runs: Runs) -> list[pa.RecordBatch]:
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(runs[0], minlength=n))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in runs[1:]]
        return pa.table([entities, pa.array(part.astype(np.int64)), *lists], names=schema.names).to_batches(max_chunksize=20_000)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()

        def fold(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            code, b, e = _codes(t.column(0)), *(t.column(c).to_numpy().astype(np.int64) for c in ("b", "e"))
            order = np.lexsort([b, code])
            first = _starts([code[order]])
            k = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
            return table(t.column(0).combine_chunks().take(pa.array(order[first])), np.full(len(first), pid), len(first), joined(k, b[order], e[order]))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= PIECE:
                yield from fold(held)
                held = []
        if held and sum(h.num_rows for h in held):
            yield from fold(held)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold(t: pa.Table) -> list[pa.RecordBatch]:
            t = t.combine_chunks()
            part = t.column("part").to_numpy()
            first = _starts([_codes(t.column("entity")), part])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, t.num_rows]))
            b, e = (t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0) for c in ("b", "e"))
            size = np.diff(b.offsets.to_numpy())
            flat = lambda x: x.flatten().to_numpy().astype(np.int64)
            runs = reduced(group, (np.repeat(np.arange(t.num_rows), size), flat(b), flat(e)))
            return table(t.column("entity").combine_chunks().take(pa.array(first)), part[first], len(first), runs)

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(_starts([_codes(t.column("entity")), t.column("part").combine_chunks().to_numpy()])[-1])
            held = t.slice(last)
            if last:
                yield from fold(t.slice(0, last))
        if held is not None and held.num_rows:
            yield from fold(held)

    out = rows.mapInArrow(partial, schema)
    n = levels(scan_partitions(df))
    for level in range(n, 0, -1):
        out = out.withColumn("part", F.floor(F.col("part") / FAN) if level > 1 else F.lit(0).cast("long"))
        out = out.repartition("entity", "part").sortWithinPartitions("entity", "part").mapInArrow(combine, schema)
    return out.select(F.col("entity").alias(entity), "b", "e")


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """entity, kind (`period`, `gap`), day_from, day_to (YYYY-MM-DD; `open` without end)."""
    m = merged(df, entity, start, end)
    n = F.size("b")
    item = lambda kind: lambda b, e: F.struct(F.lit(kind).alias("kind"), b.alias("b"), e.alias("e"))
    periods = F.zip_with("b", "e", item("period"))
    gaps = F.zip_with(F.transform(F.slice("e", 1, F.greatest(n - 1, F.lit(0))), lambda x: x + 1), F.transform(F.slice("b", 2, F.greatest(n - 1, F.lit(0))), lambda x: x - 1), item("gap"))
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    rows = m.select(entity, F.explode(F.concat(periods, gaps)).alias("r"))
    return rows.select(entity, "r.kind", day(F.col("r.b")).alias("day_from"), F.when(F.col("r.e") == OPEN, F.lit("open")).otherwise(day(F.col("r.e"))).alias("day_to"))

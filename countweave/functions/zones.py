"""Zone transition tables: UTC instants at which a zone's offset changes, as plain arrays.

A table is built once per zone on the driver from the installed time zone database, carries
that database's version and travels to the workers with the code that uses it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
CYCLE = 146_097 * 24 * HOUR  # 400 years, whole weeks


@dataclass(frozen=True)
class ZoneTable:
    zone: str
    version: str
    at: np.ndarray  # UTC microseconds of each change, ascending, then a sentinel
    offset: np.ndarray  # microseconds east of UTC: before the first change, after each
    end: int  # where the table ends; the calendar and its rules repeat every 400 years from there

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Wall clock -> UTC, microseconds. In the repeated hour the first pass; in a skipped
        hour the first instant after the skip."""
        ahead = np.maximum(0, -(-(wall - self.end + 1) // CYCLE)) * CYCLE
        return self._to_utc(wall - ahead) + ahead

    def _to_utc(self, wall: np.ndarray) -> np.ndarray:
        bound = self.at[:-1] + np.maximum(self.offset[:-1], self.offset[1:])
        i = np.searchsorted(bound, wall, side="right")
        return np.minimum(wall - self.offset[i], self.at[i])

    def to_wall(self, utc: np.ndarray) -> np.ndarray:
        return utc + self.offset[np.searchsorted(self.at[:-1], utc, side="right")]

    def skipped_hours(self) -> list[int]:
        """Wall-clock hours (hours since 1970-01-01T00:00) that do not exist in full."""
        forward = self.offset[1:] > self.offset[:-1]
        first = (self.at[:-1] + self.offset[:-1])[forward]
        last = (self.at[:-1] + self.offset[1:])[forward]
        return sorted({int(h) for a, b in zip(first, last) if b - a >= HOUR and a % HOUR == 0 for h in range(a // HOUR, b // HOUR)})

    def hours_east(self, hour: Column, slot: int = 1095) -> Column:
        """Offset in hours of a wall-clock hour (hours since 1970-01-01T00), by look-up: time is cut in
        slots in which the offset changes at most once. Hours ahead of 1970 take the first slot's
        offset, hours past the table the last. In the repeated hour the offset of the first pass."""
        bound = (self.at[:-1] + np.maximum(self.offset[:-1], self.offset[1:])) // HOUR
        last = int(bound[-1]) // slot + 1
        change = np.full(last + 1, 2**31 - 1, dtype=np.int64)
        before = np.empty(last + 1, dtype=np.int64)
        for k in range(last + 1):
            i = np.searchsorted(bound, k * slot, side="right")
            before[k] = self.offset[i] // HOUR
            if i < len(bound) and bound[i] < (k + 1) * slot:
                change[k] = bound[i]
                if i + 1 < len(bound) and bound[i + 1] < (k + 1) * slot:
                    return self.hours_east(hour, slot // 2)
        after = np.append(before[1:], self.offset[-1] // HOUR)
        at = F.greatest(F.lit(0), F.least(F.lit(last), F.floor(hour / slot))).cast("int")
        pick = lambda a: F.get(F.split(F.lit(",".join(map(str, a))), ",").cast("array<int>"), at)  # a constant
        return F.when(hour >= pick(change), pick(after)).otherwise(pick(before))


def _version() -> str:
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001
        for p in TZPATH:
            for name in ("+VERSION", "tzdata.zi"):
                try:
                    with open(f"{p}/{name}") as f:
                        return f.readline().strip().lstrip("# version")
                except OSError:
                    continue
        return "unknown"


@lru_cache
def zone_table(zone: str, first: int = 1900, last: int = 2500) -> ZoneTable:
    z = ZoneInfo(zone)
    off = lambda t: z.utcoffset(t.astimezone(z))
    at, offset = [], []
    t, end = datetime(first, 1, 1, tzinfo=UTC), datetime(last, 1, 1, tzinfo=UTC)
    now = off(t)
    offset.append(now)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    while t < end:
        nxt = t + timedelta(days=7)
        if off(nxt) != now:
            lo, hi = 0, 7 * 86_400
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(t + timedelta(seconds=mid)) == now else (lo, mid)
            change = t + timedelta(seconds=hi)
            now = off(change)
            at.append((change - epoch) // timedelta(microseconds=1))
            offset.append(now)
            nxt = change
        t = nxt
    us = [o // timedelta(microseconds=1) for o in offset]
    return ZoneTable(zone, _version(), np.array([*at, 2**62], dtype=np.int64), np.array(us, dtype=np.int64), (end - epoch) // timedelta(microseconds=1))

"""Two-stage cluster bootstraps: sites with replacement, then ISO weeks by multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countweave.operators.glm import Design, absorbed_fit, pattern_columns


def week_of(day: str) -> Column:
    return (F.extract(F.lit("YEAROFWEEK"), F.col(day)) * 100 + F.weekofyear(day)).cast("int")


def week_cells(d: DataFrame, numbers: Sequence[str] = (), factors: Sequence[str] = (), value: str = "total", entity: str = "coverage_id", site: Column | None = None) -> DataFrame:
    """site_id, entity (as hashes), year, week, covariates, s, n: all that a draw needs, condensed once."""
    keys = [(F.xxhash64("site_id") if site is None else site).alias("site_id"), F.xxhash64(entity).alias("entity"), "year", week_of("day").alias("week")]
    return d.groupBy(*keys, *numbers, *factors).agg(F.sum(F.rint(value)).alias("s"), F.count("*").alias("n"))


def multiplicities(sites: np.ndarray, weeks: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One draw: how often each site and each week is taken, both with replacement. Copies of a site
    share the draw's weeks, so their effects are equal and the site's weight stands for them."""
    return np.bincount(rng.choice(len(sites), len(sites)), minlength=len(sites)), np.bincount(rng.choice(len(weeks), len(weeks)), minlength=len(weeks))


class _Panel:
    """Cells of one task, coded; `drawn` gives sums and days of the cells without their week."""

    def __init__(self, pdf: pd.DataFrame, numbers: Sequence[str], factors: Sequence[str]) -> None:
        keys = ["site_id", "entity", "year", *numbers, *factors]
        pdf = pdf.sort_values([*keys, "week"])
        self.cell = pdf.groupby(keys, sort=False).ngroup().to_numpy()
        cells = pdf[keys].drop_duplicates().reset_index(drop=True)
        self.design = Design(cells, numbers, factors)
        self.site, self.sites = pd.factorize(cells["site_id"], sort=True)
        self.week, self.weeks = pd.factorize(pdf["week"], sort=True)
        self.year, self.s, self.n = cells["year"].to_numpy(), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float)

    def drawn(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Copies of each site, and of one copy the sums and the days of each cell."""
        ks, kw = multiplicities(self.sites, self.weeks, rng)
        w = kw[self.week]
        return ks, np.bincount(self.cell, self.s * w, len(self.site)), np.bincount(self.cell, self.n * w, len(self.site))

    def ratio(self, take: np.ndarray, ks: np.ndarray, s: np.ndarray, n: np.ndarray, a: int, b: int) -> float:
        rows = np.flatnonzero(take & (n > 0) & (ks[self.site] > 0))
        k = ks[self.site[rows]]
        try:
            return self.design.ratio(rows, s[rows] * k, n[rows] * k, a, b)
        except np.linalg.LinAlgError:
            return float("nan")


def _draws(cells: DataFrame, n: int, numbers: Sequence[str], factors: Sequence[str], fit, blocks: int = 12) -> DataFrame:
    """draw, ratio: blocks of draws run as separate groups over copies of the condensed cells."""
    per_task = -(-n // blocks)
    copies = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // per_task))).alias("block"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        panel = _Panel(pdf, numbers, factors)
        ids = range(key[0] * per_task, min(n, (key[0] + 1) * per_task))
        return pd.DataFrame({"draw": list(ids), "ratio": [fit(panel, i) for i in ids]})

    return copies.groupBy("block").applyInPandas(work, "draw int, ratio double")


def fixed_panel_draws(d: DataFrame, a: int, b: int, n: int, seed: int, numbers: Sequence[str] = (), factors: Sequence[str] = (), value: str = "total", entity: str = "coverage_id") -> DataFrame:
    def fit(panel: _Panel, i: int) -> float:
        return panel.ratio(np.ones(len(panel.site), bool), *panel.drawn(np.random.default_rng([seed, i])), a, b)

    return _draws(week_cells(d, numbers, factors, value, entity), n, numbers, factors, fit)


LINKS = 32  # partitions of the links of a chain, one or few a task


class _Link:
    """Cells of the years y and y + 1, of sites with days in both, coded for the draws of one link."""

    def __init__(self, pdf: pd.DataFrame, y: int, sites: np.ndarray, weeks: np.ndarray, min_days: int, numbers: Sequence[str], factors: Sequence[str]) -> None:
        names = ["year", *numbers, *factors]
        pdf = pdf.sort_values(["site_id", "week"], ignore_index=True)
        later = (pdf["year"] == y + 1).to_numpy()
        self.least, self.week = min_days, np.searchsorted(weeks, pdf["week"].to_numpy())
        self.local, at = pd.factorize(pdf["site_id"])
        self.sites, self.s, self.n = np.searchsorted(sites, at), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float)
        self.entity, self.entities = pd.factorize(pdf["entity"].to_numpy())
        # days of a site, a year and a week: what decides whether a site takes part
        span = len(weeks)
        key, k = np.unique((self.local * 2 + later) * span + self.week, return_inverse=True)
        self.side, self.side_week, self.side_n = key // span, key % span, np.bincount(k, self.n)
        self.pattern = pdf.groupby(names, sort=False).ngroup().to_numpy()
        p = pdf[names].drop_duplicates(ignore_index=True)
        self.x = np.column_stack([pattern_columns(p, numbers, factors), (p["year"] == y + 1).to_numpy(float)])
        self.start = None
        whole = self.enough(np.ones(span))
        self.any = bool(whole.any())
        if self.any:
            self.start = self.fit(whole.astype(float), np.ones(span))

    def enough(self, kw: np.ndarray) -> np.ndarray:
        """Sites with enough days in both years, weeks taken kw times."""
        return (np.bincount(self.side, self.side_n * kw[self.side_week], 2 * len(self.sites)).reshape(-1, 2) >= self.least).all(1)

    def fit(self, ks: np.ndarray, kw: np.ndarray) -> np.ndarray:
        """Coefficients, the last that of the later year, with the sites taken ks and the weeks kw times."""
        rows = np.flatnonzero((ks > 0)[self.local])
        w = kw[self.week[rows]] * ks[self.local[rows]]
        rows, w = rows[w > 0], w[w > 0]
        e, p, s, shape = self.entity[rows], self.pattern[rows], self.s[rows] * w, (len(self.entities), len(self.x))
        days = np.bincount(e * shape[1] + p, self.n[rows] * w, shape[0] * shape[1]).reshape(shape)
        es, ps = days.any(1), days.any(0)
        try:
            return absorbed_fit(self.x[ps], days[es][:, ps], np.bincount(e, s, shape[0])[es], np.bincount(p, s, shape[1])[ps], 1, start=self.start)
        except np.linalg.LinAlgError:
            return np.full(self.x.shape[1], np.nan)

    def ratio(self, ks: np.ndarray, kw: np.ndarray) -> float:
        k = ks[self.sites] * self.enough(kw)
        return float(np.exp(self.fit(k, kw)[-1])) if k.any() else float("nan")


def chain_draws(d: DataFrame, min_days: int, n: int, seed: int, numbers: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """Product of the links of each draw; nan where a pair of years keeps no site. The links are
    those that the panel itself has, as in `glm.chain`.

    A link is the work of one task: it gets the cells of its two years alone, of sites with days in both,
    and besides the names of all sites and weeks, from which every link takes the same draws."""
    # one exchange by site serves the cells and what years a site has
    by_site = d.withColumn("__s", F.xxhash64("site_id")).repartition("__s").withColumn("__y", F.collect_set("year").over(Window.partitionBy("__s")))
    c = week_cells(by_site, ["__y", *numbers], factors, site=F.col("__s"))
    ends = F.array_compact(F.array(F.when(F.array_contains("__y", F.col("year") + 1), F.col("year")), F.when(F.array_contains("__y", F.col("year") - 1), F.col("year") - 1)))
    c = c.withColumn("from_year", F.explode(ends)).drop("__y")
    c = c.withColumn("part", F.pmod("from_year", F.lit(LINKS)).cast("int")).repartition(LINKS, "part")
    named = d.select(F.explode(F.array(F.struct(F.lit(True).alias("is_site"), F.xxhash64("site_id").alias("name")), F.struct(F.lit(False).alias("is_site"), week_of("day").cast("long").alias("name")))).alias("x")).select("x.*").distinct()
    named = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(LINKS - 1)))).repartition(LINKS, "part")

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sites, weeks = (np.sort(right.loc[right["is_site"] == k, "name"].to_numpy()) for k in (True, False))
        # a panel without links has the product 1
        out = [pd.DataFrame({"draw": range(n), "ratio": 1.0})] if key[0] == 0 and len(right) else [pd.DataFrame({"draw": pd.Series([], dtype=int), "ratio": pd.Series([], dtype=float)})]
        for y, pdf in left.groupby("from_year"):
            link = _Link(pdf, y, sites, weeks, min_days, numbers, factors)
            if link.any:
                out.append(pd.DataFrame({"draw": range(n), "ratio": [link.ratio(*multiplicities(sites, weeks, np.random.default_rng([seed, i]))) for i in range(n)]}))
        return pd.concat(out)

    links = c.groupBy("part").cogroup(named.groupBy("part")).applyInPandas(work, "draw int, ratio double")
    none = F.lit(float("nan"))
    return links.groupBy("draw").agg(F.exp(F.sum(F.log(F.coalesce("ratio", none)))).alias("ratio"))


def summarised(draws: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """n finite, failed, median, 95 % interval and the share of draws at or above each threshold."""
    ok = ~F.isnan("ratio") & F.col("ratio").isNotNull()
    x = F.when(ok, F.col("ratio"))
    return draws.agg(F.count(x).alias("n"), F.count_if(~ok).alias("failed"), F.median(x).alias("median"), F.percentile(x, F.lit(0.025)).alias("lo"), F.percentile(x, F.lit(0.975)).alias("hi"), *[F.avg((x >= t).cast("double")).alias(f"p_ge_{str(t).replace('.', '_')}") for t in thresholds])


def histogram(draws: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n: equal bins of [lo, hi); values outside fall into the outermost."""
    width = (hi - lo) / bins
    i = F.floor(F.round((F.col("ratio") - lo) / width, 6))
    return draws.where("ratio IS NOT NULL").select(F.least(F.lit(bins - 1), F.greatest(F.lit(0), i)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))

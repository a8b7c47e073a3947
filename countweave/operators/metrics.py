"""Errors of predictions: pooled, by site, by group, by day, with block bootstraps and the rule
that picks a model. Rows: model, site, ts, y, pred (observed rows only)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors() -> list[Column]:
    e = F.col("pred") - F.col("y")
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (F.sum(F.abs(e)) / F.greatest(F.sum("y"), F.lit(1e-9))).alias("wape"), F.avg("y").alias("mean_obs")]


def common(rows: DataFrame, models: int) -> DataFrame:
    """Rows of the site-hours that all models have."""
    keys = rows.groupBy("site", "ts").agg(F.countDistinct("model").alias("k")).where(F.col("k") == models).select("site", "ts")
    return rows.join(keys, ["site", "ts"], "left_semi")


def common_rows(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """The same from a table with a column of each model (site, ts, y, ...), one row a site-hour: no join."""
    both = wide.dropna(subset=list(models))
    return both.unpivot(["site", "ts", "y"], list(models), "model", "pred")


def pooled(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(*errors())


def per_site(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model", "site").agg(*errors())


def macro(rows: DataFrame) -> DataFrame:
    """Unweighted means of the sites' errors."""
    return per_site(rows).groupBy("model").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "bias", "wape")], F.count("*").alias("n_sites"))


def by_group(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """dim, value, model and errors, for each of several groupings in one pass."""
    sets = [[d, "model"] for d in dims]
    g = rows.groupingSets(sets, *dims, "model").agg(*errors())
    value = F.coalesce(*dims)
    dim = None
    for d in dims:
        dim = F.when(F.col(d).isNotNull(), d) if dim is None else dim.when(F.col(d).isNotNull(), d)
    return g.select(dim.alias("dim"), value.alias("value"), "model", "n", "mae", "rmse", "bias", "wape", "mean_obs")


def wide(groups: DataFrame, models: Sequence[str]) -> DataFrame:
    return groups.groupBy("dim", "value").pivot("model", list(models)).agg(F.first("mae"))


def daily(rows: DataFrame) -> DataFrame:
    """Errors of day totals, over days with all 24 hours."""
    g = rows.groupBy("model", "site", F.to_date("ts").alias("day")).agg(F.sum("y").alias("y"), F.sum("pred").alias("pred"), F.count("*").alias("h")).where("h = 24")
    return g.groupBy("model").agg(*errors())


def coverage(rows: DataFrame, levels: Sequence[int] = (80, 90)) -> DataFrame:
    return rows.groupBy("model").agg(*[F.avg(F.col("y").between(F.col(f"lo{n}"), F.col(f"hi{n}")).cast("double")).alias(f"cov{n}") for n in levels])


def worst_sites(per: DataFrame, k: int = 5) -> DataFrame:
    """The k sites whose best model errs most."""
    return per.groupBy("site").agg(F.min("mae").alias("best_mae"), F.min_by("model", F.struct(F.round("mae", 9), "model")).alias("model")).orderBy(F.desc("best_mae"), "site").limit(k)


def weekly(rows: DataFrame) -> DataFrame:
    """week (number alone), model, sum of absolute errors and rows: all that a block bootstrap needs."""
    return rows.groupBy(F.weekofyear("ts").alias("week"), "model").agg(F.sum(F.abs(F.col("pred") - F.col("y"))).alias("s"), F.count("*").alias("n"))


def _interval(s: np.ndarray, n: np.ndarray, draws: int, seed: int, rule=None) -> tuple[float, float]:
    """95 % interval of sum(k s) / sum(k n) over draws of weeks with replacement; k is how often a week is
    taken. Each draw has its own seed. `rule`, draw -> k, stands for the random ones in checks."""
    w = len(s)
    k = np.stack([rule(i) if rule else np.bincount(np.random.default_rng([seed, i]).integers(0, w, w), minlength=w) for i in range(draws)])
    with np.errstate(invalid="ignore", divide="ignore"):
        x = (k @ s) / (k @ n)
    return tuple(np.nanquantile(x, [0.025, 0.975])) if np.isfinite(x).any() else (np.nan, np.nan)


def by_rule(weeks: np.ndarray):
    """Multiplicities that SQL computes as well: k = (week * 7 + draw * 13) % 3, draws from 1."""
    return lambda i: (weeks * 7 + (i + 1) * 13) % 3


def block_bootstrap(week: DataFrame, a: str, b: str, draws: int, seed: int, ruled: bool = False) -> DataFrame:
    """model_a, model_b, diff, lo, hi: difference of pooled MAE a - b and its interval over draws of weeks.
    week: `weekly`, at most 53 rows a model, which is what one task holds."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.pivot_table(index="week", columns="model", values="s", aggfunc="sum").reindex(columns=[a, b])
        n = pdf[pdf["model"] == a].groupby("week")["n"].sum().reindex(s.index)
        diff, n = (s[a] - s[b]).fillna(0).to_numpy(float), n.fillna(0).to_numpy(float)
        lo, hi = _interval(diff, n, draws, seed, by_rule(s.index.to_numpy()) if ruled else None)
        return pd.DataFrame({"diff": [diff.sum() / max(n.sum(), 1)], "lo": [lo], "hi": [hi]})

    one = week.groupBy(F.lit(0).alias("all")).applyInPandas(work, "diff double, lo double, hi double").withColumn("__j", F.lit(1))
    # no rows at all still give one of nulls
    one = week.sparkSession.range(1).select(F.lit(1).alias("__j")).join(one, "__j", "left")
    return one.select(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "diff", "lo", "hi")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' rows of one model on the hours both have: site, ts, y, pa, pb."""
    return a.select("site", "ts", "y", F.col("pred").alias("pa")).join(b.select("site", "ts", F.col("pred").alias("pb")), ["site", "ts"])


def side_by_side(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The same from one table of both models: one pass, no join."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("pred")))
    return rows.groupBy("site", "ts").agg(F.max("y").alias("y"), pick(a).alias("pa"), pick(b).alias("pb")).where("pa IS NOT NULL AND pb IS NOT NULL")


def weekly_difference(p: DataFrame) -> DataFrame:
    """site, week, s, n: sums of |error b| - |error a|, all that the paired bootstrap needs."""
    e = F.abs(F.col("pb") - F.col("y")) - F.abs(F.col("pa") - F.col("y"))
    return p.groupBy("site", F.weekofyear("ts").alias("week")).agg(F.sum(e).alias("s"), F.count("*").alias("n"))


def paired_bootstrap(site_week: DataFrame, draws: int, seed: int, ruled: bool = False) -> DataFrame:
    """diff, lo, hi, wins, n_sites: MAE difference of run b minus run a, its weekly-block interval, sites won."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n = pdf["s"].to_numpy(float), pdf["n"].to_numpy(float)
        lo, hi = _interval(s, n, draws, seed, by_rule(pdf["week"].to_numpy()) if ruled else None)
        return pd.DataFrame({"diff": [s.sum() / n.sum()], "lo": [lo], "hi": [hi]})

    week = site_week.groupBy("week").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    ci = week.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: work(pdf.sort_values("week")), "diff double, lo double, hi double")
    wins = site_week.groupBy("site").agg((F.sum("s") / F.sum("n")).alias("m")).agg(F.count_if(F.col("m") < 0).alias("wins"), F.count("*").alias("n_sites"), F.lit(1).alias("__j"))
    return wins.join(ci.withColumn("__j", F.lit(1)), "__j", "left").select("diff", "lo", "hi", "wins", "n_sites")


def chosen(val_better: Column, ci_hi: Column, wins: Column, n_sites: Column) -> Column:
    """Better in validation, interval below zero, wins on at least half of the sites."""
    return val_better & (ci_hi < 0) & (wins * 2 >= n_sites)


def decided(per: DataFrame, hi: DataFrame, a: str, b: str) -> DataFrame:
    """chosen, hi, wins, n_sites: is model a chosen over b, given the upper end (one row) of the
    interval of its pooled MAE less b's."""
    at = lambda m: F.max(F.when(F.col("model") == m, F.col("mae")))
    q = per.groupBy("site").agg(at(a).alias("a"), at(b).alias("b"))
    one = q.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count("*").alias("n_sites"))
    return one.crossJoin(hi).select(chosen(F.col("ma") < F.col("mb"), F.col("hi"), F.col("wins"), F.col("n_sites")).alias("chosen"), "hi", "wins", "n_sites")


def corrected_layer(preds: DataFrame, hourly: DataFrame, factors: DataFrame) -> DataFrame:
    """Predictions with the factor of the device active in that hour; two devices give two rows."""
    on = hourly.select(F.col("site_id").alias("site"), F.col("ts_local").alias("ts"), "standort_id").distinct().join(factors, "standort_id", "left")
    j = preds.join(on, ["site", "ts"], "left")
    return j.withColumn("corrected", F.col("pred") * F.coalesce("cf", F.lit(1.0)))

"""Poisson regressions with fixed effects: year effects beside entities and covariates.

Days are condensed to cells (entity, year, covariates) in the JVM; a fit reads cells alone. Entity
effects are profiled out in closed form, so a fit solves for years and covariates, however many
entities there are; it holds one number per entity and kind of day.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countweave.functions import calendar as cal

COVARIATES = ("temp", "temp2", "log_precip", "sun", "holiday", "school")  # numbers of a day
FACTORS = ("dow", "month")  # its classes
CALENDAR = ("holiday",)  # what is known of every day without a weather or school table


def poisson_irls(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, rounds: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Coefficients of a log-link Poisson fit; nan for all if the design is rank deficient."""
    w = np.ones(len(y)) if w is None else w
    if not len(y) or np.linalg.matrix_rank(x[w > 0]) < x.shape[1]:
        return np.full(x.shape[1], np.nan)
    mu = y + 0.5
    eta, b = np.log(mu), np.zeros(x.shape[1])
    for _ in range(rounds):
        z = eta + (y - mu) / mu
        a = x * (w * mu)[:, None]
        new = np.linalg.solve(x.T @ a, a.T @ z)
        eta = np.clip(x @ new, -30, 30)
        mu = np.exp(eta)
        if np.abs(new - b).max() < tol:
            return new
        b = new
    return b


def dummies(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of all but the first of the sorted distinct values, and those values."""
    levels, i = np.unique(values, return_inverse=True)
    return (i[:, None] == np.arange(1, len(levels))[None, :]).astype(float), levels


def with_days(d: DataFrame, calendar: DataFrame | None = None, weather: DataFrame | None = None) -> DataFrame:
    """d with dow and month of its days and, where given, holiday (and school) and temp, temp2,
    log_precip and sun. Days without a row in a given table drop out."""
    d = d.withColumn("dow", F.weekday("day")).withColumn("month", F.month("day"))
    if calendar is not None:
        d = d.join(calendar.select("day", *[F.col(c).cast("double").alias(c) for c in ("holiday", "school") if c in calendar.columns]), "day")
    if weather is not None:
        d = d.join(weather.select("day", "temp", (F.col("temp") * F.col("temp")).alias("temp2"), F.log1p("precip").alias("log_precip"), "sun"), "day")
    return d


def year_effects(d: DataFrame, value: str, entity: str | None, numbers: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """year, effect (log, against the first year) of one fit over all rows of d, with an effect per entity
    (profiled out, so their number does not matter to the fit) and covariates. Rows alike in all of
    these are condensed to cells first; only cells meet. Nothing runs before an action."""
    y = d.where(F.col(value).isNotNull()).select("year", (F.col(entity) if entity else F.lit("all")).alias("__e"), F.col(value).alias("total"), *numbers, *factors)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, effect, _ = Design(pdf, numbers, factors).fit(np.arange(len(pdf)), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float))
        return pd.DataFrame({"year": levels.astype("int32"), "effect": effect})

    return cells_of(y, "__e", [], numbers, factors).groupBy(F.lit(0).alias("all")).applyInPandas(fit, "year int, effect double")


def ratios_to(effects: DataFrame, base: int) -> DataFrame:
    w = Window.partitionBy(F.lit(0))  # one row a year
    return effects.select("year", F.exp(F.col("effect") - F.max(F.when(F.col("year") == base, F.col("effect"))).over(w)).alias("ratio"))


def pattern_columns(p: pd.DataFrame, numbers: Sequence[str], factors: Sequence[str]) -> np.ndarray:
    """Covariate columns of distinct days: numbers standardised, indicators of factors."""
    cols = [((v - v.mean()) / (v.std() or 1.0))[:, None] for v in (p[c].to_numpy(float) for c in numbers)]
    return np.column_stack(cols + [dummies(p[c].to_numpy())[0] for c in factors]) if numbers or factors else np.zeros((len(p), 0))


def _moments(x: np.ndarray, n: np.ndarray, e: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entity levels, expected sums of patterns, entity means of x and the information within entities."""
    m = n @ e
    a = total / m
    mu = e * (a @ n)
    xbar = (n @ (e[:, None] * x)) / m[:, None]
    return a, mu, xbar, x.T @ (x * mu[:, None]) - (xbar * total[:, None]).T @ xbar


def absorbed_fit(x: np.ndarray, n: np.ndarray, by_entity: np.ndarray, by_pattern: np.ndarray, needed: int, rounds: int = 60, tol: float = 1e-10, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a Poisson fit with an effect per entity, profiled out: the estimate is that of
    the fit with all indicators. x: columns of each pattern (a kind of day); n: days of entity and
    pattern; the sums of counts by entity and by pattern. The last `needed` columns are the ones
    asked for: nan for all if they follow from the others; earlier columns that do are left at 0.
    start: coefficients near the answer, which save rounds."""
    keep = by_entity > 0
    n, by_entity = n[keep], by_entity[keep]
    bad = np.full(x.shape[1], np.nan)
    if not len(n):
        return bad
    g = _moments(x, n, np.ones(len(x)), n.sum(1))[3]
    size = n.sum(0) @ (x * x)
    used = []
    for j in range(x.shape[1]):  # elimination: what is left of a column beside those before it
        if g[j, j] > 1e-9 * max(size[j], 1e-300):
            used.append(j)
            g = g - np.outer(g[:, j], g[j]) / g[j, j]
        elif j >= x.shape[1] - needed:
            return bad
    if not used:
        return np.zeros(x.shape[1])
    x = x[:, used]
    b = start[used] if start is not None and np.isfinite(start).all() else np.zeros(len(used))
    gain = lambda b: by_pattern @ (x @ b) - by_entity @ np.log(n @ np.exp(np.clip(x @ b, -30, 30)))
    at = gain(b)
    for _ in range(rounds):
        _, mu, _, info = _moments(x, n, np.exp(np.clip(x @ b, -30, 30)), by_entity)
        step = np.linalg.solve(info, x.T @ (by_pattern - mu))
        while np.abs(step).max() > tol and gain(b + step) < at - 1e-9 * abs(at):
            step = step / 2
        b = b + step
        at = gain(b)
        if np.abs(step).max() < tol:
            break
    out = np.zeros(len(bad))
    out[used] = b
    return out


def cells_of(d: DataFrame, entity: str, keys: Sequence[str], numbers: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """keys, entity, year, covariates, s, n and the sum of squares q: all a fit needs of days that are alike."""
    y = F.rint("total")
    return d.groupBy(*keys, F.col(entity).alias("entity"), "year", *numbers, *factors).agg(F.sum(y).alias("s"), F.count("*").alias("n"), F.sum(y * y).alias("q"))


class Design:
    """Cells (entity, year, covariates) coded for fits: patterns are the distinct days. Patterns and
    columns are set up once; a fit takes weights of days and sums and the years it may read."""

    def __init__(self, pdf: pd.DataFrame, numbers: Sequence[str], factors: Sequence[str]) -> None:
        names = ["year", *numbers, *factors]
        self.entity, self.entities = pd.factorize(pdf["entity"])
        self.pattern = pdf.groupby(names, sort=False).ngroup().to_numpy()
        p = pdf[names].drop_duplicates().reset_index(drop=True)
        self.years, self.cov = p["year"].to_numpy(), pattern_columns(p, numbers, factors)

    def fit(self, rows: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """years, effects against the first of them, and the fit's parts, over the given rows."""
        ent, e = np.unique(self.entity[rows], return_inverse=True)
        pat, p = np.unique(self.pattern[rows], return_inverse=True)
        yd, levels = dummies(self.years[pat])
        x = np.column_stack([self.cov[pat], yd])
        days = np.bincount(e * len(pat) + p, n, len(ent) * len(pat)).reshape(len(ent), len(pat))
        by_entity = np.bincount(e, s, len(ent))
        b = absorbed_fit(x, days, by_entity, np.bincount(p, s, len(pat)), len(levels) - 1)
        return levels, np.concatenate([[0.0], b[len(b) - len(levels) + 1 :]]), (x, days, by_entity, b, e, p)

    def ratio(self, rows: np.ndarray, s: np.ndarray, n: np.ndarray, a: int, b: int) -> float:
        if not len(rows):
            return float("nan")
        levels, effect, _ = self.fit(rows, s, n)
        if a not in levels or b not in levels:
            return float("nan")
        return float(np.exp(effect[np.searchsorted(levels, b)] - effect[np.searchsorted(levels, a)]))


def panel_ratio(d: DataFrame, a: int, b: int, entity: str = "coverage_id", value: str = "total", numbers: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """ratio: one row, year b over year a over all rows of d."""
    cells = cells_of(d.select("year", F.col(entity).alias("__e"), F.col(value).alias("total"), *numbers, *factors), "__e", [], numbers, factors)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ratio": [Design(pdf, numbers, factors).ratio(np.arange(len(pdf)), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float), a, b)]})

    return cells.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "ratio double")


def leave_one_out(d: DataFrame, a: int, b: int, entity: str = "coverage_id", numbers: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """left_out, ratio: one fit per site over the cells of all others (fixed panels are small)."""
    cells = cells_of(d, entity, ["site_id"], numbers, factors)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, site, s, n = Design(pdf, numbers, factors), pdf["site_id"].to_numpy(), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float)
        out = []
        for left in sorted(set(site)):
            rows = np.flatnonzero(site != left)
            out.append((left, x.ratio(rows, s[rows], n[rows], a, b)))
        return pd.DataFrame(out, columns=["left_out", "ratio"])

    return cells.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "left_out string, ratio double")


def chain(d: DataFrame, min_days: int, numbers: Sequence[str] = (), factors: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """from_year, to_year, n_sites, ratio, cumulative: per pair of consecutive years a fit over the
    sites with enough days in both, with coverage effects. All years from the first to the last with
    any such site are links. One without a site in both years has no ratio, and nothing after it a
    cumulative value; with `strict` it is an error."""
    sy = d.groupBy("site_id", "year").agg(F.count("*").alias("days")).where(F.col("days") >= min_days).select("site_id", "year")
    link = sy.join(sy.select("site_id", (F.col("year") - 1).alias("year")), ["site_id", "year"]).select("site_id", F.col("year").alias("from_year"))
    j = link.join(cells_of(d, "coverage_id", ["site_id"], numbers, factors), "site_id").where(F.col("year").between(F.col("from_year"), F.col("from_year") + 1))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = Design(pdf, numbers, factors).ratio(np.arange(len(pdf)), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float), key[0], key[0] + 1)
        return pd.DataFrame({"from_year": [key[0]], "to_year": [key[0] + 1], "n_sites": [pdf["site_id"].nunique()], "ratio": [r]})

    f = j.groupBy("from_year").applyInPandas(fit, "from_year int, to_year int, n_sites int, ratio double")
    years = sy.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a < b").select(F.explode(F.sequence("a", F.col("b") - 1)).alias("from_year"))
    f = years.join(f, "from_year", "left").select("from_year", (F.col("from_year") + 1).alias("to_year"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.nanvl("ratio", F.lit(None)).alias("ratio"))
    if strict:
        said = F.concat(F.lit("no site in both "), F.col("from_year").cast("string"), F.lit(" and "), F.col("to_year").cast("string"))
        f = f.withColumn("ratio", F.when(F.col("ratio").isNotNull(), F.col("ratio")).otherwise(F.raise_error(said).cast("double")))
    w = Window.partitionBy(F.lit(0)).orderBy("from_year").rowsBetween(Window.unboundedPreceding, 0)  # one row a year
    whole = F.count("ratio").over(w) == F.count("*").over(w)
    return f.withColumn("cumulative", F.when(whole, F.exp(F.sum(F.log("ratio")).over(w))))


def per_site(d: DataFrame, min_days: int, numbers: Sequence[str] = (), factors: Sequence[str] = ()) -> DataFrame:
    """site_id, year, ratio to its first eligible year; coverage effects where there are several."""
    ok = d.groupBy("site_id", "year").agg(F.count("*").alias("k")).where(F.col("k") >= min_days).select("site_id", "year")
    cells = cells_of(d.join(ok, ["site_id", "year"]), "coverage_id", ["site_id"], numbers, factors)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["year"].nunique() < 2:
            return pd.DataFrame({"site_id": [], "year": [], "ratio": []}).astype({"site_id": str, "year": "int32", "ratio": float})
        years, effect, _ = Design(pdf, numbers, factors).fit(np.arange(len(pdf)), pdf["s"].to_numpy(float), pdf["n"].to_numpy(float))
        return pd.DataFrame({"site_id": key[0], "year": years.astype("int32"), "ratio": np.exp(effect)}).dropna()

    return cells.groupBy("site_id").applyInPandas(fit, "site_id string, year int, ratio double")


def robust_index(d: DataFrame, base: int, numbers: Sequence[str] = (), factors: Sequence[str] = (), entity: str = "coverage_id") -> DataFrame:
    """year, index (base 100) and its 95 % interval from the HC1 sandwich covariance.

    The fit is over cells; what the sandwich needs besides, the sum of squared residuals of each
    cell's days, follows from the cell's sums of y and y^2, so days are read once and never held.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, q = (pdf[c].to_numpy(float) for c in ("s", "n", "q"))
        levels, effect, (x, days, by_entity, b, e, p) = Design(pdf, numbers, factors).fit(np.arange(len(pdf)), s, n)
        if not np.isfinite(b).all():
            return pd.DataFrame({"year": [], "adjusted_index": [], "ci_lo": [], "ci_hi": []})
        a, _, xbar, info = _moments(x, days, np.exp(x @ b), by_entity)
        mu = a[e] * np.exp(x @ b)[p]
        r2 = np.maximum(q - 2 * mu * s + n * mu * mu, 0)
        within = x[p] - xbar[e]
        bread = np.linalg.pinv(info, rcond=1e-9, hermitian=True)
        k, total = np.linalg.matrix_rank(bread) + len(days), n.sum()
        cov = bread @ (within.T @ (within * r2[:, None])) @ bread * total / max(total - k, 1)
        i0 = int(np.flatnonzero(levels == base)[0]) if base in levels else 0
        first = x.shape[1] - len(levels)  # column of level i is first + i
        out = []
        for i, lv in enumerate(levels):
            c = np.zeros(x.shape[1])
            if i:
                c[first + i] += 1
            if i0:
                c[first + i0] -= 1
            at, sd = effect[i] - effect[i0], np.sqrt(max(c @ cov @ c, 0.0))
            out.append((int(lv), 100 * np.exp(at), 100 * np.exp(at - 1.96 * sd), 100 * np.exp(at + 1.96 * sd)))
        return pd.DataFrame(out, columns=["year", "adjusted_index", "ci_lo", "ci_hi"])

    return cells_of(d, entity, [], numbers, factors).groupBy(F.lit(0).alias("all")).applyInPandas(fit, "year int, adjusted_index double, ci_lo double, ci_hi double")


FEATURES = ["city", "w180", "m180", "w600", "m600", "anomaly", "near", "near_min", "available"]
PLACE = ["x_km5", "y_km5"]
HOURS = ["weekend", "off", "doy_sin", "doy_cos", "sun_elev"]


def design_columns() -> list[str]:
    """Columns of the held-out models: neighbours, calendar, place and the hours 1 to 23."""
    return [*FEATURES, *HOURS, *PLACE, *[f"hour_{h}" for h in range(1, 24)]]


def with_hours(rows: DataFrame, holidays: DataFrame) -> DataFrame:
    """rows (ts) with the calendar columns of the design."""
    t = F.col("ts")
    waves = cal.day_of_year_waves(t)
    h = F.broadcast(holidays.select(F.col("day").alias("__day"), F.lit(1.0).alias("off")))  # ten days a year
    x = rows.join(h, F.to_date(t) == F.col("__day"), "left").drop("__day").fillna(0.0, ["off"])
    x = x.withColumns({"weekend": (cal.dow(t) >= 5).cast("double"), "doy_sin": waves[0], "doy_cos": waves[1], "sun_elev": cal.solar_elevation(cal.to_utc(t))})
    return x.select("*", *[(F.hour(t) == k).cast("double").alias(f"hour_{k}") for k in range(1, 24)])


def _scored(m, rows: DataFrame, pred) -> DataFrame:
    return m.transform(rows).withColumn("pred", pred).groupBy("site").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"), F.count("*").alias("n"))


def boosted(rows: DataFrame, columns: Sequence[str] = tuple(FEATURES), trees: int = 20, depth: int = 5) -> DataFrame:
    """site, mae, n of held-out sites (is_val) by gradient-boosted trees on log counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = rows.withColumn("__l", F.log1p("y"))
    p = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), GBTRegressor(labelCol="__l", featuresCol="features", maxIter=trees, maxDepth=depth, seed=1)])
    m = p.fit(x.where("NOT is_val"))
    return _scored(m, x.where("is_val"), F.expm1(F.greatest(F.col("prediction"), F.lit(0.0))))


def _gathered(rows: DataFrame, part, merge) -> np.ndarray | None:
    """part(x, y), an array, of all Arrow batches of rows, whose last column is y, merged two and two; None where there are
    no rows. One array leaves a task, and a tree of merges puts them together."""

    def work(batches):
        out = None
        for b in batches:
            if b.num_rows:
                *x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                one = part(np.column_stack(x), y)
                out = one if out is None else merge(out, one)
        if out is not None:
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["a"])

    either = lambda a, b: merge(a, b) if len(a) and len(b) else a if len(a) else b
    got = rows.mapInArrow(work, "a binary").rdd.map(lambda r: np.frombuffer(r[0])).treeAggregate(np.zeros(0), either, either)
    return got if len(got) else None


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of rows and, of each column, mean, sum of squares about it, least and largest value."""
    mean = x.mean(0)
    return np.concatenate([[len(x)], mean, ((x - mean) ** 2).sum(0), x.min(0), x.max(0)])


def _spread_of_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (n, *_), (m, *_) = a, b
    (p, s, lo, hi), (q, t, lo2, hi2) = a[1:].reshape(4, -1), b[1:].reshape(4, -1)
    return np.concatenate([[n + m], p + (q - p) * m / (n + m), s + t + (q - p) ** 2 * n * m / (n + m), np.minimum(lo, lo2), np.maximum(hi, hi2)])


def ridge_coefficients(rows: DataFrame, columns: Sequence[str], alphas: Sequence[float], rounds: int = 25, tol: float = 1e-6) -> np.ndarray | None:
    """Intercept and coefficients (of the columns as they are), a row an alpha, of Poisson regressions with an L2 penalty on
    standardised columns: the steps of Spark's GeneralizedLinearRegression, all alphas in one pass over the rows."""
    x = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("y").cast("double").alias("y"))
    ends = _gathered(x, _spread, _spread_of_both)
    if ends is None:
        return None
    mean, squares, lo, hi = ends[1:].reshape(4, len(columns))
    sd = np.where(hi > lo, np.sqrt(squares / max(ends[0] - 1, 1)), np.inf)  # columns that are constant take no part

    def step(at: np.ndarray | None):
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(y)), (x - mean) / sd])
            out = []
            for b in [None] if at is None else at:
                mu = np.maximum(y, 0.1) if b is None else np.exp(x @ b)
                z = mu * np.log(mu) if b is None else mu * (x @ b) + y - mu
                out.append(np.column_stack([x.T @ (x * mu[:, None]), x.T @ z]).ravel())
            return np.concatenate(out)

        return part

    k = len(columns) + 1
    at, left = None, rounds + 1
    while left:
        m = _gathered(x, step(at), np.add).reshape(-1, k, k + 1)
        penalty = np.diag(np.r_[0.0, np.ones(k - 1)])
        new = np.array([np.linalg.solve(h[:, :k] / h[0, 0] + a * penalty, h[:, k] / h[0, 0]) for a, h in zip(alphas, m if len(m) > 1 else [m[0]] * len(alphas))])
        left = 0 if at is not None and np.abs(new - at).max() < tol else left - 1
        at = new
    b = at[:, 1:] / sd
    return np.column_stack([at[:, 0] - b @ mean, b])


def ridges(rows: DataFrame, columns: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """site, n and mae0, mae1, ... (of each alpha) of held-out sites (is_val) by Poisson regressions on all others."""
    b = ridge_coefficients(rows.where("NOT is_val"), columns, alphas)
    pred = [F.lit(None).cast("double")] * len(alphas) if b is None else [F.exp(sum((F.lit(float(w)) * F.col(c) for w, c in zip(r[1:], columns)), F.lit(float(r[0])))) for r in b]
    return rows.where("is_val").groupBy("site").agg(F.count("*").alias("n"), *[F.avg(F.abs(p - F.col("y"))).alias(f"mae{i}") for i, p in enumerate(pred)])


def ridge(rows: DataFrame, columns: Sequence[str] = tuple(FEATURES), alpha: float = 1e-3) -> DataFrame:
    """site, mae, n of held-out sites by a Poisson regression with an L2 penalty on standardised features."""
    return ridges(rows, columns, [alpha]).select("site", F.col("mae0").alias("mae"), "n")

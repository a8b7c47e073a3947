"""Held-out counts by message passing between sites: a spatio-temporal graph network in numpy.

A window is 48 hours of all sites; its second day is scored. A layer convolves every site's hours
(five taps), then passes messages along the edges of the site graph: a learned gate times the decay of
the edge weighs each neighbour's message, weights are normalised per receiver, and the receiver
updates its state beside them (residual, tanh). Inputs are log counts where a site is visible, a
mark of visibility, the calendar and the site's place; the output is the log count.

Training hides 15 to 50 % of the visible sites in each step and learns to restore them (squared error
of log counts), by Adam, until the error on further windows has not fallen for `patience` rounds; the
best state is kept. It reads a seeded sample of at most `windows` windows and is the work of one
task; it holds sites x 48 x windows counts, and what one window takes to send gradients back. Prediction runs window by window, in parallel over blocks of
four weeks; the fitted numbers, some hundreds, go along with each block.

Held-out sites are never visible. An hour without a count at a visible site is like a hidden one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOURS = 48
CALENDAR = 5  # hour and year waves, weekend
FITTED = "sites array<string>, place array<double>, known array<boolean>, src array<int>, dst array<int>, decay array<double>, names array<string>, shapes array<int>, numbers array<float>"


def scattered(x: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums along the last axis but one of the entries of each index 0 ... n - 1."""
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.r_[True, index[order][1:] != index[order][:-1]])
    out = np.zeros((*x.shape[:-2], n, x.shape[-1]), x.dtype)
    if len(index):
        out[..., index[order][first], :] = np.add.reduceat(np.take(x, order, axis=-2), first, axis=-2)
    return out


class Node:
    """A value in a computation, with what it takes to send gradients back where any is asked for: not for
    values that come from constants (live=False) alone, which hold on to nothing."""

    def __init__(self, x: np.ndarray, back=(), live: bool = True) -> None:
        self.x, self.g, self.live = x, None, any(p.live for p, _ in back) if back else live
        self.back = back if self.live else ()

    def add(self, g: np.ndarray) -> None:
        while g.ndim > self.x.ndim:
            g = g.sum(0)
        for i, n in enumerate(self.x.shape):
            if n == 1 and g.shape[i] != 1:
                g = g.sum(i, keepdims=True)
        self.g = g if self.g is None else self.g + g

    def __add__(self, o: Node) -> Node:
        return Node(self.x + o.x, [(self, lambda g: g), (o, lambda g: g)])

    def __mul__(self, o: Node) -> Node:
        return Node(self.x * o.x, [(self, lambda g: g * o.x), (o, lambda g: g * self.x)])

    def __truediv__(self, o: Node) -> Node:
        y = self.x / o.x
        return Node(y, [(self, lambda g: g / o.x), (o, lambda g: -g * y / o.x)])

    def __matmul__(self, w: Node) -> Node:
        flat = lambda a: a.reshape(-1, a.shape[-1])
        return Node(self.x @ w.x, [(self, lambda g: g @ w.x.T), (w, lambda g: flat(self.x).T @ flat(g))])

    def tanh(self) -> Node:
        y = np.tanh(self.x)
        return Node(y, [(self, lambda g: g * (1 - y * y))])

    def gate(self) -> Node:
        y = 1 / (1 + np.exp(-np.clip(self.x, -30, 30)))
        return Node(y, [(self, lambda g: g * y * (1 - y))])

    def at(self, index: np.ndarray) -> Node:
        """Entries along the sites' axis (the last but one)."""

        n = self.x.shape[-2]
        return Node(np.take(self.x, index, axis=-2), [(self, lambda g: scattered(g, index, n))])

    def gathered(self, index: np.ndarray, n: int) -> Node:
        """Sums of edges by receiving site."""
        return Node(scattered(self.x, index, n), [(self, lambda g: np.take(g, index, axis=-2))])

    def moved(self, k: int) -> Node:
        """Shifted by k hours (the second axis), nothing beyond the ends."""

        def shift(a: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros_like(a)
            n = a.shape[1]
            out[:, max(0, k) : n + min(0, k)] = a[:, max(0, -k) : n - max(0, k)]
            return out

        return Node(shift(self.x, k), [(self, lambda g: shift(g, -k))])


def backward(loss: Node) -> None:
    order, seen = [], set()
    stack = [(loss, False)]
    while stack:
        n, done = stack.pop()
        if done:
            order.append(n)
        elif id(n) not in seen:
            seen.add(id(n))
            stack.append((n, True))
            stack += [(p, False) for p, _ in n.back]
    loss.g = np.ones_like(loss.x)
    while order:  # what was passed on is let go
        n = order.pop()
        for p, f in n.back:
            if p.live:
                p.add(f(n.g))
        if n.back:
            n.back, n.g = (), None


def start(inputs: int, d: int, layers: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda a, b: (rng.normal(0, 1, (a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"in": w(inputs, d), "in_b": np.zeros((1, d), np.float32), "out": w(d, 1), "out_b": np.zeros((1, 1), np.float32)}
    for i in range(layers):
        p |= {f"{i}t{k}": w(d, d) / 3 for k in range(5)}
        p |= {f"{i}a_src": w(d, 1), f"{i}a_dst": w(d, 1), f"{i}a_b": np.zeros((1, 1), np.float32), f"{i}msg": w(d, d), f"{i}self": w(d, d), f"{i}agg": w(d, d), f"{i}b": np.zeros((1, d), np.float32)}
    return p


def forward(p: dict[str, Node], x: np.ndarray, src: np.ndarray, dst: np.ndarray, decay: np.ndarray) -> Node:
    """Log counts (windows, hours, sites, 1) from inputs (windows, hours, sites, columns)."""
    n = x.shape[2]
    h = (Node(x, live=False) @ p["in"] + p["in_b"]).tanh()
    w = Node(decay.astype(np.float32)[:, None], live=False)
    tiny = Node(np.full((1,), 1e-6, np.float32), live=False)
    for i in range(sum(k.endswith("msg") for k in p)):
        z = h @ p[f"{i}t2"]
        for k in (0, 1, 3, 4):
            z = z + h.moved(k - 2) @ p[f"{i}t{k}"]
        h = h + z.tanh()
        a = ((h @ p[f"{i}a_src"]).at(src) + (h @ p[f"{i}a_dst"]).at(dst) + p[f"{i}a_b"]).gate() * w
        total = ((h @ p[f"{i}msg"]).at(src) * a).gathered(dst, n) / (a.gathered(dst, n) + tiny)
        h = h + (h @ p[f"{i}self"] + total @ p[f"{i}agg"] + p[f"{i}b"]).tanh()
    return h @ p["out"] + p["out_b"]


def inputs(y: np.ndarray, visible: np.ndarray, calendar: np.ndarray, place: np.ndarray) -> np.ndarray:
    """y: windows x hours x sites (nan where none); visible: windows x sites."""
    seen = np.isfinite(y) & visible[:, None, :]
    level = np.where(seen, np.log1p(np.where(seen, y, 0.0)) / 4, 0.0)
    b, hours, n = y.shape
    wide = [level[..., None], seen[..., None].astype(float), np.broadcast_to(calendar[:, :, None], (b, hours, n, CALENDAR)), np.broadcast_to(place[None, None], (b, hours, n, place.shape[1]))]
    return np.concatenate(wide, 3).astype(np.float32)


def train(y: np.ndarray, calendar: np.ndarray, place: np.ndarray, known: np.ndarray, src: np.ndarray, dst: np.ndarray, decay: np.ndarray, d: int = 8, layers: int = 2, rounds: int = 12, patience: int = 3, batch: int = 4, rate: float = 8e-3, seed: int = 0) -> dict[str, np.ndarray]:
    """Fitted numbers. known: sites that may be seen; the last fifth of the windows stops the training."""
    rng = np.random.default_rng(seed)
    p = start(2 + CALENDAR + place.shape[1], d, layers, seed)
    m, v, t = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    cut = max(1, len(y) - max(1, len(y) // 5))

    def hidden(n: int) -> np.ndarray:
        share = rng.uniform(0.15, 0.5, n)
        return known[None] & (rng.random((n, len(known))) < share[:, None])

    def scored(w: np.ndarray, hide: np.ndarray) -> int:
        return max(1, (np.isfinite(y[w]) & hide[:, None, :]).sum())

    def step(nodes: dict[str, Node], w: np.ndarray, hide: np.ndarray, n: int) -> Node:
        """The part that windows w have in the loss of a batch with n scored counts."""
        target = y[w]
        use = np.isfinite(target) & hide[:, None, :]
        out = forward(nodes, inputs(target, known[None] & ~hide, calendar[w], place), src, dst, decay)
        miss = Node(np.where(use, -np.log1p(np.where(use, target, 0.0)) / 4, 0.0)[..., None].astype(np.float32), live=False)
        e = (out + miss) * Node(use[..., None].astype(np.float32), live=False)
        return Node(np.array((e.x**2).sum() / n), [(e, lambda g: 2 * e.x * g / n)])

    test = np.arange(cut, len(y)) if cut < len(y) else np.arange(len(y))
    held = hidden(len(test))
    best, best_p, bad = np.inf, p, 0
    for _ in range(rounds):
        order = rng.permutation(cut)
        for lo in range(0, cut, batch):
            w = order[lo : lo + batch]
            nodes, hide = {k: Node(x) for k, x in p.items()}, hidden(len(w))
            n = scored(w, hide)
            for i in range(len(w)):  # gradients of a batch add up window by window: one is held at a time
                backward(step(nodes, w[i : i + 1], hide[i : i + 1], n))
            t += 1
            for k, node in nodes.items():
                g = np.zeros_like(p[k]) if node.g is None else np.clip(node.g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        fixed, parts = {k: Node(x, live=False) for k, x in p.items()}, []
        for lo in range(0, len(test), batch):
            n = scored(test[lo : lo + batch], held[lo : lo + batch])
            parts.append(sum(float(step(fixed, test[i : i + 1], held[i : i + 1], n).x) for i in range(lo, min(lo + batch, len(test)))))
        now = np.mean(parts)
        if now < best - 1e-5:
            best, best_p, bad = now, dict(p), 0
        else:
            bad += 1
            if bad >= patience:
                break
    return best_p


def _arrays(pdf: pd.DataFrame, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, counts (windows, hours, sites) and calendar of rows (start, hour, site, y)."""
    starts, w = np.unique(pdf["start"].to_numpy(), return_inverse=True)
    y = np.full((len(starts), HOURS, len(sites)), np.nan)
    y[w, pdf["hour"].to_numpy(), np.searchsorted(sites, pdf["site"].to_numpy(str))] = pdf["y"].to_numpy(float)
    t = starts[:, None].astype("datetime64[h]") + np.arange(HOURS)[None].astype("timedelta64[h]")
    hour = t.astype(np.int64) % 24
    day = t.astype("datetime64[D]")
    year = (day - t.astype("datetime64[Y]").astype("datetime64[D]")).astype(np.int64)
    weekend = (day.astype(np.int64) + 3) % 7 >= 5
    return starts, y, np.stack([np.sin(hour * np.pi / 12), np.cos(hour * np.pi / 12), np.sin(year * 2 * np.pi / 365.25), np.cos(year * 2 * np.pi / 365.25), weekend.astype(float)], 2)


def _graph(pdf: pd.DataFrame) -> tuple:
    """The graph as it travels: rows of nodes (site, x, y, held) and of edges (site, other, weight)."""
    nodes = pdf[pdf["other"].isna()].sort_values("site")
    sites = nodes["site"].to_numpy(str)
    edges = pdf[pdf["other"].notna() & pdf["site"].isin(sites) & pdf["other"].isin(sites)]
    place = np.nan_to_num(nodes[["x", "y"]].to_numpy(float))
    return sites, (place - place.mean(0)) / (place.std(0) + 1e-9), ~nodes["held"].to_numpy(bool), np.searchsorted(sites, edges["site"].to_numpy(str)), np.searchsorted(sites, edges["other"].to_numpy(str)), edges["weight"].to_numpy(float)


def predictions(counts: DataFrame, sites: DataFrame, edges: DataFrame, windows: int = 48, seed: int = 0, **settings) -> DataFrame:
    """site, ts, pred for the held-out sites: every hour of every day with any count. On the first
    day, and after days without counts, the day before is empty.

    counts: site, ts, y, one row per site and hour. sites: site, x, y, held. edges: src, dst, weight.
    """
    day = F.to_date("ts")
    both = counts.where("y IS NOT NULL").select("site", F.col("y").cast("double").alias("y"), F.hour("ts").alias("h"), F.explode(F.array(F.struct(day.alias("start"), F.lit(0).alias("k")), F.struct(F.date_sub(day, 1).alias("start"), F.lit(24).alias("k")))).alias("w"))
    rows = both.select(F.col("w.start").cast("timestamp_ntz").alias("start"), (F.col("h") + F.col("w.k")).alias("hour"), "site", "y")
    text, real = F.lit(None).cast("string"), F.lit(None).cast("double")
    graph = sites.select("site", text.alias("other"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "held", real.alias("weight"))
    graph = graph.unionByName(edges.select(F.col("src").alias("site"), F.col("dst").alias("other"), real.alias("x"), real.alias("y"), F.lit(None).cast("boolean").alias("held"), "weight"))

    # a seeded sample of windows, and all of the graph, in one task
    starts = rows.select("start").distinct().orderBy(F.xxhash64(F.col("start").cast("string"), F.lit(seed)), "start").limit(windows)
    sample = rows.join(starts, "start", "left_semi")

    def fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        site, place, known, src, dst, decay = _graph(right)
        left = left[left["site"].isin(site)]
        if not len(left) or known.all():
            return pd.DataFrame([], columns=FITTED.replace(",", " ").split()[::2])
        _, y, calendar = _arrays(left, site)
        p = train(y, calendar, place, known, src, dst, decay, seed=seed, **settings)
        shapes = [n for w in p.values() for n in w.shape]
        numbers = np.concatenate([w.ravel() for w in p.values()])
        return pd.DataFrame([(site.tolist(), place.ravel(), known.tolist(), src, dst, decay, list(p), shapes, numbers)], columns=FITTED.replace(",", " ").split()[::2])

    one = F.lit(0).alias("all")
    fitted = sample.withColumn("all", F.lit(0)).groupBy("all").cogroup(graph.select("*", one).groupBy("all")).applyInPandas(fit, FITTED)
    # four weeks of windows go together, and with each the one row of what was fitted: sites, edges, numbers
    block = F.floor(F.unix_date(F.to_date("start")) / 28).cast("int")
    rows = rows.withColumn("block", block)
    each = rows.select(F.col("block").alias("__b")).distinct().crossJoin(F.broadcast(fitted))

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"site": pd.Series([], dtype=str), "ts": pd.Series([], dtype="datetime64[us]"), "pred": pd.Series([], dtype=float)})]
        if not len(left) or not len(right):
            return out[0]
        r = right.iloc[0]
        site, known = np.array(r["sites"], dtype=str), np.array(r["known"], dtype=bool)
        place = np.array(r["place"]).reshape(len(site), -1)
        src, dst, decay = np.array(r["src"]), np.array(r["dst"]), np.array(r["decay"])
        shapes, w, p, at = np.array(r["shapes"]).reshape(-1, 2), np.array(r["numbers"], np.float32), {}, 0
        for name, (m, n) in zip(r["names"], shapes):
            p[name] = Node(w[at : at + m * n].reshape(m, n), live=False)
            at += m * n
        left = left[left["site"].isin(site)]
        if not len(left):
            return out[0]
        start, y, calendar = _arrays(left, site)
        held = site[~known]
        for k in range(len(start)):
            if not np.isfinite(y[k, 24:]).any():
                continue
            x = inputs(y[k : k + 1], known[None], calendar[k : k + 1], place)
            level = forward(p, x, src, dst, decay).x[0, 24:, ~known, 0]  # held-out sites x hours
            ts = start[k].astype("datetime64[us]") + np.arange(24, HOURS).astype("timedelta64[h]")
            out.append(pd.DataFrame({"site": np.repeat(held, 24), "ts": np.tile(ts, len(held)), "pred": np.expm1(np.clip(4 * level, 0, 20)).ravel().astype(float)}))
        return pd.concat(out)

    return rows.groupBy("block").cogroup(each.groupBy("__b")).applyInPandas(apply, "site string, ts timestamp_ntz, pred double")

"""A mix of several sources in target weights, with capped repeats and reported shares.

Sizes are tokens. A source's budget is its share of the mix's size; it is filled with its texts in
a fixed pseudo-random order, pass after pass, at most `max_repeats` passes; what is missing then is
its shortfall. A text is taken while the budget is not yet reached, so a source exceeds its budget
by less than its last text. The size is, by default (`total="shares"`), the largest at which every
source with texts reaches its share: the one whose texts times repeats are scarcest for its share
sets it. `total="all"` takes all targeted texts once, and a number is a size of its own; scarce
sources then fall short.

Order of the mix: Pfair scheduling. The mix is cut in blocks of `block` tokens, or more where that
gives over `blocks` of them. A source of n blocks among N has weight w = n / N; its block k is
released in slot floor(k / w) and due by slot ceil((k + 1) / w). Earliest deadline first among the
released blocks keeps every source within one block of its weight at any time, and as n counts the
blocks that the source really has, every slot holds one block. Where shares are reached, these
weights are the target weights; a source that falls short is spread over the whole mix.
The schedule is the work of one task: its state is one entry a source, its output one row a block.

Positions are found without any global order: sources are cut into BUCKETS hash ranges, whose
token sums give each range its offset; only rows of one range meet in one window group. Texts are
sized once and shuffled once: both the ranges' sums and the rows read that exchange.

Texts without tokens (null or empty) take no part. Ties in the hash go by doc_id. Sources without
target are left out; targets without texts appear in the report with their whole share as
shortfall. Names are compared regardless of case, outer blanks and `-` for `_`; several target rows
of one source add up, and the smallest of their max_repeats holds. A target that is null, not a
number, not above 0, or with max_repeats below 1, draws nothing. No share is too small: a source is
cut from the mix only if its budget rounds to less than one token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
BLOCK = 4096  # tokens
BLOCKS = 100_000  # rows of the schedule, sources apart


def _all():
    """All targets: one row a source."""
    return Window.partitionBy(F.lit(0))


def canonical(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), "-", "_")


def pfair(blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of sources with so many blocks each: earliest deadline first among the
    released, ties by name. Whole numbers throughout: k / w is k N / n."""
    total = sum(blocks.values())
    release = [(0, s, 0) for s, n in sorted(blocks.items()) if n > 0]
    heapq.heapify(release)
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while release and release[0][0] <= slot:
            _, s, k = heapq.heappop(release)
            heapq.heappush(ready, (-(-(k + 1) * total // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k, slot
        if k + 1 < blocks[s]:
            heapq.heappush(release, (max(slot + 1, (k + 1) * total // blocks[s]), s, k + 1))


def usable_targets(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats: one row a source."""
    share = F.col("target_share").cast("double")
    t = targets.select(canonical(F.col("source")).alias("source"), share.alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.where((F.col("target_share") > 0) & (F.col("target_share") < float("inf")) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull())
    return t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def placed(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with `bucket` and `inner`, the tokens ahead of them in their bucket; and source, bucket,
    tokens, texts and start, the tokens of the source ahead of each bucket."""
    h = F.xxhash64("source", "doc_id")
    d = docs.where("n_tokens > 0").select("doc_id", canonical(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))
    d = d.select("doc_id", "source", "n_tokens", h.alias("h"), F.pmod(F.shiftright(h, 40), F.lit(BUCKETS)).cast("int").alias("bucket"))
    # the joins below ask for these: stated here, both readers of the exchange have the same plan
    d = d.where("source IS NOT NULL AND bucket IS NOT NULL").repartition("source", "bucket")
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    d = d.withColumn("inner", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = d.select("source", "bucket", (F.col("inner") + F.col("n_tokens")).alias("tokens"), F.row_number().over(order).alias("texts"), F.lead("doc_id").over(order).isNull().alias("last")).where("last").drop("last")
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.join(targets.select("source"), "source", "left_semi")
    return d.select("doc_id", "source", "n_tokens", "bucket", "inner"), last.withColumn("start", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))


def budgets(ranges: DataFrame, targets: DataFrame, total: str | int = "shares") -> DataFrame:
    """Per source: available tokens and texts, its share (targets rescaled to sum to 1) and budget."""
    have = ranges.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("texts").alias("texts"))
    per = targets.join(have, "source", "left").fillna(0, ["available", "texts"])
    per = per.withColumn("share", F.col("target_share") / F.sum("target_share").over(_all()))
    reach = F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))
    every = F.sum("available").over(_all()).cast("double")
    size = {"shares": F.coalesce(F.min(reach).over(_all()), F.lit(0.0)), "all": every}.get(total)
    size = size if size is not None else F.lit(float(total))
    # a hair's breadth less, so that the scarcest source is not asked for a token it lacks
    budget = F.floor(F.col("share") * size * (1 - 1e-12) + (0.0 if total == "shares" else 0.5)).cast("long")
    return per.select("source", "target_share", "max_repeats", "available", "texts", "share", budget.alias("budget"))


def drawn(docs: DataFrame, targets: DataFrame, total: str | int) -> tuple[DataFrame, DataFrame]:
    """source, doc_id, n_tokens, at (tokens of the source ahead of the text in a pass), available and
    used, how often the text is taken; and the budgets."""
    t = usable_targets(targets)
    d, ranges = placed(docs, t)
    b = budgets(ranges, t, total)
    j = d.join(ranges.select("source", "bucket", "start"), ["source", "bucket"]).withColumn("at", F.col("start") + F.col("inner"))
    j = j.join(b.where("available > 0").select("source", "max_repeats", "available", "budget"), "source")
    # pass p of a text starts at p * available + at; it is used while that is below the budget
    passes = F.ceil((F.col("budget") - F.col("at")) / F.col("available")).cast("long")
    used = F.least(F.col("max_repeats").cast("long"), passes)
    return j.select("source", "doc_id", "n_tokens", "at", "available", used.alias("used")).where("used > 0"), b


def schedule(per: DataFrame, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """source, block, slot and size, the tokens of a block, from the streams' last offsets (source,
    last: one row a source)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        size = max(block, -(-int(pdf["last"].sum()) // blocks))
        n = {s: int(x) // size + 1 for s, x in zip(pdf["source"], pdf["last"])}
        out = pd.DataFrame(list(pfair(n)), columns=["source", "block", "slot"])
        return out.assign(size=size)

    return per.groupBy(F.lit(0).alias("all")).applyInPandas(work, "source string, block long, slot long, size long")


def mix(docs: DataFrame, targets: DataFrame, total: str | int = "shares", block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """The mix, one row per use of a text: source, doc_id, pass (0-based), n_tokens, block, slot,
    offset (tokens ahead of it in its source's stream). Sorting by slot, offset gives the order.

    docs: doc_id, source, n_tokens.
    """
    d, _ = drawn(docs, targets, total)
    last = d.groupBy("source").agg(F.max((F.col("used") - 1) * F.col("available") + F.col("at")).alias("last"))
    plan = schedule(last, block, blocks)
    size = plan.groupBy("source").agg(F.max("size").alias("size"))
    j = d.select("source", "doc_id", "n_tokens", "at", "available", F.explode(F.sequence(F.lit(0).cast("long"), F.col("used") - 1)).alias("pass"))
    j = j.withColumn("offset", F.col("pass") * F.col("available") + F.col("at")).join(size, "source").withColumn("block", F.floor(F.col("offset") / F.col("size")))
    j = j.join(plan.select("source", "block", "slot"), ["source", "block"])
    return j.select("source", "doc_id", F.col("pass").cast("int").alias("pass"), "n_tokens", "block", "slot", "offset")


def report(docs: DataFrame, targets: DataFrame, total: str | int = "shares") -> DataFrame:
    """Per target: texts, available, budget and mixed tokens, the share of the mix reached, the
    shortfall against the budget, and `reach`, the size up to which the source holds its share."""
    d, b = drawn(docs, targets, total)
    taken = d.groupBy("source").agg(F.sum(F.col("used") * F.col("n_tokens")).alias("mixed"), F.max("used").alias("passes"))
    out = b.join(taken, "source", "left").fillna(0, ["mixed", "passes"])
    out = out.withColumn("all_mixed", F.sum("mixed").over(_all()))
    actual = F.round(F.when(F.col("all_mixed") > 0, F.col("mixed") / F.col("all_mixed")).otherwise(0.0), 6)
    reach = F.floor(F.col("available") * F.col("max_repeats") / F.col("share")).cast("long")
    short = F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("mixed"))
    return out.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", "texts", "available", "budget", "mixed", F.col("passes").cast("int").alias("passes"), actual.alias("actual_share"), short.alias("shortfall"), reach.alias("reach"))

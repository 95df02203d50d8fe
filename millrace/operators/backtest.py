"""Rolling-origin scoring."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules


#: Windows that a product gets at least where its span has room, the least step between them, and the share that lies close together.
LEAST_WINDOWS, LEAST_STEP, RECENT_SHARE = 4, 14, 0.5


def effective_horizon(horizon: int, combos: list[tuple[int, int]]) -> int:
    """Long enough for every lead time and the coverage after it."""
    return max([horizon, *(lead + coverage for lead, coverage in combos)])


def capacity(daily: DataFrame, horizon: int = 28, warm_up: int = 120) -> DataFrame:
    """(sku, first, last, testable, windows): the span in which cutoffs may lie, and a window for each horizon length in it."""
    span = daily.groupBy("sku").agg(F.date_add(F.min("ds"), warm_up).alias("first")).join(F.broadcast(daily.agg(F.date_sub(F.max("ds"), horizon).alias("last"))))
    testable = F.datediff("last", "first")
    windows = F.when(testable >= 0, F.greatest(F.lit(LEAST_WINDOWS), F.floor(testable / horizon) + 1)).otherwise(0)
    return span.select("sku", "first", "last", testable.alias("testable"), windows.cast("int").alias("windows"))


def _schedule(testable: F.Column, windows: F.Column, step: F.Column) -> F.Column:
    """Days before the last possible cutoff: half the windows at `step`, the rest spread evenly over what is left, at least LEAST_STEP apart."""
    recent_wanted = F.greatest(F.lit(1), F.bround(windows * RECENT_SHARE).cast("int"))
    recent = F.least(recent_wanted, F.floor(testable / step).cast("int") + 1)
    oldest = (recent - 1) * step
    left, back = windows - recent, testable - oldest
    wide = F.greatest(F.lit(LEAST_STEP), F.floor(back / F.greatest(left, F.lit(1))).cast("int"))
    historic = F.when((left > 0) & (back >= LEAST_STEP), F.least(left, F.floor(back / wide).cast("int"))).otherwise(0)
    near = F.transform(F.sequence(F.lit(0), recent - 1), lambda i: F.struct((i * step).alias("back"), F.lit("recent").alias("block")))
    far = F.transform(F.sequence(F.lit(1), F.greatest(historic, F.lit(1))), lambda i: F.struct((oldest + i * wide).alias("back"), F.lit("historic").alias("block")))
    return F.when(historic > 0, F.concat(near, far)).otherwise(near)


def cutoffs(filled: DataFrame, horizon: int = 28, step: int = 28, warm_up: int = 120) -> DataFrame:
    """(sku, cutoff, block): as many windows as fit end to end, half of them close together at the end and the rest spread over the past.

    If fewer fit at `step`, it shrinks a day at a time down to LEAST_STEP; the first step that gives the most is taken.
    """
    room = capacity(filled, horizon, warm_up).where("testable >= 0")
    steps = F.sequence(F.lit(max(step, LEAST_STEP)), F.lit(LEAST_STEP), F.lit(-1))
    tried = F.transform(steps, lambda s: _schedule(F.col("testable"), F.col("windows"), s))
    rows = room.withColumn("tried", tried).withColumn("most", F.aggregate("tried", F.lit(0), lambda n, c: F.greatest(n, F.size(c))))
    chosen = F.element_at(F.filter("tried", lambda c: F.size(c) == F.col("most")), 1)
    return rows.select("sku", "last", F.explode(chosen).alias("c")).select("sku", F.expr("date_sub(last, c.back)").alias("cutoff"), F.col("c.block").alias("block"))


def score(filled: DataFrame, horizon: int = 28, step: int = 28, days: int = 28) -> DataFrame:
    """(sku, cutoff, n, sum_y, sum_yhat, abs_err, mae, wape, bias, mase): a moving average of the days before each cutoff.

    Training and test days meet their cutoffs by day, never all by all.
    """
    at = cutoffs(filled, horizon, step).select("sku", "cutoff")
    train = at.withColumn("ds", F.explode(F.sequence(F.date_sub("cutoff", days - 1), F.col("cutoff"))))
    level = train.join(filled, ["sku", "ds"]).groupBy("sku", "cutoff").agg(F.avg("y").alias("yhat"))
    test = at.withColumn("ds", F.explode(F.sequence(F.date_add("cutoff", 1), F.date_add("cutoff", horizon))))
    lagged = filled.withColumn("step7", F.abs(F.col("y") - F.lag("y", 7).over(Window.partitionBy("sku").orderBy("ds"))))
    order = Window.partitionBy("sku").orderBy("ds")
    scale = lagged.select("sku", F.col("ds").alias("cutoff"), F.avg("step7").over(order).alias("scale"))
    err = F.col("y") - F.col("yhat")
    scored = test.join(filled, ["sku", "ds"]).join(level, ["sku", "cutoff"]).groupBy("sku", "cutoff").agg(
        F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum("yhat").alias("sum_yhat"), F.sum(F.abs(err)).alias("abs_err")
    )
    return scored.join(scale, ["sku", "cutoff"]).select(
        "sku",
        "cutoff",
        "n",
        "sum_y",
        "sum_yhat",
        "abs_err",
        (F.col("abs_err") / F.col("n")).alias("mae"),
        F.when(F.col("sum_y") > 0, F.col("abs_err") / F.col("sum_y")).alias("wape"),
        F.when(F.col("sum_y") > 0, (F.col("sum_yhat") - F.col("sum_y")) / F.col("sum_y")).alias("bias"),
        F.when(F.col("scale") > 0, F.col("abs_err") / F.col("n") / F.col("scale")).alias("mase"),
    )


def aggregate(scores: DataFrame) -> DataFrame:
    """(level, sku, year, windows, wape, bias, mase): by product, by year of the cutoff, and over all, in one pass."""
    rows = scores.withColumn("year", F.year("cutoff"))
    sets = rows.groupingSets([["sku"], ["year"], []], "sku", "year").agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("windows"),
        (F.sum("abs_err") / F.sum("sum_y")).alias("wape"),
        ((F.sum("sum_yhat") - F.sum("sum_y")) / F.sum("sum_y")).alias("bias"),
        F.avg("mase").alias("mase"),
    )
    level = F.when(F.col("g") == 1, "sku").when(F.col("g") == 2, "year").otherwise("all")
    return sets.select(level.alias("level"), "sku", "year", "windows", "wape", "bias", "mase")


def by_train_bucket(scored: DataFrame, starts: DataFrame) -> DataFrame:
    """(bucket, windows, wape): accuracy by days of history at the cutoff; starts has (sku, start)."""
    days = scored.join(starts, "sku").withColumn("train_days", F.datediff("cutoff", "start") + 1)
    rows = rules.with_rules(days, bucket=rules.TRAIN_BUCKET)
    return rows.groupBy("bucket").agg(F.count("*").alias("windows"), (100 * F.sum("abs_err") / F.sum("sum_y")).alias("wape"))


def by_block(scored: DataFrame, schedule: DataFrame) -> DataFrame:
    """(block, windows, wape): recent and historic windows apart."""
    rows = scored.join(schedule, ["sku", "cutoff"])
    return rows.groupBy("block").agg(F.count("*").alias("windows"), (100 * F.sum("abs_err") / F.sum("sum_y")).alias("wape"))


def by_source(scored: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, products, windows, wape): accuracy by the file that a product came from; sources has (sku, source)."""
    rows = scored.join(sources, "sku", "left").withColumn("source", F.coalesce("source", F.lit("(unknown file)")))
    return rows.groupBy("source").agg(F.count_distinct("sku").alias("products"), F.count("*").alias("windows"), (100 * F.sum("abs_err") / F.sum("sum_y")).alias("wape"))


#: The chances that a product counts up to k times in a resample, of a Poisson number of mean 1 (the tail beyond is under 1e-9).
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def resampled(products: DataFrame, resamples: int) -> DataFrame:
    """Rows of products (sku, ...) for each resample `rep` that they count in, `times` times.

    Each product draws a Poisson number of mean 1 of its own, from a digest of its name and the resample: no products are numbered or
    brought together, and what follows is summed before it is shuffled.
    """
    drawn = products.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "sku", "rep")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum((F.when(u > p, 1).otherwise(0) for p in POISSON), F.lit(0))
    return drawn.withColumn("times", times).where("times > 0")


def intervals(scored: DataFrame, metrics: tuple[str, ...], resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """(metric, mean, lo, hi): a metric's mean over all windows and its interval over resamples of products, whose windows stay together.

    Windows without a value don't count; with fewer than two products that have one the interval is null.
    """
    long = scored.unpivot("sku", list(metrics), "metric", "value").where("value IS NOT NULL")
    sums = long.groupBy("metric", "sku").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("metric").agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("products"))
    means = resampled(sums, resamples).groupBy("metric", "rep").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    edge = (1 - level) / 2
    edges = means.groupBy("metric").agg(F.percentile("m", F.lit(edge)).alias("lo"), F.percentile("m", F.lit(1 - edge)).alias("hi"))
    enough = lambda c: F.when(F.col("products") >= 2, F.col(c)).alias(c)
    return whole.join(edges, "metric").select("metric", "mean", enough("lo"), enough("hi"))


def tier_ranking(costed: DataFrame, resamples: int = 1000) -> DataFrame:
    """(tier, p_cheapest, winner, decisive, median_margin): how often each service level is the cheapest over resamples of products.

    costed has (sku, cutoff, tier, cost).  Only tiers that every product has a cost for are ranked, two products and two tiers at least; a tier that was not
    measured is unknown, not free.  The winner is decisive with half the resamples and twice its runner-up's; median_margin is what it saves on the next tier of a
    resample, in percent.
    """
    per_sku = costed.where("cost IS NOT NULL").groupBy("tier", "sku").agg(F.avg("cost").alias("cost"))
    size = F.broadcast(per_sku.agg(F.count_distinct("sku").alias("products")))
    whole = per_sku.groupBy("tier").agg(F.count("*").alias("n")).join(size).where("n = products AND products >= 2").select("tier")
    ranked = per_sku.join(F.broadcast(whole), "tier")
    totals = resampled(ranked, resamples).groupBy("rep", "tier").agg(F.sum(F.col("cost") * F.col("times")).alias("total"))
    order = Window.partitionBy("rep").orderBy(F.round("total", 6), "tier")
    placed = totals.withColumns({"place": F.row_number().over(order), "next": F.lead("total").over(order)}).where("place = 1")
    margin = F.when(F.col("next") > 0, 100 * (F.col("next") - F.col("total")) / F.col("next"))
    wins = placed.withColumn("margin", margin)
    share = whole.join(wins.groupBy("tier").agg(F.count("*").alias("wins")), "tier", "left").join(F.broadcast(wins.agg(F.count("*").alias("reps"), F.median("margin").alias("median_margin"))))
    chances = share.select("tier", (100.0 * F.coalesce("wins", F.lit(0)) / F.col("reps")).alias("p_cheapest"), "median_margin")
    best = Window.orderBy(F.desc("p_cheapest"), "tier")  # a row to a tier
    marked = chances.withColumns({"place": F.row_number().over(best), "second": F.lead("p_cheapest").over(best), "tiers": F.count("*").over(Window.partitionBy())}).where("tiers >= 2")
    winner = F.col("place") == 1
    decisive = winner & (F.col("p_cheapest") >= 2 * F.col("second")) & (F.col("p_cheapest") >= 50)
    return marked.select("tier", "p_cheapest", winner.alias("winner"), F.coalesce(decisive, F.lit(False)).alias("decisive"), "median_margin")


def critical_ratio(costs: DataFrame, coverage: int = 30, holding: float = 0.25) -> DataFrame:
    """(sku, service): the service level at which one more unit of buffer stops paying; loss-makers are left out."""
    margin = F.col("price") - F.col("unit_cost") - F.coalesce("fees", F.lit(0.0))
    rows = costs.withColumn("margin", margin).where("margin > 0 AND unit_cost > 0")
    s = 1 - F.col("unit_cost") * holding / (365.0 / coverage * F.col("margin"))
    return rows.select("sku", (100 * F.least(F.greatest(s, F.lit(0.0)), F.lit(0.9999))).alias("service"))


def tier_costs(windows: DataFrame, costs: DataFrame, coverage: int = 30, holding: float = 0.25) -> DataFrame:
    """(sku, cutoff, tier, safety, short, covered, cost) per window and service level.

    windows has (sku, cutoff, actual, forecast, basis): demand over the lead time, its forecast and the deviation of their difference.
    A year's cost is that of the shortage in each cycle and of holding the buffer.
    """
    tiers = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(z).alias("z")) for k, _, z in rules.TIERS])
    rows = windows.join(costs, "sku").withColumn("t", F.explode(tiers)).select("*", "t.*").withColumn("safety", F.round(F.col("z") * F.col("basis") + 1e-9))
    rows = rows.withColumn("short", F.greatest(F.lit(0.0), F.col("actual") - F.col("forecast") - F.col("safety")))
    margin = F.greatest(F.col("price") - F.col("unit_cost") - F.coalesce("fees", F.lit(0.0)), F.lit(0.0))
    cost = F.col("short") * 365.0 / coverage * margin + F.col("safety") * F.col("unit_cost") * holding
    return rows.select("sku", "cutoff", "tier", "safety", "short", (F.col("short") <= 0).alias("covered"), cost.alias("cost"))


def tier_summary(costed: DataFrame) -> DataFrame:
    """(tier, windows, service, shortage, cost): per service level over all windows; a product's cost is its windows' mean."""
    per_sku = costed.groupBy("tier", "sku").agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("int")).alias("held"), F.sum("short").alias("short"), F.avg("cost").alias("cost"))
    return per_sku.groupBy("tier").agg(F.sum("n").alias("windows"), (100 * F.sum("held") / F.sum("n")).alias("service"), F.sum("short").alias("shortage"), F.sum("cost").alias("cost"))


def mixed_policy(costed: DataFrame) -> DataFrame:
    """(mixed_cost, uniform_cost, uniform_tier, mixed_wins): each window at the tier that was cheapest in the product's other windows, against the best tier for all.

    Leaving a window out is the product's sum less the window, so no window meets the others one by one.
    """
    sums = costed.groupBy("sku", "tier").agg(F.sum("cost").alias("total"), F.count("*").alias("n")).where("n >= 2")
    out = costed.join(sums, ["sku", "tier"]).withColumn("others", (F.col("total") - F.col("cost")) / (F.col("n") - 1))
    picked = out.groupBy("sku", "cutoff").agg(F.min(F.struct(F.round("others", 6).alias("o"), "tier", "cost")).alias("p"))
    mixed = picked.groupBy("sku").agg(F.avg("p.cost").alias("c")).agg(F.sum("c").alias("mixed_cost"))
    uniform = out.groupBy("tier", "sku").agg(F.avg("cost").alias("c")).groupBy("tier").agg(F.sum("c").alias("c")).agg(F.min(F.struct(F.round("c", 6).alias("c"), "tier")).alias("u"))
    both = mixed.join(F.broadcast(uniform))
    return both.select("mixed_cost", F.col("u.c").alias("uniform_cost"), F.col("u.tier").alias("uniform_tier"), (F.col("mixed_cost") < F.col("u.c")).alias("mixed_wins"))


def merge_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows, those of a fresh (sku, lead, coverage) replaced by the fresh ones."""
    keys = ["sku", "lead", "coverage"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def recost(costed_windows: DataFrame, costs: DataFrame, coverage: int = 30, holding: float = 0.25) -> DataFrame:
    """Stored windows at new prices and costs, without a fit."""
    return tier_summary(tier_costs(costed_windows, costs, coverage, holding))


def window_events(daily: DataFrame) -> DataFrame:
    """(sku, kind, start, end, price): runs of promotion days and of a listed price, as events."""
    order = Window.partitionBy("sku").orderBy("ds")
    run = F.datediff("ds", F.lit("1970-01-01")) - F.row_number().over(order)
    promos = daily.where("on_promotion >= 1").withColumn("run", run).groupBy("sku", "run").agg(F.min("ds").alias("start"), F.max("ds").alias("end"))
    changed = daily.where("price IS NOT NULL").withColumn("before", F.lag("price").over(order)).where("abs(price - before) > greatest(0.02, 0.005 * greatest(price, before))")
    as_events = promos.select("sku", F.lit("promotion").alias("kind"), "start", "end", F.lit(None).cast("double").alias("price"))
    return as_events.union(changed.select("sku", F.lit("price_change").alias("kind"), F.col("ds").alias("start"), F.col("ds").alias("end"), "price"))


def testable_windows(windows: DataFrame, lead: int) -> DataFrame:
    """(sku, windows): windows with max(3, lead // 2) scored days or more, whose buffer can be judged."""
    return windows.groupBy("sku").agg(F.count_if(F.col("n") >= max(3, lead // 2)).alias("windows"))

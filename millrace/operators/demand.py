"""What kind of demand a product has, and which forecast it may get."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules

#: Cuts of the demand classes: mean interval between sales, squared variation of their sizes.
INTERVAL_CUT, VARIATION_CUT = 1.32, 0.49


def classify(daily: DataFrame) -> DataFrame:
    """(sku, days, selling_days, units, adi, cv2, demand_class) of daily sales, with or without rows for days of no sale.

    Days run from a product's first row to the last day of all; nothing else of the calendar is needed.
    """
    end = F.broadcast(daily.agg(F.max("ds").alias("end")))
    sold = F.when(F.col("y") > 0, F.col("y"))
    stats = daily.groupBy("sku").agg(F.min("ds").alias("start"), F.count(sold).alias("selling_days"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("units"), F.avg(sold).alias("mean"), F.stddev_pop(sold).alias("sd"))
    stats = stats.join(end).withColumn("days", (F.datediff("end", "start") + 1).cast("long"))
    adi = F.when(F.col("selling_days") > 0, F.col("days") / F.col("selling_days"))
    stats = stats.select("sku", "days", "selling_days", "units", adi.alias("adi"), F.pow(F.col("sd") / F.col("mean"), 2).alias("cv2"))
    often, even = F.col("adi") < INTERVAL_CUT, F.col("cv2") < VARIATION_CUT
    kind = F.when(F.col("selling_days") == 0, "no_demand").when(often & even, "smooth").when(often, "erratic").when(even, "intermittent").otherwise("lumpy")
    return stats.withColumn("demand_class", kind)


def dormancy(daily: DataFrame) -> DataFrame:
    """(sku, trailing_zeros, active_adi, dormant): asleep after max(45, 4 usual intervals) days without a sale.

    Usual intervals are those between the first and the last sale; a product that never sold is asleep after 45 days.
    """
    end = F.broadcast(daily.agg(F.max("ds").alias("end")))
    sale = F.when(F.col("y") > 0, F.col("ds"))
    stats = daily.groupBy("sku").agg(F.min("ds").alias("start"), F.max(sale).alias("sold"), F.min(sale).alias("first"), F.count(sale).alias("n")).join(end)
    tail = F.coalesce(F.datediff("end", "sold"), F.datediff("end", "start") + 1).cast("long")
    stats = stats.withColumn("trailing_zeros", tail).withColumn("active_adi", (F.datediff("sold", "first") + 1) / F.col("n"))
    asleep = F.col("trailing_zeros") >= F.greatest(F.lit(45.0), F.coalesce(4 * F.col("active_adi"), F.lit(0.0)))
    return stats.select("sku", "trailing_zeros", "active_adi", asleep.alias("dormant"))


def _windows(daily: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Per product: units and calendar days of windows (from, to) of days before the last day of all, today's being 0."""
    end = F.broadcast(daily.agg(F.max("ds").alias("end")))
    start = daily.groupBy("sku").agg(F.min("ds").alias("start"))
    rows = daily.join(end).withColumn("age", F.datediff("end", "ds"))
    units = rows.groupBy("sku", "end").agg(*(F.coalesce(F.sum(F.when(F.col("age").between(lo, hi), F.col("y"))), F.lit(0.0)).alias(n) for n, (lo, hi) in bounds.items()))
    oldest = F.datediff("end", "start")
    return units.join(start, "sku").withColumns({f"n_{n}": F.greatest(F.least(oldest, F.lit(hi)) - lo + 1, F.lit(0)) for n, (lo, hi) in bounds.items()})


def off_season(daily: DataFrame) -> DataFrame:
    """(sku, off_season): quiet now as it was a year ago, and not fading: its season lies elsewhere in the year.

    The last 30 days and the same ones a year ago each sold at most a quarter of their year's pace, and the past year at least half of the one before.
    """
    w = _windows(daily, year=(0, 363), before=(364, 728), now=(0, 28), then=(364, 393)).withColumn("rows", F.datediff("end", "start") + 1)
    pace = F.col("year") / F.col("n_year") * 30
    pace_then = F.when(F.col("n_before") >= 300, F.col("before") / F.col("n_before") * 30).otherwise(pace)
    known = (F.col("rows") >= 400) & (F.col("n_year") >= 300) & (F.col("n_then") >= 20) & (F.col("year") >= 6)
    quiet = (F.col("now") <= 0.25 * pace) & (F.col("then") <= 0.25 * F.greatest(pace_then, F.lit(1e-9)))
    fading = (F.col("n_before") >= 300) & (F.col("year") < 0.5 * F.col("before"))
    return w.select("sku", (known & quiet & ~fading).alias("off_season"))


def sells_in_a_year(daily: DataFrame, stock: DataFrame) -> DataFrame:
    """(sku, sells): whether the past year's units reach the stock on a line that isn't fading; stock has (sku, on_hand)."""
    w = _windows(daily, year=(0, 364), before=(365, 729)).join(stock, "sku")
    fading = (F.col("n_before") >= 300) & (F.col("year") < 0.5 * F.col("before"))
    return w.select("sku", (~fading & (F.col("year") > 0) & (F.col("year") >= F.col("on_hand"))).alias("sells"))


def pooling_exclusion(daily: DataFrame) -> DataFrame:
    """(sku, excluded): products that may not lend their shape: none sold in 180 days or in the last 90, unless out of season."""
    end = F.broadcast(daily.agg(F.max("ds").alias("end")))
    last = daily.groupBy("sku").agg(F.max(F.when(F.col("y") > 0, F.col("ds"))).alias("sold")).join(end)
    silent = F.coalesce(F.datediff("end", "sold") >= 89, F.lit(True))
    return last.join(off_season(daily), "sku").select("sku", (silent & ~F.col("off_season")).alias("excluded"))


def grades(classes: DataFrame, horizon: int = rules.HORIZON) -> DataFrame:
    """Adds ready_days, usable_days, predictability, grade and reason to classify()'s rows."""
    return rules.with_rules(classes, **rules.thresholds(str(horizon)), predictability=rules.PREDICTABILITY, grade=rules.GRADE, reason=rules.GRADE_REASON)


def dispersion(filled: DataFrame) -> DataFrame:
    """(sku, dispersion, volatility): deviation over the root of the mean; none below 20 units."""
    stats = filled.groupBy("sku").agg(F.sum("y").alias("units"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    index = F.when((F.col("mean") > 0) & (F.col("units") >= 20), F.col("sd") / F.sqrt("mean"))
    stats = stats.withColumn("dispersion", index)
    return stats.select("sku", "dispersion", F.when(index < 1.25, "steady").when(index < 2.0, "variable").when(index.isNotNull(), "volatile").alias("volatility"))


def route(classes: DataFrame, relatives: DataFrame) -> DataFrame:
    """(sku, route): the first rule of the decision table that holds; relatives has (sku, relatives, cohesion)."""
    joined = classes.join(relatives, "sku", "left").withColumn("relatives", F.coalesce("relatives", F.lit(0)))
    established = (F.col("days") >= 180) & (F.col("selling_days") >= 45) & (F.col("units") >= 60)
    gaps = F.col("demand_class").isin("intermittent", "lumpy")
    sparse = gaps | (F.col("demand_class") == "no_demand")
    pooled = (F.col("relatives") >= 2) & (F.coalesce("cohesion", F.lit(1.0)) >= 0.35) & ((F.col("days") < 60) | sparse | ~established)
    rule = (
        F.when(established & ~sparse, "regular")
        .when(gaps & (F.col("days") >= 60), "sparse")
        .when(pooled, "pooled")
        .when(gaps, "sparse")
        .when((F.col("days") < 90) | (F.col("units") < 30), "abstain")
        .otherwise("regular")
    )
    return joined.select("sku", rule.alias("route"))


#: Places of a category's order that are one block of nearest_peers().
PEER_BLOCK = 4096


def nearest_peers(daily_by_category: DataFrame, most: int = 25) -> DataFrame:
    """(sku, category, peer, distance, rank): per product the closest in log volume of its category.

    Products are ordered by log volume inside the category; the closest `most` lie within `most` places on either side.  The order is
    cut into blocks that also hold the `most` places beyond either edge, so that each product meets its peers in a window of its block, and
    is sent once and not once a peer.  Distances count to nine digits, and ties go by places between, then by name.
    """
    volume = daily_by_category.groupBy("category", "sku").agg(F.log(F.sum("units")).alias("v"))
    placed = volume.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("v", "sku")))
    blocks = F.array_distinct(F.array(*(F.floor((F.col("place") + k) / PEER_BLOCK) for k in (-most, 0, most))))
    dealt = placed.withColumn("block", F.explode(blocks)).repartition("category", "block")
    around = Window.partitionBy("category", "block").orderBy("place").rowsBetween(-most, most)
    met = dealt.withColumn("others", F.collect_list(F.struct("sku", "v", "place")).over(around)).where(F.col("block") == F.floor(F.col("place") / PEER_BLOCK))
    others = F.filter("others", lambda o: o["place"] != F.col("place"))
    peers = F.transform(others, lambda o: F.struct(F.round(F.abs(F.col("v") - o["v"]), 9).alias("distance"), F.abs(o["place"] - F.col("place")).alias("between"), o["sku"].alias("peer")))
    ranked = met.select("sku", "category", F.posexplode(F.slice(F.array_sort(peers), 1, most)).alias("r", "p"))
    return ranked.select("sku", "category", "p.peer", "p.distance", (F.col("r") + 1).alias("rank"))

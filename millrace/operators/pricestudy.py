"""Price response read at a product's own price changes: the weeks before against the weeks after, beside products whose price stood still."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days compared on either side at most and at least, the least move of a price in logs, and what counts as the same price.
WINDOW, LEAST_SIDE, LEAST_STEP, SAME_PRICE = 91, 7, 0.05, 0.01
#: Products that make a yardstick, their units on either side, and the dispersion of counts.
YARDSTICK, YARDSTICK_UNITS, DISPERSION = 3, 5, 2.0
#: Weekday means count from so many days, profiles from so many; a profile is shrunk by so many units.
WEEKDAY_ROWS, PROFILE_ROWS, PROFILE_UNITS = 4, 28, 20.0
#: A reading must be this precise and no steeper; two readings this far apart still agree.
MOST_ERROR, STEEPEST, AGREE = 1.5, 4.0, 0.75


def usable_days(filled: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(sku, ds, y, price) of days at one known price, without masked ones (sku, ds), such as holidays."""
    rows = filled.where((F.col("price") > 0) & (F.coalesce("price_mixed", F.lit(0)) < 1)).select("sku", "ds", "y", "price")
    return rows if masked is None else rows.join(masked.select("sku", "ds"), ["sku", "ds"], "left_anti")


def weekday_weights(days: DataFrame) -> DataFrame:
    """(sku, weekday, weight): a weekday's mean over the mean, shrunk by its units, of mean 1; 1 with too few days to tell."""
    whole = days.groupBy("sku").agg(F.avg("y").alias("mean"), F.count("*").alias("rows"))
    own = days.groupBy("sku", F.weekday("ds").alias("weekday")).agg(F.avg("y").alias("m"), F.sum("y").alias("units"), F.count("*").alias("n"))
    grid = whole.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(own, ["sku", "weekday"], "left")
    told = (F.col("n") >= WEEKDAY_ROWS) & (F.col("rows") >= PROFILE_ROWS) & (F.col("mean") > 0)
    raw = F.when(told, 1 + (F.col("m") / F.col("mean") - 1) * F.col("units") / (F.col("units") + PROFILE_UNITS)).otherwise(1.0)
    return grid.withColumn("raw", raw).select("sku", "weekday", (F.col("raw") / F.avg("raw").over(Window.partitionBy("sku"))).alias("weight"))


def _anchors(prices: Column) -> Column:
    """For each price the first of its stretch: a stretch lasts while prices stay within SAME_PRICE of that first one."""
    near = lambda a, p: F.abs(F.log(p / a)) < SAME_PRICE
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        anchor = F.when(s["anchor"].isNotNull() & near(s["anchor"], p), s["anchor"]).otherwise(p)
        return F.struct(anchor.alias("anchor"), F.concat(s["out"], F.array(anchor)).alias("out"))

    return F.aggregate(prices, start, step, lambda s: s["out"])


def stretches(days: DataFrame) -> DataFrame:
    """(sku, ds, y, stretch, price, place, left): usable days with the number of their stretch, its price, and the day's place from its start and before its end.

    A product's prices are one array, scanned once.
    """
    listed = days.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("ds", "y", F.col("price").cast("double").alias("price")))).alias("d"))
    anchored = listed.select("sku", F.inline(F.arrays_zip(F.col("d.ds").alias("ds"), F.col("d.y").alias("y"), _anchors(F.col("d.price")).alias("price"))))
    order = Window.partitionBy("sku").orderBy("ds")
    turned = F.coalesce(F.lag("price").over(order) != F.col("price"), F.lit(True)).cast("int")
    numbered = anchored.withColumn("turned", turned).withColumn("stretch", F.sum("turned").over(order)).drop("turned")
    own = Window.partitionBy("sku", "stretch")
    return numbered.withColumns({"place": F.row_number().over(own.orderBy("ds")), "left": F.row_number().over(own.orderBy(F.desc("ds")))})


def changes(filled: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(sku, stretch, p0, p1, step, first, turn, last, n0, n1, y0, expected, y1, own): each price change that can be read, and how far units moved beyond the weekdays, in logs."""
    days = usable_days(filled, masked)
    rows = stretches(days).withColumn("weekday", F.weekday("ds")).join(weekday_weights(days), ["sku", "weekday"])
    sums = {"from": F.min("ds"), "to": F.max("ds"), "n": F.count("*"), "y": F.sum("y"), "w": F.sum("weight"), "p": F.min("price")}
    side = lambda near, shift, k: rows.where(F.col(near) <= WINDOW).groupBy("sku", (F.col("stretch") + shift).alias("stretch")).agg(*(f.alias(n + k) for n, f in sums.items())).where(F.col("n" + k) >= LEAST_SIDE)
    met = side("left", 1, "0").join(side("place", 0, "1"), ["sku", "stretch"]).withColumn("step", F.log(F.col("p1") / F.col("p0"))).where((F.abs("step") >= LEAST_STEP) & (F.col("y0") > 0))
    expected = F.col("y0") / F.col("w0") * F.col("w1")
    own = F.log((F.col("y1") + 0.5) / (F.col("expected") + 0.5))
    return met.withColumn("expected", expected).select("sku", "stretch", "p0", "p1", "step", F.col("from0").alias("first"), F.col("from1").alias("turn"), F.col("to1").alias("last"), "n0", "n1", "y0", "expected", "y1", own.alias("own"))


def yardsticks(found: DataFrame, filled: DataFrame, peers: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(sku, stretch, moved, scope): the median move of other products over the same days, of preferred peers if there are YARDSTICK, else of all.

    peers has (sku, peer, preferred), a bounded number to a product.  A peer counts if it was on sale all the time at one price and sold some units on both sides; it meets a change on
    the change's days alone.
    """
    spans = filled.groupBy("sku").agg(F.min("ds").alias("since"), F.max("ds").alias("until")).withColumnRenamed("sku", "peer")
    asked = found.select("sku", "stretch", "first", "last", "turn").join(peers.groupBy("sku", "peer").agg(F.max("preferred").alias("preferred")), "sku")
    asked = asked.join(spans, "peer").where("since <= first AND until >= last")
    used = stretches(usable_days(filled, masked))
    sides = used.where(F.col("left") <= WINDOW).select("sku", (F.col("stretch") + 1).alias("stretch"), "ds", F.lit(0).alias("side")).unionByName(used.where(F.col("place") <= WINDOW).select("sku", "stretch", "ds", F.lit(1).alias("side")))
    calendar = asked.withColumn("ds", F.explode(F.sequence("first", "last"))).join(sides, ["sku", "stretch", "ds"], "left")
    theirs = filled.select(F.col("sku").alias("peer"), "ds", "y", F.when(F.col("price") > 0, F.col("price")).alias("price"))
    met = calendar.join(theirs, ["peer", "ds"], "left").groupBy("sku", "stretch", "peer", "preferred").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), *(F.coalesce(F.sum(F.when(F.col("side") == k, F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias(f"c{k}") for k in (0, 1)), *(F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1))
    )
    still = met.where((F.col("hi") / F.col("lo") < 1 + SAME_PRICE) & (F.col("c0") >= YARDSTICK_UNITS) & (F.col("c1") >= YARDSTICK_UNITS))
    ratio = F.log((F.col("c1") / F.col("n1")) / (F.col("c0") / F.col("n0")))
    of = still.withColumn("r", ratio).groupBy("sku", "stretch").agg(F.count_if("preferred").alias("near"), F.median(F.when(F.col("preferred"), F.col("r"))).alias("near_r"), F.count("*").alias("every"), F.median("r").alias("every_r"))
    near, enough = F.col("near") >= YARDSTICK, F.col("every") >= YARDSTICK
    return of.where(near | enough).select("sku", "stretch", F.when(near, F.col("near_r")).otherwise(F.col("every_r")).alias("moved"), F.when(near, "category").otherwise("store").alias("scope"))


def before_after(filled: DataFrame, peers: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(sku, elasticity, se, changes, lo, hi): the changes' responses beside their yardsticks, weighted by the square of the step over the noise of the counts."""
    found = changes(filled, masked)
    met = found.join(yardsticks(found, filled, peers, masked), ["sku", "stretch"], "left")
    noise = DISPERSION * (1 / F.greatest("y0", F.lit(1.0)) + 1 / F.greatest("expected", F.lit(1.0)))
    rows = met.withColumns({"e": (F.col("own") - F.coalesce("moved", F.lit(0.0))) / F.col("step"), "w": F.col("step") * F.col("step") / noise})
    return rows.groupBy("sku").agg(
        (F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("elasticity"), (1 / F.sqrt(F.sum("w"))).alias("se"), F.count("*").alias("changes"), F.min(F.least("p0", "p1")).alias("lo"), F.max(F.greatest("p0", "p1")).alias("hi")
    )


def reading(same_months: DataFrame, study: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """(sku, elasticity, basis, same_months, before_after): both readings' mean where they agree, none where they don't, else the one there is.

    same_months has (sku, elasticity, basis) as of pricing.elasticity(), study is before_after(); usable (sku, usable) tells whose price evidence allows the first.  A study
    that is too noisy, too steep or not negative is no reading.
    """
    ok = usable.select("sku", "usable") if usable is not None else same_months.select("sku").withColumn("usable", F.lit(True))
    rows = same_months.select("sku", F.col("elasticity").alias("e0"), F.col("basis").alias("b0")).join(ok, "sku", "left").join(study.select("sku", F.col("elasticity").alias("e1"), "se"), "sku", "full_outer")
    gate = F.coalesce("usable", F.lit(False))
    first = F.when(gate & (F.col("b0") == "measured") & (F.col("e0") < 0), F.col("e0"))
    clear = (F.col("se") <= MOST_ERROR) & (F.col("e1") >= -STEEPEST)
    met = rows.withColumns({"same_months": first, "before_after": F.when(clear & (F.col("e1") < 0), F.col("e1"))})
    a, b = F.col("same_months"), F.col("before_after")
    agree = F.abs(a - b) <= AGREE
    reason = F.coalesce("b0", F.lit("none"))
    reason = F.when(clear & (F.col("e1") >= 0) & gate, "positive-elasticity-ignored").when(~gate & (reason == "measured"), "too-few-price-levels").otherwise(reason)
    value = F.when(a.isNotNull() & b.isNotNull(), F.when(agree, (a + b) / 2)).otherwise(F.coalesce(a, b))
    basis = F.when(a.isNotNull() & b.isNotNull(), F.when(agree, "both").otherwise("readings-disagree")).when(a.isNotNull(), "same-months").when(b.isNotNull(), "before-after").otherwise(reason)
    return met.select("sku", F.round(value + F.lit(0.0), 3).alias("elasticity"), basis.alias("basis"), "same_months", "before_after")

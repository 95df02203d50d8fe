"""What prices and promotions did to sales, and what planned ones will do.

Rows come calendar-filled: (sku, ds, y, price, price_mixed, on_promotion), with days of no sale at the listed price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules

#: A level counts as evidence from this many days on; two must lie this far apart.
LEVEL_DAYS, LEVEL_SPREAD = 30, 0.05
#: Sale days that an elasticity needs, days that shrink it by half, and its greatest size.
POINTS, SHRINK_DAYS, STEEPEST = 30, 60, 4.0
#: Days at a month's less common prices that a comparison within months needs.
MINORITY_DAYS = 30
#: Days on promotion that a lift needs, days that shrink it by half, and its bounds.
PROMO_DAYS, PROMO_SHRINK, LIFT_BOUNDS = 3, 5, (0.5, 5.0)


def single_price_days(filled: DataFrame) -> DataFrame:
    """Days with one price; `cents` is the price to the cent."""
    return filled.where("coalesce(price_mixed, 0) < 1 AND price IS NOT NULL").withColumn("cents", F.round(F.col("price") + 1e-9, 2))


def price_levels(filled: DataFrame) -> DataFrame:
    """(sku, level, days, price, quality): prices from low to high, those within two cents or half a percent of a level's lowest being the same level.

    A level is named by its most common price, the higher on a tie.  The scan runs over a product's distinct prices alone.
    """
    counts = single_price_days(filled).groupBy("sku", "cents").agg(F.count("*").alias("n"))
    ordered = counts.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("cents", "n"))).alias("prices"))
    last = "element_at(acc, -1)"
    joins = f"size(acc) > 0 AND x.cents - {last}.anchor <= greatest(0.02, 0.005 * abs(x.cents))"
    grown = f"named_struct('anchor', {last}.anchor, 'price', CASE WHEN x.n >= {last}.most THEN x.cents ELSE {last}.price END, 'most', greatest({last}.most, x.n), 'days', {last}.days + x.n)"
    opened = "named_struct('anchor', x.cents, 'price', x.cents, 'most', x.n, 'days', x.n)"
    scan = (
        "aggregate(prices, cast(array() AS array<struct<anchor:double,price:double,most:bigint,days:bigint>>), "
        f"(acc, x) -> CASE WHEN {joins} THEN concat(slice(acc, 1, size(acc) - 1), array({grown})) ELSE concat(acc, array({opened})) END)"
    )
    levels = ordered.select("sku", F.posexplode(F.expr(scan)).alias("level", "of"))
    return rules.with_rules(levels.select("sku", (F.col("level") + 1).alias("level"), F.col("of.days").alias("days"), F.col("of.price").alias("price")), quality=rules.TIER_QUALITY)


def price_evidence(filled: DataFrame, levels: DataFrame) -> DataFrame:
    """(sku, levels, qualifying, mixed_days, last_price, range_lo, range_hi, usable, reason): whether prices may move a forecast."""
    days = filled.groupBy("sku").agg(
        F.count_if(F.coalesce("price_mixed", F.lit(0)) >= 1).alias("mixed_days"),
        F.max(F.when(F.col("price").isNotNull() & (F.coalesce("price_mixed", F.lit(0)) < 1), F.struct("ds", "price"))).getField("price").alias("last_price"),
    )
    long = F.col("days") >= LEVEL_DAYS
    found = levels.groupBy("sku").agg(
        F.count("*").alias("levels"), F.count_if(long).alias("qualifying"), F.min(F.when(long, F.col("price"))).alias("lo"), F.max(F.when(long, F.col("price"))).alias("hi")
    )
    rows = days.join(found, "sku", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("levels", "qualifying")})
    enough = F.col("qualifying") >= 2
    apart = enough & ((F.col("hi") - F.col("lo")) / F.col("hi") >= LEVEL_SPREAD)
    reason = F.when(F.col("levels") == 0, "no-price-data").when(~enough, "too-few-price-levels").when(~apart, "levels-too-close").otherwise("usable")
    return rows.select(
        "sku", "levels", "qualifying", "mixed_days", "last_price", *(F.when(enough, F.col(c)).alias(f"range_{c}") for c in ("lo", "hi")), F.coalesce(apart, F.lit(False)).alias("usable"), reason.alias("reason")
    )


def price_bounds(evidence: DataFrame, current: str = "last_price") -> DataFrame:
    """(sku, lo, hi) of usable evidence: a fifth of the lowest to twice the highest known price, and today's price in any case."""
    lo, hi = F.least(0.2 * F.col("range_lo"), F.col(current)), F.greatest(2.0 * F.col("range_hi"), F.col(current))
    return evidence.where("usable").select("sku", F.round(lo + 1e-9, 2).alias("lo"), F.round(hi + 1e-9, 2).alias("hi"))


#: Days at a price that make it reliable, and how far beyond the known prices a range may reach: of their spread, and of the mean price.
RELIABLE_DAYS, REACH_OF_SPREAD, REACH_OF_MEAN = 90, 0.25, 0.10


def price_analysis(levels: DataFrame, evidence: DataFrame) -> DataFrame:
    """(sku, varied, well_sampled, last_price, warning): whether a product's prices can be learned from; evidence is price_evidence(), levels price_levels()."""
    found = levels.groupBy("sku").agg(F.count("*").alias("n"), F.bool_and(F.col("quality") == "reliable").alias("reliable"))
    rows = evidence.select("sku", "last_price").join(found, "sku", "left")
    known, varied = F.col("last_price").isNotNull(), F.col("n") > 1
    warning = F.when(~known, "no_column").when(~varied, "never_changed").when(~F.col("reliable"), "thin_data")
    told = lambda c: F.coalesce(known & c, F.lit(False))
    return rows.select("sku", told(varied).alias("varied"), told(varied & F.col("reliable")).alias("well_sampled"), "last_price", warning.alias("warning"))


def safe_range(filled: DataFrame, levels: DataFrame, residuals: DataFrame, slopes: DataFrame | None = None) -> DataFrame:
    """(sku, lo, hi): how far prices may leave the known ones, by the days sold at the outermost and by what the noise allows.

    residuals has (sku, sigma), the deviation of a forecast's errors; slopes (sku, coefficient), units lost per unit of price, if known.  Without a slope the noise allows the deviation of the prices
    times the root of the days; without noise nothing is held back.  The reach is at most a tenth of the mean price and a quarter of the spread.
    """
    known = filled.where("price IS NOT NULL").groupBy("sku").agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"))
    rows = filled.groupBy("sku").agg(F.count("*").alias("n"))
    ends = levels.groupBy("sku").agg(F.min("price").alias("p0"), F.max("price").alias("p1"), F.min_by("days", "price").alias("d0"), F.max_by("days", "price").alias("d1"))
    met = ends.join(known, "sku").join(rows, "sku").join(residuals.select("sku", "sigma"), "sku", "left")
    met = met.withColumn("coefficient", F.lit(None).cast("double")) if slopes is None else met.join(slopes.select("sku", "coefficient"), "sku", "left")
    spread = F.col("p1") - F.col("p0")
    most = F.least(F.when(spread > 0, REACH_OF_SPREAD * spread).otherwise(REACH_OF_MEAN * F.col("mean")), REACH_OF_MEAN * F.col("mean"))
    noise = F.when(F.abs("coefficient") > 1e-9, F.col("sigma") / F.abs("coefficient")).when((F.col("sd") > 0) & (F.col("sigma") > 0), F.col("sd") * F.sqrt("n"))
    reach = lambda days: F.when(noise > 0, F.least(most * F.least(F.col(days) / RELIABLE_DAYS, F.lit(1.0)), noise)).otherwise(most * F.least(F.col(days) / RELIABLE_DAYS, F.lit(1.0)))
    return met.select("sku", F.round(F.greatest(F.col("p0") - reach("d0"), F.lit(0.0)) + 1e-9, 2).alias("lo"), F.round(F.col("p1") + reach("d1") + 1e-9, 2).alias("hi"))


def _slope(cells: DataFrame, *keys: str) -> DataFrame:
    """Per keys: weighted sums over (w, x, y) that give the slope of y on x."""
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = cells.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("w").alias("sw"), F.max("w").alias("w_most"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy")
    )
    return sums.withColumns({"num": F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw"), "den": F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")})


def _cells(filled: DataFrame, *keys: str) -> DataFrame:
    cells = single_price_days(filled).where("cents > 0 AND y >= 0").groupBy("sku", *keys, "cents").agg(F.count("*").alias("w"), F.avg("y").alias("mean"))
    return cells.where("w >= 3 AND mean > 0").withColumns({"x": F.log("cents"), "y": F.log("mean")})


def within_month_elasticity(filled: DataFrame) -> DataFrame:
    """(sku, elasticity, months): prices compared inside the same calendar month, where enough days stand at its less common prices."""
    months = _slope(_cells(filled.withColumn("month", F.month("ds")), "month"), "sku", "month").where("k >= 2")
    total = months.groupBy("sku").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.count("*").alias("months"), F.sum(F.col("sw") - F.col("w_most")).alias("minority"))
    return total.where(f"den > 1e-12 AND minority >= {MINORITY_DAYS}").select("sku", (F.col("num") / F.col("den")).alias("elasticity"), "months")


def elasticity(filled: DataFrame) -> DataFrame:
    """(sku, points, basis, elasticity): slope of log units on log price, zero days counted, within months where that can be read.

    None is read under POINTS sale days, with one price level or levels less than 5% apart, or where demand rises with the price; else it is
    shrunk by n / (n + SHRINK_DAYS) sale days and no steeper than STEEPEST.
    """
    points = single_price_days(filled).where("cents > 0").groupBy("sku").agg(F.count_if(F.col("y") > 0).alias("points"))
    cells = _cells(filled)
    spread = cells.groupBy("sku").agg((1 - F.min("cents") / F.max("cents")).alias("spread"))
    across = _slope(cells, "sku").join(spread, "sku").withColumn("across", F.col("num") / F.col("den")).select("sku", "k", "den", "spread", "across")
    within = within_month_elasticity(filled).select("sku", F.col("elasticity").alias("within"))
    rows = points.join(across, "sku", "left").join(within, "sku", "left").withColumn("raw", F.coalesce("within", "across"))
    varied = (F.col("k") >= 2) & (F.col("spread") >= LEVEL_SPREAD) & (F.col("den") > 1e-12)
    basis = F.when(F.col("points") < POINTS, "too-few-points").when(~F.coalesce(varied, F.lit(False)), "price-never-varied").when(F.col("raw") > 0, "positive-elasticity-ignored").otherwise("measured")
    shrunk = F.greatest(F.col("raw") * F.col("points") / (F.col("points") + SHRINK_DAYS), F.lit(-STEEPEST))
    return rows.withColumn("basis", basis).select("sku", "points", "basis", F.when(F.col("basis") == "measured", shrunk).otherwise(0.0).alias("elasticity"))


def promotion_lift(filled: DataFrame) -> DataFrame:
    """(sku, promo_days, normal_days, basis, lift): mean on promotion over the mean off it, days of no sale counted, shrunk toward 1."""
    on = F.coalesce("on_promotion", F.lit(0)) >= 1
    s = filled.groupBy("sku").agg(F.count_if(on).alias("n"), F.count_if(~on).alias("m"), F.avg(F.when(on, F.col("y"))).alias("p"), F.avg(F.when(~on, F.col("y"))).alias("q"))
    basis = F.when((F.col("n") < PROMO_DAYS) | (F.col("m") == 0), "too-few-promo-days").when(F.col("q") <= 0, "no-normal-baseline").otherwise("own-history")
    lift = 1 + (F.col("p") / F.col("q") - 1) * F.col("n") / (F.col("n") + PROMO_SHRINK)
    bounded = F.least(F.greatest(lift, F.lit(LIFT_BOUNDS[0])), F.lit(LIFT_BOUNDS[1]))
    return s.withColumn("basis", basis).select(
        "sku", F.col("n").alias("promo_days"), F.col("m").alias("normal_days"), "basis", F.when(F.col("basis") == "own-history", bounded).otherwise(1.0).alias("lift")
    )


def cohort_promotion_lift(lifts: DataFrame, keys: DataFrame) -> DataFrame:
    """(category, peers, lift): the members' lifts weighted by their promotion days and their trust in them; two members at least."""
    weight = F.col("promo_days") * F.col("promo_days") / (F.col("promo_days") + PROMO_SHRINK)
    own = lifts.where("basis = 'own-history'").join(keys, "sku").groupBy("category").agg(F.count("*").alias("peers"), (F.sum(F.col("lift") * weight) / F.sum(weight)).alias("lift"))
    return own.where("peers >= 2")


def pooled_elasticity(responses: DataFrame, evidence: DataFrame, keys: DataFrame) -> DataFrame:
    """(category, peers, elasticity, rel_lo, rel_hi): medians over members with usable prices and a measured response."""
    usable = responses.where("basis = 'measured' AND elasticity < 0").join(evidence.where("usable AND last_price > 0"), "sku").join(keys, "sku")
    rel = usable.withColumns({"lo": F.col("range_lo") / F.col("last_price"), "hi": F.col("range_hi") / F.col("last_price")})
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    pooled = rel.groupBy("category").agg(F.count("*").alias("peers"), F.median("elasticity").alias("elasticity"), upper("lo").alias("rel_lo"), upper("hi").alias("rel_hi"))
    return pooled.where("peers >= 2").withColumns({"rel_lo": F.least("rel_lo", F.lit(1.0)), "rel_hi": F.greatest("rel_hi", F.lit(1.0))})


def price_history(filled: DataFrame) -> DataFrame:
    """(sku, ds, price, previous): days on which the listed price of single-price days changed."""
    before = F.lag("cents").over(Window.partitionBy("sku").orderBy("ds"))
    return single_price_days(filled).withColumn("previous", before).where("previous <> cents").select("sku", "ds", F.col("cents").alias("price"), "previous")


def scheduled_prices(days: DataFrame, events: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(sku, ds, price, discount_pct) for days (sku, ds, base_price).

    events has (sku, kind, start, end, new_price, discount_pct).  The latest permanent change holds from its day on, the latest temporary
    one covers its window, and of the promotions of a day the deepest alone applies; bounds (sku, lo, hi) hold last.
    """
    spans = events.select("sku", "kind", "start", F.coalesce("end", "start").alias("end"), "new_price", F.least("discount_pct", F.lit(100.0)).alias("pct"))
    permanent = F.col("kind") == "price_change_permanent"
    live = (F.col("ds") >= F.col("start")) & (permanent | (F.col("ds") <= F.col("end")))
    met = days.join(spans, "sku", "left").withColumn("live", F.coalesce(live, F.lit(False)))

    def latest(kind: str) -> F.Column:
        return F.max(F.when(F.col("live") & (F.col("kind") == kind) & F.col("new_price").isNotNull(), F.struct("start", "new_price"))).getField("new_price")

    day = met.groupBy("sku", "ds", "base_price").agg(
        latest("price_change_permanent").alias("permanent"),
        latest("price_change_temporary").alias("temporary"),
        F.greatest(F.max(F.when(F.col("live") & (F.col("kind") == "promotion"), F.col("pct"))), F.lit(0.0)).alias("discount_pct"),
    )
    price = F.round(F.coalesce("temporary", "permanent", "base_price") * (1 - F.coalesce("discount_pct", F.lit(0.0)) / 100) + 1e-9, 2)
    day = day.select("sku", "ds", price.alias("price"), F.coalesce("discount_pct", F.lit(0.0)).alias("discount_pct"))
    if bounds is None:
        return day
    held = F.when(F.col("lo").isNull(), F.col("price")).otherwise(F.least(F.greatest("price", "lo"), "hi"))
    return day.join(bounds, "sku", "left").select("sku", "ds", held.alias("price"), "discount_pct")


def future_multipliers(path: DataFrame, products: DataFrame) -> DataFrame:
    """(sku, ds, multiplier): the promotion's lift times the response to the day's price.

    path is scheduled_prices(); products has (sku, base_price, elasticity, lift, range_lo, range_hi), the range null where none is known.
    """
    known = products.withColumns({"lo": F.coalesce("range_lo", F.lit(0.0)), "hi": F.coalesce("range_hi", F.lit(1e12))})
    rows = path.join(known, "sku")
    response = F.expr(rules.price_response("elasticity", "base_price", "price", "greatest(lo, 1e-6)", "hi"))
    return rows.select("sku", "ds", (F.when(F.col("discount_pct") > 0, F.col("lift")).otherwise(1.0) * response).alias("multiplier"))


def apply_multipliers(forecast: DataFrame, multipliers: DataFrame, *columns: str) -> DataFrame:
    """Scales the point forecast and its bounds; days without a multiplier stay."""
    rows = forecast.join(multipliers, ["sku", "ds"], "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))
    return rows.withColumns({c: F.col(c) * F.col("multiplier") for c in columns}).drop("multiplier")


def price_events(live: DataFrame, first_day: str = "first_day", last_day: str = "last_day") -> DataFrame:
    """Events that a point of sale's prices imply: (sku, list_price, current_price, recorded_price, discount_from, discount_to) become changes and promotions.

    A list price that moved from the recorded one is a permanent change; a current price below the list price is a promotion for its window.
    """
    changed = live.where("list_price > 0 AND abs(list_price - recorded_price) > greatest(0.02, 0.005 * greatest(list_price, recorded_price))").select(
        "sku", F.lit("price_change_permanent").alias("kind"), F.col(first_day).alias("start"), F.lit(None).cast("date").alias("end"), F.col("list_price").alias("new_price"), F.lit(None).cast("double").alias("discount_pct")
    )
    off = F.round(100 * (1 - F.col("current_price") / F.col("list_price")) + 1e-9, 2)
    promoted = live.where("current_price > 0 AND current_price < list_price").select(
        "sku", F.lit("promotion").alias("kind"), F.greatest(F.coalesce("discount_from", first_day), F.col(first_day)).alias("start"), F.least(F.coalesce("discount_to", last_day), F.col(last_day)).alias("end"), F.lit(None).cast("double").alias("new_price"), off.alias("discount_pct")
    )
    return changed.unionByName(promoted.where("start <= end"))

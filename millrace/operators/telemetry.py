"""Stock readings: repeats, jumps and hours in stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The last reading speaks for this many hours.
CARRY_HOURS = 26
#: Hours of a day that readings must cover.
LEAST_HOURS = 12
#: Hours in stock, a tenth and 95% of 24, from which a day is partial and whole.  Hours are held against these: their 24th part may fall beside 0.1 and 0.95.
PARTIAL_HOURS, WHOLE_HOURS = 2.4, 22.8


def collapse(readings: DataFrame) -> DataFrame:
    """First and last of each run of equal levels; those between say nothing new."""
    order = Window.partitionBy("sku").orderBy("ts")
    same_before, same_after = (F.coalesce(f("on_hand").over(order) == F.col("on_hand"), F.lit(False)) for f in (F.lag, F.lead))
    return readings.withColumn("inside", same_before & same_after).where(~F.col("inside")).drop("inside")


def rises(readings: DataFrame, least: int = 3, zone: str = "UTC") -> DataFrame:
    """(sku, ts, day, before, after, gain): rises of `least` units or more from one reading to the next, on the store's day."""
    before = F.lag("on_hand").over(Window.partitionBy("sku").orderBy("ts"))
    rows = readings.withColumn("before", before).withColumn("gain", F.col("on_hand") - F.col("before")).where(F.col("gain") >= max(1, least))
    return rows.select("sku", "ts", local_day(F.col("ts"), zone).alias("day"), "before", F.col("on_hand").alias("after"), "gain")


def jumps(readings: DataFrame, least: int = 3) -> DataFrame:
    """(sku, ts, gain): rises of `least` units or more from one reading to the next."""
    return rises(readings, least).select("sku", "ts", "gain")


def local_day(ts: F.Column, zone: str) -> F.Column:
    """The store's day of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_start(day: F.Column, zone: str) -> F.Column:
    """The UTC instant at which a store's day starts."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def hours_in_stock(readings: DataFrame, zone: str = "UTC") -> DataFrame:
    """(sku, ds, covered, hours): per day of the store the seconds that readings cover, and the hours in stock scaled to 24.

    A reading holds until the next one, the last for CARRY_HOURS; stretches are cut at the store's midnight, a day has 24 hours from there, and days covered less than LEAST_HOURS left out.
    """
    second = F.unix_timestamp("ts")
    nxt = F.lead(second).over(Window.partitionBy("sku").orderBy("ts"))
    held = readings.select("sku", "on_hand", second.alias("a"), F.coalesce(nxt, second + CARRY_HOURS * 3600).alias("b")).where("b > a")
    day_of = lambda second: local_day(F.timestamp_seconds(second), zone)
    days = held.withColumn("ds", F.explode(F.sequence(day_of(F.col("a")), day_of(F.col("b") - 1)))).withColumn("start", F.unix_timestamp(day_start(F.col("ds"), zone)))
    share = F.greatest(F.least("b", F.col("start") + 86400) - F.greatest("a", "start"), F.lit(0))
    sums = days.withColumn("s", share).groupBy("sku", "ds").agg(F.sum("s").alias("covered"), F.sum(F.when(F.col("on_hand") > 0, F.col("s")).otherwise(0)).alias("stocked"))
    whole = sums.where(F.col("covered") >= LEAST_HOURS * 3600)
    return whole.select("sku", "ds", "covered", (24.0 * F.col("stocked") / F.col("covered")).alias("hours"))


def availability_series(hours: DataFrame, first: str, last: str) -> DataFrame:
    """(sku, ds, hours) for every product and day of a range, null where readings don't cover the day."""
    days = hours.select("sku").distinct().withColumn("ds", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    return days.join(hours.select("sku", "ds", "hours"), ["sku", "ds"], "left")


def demand_estimate(days: DataFrame) -> DataFrame:
    """Adds share, kind, estimate, is_floor and weight to (sku, ds, y, hours, closing).

    Under a tenth of the day in stock a day with sales is capped and one without unavailable; under 95% it is partial, and sales are scaled
    up to three times; a whole day that ended empty is capped.  Unknown hours count as a whole day, unknown closing stock as not empty.
    """
    share = F.least(F.greatest(F.coalesce(F.col("hours") / 24, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    rows = days.withColumn("share", share)
    empty = F.coalesce(F.col("closing") <= 0, F.lit(False))
    kind = F.when(F.col("hours") < PARTIAL_HOURS, F.when(F.col("y") > 0, "capped").otherwise("unavailable")).when(F.col("hours") < WHOLE_HOURS, "partial").when(empty, "capped").otherwise("normal")
    rows = rows.withColumn("kind", kind)
    partial, gone = F.col("kind") == "partial", F.col("kind") == "unavailable"
    estimate = F.when(partial, F.col("y") * F.least(F.lit(3.0), 1 / F.col("share"))).when(~gone, F.col("y"))
    weight = F.when(gone, 0.0).when(F.col("kind") == "capped", 0.5).when(partial, F.greatest(F.lit(0.1), F.col("share"))).otherwise(1.0)
    return rows.withColumns({"estimate": estimate, "is_floor": F.col("kind") != "normal", "weight": weight})


def demand_frame(days: DataFrame) -> DataFrame:
    """Training rows of demand in place of sales: (sku, ds, y, kind, weight) from (sku, ds, y, hours, closing).

    Without hours, an empty day without a sale after a day that closed empty had nothing to sell.  Unavailable days go, partial ones
    are scaled up, capped ones keep their sales as a floor.
    """
    before = F.lag("closing").over(Window.partitionBy("sku").orderBy("ds"))
    still_empty = F.col("hours").isNull() & (F.col("closing") <= 0) & (F.col("before") <= 0) & (F.col("y") <= 0)
    known = days.withColumn("before", before).withColumn("hours", F.when(still_empty, 0.0).otherwise(F.col("hours"))).drop("before")
    return demand_estimate(known).where("kind <> 'unavailable'").select("sku", "ds", F.col("estimate").alias("y"), "kind", "weight")


#: Days before and after its expected day in which a rise may be an order, the least likeness of sizes, and the weight of size against timing.
EARLY, LATE, LEAST_RATIO, SIZE_SHARE = 21, 60, 0.5, 0.75
#: A rise under this share of its order is a recount, one under so many days of sales a refund.
LEAST_SHARE, REFUND_DAYS = 0.15, 2.0


def order_matches(gains: DataFrame, orders: DataFrame) -> DataFrame:
    """(sku, ts, gain, order_id, qty, score) and the order's days: the open order that explains a rise of stock best.

    gains has (sku, ts, gain) and maybe (day), orders (sku, order_id, qty) and maybe (ordered, expected, received).  Received orders and those placed after the day are passed over.
    An order without an expected day counts from the day it was placed; with neither, the timing is perfect.  Size counts three times as much as
    timing; equal scores go to the smaller order number.
    """
    for name in ("ordered", "expected", "received"):
        if name not in orders.columns:
            orders = orders.withColumn(name, F.lit(None).cast("date"))
    gains = gains if "day" in gains.columns else gains.withColumn("day", F.to_date("ts"))
    open_ = orders.where("qty > 0 AND received IS NULL").select("sku", "order_id", "qty", "ordered", "expected")
    met = gains.join(open_, "sku").where("ordered IS NULL OR day >= ordered")
    late = F.datediff("day", F.coalesce("expected", "ordered"))
    met = met.withColumn("late", F.coalesce(late, F.lit(0))).where(F.col("late").between(-EARLY, LATE))
    ratio = F.least(F.col("gain"), F.col("qty")) / F.greatest(F.col("gain"), F.col("qty"))
    timing = 1 - F.least(F.abs("late") / float(LATE), F.lit(1.0))
    scored = met.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).withColumn("score", SIZE_SHARE * F.col("ratio") + (1 - SIZE_SHARE) * timing)
    best = F.row_number().over(Window.partitionBy("sku", "ts").orderBy(F.desc("score"), "order_id"))
    return scored.withColumn("r", best).where("r = 1").drop("r", "ratio", "late")


def arrivals(readings: DataFrame, orders: DataFrame, daily: DataFrame | None = None, least: int = 3, zone: str = "UTC") -> DataFrame:
    """(sku, order_id, arrived_on, ts, stock_before, stock_after, gain, qty, confidence, match, lead_days, days_late): rises that look like deliveries, for a person to confirm.

    Each rise goes to its best order first; then small parts of a large order fall out as recounts, and with daily rates (sku, rate) rises
    worth under REFUND_DAYS of sales as refunds, unless they are exactly the order.
    """
    found = order_matches(rises(readings, least, zone), orders).where(F.col("gain") >= F.greatest(F.lit(float(least)), LEAST_SHARE * F.col("qty")))
    if daily is not None:
        found = found.join(daily.select("sku", "rate"), "sku", "left").where((F.col("gain") == F.col("qty")) | F.coalesce(F.col("rate") <= 0, F.lit(True)) | (F.col("gain") >= REFUND_DAYS * F.col("rate")))
    match = F.when(F.col("gain") == F.col("qty"), "exact").when(F.col("gain") < F.col("qty"), "partial").otherwise("over")
    return found.select(
        "sku", "order_id", F.col("day").alias("arrived_on"), "ts", F.col("before").alias("stock_before"), F.col("after").alias("stock_after"), "gain", "qty", F.round(F.col("score") + 1e-9, 3).alias("confidence"),
        match.alias("match"), F.datediff("day", "ordered").alias("lead_days"), F.datediff("day", "expected").alias("days_late"),
    )


def units_sold_since(counts: DataFrame, daily: DataFrame, today: DataFrame) -> DataFrame:
    """(sku, units): closed days from the count's day on and today's units; counts has (sku, counted_on), today (sku, units)."""
    closed = daily.join(counts, "sku").where("ds >= counted_on").groupBy("sku").agg(F.sum("y").alias("closed"))
    rows = counts.join(closed, "sku", "left").join(today.withColumnRenamed("units", "open"), "sku", "left")
    return rows.select("sku", (F.coalesce("closed", F.lit(0.0)) + F.coalesce("open", F.lit(0.0))).alias("units"))


def share_after(hourly: DataFrame, least_days: int = 14) -> DataFrame:
    """(hour, share): the part of a day's units that sells from the hour on, over days (ds, hour, units); even under least_days days."""
    total = hourly.groupBy("ds").agg(F.sum("units").alias("total")).where("total > 0")
    days = F.broadcast(total.agg(F.count("*").alias("days")))
    part = hourly.join(total, "ds").groupBy("hour").agg(F.sum(F.col("units") / F.col("total")).alias("part"))
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    met = hours.join(part, "hour", "left").join(days).withColumn("part", F.coalesce("part", F.lit(0.0)) / F.col("days"))
    left = met.select(F.col("hour").alias("h"), "part")
    summed = met.select("hour", "days").join(F.broadcast(left), F.col("h") >= F.col("hour")).groupBy("hour", "days").agg(F.sum("part").alias("s"))
    return summed.select("hour", F.when(F.col("days") >= least_days, F.col("s")).otherwise((24 - F.col("hour")) / 24.0).alias("share"))


def latest(readings: DataFrame) -> DataFrame:
    """(sku, ts, on_hand): the newest reading of each product."""
    return readings.groupBy("sku").agg(F.max(F.struct("ts", "on_hand")).alias("r")).select("sku", "r.ts", "r.on_hand")


def coverage(readings: DataFrame) -> DataFrame:
    """(sku, first_ts, last_ts, samples)."""
    return readings.groupBy("sku").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("samples"))


def retain(readings: DataFrame, days: int = 120) -> DataFrame:
    """Readings of the last `days` before the newest of all, and of each product the newest older one, which opens the first day."""
    cutoff = readings.agg((F.max("ts") - F.expr(f"interval {days} days")).alias("cutoff"))
    marked = readings.join(F.broadcast(cutoff))
    anchor = marked.where("ts < cutoff").groupBy("sku").agg(F.max(F.struct("ts", "on_hand")).alias("r")).select("sku", "r.ts", "r.on_hand")
    return marked.where("ts >= cutoff").select("sku", "ts", "on_hand").union(anchor)


def state(readings: DataFrame, zone: str = "UTC") -> DataFrame:
    """(sku, level, state, readings_today, went_out_today, out_since); today is the store's day of the newest reading of all.

    out_since is the first reading of the run of empty ones that still lasts.
    """
    today = readings.agg(local_day(F.max("ts"), zone).alias("today"))
    on_day = local_day(F.col("ts"), zone) == F.col("today")
    filled = readings.join(F.broadcast(today)).withColumn("last_filled", F.max(F.when(F.col("on_hand") > 0, F.col("ts"))).over(Window.partitionBy("sku")))
    rows = filled.groupBy("sku").agg(
        F.max(F.struct("ts", "on_hand")).getField("on_hand").alias("level"),
        F.count_if(on_day).alias("readings_today"),
        F.coalesce(F.bool_or(on_day & (F.col("on_hand") <= 0)), F.lit(False)).alias("went_out_today"),
        F.min(F.when(F.col("last_filled").isNull() | (F.col("ts") > F.col("last_filled")), F.col("ts"))).alias("out_since"),
    )
    return rows.withColumn("state", F.when(F.col("level") <= 0, "out").otherwise("in"))


def censoring_summary(estimated: DataFrame) -> DataFrame:
    """(sku, days, normal, capped, partial, unavailable, observed, censored_share, hidden_units, understated_pct) of demand_estimate()."""
    kinds = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("normal", "capped", "partial", "unavailable")}
    rows = estimated.groupBy("sku").agg(F.count("*").alias("days"), *kinds.values(), F.sum("y").alias("observed"), F.coalesce(F.sum("estimate"), F.lit(0.0)).alias("estimated"))
    hidden = F.col("estimated") - F.col("observed")
    return rows.select(
        "sku",
        "days",
        *kinds,
        "observed",
        (100.0 * (F.col("days") - F.col("normal")) / F.col("days")).alias("censored_share"),
        hidden.alias("hidden_units"),
        F.when(F.col("observed") > 0, 100 * hidden / F.col("observed")).alias("understated_pct"),
    )

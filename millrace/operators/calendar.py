"""Daily rollups, continuous calendars and days that must not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prices within this distance or this share of the larger are the same price.
SAME_PRICE = (0.02, 0.005)
#: Half cents go up, whatever their binary form.
HALF_CENT_NUDGE = 1e-7
#: The dominant price needs this share of a day's units.
DOMINANT_SHARE = 0.80


def daily_sales(lines: DataFrame) -> DataFrame:
    """(sku, ds, y, promo_units, n_lines)."""
    return lines.groupBy("sku", "ds").agg(
        F.sum("units").alias("y"), F.sum(F.col("units") * F.col("on_promotion")).alias("promo_units"), F.count("*").alias("n_lines")
    )


def daily_price_rollup(lines: DataFrame) -> DataFrame:
    """(sku, ds, y, price, price_mixed, on_promotion).

    Prices in cents are aggregated first, so that the window over a day sees one row per price.  The price with most units is
    the top one, the lower on a tie.
    """
    cents = lines.groupBy("sku", "ds", F.round(F.col("price") + HALF_CENT_NUDGE, 2).alias("p")).agg(
        F.sum("units").alias("u"), F.sum(F.col("units") * F.col("on_promotion")).alias("pu"), F.max("on_promotion").alias("any_promo")
    )
    tops = cents.groupBy("sku", "ds").agg(F.max(F.struct("u", -F.col("p"))).alias("best"))
    tops = tops.select("sku", "ds", (-F.col("best.col2")).alias("top"))
    fixed, share = SAME_PRICE
    same = F.abs(F.col("p") - F.col("top")) <= F.greatest(F.lit(fixed), share * F.greatest("p", "top"))
    day = cents.join(tops, ["sku", "ds"]).withColumn("same", same).groupBy("sku", "ds").agg(
        F.sum("u").alias("y"),
        F.sum(F.when(F.col("same"), F.col("u")).otherwise(0.0)).alias("su"),
        F.sum(F.when(F.col("same"), F.col("u") * F.col("p")).otherwise(0.0)).alias("sr"),
        F.sum(F.when(F.col("same"), F.col("pu")).otherwise(0.0)).alias("sp"),
        F.sum(F.col("u") * F.col("p")).alias("r"),
        F.max("any_promo").alias("any_promo"),
    )
    clear = F.col("su") >= DOMINANT_SHARE * F.col("y")
    return day.select(
        "sku",
        "ds",
        "y",
        F.when(clear, F.col("sr") / F.col("su")).otherwise(F.col("r") / F.col("y")).alias("price"),
        F.when(clear, 0).otherwise(1).alias("price_mixed"),
        F.when(clear, (2 * F.col("sp") > F.col("su")).cast("int")).otherwise(F.col("any_promo")).alias("on_promotion"),
    )


def fill_calendar(daily: DataFrame) -> DataFrame:
    """A row per product and day from its first sale to the last day of all; y is 0 where nothing sold.

    A price column is carried forward from unmixed days, then back to days before the first.
    """
    end = daily.agg(F.max("ds").alias("end"))
    span = daily.groupBy("sku").agg(F.min("ds").alias("start")).join(F.broadcast(end))
    days = span.select("sku", F.explode(F.sequence("start", "end")).alias("ds"))
    filled = days.join(daily, ["sku", "ds"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    if "price" in daily.columns:
        pure = F.when(F.coalesce("price_mixed", F.lit(0)) == 0, F.col("price"))
        forward = F.last(pure, ignorenulls=True).over(Window.partitionBy("sku").orderBy("ds"))
        back = F.first(pure, ignorenulls=True).over(Window.partitionBy("sku").orderBy("ds").rowsBetween(0, Window.unboundedFollowing))
        filled = filled.withColumn("price", F.coalesce("price", forward, back))
    for name in ("promo_units", "n_lines", "on_promotion", "price_mixed"):
        if name in daily.columns:
            filled = filled.withColumn(name, F.coalesce(name, F.lit(0)))
    return filled


def store_zero_days(daily: DataFrame) -> DataFrame:
    """Days on which nothing sold with 3 products or more on file, in a store of 3 products and a median day of 5 units or more."""
    filled = fill_calendar(daily)
    days = filled.groupBy("ds").agg(F.sum("y").alias("units"), F.count("*").alias("on_file"))
    store = days.agg(F.median("units").alias("typical")).crossJoin(daily.agg(F.count_distinct("sku").alias("products")))
    return days.join(F.broadcast(store)).where("units = 0 and on_file >= 3 and products >= 3 and typical >= 5").select("ds", "on_file")


def hold_out_promotions(filled: DataFrame, promo: F.Column) -> DataFrame:
    """Rows off promotion; all rows of a product with over 40% promotion days or with fewer than 45 days left."""
    counts = filled.groupBy("sku").agg(F.count("*").alias("n"), F.sum(promo.cast("int")).alias("n_promo"))
    keep_all = (F.col("n_promo") > 0.4 * F.col("n")) | (F.col("n") - F.col("n_promo") < 45)
    return filled.join(counts, "sku").where(keep_all | ~promo).drop("n", "n_promo")


def without_closed_days(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows on days that `closed` (ds) doesn't list."""
    return rows.join(closed.select("ds").distinct(), "ds", "left_anti")


def closed_days(dates: DataFrame, yearly: DataFrame, first: str, last: str) -> DataFrame:
    """(ds): single dates (ds) and yearly rules (month, day) within a range; 29 February is left out of other years."""
    years = yearly.withColumn("year", F.explode(F.sequence(F.year(F.lit(first).cast("date")), F.year(F.lit(last).cast("date")))))
    every = years.select(F.expr("try_make_timestamp(year, month, day, 0, 0, 0)").cast("date").alias("ds")).union(dates.select("ds"))
    return every.where(F.col("ds").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).distinct()


def zero_closed_days(forecast: DataFrame, closed: DataFrame, *columns: str) -> DataFrame:
    """A forecast with nothing sold on closed days."""
    shut = closed.select("ds", F.lit(True).alias("shut")).distinct()
    rows = forecast.join(shut, "ds", "left")
    return rows.withColumns({c: F.when(F.col("shut"), 0.0).otherwise(F.col(c)) for c in columns}).drop("shut")


def reanchored(rows: DataFrame, newest: F.Column) -> DataFrame:
    """All days moved so that the newest is `newest`; `shift` undoes it."""
    end = F.broadcast(rows.agg(F.max("ds").alias("end")))
    moved = rows.join(end).withColumn("shift", F.datediff(newest, "end"))
    return moved.withColumn("ds", F.expr("date_add(ds, shift)")).drop("end")


def true_days(rows: DataFrame) -> DataFrame:
    """The days of reanchored() rows as they were."""
    return rows.withColumn("ds", F.expr("date_sub(ds, shift)")).drop("shift")


def scoreable_days(estimated: DataFrame) -> DataFrame:
    """Days that may be graded: all but those on which nothing could be sold."""
    return estimated.where("kind <> 'unavailable'")


def from_day(forecast: DataFrame, day: F.Column) -> DataFrame:
    """A forecast from a day on; products whose forecast ends before it keep all of theirs."""
    last = forecast.groupBy("sku").agg(F.max("ds").alias("last"))
    return forecast.join(last, "sku").where((F.col("ds") >= day) | (F.col("last") < day)).drop("last")

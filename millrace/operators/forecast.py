"""Forecasts in closed form and the spread of their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Smoothing with a half-life of ten days.
LEVEL_WEIGHT = 1 - 0.5**0.1
#: Smoothing of sizes and chances of sparse demand.
SIZE_WEIGHT, CHANCE_WEIGHT = 0.1, 0.1


def aged(filled: DataFrame) -> DataFrame:
    """Adds `age`, days before the product's last day."""
    return filled.withColumn("age", F.datediff(F.max("ds").over(Window.partitionBy("sku")), "ds"))


def weekday_profile(filled: DataFrame, days: int = 56) -> DataFrame:
    """(sku, weekday, profile): 1 + (weekday mean / mean - 1) n / (n + 20) over the last days, brought to mean 1; n counts units."""
    recent = aged(filled).where(F.col("age") < days)
    total = recent.groupBy("sku").agg(F.avg("y").alias("mean"), F.sum("y").alias("n")).where("mean > 0")
    by_day = recent.groupBy("sku", F.dayofweek("ds").alias("weekday")).agg(F.avg("y").alias("m"))
    raw = by_day.join(total, "sku").select("sku", "weekday", (1 + (F.col("m") / F.col("mean") - 1) * F.col("n") / (F.col("n") + 20)).alias("p"))
    return raw.select("sku", "weekday", (F.col("p") / F.avg("p").over(Window.partitionBy("sku"))).alias("profile"))


def recent_level(filled: DataFrame) -> DataFrame:
    """(sku, level): y over its weekday's profile, smoothed from the mean of the first 28 days on.

    The recursion l = l + a (z - l) is the sum of a (1-a)^age z plus (1-a)^n times its start.
    """
    z = aged(filled).withColumn("weekday", F.dayofweek("ds")).join(weekday_profile(filled), ["sku", "weekday"]).withColumn("z", F.col("y") / F.col("profile"))
    first = F.row_number().over(Window.partitionBy("sku").orderBy("ds"))
    a = LEVEL_WEIGHT
    return z.withColumn("i", first).groupBy("sku").agg(
        (F.sum(a * F.pow(F.lit(1 - a), F.col("age")) * F.col("z")) + F.pow(F.lit(1 - a), F.count("*")) * F.avg(F.when(F.col("i") <= 28, F.col("z")))).alias("level")
    )


def moving_average(filled: DataFrame, days: int = 28) -> DataFrame:
    return aged(filled).where(F.col("age") < days).groupBy("sku").agg(F.avg("y").alias("level"))


def sparse_demand(filled: DataFrame) -> DataFrame:
    """(sku, size, interval, classic, corrected): Croston's rate and its bias-corrected form, from smoothed sizes and intervals.

    Both start at their first value: (1-a)^(n-1) x_1 plus the sum of a (1-a)^(n-i) x_i.
    """
    day = F.datediff("ds", F.lit("1970-01-01"))
    order = Window.partitionBy("sku").orderBy("ds")
    start = F.min(day).over(Window.partitionBy("sku"))
    sales = filled.withColumn("d", day).withColumn("start", start).where("y > 0")
    sales = sales.withColumn("gap", F.col("d") - F.coalesce(F.lag("d").over(order), F.col("start") - 1))
    placed = sales.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("sku")))
    a = SIZE_WEIGHT
    weight = F.when(F.col("i") == 1, 1.0).otherwise(a) * F.pow(F.lit(1 - a), F.col("n") - F.col("i"))
    rates = placed.groupBy("sku").agg(F.sum(weight * F.col("y")).alias("size"), F.sum(weight * F.col("gap")).alias("interval"))
    classic = F.col("size") / F.col("interval")
    return rates.select("sku", "size", "interval", classic.alias("classic"), ((1 - a / 2) * classic).alias("corrected"))


def lead_window_sigma(residuals: DataFrame, lead: int) -> DataFrame:
    """(sku, sigma): deviation of the sums of `lead` errors in a row; residuals has (sku, ds, err), windows need lead + 5 errors."""
    frame = Window.partitionBy("sku").orderBy("ds").rowsBetween(-(lead - 1), 0)
    sums = residuals.select("sku", F.sum("err").over(frame).alias("s"), F.count("err").over(frame).alias("n"))
    whole = sums.where(F.col("n") == lead)
    return whole.groupBy("sku").agg(F.stddev_samp("s").alias("sigma"), F.count("*").alias("k")).where("k >= 6").drop("k")


def conformal_offsets(residuals: DataFrame) -> DataFrame:
    """(sku, lower, upper): the 10th and 90th percentile of errors if there are 8, else 1.2816 deviations."""
    stats = residuals.groupBy("sku").agg(
        F.count("err").alias("n"), F.expr("percentile(err, 0.1)").alias("p10"), F.expr("percentile(err, 0.9)").alias("p90"), F.stddev_samp("err").alias("sd")
    )
    few = F.col("n") < 8
    return stats.select("sku", F.when(few, -1.2816 * F.col("sd")).otherwise(F.col("p10")).alias("lower"), F.when(few, 1.2816 * F.col("sd")).otherwise(F.col("p90")).alias("upper"))

"""Growth, read from months and divided out before a season is read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A month counts from this many days on; growth and season part once this many calendar months recur.
MONTH_DAYS, REPEATED_MONTHS = 10, 2
#: Rows and months that a slope needs, and its bound: four times a year.
LEAST_ROWS, LEAST_MONTHS, STEEPEST = 60, 4, math.log(4.0)


def slope(rows: DataFrame, short_history: bool = True) -> DataFrame:
    """(sku, start, slope, basis): yearly log growth of each product of (sku, ds, y).

    Weighted least squares on month means; with REPEATED_MONTHS calendar months seen in two years each calendar month has its own level,
    which comes to a regression on what differs from the month's weighted means.  Shorter histories take a straight line, or none.
    """
    span = rows.groupBy("sku").agg(F.min("ds").alias("start"), F.avg("y").alias("mean"), F.count("y").alias("rows"))
    months = rows.groupBy("sku", F.trunc("ds", "month").alias("first_day")).agg(F.count("y").alias("w"), F.avg("y").alias("m")).where(F.col("w") >= MONTH_DAYS)
    points = months.join(span, "sku").select(
        "sku",
        F.month("first_day").alias("month"),
        F.col("w").cast("double").alias("w"),
        (F.datediff(F.date_add("first_day", 14), "start") / 365.25).alias("x"),
        F.log(F.greatest("m", F.lit(0.0)) + 0.1 * F.col("mean") + 1e-6).alias("z"),
    )

    def regression(*keys: str) -> DataFrame:
        w, x, z = F.col("w"), F.col("x"), F.col("z")
        sums = points.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * z).alias("sz"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * z).alias("sxz"))
        return sums.withColumns({"num": F.col("sxz") - F.col("sx") * F.col("sz") / F.col("sw"), "den": F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")})

    within = regression("sku", "month").groupBy("sku").agg(
        F.sum("k").alias("months"), F.count_if(F.col("k") >= 2).alias("repeated"), F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("sw").alias("sw"),
        F.sum("sx").alias("sx"), F.sum("sz").alias("sz"), F.sum("sxx").alias("sxx"), F.sum("sxz").alias("sxz"),
    )
    line = (F.col("sxz") - F.col("sx") * F.col("sz") / F.col("sw")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"))
    seasonal = F.col("repeated") >= REPEATED_MONTHS
    enough = (F.col("rows") >= LEAST_ROWS) & (F.coalesce("months", F.lit(0)) >= LEAST_MONTHS)
    basis = F.when(~enough, "none").when(seasonal, "seasonal-fit").otherwise("linear" if short_history else "none")
    found = span.join(within, "sku", "left").withColumn("basis", basis)
    raw = F.when(F.col("basis") == "seasonal-fit", F.col("num") / F.col("den")).when(F.col("basis") == "linear", line).otherwise(0.0)
    return found.select("sku", "start", F.least(F.greatest(raw, F.lit(-STEEPEST)), F.lit(STEEPEST)).alias("slope"), "basis")


def factors(rows: DataFrame, short_history: bool = True) -> DataFrame:
    """Rows with `factor`, the growth of each day, of mean 1 over the product's rows."""
    grown = rows.join(slope(rows, short_history).drop("basis"), "sku").withColumn("f", F.exp(F.col("slope") * F.datediff("ds", "start") / 365.25))
    means = grown.groupBy("sku").agg(F.avg("f").alias("f_mean"))
    return grown.join(means, "sku").withColumn("factor", F.col("f") / F.col("f_mean")).drop("f", "f_mean", "slope", "start")


def detrend(rows: DataFrame, short_history: bool = True) -> DataFrame:
    """Rows with growth divided out of y; the average level stays about where it was."""
    return factors(rows, short_history).withColumn("y", F.col("y") / F.col("factor")).drop("factor")

"""Forecasts sealed before their window, revised while it is open, and graded after it.

A log row is (store, sku, origin, horizon_days, predicted, lo, hi, band, created_at, count_from, daily) and, once graded, (actual, scored_at);
`daily` is an array of (ds, yhat).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules

KEYS = ("store", "sku", "origin", "horizon_days")


def period_origin(day: F.Column, cadence: str = "weekly") -> F.Column:
    """The Sunday on or before a day, or the first of its month."""
    return F.trunc(day, "month") if cadence == "monthly" else F.date_sub(day, F.dayofweek(day) - 1)


def sealed(forecasts: DataFrame) -> DataFrame:
    """Adds id, due_at (the last day counted), gradable_from and days_counted; count_from lies in the window."""
    due = F.expr("date_add(origin, horizon_days - 1)")
    rows = forecasts.withColumn("due_at", due).withColumn("count_from", F.greatest("origin", F.least(F.coalesce("count_from", "origin"), "due_at")))
    return rows.withColumns(
        {
            "id": F.concat_ws("|", F.coalesce("store", F.lit("sheets")), "sku", F.col("origin").cast("string"), F.col("horizon_days").cast("string")),
            "gradable_from": F.date_add("due_at", 1),
            "days_counted": F.datediff("due_at", "count_from") + 1,
        }
    )


def snapshot(log: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The log with the forecasts of periods that it doesn't hold yet; what is sealed stays as it is."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEYS]
    fresh = forecasts.alias("n").join(log.select(*KEYS).distinct().alias("o"), same, "left_anti")
    return log.unionByName(fresh.select("n.*"), allowMissingColumns=True)


def dedupe(log: DataFrame) -> DataFrame:
    """One row per store, product, origin and horizon: a graded one, else that sealed first."""
    order = Window.partitionBy(*KEYS).orderBy(F.col("scored_at").isNull(), "created_at", "predicted")
    return log.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")


def amend(log: DataFrame, changes: DataFrame) -> DataFrame:
    """New predictions for rows not yet graded; changes has (id, new_predicted, reason), one row to an id.

    What was sealed first stays in `original`, and a row once amended stays marked, however often it or others are amended later.
    """
    for name, kind in (("original", "double"), ("amended", "boolean"), ("amend_reason", "string")):
        if name not in log.columns:
            log = log.withColumn(name, F.lit(None).cast(kind))
    met = log.join(changes, "id", "left")
    open_ = F.col("new_predicted").isNotNull() & F.col("scored_at").isNull()
    return met.withColumns(
        {
            "original": F.coalesce("original", F.when(open_, F.col("predicted"))),
            "amended": F.coalesce("amended", F.lit(False)) | open_,
            "amend_reason": F.when(open_, F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("revised"))).otherwise(F.col("amend_reason")),
            "predicted": F.when(open_, F.round("new_predicted", 2)).otherwise(F.col("predicted")),
        }
    ).drop("new_predicted", "reason")


def revise_days(log: DataFrame, factors: DataFrame) -> DataFrame:
    """Open rows with chosen days scaled; factors has (sku, ds, factor), those of one day multiplied.  The prediction moves by what its days moved, the band with it."""
    by_day = factors.groupBy("sku", "ds").agg(F.product("factor").alias("factor"))
    by_sku = by_day.groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("ds", "factor"))).alias("by_day"))
    met = log.join(by_sku, "sku", "left")
    scaled = F.transform("daily", lambda d: F.struct(d["ds"].alias("ds"), (d["yhat"] * F.coalesce(F.try_element_at("by_day", d["ds"]), F.lit(1.0))).alias("yhat")))
    open_ = F.col("scored_at").isNull() & F.col("by_day").isNotNull()
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, d: acc + d["yhat"])
    rows = met.withColumn("revised", F.when(open_, scaled).otherwise(F.col("daily")))
    shift = total("revised") - total("daily")
    return rows.withColumns({c: F.greatest(F.col(c) + F.coalesce(shift, F.lit(0.0)), F.lit(0.0)) for c in ("predicted", "lo", "hi")}).withColumn("daily", F.col("revised")).drop("revised", "by_day")


def score_due(log: DataFrame, actuals: DataFrame, today: F.Column) -> DataFrame:
    """The log with every closed window graded; actuals has (sku, ds, y).  Days before count_from don't count, graded rows stay."""
    due = log.where(F.col("scored_at").isNull() & (today > F.col("due_at"))).select("id", "sku", F.explode(F.sequence("count_from", "due_at")).alias("ds"))
    units = due.join(actuals.select("sku", "ds", "y"), ["sku", "ds"], "left").groupBy("id").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("units"))
    met = log.join(units, "id", "left")
    return met.withColumns({"actual": F.coalesce("actual", "units"), "scored_at": F.coalesce("scored_at", F.when(F.col("units").isNotNull(), today))}).drop("units")


def graded(log: DataFrame) -> DataFrame:
    """Scored rows with signed_err, abs_err, pct_err, in_band and band_z."""
    rows = log.where(F.col("scored_at").isNotNull()).withColumn("signed_err", F.col("predicted") - F.col("actual"))
    rows = rows.withColumn("abs_err", F.abs("signed_err")).withColumn("pct_err", F.when(F.col("actual") != 0, 100 * F.col("abs_err") / F.col("actual")))
    return rules.with_rules(rows.withColumn("in_band", (F.col("lo") <= F.col("actual")) & (F.col("actual") <= F.col("hi"))), band_z=rules.BAND_Z)


def record(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, units, wape, bias, mean_abs_err, cal_n, hits, hit_rate, nominal, gap, se, verdict): volume-weighted error, and whether bands held what they promised."""
    banded = F.col("in_band").isNotNull()
    sums = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("actual").alias("units"), F.sum("abs_err").alias("abs"), F.sum("signed_err").alias("signed"),
        F.count_if(banded).alias("cal_n"), F.count_if("in_band").alias("hits"), F.avg(F.when(banded, F.col("band"))).alias("nominal"),
    )
    sold = F.col("units") > 0
    rows = sums.withColumns(
        {
            "wape": F.when(sold, 100 * F.col("abs") / F.col("units")),
            "bias": F.when(sold, 100 * F.col("signed") / F.col("units")),
            "mean_abs_err": F.col("abs") / F.col("n"),
            "hit_rate": F.when(F.col("cal_n") > 0, 100.0 * F.col("hits") / F.col("cal_n")),
        }
    )
    rows = rows.withColumn("gap", F.col("hit_rate") - F.col("nominal")).withColumn("se", F.sqrt(F.greatest("nominal", F.lit(1e-9)) * (100 - F.col("nominal")) / F.col("cal_n")))
    verdict = F.expr(rules.CALIBRATION_VERDICT.replace("n < 10", "cal_n < 10"))
    return rows.withColumn("verdict", F.when(F.col("cal_n") == 0, "no-data").otherwise(verdict)).drop("abs", "signed")


def week_tiles(log: DataFrame, today: F.Column) -> DataFrame:
    """(origin, ends_on, products, scored, due, amended, predicted, predicted_scored, actual, in_band, status) per week."""
    done = F.col("scored_at").isNotNull()
    inside = (F.col("lo") <= F.col("actual")) & (F.col("actual") <= F.col("hi"))
    open_due = ~done & (today > F.col("due_at"))
    rows = log.groupBy("origin").agg(
        F.max("due_at").alias("ends_on"), F.count("*").alias("products"), F.count_if(done).alias("scored"), F.count_if(open_due).alias("due"), F.count_if("amended").alias("amended"),
        F.sum("predicted").alias("predicted"), F.sum(F.when(done, F.col("predicted"))).alias("predicted_scored"), F.sum(F.when(done, F.col("actual"))).alias("actual"), F.count_if(done & inside).alias("in_band"),
    )
    status = F.when((F.col("scored") > 0) & (F.col("scored") == F.col("products")), "scored").when(F.col("scored") > 0, "partial").when(F.col("due") > 0, "due").otherwise("open")
    return rows.withColumn("status", status)


def week_grade(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, in_rate, median_z, bias_z, nominal, verdict): how often actuals fell inside, and how near the middle."""
    rows = scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(100.0 * F.count_if("in_band") / F.when(F.count("in_band") > 0, F.count("in_band"))).alias("in_rate"),
        F.median(F.abs("band_z")).alias("median_z"),
        F.median("band_z").alias("bias_z"),
        F.max("band").cast("double").alias("nominal"),
    )
    return rules.with_rules(rows, verdict=rules.WEEK_VERDICT)


def window_units(windows: DataFrame, daily: DataFrame) -> DataFrame:
    """(sku, start, end, units) of closed intervals (sku, start, end)."""
    days = windows.withColumn("ds", F.explode(F.sequence("start", "end")))
    return days.join(daily.select("sku", "ds", "y"), ["sku", "ds"], "left").groupBy("sku", "start", "end").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("units"))

"""Seasonal shapes: indices by month and weekday, their likeness, growth and rush weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import trend

#: Least strength of a season that is acted on.
LEAST_STRENGTH = 0.15
#: Days compared with the same days of past years, and units that shrink a growth by half.
GROWTH_DAYS, GROWTH_UNITS, YEAR_DAYS, MOST_YEARS = 182, 30, 364, 3


def _settle(index: DataFrame) -> DataFrame:
    """Brings indices to mean 1 and into [0.25, 4] in turn until both hold nearly."""
    every_month = Window.partitionBy("sku")
    for _ in range(4):
        index = index.withColumn("index", F.col("index") / F.avg("index").over(every_month))
        index = index.withColumn("index", F.least(F.greatest("index", F.lit(0.25)), F.lit(4.0)))
    return index


def monthly_index(filled: DataFrame, least_rows: int = 330, least_days: int = 8, least_months: int = 8, shrink: bool = True) -> DataFrame:
    """(sku, month, index): detrended month mean over the mean of the months covered, shrunk by years on file."""
    span = filled.groupBy("sku").agg(F.count("*").alias("rows"))
    level = trend.detrend(filled.select("sku", "ds", "y"), short_history=False)
    months = level.groupBy("sku", F.month("ds").alias("month")).agg(F.avg("y").alias("m"), F.sum("y").alias("total"), F.count("*").alias("d")).where(F.col("d") >= least_days)
    known = months.groupBy("sku").agg(F.count("*").alias("n_months"), (F.sum("total") / F.sum("d")).alias("mean")).where(F.col("n_months") >= least_months)
    grid = span.where(F.col("rows") >= least_rows).join(known.where("mean > 0"), "sku")
    grid = grid.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(months.select("sku", "month", "m"), ["sku", "month"], "left")
    years = F.col("rows") / 365.0
    raw = F.coalesce(F.col("m") / F.col("mean"), F.lit(1.0))
    return _settle(grid.select("sku", "month", (1 + (raw - 1) * (years / (years + 1) if shrink else F.lit(1.0))).alias("index")))


def index_strength(index: DataFrame) -> DataFrame:
    """(sku, strength, used): half the range; below LEAST_STRENGTH an index isn't used."""
    return index.groupBy("sku").agg(((F.max("index") - F.min("index")) / 2).alias("strength")).withColumn("used", F.col("strength") >= LEAST_STRENGTH)


def cohort_index(unshrunk: DataFrame, keys: DataFrame) -> DataFrame:
    """(category, month, index): the mean of two members' unshrunk indices or more."""
    mean = unshrunk.join(keys, "sku").groupBy("category", "month").agg(F.avg("index").alias("index"), F.count("*").alias("peers")).where("peers >= 2")
    return _settle(mean.select(F.col("category").alias("sku"), "month", "index")).withColumnRenamed("sku", "category")


def resolved_index(own: DataFrame, cohort: DataFrame, keys: DataFrame) -> DataFrame:
    """(sku, month, index, source): the own index where strong enough, else the category's, else flat."""
    strong_own = own.join(index_strength(own).where("used").select("sku"), "sku", "left_semi").withColumn("source", F.lit("own"))
    as_sku = cohort.withColumnRenamed("category", "sku")
    strong = as_sku.join(index_strength(as_sku).where("used").select("sku"), "sku", "left_semi").withColumnRenamed("sku", "category")
    grid = keys.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    joined = grid.join(strong_own, ["sku", "month"], "left").join(strong.withColumnRenamed("index", "shared"), ["category", "month"], "left")
    source = F.when(F.col("source").isNotNull(), F.col("source")).when(F.col("shared").isNotNull(), "cohort").otherwise("none")
    return joined.select("sku", "month", F.coalesce("index", "shared", F.lit(1.0)).alias("index"), source.alias("source"))


def coverage_factor(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(sku, coverage): the average index of the days that a rate was measured on."""
    return rows.withColumn("month", F.month("ds")).join(index, ["sku", "month"]).groupBy("sku").agg(F.avg("index").alias("coverage"))


def month_multipliers(days: DataFrame, index: DataFrame, coverage: DataFrame) -> DataFrame:
    """(sku, ds, multiplier) for days (sku, ds): index over coverage, 1 where the season is too weak."""
    used = index.join(index_strength(index).where("used").select("sku"), "sku", "left_semi")
    met = days.withColumn("month", F.month("ds")).join(used, ["sku", "month"], "left").join(coverage, "sku", "left")
    cov = F.when(F.col("coverage") > 0, F.col("coverage")).otherwise(1.0)
    return met.select("sku", "ds", F.coalesce(F.col("index") / cov, F.lit(1.0)).alias("multiplier"))


def daily_index(days: DataFrame, index: DataFrame) -> DataFrame:
    """(sku, ds, index): month indices stand at the 15th, days between lie on the line from one to the next."""
    later = F.dayofmonth("ds") >= 15
    this = F.date_add(F.trunc("ds", "month"), 14)
    a, b = F.when(later, this).otherwise(F.add_months(this, -1)), F.when(later, F.add_months(this, 1)).otherwise(this)
    placed = days.withColumns({"a": a, "b": b})
    at = lambda name, out: index.select("sku", F.col("month").alias(f"m_{name}"), F.col("index").alias(out))
    met = placed.withColumns({"m_a": F.month("a"), "m_b": F.month("b")}).join(at("a", "i_a"), ["sku", "m_a"]).join(at("b", "i_b"), ["sku", "m_b"])
    share = F.datediff("ds", "a") / F.datediff("b", "a")
    return met.select("sku", "ds", F.greatest(F.col("i_a") * (1 - share) + F.col("i_b") * share, F.lit(1e-6)).alias("index"))


def signature(filled: DataFrame, least_rows: int = 120) -> DataFrame:
    """(sku, slot, value): detrended mean of y over its overall mean by weekday (slots 1 to 7, Sunday first) and month (slots 8 to 19)."""
    long = filled.groupBy("sku").agg(F.count("*").alias("rows")).where(F.col("rows") >= least_rows).select("sku")
    level = trend.detrend(filled.select("sku", "ds", "y").join(long, "sku", "left_semi"))
    means = level.groupBy("sku").agg(F.avg("y").alias("mean"))
    ratio = level.join(means, "sku").withColumn("ratio", F.col("y") / F.when(F.col("mean") != 0, F.col("mean")).otherwise(1.0))
    slots = ratio.select("sku", "ratio", F.explode(F.array(F.dayofweek("ds"), F.month("ds") + 7)).alias("slot"))
    return slots.groupBy("sku", "slot").agg(F.avg("ratio").alias("value"))


def shape_links(signatures: DataFrame, keys: DataFrame, least: float = 0.35) -> DataFrame:
    """(category, a, b, likeness, linked): correlation of two members' signatures less the catalogue's mean.

    keys has (sku, category); members meet on category and slot, and correlation is an aggregate of sums.  Under five joint months nothing
    can be said (0); two flat signatures are alike (1), a flat one is like no other (0).
    """
    base = signatures.groupBy("slot").agg(F.avg("value").alias("base"))
    own = signatures.join(F.broadcast(base), "slot").join(keys, "sku").select("category", "sku", "slot", (F.col("value") - F.col("base")).alias("v"))
    other = own.select("category", "slot", F.col("sku").alias("b"), F.col("v").alias("w"))
    pairs = own.withColumnRenamed("sku", "a").join(other, ["category", "slot"]).where("a < b")
    months = F.sum((F.col("slot") > 7).cast("int"))
    found = pairs.groupBy("category", "a", "b").agg(
        F.corr("v", "w").alias("r"), months.alias("months"), F.count("*").alias("slots"), (F.stddev_pop("v") < 1e-9).alias("flat_a"), (F.stddev_pop("w") < 1e-9).alias("flat_b")
    )
    alike = F.when(F.col("flat_a") & F.col("flat_b"), 1.0).when(F.col("flat_a") | F.col("flat_b"), 0.0).otherwise(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))
    likeness = F.when((F.col("months") >= 5) & (F.col("slots") >= 3), alike).otherwise(0.0)
    return found.select("category", "a", "b", likeness.alias("likeness"), (likeness >= least).alias("linked"))


def cohesion(links: DataFrame) -> DataFrame:
    """(category, pairs, cohesion, weakest): mean and least likeness of a category's pairs."""
    return links.groupBy("category").agg(F.count("*").alias("pairs"), F.avg("likeness").alias("cohesion"), F.min("likeness").alias("weakest"))


def year_on_year(filled: DataFrame, years_back: int = 1) -> DataFrame:
    """(sku, growth): mean of the last GROWTH_DAYS over that of the same days years_back times 364 earlier.

    The log of the ratio is shrunk by n / (n + GROWTH_UNITS), n the lesser side's units; it lies within a third and three.
    Products with fewer than 20 rows on either side are left out; nothing sold then means no growth (1).
    """
    off = YEAR_DAYS * years_back
    last = filled.groupBy("sku").agg(F.max("ds").alias("end"))
    rows = filled.join(last, "sku").withColumn("age", F.datediff("end", "ds"))
    now, then = F.col("age") < GROWTH_DAYS, (F.col("age") >= off) & (F.col("age") < off + GROWTH_DAYS)
    sums = rows.groupBy("sku").agg(
        F.count_if(now).alias("n_now"), F.count_if(then).alias("n_then"), F.coalesce(F.sum(F.when(now, F.col("y"))), F.lit(0.0)).alias("now"), F.coalesce(F.sum(F.when(then, F.col("y"))), F.lit(0.0)).alias("then")
    )
    n = F.least("now", "then")
    ratio = F.greatest((F.col("now") / F.col("n_now")) / (F.col("then") / F.col("n_then")), F.lit(1e-6))
    growth = F.when(F.col("then") <= 0, 1.0).otherwise(F.least(F.greatest(F.exp(F.log(ratio) * n / (n + GROWTH_UNITS)), F.lit(1 / 3)), F.lit(3.0)))
    return sums.where("n_now >= 20 AND n_then >= 20").select("sku", growth.alias("growth"))


def recent_agrees(filled: DataFrame, growth: DataFrame, days: int = 28) -> DataFrame:
    """(sku, expected, actual, agrees): whether last year's same weeks at this year's pace would have called the last ones.

    They disagree where one is over twice the other and more than two Poisson deviations (of twice the variance) apart.
    """
    last = filled.groupBy("sku").agg(F.max("ds").alias("end"))
    rows = filled.join(last, "sku").withColumn("age", F.datediff("end", "ds"))
    got, was = F.col("age") < days, (F.col("age") >= YEAR_DAYS) & (F.col("age") < YEAR_DAYS + days)
    s = rows.groupBy("sku").agg(F.count_if(got).alias("n"), F.count_if(was).alias("m"), F.sum(F.when(got, F.col("y"))).alias("actual"), F.avg(F.when(was, F.col("y"))).alias("rate")).join(growth, "sku")
    s = s.withColumn("expected", F.coalesce(F.col("rate") * F.col("growth") * F.col("n"), F.lit(0.0)))
    apart = 2 * F.sqrt(2.0 * F.greatest("expected", F.lit(1.0)))
    low = (2 * F.col("actual") < F.col("expected")) & (F.col("expected") - F.col("actual") > apart)
    high = (F.col("actual") > 2 * F.col("expected")) & (F.col("actual") - F.col("expected") > apart)
    return s.select("sku", "expected", "actual", ((F.col("n") < 7) | (F.col("m") < 7) | ~(low | high)).alias("agrees"))


def same_weeks(filled: DataFrame, horizon: int = 30) -> DataFrame:
    """(sku, day, years, yhat): for each coming day the mean of up to three past years' 29 days around it, each scaled by its growth.

    A day with fewer than seven rows around it a year ago takes that year's mean over the days that have them.  Years end at the first without a growth, without 182 days before the days
    compared, or without such a day.  Products that sold nothing in the last 91 days or have rows on under half of the last 28 are left out, and so are those whose last four weeks disagree.
    """
    span = filled.groupBy("sku").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    age = F.datediff("last", "ds")
    lately = filled.join(span, "sku").groupBy("sku").agg(F.sum(F.when(age < 91, F.col("y"))).alias("lately"), F.count_if(age < 28).alias("rows")).where("lately > 0 AND rows >= 14")
    parts = []
    for k in range(1, MOST_YEARS + 1):
        grown = year_on_year(filled, k).join(span, "sku").where(F.datediff("last", "first") >= YEAR_DAYS * k + GROWTH_DAYS)
        if k == 1:
            grown = grown.join(recent_agrees(filled, year_on_year(filled)).where("agrees").select("sku"), "sku", "left_semi")
        days = grown.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        around = days.withColumn("ds", F.explode(F.sequence(F.expr(f"date_add(last, day - {YEAR_DAYS * k + 14})"), F.expr(f"date_add(last, day - {YEAR_DAYS * k - 14})"))))
        met = around.join(filled.select("sku", "ds", "y"), ["sku", "ds"], "left").groupBy("sku", "day", "growth").agg(F.avg("y").alias("m"), F.count("y").alias("n"))
        known = met.withColumn("m", F.when(F.col("n") >= 7, F.col("m")))
        whole = known.withColumn("m", F.coalesce("m", F.avg("m").over(Window.partitionBy("sku")))).where("m IS NOT NULL")
        parts.append(whole.select("sku", F.lit(k).alias("k"), "day", (F.col("m") * F.col("growth")).alias("v")))
    every = parts[0].union(parts[1]).union(parts[2])
    # a year counts only if those before it do
    held = every.groupBy("sku").agg(F.collect_set("k").alias("ks"))
    usable = F.when(~F.array_contains("ks", 1), 0).when(~F.array_contains("ks", 2), 1).when(~F.array_contains("ks", 3), 2).otherwise(3)
    years = held.select("sku", usable.alias("years")).join(lately, "sku", "left_semi")
    return every.join(years, "sku").where("k <= years").groupBy("sku", "day", "years").agg(F.avg("v").alias("yhat"))


def weekly_rates(filled: DataFrame) -> DataFrame:
    """(sku, w, units, rate): 7-day buckets that end on the product's last day (w = 0), those with four days or more."""
    last = filled.groupBy("sku").agg(F.max("ds").alias("end"))
    weeks = filled.join(last, "sku").withColumn("w", -F.floor(F.datediff("end", "ds") / 7).cast("int"))
    return weeks.groupBy("sku", "w").agg(F.sum("y").alias("units"), F.avg("y").alias("rate"), F.count("*").alias("days")).where("days >= 4").drop("days")


def rush_weeks(filled: DataFrame) -> DataFrame:
    """(sku, first_week, last_week, weeks, units): two weeks in a row or more at 1.5 times the median of the 12 on either side.

    The next week on either side is left out of the median, which needs four weeks.
    """
    weeks = weekly_rates(filled)
    apart = F.col("step")
    reach = weeks.select("sku", F.col("w").alias("of"), F.explode(F.sequence(F.lit(-13), F.lit(13))).alias("step")).where(F.abs(apart) >= 2).withColumn("w", F.col("of") + apart)
    near = reach.join(weeks.select("sku", "w", "rate"), ["sku", "w"]).groupBy("sku", F.col("of").alias("w")).agg(F.median("rate").alias("usual"), F.count("*").alias("n")).where("n >= 4")
    hot = weeks.join(near, ["sku", "w"]).where((F.col("usual") > 0) & (F.col("rate") >= 1.5 * F.col("usual")))
    run = F.col("w") - F.row_number().over(Window.partitionBy("sku").orderBy("w"))
    runs = hot.withColumn("run", run).groupBy("sku", "run").agg(F.min("w").alias("first_week"), F.max("w").alias("last_week"), F.count("*").alias("weeks"), F.sum("units").alias("units"))
    return runs.where("weeks >= 2").drop("run")


def rush_levels(filled: DataFrame, runs: DataFrame, side: int = 8) -> DataFrame:
    """(sku, first_week, last_week, rate, usual, ratio): a run's mean rate over the median of the weeks on either side, the next one left out."""
    weeks = weekly_rates(filled)
    met = runs.select("sku", "first_week", "last_week").join(weeks.select("sku", "w", "rate"), "sku").where(F.col("w").between(F.col("first_week") - side, F.col("last_week") + 1 + side))
    inside = F.col("w").between(F.col("first_week"), F.col("last_week"))
    beside = F.col("w").between(F.col("first_week") - side, F.col("first_week") - 2) | F.col("w").between(F.col("last_week") + 2, F.col("last_week") + 1 + side)
    found = met.groupBy("sku", "first_week", "last_week").agg(F.avg(F.when(inside, F.col("rate"))).alias("rate"), F.median(F.when(beside, F.col("rate"))).alias("usual"), F.count_if(beside).alias("n"))
    return found.where("n >= 2 AND usual > 0").select("sku", "first_week", "last_week", "rate", "usual", (F.col("rate") / F.col("usual")).alias("ratio"))


def rush_deflate(filled: DataFrame, factors: DataFrame) -> DataFrame:
    """Days of a rush divided by its factor; factors has (sku, start, end, factor)."""
    days = factors.select("sku", F.explode(F.sequence("start", "end")).alias("ds"), "factor").groupBy("sku", "ds").agg(F.max("factor").alias("factor"))
    return filled.join(days, ["sku", "ds"], "left").withColumn("y", F.col("y") / F.coalesce("factor", F.lit(1.0))).drop("factor")

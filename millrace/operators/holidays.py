"""Holidays: their days by rule, the stretch of days around each, and how sales shape themselves in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.staging import staged

#: Fixed values: (holiday, rule, days of the stretch before and after the core).  Rules: a date; the nth or last weekday of a month (Monday 0),
#: with the core's first and last day from there; Easter.
HOLIDAYS = (
    ("thanksgiving_week", ("nth", 11, 3, 4, 0, 4), 7, 7),
    ("christmas_newyear", ("fixed", 12, 24, 0, 8), 14, 7),
    ("valentines", ("fixed", 2, 14, 0, 0), 10, 2),
    ("super_bowl", ("superbowl",), 5, 1),
    ("presidents_day", ("nth", 2, 0, 3, -2, 0), 3, 1),
    ("st_patricks", ("fixed", 3, 17, 0, 0), 5, 1),
    ("easter", ("easter",), 10, 2),
    ("mothers_day", ("nth", 5, 6, 2, 0, 0), 10, 2),
    ("memorial_day", ("last", 5, 0, -2, 0), 5, 2),
    ("fathers_day", ("nth", 6, 6, 3, 0, 0), 10, 2),
    ("july_4", ("fixed", 7, 4, 0, 0), 7, 3),
    ("labor_day", ("nth", 9, 0, 1, -2, 0), 5, 2),
    ("halloween", ("fixed", 10, 31, 0, 0), 14, 3),
)
#: A past year counts this much less for each year of age.
YEAR_DECAY = 0.75
#: Units that pull a day's level half way to its prior, before a product's noise is counted.
SHRINK_UNITS = 10.0
#: A day either side of a thin one is read with it up to this far, unless it rests on this many units.
SMOOTH_DAYS, SMOOTH_UNITS = 3, 60.0
#: A stretch counts as measured if this share of its days is on file.
COVER = 0.6
#: What makes a shape significant: its highest and lowest level over the median, and how clear they are.
HIGH, LOW, CLEAR = 1.25, 0.8, 3.0


def easter(year: str) -> str:
    """Easter Sunday by the anonymous Gregorian rule, in whole numbers, as SQL for Spark."""
    a, b, c = f"({year} % 19)", f"({year} div 100)", f"({year} % 100)"
    d, e = f"({b} div 4)", f"({b} % 4)"
    g = f"(({b} - ({b} + 8) div 25 + 1) div 3)"
    h = f"((19 * {a} + {b} - {d} - {g} + 15) % 30)"
    i, k = f"({c} div 4)", f"({c} % 4)"
    w = f"((32 + 2 * {e} + 2 * {i} - {h} - {k}) % 7)"
    n = f"({h} + {w} - 7 * (({a} + 11 * {h} + 22 * {w}) div 451) + 114)"
    return f"make_date({year}, cast({n} div 31 as int), cast({n} % 31 + 1 as int))"


def _anchor(rule: tuple) -> str:
    kind = rule[0]
    if kind == "fixed":
        return f"make_date(year, {rule[1]}, {rule[2]})"
    if kind == "nth":
        return f"date_add(make_date(year, {rule[1]}, 1), cast(pmod({rule[2]} - weekday(make_date(year, {rule[1]}, 1)), 7) + {7 * (rule[3] - 1)} as int))"
    if kind == "last":
        last = f"last_day(make_date(year, {rule[1]}, 1))"
        return f"date_sub({last}, cast(pmod(weekday({last}) - {rule[2]}, 7) as int))"
    if kind == "superbowl":
        return "date_add(make_date(year, 2, 1), cast(pmod(6 - weekday(make_date(year, 2, 1)), 7) as int) + case when year >= 2022 then 7 else 0 end)"
    return easter("year")


def occurrences(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(holiday, rank, anchor, core_start, core_end, start, end) of every holiday of the years."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    parts = []
    for rank, (name, rule, before, after) in enumerate(HOLIDAYS):
        lo, hi = (rule[-2], rule[-1]) if rule[0] in ("fixed", "nth", "last") else (0, 0)
        anchor = F.expr(_anchor(rule))
        parts.append(
            years.select(
                F.lit(name).alias("holiday"), F.lit(rank).alias("rank"), F.date_add(anchor, lo).alias("anchor"), F.date_add(anchor, lo).alias("core_start"), F.date_add(anchor, hi).alias("core_end"),
                F.date_add(anchor, lo - before).alias("start"), F.date_add(anchor, hi + after).alias("end"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def windows(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(holiday, core_start, core_end) of holidays whose core touches a range of days."""
    years = int(first[:4]) - 1, int(last[:4]) + 1
    found = occurrences(spark, *years).where((F.col("core_end") >= F.lit(first).cast("date")) & (F.col("core_start") <= F.lit(last).cast("date")))
    return found.select("holiday", "core_start", "core_end")


def assigned(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(ds, holiday, anchor, offset, core): each day of a stretch belongs to the holiday whose core is nearest, the first listed on a tie."""
    days = occurrences(spark, first_year - 1, last_year + 1).withColumn("ds", F.explode(F.sequence("start", "end")))
    core = F.col("ds").between(F.col("core_start"), F.col("core_end"))
    distance = F.when(core, 0).otherwise(F.least(F.abs(F.datediff("ds", "core_start")), F.abs(F.datediff("ds", "core_end"))))
    nearest = Window.partitionBy("ds").orderBy("distance", "rank", "anchor")
    ranked = days.withColumn("distance", distance).withColumn("r", F.row_number().over(nearest)).where("r = 1")
    return ranked.select("ds", "holiday", "anchor", F.datediff("ds", "anchor").alias("offset"), (F.col("distance") == 0).alias("core"))


def weekday_index(rows: DataFrame) -> DataFrame:
    """(sku, weekday, profile): ordinary days (`clean`), shrunk toward even by n / (n + 20) units, brought to mean 1; Monday is 0."""
    clean = rows.where("clean")
    total = clean.groupBy("sku").agg(F.avg("y").alias("mean"), F.count("*").alias("days")).where("days >= 28 AND mean > 0")
    by_day = clean.groupBy("sku", F.weekday("ds").alias("weekday")).agg(F.avg("y").alias("m"), F.sum("y").alias("n"), F.count("*").alias("k")).where("k >= 4")
    grid = rows.select("sku").distinct().withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    raw = grid.join(total, "sku", "left").join(by_day, ["sku", "weekday"], "left")
    p = F.coalesce(1 + (F.col("m") / F.col("mean") - 1) * F.col("n") / (F.col("n") + 20.0), F.lit(1.0))
    p = raw.select("sku", "weekday", p.alias("p"))
    return p.select("sku", "weekday", (F.col("p") / F.avg("p").over(Window.partitionBy("sku"))).alias("profile"))


def dispersion(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """(sku, phi): variance over mean around the level of 29 days, on ordinary days; 2 under 60 of them, between 1 and 20."""
    z = rows.join(profile, [rows["sku"] == profile["sku"], F.weekday(rows["ds"]) == profile["weekday"]]).select(rows["sku"], "ds", "y", "clean", "profile")
    day = F.datediff("ds", F.lit("1970-01-01"))
    around = Window.partitionBy("sku").orderBy(day).rangeBetween(-14, 14)
    held = F.when(F.col("clean"), F.col("y") / F.col("profile"))
    level = F.when(F.count(held).over(around) >= 14, F.avg(held).over(around) * F.col("profile"))
    rows = z.withColumn("level", level).where("clean AND level > 0")
    sums = rows.groupBy("sku").agg(F.sum(F.pow(F.col("y") - F.col("level"), 2)).alias("v"), F.sum("level").alias("l"), F.count("*").alias("n"))
    found = sums.select("sku", F.when(F.col("n") >= 60, F.least(F.greatest(F.col("v") / F.col("l"), F.lit(1.0)), F.lit(20.0))).otherwise(2.0).alias("phi"))
    return z.select("sku").distinct().join(found, "sku", "left").select("sku", F.coalesce("phi", F.lit(2.0)).alias("phi"))


def measure(filled: DataFrame, days: DataFrame) -> DataFrame:
    """(sku, holiday, offset, core, num, den, var, phi): units sold and expected per day of a holiday's stretch, past years weighted by age.

    filled has (sku, ds, y, on_promotion); promotion days don't speak for a holiday.  A year's stretch counts if it has ended and COVER of it is on file; its
    level is its units over its weekdays' weights.
    """
    met = filled.join(F.broadcast(days), "ds", "left").withColumn("usable", F.coalesce("on_promotion", F.lit(0)) < 1)
    met = met.withColumn("clean", F.col("usable") & F.col("holiday").isNull())
    profile = weekday_index(met.select("sku", "ds", "y", "clean"))
    phi = dispersion(met.select("sku", "ds", "y", "clean"), profile).select("sku", F.least(F.greatest("phi", F.lit(1.0)), F.lit(8.0)).alias("phi"))
    end = F.broadcast(filled.agg(F.max("ds").alias("last")))
    spans = days.groupBy("holiday", "anchor").agg(F.count("*").alias("length"), F.max("ds").alias("span_end"))
    inside = met.where("holiday IS NOT NULL").withColumn("weekday", F.weekday("ds")).join(profile, ["sku", "weekday"])
    years = inside.groupBy("sku", "holiday", "anchor").agg(
        F.count("*").alias("on_file"), F.sum(F.when(F.col("usable"), F.col("y"))).alias("units"), F.sum(F.when(F.col("usable"), F.col("profile"))).alias("weights")
    )
    full = years.join(F.broadcast(spans), ["holiday", "anchor"]).join(end).where(f"span_end <= last AND on_file >= {COVER} * length AND weights >= 5 AND units > 0")
    latest = full.groupBy("sku", "holiday").agg(F.max("anchor").alias("latest"))
    weighed = full.join(latest, ["sku", "holiday"]).withColumn("w", F.pow(F.lit(YEAR_DECAY), F.round(F.datediff("latest", "anchor") / 365.25)))
    used = inside.where("usable").join(weighed.select("sku", "holiday", "anchor", "w", (F.col("units") / F.col("weights")).alias("level")), ["sku", "holiday", "anchor"])
    expected = F.col("level") * F.col("profile")
    sums = used.groupBy("sku", "holiday", "offset").agg(
        F.bool_or("core").alias("core"), F.sum(F.col("w") * F.col("y")).alias("num"), F.sum(F.col("w") * expected).alias("den"), F.sum(F.col("w") * F.col("w") * expected).alias("var")
    )
    return sums.join(phi, "sku")


def pool(measures: DataFrame, keys: DataFrame) -> DataFrame:
    """(category, holiday, offset, core, num, den, var, phi, n): members' evidence, none counting for more than the median member."""
    own = measures.join(keys, "sku")
    totals = own.groupBy("category", "holiday", "sku").agg(F.sum("den").alias("t"), F.first("phi").alias("phi")).where("t > 0")
    cap = totals.groupBy("category", "holiday").agg(F.median("t").alias("cap"), F.avg("phi").alias("phi_mean"), F.count("*").alias("n"))
    weight = totals.join(cap, ["category", "holiday"]).withColumn("w", F.least(F.lit(1.0), F.col("cap") / F.col("t"))).select("category", "holiday", "sku", "w", "phi_mean", "n")
    met = own.join(weight, ["category", "holiday", "sku"])
    return met.groupBy("category", "holiday", "offset").agg(
        F.bool_or("core").alias("core"), F.sum(F.col("w") * F.col("num")).alias("num"), F.sum(F.col("w") * F.col("den")).alias("den"), F.sum(F.col("w") * F.col("w") * F.col("var")).alias("var"),
        F.max("phi_mean").alias("phi"), F.max("n").alias("n"),
    )


def _smoothed(evidence: DataFrame, *keys: str) -> DataFrame:
    """(keys, offset, core, s_num, s_den, s_var): a core day or one that rests on enough units alone, others with the days either side outside the core."""
    alone = F.col("core") | (F.col("den") * F.col("den") >= SMOOTH_UNITS * F.col("var"))
    reach = evidence.select(*keys, "offset", "core", F.explode(F.when(alone, F.array(F.col("offset"))).otherwise(F.sequence(F.col("offset") - SMOOTH_DAYS, F.col("offset") + SMOOTH_DAYS))).alias("at"))
    other = evidence.select(*keys, F.col("offset").alias("at"), F.col("core").alias("at_core"), "num", "den", "var")
    near = reach.join(other, [*keys, "at"]).where("core OR at = offset OR NOT at_core")
    return near.groupBy(*keys, "offset", "core").agg(F.sum("num").alias("s_num"), F.sum("den").alias("s_den"), F.sum("var").alias("s_var"))


def levels(measures: DataFrame, pooled: DataFrame, keys: DataFrame) -> DataFrame:
    """(sku, holiday, offset, level, z): own sales over expected, pulled toward the category's, itself pulled toward even, by the units behind each."""
    own = _smoothed(measures, "sku", "holiday").join(measures.select("sku", "phi").distinct(), "sku").join(keys, "sku")
    shared = _smoothed(pooled, "category", "holiday").join(pooled.select("category", "holiday", F.col("phi").alias("phi_p")).distinct(), ["category", "holiday"])
    shared = shared.select("category", "holiday", "offset", "phi_p", *(F.col(c).alias(f"p_{c}") for c in ("s_num", "s_den", "s_var")))
    met = own.join(shared, ["category", "holiday", "offset"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p_s_num", "p_s_den", "p_s_var")})
    met = met.withColumn("phi_p", F.coalesce("phi_p", F.lit(2.0)))
    kp, ko = SHRINK_UNITS * F.col("phi_p"), SHRINK_UNITS * F.col("phi")
    prior = (F.col("p_s_num") + kp) / (F.col("p_s_den") + kp)
    num, den, var = (F.col(f"s_{c}") + F.col(f"p_s_{c}") for c in ("num", "den", "var"))
    return met.select("sku", "holiday", "offset", ((F.col("s_num") + ko * prior) / (F.col("s_den") + ko)).alias("level"), F.when(var > 0, (num - den) / F.sqrt(F.greatest("phi", "phi_p") * var)).alias("z"))


def shape(filled: DataFrame, days: DataFrame, keys: DataFrame) -> DataFrame:
    """levels() of a catalogue; the calendar, each product's evidence and the categories' are written once, since every later step reads them again."""
    calendar = staged(days)
    measures = staged(measure(filled, calendar))
    return staged(levels(measures, staged(pool(measures, keys)), keys))


def significant(found: DataFrame) -> DataFrame:
    """(sku, holiday, high, low, significant): whether the busiest or quietest day stands clearly apart from a typical day of the stretch."""
    rows = found.groupBy("sku", "holiday").agg(F.median("level").alias("typical"), F.max("level").alias("hi"), F.min("level").alias("lo"), F.max("z").alias("z_hi"), F.min("z").alias("z_lo"))
    high, low = F.col("hi") / F.col("typical"), F.col("lo") / F.col("typical")
    clear = ((high >= HIGH) & (F.coalesce("z_hi", F.lit(0.0)) >= CLEAR)) | ((low <= LOW) & (F.coalesce("z_lo", F.lit(0.0)) <= -CLEAR))
    return rows.select("sku", "holiday", high.alias("high"), low.alias("low"), clear.alias("significant"))


def redistribute(forecast: DataFrame, days: DataFrame, found: DataFrame, profile: DataFrame) -> DataFrame:
    """A forecast (sku, ds, yhat) whose stretches keep their totals, split over their days by weekday and level."""
    met = forecast.join(F.broadcast(days), "ds", "left").withColumn("weekday", F.weekday("ds")).join(profile, ["sku", "weekday"], "left").join(found.select("sku", "holiday", "offset", "level"), ["sku", "holiday", "offset"], "left")
    weight = F.coalesce("profile", F.lit(1.0)) * F.coalesce("level", F.lit(1.0))
    stretch = Window.partitionBy("sku", "holiday", "anchor")
    rows = met.withColumn("w", weight)
    moved = F.sum("yhat").over(stretch) * F.col("w") / F.sum("w").over(stretch)
    return rows.select("sku", "ds", F.when(F.col("holiday").isNotNull(), moved).otherwise(F.col("yhat")).alias("yhat"))

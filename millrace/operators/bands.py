"""How sure a total over several days is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided normal quantiles by band in percent.
Z = {50.0: 0.6745, 80.0: 1.2816, 90.0: 1.6449, 95.0: 1.96}


def day_correlation(errors: DataFrame, days: int) -> DataFrame:
    """(sku, rho): mean correlation of errors within blocks of `days` days, from Var(sum) = n s2 (1 + (n - 1) rho); 0 where unknown.

    errors has (sku, window, ds, err).  Blocks are no longer than the longest window less 5, and come from windows of 5 days more.
    """
    sizes = errors.groupBy("sku", "window").agg(F.count("*").alias("len")).where("len >= 7")
    longest = sizes.groupBy("sku").agg(F.least(F.lit(days), F.max("len") - 5).cast("int").alias("k")).where("k >= 2")
    rows = errors.join(sizes, ["sku", "window"]).join(longest, "sku")
    order = Window.partitionBy("sku", "window").orderBy("ds")
    run = rows.withColumn("run", F.sum("err").over(order)).withColumn("i", F.row_number().over(order))
    ahead = run.select("sku", "window", (F.col("i") + F.col("k")).alias("i"), F.col("run").alias("run_before"))
    sums = run.join(ahead, ["sku", "window", "i"], "left").where("len >= k + 5 AND i >= k").withColumn("s", F.col("run") - F.coalesce("run_before", F.lit(0.0)))
    blocks = sums.groupBy("sku", "k").agg(F.var_samp("s").alias("vk"))
    own = rows.groupBy("sku").agg(F.var_samp("err").alias("s2"))
    rho = (F.col("vk") / (F.col("k") * F.col("s2")) - 1) / (F.col("k") - 1)
    known = own.join(blocks, "sku", "left").select("sku", F.when(F.col("s2") > 0, F.least(F.greatest(rho, F.lit(0.0)), F.lit(1.0))).alias("rho"))
    return errors.select("sku").distinct().join(known, "sku", "left").select("sku", F.coalesce("rho", F.lit(0.0)).alias("rho"))


def level_error(errors: DataFrame) -> DataFrame:
    """(sku, level_sd): typical miss of the daily level, from windows' mean errors less what the days' noise alone would give."""
    means = errors.groupBy("sku", "window").agg(F.avg("err").alias("m"), F.count("*").alias("len")).where("len >= 7")
    kept = errors.join(means.select("sku", "window"), ["sku", "window"], "left_semi").groupBy("sku").agg(F.coalesce(F.var_samp("err"), F.lit(0.0)).alias("s2"))
    v = means.groupBy("sku").agg(F.avg(F.col("m") * F.col("m")).alias("v"), F.avg("len").alias("length")).join(kept, "sku")
    return v.select("sku", F.sqrt(F.greatest(F.col("v") - F.col("s2") / F.col("length"), F.lit(0.0))).alias("level_sd"))


def total_band(days: DataFrame, stats: DataFrame, band: float = 80.0) -> DataFrame:
    """(sku, point, lo, hi) of totals over the days (sku, ds, yhat, lower, upper).

    Day noise adds up with correlation rho; the level's error grows with the number of days and scales with the forecast's level over ref_mean, between
    a quarter and four.  stats has (sku, rho, level_sd, ref_mean).
    """
    down, up = F.greatest(F.col("yhat") - F.col("lower"), F.lit(0.0)), F.greatest(F.col("upper") - F.col("yhat"), F.lit(0.0))
    sums = days.groupBy("sku").agg(
        F.count("*").alias("n"), F.sum("yhat").alias("point"), F.sum(down * down).alias("lo2"), F.sum(down).alias("lo1"), F.sum(up * up).alias("hi2"), F.sum(up).alias("hi1")
    )
    rows = sums.join(stats, "sku", "left").withColumns({"rho": F.coalesce("rho", F.lit(0.0)), "level_sd": F.coalesce("level_sd", F.lit(0.0))})
    scale = F.when((F.col("ref_mean") > 0) & (F.col("point") > 0), F.least(F.greatest(F.col("point") / F.col("n") / F.col("ref_mean"), F.lit(0.25)), F.lit(4.0))).otherwise(1.0)
    level = Z[band] * F.col("n") * F.col("level_sd") * scale
    noise = lambda a, b: F.greatest(F.col(a) + F.col("rho") * (F.col(b) * F.col(b) - F.col(a)), F.lit(0.0))
    lo = F.col("point") - F.sqrt(noise("lo2", "lo1") + level * level)
    hi = F.col("point") + F.sqrt(noise("hi2", "hi1") + level * level)
    return rows.select("sku", "point", F.greatest(lo, F.lit(0.0)).alias("lo"), F.greatest(hi, "point").alias("hi"))


def rho_by_length(errors: DataFrame, lengths: list[int]) -> DataFrame:
    """(sku, days, rho): how errors of days go together in blocks of each length."""
    found = [day_correlation(errors, n).withColumn("days", F.lit(n)) for n in sorted(set(lengths))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("sku", "days", "rho")


def month_spans(days: DataFrame) -> DataFrame:
    """(sku, first, last): each product's calendar months as far as its days (sku, ds) go."""
    return days.groupBy("sku", F.trunc("ds", "month").alias("month")).agg(F.min("ds").alias("first"), F.max("ds").alias("last")).drop("month")


def horizon_totals(days: DataFrame, spans: DataFrame, rhos: DataFrame, stats: DataFrame, band: float = 80.0) -> DataFrame:
    """(sku, first, last, days, point, lo, hi): totals and their bands over any spans (sku, first, last) of stored daily forecasts (sku, ds, yhat, lower, upper).

    The rule is total_band()'s.  Days are summed up once per product; a span is the difference of two sums, looked up by its ends, however many spans there are.  rhos has (sku, days, rho),
    0 where the number of days isn't listed, stats (sku, level_sd, ref_mean).  Days run without gaps; a span is cut to those there are, and one without any is left out.
    """
    yhat = F.greatest("yhat", F.lit(0.0))
    down, up = F.greatest(yhat - F.greatest("lower", F.lit(0.0)), F.lit(0.0)), F.greatest(F.col("upper") - yhat, F.lit(0.0))
    order = Window.partitionBy("sku").orderBy("ds")
    parts = {"n": F.lit(1), "point": yhat, "lo1": down, "lo2": down * down, "hi1": up, "hi2": up * up}
    sums = days.select("sku", "ds", *(F.sum(v).over(order).alias(k) for k, v in parts.items()))
    edges = sums.groupBy("sku").agg(F.min("ds").alias("start"), F.max("ds").alias("end"))
    cut = spans.join(edges, "sku").withColumns({"a": F.greatest("first", "start"), "b": F.least("last", "end")}).where("a <= b")
    until = sums.select("sku", F.col("ds").alias("b"), *(F.col(k).alias(f"{k}_b") for k in parts))
    before = sums.select("sku", F.date_add("ds", 1).alias("a"), *(F.col(k).alias(f"{k}_a") for k in parts))
    met = cut.join(until, ["sku", "b"]).join(before, ["sku", "a"], "left")
    rows = met.select("sku", "first", "last", *((F.col(f"{k}_b") - F.coalesce(F.col(f"{k}_a"), F.lit(0))).alias(k) for k in parts))
    rows = rows.join(rhos.withColumnRenamed("days", "n"), ["sku", "n"], "left").join(stats.select("sku", "level_sd", "ref_mean"), "sku", "left")
    rows = rows.withColumns({"rho": F.coalesce("rho", F.lit(0.0)), "level_sd": F.coalesce("level_sd", F.lit(0.0))})
    scale = F.when((F.col("ref_mean") > 0) & (F.col("point") > 0), F.least(F.greatest(F.col("point") / F.col("n") / F.col("ref_mean"), F.lit(0.25)), F.lit(4.0))).otherwise(1.0)
    level = Z[band] * F.col("n") * F.col("level_sd") * scale
    noise = lambda two, one: F.greatest(F.col(two) + F.col("rho") * (F.col(one) * F.col(one) - F.col(two)), F.lit(0.0))
    lo = F.greatest(F.col("point") - F.sqrt(noise("lo2", "lo1") + level * level), F.lit(0.0))
    return rows.select("sku", "first", "last", F.col("n").alias("days"), "point", lo.alias("lo"), F.greatest(F.col("point") + F.sqrt(noise("hi2", "hi1") + level * level), "point").alias("hi"))


def widened(days: DataFrame, extra: DataFrame) -> DataFrame:
    """Bands with a further deviation x_sd (sku, ds, x_sd) added in squares, none below 0."""
    met = days.join(extra, ["sku", "ds"], "left").withColumn("e", Z[80.0] * F.coalesce("x_sd", F.lit(0.0)))
    wide = lambda w: F.sqrt(w * w + F.col("e") * F.col("e"))
    return met.withColumns(
        {"lower": F.greatest(F.col("yhat") - wide(F.col("yhat") - F.col("lower")), F.lit(0.0)), "upper": F.col("yhat") + wide(F.col("upper") - F.col("yhat"))}
    ).drop("x_sd", "e")

"""Forecast engines: pooled shapes, sparse demand with a choice of models, and a fitted trend with seasons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import trend

#: Rows of a level, least rows of a trend, its damping a day, and the share of the level that it must move in 30 days.
LEVEL_ROWS, TREND_ROWS, TREND_DAMPING, TREND_SHARE = 90, 21, 0.90, 0.15
#: Relatives and cohesion that a borrowed season needs, and the days of history over which it fades out.
RELATIVES, COHESION, FADE_START, YEARLY_DAYS = 2, 0.35, 180, 450
#: Smoothing of sizes and chances with decay, the margin by which a challenger must win, and the widening of sparse bands.
DECAY_WEIGHT, CHALLENGE, SPARSE_WIDENING = 0.2, 0.98, 1.36
#: Days of a hold-out, hold-outs, damping of a fitted trend a day, and the least weight that counts.
HOLD_OUT, HOLD_OUTS, FITTED_DAMPING, LEAST_WEIGHT = 28, 3, 0.97, 0.02


def pooled_indices(filled: DataFrame, keys: DataFrame) -> DataFrame:
    """(category, kind, slot, index): members' detrended mean ratios by weekday (kind 'w', Monday 0) and month ('m'), averaged and brought to mean 1."""
    level = trend.detrend(filled.select("sku", "ds", "y"), short_history=False)
    means = level.groupBy("sku").agg(F.avg("y").alias("mean"))
    ratio = level.join(means, "sku").join(keys, "sku").withColumn("ratio", F.col("y") / F.when(F.col("mean") != 0, F.col("mean")).otherwise(1.0))
    slots = F.array(F.struct(F.lit("w").alias("kind"), F.weekday("ds").alias("slot")), F.struct(F.lit("m").alias("kind"), F.month("ds").alias("slot")))
    own = ratio.select("category", "sku", "ratio", F.inline(slots)).groupBy("category", "sku", "kind", "slot").agg(F.avg("ratio").alias("v"))
    pooled = own.groupBy("category", "kind", "slot").agg(F.avg("v").alias("index"))
    grid = pooled.select("category").distinct().withColumn("s", F.concat(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(F.lit("w").alias("kind"), i.alias("slot"))), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(F.lit("m").alias("kind"), i.alias("slot")))))
    whole = grid.select("category", F.inline("s")).join(pooled, ["category", "kind", "slot"], "left").withColumn("index", F.coalesce("index", F.lit(1.0)))
    return whole.withColumn("index", F.col("index") / F.avg("index").over(Window.partitionBy("category", "kind")))


def _seasoned(days: DataFrame, indices: DataFrame) -> DataFrame:
    """Adds `season`, weekday times month of the category, to rows (sku, category, ds)."""
    part = lambda kind, slot, out: indices.where(F.col("kind") == kind).select("category", F.col("slot").alias(slot), F.col("index").alias(out))
    met = days.withColumns({"_w": F.weekday("ds"), "_m": F.month("ds")}).join(F.broadcast(part("w", "_w", "_iw")), ["category", "_w"]).join(F.broadcast(part("m", "_m", "_im")), ["category", "_m"])
    return met.withColumn("season", F.col("_iw") * F.col("_im")).drop("_w", "_m", "_iw", "_im")


def pooled_forecast(filled: DataFrame, keys: DataFrame, horizon: int = 30) -> DataFrame:
    """(sku, day, yhat): own level of the last LEVEL_ROWS days without the category's season, its growth damped, times the season of each day.

    A product without sales or with under 7 rows stays at its own mean: relatives lend their shape, never their volume.
    """
    indices = pooled_indices(filled, keys)
    end = F.broadcast(filled.agg(F.max("ds").alias("end")))
    rows = _seasoned(filled.join(keys, "sku").join(end).withColumn("age", F.datediff("end", "ds")).where(F.col("age") < LEVEL_ROWS), indices)
    z = F.col("y") / F.when(F.col("season") > 1e-6, F.col("season")).otherwise(1.0)
    x = -F.col("age").cast("double")
    fits = rows.withColumns({"z": z, "x": x}).groupBy("sku", "category", "end").agg(F.avg("z").alias("mean_z"), F.regr_slope("z", "x").alias("slope"), F.regr_intercept("z", "x").alias("at_end"), F.count("*").alias("n"))
    total = filled.groupBy("sku").agg(F.count("*").alias("rows"), F.sum("y").alias("units"), F.avg("y").alias("mean"))
    fits = fits.join(total, "sku")
    level = F.when((F.col("rows") >= 7) & (F.col("units") > 0), F.col("mean_z")).otherwise(F.coalesce("mean", F.lit(0.0)))
    fits = fits.withColumn("level", level)
    grows = (F.col("n") >= TREND_ROWS) & (F.col("units") > 0) & (F.col("slope") > 0) & (30 * F.col("slope") >= TREND_SHARE * F.greatest("level", F.lit(1.0)))
    fits = fits.withColumn("growth", F.when(grows, F.least("slope", "level")).otherwise(0.0)).withColumn("start", F.when(grows, F.greatest("at_end", F.lit(0.0))).otherwise(F.col("level")))
    days = fits.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.expr("date_add(end, day)"))
    damped = TREND_DAMPING * (1 - F.pow(F.lit(TREND_DAMPING), F.col("day"))) / (1 - TREND_DAMPING)
    return _seasoned(days, indices).select("sku", "day", F.greatest((F.col("start") + F.col("growth") * damped) * F.col("season"), F.lit(0.0)).alias("yhat"))


def blend_weight(products: DataFrame) -> DataFrame:
    """Adds `weight` to (sku, days, relatives, cohesion): how far a borrowed yearly season counts, fading until the product has its own."""
    history = F.least(F.greatest((YEARLY_DAYS - F.col("days")) / (YEARLY_DAYS - FADE_START), F.lit(0.0)), F.lit(1.0))
    trust = 0.5 + 0.5 * F.least(F.greatest((F.col("cohesion") - COHESION) / (1 - COHESION), F.lit(0.0)), F.lit(1.0))
    some = (F.col("relatives") >= RELATIVES) & (F.col("cohesion") >= COHESION) & (F.col("days") < YEARLY_DAYS)
    return products.withColumn("weight", F.when(some, history * trust).otherwise(0.0))


def apply_pooled_year(forecast: DataFrame, indices: DataFrame, weights: DataFrame) -> DataFrame:
    """Forecast rows (sku, category, ds, yhat, lower, upper) moved toward the category's month by the product's weight."""
    months = indices.where("kind = 'm'").select("category", F.col("slot").alias("month"), "index")
    met = forecast.withColumn("month", F.month("ds")).join(F.broadcast(months), ["category", "month"]).join(weights.select("sku", "weight"), "sku")
    factor = 1 + F.col("weight") * (F.col("index") - 1)
    return met.select("sku", "ds", *(F.greatest(F.col(c) * factor, F.lit(0.0)).alias(c) for c in ("yhat", "lower", "upper")))


def sparse_rates(filled: DataFrame, origins: DataFrame) -> DataFrame:
    """(sku, k, origin, classic, corrected, decaying): rates as of each origin (sku, k, origin), in closed form over the sales up to it.

    Sizes and intervals are smoothed by 0.1 from their first value on; the decaying rate smooths size and chance of a sale by DECAY_WEIGHT.
    """
    order = Window.partitionBy("sku").orderBy("ds")
    start = filled.groupBy("sku").agg(F.min("ds").alias("start"))
    sales = filled.where("y > 0").join(start, "sku").withColumn("i", F.row_number().over(order)).withColumn("gap", F.datediff("ds", F.coalesce(F.lag("ds").over(order), F.date_sub("start", 1))))
    met = sales.join(origins, "sku").where("ds <= origin").withColumns({"n": F.max("i").over(Window.partitionBy("sku", "k")), "length": F.datediff("origin", "start") + 1, "t": F.datediff("ds", "start") + 1})

    def smoothed(a: float, value: F.Column) -> F.Column:
        return F.sum(F.when(F.col("i") == 1, 1.0).otherwise(a) * F.pow(F.lit(1 - a), F.col("n") - F.col("i")) * value)

    b = DECAY_WEIGHT
    chance = F.sum(F.when(F.col("t") == 1, 1.0).otherwise(b) * F.pow(F.lit(1 - b), F.col("length") - F.col("t")))
    sums = met.groupBy("sku", "k", "origin").agg(smoothed(0.1, F.col("y")).alias("size"), smoothed(0.1, F.col("gap")).alias("gap"), smoothed(b, F.col("y")).alias("size_b"), chance.alias("chance"))
    classic = F.col("size") / F.col("gap")
    return sums.select("sku", "k", "origin", classic.alias("classic"), (0.95 * classic).alias("corrected"), (F.col("size_b") * F.col("chance")).alias("decaying"))


def sparse_forecast(filled: DataFrame, subtypes: DataFrame) -> DataFrame:
    """(sku, model, rate, lower, upper): the classic rate unless a challenger's hold-out error is 2% smaller; bands from its errors, widened.

    Hold-outs of min(28, max(7, n / 6)) days: three, two or one as the history allows.  The decaying model is not tried for steady trickles.
    """
    span = filled.groupBy("sku").agg(F.min("ds").alias("start"), F.max("ds").alias("end"))
    n = F.datediff("end", "start") + 1
    span = span.withColumn("h", F.least(F.lit(28), F.greatest(F.lit(7), F.floor(n / 6))).cast("int")).withColumn("ks", F.when(n >= 6 * F.col("h"), 3).when(n >= 4 * F.col("h"), 2).otherwise(1))
    origins = span.withColumn("k", F.explode(F.sequence(F.lit(0), "ks"))).withColumn("origin", F.expr("date_sub(end, k * h)")).where("origin >= start").select("sku", "k", "origin", "h")
    rates = sparse_rates(filled, origins.drop("h"))
    tests = rates.where("k > 0").join(origins.select("sku", "k", "h"), ["sku", "k"]).withColumn("ds", F.explode(F.sequence(F.date_add("origin", 1), F.expr("date_add(origin, h)"))))
    errors = tests.join(filled.select("sku", "ds", "y"), ["sku", "ds"])
    mae = errors.groupBy("sku").agg(*(F.avg(F.abs(F.col("y") - F.col(c))).alias(f"e_{c}") for c in ("classic", "corrected", "decaying")))
    met = rates.where("k = 0").join(mae, "sku", "left").join(subtypes.select("sku", "subtype"), "sku", "left")
    first = F.when(F.col("e_corrected") < CHALLENGE * F.col("e_classic"), "corrected").otherwise("classic")
    best = F.when(F.col("e_corrected") < CHALLENGE * F.col("e_classic"), F.col("e_corrected")).otherwise(F.col("e_classic"))
    model = F.when((F.coalesce("subtype", F.lit("")) != "low_volume_regular") & (F.col("e_decaying") < CHALLENGE * best), "decaying").otherwise(first)
    met = met.withColumn("model", model)
    chosen = F.when(F.col("model") == "decaying", F.col("decaying")).when(F.col("model") == "corrected", F.col("corrected")).otherwise(F.col("classic"))
    picked = met.select("sku", "model", chosen.alias("rate"))
    err = F.when(F.col("model") == "decaying", F.col("decaying")).when(F.col("model") == "corrected", F.col("corrected")).otherwise(F.col("classic"))
    spread = errors.join(picked.select("sku", "model"), "sku").withColumn("err", F.col("y") - err).groupBy("sku").agg(F.percentile("err", F.lit(0.1)).alias("lo"), F.percentile("err", F.lit(0.9)).alias("hi"))
    wide = picked.join(spread, "sku", "left")
    return wide.select("sku", "model", "rate", *(F.greatest(F.col("rate") + SPARSE_WIDENING * F.coalesce(c, F.lit(0.0)), F.lit(0.0)).alias(o) for c, o in (("lo", "lower"), ("hi", "upper"))))


def _design(t: np.ndarray, day: np.ndarray, yearly: bool) -> np.ndarray:
    """Level, trend in years, and waves of the week and, with history enough, of the year."""
    waves = [(7.0, 3)] + ([(365.25, 5)] if yearly else [])
    columns = [np.ones(len(t)), t / 365.25]
    for period, n in waves:
        for k in range(1, n + 1):
            columns += [np.sin(2 * np.pi * k * day / period), np.cos(2 * np.pi * k * day / period)]
    return np.column_stack(columns)


def _ridge(y: np.ndarray, day: np.ndarray, horizon: int) -> np.ndarray:
    """The coming days of one series: ridge on _design, its trend damped day by day."""
    n = len(y)
    x = _design(np.arange(n, dtype=float), day, n >= YEARLY_DAYS)
    penalty = np.diag([0.0, 1.0] + [0.1] * (x.shape[1] - 2)) * n / 100
    beta = np.linalg.solve(x.T @ x + penalty + 1e-8 * np.eye(x.shape[1]), x.T @ y)
    ahead = np.arange(1, horizon + 1, dtype=float)
    damped = FITTED_DAMPING * (1 - FITTED_DAMPING**ahead) / (1 - FITTED_DAMPING)
    return np.maximum(_design(n - 1 + damped, day[-1] + ahead, n >= YEARLY_DAYS) @ beta, 0.0)


def _recent(y: np.ndarray, day: np.ndarray, horizon: int) -> np.ndarray:
    """The smoothed recent level times the weekday profile of the last eight weeks."""
    last, wd = y[-56:], day[-56:].astype(int) % 7
    mean, n = last.mean(), last.sum()
    raw = np.array([1 + (last[wd == w].mean() / mean - 1) * n / (n + 20) if mean > 0 and (wd == w).any() else 1.0 for w in range(7)])
    profile = raw / raw.mean()
    z = y / profile[day.astype(int) % 7]
    a = 1 - 0.5**0.1
    weights = a * (1 - a) ** np.arange(len(z) - 1, -1, -1)
    level = weights @ z + (1 - a) ** len(z) * z[:28].mean()
    return level * profile[(day[-1] + np.arange(1, horizon + 1)).astype(int) % 7]


def fitted_series(y: np.ndarray, day: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """yhat, lower and upper of the coming days of one series, the recent level's weight, and the errors of its hold-outs, oldest first."""
    errors, misses = [], []
    for k in range(1, HOLD_OUTS + 1):
        cut = len(y) - k * HOLD_OUT
        if cut >= 60:
            actual = y[cut : cut + HOLD_OUT]
            fitted, recent = (f(y[:cut], day[:cut], HOLD_OUT) for f in (_ridge, _recent))
            errors.insert(0, actual - fitted)
            misses.append([np.abs((actual - f).reshape(4, 7).sum(axis=1)).mean() / 7 for f in (fitted, recent)])
    weight = 0.0
    if misses and len(y) < YEARLY_DAYS:
        p, alt = np.mean(misses, axis=0)
        weight = p * p / (p * p + alt * alt) if p + alt > 0 else 0.0
    weight = weight if weight >= LEAST_WEIGHT else 0.0
    yhat = (1 - weight) * _ridge(y, day, horizon) + (weight * _recent(y, day, horizon) if weight else 0.0)
    resid = np.concatenate(errors) if errors else np.zeros(0)
    if len(resid) >= 8:
        lo, hi = np.percentile(resid, [10, 90])
    else:
        hi = 1.2816 * (y.std() if len(y) else 0.0)
        lo = -hi
    return yhat, np.maximum(yhat + lo, 0.0), np.maximum(yhat + hi, 0.0), weight, resid


def _fit_product(horizon: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        y, day = rows["y"].to_numpy(float), (pd.to_datetime(rows["ds"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
        yhat, lower, upper, weight, _ = fitted_series(y, day, horizon)
        return pd.DataFrame({"sku": rows["sku"].iloc[0], "day": np.arange(1, horizon + 1), "yhat": yhat, "lower": lower, "upper": upper, "recent_weight": weight})

    return fit


def fitted_forecast(filled: DataFrame, horizon: int = 30) -> DataFrame:
    """(sku, day, yhat, lower, upper, recent_weight): a ridge fit of trend and waves per product, mixed with the recent level by their hold-out errors.

    A product's series is one group of days, some thousands of rows at most; products are spread over the tasks.  Products of under 30 rows are left out.
    """
    long = filled.groupBy("sku").agg(F.count("*").alias("rows")).where("rows >= 30").select("sku")
    rows = filled.select("sku", "ds", "y").join(long, "sku", "left_semi")
    return rows.groupBy("sku").applyInPandas(_fit_product(horizon), "sku string, day int, yhat double, lower double, upper double, recent_weight double")

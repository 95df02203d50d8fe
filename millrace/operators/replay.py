"""Backtests of the engines: every product is forecast again as of each cutoff, from nothing but the days up to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import backtest, demand, engines, trend
from millrace.sources.staging import staged

ENGINES = ("regular", "sparse", "pooled")
#: Cutoffs of a product that are refit in one row's turn; a long history is spread over several.
CUTOFFS_A_ROW = 8
#: Days of history that a donor needs, and days without a sale after which it lends nothing.
DONOR_DAYS, ASLEEP_DAYS = 180, 89
SLOTS = 19

_FORECAST = (
    "sku string, cutoff date, block string, engine string, days int, selling_days int, units double, adi double, cv2 double, relatives int, scale double, sigma double, "
    "basis array<double>, yhat array<double>, lower array<double>, upper array<double>"
)


def _calendar(start: pd.Timestamp, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Days since 1970, weekday (Monday 0) and month (1 to 12) of n days from start on."""
    day = (np.datetime64(start, "D") + np.arange(n)).astype("datetime64[D]")
    number = day.astype(np.int64)
    return number.astype(float), (number + 3) % 7, day.astype("datetime64[M]").astype(np.int64) % 12 + 1


def growth(y: np.ndarray, day: np.ndarray, month: np.ndarray) -> float:
    """Yearly log growth where months of two years can be compared, else 0; the rule of trend.slope()."""
    if len(y) < trend.LEAST_ROWS:
        return 0.0
    edge = np.flatnonzero(np.append(True, month[1:] != month[:-1]))
    size = np.diff(np.append(edge, len(y)))
    keep = size >= 10
    edge, w = edge[keep], size[keep].astype(float)
    mean = np.add.reduceat(y, np.flatnonzero(np.append(True, month[1:] != month[:-1])))[keep] / w
    first = np.array([(np.datetime64(int(day[e]), "D").astype("datetime64[M]").astype("datetime64[D]")).astype(np.int64) for e in edge], float)
    x, z, m = (first + 14 - day[0]) / 365.25, np.log(np.maximum(mean, 0) + 0.1 * y.mean() + 1e-6), month[edge]
    top = bottom = 0.0
    repeated = 0
    for k in np.unique(m):
        at = m == k
        repeated += at.sum() >= 2
        sw, sx, sz = w[at].sum(), (w * x)[at].sum(), (w * z)[at].sum()
        top += (w * x * z)[at].sum() - sx * sz / sw
        bottom += (w * x * x)[at].sum() - sx * sx / sw
    if len(m) < trend.LEAST_MONTHS or repeated < trend.REPEATED_MONTHS or bottom <= 0:
        return 0.0
    return float(np.clip(top / bottom, -trend.STEEPEST, trend.STEEPEST))


def shape(y: np.ndarray, day: np.ndarray, weekday: np.ndarray, month: np.ndarray) -> np.ndarray:
    """Detrended means over the mean, by weekday and month, nan where there are none: what a donor lends."""
    f = np.exp(growth(y, day, month) * (day - day[0]) / 365.25)
    level = y * f.mean() / f
    ratio = level / (level.mean() or 1.0)
    slot = lambda by, k: ratio[by == k].mean() if (by == k).any() else np.nan
    return np.array([*(slot(weekday, k) for k in range(7)), *(slot(month, k) for k in range(1, 13))])


def _rates(y: np.ndarray) -> dict[str, float]:
    """The rates of engines.sparse_rates() at the end of a series."""
    at = np.flatnonzero(y > 0)
    if not len(at):
        return {"classic": 0.0, "corrected": 0.0, "decaying": 0.0}
    n, age = len(at), np.arange(len(at) - 1, -1, -1)
    first = np.arange(n) == 0
    smooth = lambda a, v: float((np.where(first, 1.0, a) * (1 - a) ** age * v).sum())
    b = engines.DECAY_WEIGHT
    classic = smooth(0.1, y[at]) / smooth(0.1, np.diff(np.append(-1, at)))
    chance = float((np.where(at == 0, 1.0, b) * (1 - b) ** (len(y) - 1 - at)).sum())
    return {"classic": classic, "corrected": 0.95 * classic, "decaying": smooth(b, y[at]) * chance}


def sparse_series(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """yhat, lower, upper and hold-out errors by the model that engines.sparse_forecast() would choose, the decaying one tried for all."""
    n = len(y)
    h = int(min(28, max(7, n // 6)))
    tries = 3 if n >= 6 * h else 2 if n >= 4 * h else 1
    errors: dict[str, list[np.ndarray]] = {"classic": [], "corrected": [], "decaying": []}
    for k in range(tries, 0, -1):
        if n - k * h >= 1:
            for model, rate in _rates(y[: n - k * h]).items():
                errors[model].append(y[n - k * h : n - (k - 1) * h] - rate)
    model = "classic"
    if errors["classic"]:
        miss = {m: np.abs(np.concatenate(e)).mean() for m, e in errors.items()}
        for m in ("corrected", "decaying"):
            model = m if miss[m] < engines.CHALLENGE * miss[model] else model
    rate = _rates(y)[model]
    resid = np.concatenate(errors[model]) if errors[model] else np.zeros(0)
    lo, hi = np.percentile(resid, [10, 90]) if len(resid) else (0.0, 0.0)
    flat = np.ones(horizon)
    return rate * flat, max(rate + engines.SPARSE_WIDENING * lo, 0.0) * flat, max(rate + engines.SPARSE_WIDENING * hi, 0.0) * flat, resid


def pooled_series(y: np.ndarray, index: np.ndarray, weekday: np.ndarray, month: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """yhat, lower, upper and errors in the sample: engines.pooled_forecast() with a family's index; weekday and month go on over the horizon."""
    index = np.where(np.isfinite(index), index, 1.0)
    index = np.concatenate((index[:7] / index[:7].mean(), index[7:] / index[7:].mean()))
    season = index[weekday] * index[6 + month]
    n, past = len(y), slice(max(0, len(y) - engines.LEVEL_ROWS), len(y))
    z = y[past] / np.where(season[past] > 1e-6, season[past], 1.0)
    level, slope, start = (z.mean() if n >= 7 and y.sum() > 0 else y.mean()), 0.0, 0.0
    if len(z) >= engines.TREND_ROWS and y.sum() > 0:
        slope, start = np.polyfit(np.arange(1 - len(z), 1, dtype=float), z, 1)
    grows = slope > 0 and 30 * slope >= engines.TREND_SHARE * max(level, 1.0)
    d = engines.TREND_DAMPING
    ahead = np.arange(1, horizon + 1)
    base = max(start, 0.0) + min(slope, level) * d * (1 - d**ahead) / (1 - d) if grows else np.full(horizon, level)
    yhat = np.maximum(base * season[n : n + horizon], 0.0)
    resid = y[past] - level * season[past]
    hi = 1.2816 * resid.std()
    return yhat, np.maximum(yhat - hi, 0.0), yhat + hi, resid


def buffer_basis(resid: np.ndarray, sigma: float, lead: int) -> float:
    """The deviation of demand over a lead time: sigma sqrt(lead), widened to that of sums of errors in a row, three times at most."""
    plain = sigma * np.sqrt(lead)
    if len(resid) < lead + 5:
        return plain
    sums = np.convolve(resid, np.ones(lead), "valid")
    return plain if len(sums) < 6 else float(min(max(sums.std(ddof=1), plain), 3 * plain))


def _lend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each donor's shape as of each cutoff of its family."""
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            y, start = np.asarray(r.y, float), pd.Timestamp(r.start)
            day, weekday, month = _calendar(start, len(y))
            for cutoff in r.cutoffs:
                n = (pd.Timestamp(cutoff) - start).days + 1
                if DONOR_DAYS <= n <= len(y) and y[max(0, n - ASLEEP_DAYS) : n].any():
                    out.append((r.sku, r.category, cutoff, shape(y[:n], day[:n], weekday[:n], month[:n]).tolist()))
        yield pd.DataFrame(out, columns=["sku", "category", "cutoff", "shape"])


def _forecast(horizon: int, leads: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                start = pd.Timestamp(r.start)
                day, weekday, month = _calendar(start, len(r.y) + horizon)
                for c in r.cutoffs:
                    n = (pd.Timestamp(c["cutoff"]) - start).days + 1
                    y = np.asarray(r.y[:n], float)  # nothing after the cutoff goes further
                    sold = y[y > 0]
                    step = np.abs(y[7:] - y[:-7])
                    scale = float(step.mean()) if len(step) and step.mean() > 1e-9 else None
                    found = {"regular": engines.fitted_series(y, day[:n], horizon), "sparse": sparse_series(y, horizon)}
                    if c["relatives"] and c["relatives"] >= engines.RELATIVES:
                        found["pooled"] = pooled_series(y, np.array(c["index"], float), weekday, month, horizon)
                    for engine, (yhat, lower, upper, *_, resid) in found.items():
                        sigma = float(resid.std()) if len(resid) >= 8 else float(y.std())
                        out.append((
                            r.sku, c["cutoff"], c["block"], engine, n, len(sold), float(y.sum()), n / len(sold) if len(sold) else None, float((sold.std() / sold.mean()) ** 2) if len(sold) else None,
                            int(c["relatives"] or 0), scale, sigma, [buffer_basis(resid, sigma, lead) for lead in leads], np.maximum(yhat, 0.0).tolist(), lower.tolist(), upper.tolist(),
                        ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FORECAST.split(", ")])

    return run


def forecasts_as_of(filled: DataFrame, keys: DataFrame, schedule: DataFrame, horizon: int = 44, leads: tuple[int, ...] = (14,)) -> DataFrame:
    """One row per product, cutoff and engine: what the engine would have said then; schedule has (sku, cutoff, block), keys (sku, category).

    A product's days are one array, of a few thousand numbers; its cutoffs are refit CUTOFFS_A_ROW at a time, spread over the tasks.  The pooled engine's family is known as of the same
    day: donors' shapes are taken at every cutoff of the family and summed, and a product's own part is taken out of the sum.
    """
    series = filled.groupBy("sku").agg(F.min("ds").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda d: d["y"]).alias("y")).join(keys, "sku")
    moments = schedule.join(keys, "sku").groupBy("category").agg(F.array_sort(F.collect_set("cutoff")).alias("cutoffs"))
    donors = series.join(moments, "category").select("sku", "category", "start", "y", "cutoffs")
    lent = staged(donors.repartition("sku").mapInPandas(_lend, "sku string, category string, cutoff date, shape array<double>"))
    slots = lent.select("sku", "category", "cutoff", F.posexplode("shape").alias("slot", "v"))
    sums = slots.groupBy("category", "cutoff", "slot").agg(F.sum(F.when(~F.isnan("v"), F.col("v"))).alias("s"), F.count(F.when(~F.isnan("v"), 1)).alias("n"), F.count("*").alias("donors"))
    asked = schedule.join(keys, "sku").join(sums, ["category", "cutoff"], "left").join(slots.select("sku", "cutoff", "slot", F.col("v").alias("own")), ["sku", "cutoff", "slot"], "left")
    known = F.col("own").isNotNull() & ~F.isnan("own")
    others, left = F.col("s") - F.when(known, F.col("own")).otherwise(0.0), F.col("n") - known.cast("int")
    index = F.when(left > 0, others / left).otherwise(F.lit(float("nan")))
    rows = asked.withColumns({"v": index, "r": F.col("donors") - F.col("own").isNotNull().cast("int")})
    by_cutoff = rows.groupBy("sku", "cutoff", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "v")))), lambda x: x["v"]).alias("index"), F.coalesce(F.max("r"), F.lit(0)).cast("int").alias("relatives")
    )
    listed = by_cutoff.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("cutoff", "block", "index", "relatives"))).alias("cutoffs"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("cutoffs") - 1) / CUTOFFS_A_ROW).cast("int")), lambda i: F.slice("cutoffs", i * CUTOFFS_A_ROW + 1, CUTOFFS_A_ROW))
    spread = series.join(listed, "sku").select("sku", "start", "y", F.posexplode(parts).alias("part", "cutoffs")).repartition("sku", "part").drop("part")
    return spread.mapInPandas(_forecast(horizon, leads), _FORECAST)


def routed(forecasts: DataFrame) -> DataFrame:
    """Adds `routed`: whether the product would have been forecast by this engine on the day of the cutoff."""
    often, even = F.col("adi") < demand.INTERVAL_CUT, F.col("cv2") < demand.VARIATION_CUT
    kind = F.when(F.col("selling_days") == 0, "no_demand").when(often & even, "smooth").when(often, "erratic").when(even, "intermittent").otherwise("lumpy")
    key = F.concat_ws("|", "sku", "cutoff")
    classes = forecasts.select(key.alias("sku"), "days", "selling_days", "units", kind.alias("demand_class"), "relatives").distinct()
    routes = demand.route(classes.drop("relatives"), classes.select("sku", "relatives", F.lit(None).cast("double").alias("cohesion")))
    met = forecasts.withColumn("key", key).join(routes.select(F.col("sku").alias("key"), "route"), "key").drop("key")
    return met.withColumn("routed", F.col("route") == F.col("engine"))


def score(forecasts: DataFrame, filled: DataFrame, combos: tuple[tuple[int, int], ...] = ((14, 30),), z: float = 1.6449) -> DataFrame:
    """One row per forecast and pair of lead time and coverage: accuracy over the window, and what an order placed at the cutoff would have met.

    forecasts were made for the lead times of combos, in that order.  covered tells whether the forecast and z deviations outlast the lead time, short what was missing, order_err
    by how much percent the order for the coverage after it was off.
    """
    key = ["sku", "cutoff", "engine"]
    days = forecasts.select(*key, F.posexplode(F.arrays_zip("yhat", "lower", "upper")).alias("i", "f")).select(*key, (F.col("i") + 1).alias("day"), F.expr("date_add(cutoff, i + 1)").alias("ds"), "f.*")
    met = days.join(filled.select("sku", "ds", "y"), ["sku", "ds"])
    err = F.abs(F.col("y") - F.col("yhat"))
    inside = (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    within = lambda c, a, b: F.coalesce(F.sum(F.when((F.col("day") > a) & (F.col("day") <= b), F.col(c))), F.lit(0.0))
    sums = [F.struct(F.lit(k).alias("k"), F.lit(lead).alias("lead"), F.lit(cover).alias("coverage"), within("yhat", 0, lead).alias("f_lead"), within("y", 0, lead).alias("a_lead"), within("yhat", lead, lead + cover).alias("f_cover"), within("y", lead, lead + cover).alias("a_cover")) for k, (lead, cover) in enumerate(combos)]
    windows = met.groupBy(*key).agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum("yhat").alias("sum_yhat"), F.sum(err).alias("abs_err"), F.avg(inside.cast("double")).alias("inside"), F.array(*sums).alias("combos"))
    rows = forecasts.drop("yhat", "lower", "upper").join(windows, key).select("*", F.inline("combos")).withColumn("safety", z * F.element_at("basis", F.col("k") + 1))
    gap = F.col("a_lead") - F.col("f_lead") - F.col("safety")
    return rows.withColumns(
        {
            "mae": F.col("abs_err") / F.col("n"),
            "mase": F.col("abs_err") / F.col("n") / F.col("scale"),
            "wape": F.when(F.col("sum_y") > 0, F.col("abs_err") / F.col("sum_y")),
            "covered": (gap <= 0).cast("double"),
            "short": F.greatest(gap, F.lit(0.0)),
            "order_err": F.when(F.col("a_cover") > 0, 100 * (F.col("f_cover") - F.col("a_cover")) / F.col("a_cover")),
        }
    ).drop("combos", "basis", "k", "f_lead", "a_lead", "f_cover", "a_cover")


def run(filled: DataFrame, keys: DataFrame, combos: tuple[tuple[int, int], ...] = ((14, 30),), horizon: int = 44) -> DataFrame:
    """The whole backtest: schedule, forecasts as of each cutoff, routes and scores, over a horizon that holds every pair of lead time and coverage."""
    horizon = backtest.effective_horizon(horizon, list(combos))
    made = staged(forecasts_as_of(filled, keys, staged(backtest.cutoffs(filled, horizon)), horizon, tuple(lead for lead, _ in combos)))
    return score(routed(made), filled, combos)


def summary(scored: DataFrame) -> DataFrame:
    """(engine, lead, coverage, windows, products, wape, mase, bias, inside_pct, service_pct, order_err): per engine, and as `routed` over the windows of the engine that would have been chosen."""
    chosen = scored.where("routed").withColumn("engine", F.lit("routed"))
    return scored.unionByName(chosen).groupBy("engine", "lead", "coverage").agg(
        F.count("*").alias("windows"), F.count_distinct("sku").alias("products"), (100 * F.sum("abs_err") / F.sum("sum_y")).alias("wape"), F.avg("mase").alias("mase"),
        (100 * (F.sum("sum_yhat") - F.sum("sum_y")) / F.sum("sum_y")).alias("bias"), (100 * F.avg("inside")).alias("inside_pct"), (100 * F.avg("covered")).alias("service_pct"), F.avg("order_err").alias("order_err"),
    )

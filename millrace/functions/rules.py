"""Scalar rules as SQL expressions, for F.expr and SQL alike; each names the columns that it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Horizons of history before a forecast counts as measured or usable, floors in days, and the usual horizon.
READY_HORIZONS, USABLE_HORIZONS, READY_FLOOR, USABLE_FLOOR, HORIZON = 4, 2, 60, 30, 44
#: Selling days and units of established products, and the least history.
ESTABLISHED_SELLING_DAYS, ESTABLISHED_UNITS, LEAST_SELLING_DAYS, LEAST_UNITS = 45, 60, 15, 30
#: Service levels in percent and their normal quantiles.
TIERS = (("light", 90.0, 1.282), ("standard", 95.0, 1.645), ("high", 98.0, 2.054), ("max", 99.0, 2.326), ("ultra", 99.5, 2.576))


def thresholds(horizon: str = str(HORIZON)) -> dict[str, str]:
    """Days of history at which a forecast is measured and usable."""
    return {"ready_days": f"greatest({READY_HORIZONS} * {horizon}, {READY_FLOOR})", "usable_days": f"greatest({USABLE_HORIZONS} * {horizon}, {USABLE_FLOOR})"}


#: demand_class
PREDICTABILITY = (
    "CASE demand_class WHEN 'smooth' THEN 'steady' WHEN 'erratic' THEN 'variable' WHEN 'intermittent' THEN 'occasional' "
    "WHEN 'lumpy' THEN 'occasional' WHEN 'no_demand' THEN 'dormant' ELSE 'unknown' END"
)
_READY = f"days >= ready_days AND selling_days >= {ESTABLISHED_SELLING_DAYS} AND units >= {ESTABLISHED_UNITS}"
_USABLE = f"days >= usable_days AND selling_days >= {LEAST_SELLING_DAYS} AND units >= {LEAST_UNITS}"
#: days, selling_days, units, ready_days, usable_days, predictability
GRADE = (
    f"CASE WHEN NOT ({_READY}) AND NOT ({_USABLE}) THEN 'INSUFFICIENT' WHEN predictability IN ('occasional', 'dormant') THEN 'LOW_CONFIDENCE' "
    f"WHEN {_READY} THEN 'FORECAST_ELIGIBLE' ELSE 'LOW_CONFIDENCE' END"
)
#: the same and grade
GRADE_REASON = (
    "CASE WHEN grade <> 'INSUFFICIENT' AND predictability = 'dormant' THEN 'dormant' WHEN grade <> 'INSUFFICIENT' AND predictability = 'occasional' THEN 'intermittent_demand' "
    "WHEN grade = 'FORECAST_ELIGIBLE' THEN 'established' WHEN grade = 'LOW_CONFIDENCE' THEN 'partial_history' "
    f"WHEN days < usable_days AND units < {LEAST_UNITS} AND selling_days < {LEAST_SELLING_DAYS} THEN 'new_product' "
    f"WHEN days < usable_days THEN 'short_history' WHEN selling_days < {LEAST_SELLING_DAYS} THEN 'few_selling_days' ELSE 'low_volume' END"
)


def reliability(forecast_days: str, history_days: str) -> str:
    """The share of the window in the history: green under a quarter, yellow under a half, orange under three quarters."""
    r = f"(CASE WHEN {history_days} > 0 THEN 1.0 * {forecast_days} / {history_days} ELSE 1.0 END)"
    return f"CASE WHEN {r} < 0.25 THEN 'GREEN' WHEN {r} < 0.50 THEN 'YELLOW' WHEN {r} < 0.75 THEN 'ORANGE' ELSE 'RED' END"


#: Dispersion cuts and the score at the edges of the colours.
STEADY, VARIABLE, FLOOR, GREEN, AMBER = 1.25, 2.00, 3.5, 0.66, 0.33


def volatility_score(d: str) -> str:
    """A bar from 1 (steady) to 0.1, linear between the cuts of the labels."""
    return (
        f"CASE WHEN {d} IS NULL THEN 0.6 WHEN {d} <= 1.0 THEN 1.0 WHEN {d} <= {STEADY} THEN 1.0 - ({d} - 1.0) / {STEADY - 1.0} * {1.0 - GREEN - 0.01} "
        f"WHEN {d} < {VARIABLE} THEN {GREEN - 0.01} - ({d} - {STEADY}) / {VARIABLE - STEADY} * {GREEN - 0.01 - AMBER} WHEN {d} >= {FLOOR} THEN 0.10 "
        f"ELSE greatest(0.10, {AMBER - 0.01} - ({d} - {VARIABLE}) / {FLOOR - VARIABLE} * {AMBER - 0.11}) END"
    )


#: demand_class, dormant, days, selling_days, units: steady trickles and sales that come now and then.
SPARSE_SUBTYPE = (
    "CASE WHEN demand_class NOT IN ('intermittent', 'lumpy', 'no_demand') THEN '' WHEN dormant THEN 'true_intermittent' "
    "WHEN 1.0 * selling_days / days >= 0.30 AND 1.0 * units / days <= 1.5 THEN 'low_volume_regular' ELSE 'true_intermittent' END"
)
#: days at one price
TIER_QUALITY = "CASE WHEN days >= 90 THEN 'reliable' WHEN days >= 60 THEN 'moderate' WHEN days >= 30 THEN 'weak' ELSE 'insufficient' END"
#: price, range_lo, range_hi: how far outside the known prices, in widths of their range.
EXTRAPOLATION_DISTANCE = (
    "CASE WHEN price IS NULL OR range_lo IS NULL OR range_hi IS NULL THEN 0.0 WHEN price < range_lo THEN (range_lo - price) / greatest(range_hi - range_lo, 0.05 * range_hi, 1e-9) "
    "WHEN price > range_hi THEN (price - range_hi) / greatest(range_hi - range_lo, 0.05 * range_hi, 1e-9) ELSE 0.0 END"
)


def extrapolation_uncertainty(distance: str, floor: float = 0.25) -> str:
    return f"least(1.0, {floor} + 0.4 * greatest(0.0, {distance}))"


def price_multiplier(elasticity: str, base: str, new: str) -> str:
    return f"(CASE WHEN {base} > 0 AND {new} > 0 AND {elasticity} <> 0 THEN power({new} / {base}, {elasticity}) ELSE 1.0 END)"


def tapered(edge: str, raw: str, ref: str = "1.0") -> str:
    """Beyond the edge the extra response nears five times or a fifth without reaching them."""
    le, lb = f"ln({edge} / {ref})", f"ln({raw} / {edge})"
    up, down = f"greatest(ln(5.0) - {le}, 1e-9)", f"greatest({le} - ln(0.2), 1e-9)"
    eased = f"CASE WHEN {lb} >= 0 THEN {up} * tanh({lb} / {up}) ELSE -({down}) * tanh(-({lb}) / {down}) END"
    return f"(CASE WHEN {edge} > 1e-12 AND {raw} > 1e-12 AND {ref} > 1e-12 THEN {edge} * exp({eased}) ELSE {raw} END)"


def price_response(elasticity: str, base: str, new: str, lo: str, hi: str) -> str:
    """Demand at a new price over demand at the base price, tapered beyond the known range and within a fifth and five."""
    m, at_lo, at_hi = (price_multiplier(elasticity, base, p) for p in (new, lo, hi))
    m = f"(CASE WHEN {elasticity} <> 0 AND {new} < {lo} THEN {tapered(at_lo, m)} WHEN {elasticity} <> 0 AND {new} > {hi} THEN {tapered(at_hi, m)} ELSE {m} END)"
    return f"least(greatest({m}, 0.2), 5.0)"


#: lead: a shortage looms within half the lead time, an order is due within one and a half; halves go to the even number.
RISK_DAYS, DUE_DAYS = "greatest(1, {half_even}(0.5 * lead))", "greatest(2, {half_even}(1.5 * lead))"
#: stock_counted, dormant, ever_sold, on_order, days_to_reorder, risk, due, sell_through, days_of_cover, lead, coverage, excused (new, off season or sold within a year)
STATUS = (
    "CASE WHEN NOT stock_counted THEN 'Stock not counted' WHEN dormant AND ever_sold THEN 'Dead stock' WHEN NOT on_order AND days_to_reorder < risk THEN 'Stockout risk' "
    "WHEN sell_through < 0.05 AND (days_of_cover IS NULL OR days_of_cover > 3 * (lead + coverage)) THEN CASE WHEN excused THEN 'Overstocked' ELSE 'Dead stock' END "
    "WHEN days_of_cover IS NULL OR days_of_cover > lead + coverage THEN 'Overstocked' WHEN NOT on_order AND days_to_reorder BETWEEN risk AND due THEN 'Reorder due' ELSE 'Healthy' END"
)
#: status, on_order, days_to_reorder, risk, due: the status where there is one, else what timing alone can say.
SKU_STATE = (
    "CASE WHEN status IS NOT NULL THEN CASE status WHEN 'Stockout risk' THEN 'stockout' WHEN 'Reorder due' THEN 'reorder' WHEN 'Healthy' THEN 'healthy' WHEN 'Overstocked' THEN 'overstock' "
    "WHEN 'Dead stock' THEN 'dead' ELSE 'unrated' END WHEN NOT on_order AND days_to_reorder < risk THEN 'stockout' WHEN NOT on_order AND days_to_reorder <= due THEN 'reorder' ELSE 'unrated' END"
)
#: price, unit_cost, fees
UNIT_MARGIN = "CASE WHEN price > 0 AND unit_cost > 0 THEN price - unit_cost - coalesce(fees, 0.0) END"
#: margin_pct of price
UNIT_GRADE = "CASE WHEN margin_pct >= 45 THEN 'A' WHEN margin_pct >= 30 THEN 'B' WHEN margin_pct >= 15 THEN 'C' WHEN margin_pct > 0 THEN 'D' WHEN margin_pct IS NOT NULL THEN 'F' END"
#: train_days
TRAIN_BUCKET = "CASE WHEN train_days < 180 THEN '<180d' WHEN train_days < 365 THEN '180-365d' ELSE '>365d' END"
#: actual, predicted, lo, hi
BAND_Z = "CASE WHEN hi > lo THEN (actual - predicted) / ((hi - lo) / 2) END"
#: n, in_rate, median_z, nominal
WEEK_VERDICT = (
    "CASE WHEN n < 10 OR in_rate IS NULL OR median_z IS NULL THEN 'too-few' WHEN median_z > 1.0 OR in_rate - nominal < -20 THEN 'bands-too-narrow' "
    "WHEN median_z < 0.25 AND in_rate - nominal > 12 THEN 'bands-too-wide' WHEN median_z <= 0.75 AND abs(in_rate - nominal) <= 12 THEN 'calibrated' ELSE 'drifting' END"
)
#: n, gap, se
CALIBRATION_VERDICT = "CASE WHEN n < 10 THEN 'too-few' WHEN abs(gap) <= 2 * se THEN 'calibrated' WHEN gap < 0 THEN 'overconfident' ELSE 'underconfident' END"


def normal_density(z: str) -> str:
    return f"(exp(-0.5 * {z} * {z}) / 2.5066282746310002)"


def normal_tail(z: str) -> str:
    """1 - Phi(z) for z >= 0, by the rational approximation of Abramowitz and Stegun 26.2.17; its error is under 7.5e-8."""
    t = f"(1.0 / (1.0 + 0.2316419 * {z}))"
    series = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"({normal_density(z)} * {series})"


def expected_shortage(spread: str, z: str) -> str:
    """Units beyond z deviations that a normal error of this spread is short on average."""
    return f"(CASE WHEN {spread} > 0 THEN {spread} * greatest(0.0, {normal_density(z)} - {z} * {normal_tail(z)}) ELSE 0.0 END)"


def half_even(rule: str, name: str) -> str:
    """Rules that round halves to even name the engine's function."""
    return rule.replace("{half_even}", name)


def with_rules(df: DataFrame, **rules: str) -> DataFrame:
    """Adds columns one after the other; a later rule may read an earlier one's."""
    for name, rule in rules.items():
        df = df.withColumn(name, rule if isinstance(rule, Column) else F.expr(half_even(rule, "bround")))
    return df

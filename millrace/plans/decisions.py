"""Queries on grades, prices, protection, the sealed log and sheets, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import backtest, bands, bundles, calendar, demand, livelog, planning, pricing, seasonality, telemetry, trend
from millrace.plans.queries import (
    AGED, BOM, DAILY, ELASTICITY_SQL, EVIDENCE_SQL, FILLED, HOURS, INDEX, LIFT_SQL, LINES, LOCAL_DAY, PRICE_LEVELS_SQL, READINGS, RESIDUALS, SCORES, STEPPED, STORE_ZONE, TREND_LINEAR, UNSHRUNK_INDEX,
    _bundle_parts, _residuals, daily, filled, rounded, stepped, with_,
)
from millrace.sources import ingest, tables
from millrace.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r(expr: str, digits: int = 4) -> str:
    return f"round({expr} + 1e-9, {digits})"


STATS = """ends AS (SELECT max(ds) AS e FROM daily),
stats AS (SELECT sku, min(ds) AS start, count(*) FILTER (y > 0) AS selling_days, sum(y) AS units, avg(y) FILTER (y > 0) AS mean, stddev_pop(y) FILTER (y > 0) AS sd,
  date_diff('day', min(ds), (SELECT e FROM ends)) + 1 AS days, date_diff('day', max(ds) FILTER (y > 0), (SELECT e FROM ends)) AS tail,
  (date_diff('day', min(ds) FILTER (y > 0), max(ds) FILTER (y > 0)) + 1) / CAST(count(*) FILTER (y > 0) AS DOUBLE) AS active_adi FROM daily GROUP BY sku),
classes AS (SELECT sku, start, days, selling_days, units, CAST(days AS DOUBLE) / selling_days AS adi, tail >= greatest(45.0, 4 * active_adi) AS dormant,
  CASE WHEN CAST(days AS DOUBLE) / selling_days < 1.32 THEN CASE WHEN power(sd / mean, 2) < 0.49 THEN 'smooth' ELSE 'erratic' END WHEN power(sd / mean, 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_class FROM stats)"""


@query(
    with_(LINES, DAILY, STATS, key="p_partkey")
    + f""", t AS (SELECT *, {rules.thresholds()['ready_days']} AS ready_days, {rules.thresholds()['usable_days']} AS usable_days, {rules.PREDICTABILITY} AS predictability FROM classes),
g AS (SELECT *, {rules.GRADE} AS grade FROM t)
SELECT sku, days, selling_days, units, predictability, grade, {rules.GRADE_REASON} AS reason, {rules.SPARSE_SUBTYPE} AS subtype, {rules.reliability('90', 'days')} AS reliability FROM g"""
)
def forecast_grades(spark, d):
    """Grade, reason, sparse subtype and reliability of each product."""
    rows = daily(spark, d, "p_partkey")
    classes = demand.grades(demand.classify(rows)).join(demand.dormancy(rows).select("sku", "dormant"), "sku")
    out = rules.with_rules(classes, subtype=F.expr(rules.SPARSE_SUBTYPE), reliability=F.expr(rules.reliability("90", "days")))
    return out.select("sku", "days", "selling_days", "units", "predictability", "grade", "reason", "subtype", "reliability")


WINDOWS = """wins AS (SELECT d.sku, (SELECT e FROM ends) AS e, min(ds) AS start, {sums} FROM (SELECT *, date_diff('day', ds, (SELECT e FROM ends)) AS age FROM daily) d GROUP BY d.sku)"""


def win(name: str, lo: int, hi: int) -> str:
    return f"coalesce(sum(y) FILTER (age BETWEEN {lo} AND {hi}), 0) AS {name}, greatest(least(max(age), {hi}) - {lo} + 1, 0) AS n_{name}"


SEASON_SQL = WINDOWS.replace("{sums}", ", ".join((win("yr", 0, 363), win("prev", 364, 728), win("cur", 0, 28), win("was", 364, 393)))) + """,
off AS (SELECT sku, date_diff('day', start, e) + 1 >= 400 AND n_yr >= 300 AND n_was >= 20 AND yr >= 6 AND cur <= 0.25 * yr / n_yr * 30
  AND was <= 0.25 * greatest(CASE WHEN n_prev >= 300 THEN prev / n_prev * 30 ELSE yr / n_yr * 30 END, 1e-9) AND NOT (n_prev >= 300 AND yr < 0.5 * prev) AS off_season FROM wins)"""


@query(with_(LINES, DAILY, STATS, SEASON_SQL, key="p_partkey") + "SELECT sku, off_season FROM off")
def off_season(spark, d):
    return demand.off_season(daily(spark, d, "p_partkey"))


@query(with_(LINES, DAILY, STATS, SEASON_SQL, key="p_partkey") + "SELECT sku, date_diff('day', max(ds) FILTER (y > 0), max(e)) >= 89 AND NOT bool_or(off_season) AS excluded FROM daily JOIN off USING (sku), ends GROUP BY sku")
def pooling_exclusion(spark, d):
    return demand.pooling_exclusion(daily(spark, d, "p_partkey"))


@query(
    with_(LINES, DAILY, STATS, WINDOWS.replace("{sums}", ", ".join((win("yr", 0, 364), win("prev", 365, 729)))), key="p_partkey")
    + "SELECT sku, NOT (n_prev >= 300 AND yr < 0.5 * prev) AND yr > 0 AND yr >= CAST(sku AS INTEGER) % 90 AS sells FROM wins"
)
def sells_in_a_year(spark, d):
    rows = daily(spark, d, "p_partkey")
    return demand.sells_in_a_year(rows, rows.select("sku").distinct().withColumn("on_hand", F.col("sku").cast("int") % 90))


@query(
    with_(LINES, DAILY, FILLED, key="p_brand")
    + f", x AS (SELECT sku, CASE WHEN avg(y) > 0 AND sum(y) >= 20 THEN stddev_pop(y) / sqrt(avg(y)) / 3 END AS d FROM filled GROUP BY sku) SELECT sku, {r(rules.volatility_score('d'))} AS score FROM x"
)
def volatility_score(spark, d):
    rows = demand.dispersion(filled(spark, d, "p_brand")).withColumn("d", F.col("dispersion") / 3)
    return rounded(rules.with_rules(rows, score=F.expr(rules.volatility_score("d"))).select("sku", "score"), "score")


@query(with_(LINES, DAILY, FILLED, TREND_LINEAR, key="p_brand") + f"SELECT sku, basis, {r('b')} AS slope FROM tslope")
def trend_slope(spark, d):
    return rounded(trend.slope(filled(spark, d, "p_brand")).select("sku", "basis", "slope"), "slope")


COHORT = """, coh0 AS (SELECT substring(sku, 1, 7) AS category, month, avg(x) AS x FROM r3 GROUP BY 1, 2 HAVING count(*) >= 2),
""" + ",\n".join(
    f"coh{i + 1} AS (SELECT category, month, least(greatest(x / avg(x) OVER (PARTITION BY category), 0.25), 4.0) AS x FROM coh{i})" for i in range(4)
)


def _families(rows: DataFrame) -> DataFrame:
    return rows.select("sku", F.substring("sku", 1, 7).alias("category")).distinct()


@query(with_(LINES, DAILY, FILLED, UNSHRUNK_INDEX, key="p_brand") + COHORT + f"SELECT category, CAST(month AS INTEGER) AS month, {r('x')} AS \"index\" FROM coh4")
def cohort_index(spark, d):
    rows = filled(spark, d, "p_brand")
    return rounded(seasonality.cohort_index(seasonality.monthly_index(rows, shrink=False), _families(rows)), "index")


def _index(spark, d):
    return seasonality.monthly_index(filled(spark, d))


def _coming_days(rows: DataFrame, horizon: int = 60) -> DataFrame:
    end = F.broadcast(rows.agg(F.max("ds").alias("end")))
    return rows.select("sku").distinct().join(end).select("sku", F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", horizon))).alias("ds"))


AHEAD = "ahead AS (SELECT sku, CAST((SELECT max(ds) FROM daily) + CAST(k AS INTEGER) AS DATE) AS ds FROM (SELECT DISTINCT sku FROM daily), (SELECT unnest(range(1, 61)) AS k))"


@query(
    with_(LINES, DAILY, FILLED, INDEX, AHEAD)
    + f""", used AS (SELECT sku FROM r3 GROUP BY sku HAVING (max(x) - min(x)) / 2 >= 0.15), cov AS (SELECT f.sku, avg(x) AS c FROM filled f JOIN r3 ON r3.sku = f.sku AND r3.month = month(f.ds) GROUP BY f.sku)
SELECT a.sku, a.ds, {r('CASE WHEN u.sku IS NULL THEN 1.0 ELSE x / (CASE WHEN c > 0 THEN c ELSE 1 END) END')} AS multiplier
FROM ahead a LEFT JOIN used u USING (sku) LEFT JOIN r3 ON r3.sku = a.sku AND r3.month = month(a.ds) LEFT JOIN cov ON cov.sku = a.sku"""
)
def month_multipliers(spark, d):
    rows, index = filled(spark, d), _index(spark, d)
    return rounded(seasonality.month_multipliers(_coming_days(rows), index, seasonality.coverage_factor(rows, index)), "multiplier")


@query(
    with_(LINES, DAILY, FILLED, INDEX, AHEAD)
    + f""", m AS (SELECT sku, ds, CAST(date_trunc('month', ds) AS DATE) + 14 AS mid FROM ahead),
e AS (SELECT sku, ds, CASE WHEN ds >= mid THEN mid ELSE CAST(mid - INTERVAL 1 MONTH AS DATE) END AS a, CASE WHEN ds >= mid THEN CAST(mid + INTERVAL 1 MONTH AS DATE) ELSE mid END AS b FROM m)
SELECT e.sku, ds, {r("greatest(p.x * (1 - date_diff('day', a, ds) / CAST(date_diff('day', a, b) AS DOUBLE)) + q.x * (date_diff('day', a, ds) / CAST(date_diff('day', a, b) AS DOUBLE)), 1e-6)")} AS \"index\"
FROM e JOIN r3 p ON p.sku = e.sku AND p.month = month(a) JOIN r3 q ON q.sku = e.sku AND q.month = month(b)"""
)
def daily_index(spark, d):
    return rounded(seasonality.daily_index(_coming_days(filled(spark, d)), _index(spark, d)), "index")


GROWTH = """gsum AS (SELECT sku, count(*) FILTER (age < 182) AS cn, count(*) FILTER (age >= 364 AND age < 546) AS ct, coalesce(sum(y) FILTER (age < 182), 0) AS n, coalesce(sum(y) FILTER (age >= 364 AND age < 546), 0) AS t FROM aged GROUP BY sku),
growth AS (SELECT sku, CASE WHEN t <= 0 THEN 1 ELSE least(greatest(exp(ln(greatest((n / cn) / (t / ct), 1e-6)) * least(n, t) / (least(n, t) + 30)), 1 / 3.0), 3.0) END AS growth FROM gsum WHERE cn >= 20 AND ct >= 20),
agree0 AS (SELECT sku, count(*) FILTER (age < 28) AS n, count(*) FILTER (age >= 364 AND age < 392) AS m, sum(y) FILTER (age < 28) AS actual, avg(y) FILTER (age >= 364 AND age < 392) AS rate FROM aged GROUP BY sku),
agree AS (SELECT sku, n, m, actual, coalesce(rate * growth * n, 0) AS expected FROM agree0 JOIN growth USING (sku))"""


@query(
    with_(LINES, DAILY, FILLED, AGED, GROWTH, key="p_brand")
    + f"""SELECT sku, {r('expected')} AS expected, actual, n < 7 OR m < 7 OR NOT ((2 * actual < expected AND expected - actual > 2 * sqrt(2.0 * greatest(expected, 1.0))) OR (actual > 2 * expected AND actual - expected > 2 * sqrt(2.0 * greatest(expected, 1.0)))) AS agrees FROM agree"""
)
def recent_agreement(spark, d):
    rows = filled(spark, d, "p_brand")
    return rounded(seasonality.recent_agrees(rows, seasonality.year_on_year(rows)), "expected")


@query(None)
def same_weeks(spark, d):
    """The coming 30 days from the same weeks of up to three past years; the rules of its parts have SQL of their own."""
    return rounded(seasonality.same_weeks(filled(spark, d, "p_brand")), "yhat")


@query(with_(LINES, DAILY, FILLED, AGED, key="p_brand") + f"SELECT sku, CAST(-(age // 7) AS INTEGER) AS w, sum(y) AS units, {r('avg(y)')} AS rate FROM aged GROUP BY 1, 2 HAVING count(*) >= 4")
def weekly_rates(spark, d):
    return rounded(seasonality.weekly_rates(filled(spark, d, "p_brand")), "rate")


RUNS = """weeks AS (SELECT sku, CAST(-(age // 7) AS INTEGER) AS w, sum(y) AS units, avg(y) AS rate FROM aged GROUP BY 1, 2 HAVING count(*) >= 4),
usuals AS (SELECT a.sku, a.w, median(b.rate) AS usual FROM weeks a JOIN weeks b ON a.sku = b.sku AND abs(a.w - b.w) BETWEEN 2 AND 13 GROUP BY 1, 2 HAVING count(*) >= 4),
hot AS (SELECT weeks.*, weeks.w - row_number() OVER (PARTITION BY sku ORDER BY weeks.w) AS run FROM weeks JOIN usuals USING (sku, w) WHERE usual > 0 AND rate >= 1.5 * usual),
runs AS (SELECT sku, min(w) AS s, max(w) AS e FROM hot GROUP BY sku, run HAVING count(*) >= 2)"""


@query(
    with_(LINES, DAILY, FILLED, AGED, RUNS, key="p_brand")
    + f""", l AS (SELECT r.sku, s, e, avg(rate) FILTER (w BETWEEN s AND e) AS rate, median(rate) FILTER (w BETWEEN s - 8 AND s - 2 OR w BETWEEN e + 2 AND e + 9) AS usual, count(*) FILTER (w BETWEEN s - 8 AND s - 2 OR w BETWEEN e + 2 AND e + 9) AS n
  FROM runs r JOIN weeks k ON k.sku = r.sku AND k.w BETWEEN s - 8 AND e + 9 GROUP BY 1, 2, 3)
SELECT sku, s AS first_week, e AS last_week, {r('rate')} AS rate, {r('usual')} AS usual, {r('rate / usual')} AS ratio FROM l WHERE n >= 2 AND usual > 0"""
)
def rush_levels(spark, d):
    rows = filled(spark, d, "p_brand")
    return rounded(seasonality.rush_levels(rows, seasonality.rush_weeks(rows)), "rate", "usual", "ratio")


PRICED_SQL = "WITH RECURSIVE " + STEPPED + ",\n" + PRICE_LEVELS_SQL + ",\n" + EVIDENCE_SQL


def _evidence(rows: DataFrame) -> DataFrame:
    return pricing.price_evidence(rows, pricing.price_levels(rows))


@query(PRICED_SQL + "SELECT sku, round(least(0.2 * lo, last_price) + 1e-9, 2) AS lo, round(greatest(2.0 * hi, last_price) + 1e-9, 2) AS hi FROM ev WHERE reason = 'usable'")
def price_bounds(spark, d):
    return pricing.price_bounds(_evidence(stepped(spark, d)))


@query("WITH " + STEPPED + ",\n" + ELASTICITY_SQL + f" SELECT sku, {r('within')} AS elasticity, months FROM within")
def within_month_elasticity(spark, d):
    return rounded(pricing.within_month_elasticity(stepped(spark, d)), "elasticity")


@query(
    "WITH " + STEPPED + ",\n" + LIFT_SQL
    + f""" SELECT substring(sku, 1, 7) AS category, count(*) AS peers, {r('sum(lift * promo_days * promo_days / (promo_days + 5)) / sum(CAST(promo_days AS DOUBLE) * promo_days / (promo_days + 5))')} AS lift
FROM lifts WHERE basis = 'own-history' GROUP BY 1 HAVING count(*) >= 2"""
)
def cohort_promotion_lift(spark, d):
    rows = stepped(spark, d)
    return rounded(pricing.cohort_promotion_lift(pricing.promotion_lift(rows), _families(rows)), "lift")


@query(
    PRICED_SQL + ",\n" + ELASTICITY_SQL
    + f""", u AS (SELECT substring(sku, 1, 7) AS category, elasticity, lo / last_price AS l, hi / last_price AS h FROM elasticities JOIN ev USING (sku) WHERE basis = 'measured' AND elasticity < 0 AND reason = 'usable' AND last_price > 0),
p AS (SELECT category, count(*) AS peers, median(elasticity) AS e, list_sort(list(l))[count(*) // 2 + 1] AS l, list_sort(list(h))[count(*) // 2 + 1] AS h FROM u GROUP BY category HAVING count(*) >= 2)
SELECT category, peers, {r('e')} AS elasticity, {r('least(l, 1.0)')} AS rel_lo, {r('greatest(h, 1.0)')} AS rel_hi FROM p"""
)
def pooled_elasticity(spark, d):
    rows = stepped(spark, d)
    return rounded(pricing.pooled_elasticity(pricing.elasticity(rows), _evidence(rows), _families(rows)), "elasticity", "rel_lo", "rel_hi")


@query("WITH " + STEPPED + " SELECT sku, ds, cents AS price, previous FROM (SELECT sku, ds, cents, lag(cents) OVER (PARTITION BY sku ORDER BY ds) AS previous FROM single) WHERE previous <> cents")
def price_history(spark, d):
    return pricing.price_history(stepped(spark, d))


EVENTS_SQL = """brands AS (SELECT DISTINCT p_brand AS sku, CAST(substring(p_brand, 7) AS INTEGER) AS b FROM part),
events_ AS (SELECT sku, 'price_change_permanent' AS kind, DATE '2002-01-01' + b % 7 AS start, NULL::DATE AS end_, 15.0 + b % 9 AS new_price, NULL::DOUBLE AS pct FROM brands
  UNION ALL SELECT sku, 'price_change_permanent', DATE '2002-01-01' + 15, NULL, 30.0 + b % 4, NULL FROM brands WHERE b % 2 = 0
  UNION ALL SELECT sku, 'price_change_temporary', DATE '2002-01-01' + b % 11, DATE '2002-01-01' + b % 11 + 4, 12.5, NULL FROM brands WHERE b % 3 = 0
  UNION ALL SELECT sku, 'promotion', DATE '2002-01-01' + 8, DATE '2002-01-01' + 14, NULL, 20.0 FROM brands UNION ALL SELECT sku, 'promotion', DATE '2002-01-01' + 12, NULL, NULL, 35.0 FROM brands WHERE b % 2 = 1),
days_ AS (SELECT sku, DATE '2002-01-01' + CAST(k AS INTEGER) AS ds FROM brands, (SELECT unnest(range(0, 31)) AS k)),
path AS (SELECT d.sku, d.ds, arg_max(new_price, start) FILTER (kind = 'price_change_permanent' AND d.ds >= start) AS p, arg_max(new_price, start) FILTER (kind = 'price_change_temporary' AND d.ds BETWEEN start AND coalesce(end_, start)) AS t,
  coalesce(max(pct) FILTER (kind = 'promotion' AND d.ds BETWEEN start AND coalesce(end_, start)), 0) AS pct FROM days_ d JOIN events_ e ON e.sku = d.sku GROUP BY 1, 2),
scheduled AS (SELECT sku, ds, least(greatest(round(coalesce(t, p, 22.0) * (1 - pct / 100) + 1e-9, 2), 11.0), 32.0) AS price, pct AS discount_pct FROM path)"""


def _scheduled(spark, d):
    brands = tables.table(spark, d, "part").select(F.col("p_brand").alias("sku"), F.substring("p_brand", 7, 9).cast("int").alias("b")).distinct()
    first = F.lit("2002-01-01").cast("date")
    none = F.lit(None).cast("double")

    def events(kind, start, length, price, pct, where="true"):
        end = F.date_add(F.date_add(first, start), length) if length is not None else F.lit(None).cast("date")
        return brands.where(where).select("sku", F.lit(kind).alias("kind"), F.date_add(first, start).alias("start"), end.alias("end"), price.cast("double").alias("new_price"), pct.cast("double").alias("discount_pct"))

    b = F.col("b")
    every = (
        events("price_change_permanent", b % 7, None, 15 + b % 9, none)
        .union(events("price_change_permanent", F.lit(15), None, 30 + b % 4, none, "b % 2 = 0"))
        .union(events("price_change_temporary", b % 11, 4, F.lit(12.5), none, "b % 3 = 0"))
        .union(events("promotion", F.lit(8), 6, none, F.lit(20.0)))
        .union(events("promotion", F.lit(12), None, none, F.lit(35.0), "b % 2 = 1"))
    )
    days = brands.select("sku", F.explode(F.sequence(first, F.date_add(first, 30))).alias("ds"), F.lit(22.0).alias("base_price"))
    return pricing.scheduled_prices(days, every, brands.select("sku", F.lit(11.0).alias("lo"), F.lit(32.0).alias("hi")))


@query("WITH " + EVENTS_SQL + " SELECT sku, ds, CAST(price AS DOUBLE) AS price, CAST(discount_pct AS DOUBLE) AS discount_pct FROM scheduled")
def scheduled_prices(spark, d):
    return _scheduled(spark, d)


@query(
    "WITH " + EVENTS_SQL
    + f""", k AS (SELECT sku, ds, CAST(price AS DOUBLE) AS price, discount_pct, 22.0::DOUBLE AS base_price, -0.5::DOUBLE - b % 3 AS elasticity, 18.0::DOUBLE AS lo, 26.0::DOUBLE AS hi FROM scheduled JOIN brands USING (sku))
SELECT sku, ds, {r('(CASE WHEN discount_pct > 0 THEN 1.4 ELSE 1.0 END) * ' + rules.price_response('elasticity', 'base_price', 'price', 'greatest(lo, 1e-6)', 'hi'))} AS multiplier FROM k"""
)
def future_multipliers(spark, d):
    path = _scheduled(spark, d)
    products = path.select("sku", (-0.5 - F.substring("sku", 7, 9).cast("int") % 3).alias("elasticity")).distinct()
    products = products.withColumns({"base_price": F.lit(22.0), "lift": F.lit(1.4), "range_lo": F.lit(18.0), "range_hi": F.lit(26.0)})
    return rounded(pricing.future_multipliers(path, products), "multiplier")


COSTS = """costs AS (SELECT p_partkey AS sku, p_retailprice AS price, p_retailprice * (40 + p_size) / 100.5 AS unit_cost, 0.5::DOUBLE AS fees, 5.0::DOUBLE + p_size AS spread, 30 AS coverage FROM part)"""


def _costs(spark, d):
    part = tables.table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * (40 + F.col("p_size")) / 100.5).alias("unit_cost"), F.lit(0.5).alias("fees"), (5.0 + F.col("p_size")).alias("spread"), F.lit(30).alias("coverage")
    )


@query(
    f"WITH {COSTS}, m AS (SELECT sku, {rules.UNIT_MARGIN} AS per, price FROM costs), n AS (SELECT sku, per, 100 * per / price AS margin_pct FROM m) SELECT sku, {r('per')} AS per_unit, {r('margin_pct')} AS margin_pct, {rules.UNIT_GRADE} AS grade FROM n"
)
def unit_margins(spark, d):
    rows = rules.with_rules(_costs(spark, d), per_unit=F.expr(rules.UNIT_MARGIN), margin_pct=F.expr("100 * per_unit / price"), grade=F.expr(rules.UNIT_GRADE))
    return rounded(rows.select("sku", "per_unit", "margin_pct", "grade"), "per_unit", "margin_pct")


TIER_VALUES = ", ".join(f"('{k}', {s}::DOUBLE, {z}::DOUBLE)" for k, s, z in rules.TIERS)
TIER_COSTS = f"""tiers AS (SELECT * FROM (VALUES {TIER_VALUES}) AS t(tier, service, z)),
tc AS (SELECT sku, tier, service, z, z * spread AS safety_units, {rules.expected_shortage('spread', 'z')} * 365.0 / coverage * (price - unit_cost - fees) AS stockout_cost, z * spread * unit_cost * 0.25 AS holding_cost FROM costs, tiers)"""


@query(f"WITH {COSTS}, {TIER_COSTS} SELECT sku, tier, service, z, {r('safety_units')} AS safety_units, {r('stockout_cost', 2)} AS stockout_cost, {r('holding_cost', 2)} AS holding_cost, {r('stockout_cost + holding_cost', 2)} AS total_cost FROM tc")
def protection_tiers(spark, d):
    return rounded(rounded(planning.protection_tiers(_costs(spark, d)), "safety_units"), "stockout_cost", "holding_cost", "total_cost", digits=2)


@query(
    f"""WITH {COSTS}, {TIER_COSTS}, facts AS (SELECT *, sku % 300 AS days, sku % 170 AS units, CASE sku % 3 WHEN 0 THEN 'smooth' WHEN 1 THEN 'erratic' ELSE 'lumpy' END AS demand_class, 100 * (price - unit_cost) / price AS m, price - unit_cost - fees AS mu FROM costs),
best AS (SELECT sku, tier FROM (SELECT sku, tier, row_number() OVER (PARTITION BY sku ORDER BY round(stockout_cost + holding_cost, 2), service) AS k FROM tc) WHERE k = 1),
j AS (SELECT f.sku, mu, CASE WHEN m < 15 THEN 'light' WHEN m < 30 THEN 'standard' WHEN m < 50 THEN 'high' WHEN m >= 50 THEN 'max' ELSE 'standard' END AS by_margin,
  CASE WHEN mu > 0 AND days >= 180 AND units >= 100 AND demand_class <> 'lumpy' THEN tier END AS best FROM facts f JOIN best USING (sku))
SELECT sku, CASE WHEN mu <= 0 THEN 'light' ELSE coalesce(best, by_margin) END AS protection, CASE WHEN mu <= 0 OR best IS NOT NULL THEN 'economics' ELSE 'margin' END AS source FROM j"""
)
def economic_protection(spark, d):
    kind = F.when(F.col("sku") % 3 == 0, "smooth").when(F.col("sku") % 3 == 1, "erratic").otherwise("lumpy")
    rows = _costs(spark, d).withColumns({"days": F.col("sku") % 300, "units": F.col("sku") % 170, "demand_class": kind})
    return planning.economic_protection(rows)


@query(f"WITH {COSTS} SELECT sku, {r('100 * least(greatest(1 - unit_cost * 0.25 / (365.0 / 30 * (price - unit_cost - fees)), 0), 0.9999)')} AS service FROM costs WHERE price - unit_cost - fees > 0 AND unit_cost > 0")
def critical_ratio(spark, d):
    return rounded(backtest.critical_ratio(_costs(spark, d)), "service")


SCORECARD = f"""facts AS (SELECT *, sku % 61 AS on_hand, CASE WHEN sku % 11 = 0 THEN NULL ELSE sku % 120 END AS days_of_cover, CASE WHEN sku % 11 = 0 THEN NULL ELSE sku % 120 - 14 END AS days_to_reorder, 14 AS lead,
  CAST(sku % 23 AS DOUBLE) * (sku % 2) AS sold_30, sku % 17 <> 0 AS stock_counted, sku % 13 = 0 AS dormant, sku % 26 <> 0 AS ever_sold, sku % 5 = 0 AS on_order, sku % 7 = 0 AS excused FROM costs),
b AS (SELECT *, {rules.half_even(rules.RISK_DAYS, 'round_even').replace('lead)', 'lead, 0)')} AS risk, {rules.half_even(rules.DUE_DAYS, 'round_even').replace('lead)', 'lead, 0)')} AS due, CASE WHEN sold_30 + on_hand > 0 THEN sold_30 / (sold_30 + on_hand) END AS sell_through FROM facts),
scored AS (SELECT *, {rules.STATUS} AS status, greatest(on_hand, 0) * unit_cost AS carrying_value, 100 * (price - unit_cost) / price AS m FROM b)"""


def _scored(spark, d):
    s = F.col("sku")
    known = s % 11 != 0
    rows = _costs(spark, d).withColumns(
        {
            "on_hand": s % 61, "days_of_cover": F.when(known, s % 120), "days_to_reorder": F.when(known, s % 120 - 14), "lead": F.lit(14), "sold_30": (s % 23 * (s % 2)).cast("double"),
            "stock_counted": s % 17 != 0, "dormant": s % 13 == 0, "ever_sold": s % 26 != 0, "on_order": s % 5 == 0, "excused": s % 7 == 0,
        }
    )
    return planning.scorecard(rows)


@query(
    f"""WITH {COSTS}, {SCORECARD} SELECT sku, {r('sell_through')} AS sell_through, CASE WHEN days_of_cover IS NULL THEN 'long' WHEN days_of_cover < 16.8 THEN 'short' WHEN days_of_cover > 44 THEN 'long' ELSE 'healthy' END AS direction,
  status, CASE WHEN m >= 40 THEN 'A' WHEN m >= 20 THEN 'B' WHEN m > 0 THEN 'C' ELSE 'F' END AS return_tier, {r('carrying_value')} AS carrying_value,
  CASE WHEN status = 'Stock not counted' THEN 'count' WHEN status = 'Dead stock' THEN 'clear' WHEN status IN ('Stockout risk', 'Reorder due') THEN CASE WHEN m <= 0 THEN 'review price' ELSE 'order' END WHEN status = 'Overstocked' THEN 'hold' ELSE 'none' END AS action FROM scored"""
)
def scorecard(spark, d):
    return rounded(_scored(spark, d).select("sku", "sell_through", "direction", "status", "return_tier", "carrying_value", "action"), "sell_through", "carrying_value")


@query(f"WITH {COSTS}, {SCORECARD} SELECT status, count(*) AS products, {r('sum(carrying_value)', 2)} AS value FROM scored GROUP BY ROLLUP (status)")
def fleet_summary(spark, d):
    return rounded(planning.fleet_summary(_scored(spark, d)), "value", digits=2)


@query(f"WITH {COSTS}, {SCORECARD} SELECT sku, status, days_to_reorder FROM scored WHERE status IN ('Stockout risk', 'Reorder due') ORDER BY days_to_reorder, sku LIMIT 5")
def attention(spark, d):
    return planning.attention(_scored(spark, d))


@query(f"WITH {COSTS}, {SCORECARD} SELECT sku, {r('carrying_value')} AS carrying_value FROM scored ORDER BY carrying_value DESC, sku LIMIT 5")
def most_carried(spark, d):
    return rounded(planning.most_carried(_scored(spark, d)), "carrying_value")


@query(
    f"WITH {COSTS}, {SCORECARD}, t AS (SELECT sku, CASE WHEN sku % 3 > 0 THEN status END AS status, on_order, days_to_reorder, risk, due FROM scored) SELECT sku, {rules.SKU_STATE} AS state FROM t"
)
def sku_state(spark, d):
    rows = _scored(spark, d).withColumn("status", F.when(F.col("sku") % 3 > 0, F.col("status")))
    return rows.select("sku", F.expr(rules.SKU_STATE).alias("state"))


LOG = """today AS (SELECT max(ds) + 1 AS t FROM daily),
sundays AS (SELECT DISTINCT ds - CAST(dayofweek(ds) AS INTEGER) AS origin FROM daily, today WHERE ds > t - 120),
log0 AS (SELECT CASE WHEN CAST(substring(s.sku, 7) AS INTEGER) % 4 = 0 THEN 's1' END AS store, s.sku, CAST(origin AS DATE) AS origin, sum(y) / 4 AS predicted, CASE WHEN CAST(substring(s.sku, 7) AS INTEGER) % 5 = 0 THEN CAST(origin + 2 AS DATE) ELSE CAST(origin AS DATE) END AS count_from
  FROM sundays JOIN filled s ON s.ds BETWEEN origin - 28 AND origin - 1 GROUP BY ALL),
log AS (SELECT *, CAST(origin + 6 AS DATE) AS due_at, 0.8 * predicted AS lo, 1.2 * predicted AS hi, concat_ws('|', coalesce(store, 'sheets'), sku, CAST(origin AS VARCHAR), '7') AS id FROM log0),
due AS (SELECT id, coalesce(sum(y), 0) AS actual FROM log CROSS JOIN today JOIN filled f ON f.sku = log.sku AND f.ds BETWEEN count_from AND due_at WHERE t > due_at GROUP BY id),
graded AS (SELECT log.*, actual, predicted - actual AS signed_err, abs(predicted - actual) AS abs_err, lo <= actual AND actual <= hi AS in_band, CASE WHEN hi > lo THEN (actual - predicted) / ((hi - lo) / 2) END AS band_z FROM log JOIN due USING (id))"""


def _log(spark, d):
    """Weekly forecasts of the last 120 days from four weeks' sales, some sealed late."""
    rows = filled(spark, d, "p_brand")
    end = F.broadcast(rows.agg(F.date_add(F.max("ds"), 1).alias("t")))
    sundays = F.broadcast(rows.select("ds").distinct().join(end).where(F.datediff("t", "ds") < 120).select(livelog.period_origin(F.col("ds")).alias("origin")).distinct())
    met = rows.join(sundays, F.col("ds").between(F.date_sub("origin", 28), F.date_sub("origin", 1))).groupBy("sku", "origin").agg((F.sum("y") / 4).alias("predicted"))
    b = F.substring("sku", 7, 9).cast("int")
    made = met.withColumns(
        {
            "store": F.when(b % 4 == 0, "s1"), "horizon_days": F.lit(7), "lo": 0.8 * F.col("predicted"), "hi": 1.2 * F.col("predicted"), "band": F.lit(80), "count_from": F.when(b % 5 == 0, F.date_add("origin", 2)),
            "created_at": F.col("origin"), "scored_at": F.lit(None).cast("date"), "actual": F.lit(None).cast("double"),
        }
    )
    return livelog.sealed(made), rows, end


def _graded(spark, d):
    log, rows, end = _log(spark, d)
    today = F.col("t")
    return livelog.score_due(log.join(end), rows, today)


@query(with_(LINES, DAILY, FILLED, LOG, key="p_brand") + f"SELECT id, {r('predicted')} AS predicted, actual, {r('abs_err')} AS abs_err, {r('signed_err')} AS signed_err, in_band, {r('band_z')} AS band_z FROM graded")
def live_scores(spark, d):
    rows = livelog.graded(_graded(spark, d)).select("id", "predicted", "actual", "abs_err", "signed_err", "in_band", "band_z")
    return rounded(rows, "predicted", "abs_err", "signed_err", "band_z")


@query(
    with_(LINES, DAILY, FILLED, LOG, key="p_brand")
    + f""", s AS (SELECT sku, count(*) AS n, sum(actual) AS units, sum(abs_err) AS a, sum(signed_err) AS g, count(*) FILTER (in_band) AS hits FROM graded GROUP BY sku),
c AS (SELECT *, n AS cal_n, 100.0 * hits / n AS hit_rate, 100.0 * hits / n - 80 AS gap, sqrt(80.0 * 20 / n) AS se FROM s)
SELECT sku, n, units, {r('100 * a / units')} AS wape, {r('100 * g / units')} AS bias, hits, {r('hit_rate')} AS hit_rate, {rules.CALIBRATION_VERDICT} AS verdict FROM c"""
)
def live_record(spark, d):
    rows = livelog.record(livelog.graded(_graded(spark, d)), "sku").select("sku", "n", "units", "wape", "bias", "hits", "hit_rate", "verdict")
    return rounded(rows, "wape", "bias", "hit_rate")


@query(
    with_(LINES, DAILY, FILLED, LOG, key="p_brand")
    + f"""SELECT log.origin, max(log.due_at) AS ends_on, count(*) AS products, count(actual) AS scored, {r('sum(log.predicted)')} AS predicted, sum(actual) AS actual, count(*) FILTER (in_band) AS in_band,
  CASE WHEN count(actual) = count(*) THEN 'scored' WHEN count(actual) > 0 THEN 'partial' WHEN count(*) FILTER (t > log.due_at) > 0 THEN 'due' ELSE 'open' END AS status FROM log CROSS JOIN today LEFT JOIN graded USING (id) GROUP BY log.origin"""
)
def live_weeks(spark, d):
    rows = livelog.week_tiles(_graded(spark, d).withColumn("amended", F.lit(False)), F.col("t"))
    return rounded(rows.select("origin", "ends_on", "products", "scored", "predicted", "actual", "in_band", "status"), "predicted")


@query(
    with_(LINES, DAILY, FILLED, LOG, key="p_brand")
    + f""", w AS (SELECT origin, count(*) AS n, round(100.0 * count(*) FILTER (in_band) / count(*)) AS in_rate, median(abs(band_z)) AS median_z, median(band_z) AS bias_z, 80.0::DOUBLE AS nominal FROM graded GROUP BY origin)
SELECT origin, n, in_rate, {r('median_z')} AS median_z, {r('bias_z')} AS bias_z, {rules.WEEK_VERDICT} AS verdict FROM w"""
)
def live_week_grades(spark, d):
    return rounded(livelog.week_grade(livelog.graded(_graded(spark, d)), "origin").select("origin", "n", "in_rate", "median_z", "bias_z", "verdict"), "median_z", "bias_z")


ERRORS = RESIDUALS + """, er AS (SELECT sku, date_diff('day', ds, (SELECT max(ds) FROM filled)) // 45 AS win, ds, err FROM resid WHERE date_diff('day', ds, (SELECT max(ds) FROM filled)) < 225)"""


def _errors(spark, d):
    rows = _residuals(filled(spark, d))
    end = F.broadcast(rows.agg(F.max("ds").alias("end")))
    return rows.join(end).withColumn("window", F.floor(F.datediff("end", "ds") / 45)).where("window < 5").select("sku", "window", "ds", "err")


@query(
    with_(LINES, DAILY, FILLED, ERRORS)
    + f""", b AS (SELECT sku, win, ds, sum(err) OVER w AS s, count(*) OVER w AS n, count(*) OVER (PARTITION BY sku, win) AS len FROM er WINDOW w AS (PARTITION BY sku, win ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
v AS (SELECT sku, var_samp(s) AS vk FROM b WHERE n = 30 AND len >= 35 GROUP BY sku), o AS (SELECT sku, var_samp(err) AS s2 FROM er GROUP BY sku)
SELECT sku, {r('coalesce(least(greatest((vk / (30 * s2) - 1) / 29, 0), 1), 0)', 3)} AS rho FROM o LEFT JOIN v USING (sku)"""
)
def day_correlation(spark, d):
    return rounded(bands.day_correlation(_errors(spark, d), 30), "rho", digits=3)


@query(
    with_(LINES, DAILY, FILLED, ERRORS)
    + f""", m AS (SELECT sku, win, avg(err) AS m, count(*) AS len FROM er GROUP BY 1, 2 HAVING count(*) >= 7),
v AS (SELECT sku, avg(m * m) AS v, avg(len) AS l FROM m GROUP BY sku), o AS (SELECT sku, var_samp(err) AS s2 FROM er GROUP BY sku) SELECT sku, {r('sqrt(greatest(v - s2 / l, 0))', 3)} AS level_sd FROM v JOIN o USING (sku)"""
)
def level_error(spark, d):
    return rounded(bands.level_error(_errors(spark, d)), "level_sd", digits=3)


@query(with_(LINES, DAILY, FILLED, SCORES) + "SELECT sku, cutoff, block FROM blocks")
def cutoff_schedule(spark, d):
    return backtest.cutoffs(filled(spark, d))


@query(with_(LINES, DAILY, FILLED, SCORES) + "SELECT sku, CAST(first AS DATE) AS first, CAST(last AS DATE) AS last, testable, CAST(windows AS INTEGER) AS windows FROM room")
def backtest_capacity(spark, d):
    return backtest.capacity(daily(spark, d))


@query(
    with_(LINES, DAILY, FILLED, SCORES)
    + f", t AS (SELECT *, date_diff('day', a, cutoff) + 1 AS train_days FROM scores JOIN span USING (sku)) SELECT {rules.TRAIN_BUCKET} AS bucket, count(*) AS windows, {r('100 * sum(abs_err) / sum(sum_y)')} AS wape FROM t GROUP BY 1"
)
def accuracy_by_history(spark, d):
    rows = filled(spark, d)
    return rounded(backtest.by_train_bucket(backtest.score(rows), rows.groupBy("sku").agg(F.min("ds").alias("start"))), "wape")


@query(with_(LINES, DAILY, FILLED, SCORES) + f"SELECT block, count(*) AS windows, {r('100 * sum(abs_err) / sum(sum_y)')} AS wape FROM scores JOIN blocks USING (sku, cutoff) GROUP BY block")
def accuracy_by_block(spark, d):
    rows = filled(spark, d)
    return rounded(backtest.by_block(backtest.score(rows), backtest.cutoffs(rows)), "wape")


TESTED = f"""tests AS (SELECT sku, cutoff, sum_y AS actual, sum_yhat AS forecast, 60.0 + 10 * mae AS basis, 20.0::DOUBLE AS price, 8.0::DOUBLE AS unit_cost, 0.5::DOUBLE AS fees FROM scores),
tiers AS (SELECT * FROM (VALUES {TIER_VALUES}) AS t(tier, service, z)),
t0 AS (SELECT *, round(z * basis + 1e-9) AS safety FROM tests, tiers),
t1 AS (SELECT *, greatest(0, actual - forecast - safety) AS short FROM t0),
costed AS (SELECT sku, cutoff, tier, safety, short, short * 365.0 / 30 * greatest(price - unit_cost - fees, 0) + safety * unit_cost * 0.25 AS cost FROM t1)"""


def _costed(spark, d):
    windows = backtest.score(filled(spark, d)).select("sku", "cutoff", F.col("sum_y").alias("actual"), F.col("sum_yhat").alias("forecast"), (60.0 + 10 * F.col("mae")).alias("basis"))
    costs = windows.select("sku").distinct().withColumns({"price": F.lit(20.0), "unit_cost": F.lit(8.0), "fees": F.lit(0.5)})
    return backtest.tier_costs(windows, costs)


@query(
    with_(LINES, DAILY, FILLED, SCORES, TESTED)
    + f""", p AS (SELECT tier, sku, count(*) AS n, count(*) FILTER (short <= 0) AS held, sum(short) AS short, avg(cost) AS cost FROM costed GROUP BY 1, 2)
SELECT tier, CAST(sum(n) AS BIGINT) AS windows, {r('100 * sum(held) / sum(n)')} AS service, {r('sum(short)', 2)} AS shortage, {r('sum(cost)', 2)} AS cost FROM p GROUP BY tier"""
)
def tier_summary(spark, d):
    return rounded(rounded(backtest.tier_summary(_costed(spark, d)), "service"), "shortage", "cost", digits=2)


@query(
    with_(LINES, DAILY, FILLED, SCORES, TESTED)
    + f""", o AS (SELECT c.*, (sum(cost) OVER w - cost) / (count(*) OVER w - 1) AS others FROM costed c WINDOW w AS (PARTITION BY sku, tier)),
p AS (SELECT sku, cost FROM (SELECT *, row_number() OVER (PARTITION BY sku, cutoff ORDER BY round(others, 6), tier) AS k FROM o) WHERE k = 1),
m AS (SELECT sum(c) AS mixed FROM (SELECT avg(cost) AS c FROM p GROUP BY sku)), u AS (SELECT tier, sum(c) AS c FROM (SELECT tier, sku, avg(cost) AS c FROM o GROUP BY 1, 2) GROUP BY tier ORDER BY round(sum(c), 6), tier LIMIT 1)
SELECT {r('mixed', 2)} AS mixed_cost, {r('c', 2)} AS uniform_cost, tier AS uniform_tier, mixed < c AS mixed_wins FROM m, u"""
)
def mixed_policy(spark, d):
    return rounded(backtest.mixed_policy(_costed(spark, d)), "mixed_cost", "uniform_cost", digits=2)


SHEET = """sheet AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') ELSE strftime(CAST(o_orderdate AS DATE), '%-d/%-m/%Y') END AS date, CAST(o_custkey AS VARCHAR) AS sku,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' WHEN o_orderkey % 49 = 0 THEN '-3' ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS units_sold, o_orderkey AS line FROM orders)"""


def _sheet(spark, d):
    orders = tables.table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    units = F.when(k % 50 == 0, "n/a").when(k % 49 == 0, "-3").otherwise((k % 9).cast("string"))
    date = F.when(k % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "d/M/yyyy"))
    return ingest.normalised_columns(orders.select(date.alias(" Date"), F.col("o_custkey").cast("string").alias("SKU"), units.alias("Units Sold"), k.alias("line")))


@query(
    f"WITH {SHEET}, p AS (SELECT regexp_extract(date, '^(\\d+)/', 1)::INT AS a, regexp_extract(date, '/(\\d+)/', 1)::INT AS b FROM sheet) SELECT CASE WHEN max(a) > 12 AND max(b) <= 12 THEN 'day_first' ELSE 'month_first' END AS dialect, max(a) <= 12 AND max(b) <= 12 AS ambiguous FROM p"
)
def sheet_dialect(spark, d):
    return ingest.date_dialect(_sheet(spark, d))


@query(
    f"""WITH {SHEET} SELECT sku, CAST(o_orderdate AS DATE) AS ds, sum(greatest(coalesce(TRY_CAST(units_sold AS DOUBLE), 0), 0)) AS y, arg_max(line, line) AS line FROM sheet JOIN orders ON o_orderkey = line GROUP BY 1, 2"""
)
def sheet_daily(spark, d):
    return ingest.collapsed(ingest.parsed_dates(_sheet(spark, d)), "line", "line")


@query(
    f"""WITH {SHEET} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unreadable_dates, count(*) FILTER (TRY_CAST(units_sold AS DOUBLE) IS NULL) AS unreadable_units, count(*) FILTER (TRY_CAST(units_sold AS DOUBLE) < 0) AS negative_units,
  count(*) FILTER (trim(sku) = '') AS blank_skus, count(DISTINCT sku) AS products FROM sheet"""
)
def sheet_quality(spark, d):
    return ingest.quality_report(ingest.parsed_dates(_sheet(spark, d)))


@query("SELECT 3 AS copies, count(*) AS rows FROM supplier")
def sheet_repeats(spark, d):
    """A table pasted three times in a row, and what is left of it."""
    size = F.broadcast(tables.table(spark, d, "supplier").agg((F.max("s_suppkey") + 1).alias("size")))
    sheet = tables.table(spark, d, "supplier").join(size).withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).withColumn("line", F.col("copy") * F.col("size") + F.col("s_suppkey")).drop("size", "copy")
    left = ingest.without_repeats(sheet, "line").agg(F.count("*").alias("rows"))
    return ingest.repeated_block(sheet, "line").join(F.broadcast(left))


@query(with_(LINES, DAILY, key="p_partkey") + "SELECT sku, count(*) AS rows, min(ds) AS first, max(ds) AS last, round(sum(y), 3) AS units FROM daily GROUP BY sku")
def fingerprint_parts(spark, d):
    return ingest.fingerprint_parts(daily(spark, d, "p_partkey"))


@query(
    with_(LINES, DAILY, key="p_partkey")
    + """, f AS (SELECT sku, count(*) AS n, min(ds) AS a, max(ds) AS b, round(sum(y), 3) AS u FROM daily GROUP BY sku),
h AS (SELECT sha256(concat_ws('|', sku, n, a, b, printf('%.3f', u))) AS h FROM f),
t AS (SELECT count(*) AS n, sum(CAST(concat('0x', substring(h, 1, 12)) AS HUGEINT)) AS a, sum(CAST(concat('0x', substring(h, 13, 12)) AS HUGEINT)) AS b FROM h)
SELECT n AS products, sha256(concat_ws('|', n, a, b)) AS digest FROM t"""
)
def fingerprint(spark, d):
    return ingest.fingerprint(ingest.fingerprint_parts(daily(spark, d, "p_partkey")))


@query("SELECT true AS grew")
def growth_only(spark, d):
    rows = daily(spark, d, "p_partkey")
    before = rows.where("ds < '2001-06-01'")
    return ingest.grew_only(ingest.fingerprint_parts(before), ingest.fingerprint_parts(rows))


@query(with_(LINES, DAILY, key="p_partkey") + "SELECT sku, min(ds) AS first, max(ds) AS last, CAST(date_diff('day', min(ds), max(ds)) + 1 AS INTEGER) AS days, count(*) FILTER (y > 0) AS selling_days, sum(y) AS units FROM daily GROUP BY sku")
def product_list(spark, d):
    return ingest.product_list(daily(spark, d, "p_partkey"))


@query(
    with_(LINES, DAILY, key="p_brand")
    + "SELECT sku, CAST(date_trunc('month', ds) AS DATE) AS month, sum(y) AS units, count(*) FILTER (y > 0) AS days, bool_and(last_day(ds) <= (SELECT max(ds) FROM daily)) AS complete FROM daily GROUP BY 1, 2"
)
def monthly_history(spark, d):
    return ingest.monthly_history(daily(spark, d, "p_brand"))


@query(with_(LINES, DAILY, key="p_brand") + "SELECT d.sku, ds, y FROM daily d JOIN (SELECT sku, max(ds) AS e FROM daily GROUP BY sku) USING (sku) WHERE date_diff('day', ds, e) < 30")
def recent_days(spark, d):
    return ingest.recent_days(daily(spark, d, "p_brand"))


@query(
    with_(LINES, DAILY, key="p_brand")
    + "SELECT sku, ds, CASE WHEN ds >= DATE '2001-01-01' THEN 2 * y ELSE y END AS y FROM daily"
)
def history_upsert(spark, d):
    rows = daily(spark, d, "p_brand").select("sku", "ds", "y")
    return ingest.upsert(rows, rows.where("ds >= '2001-01-01'").withColumn("y", 2 * F.col("y")))


@query(
    """WITH e AS (SELECT o_orderkey AS event_id, CASE o_orderkey % 4 WHEN 0 THEN 'promotion' WHEN 1 THEN 'price_change_permanent' WHEN 2 THEN 'price_change_temporary' ELSE 'sale' END AS kind, CASE WHEN o_orderkey % 31 > 0 THEN CAST(o_orderdate AS DATE) END AS start,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 1 AS INTEGER) AS end_, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 30 AS DOUBLE) - 2 END AS new_price, CAST(o_orderkey % 109 AS DOUBLE) AS pct FROM orders),
f AS (SELECT event_id, CASE WHEN kind = 'sale' THEN 'kind' WHEN start IS NULL THEN 'date' WHEN end_ < start THEN 'order' WHEN kind <> 'promotion' AND NOT coalesce(new_price >= 0, false) THEN 'price' WHEN pct < 0 OR pct > 100 THEN 'discount' END AS fault FROM e)
SELECT event_id, fault FROM f WHERE fault IS NOT NULL"""
)
def event_faults(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    kind = F.when(k % 4 == 0, "promotion").when(k % 4 == 1, "price_change_permanent").when(k % 4 == 2, "price_change_temporary").otherwise("sale")
    events = tables.table(spark, d, "orders").select(
        k.alias("event_id"), kind.alias("kind"), F.when(k % 31 > 0, day).alias("start"), F.date_add(day, (k % 5 - 1).cast("int")).alias("end"), F.when(k % 7 > 0, (k % 30 - 2).cast("double")).alias("new_price"), (k % 109).cast("double").alias("discount_pct")
    )
    return ingest.event_faults(events)


#: BOM however deep bundles are nested.
BOM_WHOLE = BOM.replace("depth < 4 AND ", "").replace("depth = 4 OR ", "")


@query(
    "WITH RECURSIVE " + BOM_WHOLE
    + """, dl AS (SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
x AS (SELECT flat.sku, ds, sum(y * qty) AS extra FROM dl JOIN flat ON flat.bundle = dl.sku WHERE flat.bundle <> flat.sku AND y > 0 GROUP BY 1, 2 HAVING sum(y * qty) > 0)
SELECT coalesce(dl.sku, x.sku) AS sku, coalesce(dl.ds, x.ds) AS ds, coalesce(y, 0) + coalesce(extra, 0) AS y, coalesce(extra, 0) AS bundle_units, y IS NULL AS from_bundle_only FROM dl FULL JOIN x ON x.sku = dl.sku AND x.ds = dl.ds"""
)
def bundle_attribution(spark, d):
    lines = tables.table(spark, d, "lineitem")
    tasks = 1 + lines.count() // bundles.TASK_ROWS
    dealt = lines.select(F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("ds"), "l_quantity").repartition(tasks, "sku", "ds")
    rows = dealt.groupBy("sku", "ds").agg(F.sum("l_quantity").alias("y"))
    return bundles.attribute(rows, bundles.expand_whole(staged(_bundle_parts(spark, d))), tasks)


@query(
    """WITH p AS (SELECT DISTINCT bundle, component FROM (SELECT p_partkey AS bundle, p_partkey // 2 AS component FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_partkey // 5 + 1 FROM part WHERE p_partkey % 3 = 0) WHERE bundle <> component),
k AS (SELECT p_partkey AS sku FROM part WHERE p_partkey % 10 > 0),
f AS (SELECT bundle, component, CASE WHEN bundle NOT IN (SELECT sku FROM k) THEN 'unknown bundle' WHEN component NOT IN (SELECT sku FROM k) THEN 'unknown component' WHEN component IN (SELECT bundle FROM p) THEN 'nested' END AS fault FROM p)
SELECT bundle, component, fault FROM f WHERE fault IS NOT NULL"""
)
def bundle_faults(spark, d):
    known = tables.table(spark, d, "part").where("p_partkey % 10 > 0").select(F.col("p_partkey").alias("sku"))
    return bundles.faults(_bundle_parts(spark, d), known)


@query(
    """WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders WHERE o_orderkey % 101 = 0), y AS (SELECT * FROM (VALUES (12, 25), (1, 1), (2, 29)) AS v(month, day))
SELECT DISTINCT ds FROM (SELECT ds FROM s UNION ALL SELECT TRY_CAST(printf('%04d-%02d-%02d', yr, month, day) AS DATE) FROM y, (SELECT unnest(range(1996, 2001)) AS yr)) WHERE ds BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""
)
def closed_days(spark, d):
    dates = tables.table(spark, d, "orders").where("o_orderkey % 101 = 0").select(F.to_date("o_orderdate").alias("ds"))
    yearly = spark.createDataFrame([(12, 25), (1, 1), (2, 29)], "month int, day int")
    return calendar.closed_days(dates, yearly, "1996-01-01", "2000-12-31")


@query(with_(LINES, DAILY, key="p_brand") + "SELECT sku, ds, y FROM daily WHERE ds NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 101 = 0)")
def open_days(spark, d):
    closed = tables.table(spark, d, "orders").where("o_orderkey % 101 = 0").select(F.to_date("o_orderdate").alias("ds"))
    return calendar.without_closed_days(daily(spark, d, "p_brand").select("sku", "ds", "y"), closed)


@query(
    with_(READINGS)
    + "SELECT sku, ts, CAST(timezone('America/New_York', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS store_day, date_diff('second', timezone('UTC', timezone('America/New_York', CAST(CAST(timezone('America/New_York', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS TIMESTAMP))), CAST(ts AS TIMESTAMP)) AS since_open FROM readings"
)
def store_days(spark, d):
    zone = "America/New_York"
    day = telemetry.local_day(F.col("ts"), zone)
    start = telemetry.day_start(day, zone)
    return tables.stock_readings(spark, d).select("sku", "ts", day.alias("store_day"), (F.unix_timestamp("ts") - F.unix_timestamp(start)).alias("since_open"))


SUPPLIED = """po AS (SELECT l_suppkey AS supplier, l_orderkey * 10 + l_linenumber AS order_id, l_partkey AS sku, l_quantity AS qty, CAST(o_orderdate AS DATE) AS ordered, CAST(o_orderdate AS DATE) + 30 AS expected, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_shipdate AS DATE) END AS received
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _supplied(spark, d):
    lines = tables.table(spark, d, "lineitem").join(tables.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.to_date("o_orderdate")
    return lines.select(
        F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("qty"), day.alias("ordered"), F.date_add(day, 30).alias("expected"),
        F.when(F.col("l_linenumber") % 4 > 0, F.to_date("l_shipdate")).alias("received"),
    )


@query(
    f"""WITH {SUPPLIED} SELECT supplier, count(received) AS completed, count(*) - count(received) AS in_transit, round(avg(date_diff('day', ordered, received)) FILTER (received >= ordered) + 1e-9) AS avg_days,
  round(quantile_cont(date_diff('day', ordered, received), 0.8) FILTER (received >= ordered) + 1e-9) AS p80_days, round(100.0 * count(*) FILTER (received <= expected) / nullif(count(received), 0) + 1e-9) AS on_time_pct, round(avg(date_diff('day', expected, received)) + 1e-9, 1) AS avg_variance FROM po GROUP BY supplier"""
)
def supplier_kpis(spark, d):
    return planning.supplier_kpis(_supplied(spark, d))


@query(f"WITH {SUPPLIED} SELECT DISTINCT order_id, sku, CAST(greatest(date_diff('day', DATE '1998-01-01', expected), 0) AS INTEGER) AS eta_days FROM po WHERE received IS NULL")
def eta_days(spark, d):
    return planning.eta_days(_supplied(spark, d).where("received IS NULL"), F.lit("1998-01-01").cast("date")).distinct()


@query(
    f"""WITH {SUPPLIED}, pairs AS (SELECT DISTINCT supplier % 9 AS lead, sku % 5 AS coverage, sku FROM po) SELECT lead, coverage, count(*) AS products FROM pairs GROUP BY 1, 2 ORDER BY products DESC, lead, coverage LIMIT 12"""
)
def settings_in_use(spark, d):
    rows = _supplied(spark, d).select((F.col("supplier") % 9).alias("lead"), (F.col("sku") % 5).alias("coverage"), "sku").distinct()
    return planning.settings_in_use(rows)


@query(
    with_(READINGS, HOURS)
    + f"""SELECT sku, CAST(ds AS DATE) AS ds, h.hours FROM (SELECT sku, ds FROM (SELECT DISTINCT sku FROM hours), (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS ds)) g
LEFT JOIN (SELECT sku, CAST(ds AS DATE) AS ds, {r('24.0 * stocked / covered', 3)} AS hours FROM hours) h USING (sku, ds)"""
)
def availability_series(spark, d):
    hours = rounded(telemetry.hours_in_stock(tables.stock_readings(spark, d)), "hours", digits=3)
    return telemetry.availability_series(hours, "2024-01-05", "2024-01-20")


#: Order lines by part, their days brought into the year of the readings; every fourth has no expected day, and those with line status F have come.
PLACED = """placed AS (SELECT l_partkey AS sku, l_orderkey * 10 + l_linenumber AS order_id, l_quantity AS qty, make_date(2024, month(o_orderdate), least(day(o_orderdate), 28)) AS ordered,
  CASE WHEN l_linenumber % 4 > 0 THEN make_date(2024, month(o_orderdate), least(day(o_orderdate), 28)) + 14 END AS expected FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O')"""
RISES = f"""rises AS (SELECT sku, ts, {LOCAL_DAY.format(ts='ts')} AS day, before, on_hand AS after, on_hand - before AS gain FROM (SELECT *, lag(on_hand) OVER (PARTITION BY sku ORDER BY ts) AS before FROM readings) WHERE on_hand - before >= 3),
m AS (SELECT r.*, order_id, qty, ordered, expected, coalesce(date_diff('day', coalesce(expected, ordered), day), 0) AS late, least(gain, qty) / greatest(gain, qty) AS ratio FROM rises r JOIN placed p ON p.sku = r.sku AND day >= ordered),
best AS (SELECT *, 0.75 * ratio + 0.25 * (1 - least(abs(late) / 60.0, 1.0)) AS score FROM m WHERE late BETWEEN -21 AND 60 AND ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY sku, ts ORDER BY score DESC, order_id) = 1)"""


def _placed(spark, d):
    lines = tables.table(spark, d, "lineitem").where("l_linestatus = 'O'").join(tables.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.expr("make_date(2024, month(o_orderdate), least(day(o_orderdate), 28))")
    rows = lines.select(F.col("l_partkey").alias("sku"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"), F.col("l_quantity").alias("qty"), day.alias("ordered"), "l_linenumber")
    return rows.withColumn("expected", F.when(F.col("l_linenumber") % 4 > 0, F.date_add("ordered", 14))).drop("l_linenumber")


@query(with_(READINGS, PLACED, RISES) + f"SELECT sku, ts, gain, order_id, qty, {r('score')} AS score FROM best")
def order_matches(spark, d):
    """Rises of stock and the open orders that they fit best."""
    gains = telemetry.rises(tables.stock_readings(spark, d), zone=STORE_ZONE)
    return rounded(telemetry.order_matches(gains, _placed(spark, d)).select("sku", "ts", "gain", "order_id", "qty", "score"), "score")


@query(
    with_(READINGS, PLACED, RISES)
    + f""", rates AS (SELECT user_id AS sku, count(*) / 30.0 AS rate FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT sku, order_id, day AS arrived_on, ts, before AS stock_before, after AS stock_after, gain, qty, {r('score', 3)} AS confidence, CASE WHEN gain = qty THEN 'exact' WHEN gain < qty THEN 'partial' ELSE 'over' END AS match,
  CAST(date_diff('day', ordered, day) AS INTEGER) AS lead_days, CAST(date_diff('day', expected, day) AS INTEGER) AS days_late
FROM best LEFT JOIN rates USING (sku) WHERE gain >= greatest(3, 0.15 * qty) AND (gain = qty OR coalesce(rate <= 0, true) OR gain >= 2 * rate)"""
)
def arrivals(spark, d):
    """Rises of stock that look like deliveries, with their confidence and the days the order took."""
    rates = tables.table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("sku")).agg((F.count("*") / 30.0).alias("rate"))
    return telemetry.arrivals(tables.stock_readings(spark, d), _placed(spark, d), rates, zone=STORE_ZONE)


@query(
    f"""WITH h AS (SELECT CAST(ts AS DATE) AS ds, hour(ts) AS hour, CAST(count(*) AS DOUBLE) AS units FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), t AS (SELECT ds, sum(units) AS total FROM h GROUP BY ds),
p AS (SELECT hour, sum(units / total) / (SELECT count(*) FROM t) AS part FROM h JOIN t USING (ds) GROUP BY hour), g AS (SELECT unnest(range(0, 24)) AS hour)
SELECT CAST(g.hour AS INTEGER) AS hour, {r('coalesce(sum(part), 0)')} AS share FROM g LEFT JOIN p ON p.hour >= g.hour GROUP BY g.hour"""
)
def share_after_hour(spark, d):
    bought = tables.table(spark, d, "events").where("event_type = 'purchase'")
    hourly = bought.groupBy(F.to_date("ts").alias("ds"), F.hour("ts").alias("hour")).agg(F.count("*").cast("double").alias("units"))
    return rounded(telemetry.share_after(hourly), "share")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The planning queries over the star-schema tables and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import backtest, bundles, calendar, demand, forecast, planning, pricing, seasonality, telemetry
from millrace.sources import tables
from millrace.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]

LINES = """lines AS (
  SELECT CAST({key} AS VARCHAR) AS sku, p_brand AS category, CAST(l_shipdate AS DATE) AS ds, l_quantity AS units,
    p_retailprice * (1 - l_discount) AS price, CAST(l_discount >= 0.08 AS INTEGER) AS on_promotion
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
DAILY = "daily AS (SELECT sku, ds, sum(units) AS y, sum(units * on_promotion) AS promo_units, count(*) AS n_lines FROM lines GROUP BY sku, ds)"
FILLED = """filled AS (
  SELECT s.sku, s.ds, coalesce(d.y, 0) AS y, coalesce(d.promo_units, 0) AS promo_units FROM (
    SELECT sku, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST((SELECT max(ds) FROM daily) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily GROUP BY sku
  ) s LEFT JOIN daily d ON d.sku = s.sku AND d.ds = s.ds)"""
AGED = "aged AS (SELECT *, date_diff('day', ds, max(ds) OVER (PARTITION BY sku)) AS age FROM filled)"


def with_(*parts: str, key: str = "p_type") -> str:
    return "WITH " + ",\n".join(p.replace("{key}", key) for p in parts) + "\n"


def filled(spark: SparkSession, d: str, key: str = "p_type") -> DataFrame:
    return calendar.fill_calendar(calendar.daily_sales(tables.sales_lines(spark, d, key)))


def kept(spark: SparkSession, d: str, key: str = "p_type") -> DataFrame:
    """filled() written once, for plans that read the days several times."""
    return staged(filled(spark, d, key).select("sku", "ds", "y", "promo_units"))


def daily(spark: SparkSession, d: str, key: str = "p_type") -> DataFrame:
    return calendar.daily_sales(tables.sales_lines(spark, d, key))


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    """Rounds for comparison; halves go up, whatever their binary form."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, digits) for n in names})


def daily_sales(spark, d):
    return calendar.daily_sales(tables.sales_lines(spark, d, "p_brand"))


DAILY_SALES = with_(LINES, DAILY, key="p_brand") + "SELECT sku, ds, y, promo_units, n_lines FROM daily"


def daily_price_rollup(spark, d):
    return rounded(calendar.daily_price_rollup(tables.sales_lines(spark, d)), "price")


PRICED = """cents AS (SELECT sku, ds, round(price + 1e-7, 2) AS p, sum(units) AS u, sum(units * on_promotion) AS pu, max(on_promotion) AS any_promo FROM lines GROUP BY 1, 2, 3),
tops AS (SELECT sku, ds, p AS top FROM (SELECT *, row_number() OVER (PARTITION BY sku, ds ORDER BY u DESC, p) AS r FROM cents) WHERE r = 1),
days AS (SELECT sku, ds, sum(u) AS y, sum(u) FILTER (same) AS su, sum(u * p) FILTER (same) AS sr, sum(pu) FILTER (same) AS sp, sum(u * p) AS r, max(any_promo) AS any_promo
  FROM (SELECT *, abs(p - top) <= greatest(0.02, 0.005 * greatest(p, top)) AS same FROM cents JOIN tops USING (sku, ds)) GROUP BY sku, ds),
priced AS (SELECT sku, ds, y, CASE WHEN su >= 0.8 * y THEN sr / su ELSE r / y END AS price, CASE WHEN su >= 0.8 * y THEN 0 ELSE 1 END AS price_mixed,
  CASE WHEN su >= 0.8 * y THEN CAST(2 * sp > su AS INTEGER) ELSE any_promo END AS on_promotion FROM days)"""
DAILY_PRICE_ROLLUP = with_(LINES, PRICED) + "SELECT sku, ds, y, round(price + 1e-9, 4) AS price, price_mixed, on_promotion FROM priced"


def calendar_fill(spark, d):
    priced = calendar.daily_price_rollup(tables.sales_lines(spark, d))
    return rounded(calendar.fill_calendar(priced).select("sku", "ds", "y", "price", "price_mixed"), "price")


CALENDAR_FILL = (
    with_(LINES, PRICED, "daily AS (SELECT * FROM priced)")
    + """, spans AS (SELECT sku, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST((SELECT max(ds) FROM daily) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily GROUP BY sku),
j AS (SELECT s.sku, s.ds, coalesce(y, 0) AS y, price, coalesce(price_mixed, 0) AS price_mixed, CASE WHEN coalesce(price_mixed, 0) = 0 THEN price END AS pure FROM spans s LEFT JOIN daily d ON d.sku = s.sku AND d.ds = s.ds)
SELECT sku, ds, y, round((coalesce(price, last_value(pure IGNORE NULLS) OVER (PARTITION BY sku ORDER BY ds ROWS UNBOUNDED PRECEDING),
  first_value(pure IGNORE NULLS) OVER (PARTITION BY sku ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) + 1e-9, 4) AS price, price_mixed FROM j"""
)

CLASSES = """stats AS (SELECT sku, count(*) AS days, count(*) FILTER (y > 0) AS selling_days, sum(y) AS units, avg(y) FILTER (y > 0) AS mean, stddev_pop(y) FILTER (y > 0) AS sd FROM filled GROUP BY sku),
classes AS (SELECT sku, days, selling_days, units, CAST(days AS DOUBLE) / nullif(selling_days, 0) AS adi, power(sd / mean, 2) AS cv2,
  CASE WHEN selling_days = 0 THEN 'no_demand' WHEN CAST(days AS DOUBLE) / selling_days < 1.32 THEN CASE WHEN power(sd / mean, 2) < 0.49 THEN 'smooth' ELSE 'erratic' END
  WHEN power(sd / mean, 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_class FROM stats)"""


def demand_class(spark, d):
    return rounded(demand.classify(daily(spark, d, "p_partkey")), "adi", "cv2")


DEMAND_CLASS = with_(LINES, DAILY, FILLED, CLASSES, key="p_partkey") + "SELECT sku, days, selling_days, units, round(adi + 1e-9, 4) AS adi, round(cv2 + 1e-9, 4) AS cv2, demand_class FROM classes"


def dormancy(spark, d):
    return rounded(demand.dormancy(daily(spark, d, "p_partkey")), "active_adi")


DORMANCY = (
    with_(LINES, DAILY, FILLED, key="p_partkey")
    + """, s AS (SELECT sku, date_diff('day', max(ds) FILTER (y > 0), max(ds)) AS trailing_zeros,
  CAST(date_diff('day', min(ds) FILTER (y > 0), max(ds) FILTER (y > 0)) + 1 AS DOUBLE) / count(*) FILTER (y > 0) AS active_adi FROM filled GROUP BY sku)
SELECT sku, trailing_zeros, round(active_adi + 1e-9, 4) AS active_adi, trailing_zeros >= greatest(45.0, 4 * active_adi) AS dormant FROM s"""
)


def dispersion_index(spark, d):
    return rounded(demand.dispersion(filled(spark, d, "p_brand")), "dispersion")


DISPERSION_INDEX = (
    with_(LINES, DAILY, FILLED, key="p_brand")
    + """, s AS (SELECT sku, CASE WHEN avg(y) > 0 AND sum(y) >= 20 THEN stddev_pop(y) / sqrt(avg(y)) END AS x FROM filled GROUP BY sku)
SELECT sku, round(x + 1e-9, 4) AS dispersion, CASE WHEN x < 1.25 THEN 'steady' WHEN x < 2.0 THEN 'variable' WHEN x IS NOT NULL THEN 'volatile' END AS volatility FROM s"""
)


def forecast_route(spark, d):
    classes = demand.classify(daily(spark, d, "p_partkey"))
    family = tables.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sku"), "p_brand")
    usable = classes.where("days >= 180").join(family, "sku").groupBy("p_brand").agg((F.count("*") - 1).alias("relatives"))
    relatives = family.join(usable, "p_brand").select("sku", "relatives", F.lit(None).cast("double").alias("cohesion"))
    return demand.route(classes, relatives)


FORECAST_ROUTE = (
    with_(LINES, DAILY, FILLED, CLASSES, key="p_partkey")
    + """, family AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_brand FROM part),
usable AS (SELECT p_brand, count(*) - 1 AS relatives FROM classes JOIN family USING (sku) WHERE days >= 180 GROUP BY p_brand),
j AS (SELECT c.*, coalesce(relatives, 0) AS rel, days >= 180 AND selling_days >= 45 AND units >= 60 AS est, demand_class IN ('intermittent', 'lumpy') AS gaps FROM classes c LEFT JOIN family USING (sku) LEFT JOIN usable USING (p_brand))
SELECT sku, CASE WHEN est AND NOT gaps AND demand_class <> 'no_demand' THEN 'regular' WHEN gaps AND days >= 60 THEN 'sparse'
  WHEN rel >= 2 AND (days < 60 OR gaps OR demand_class = 'no_demand' OR NOT est) THEN 'pooled' WHEN gaps THEN 'sparse' WHEN days < 90 OR units < 30 THEN 'abstain' ELSE 'regular' END AS route FROM j"""
)


def volume_peers(spark, d):
    return rounded(demand.nearest_peers(tables.sales_lines(spark, d, "p_partkey")), "distance", digits=6)


VOLUME_PEERS = (
    with_(LINES, key="p_partkey")
    + """, v AS (SELECT category, sku, ln(sum(units)) AS v FROM lines GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY v, sku) AS place FROM v),
p AS (SELECT a.sku, a.category, b.sku AS peer, round(abs(a.v - b.v), 9) AS distance, abs(a.place - b.place) AS "between" FROM n a JOIN n b ON a.category = b.category AND a.sku <> b.sku)
SELECT sku, category, peer, round(distance + 1e-9, 6) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category, sku ORDER BY distance, "between", peer) AS r FROM p) WHERE r <= 25"""
)


def monthly_index(spark, d):
    return rounded(seasonality.monthly_index(kept(spark, d)), "index")


TREND = """tspan AS (SELECT sku, min(ds) AS start, avg(y) AS mean, count(*) AS n FROM filled GROUP BY sku),
tmon AS (SELECT f.sku, month(m0) AS month, CAST(w AS DOUBLE) AS w, date_diff('day', start, m0 + 14) / 365.25 AS x, ln(greatest(m, 0) + 0.1 * mean + 1e-6) AS z
  FROM (SELECT sku, CAST(date_trunc('month', ds) AS DATE) AS m0, count(*) AS w, avg(y) AS m FROM filled GROUP BY 1, 2 HAVING count(*) >= 10) f JOIN tspan USING (sku)),
treg AS (SELECT sku, month, count(*) AS k, sum(w) AS sw, sum(w * x) AS sx, sum(w * z) AS sz, sum(w * x * x) AS sxx, sum(w * x * z) AS sxz FROM tmon GROUP BY 1, 2),
tsum AS (SELECT sku, sum(k) AS months, count(*) FILTER (k >= 2) AS rep, sum(sxz - sx * sz / sw) / sum(sxx - sx * sx / sw) AS seasonal,
  (sum(sxz) - sum(sx) * sum(sz) / sum(sw)) / (sum(sxx) - sum(sx) * sum(sx) / sum(sw)) AS line FROM treg GROUP BY sku),
tslope AS (SELECT sku, start, least(greatest(CASE WHEN n < 60 OR coalesce(months, 0) < 4 THEN 0 WHEN rep >= 2 THEN seasonal ELSE {short} END, -ln(4.0)), ln(4.0)) AS b,
  CASE WHEN n < 60 OR coalesce(months, 0) < 4 THEN 'none' WHEN rep >= 2 THEN 'seasonal-fit' ELSE {short_name} END AS basis FROM tspan LEFT JOIN tsum USING (sku)),
level AS (SELECT sku, ds, y * avg(f) OVER (PARTITION BY sku) / f AS y FROM (SELECT sku, ds, y, exp(b * date_diff('day', start, ds) / 365.25) AS f FROM filled JOIN tslope USING (sku)))"""
TREND_LINEAR = TREND.replace("{short_name}", "'linear'").replace("{short}", "line")
TREND_NONE = TREND.replace("{short_name}", "'none'").replace("{short}", "0")
INDEX = TREND_NONE + """, span AS (SELECT sku, count(*) AS n FROM filled GROUP BY sku),
months AS (SELECT sku, month(ds) AS month, avg(y) AS m, sum(y) AS total, count(*) AS d FROM level GROUP BY 1, 2 HAVING count(*) >= 8),
ok AS (SELECT sku, sum(total) / sum(d) AS mean FROM months GROUP BY sku HAVING count(*) >= 8),
r0 AS (SELECT s.sku, g.month, 1 + (coalesce(m / mean, 1) - 1) * {shrunk} AS x
  FROM span s JOIN ok USING (sku) CROSS JOIN (SELECT unnest(range(1, 13)) AS month) g LEFT JOIN months m ON m.sku = s.sku AND m.month = g.month WHERE n >= 330 AND mean > 0),
r1 AS (SELECT sku, month, least(greatest(x / avg(x) OVER (PARTITION BY sku), 0.25), 4.0) AS x FROM r0),
r2 AS (SELECT sku, month, least(greatest(x / avg(x) OVER (PARTITION BY sku), 0.25), 4.0) AS x FROM r1),
r4 AS (SELECT sku, month, least(greatest(x / avg(x) OVER (PARTITION BY sku), 0.25), 4.0) AS x FROM r2),
r3 AS (SELECT sku, month, least(greatest(x / avg(x) OVER (PARTITION BY sku), 0.25), 4.0) AS x FROM r4)"""
UNSHRUNK_INDEX = INDEX.replace("{shrunk}", "1.0")
INDEX = INDEX.replace("{shrunk}", "(n / 365.0) / (n / 365.0 + 1)")
MONTHLY_INDEX = with_(LINES, DAILY, FILLED, INDEX) + 'SELECT sku, CAST(month AS INTEGER) AS month, round(x + 1e-9, 4) AS "index" FROM r3'


def index_strength(spark, d):
    return rounded(seasonality.index_strength(seasonality.monthly_index(kept(spark, d, "p_brand"))), "strength")


INDEX_STRENGTH = with_(LINES, DAILY, FILLED, INDEX, key="p_brand") + "SELECT sku, round(((max(x) - min(x)) / 2) + 1e-9, 4) AS strength, (max(x) - min(x)) / 2 >= 0.15 AS used FROM r3 GROUP BY sku"

SIGNATURES = TREND_LINEAR + """, ratios AS (SELECT sku, ds, y / coalesce(nullif(avg(y) OVER (PARTITION BY sku), 0), 1) AS ratio FROM level WHERE sku IN (SELECT sku FROM filled GROUP BY sku HAVING count(*) >= 120)),
sig AS (SELECT sku, slot, avg(ratio) AS value FROM (SELECT sku, ratio, unnest([dayofweek(ds) + 1, month(ds) + 7]) AS slot FROM ratios) GROUP BY 1, 2)"""


def seasonal_signature(spark, d):
    return rounded(seasonality.signature(kept(spark, d, "p_brand")), "value")


SEASONAL_SIGNATURE = with_(LINES, DAILY, FILLED, SIGNATURES, key="p_brand") + "SELECT sku, CAST(slot AS INTEGER) AS slot, round(value + 1e-9, 4) AS value FROM sig"


def shape_links(spark, d):
    rows = kept(spark, d, "p_brand")
    keys = rows.select("sku", F.substring("sku", 1, 7).alias("category")).distinct()
    return rounded(seasonality.shape_links(seasonality.signature(rows), keys), "likeness", digits=3)


SHAPE_LINKS = (
    with_(LINES, DAILY, FILLED, SIGNATURES, key="p_brand")
    + """, base AS (SELECT slot, avg(value) AS base FROM sig GROUP BY slot),
own AS (SELECT substring(sku, 1, 7) AS category, sku, slot, value - base AS v FROM sig JOIN base USING (slot)),
p AS (SELECT a.category, a.sku AS a, b.sku AS b, corr(a.v, b.v) AS r, count(*) FILTER (a.slot > 7) AS months, count(*) AS slots, stddev_pop(a.v) < 1e-9 AS fa, stddev_pop(b.v) < 1e-9 AS fb FROM own a JOIN own b ON a.category = b.category AND a.slot = b.slot AND a.sku < b.sku GROUP BY ALL),
links AS (SELECT category, a, b, CASE WHEN months < 5 OR slots < 3 THEN 0 WHEN fa AND fb THEN 1 WHEN fa OR fb THEN 0 ELSE coalesce(r, 0) END AS likeness FROM p)
SELECT category, a, b, round(likeness + 1e-9, 3) AS likeness, likeness >= 0.35 AS linked FROM links"""
)


def year_on_year(spark, d):
    return rounded(seasonality.year_on_year(kept(spark, d, "p_brand")), "growth")


YEAR_ON_YEAR = (
    with_(LINES, DAILY, FILLED, AGED, key="p_brand")
    + """, s AS (SELECT sku, count(*) FILTER (age < 182) AS cn, count(*) FILTER (age >= 364 AND age < 546) AS ct, coalesce(sum(y) FILTER (age < 182), 0) AS n, coalesce(sum(y) FILTER (age >= 364 AND age < 546), 0) AS t FROM aged GROUP BY sku)
SELECT sku, round(CASE WHEN t <= 0 THEN 1 ELSE least(greatest(exp(ln(greatest((n / cn) / (t / ct), 1e-6)) * least(n, t) / (least(n, t) + 30)), 1 / 3.0), 3.0) END + 1e-9, 4) AS growth FROM s WHERE cn >= 20 AND ct >= 20"""
)


def rush_weeks(spark, d):
    return seasonality.rush_weeks(filled(spark, d, "p_brand"))


RUSH_WEEKS = (
    with_(LINES, DAILY, FILLED, AGED, key="p_brand")
    + """, weeks AS (SELECT sku, CAST(-(age // 7) AS INTEGER) AS w, sum(y) AS units, avg(y) AS rate FROM aged GROUP BY 1, 2 HAVING count(*) >= 4),
u AS (SELECT a.sku, a.w, median(b.rate) AS usual FROM weeks a JOIN weeks b ON a.sku = b.sku AND abs(a.w - b.w) BETWEEN 2 AND 13 GROUP BY 1, 2 HAVING count(*) >= 4),
hot AS (SELECT weeks.*, weeks.w - row_number() OVER (PARTITION BY sku ORDER BY weeks.w) AS run FROM weeks JOIN u USING (sku, w) WHERE usual > 0 AND rate >= 1.5 * usual)
SELECT sku, min(w) AS first_week, max(w) AS last_week, count(*) AS weeks, sum(units) AS units FROM hot GROUP BY sku, run HAVING count(*) >= 2"""
)

PROFILE = """recent AS (SELECT * FROM aged WHERE age < 56),
tot AS (SELECT sku, avg(y) AS mean, sum(y) AS n FROM recent GROUP BY sku HAVING avg(y) > 0),
wd AS (SELECT sku, dayofweek(ds) + 1 AS weekday, avg(y) AS m FROM recent GROUP BY 1, 2),
profile AS (SELECT sku, weekday, p / avg(p) OVER (PARTITION BY sku) AS profile FROM (SELECT sku, weekday, 1 + (m / mean - 1) * n / (n + 20) AS p FROM wd JOIN tot USING (sku)))"""
LEVELS = """z AS (SELECT a.sku, age, y / profile AS z, row_number() OVER (PARTITION BY a.sku ORDER BY ds) AS i FROM aged a JOIN profile p ON p.sku = a.sku AND p.weekday = dayofweek(ds) + 1),
levels AS (SELECT sku, sum((1 - pow(0.5, 0.1)) * pow(pow(0.5, 0.1), age) * z) + pow(pow(0.5, 0.1), count(*)) * avg(z) FILTER (i <= 28) AS level FROM z GROUP BY sku)"""


def weekday_profile(spark, d):
    return rounded(forecast.weekday_profile(filled(spark, d)), "profile")


WEEKDAY_PROFILE = with_(LINES, DAILY, FILLED, AGED, PROFILE) + "SELECT sku, CAST(weekday AS INTEGER) AS weekday, round(profile + 1e-9, 4) AS profile FROM profile"


def recent_level(spark, d):
    return rounded(forecast.recent_level(kept(spark, d)), "level")


RECENT_LEVEL = with_(LINES, DAILY, FILLED, AGED, PROFILE, LEVELS) + "SELECT sku, round(level + 1e-9, 4) AS level FROM levels"


def moving_average(spark, d):
    return rounded(forecast.moving_average(filled(spark, d, "p_brand")), "level")


MOVING_AVERAGE = with_(LINES, DAILY, FILLED, AGED, key="p_brand") + "SELECT sku, round(avg(y) + 1e-9, 4) AS level FROM aged WHERE age < 28 GROUP BY sku"


def sparse_demand(spark, d):
    return rounded(forecast.sparse_demand(daily(spark, d, "p_partkey")), "size", "interval", "classic", "corrected")


SPARSE_DEMAND = (
    with_(LINES, DAILY, FILLED, key="p_partkey")
    + """, sales AS (SELECT sku, y, date_diff('day', coalesce(lag(ds) OVER w, start - 1), ds) AS gap, row_number() OVER w AS i, count(*) OVER (PARTITION BY sku) AS n
  FROM (SELECT *, min(ds) OVER (PARTITION BY sku) AS start FROM filled) WHERE y > 0 WINDOW w AS (PARTITION BY sku ORDER BY ds)),
r AS (SELECT sku, sum(CASE WHEN i = 1 THEN 1.0 ELSE 0.1 END * pow(0.9, n - i) * y) AS size, sum(CASE WHEN i = 1 THEN 1.0 ELSE 0.1 END * pow(0.9, n - i) * gap) AS gap FROM sales GROUP BY sku)
SELECT sku, round(size + 1e-9, 4) AS size, round(gap + 1e-9, 4) AS interval, round((size / gap) + 1e-9, 4) AS classic, round((0.95 * size / gap) + 1e-9, 4) AS corrected FROM r"""
)


def _residuals(rows: DataFrame) -> DataFrame:
    mean = F.avg("y").over(Window.partitionBy("sku").orderBy("ds").rowsBetween(-28, -1))
    return rows.withColumn("err", F.col("y") - mean).where("err is not null").select("sku", "ds", "err")


RESIDUALS = "resid AS (SELECT * FROM (SELECT sku, ds, y - avg(y) OVER (PARTITION BY sku ORDER BY ds ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS err FROM filled) WHERE err IS NOT NULL)"
SIGMA = """sums AS (SELECT sku, sum(err) OVER w AS s, count(err) OVER w AS n FROM resid WINDOW w AS (PARTITION BY sku ORDER BY ds ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
sigma AS (SELECT sku, stddev_samp(s) AS sigma FROM sums WHERE n = 14 GROUP BY sku HAVING count(*) >= 6)"""


def lead_window_sigma(spark, d):
    return rounded(forecast.lead_window_sigma(_residuals(filled(spark, d)), 14), "sigma", digits=3)


LEAD_WINDOW_SIGMA = with_(LINES, DAILY, FILLED, RESIDUALS, SIGMA) + "SELECT sku, round(sigma + 1e-9, 3) AS sigma FROM sigma"


def conformal_offsets(spark, d):
    return rounded(forecast.conformal_offsets(_residuals(filled(spark, d, "p_brand"))), "lower", "upper", digits=3)


CONFORMAL_OFFSETS = (
    with_(LINES, DAILY, FILLED, RESIDUALS, key="p_brand")
    + """SELECT sku, round((CASE WHEN count(*) < 8 THEN -1.2816 * stddev_samp(err) ELSE quantile_cont(err, 0.1) END) + 1e-9, 3) AS lower,
  round((CASE WHEN count(*) < 8 THEN 1.2816 * stddev_samp(err) ELSE quantile_cont(err, 0.9) END) + 1e-9, 3) AS upper FROM resid GROUP BY sku"""
)

SCORES = """span AS (SELECT sku, min(ds) AS a, max(ds) AS b FROM filled GROUP BY sku),
room AS (SELECT sku, a + 120 AS first, b - 28 AS last, date_diff('day', a + 120, b - 28) AS testable, greatest(4, date_diff('day', a + 120, b - 28) // 28 + 1) AS windows FROM span WHERE date_diff('day', a + 120, b - 28) >= 0),
steps AS (SELECT *, least(greatest(1, CAST(round_even(windows * 0.5, 0) AS BIGINT)), testable // step + 1) AS recent FROM room, (SELECT unnest(range(14, 29)) AS step)),
spread AS (SELECT *, (recent - 1) * step AS oldest, windows - recent AS rest, testable - (recent - 1) * step AS back FROM steps),
wider AS (SELECT *, greatest(14, back // greatest(rest, 1)) AS wide FROM spread),
sized AS (SELECT *, CASE WHEN rest > 0 AND back >= 14 THEN least(rest, back // wide) ELSE 0 END AS historic FROM wider),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY recent + historic DESC, step DESC) AS r FROM sized) WHERE r = 1),
blocks AS (SELECT sku, CAST(last - CAST(i * step AS INTEGER) AS DATE) AS cutoff, 'recent' AS block FROM (SELECT *, unnest(range(0, recent)) AS i FROM picked)
  UNION ALL SELECT sku, CAST(last - CAST(oldest + i * wide AS INTEGER) AS DATE), 'historic' FROM (SELECT *, unnest(range(1, historic + 1)) AS i FROM picked)),
cuts AS (SELECT sku, cutoff FROM blocks),
lev AS (SELECT c.sku, cutoff, avg(y) AS yhat FROM cuts c JOIN filled f ON f.sku = c.sku AND f.ds BETWEEN cutoff - 27 AND cutoff GROUP BY 1, 2),
sc AS (SELECT sku, ds AS cutoff, avg(abs(y - l)) OVER (PARTITION BY sku ORDER BY ds ROWS UNBOUNDED PRECEDING) AS scale FROM (SELECT *, lag(y, 7) OVER (PARTITION BY sku ORDER BY ds) AS l FROM filled)),
s AS (SELECT c.sku, c.cutoff, count(*) AS n, sum(y) AS sum_y, sum(yhat) AS sum_yhat, sum(abs(y - yhat)) AS abs_err FROM cuts c JOIN filled f ON f.sku = c.sku AND f.ds BETWEEN c.cutoff + 1 AND c.cutoff + 28 JOIN lev ON lev.sku = c.sku AND lev.cutoff = c.cutoff GROUP BY 1, 2),
scores AS (SELECT s.*, abs_err / n AS mae, CASE WHEN sum_y > 0 THEN abs_err / sum_y END AS wape, CASE WHEN sum_y > 0 THEN (sum_yhat - sum_y) / sum_y END AS bias, CASE WHEN scale > 0 THEN abs_err / n / scale END AS mase FROM s JOIN sc USING (sku, cutoff))"""


def backtest_windows(spark, d):
    return rounded(backtest.score(kept(spark, d)), "sum_yhat", "abs_err", "mae", "wape", "bias", "mase", digits=3)


BACKTEST_WINDOWS = with_(LINES, DAILY, FILLED, SCORES) + "SELECT sku, cutoff, n, sum_y, round(sum_yhat + 1e-9, 3) AS sum_yhat, round(abs_err + 1e-9, 3) AS abs_err, round(mae + 1e-9, 3) AS mae, round(wape + 1e-9, 3) AS wape, round(bias + 1e-9, 3) AS bias, round(mase + 1e-9, 3) AS mase FROM scores"


def backtest_summary(spark, d):
    return rounded(backtest.aggregate(backtest.score(kept(spark, d))), "wape", "bias", "mase")


BACKTEST_SUMMARY = (
    with_(LINES, DAILY, FILLED, SCORES)
    + """SELECT CASE WHEN grouping(sku) = 0 THEN 'sku' WHEN grouping(yr) = 0 THEN 'year' ELSE 'all' END AS level, sku, CAST(yr AS INTEGER) AS year, count(*) AS windows,
  round((sum(abs_err) / sum(sum_y)) + 1e-9, 4) AS wape, round(((sum(sum_yhat) - sum(sum_y)) / sum(sum_y)) + 1e-9, 4) AS bias, round(avg(mase) + 1e-9, 4) AS mase
FROM (SELECT *, year(cutoff) AS yr FROM scores) GROUP BY GROUPING SETS ((sku), (yr), ())"""
)

LEAD, COVERAGE = 14, 30


def reorder_plan(spark, d):
    rows = kept(spark, d)
    residuals = _residuals(rows)
    day = residuals.groupBy("sku").agg(F.stddev_samp("err").alias("sigma_day"))
    sigma = day.join(forecast.lead_window_sigma(residuals, LEAD).withColumnRenamed("sigma", "sigma_lead"), "sku", "left")
    safety = planning.safety_stock(sigma, LEAD, planning.SERVICE_LEVELS[95.0]).select("sku", "safety")
    end = rows.groupBy("sku").agg(F.max("ds").alias("end"))
    ahead = end.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(120)))).withColumn("weekday", F.dayofweek(F.expr("date_add(end, day)")))
    plan = ahead.join(forecast.recent_level(rows), "sku").join(forecast.weekday_profile(rows), ["sku", "weekday"])
    plan = plan.select("sku", "day", (F.col("level") * F.col("profile")).alias("yhat"))
    stock = forecast.aged(rows).where("age < 40").groupBy("sku").agg(F.sum("y").alias("on_hand"))
    return planning.reorder_plan(stock, plan, safety, LEAD, COVERAGE)


REORDER_PLAN = (
    with_(LINES, DAILY, FILLED, AGED, RESIDUALS, SIGMA, PROFILE, LEVELS)
    + """, sd AS (SELECT sku, stddev_samp(err) * sqrt(14.0) AS base FROM resid GROUP BY sku),
safe AS (SELECT sku, round(1.645 * CASE WHEN sigma IS NULL THEN base ELSE least(greatest(sigma, base), 3 * base) END) AS safety FROM sd LEFT JOIN sigma USING (sku)),
stock AS (SELECT sku, sum(y) AS on_hand FROM aged WHERE age < 40 GROUP BY sku),
plan AS (SELECT e.sku, day, level * profile AS yhat FROM (SELECT sku, max(ds) AS e, unnest(range(1, 121)) AS day FROM filled GROUP BY sku) e JOIN levels USING (sku) JOIN profile p ON p.sku = e.sku AND p.weekday = dayofweek(e.e + CAST(day AS INTEGER)) + 1),
used AS (SELECT *, sum(greatest(yhat, 0)) OVER (PARTITION BY sku ORDER BY day) AS used FROM plan JOIN stock USING (sku)),
o AS (SELECT sku, on_hand, min(day) FILTER (used >= on_hand) AS out_day, coalesce(min(day) FILTER (used >= on_hand), max(day) + 1) - 14 AS reorder FROM used GROUP BY sku, on_hand),
n AS (SELECT sku, on_hand, out_day, reorder, sum(CASE WHEN day <= greatest(reorder, 0) + 14 THEN greatest(yhat, 0) ELSE 0 END) AS before,
  avg(yhat) FILTER (day > greatest(reorder, 0) + 14 AND day <= greatest(reorder, 0) + 44) AS rate FROM plan JOIN o USING (sku) GROUP BY ALL)
SELECT sku, out_day AS days_to_stockout, reorder AS days_to_reorder, round(coalesce(rate, 0) * 30) AS coverage_qty, greatest(0, on_hand - round(before)) AS stock_at_delivery, safety,
  greatest(0, round(coalesce(rate, 0) * 30) + safety - greatest(0, on_hand - round(before))) AS order_qty FROM n JOIN safe USING (sku)"""
)


def supplier_stats(spark, d):
    return rounded(planning.supplier_stats(tables.purchase_orders(spark, d)), "avg_days", "p80_days")


ORDERED = "ord AS (SELECT l_suppkey AS supplier, l_partkey AS sku, o_orderpriority AS lane, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SUPPLIER_STATS = with_(ORDERED) + "SELECT supplier, count(*) AS n, round(avg(lead) + 1e-9, 4) AS avg_days, round(quantile_cont(lead, 0.8) + 1e-9, 4) AS p80_days FROM ord WHERE lead >= 0 GROUP BY supplier"


def lane_stats(spark, d):
    return rounded(planning.lane_stats(tables.purchase_orders(spark, d)), "p80_days")


LANE_STATS = with_(ORDERED) + "SELECT supplier, lane, count(*) AS n, round(quantile_cont(lead, 0.8) + 1e-9, 4) AS p80_days FROM ord WHERE lead >= 0 GROUP BY GROUPING SETS ((supplier, lane), (lane))"


def planning_lead(spark, d):
    """Lanes are the orders' priorities."""
    return planning.planning_lead(tables.purchase_orders(spark, d))


PLANNING_LEAD = (
    with_(ORDERED)
    + """, own AS (SELECT sku, lane, count(*) AS n, round(quantile_cont(lead, 0.8)) AS p FROM ord WHERE lead >= 0 GROUP BY sku, lane QUALIFY row_number() OVER (PARTITION BY sku ORDER BY lane IS NULL, count(*) DESC, lane) = 1)
SELECT CAST(sku AS VARCHAR) AS sku, lane, CASE WHEN n >= 3 THEN p ELSE 14.0 END AS lead, CASE WHEN n >= 3 THEN 'measured' ELSE 'baseline' END AS source, coalesce(n, 0) AS n FROM (SELECT DISTINCT sku FROM ord) LEFT JOIN own USING (sku)"""
)

READINGS = "readings AS (SELECT user_id AS sku, ts, max(CAST(floor(value / 10) AS BIGINT)) AS on_hand FROM events GROUP BY 1, 2)"


def reading_collapse(spark, d):
    return telemetry.collapse(tables.stock_readings(spark, d))


READING_COLLAPSE = (
    with_(READINGS)
    + "SELECT sku, ts, on_hand FROM (SELECT *, coalesce(lag(on_hand) OVER w = on_hand, false) AND coalesce(lead(on_hand) OVER w = on_hand, false) AS inside FROM readings WINDOW w AS (PARTITION BY sku ORDER BY ts)) WHERE NOT inside"
)


def stock_jumps(spark, d):
    return telemetry.jumps(tables.stock_readings(spark, d))


STOCK_JUMPS = with_(READINGS) + "SELECT sku, ts, gain FROM (SELECT sku, ts, on_hand - lag(on_hand) OVER (PARTITION BY sku ORDER BY ts) AS gain FROM readings) WHERE gain >= 3"

HOURS = """h AS (SELECT sku, on_hand, CAST(floor(epoch(ts)) AS BIGINT) AS a, coalesce(lead(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY sku ORDER BY ts), CAST(floor(epoch(ts)) AS BIGINT) + 93600) AS b FROM readings),
e AS (SELECT *, unnest(range(a // 86400, (b - 1) // 86400 + 1)) AS d FROM h WHERE b > a),
hours AS (SELECT sku, DATE '1970-01-01' + CAST(d AS INTEGER) AS ds, sum(least(b, (d + 1) * 86400) - greatest(a, d * 86400)) AS covered, sum(CASE WHEN on_hand > 0 THEN least(b, (d + 1) * 86400) - greatest(a, d * 86400) ELSE 0 END) AS stocked
  FROM e GROUP BY 1, 2 HAVING sum(least(b, (d + 1) * 86400) - greatest(a, d * 86400)) >= 43200)"""


def hours_in_stock(spark, d):
    """Over the days of a store in New York."""
    return rounded(telemetry.hours_in_stock(tables.stock_readings(spark, d), STORE_ZONE), "hours", digits=3)


STORE_ZONE = "America/New_York"
#: The store's day of an instant and the second at which a store's day starts.
LOCAL_DAY = f"CAST(timezone('{STORE_ZONE}', timezone('UTC', CAST({{ts}} AS TIMESTAMP))) AS DATE)"
LOCAL_START = f"CAST(epoch(timezone('UTC', timezone('{STORE_ZONE}', CAST({{day}} AS TIMESTAMP)))) AS BIGINT)"
STORE_HOURS = (
    HOURS.split("\n")[0]
    + f"""
e AS (SELECT *, CAST(unnest(generate_series(CAST({LOCAL_DAY.format(ts="make_timestamp(a * 1000000)")} AS TIMESTAMP), CAST({LOCAL_DAY.format(ts="make_timestamp((b - 1) * 1000000)")} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM h WHERE b > a),
f AS (SELECT *, {LOCAL_START.format(day="ds")} AS s FROM e), g AS (SELECT sku, ds, on_hand, greatest(least(b, s + 86400) - greatest(a, s), 0) AS held FROM f),
hours AS (SELECT sku, ds, sum(held) AS covered, coalesce(sum(held) FILTER (on_hand > 0), 0) AS stocked FROM g GROUP BY 1, 2 HAVING sum(held) >= 43200)"""
)
HOURS_IN_STOCK = with_(READINGS, STORE_HOURS) + "SELECT sku, CAST(ds AS DATE) AS ds, CAST(covered AS BIGINT) AS covered, round((24.0 * stocked / covered) + 1e-9, 3) AS hours FROM hours"


def _estimated(spark, d):
    readings = tables.stock_readings(spark, d)
    sales = tables.table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("sku"), F.to_date("ts").alias("ds")).agg(F.count("*").cast("double").alias("y"))
    closing = readings.groupBy("sku", F.to_date("ts").alias("ds")).agg(F.max_by("on_hand", "ts").alias("closing"))
    days = telemetry.hours_in_stock(readings).join(sales, ["sku", "ds"], "left").join(closing, ["sku", "ds"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    return telemetry.demand_estimate(days).select("sku", "ds", "y", "kind", "estimate", "is_floor", "weight")


def demand_estimate(spark, d):
    return rounded(_estimated(spark, d), "estimate", "weight", digits=3)


DEMAND_ESTIMATE = (
    with_(READINGS, HOURS)
    + """, sales AS (SELECT user_id AS sku, CAST(ts AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
closes AS (SELECT sku, CAST(ts AS DATE) AS ds, arg_max(on_hand, ts) AS closing FROM readings GROUP BY 1, 2),
j AS (SELECT h.sku, CAST(h.ds AS DATE) AS ds, coalesce(y, 0) AS y, CAST(stocked AS DOUBLE) / covered AS share, closing FROM hours h LEFT JOIN sales s ON s.sku = h.sku AND s.ds = CAST(h.ds AS DATE) LEFT JOIN closes c ON c.sku = h.sku AND c.ds = CAST(h.ds AS DATE)),
k AS (SELECT *, CASE WHEN share < 0.10 THEN CASE WHEN y > 0 THEN 'capped' ELSE 'unavailable' END WHEN share < 0.95 THEN 'partial' WHEN closing <= 0 THEN 'capped' ELSE 'normal' END AS kind FROM j)
SELECT sku, ds, y, kind, round((CASE WHEN kind = 'partial' THEN y * least(3.0, 1 / share) WHEN kind <> 'unavailable' THEN y END) + 1e-9, 3) AS estimate, kind <> 'normal' AS is_floor,
  round(CASE kind WHEN 'unavailable' THEN 0.0 WHEN 'capped' THEN 0.5 WHEN 'partial' THEN greatest(0.1, share) ELSE 1.0 END + 1e-9, 3) AS weight FROM k"""
)

STEPPED = """daily AS (SELECT p_brand AS sku, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS y,
  CAST(20 + 2 * ((year(CAST(l_shipdate AS DATE)) * 4 + quarter(CAST(l_shipdate AS DATE)) + CAST(substring(p_brand, 7) AS INTEGER)) % 3) + 0.01 * (day(CAST(l_shipdate AS DATE)) % 2) AS DOUBLE) AS price,
  CAST(day(CAST(l_shipdate AS DATE)) = 13 AS INTEGER) AS price_mixed, CAST(2 * sum(CASE WHEN l_discount >= 0.08 THEN l_quantity ELSE 0 END) > sum(l_quantity) AS INTEGER) AS on_promotion
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 4, 5),
spans AS (SELECT sku, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST((SELECT max(ds) FROM daily) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily GROUP BY sku),
sj AS (SELECT s.sku, s.ds, coalesce(y, 0) AS y, price, coalesce(price_mixed, 0) AS price_mixed, coalesce(on_promotion, 0) AS on_promotion, CASE WHEN coalesce(price_mixed, 0) = 0 THEN price END AS pure FROM spans s LEFT JOIN daily d ON d.sku = s.sku AND d.ds = s.ds),
stepped AS (SELECT sku, ds, y, price_mixed, on_promotion, coalesce(price, last_value(pure IGNORE NULLS) OVER (PARTITION BY sku ORDER BY ds ROWS UNBOUNDED PRECEDING),
  first_value(pure IGNORE NULLS) OVER (PARTITION BY sku ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM sj),
single AS (SELECT *, round(price + 1e-9, 2) AS cents FROM stepped WHERE price_mixed < 1 AND price IS NOT NULL)"""
PRICE_LEVELS_SQL = """pc AS (SELECT sku, cents, count(*) AS n FROM single GROUP BY 1, 2),
po AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY cents) AS i FROM pc),
anchored(sku, i, cents, n, anchor) AS (SELECT sku, i, cents, n, cents FROM po WHERE i = 1
  UNION ALL SELECT po.sku, po.i, po.cents, po.n, CASE WHEN po.cents - a.anchor <= greatest(0.02, 0.005 * abs(po.cents)) THEN a.anchor ELSE po.cents END FROM anchored a JOIN po ON po.sku = a.sku AND po.i = a.i + 1),
lv AS (SELECT sku, dense_rank() OVER (PARTITION BY sku ORDER BY anchor) AS level, sum(n) AS days, arg_max(cents, n * 1e7 + cents) AS price FROM anchored GROUP BY sku, anchor)"""


def stepped(spark, d):
    """Brands whose listed price moves by quarter."""
    return calendar.fill_calendar(tables.stepped_sales(spark, d))


def price_levels(spark, d):
    return pricing.price_levels(stepped(spark, d))


PRICE_LEVELS = "WITH RECURSIVE " + STEPPED + ",\n" + PRICE_LEVELS_SQL + "SELECT sku, CAST(level AS INTEGER) AS level, CAST(days AS BIGINT) AS days, price, " + rules.TIER_QUALITY + " AS quality FROM lv"


def price_evidence(spark, d):
    rows = stepped(spark, d)
    return pricing.price_evidence(rows, pricing.price_levels(rows))


EVIDENCE_SQL = """ev AS (SELECT s.sku, coalesce(levels, 0) AS levels, coalesce(q, 0) AS qualifying, mixed_days, last_price, lo, hi,
  CASE WHEN coalesce(levels, 0) = 0 THEN 'no-price-data' WHEN coalesce(q, 0) < 2 THEN 'too-few-price-levels' WHEN (hi - lo) / hi < 0.05 THEN 'levels-too-close' ELSE 'usable' END AS reason
  FROM (SELECT sku, count(*) FILTER (price_mixed >= 1) AS mixed_days, arg_max(price, ds) FILTER (price_mixed < 1 AND price IS NOT NULL) AS last_price FROM stepped GROUP BY sku) s
  LEFT JOIN (SELECT sku, count(*) AS levels, count(*) FILTER (days >= 30) AS q, min(price) FILTER (days >= 30) AS lo, max(price) FILTER (days >= 30) AS hi FROM lv GROUP BY sku) USING (sku))"""
PRICE_EVIDENCE = (
    "WITH RECURSIVE " + STEPPED + ",\n" + PRICE_LEVELS_SQL + ",\n" + EVIDENCE_SQL
    + """SELECT sku, levels, qualifying, mixed_days, last_price, CASE WHEN qualifying >= 2 THEN lo END AS range_lo, CASE WHEN qualifying >= 2 THEN hi END AS range_hi, reason = 'usable' AS usable, reason FROM ev"""
)


def elasticity(spark, d):
    return rounded(pricing.elasticity(staged(stepped(spark, d))), "elasticity")


ELASTICITY_SQL = """cells AS (SELECT sku, cents, count(*) AS w, ln(cents) AS x, ln(avg(y)) AS z FROM single WHERE cents > 0 AND y >= 0 GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(y) > 0),
mcells AS (SELECT sku, month(ds) AS month, cents, count(*) AS w, ln(cents) AS x, ln(avg(y)) AS z FROM single WHERE cents > 0 AND y >= 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND avg(y) > 0),
across AS (SELECT sku, count(*) AS k, 1 - min(cents) / max(cents) AS spread, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS den, sum(w * x * z) - sum(w * x) * sum(w * z) / sum(w) AS num FROM cells GROUP BY sku),
mm AS (SELECT sku, month, sum(w) AS sw, max(w) AS mw, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS den, sum(w * x * z) - sum(w * x) * sum(w * z) / sum(w) AS num FROM mcells GROUP BY 1, 2 HAVING count(*) >= 2),
within AS (SELECT sku, sum(num) / sum(den) AS within, count(*) AS months FROM mm GROUP BY sku HAVING sum(den) > 1e-12 AND sum(sw - mw) >= 30),
pts AS (SELECT sku, count(*) FILTER (y > 0) AS points FROM single WHERE cents > 0 GROUP BY sku),
el AS (SELECT sku, points, coalesce(within, num / den) AS raw, CASE WHEN points < 30 THEN 'too-few-points' WHEN NOT coalesce(k >= 2 AND spread >= 0.05 AND den > 1e-12, false) THEN 'price-never-varied'
  WHEN coalesce(within, num / den) > 0 THEN 'positive-elasticity-ignored' ELSE 'measured' END AS basis FROM pts LEFT JOIN across USING (sku) LEFT JOIN within USING (sku)),
elasticities AS (SELECT sku, points, basis, CASE WHEN basis = 'measured' THEN greatest(raw * points / (points + 60), -4.0) ELSE 0.0 END AS elasticity FROM el)"""
ELASTICITY = "WITH " + STEPPED + ",\n" + ELASTICITY_SQL + " SELECT sku, points, basis, round(elasticity + 1e-9, 4) AS elasticity FROM elasticities"


def promotion_lift(spark, d):
    return rounded(pricing.promotion_lift(stepped(spark, d)), "lift")


LIFT_SQL = """ls AS (SELECT sku, count(*) FILTER (on_promotion >= 1) AS n, count(*) FILTER (on_promotion < 1) AS m, avg(y) FILTER (on_promotion >= 1) AS p, avg(y) FILTER (on_promotion < 1) AS q FROM stepped GROUP BY sku),
lifts AS (SELECT sku, n AS promo_days, m AS normal_days, CASE WHEN n < 3 OR m = 0 THEN 'too-few-promo-days' WHEN q <= 0 THEN 'no-normal-baseline' ELSE 'own-history' END AS basis,
  CASE WHEN n >= 3 AND m > 0 AND q > 0 THEN least(greatest(1 + (p / q - 1) * n / (n + 5), 0.5), 5.0) ELSE 1.0 END AS lift FROM ls)"""
PROMOTION_LIFT = "WITH " + STEPPED + ",\n" + LIFT_SQL + " SELECT sku, promo_days, normal_days, basis, round(lift + 1e-9, 4) AS lift FROM lifts"


def promotion_hold_out(spark, d):
    rows = filled(spark, d, "p_brand")
    return calendar.hold_out_promotions(rows, 2 * F.col("promo_units") > F.col("y")).groupBy("sku").agg(F.count("*").alias("days"), F.sum("y").alias("units"))


PROMOTION_HOLD_OUT = (
    with_(LINES, DAILY, FILLED, key="p_brand")
    + """, c AS (SELECT sku, count(*) AS n, count(*) FILTER (2 * promo_units > y) AS k FROM filled GROUP BY sku)
SELECT sku, count(*) AS days, sum(y) AS units FROM filled JOIN c USING (sku) WHERE k > 0.4 * n OR n - k < 45 OR NOT 2 * promo_units > y GROUP BY sku"""
)


def store_zero_days(spark, d):
    return calendar.store_zero_days(calendar.daily_sales(tables.sales_lines(spark, d)))


STORE_ZERO_DAYS = (
    with_(LINES, DAILY, FILLED)
    + """, days AS (SELECT ds, sum(y) AS units, count(*) AS on_file FROM filled GROUP BY ds)
SELECT ds, on_file FROM days WHERE units = 0 AND on_file >= 3 AND (SELECT count(DISTINCT sku) FROM daily) >= 3 AND (SELECT median(units) FROM days) >= 5"""
)

def latest_reading(spark, d):
    return telemetry.latest(tables.stock_readings(spark, d))


LATEST_READING = with_(READINGS) + "SELECT sku, max(ts) AS ts, arg_max(on_hand, ts) AS on_hand FROM readings GROUP BY sku"


def reading_coverage(spark, d):
    return telemetry.coverage(tables.stock_readings(spark, d))


READING_COVERAGE = with_(READINGS) + "SELECT sku, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS samples FROM readings GROUP BY sku"


def reading_retention(spark, d):
    return telemetry.retain(tables.stock_readings(spark, d), 10)


READING_RETENTION = (
    with_(READINGS)
    + """, cut AS (SELECT max(ts) - INTERVAL 10 DAY AS cutoff FROM readings)
SELECT sku, ts, on_hand FROM readings, cut WHERE ts >= cutoff
UNION ALL SELECT sku, max(ts), arg_max(on_hand, ts) FROM readings, cut WHERE ts < cutoff GROUP BY sku"""
)


def stock_state(spark, d):
    return telemetry.state(tables.stock_readings(spark, d), STORE_ZONE)


STOCK_STATE = (
    with_(READINGS)
    + f""", day AS (SELECT {LOCAL_DAY.format(ts="max(ts)")} AS today FROM readings),
f AS (SELECT *, max(ts) FILTER (on_hand > 0) OVER (PARTITION BY sku) AS last_filled FROM readings, day)
SELECT sku, arg_max(on_hand, ts) AS level, CASE WHEN arg_max(on_hand, ts) <= 0 THEN 'out' ELSE 'in' END AS state, count(*) FILTER ({LOCAL_DAY.format(ts="ts")} = today) AS readings_today,
  bool_or({LOCAL_DAY.format(ts="ts")} = today AND on_hand <= 0) AS went_out_today, min(ts) FILTER (last_filled IS NULL OR ts > last_filled) AS out_since FROM f GROUP BY sku"""
)


def censoring_summary(spark, d):
    return rounded(telemetry.censoring_summary(_estimated(spark, d)), "censored_share", "hidden_units", "understated_pct", digits=2)


CENSORING_SUMMARY = (
    "WITH est AS (SELECT sku, y, kind, estimate FROM ("
    + DEMAND_ESTIMATE.replace("round((", "((").replace(") + 1e-9, 3) AS estimate", ")) AS estimate")
    + """))
SELECT sku, count(*) AS days, count(*) FILTER (kind = 'normal') AS normal, count(*) FILTER (kind = 'capped') AS capped, count(*) FILTER (kind = 'partial') AS partial,
  count(*) FILTER (kind = 'unavailable') AS unavailable, sum(y) AS observed, round(100.0 * count(*) FILTER (kind <> 'normal') / count(*) + 1e-9, 2) AS censored_share,
  round(coalesce(sum(estimate), 0) - sum(y) + 1e-9, 2) AS hidden_units,
  CASE WHEN sum(y) > 0 THEN round(100 * (coalesce(sum(estimate), 0) - sum(y)) / sum(y) + 1e-9, 2) END AS understated_pct FROM est GROUP BY sku"""
)


def margin_protection(spark, d):
    costs = tables.table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * (40 + F.col("p_size")) / 100.5).alias("unit_cost"))
    return rounded(planning.margins(costs).select("sku", "margin_pct", "return_tier", "protection"), "margin_pct")


MARGIN_PROTECTION = """WITH m AS (SELECT p_partkey AS sku, 100 * (p_retailprice - p_retailprice * (40 + p_size) / 100.5) / p_retailprice AS m FROM part WHERE p_retailprice > 0
UNION ALL SELECT p_partkey, NULL FROM part WHERE p_retailprice IS NULL OR p_retailprice <= 0)
SELECT sku, round(m + 1e-9, 4) AS margin_pct, CASE WHEN m >= 40 THEN 'A' WHEN m >= 20 THEN 'B' WHEN m > 0 THEN 'C' WHEN m <= 0 THEN 'F' END AS return_tier,
  CASE WHEN m < 15 THEN 'light' WHEN m < 30 THEN 'standard' WHEN m < 50 THEN 'high' WHEN m >= 50 THEN 'max' ELSE 'standard' END AS protection FROM m"""


def cover_direction(spark, d):
    return planning.cover(reorder_plan(spark, d), LEAD, COVERAGE)


COVER_DIRECTION = (
    "SELECT sku, days_to_stockout AS days_of_cover, CASE WHEN days_to_stockout IS NULL THEN 'long' WHEN days_to_stockout < 16.8 THEN 'short' WHEN days_to_stockout > 44 THEN 'long' ELSE 'healthy' END AS direction, "
    "CASE WHEN days_to_reorder <= 0 THEN 'now' WHEN days_to_reorder <= 7 THEN 'risk' WHEN days_to_reorder <= 21 THEN 'due' ELSE 'later' END AS band FROM (" + REORDER_PLAN + ")"
)

BOM = """bom AS (SELECT bundle, component, sum(qty) AS qty FROM (
  SELECT p_partkey AS bundle, p_partkey // 2 AS component, 2.0::DOUBLE AS qty FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_partkey // 5 + 1, 1.0::DOUBLE FROM part WHERE p_partkey % 3 = 0
) WHERE bundle <> component GROUP BY 1, 2),
r(bundle, sku, qty, path, depth) AS (SELECT DISTINCT bundle, bundle, 1.0::DOUBLE, []::BIGINT[], 0 FROM bom
  UNION ALL SELECT r.bundle, bom.component, r.qty * bom.qty, list_append(path, r.sku), depth + 1 FROM r JOIN bom ON r.sku = bom.bundle WHERE depth < 4 AND NOT list_contains(path, r.sku)),
flat AS (SELECT bundle, sku, sum(qty) AS qty FROM r WHERE depth = 4 OR list_contains(path, sku) OR sku NOT IN (SELECT bundle FROM bom) GROUP BY 1, 2)"""


def _bundle_parts(spark, d):
    """Every third part counts as a bundle of two others."""
    part = tables.table(spark, d, "part").where("p_partkey % 3 = 0")
    pairs = part.selectExpr("p_partkey AS bundle", "inline(array(struct(p_partkey div 2 AS component, 2D AS qty), struct(p_partkey div 5 + 1 AS component, 1D AS qty)))")
    return bundles.normalise(pairs)


def bundle_expansion(spark, d):
    return bundles.expand(_bundle_parts(spark, d))


BUNDLE_EXPANSION = "WITH RECURSIVE " + BOM + " SELECT bundle, sku, qty FROM flat"


def bundle_dependency(spark, d):
    units = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.sum("l_quantity").alias("units"))
    return rounded(bundles.dependency(units, bundles.expand(_bundle_parts(spark, d))), "share_pct")


BUNDLE_DEPENDENCY = (
    "WITH RECURSIVE "
    + BOM
    + """, u AS (SELECT l_partkey AS sku, sum(l_quantity) AS units FROM lineitem GROUP BY 1),
v AS (SELECT flat.sku, sum(qty * units) AS via FROM flat JOIN u ON u.sku = flat.bundle WHERE flat.bundle <> flat.sku GROUP BY 1 HAVING sum(qty * units) > 0)
SELECT v.sku, coalesce(units, 0) AS own_units, via AS via_bundles, round(100 * via / (coalesce(units, 0) + via) + 1e-9, 4) AS share_pct, 100 * via / (coalesce(units, 0) + via) >= 50 AS bundle_driven
FROM v LEFT JOIN u ON u.sku = v.sku"""
)

NAMES = (
    "reorder_plan daily_sales daily_price_rollup calendar_fill demand_class dormancy dispersion_index forecast_route volume_peers monthly_index "
    "index_strength seasonal_signature shape_links year_on_year rush_weeks weekday_profile recent_level moving_average sparse_demand lead_window_sigma "
    "conformal_offsets backtest_windows backtest_summary supplier_stats lane_stats planning_lead reading_collapse stock_jumps hours_in_stock demand_estimate "
    "price_levels price_evidence elasticity promotion_lift promotion_hold_out store_zero_days "
    "latest_reading reading_coverage reading_retention stock_state censoring_summary margin_protection cover_direction bundle_expansion bundle_dependency"
).split()


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return {n: globals()[n.upper()] for n in NAMES}

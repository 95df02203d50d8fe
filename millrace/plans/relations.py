"""Queries on events, windows and sets, on holidays and engines, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import backtest, engines, holidays, planning, telemetry
from millrace.plans.decisions import COSTS, LINES, SUPPLIED, Query, _costs, _families, _supplied, r
from millrace.plans.queries import DAILY, FILLED, STEPPED, TREND_NONE, daily, filled, rounded, stepped, with_
from millrace.sources import tables
from millrace.streaming import events as stream

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


@query("SELECT user_id AS sku, time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS units FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def tumbling_sales(spark, d):
    return stream.hourly_sales(tables.table(spark, d, "events"))


@query(
    "SELECT user_id AS sku, time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INTEGER)) AS start, time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INTEGER)) + INTERVAL 7 DAY AS \"end\", count(*) AS units FROM events, (SELECT unnest(range(0, 7)) AS k) WHERE event_type = 'purchase' GROUP BY 1, 2"
)
def sliding_sales(spark, d):
    return stream.hourly_sales(tables.table(spark, d, "events"), slide="1 day", width="7 days")


@query(
    """WITH g AS (SELECT user_id AS sku, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY sku ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT sku, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY sku, session"""
)
def event_sessions(spark, d):
    return stream.sessions(tables.table(spark, d, "events").dropDuplicates(["user_id", "ts", "event_id"]))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_props(spark, d):
    return stream.with_props(tables.table(spark, d, "events")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT user_id AS sku, ts, max(CAST(floor(value / 10) AS BIGINT)) AS on_hand FROM events GROUP BY 1, 2),
m AS (SELECT DISTINCT user_id AS sku, date_trunc('hour', ts) AS "at" FROM events WHERE event_type = 'purchase') SELECT m.sku, m."at", on_hand FROM m ASOF LEFT JOIN r ON m.sku = r.sku AND m."at" >= r.ts"""
)
def level_at_sales(spark, d):
    asked = tables.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("sku"), F.date_trunc("hour", "ts").alias("at")).distinct()
    return stream.level_at(tables.stock_readings(spark, d), asked)


@query(
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), c AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, c.k) AS k, n_orders, nation FROM o FULL JOIN c ON o.k = c.k"""
)
def outer_match(spark, d):
    some = tables.table(spark, d, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    even = tables.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return some.join(even, "k", "full_outer")


@query(
    """WITH a AS (SELECT l_partkey AS sku FROM lineitem WHERE l_discount >= 0.08), b AS (SELECT l_partkey AS sku FROM lineitem WHERE l_quantity >= 45)
SELECT 'both' AS side, sku FROM (SELECT sku FROM a INTERSECT SELECT sku FROM b) UNION ALL SELECT 'promoted only', sku FROM (SELECT sku FROM a EXCEPT SELECT sku FROM b)"""
)
def promoted_and_bulk(spark, d):
    lines = tables.table(spark, d, "lineitem")
    a, b = lines.where("l_discount >= 0.08").select(F.col("l_partkey").alias("sku")), lines.where("l_quantity >= 45").select(F.col("l_partkey").alias("sku"))
    return a.intersect(b).select(F.lit("both").alias("side"), "sku").union(a.subtract(b).select(F.lit("promoted only").alias("side"), "sku"))


@query("SELECT s_suppkey AS supplier, regexp_extract(upper(s_name), '[0-9]+$') AS digits, length(s_name) AS n, concat_ws('/', s_suppkey, s_nationkey) AS code FROM supplier")
def supplier_codes(spark, d):
    found = tables.table(spark, d, "supplier")
    return found.select(F.col("s_suppkey").alias("supplier"), F.regexp_extract(F.upper("s_name"), "[0-9]+$", 0).alias("digits"), F.length("s_name").alias("n"), F.concat_ws("/", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("code"))


def _holiday_years(spark, d):
    return holidays.assigned(spark, 1995, 2001).where(F.col("ds").between("1995-01-01", "2001-12-31"))


@query(None)
def holiday_days(spark, d):
    """Each day of a holiday's stretch from 1995 to 2001; a test has Easter and the floating days by hand."""
    return _holiday_years(spark, d)


@query(None)
def fitted_forecast(spark, d):
    """The fitted engine; a test has a trend and a season that it must find."""
    return rounded(engines.fitted_forecast(filled(spark, d)), "yhat", "lower", "upper", "recent_weight")


POOLED = TREND_NONE + """, pr AS (SELECT sku, substring(sku, 1, 7) AS category, ds, y / coalesce(nullif(avg(y) OVER (PARTITION BY sku), 0), 1) AS ratio FROM level),
own AS (SELECT category, sku, 'w' AS kind, CAST(isodow(ds) - 1 AS INTEGER) AS slot, avg(ratio) AS v FROM pr GROUP BY 1, 2, 4 UNION ALL SELECT category, sku, 'm', CAST(month(ds) AS INTEGER), avg(ratio) FROM pr GROUP BY 1, 2, 4),
pooled AS (SELECT category, kind, slot, avg(v) AS x FROM own GROUP BY 1, 2, 3),
grid AS (SELECT category, kind, slot FROM (SELECT DISTINCT category FROM pooled), (SELECT 'w' AS kind, CAST(unnest(range(0, 7)) AS INTEGER) AS slot UNION ALL SELECT 'm', CAST(unnest(range(1, 13)) AS INTEGER))),
idx AS (SELECT category, kind, slot, coalesce(x, 1) / avg(coalesce(x, 1)) OVER (PARTITION BY category, kind) AS x FROM grid LEFT JOIN pooled USING (category, kind, slot))"""


@query(with_(LINES, DAILY, FILLED, POOLED, key="p_brand") + f"SELECT category, kind, slot, {r('x')} AS \"index\" FROM idx")
def pooled_indices(spark, d):
    rows = filled(spark, d, "p_brand")
    return rounded(engines.pooled_indices(rows, _families(rows)), "index")


@query(
    with_(LINES, DAILY, FILLED, POOLED, key="p_brand")
    + f""", lst AS (SELECT max(ds) AS e FROM filled), rec AS (SELECT f.sku, -date_diff('day', f.ds, e) AS x, y / (CASE WHEN w.x * m.x > 1e-6 THEN w.x * m.x ELSE 1 END) AS z
  FROM filled f, lst JOIN idx w ON w.kind = 'w' AND w.category = substring(f.sku, 1, 7) AND w.slot = isodow(f.ds) - 1 JOIN idx m ON m.kind = 'm' AND m.category = substring(f.sku, 1, 7) AND m.slot = month(f.ds) WHERE date_diff('day', f.ds, e) < 90),
ft AS (SELECT sku, avg(z) AS mz, regr_slope(z, x) AS b, regr_intercept(z, x) AS a, count(*) AS n FROM rec GROUP BY sku), tot AS (SELECT sku, count(*) AS rows_, sum(y) AS units, avg(y) AS mean FROM filled GROUP BY sku),
lv AS (SELECT *, CASE WHEN rows_ >= 7 AND units > 0 THEN mz ELSE coalesce(mean, 0) END AS lev FROM ft JOIN tot USING (sku)),
gr AS (SELECT *, n >= 21 AND units > 0 AND b > 0 AND 30 * b >= 0.15 * greatest(lev, 1) AS grows FROM lv),
dy AS (SELECT sku, k AS day, e + CAST(k AS INTEGER) AS ds, CASE WHEN grows THEN greatest(a, 0) + least(b, lev) * 0.9 * (1 - pow(0.9, k)) / 0.1 ELSE lev END AS v FROM gr, lst, (SELECT unnest(range(1, 31)) AS k))
SELECT sku, CAST(day AS INTEGER) AS day, {r('greatest(v * w.x * m.x, 0)')} AS yhat FROM dy JOIN idx w ON w.kind = 'w' AND w.category = substring(sku, 1, 7) AND w.slot = isodow(ds) - 1 JOIN idx m ON m.kind = 'm' AND m.category = substring(sku, 1, 7) AND m.slot = month(ds)"""
)
def pooled_forecast(spark, d):
    rows = filled(spark, d, "p_brand")
    return rounded(engines.pooled_forecast(rows, _families(rows)), "yhat")


@query(
    f"""WITH p AS (SELECT p_partkey AS sku, p_partkey % 600 AS days, p_partkey % 5 AS relatives, (p_partkey % 100) / 100.0 AS cohesion FROM part)
SELECT sku, {r('CASE WHEN relatives >= 2 AND cohesion >= 0.35 AND days < 450 THEN least(greatest((450 - days) / 270.0, 0), 1) * (0.5 + 0.5 * least(greatest((cohesion - 0.35) / 0.65, 0), 1)) ELSE 0 END')} AS weight FROM p"""
)
def blend_weights(spark, d):
    k = F.col("p_partkey")
    rows = tables.table(spark, d, "part").select(k.alias("sku"), (k % 600).alias("days"), (k % 5).alias("relatives"), (k % 100 / 100.0).alias("cohesion"))
    return rounded(engines.blend_weight(rows).select("sku", "weight"), "weight")


RATES = """spans AS (SELECT sku, min(ds) AS start, max(ds) AS e FROM filled GROUP BY sku),
hs AS (SELECT *, date_diff('day', start, e) + 1 AS n, least(28, greatest(7, (date_diff('day', start, e) + 1) // 6)) AS h FROM spans),
org AS (SELECT sku, start, e, h, k, CAST(e - CAST(k * h AS INTEGER) AS DATE) AS origin FROM hs, (SELECT unnest(range(0, 4)) AS k) WHERE k <= CASE WHEN n >= 6 * h THEN 3 WHEN n >= 4 * h THEN 2 ELSE 1 END AND e - CAST(k * h AS INTEGER) >= start),
sl AS (SELECT f.sku, ds, y, row_number() OVER w AS i, date_diff('day', coalesce(lag(ds) OVER w, start - 1), ds) AS gap, date_diff('day', start, ds) + 1 AS t FROM filled f JOIN spans USING (sku) WHERE y > 0 WINDOW w AS (PARTITION BY f.sku ORDER BY ds)),
mt AS (SELECT sl.*, k, origin, h, max(i) OVER (PARTITION BY sl.sku, k) AS n, date_diff('day', start, origin) + 1 AS len FROM sl JOIN org ON org.sku = sl.sku AND ds <= origin),
rt AS (SELECT sku, k, origin, h, sum((CASE WHEN i = 1 THEN 1 ELSE 0.1 END) * pow(0.9, n - i) * y) / sum((CASE WHEN i = 1 THEN 1 ELSE 0.1 END) * pow(0.9, n - i) * gap) AS classic,
  sum((CASE WHEN i = 1 THEN 1 ELSE 0.2 END) * pow(0.8, n - i) * y) * sum((CASE WHEN t = 1 THEN 1 ELSE 0.2 END) * pow(0.8, len - t)) AS decaying FROM mt GROUP BY 1, 2, 3, 4),
er AS (SELECT rt.sku, y, classic, 0.95 * classic AS corrected, decaying FROM rt JOIN filled f ON f.sku = rt.sku AND f.ds > origin AND f.ds <= origin + CAST(h AS INTEGER) WHERE k > 0),
ma AS (SELECT sku, avg(abs(y - classic)) AS a, avg(abs(y - corrected)) AS b, avg(abs(y - decaying)) AS c FROM er GROUP BY sku),
ch AS (SELECT rt.sku, CASE WHEN c < 0.98 * (CASE WHEN b < 0.98 * a THEN b ELSE a END) THEN 'decaying' WHEN b < 0.98 * a THEN 'corrected' ELSE 'classic' END AS model, classic, decaying FROM rt LEFT JOIN ma USING (sku) WHERE k = 0),
pk AS (SELECT sku, model, CASE model WHEN 'decaying' THEN decaying WHEN 'corrected' THEN 0.95 * classic ELSE classic END AS rate FROM ch),
sp AS (SELECT er.sku, quantile_cont(y - CASE model WHEN 'decaying' THEN decaying WHEN 'corrected' THEN corrected ELSE classic END, 0.1) AS lo, quantile_cont(y - CASE model WHEN 'decaying' THEN decaying WHEN 'corrected' THEN corrected ELSE classic END, 0.9) AS hi FROM er JOIN pk USING (sku) GROUP BY er.sku)"""


@query(with_(LINES, DAILY, FILLED, RATES, key="p_brand") + f"SELECT sku, model, {r('rate')} AS rate, {r('greatest(rate + 1.36 * coalesce(lo, 0), 0)')} AS lower, {r('greatest(rate + 1.36 * coalesce(hi, 0), 0)')} AS upper FROM pk LEFT JOIN sp USING (sku)")
def sparse_forecast(spark, d):
    rows = filled(spark, d, "p_brand")
    return rounded(engines.sparse_forecast(rows, rows.select("sku", F.lit("true_intermittent").alias("subtype")).distinct()), "rate", "lower", "upper")


@query(
    f"WITH {SUPPLIED}, w AS (SELECT sku, supplier % 40 + 1 AS lead, order_id % 4 + 1 AS windows, CASE order_id % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'high' ELSE 'max' END AS tier, sku % 20 + 20 AS coverage FROM po), "
    "m AS (SELECT sku, tier, lead, row_number() OVER (PARTITION BY sku ORDER BY abs(lead - 14), abs(coverage - 30), lead, tier) AS k FROM w WHERE windows >= 4 AND abs(lead - 14) <= 0.25 * 14 AND abs(coverage - 30) <= 0.25 * 30) SELECT sku, tier, lead AS measured_lead FROM m WHERE k = 1"
)
def tier_lookup(spark, d):
    tier = F.when(F.col("order_id") % 3 == 0, "light").when(F.col("order_id") % 3 == 1, "high").otherwise("max")
    measured = _supplied(spark, d).select("sku", (F.col("supplier") % 40 + 1).alias("lead"), (F.col("sku") % 20 + 20).alias("coverage"), tier.alias("tier"), (F.col("order_id") % 4 + 1).alias("windows"))
    asked = measured.select("sku").distinct().withColumns({"lead": F.lit(14), "coverage": F.lit(30)})
    return planning.tier_lookup(measured, asked)


@query(f"WITH {COSTS} SELECT sku, {r('price')} AS old_price, {r('price * (1 + (sku % 5) / 100.0)')} AS price FROM costs WHERE sku % 5 >= 2")
def price_drift(spark, d):
    old = _costs(spark, d).select("sku", "price")
    new = old.withColumn("price", F.col("price") * (1 + F.col("sku") % 5 / 100.0)).where("sku % 5 <> 1")
    return rounded(planning.price_drift(old, new), "old_price", "price")


@query(f"WITH {COSTS} SELECT sku, sku % 3 = 0 AS drifted FROM costs")
def economics_drift(spark, d):
    old = _costs(spark, d).select("sku", "unit_cost", "fees", F.lit(0.25).alias("holding"))
    return planning.economics_drift(old, old.withColumn("fees", F.when(F.col("sku") % 3 == 0, F.lit(None)).otherwise(F.col("fees"))))


@query(f"WITH {COSTS} SELECT sku, {r('CASE WHEN sku % 4 = 0 THEN 9.5 ELSE unit_cost END')} AS unit_cost, CASE WHEN sku % 8 = 0 THEN 1.25::DOUBLE ELSE fees END AS fees FROM costs")
def effective_costs(spark, d):
    sheet = _costs(spark, d).select("sku", "unit_cost", "fees")
    given = sheet.where("sku % 4 = 0").select("sku", F.lit(9.5).alias("unit_cost"), F.when(F.col("sku") % 8 == 0, 1.25).alias("fees"))
    return rounded(planning.effective_costs(sheet, given), "unit_cost")


@query(
    "WITH o AS (SELECT o_custkey AS sku, CAST(o_orderdate AS DATE) AS ds, min(o_orderpriority) AS route FROM orders GROUP BY 1, 2) SELECT sku, ds, route, previous FROM (SELECT *, lag(route) OVER (PARTITION BY sku ORDER BY ds) AS previous FROM o) WHERE previous <> route"
)
def route_switches(spark, d):
    routes = tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sku"), F.to_date("o_orderdate").alias("ds")).agg(F.min("o_orderpriority").alias("route"))
    return planning.route_switches(routes)


@query(
    f"WITH {SUPPLIED}, plans AS (SELECT order_id, max(sku) AS sku, max(qty) AS qty, max(expected) AS expected FROM po WHERE received IS NULL GROUP BY 1), a AS (SELECT * FROM plans WHERE order_id % 3 < 2), b AS (SELECT order_id, sku, qty + 1 AS qty, expected FROM plans WHERE order_id % 3 > 0) "
    "SELECT * FROM a UNION ALL SELECT * FROM b WHERE order_id NOT IN (SELECT order_id FROM a)"
)
def open_orders(spark, d):
    plans = _supplied(spark, d).where("received IS NULL").groupBy("order_id").agg(F.max("sku").alias("sku"), F.max("qty").alias("qty"), F.max("expected").alias("expected"))
    return planning.open_orders(plans.where("order_id % 3 < 2"), plans.where("order_id % 3 > 0").withColumn("qty", F.col("qty") + 1))


@query(
    with_(LINES, DAILY, key="p_brand")
    + """, f AS (SELECT sku, CAST(k AS INTEGER) AS day, avg(y) * (1 + k % 7) / 4 AS yhat FROM daily, (SELECT unnest(range(1, 61)) AS k) GROUP BY sku, k),
s AS (SELECT DISTINCT sku, CAST(substring(sku, 7) AS INTEGER) * 40 AS on_hand, 300 AS on_order, CAST(substring(sku, 7) AS INTEGER) AS eta FROM daily),
u AS (SELECT f.sku, day, sum(greatest(yhat, 0)) OVER (PARTITION BY f.sku ORDER BY day) AS used, on_hand + CASE WHEN day >= eta THEN on_order ELSE 0 END AS have FROM f JOIN s USING (sku))
SELECT sku, min(day) FILTER (used >= have) AS days_to_stockout FROM u GROUP BY sku"""
)
def arrival_cover(spark, d):
    rows = daily(spark, d, "p_brand").groupBy("sku").agg(F.avg("y").alias("m"))
    forecast = rows.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(60)))).select("sku", "day", (F.col("m") * (1 + F.col("day") % 7) / 4).alias("yhat"))
    b = F.substring("sku", 7, 9).cast("int")
    stock = rows.select("sku", (b * 40).alias("on_hand"), F.lit(300).alias("on_order"), b.alias("eta_days"))
    return planning.arrival_cover(forecast, stock)


@query(
    "WITH " + STEPPED
    + """, pr AS (SELECT sku, ds, ds - CAST(row_number() OVER (PARTITION BY sku ORDER BY ds) AS INTEGER) AS run FROM stepped WHERE on_promotion >= 1), c AS (SELECT sku, ds, price, lag(price) OVER (PARTITION BY sku ORDER BY ds) AS b FROM stepped WHERE price IS NOT NULL)
SELECT sku, 'promotion' AS kind, min(ds) AS start, max(ds) AS "end", NULL::DOUBLE AS price FROM pr GROUP BY sku, run UNION ALL SELECT sku, 'price_change', ds, ds, price FROM c WHERE abs(price - b) > greatest(0.02, 0.005 * greatest(price, b))"""
)
def window_events(spark, d):
    return backtest.window_events(stepped(spark, d))


@query(
    with_(LINES, DAILY, FILLED, key="p_brand")
    + """, h AS (SELECT sku, ds, y, CASE WHEN day(ds) % 9 = 0 THEN CAST(day(ds) % 4 * 6 AS DOUBLE) END AS hours, CASE WHEN day(ds) % 5 = 0 THEN 0 ELSE day(ds) % 3 END AS closing FROM filled),
b AS (SELECT *, lag(closing) OVER (PARTITION BY sku ORDER BY ds) AS before FROM h), k AS (SELECT *, least(greatest(coalesce(CASE WHEN hours IS NULL AND closing <= 0 AND before <= 0 AND y <= 0 THEN 0 ELSE hours END / 24, 1), 0), 1) AS share FROM b),
t AS (SELECT *, CASE WHEN share < 0.1 THEN CASE WHEN y > 0 THEN 'capped' ELSE 'unavailable' END WHEN share < 0.95 THEN 'partial' WHEN closing <= 0 THEN 'capped' ELSE 'normal' END AS kind FROM k)
SELECT sku, ds, round(CASE WHEN kind = 'partial' THEN y * least(3.0, 1 / share) ELSE y END + 1e-9, 3) AS y, kind, CASE kind WHEN 'capped' THEN 0.5 WHEN 'partial' THEN greatest(0.1, share) ELSE 1.0 END AS weight FROM t WHERE kind <> 'unavailable'"""
)
def demand_frame(spark, d):
    day = F.dayofmonth("ds")
    rows = filled(spark, d, "p_brand").select("sku", "ds", "y", F.when(day % 9 == 0, (day % 4 * 6).cast("double")).alias("hours"), F.when(day % 5 == 0, 0).otherwise(day % 3).alias("closing"))
    return rounded(telemetry.demand_frame(rows), "y", digits=3)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

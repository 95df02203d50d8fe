"""Queries on rushes, families, price changes and backtests by engine, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import backtest, bands, demand, families, forecast, holidays, planning, pricestudy, pricing, replay, rush, seasonality, telemetry
from millrace.plans.decisions import ERRORS, PLACED, TESTED, _costed, _errors, _placed, r
from millrace.plans.queries import AGED, DAILY, ELASTICITY_SQL, EVIDENCE_SQL, FILLED, LEVELS, LINES, PRICE_LEVELS_SQL, PROFILE, READINGS, SCORES, SIGNATURES, STEPPED, _residuals, filled, rounded, stepped, with_
from millrace.sources import tables
from millrace.sources.staging import staged
from millrace.streaming import grades

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


PEERS_SQL = """vol AS (SELECT category, sku, ln(sum(units)) AS v FROM lines GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY v, sku) AS place FROM vol),
peers AS (SELECT a.sku, b.sku AS peer FROM placed a JOIN placed b ON a.category = b.category AND a.sku <> b.sku
  QUALIFY row_number() OVER (PARTITION BY a.category, a.sku ORDER BY round(abs(a.v - b.v), 9), abs(a.place - b.place), b.sku) <= 25)"""


def _ratio_sql(ranges: str, keys: str) -> str:
    """(keys, ratio) of ranges (keys, of, f, l) of weeks of product `of`."""
    return f"""SELECT {keys}, CASE WHEN count(rate) FILTER (w BETWEEN f AND l) >= greatest(1, (l - f + 1) // 2) AND count(rate) FILTER (NOT w BETWEEN f - 1 AND l + 1) >= 2
    AND median(rate) FILTER (NOT w BETWEEN f - 1 AND l + 1) > 0 THEN avg(rate) FILTER (w BETWEEN f AND l) / median(rate) FILTER (NOT w BETWEEN f - 1 AND l + 1) END AS ratio
  FROM {ranges} JOIN (SELECT sku AS of, w0 FROM spans) USING (of) JOIN (SELECT sku AS of, w, rate FROM every) USING (of) WHERE f >= w0 AND l <= 0 AND w BETWEEN f - 8 AND l + 9 GROUP BY {keys}, f, l"""


def _past_sql(ranges: str, keys: str) -> str:
    """(keys, past) of ranges (keys, of, f, l)."""
    moved = f"(SELECT {keys}, of, y, f - 52 * y + s AS f, l - 52 * y + s AS l FROM {ranges}, (SELECT unnest(range(1, 4)) AS y), (SELECT unnest(range(-3, 4)) AS s))"
    return f"SELECT {keys}, median(best) AS past FROM (SELECT {keys}, y, max(ratio) AS best FROM ({_ratio_sql(moved, f'{keys}, y')}) GROUP BY {keys}, y) WHERE best IS NOT NULL GROUP BY {keys}"


RUSH_SQL = (
    with_(LINES, DAILY, FILLED, AGED, key="p_brand")
    + f""", plines AS (SELECT sku, substring(sku, 1, 7) AS category, units FROM lines),
{PEERS_SQL.replace("FROM lines", "FROM plines")},
spans AS (SELECT sku, max(ds) AS e, CAST(-(max(age) // 7) AS INTEGER) AS w0 FROM aged GROUP BY sku),
weeks AS (SELECT sku, CAST(-(age // 7) AS INTEGER) AS w, avg(y) AS rate FROM aged GROUP BY 1, 2 HAVING count(*) >= 4),
every AS (SELECT g.sku, g.w, rate FROM (SELECT sku, CAST(unnest(range(w0, 1)) AS INTEGER) AS w FROM spans) g LEFT JOIN weeks USING (sku, w)),
usual AS (SELECT a.sku, a.w, median(b.rate) AS usual FROM weeks a JOIN weeks b ON a.sku = b.sku AND abs(a.w - b.w) BETWEEN 2 AND 13 GROUP BY 1, 2 HAVING count(*) >= 4),
hot AS (SELECT sku, w, w - row_number() OVER (PARTITION BY sku ORDER BY w) AS run FROM weeks JOIN usual USING (sku, w) WHERE usual > 0 AND rate >= 1.5 * usual),
runs AS (SELECT sku, min(w) AS s, max(w) AS e FROM hot GROUP BY sku, run HAVING count(*) >= 2),
based AS (SELECT runs.sku, s, e, median(rate) AS base FROM runs JOIN weeks ON weeks.sku = runs.sku AND (w BETWEEN s - 8 AND s - 2 OR w BETWEEN e + 2 AND e + 9) GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND median(rate) > 0),
wide AS (SELECT b.sku, s, e, base, coalesce(max(w) FILTER (w < s AND coalesce(rate < 1.2 * base, true)), min(w0) - 1) + 1 AS f, coalesce(min(w) FILTER (w > e AND coalesce(rate < 1.2 * base, true)), 1) - 1 AS l
  FROM based b JOIN every USING (sku) JOIN (SELECT sku, w0 FROM spans) USING (sku) GROUP BY 1, 2, 3, 4),
cand AS (SELECT wide.sku, s, f, l, base, 7 * base * count(rate) FILTER (w BETWEEN f AND l) AS expected, 7 * sum(rate) FILTER (w BETWEEN f AND l) AS got FROM wide JOIN every USING (sku) WHERE l - f + 1 <= 10 GROUP BY 1, 2, 3, 4, 5
  HAVING count(*) FILTER (w BETWEEN l + 1 AND l + 2 AND rate < 1.2 * base) = 2 AND count(rate) FILTER (w BETWEEN f - 8 AND f - 1) >= 2),
beyond AS (SELECT *, got / greatest(expected, 1e-9) AS ratio FROM cand WHERE got - expected >= 3 * sqrt(2 * greatest(expected, 1))),
asked AS (SELECT DISTINCT sku, sku AS of, f, l, f AS kf, l AS kl FROM beyond),
own AS ({_past_sql('asked', 'sku, kf, kl')}),
unsure AS (SELECT a.sku, peer, peer AS of, f, l, kf, kl FROM asked a LEFT JOIN own USING (sku, kf, kl) JOIN peers USING (sku) WHERE past IS NULL),
p_now AS ({_ratio_sql('unsure', 'sku, kf, kl, peer')}), p_past AS ({_past_sql('unsure', 'sku, kf, kl, peer')}),
told AS (SELECT sku, kf, kl, median(ratio) AS now, median(past) AS past FROM p_now JOIN p_past USING (sku, kf, kl, peer) WHERE ratio IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
judged AS (SELECT b.*, own.past IS NOT NULL AS is_own, coalesce(own.past, CASE WHEN told.past < 1.3 AND now >= 1.3 THEN 1.0 END) AS past FROM beyond b LEFT JOIN own ON own.sku = b.sku AND own.kf = b.f AND own.kl = b.l LEFT JOIN told ON told.sku = b.sku AND told.kf = b.f AND told.kl = b.l),
found AS (SELECT sku, s, f, l, base, ratio, got, expected, CASE WHEN past < 1.3 THEN 1.0 ELSE past END AS past, is_own FROM judged WHERE past IS NOT NULL AND ratio >= 2.0 * greatest(past, 1.0)),
factors AS (SELECT found.sku, CAST(spans.e + 7 * w - 6 AS DATE) AS start, CAST(spans.e + 7 * w AS DATE) AS "end", greatest(rate / (base * past), 1.0) AS factor FROM found JOIN every ON every.sku = found.sku AND w BETWEEN f AND l AND rate IS NOT NULL JOIN spans ON spans.sku = found.sku)"""
)


def _rushes(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.sales_lines(spark, d, "p_brand")
    peers = demand.nearest_peers(lines.withColumn("category", F.substring("sku", 1, 7)))
    return rush.find(filled(spark, d, "p_brand"), peers)


@query(RUSH_SQL + f"""SELECT sku, CAST(spans.e + 7 * f - 6 AS DATE) AS start, CAST(spans.e + 7 * l AS DATE) AS "end", l - f + 1 AS weeks, {r('ratio')} AS ratio, {r('past')} AS past, CASE WHEN is_own THEN 'own' ELSE 'similar products' END AS source, {r('got - expected * past', 2)} AS units FROM found JOIN spans USING (sku)""")
def rush_finder(spark, d):
    """One-off rushes of the brands, peers being the brands of one maker."""
    return rounded(rounded(_rushes(spark, d).select("sku", "start", "end", "weeks", "ratio", "past", "source", "units"), "ratio", "past"), "units", digits=2)


@query(
    RUSH_SQL
    + f""", shares AS (SELECT f.sku, f.ds, max(factor) AS factor FROM filled f JOIN factors x ON x.sku = f.sku AND f.ds BETWEEN x.start AND x."end" GROUP BY 1, 2)
SELECT sku, ds, {r('y / coalesce(factor, 1.0)')} AS y FROM filled LEFT JOIN shares USING (sku, ds)"""
)
def rush_deflated(spark, d):
    """Daily units with the rushes divided out."""
    return rounded(seasonality.rush_deflate(filled(spark, d, "p_brand").select("sku", "ds", "y"), rush.factors(_rushes(spark, d))), "y")


#: Variants: a brand's parts of one type; their family is the maker.
VARIANT = "p_brand || '/' || p_type"


def _cohesion_sql(mem: str, sig: str) -> str:
    """(grp, members, cohesion) over all pairs of members (grp, sku) with a signature."""
    return f"""SELECT n.grp, n.members, CASE WHEN n.members > 1 THEN 2 * coalesce(t.s, 0) / (n.members * (n.members - 1)) ELSE 0 END AS cohesion
  FROM (SELECT grp, count(*) AS members FROM {mem} WHERE sku IN (SELECT sku FROM {sig}) GROUP BY grp) n LEFT JOIN (SELECT grp, sum(CASE WHEN months < 5 OR slots < 3 THEN 0 WHEN fa AND fb THEN 1 WHEN fa OR fb THEN 0 ELSE coalesce(r, 0) END) AS s FROM (
    SELECT x.grp, a.sku AS a, b.sku AS b, corr(a.value, b.value) AS r, count(*) FILTER (a.slot > 7) AS months, count(*) AS slots, stddev_pop(a.value) < 1e-9 AS fa, stddev_pop(b.value) < 1e-9 AS fb
    FROM {mem} x JOIN {mem} y ON x.grp = y.grp AND x.sku < y.sku JOIN {sig} a ON a.sku = x.sku JOIN {sig} b ON b.sku = y.sku AND b.slot = a.slot GROUP BY 1, 2, 3) GROUP BY grp) t USING (grp)"""


FAMILIES_SQL = (
    with_(LINES, DAILY, FILLED, SIGNATURES, key=VARIANT)
    + """, dist AS (SELECT sku, slot, value - avg(value) OVER (PARTITION BY slot) AS value FROM sig),
parts AS (SELECT DISTINCT p_brand || '/' || p_type AS sku, substring(p_brand, 1, 7) AS base, p_brand AS brand, p_type AS type FROM part),
spans AS (SELECT sku, count(*) AS days FROM filled GROUP BY sku),
usable AS (SELECT parts.* FROM parts JOIN spans USING (sku) WHERE days >= 180 AND sku IN (SELECT sku FROM sig))"""
)


def _variants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products (sku, base, days), attributes (sku, name, value), and signatures."""
    rows = filled(spark, d, VARIANT)
    named = tables.table(spark, d, "part").select(F.expr(VARIANT).alias("sku"), F.substring("p_brand", 1, 7).alias("base"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).distinct()
    products = named.select("sku", "base").join(rows.groupBy("sku").agg(F.count("*").alias("days")), "sku", "left")
    return products, named.unpivot("sku", ["brand", "type"], "name", "value"), staged(seasonality.signature(rows))


@query(
    FAMILIES_SQL
    + f""", mem AS (SELECT base AS grp, sku FROM usable), c AS ({_cohesion_sql('mem', 'sig')}), x AS ({_cohesion_sql('mem', 'dist')})
SELECT grp AS "group", c.members, {r('c.cohesion')} AS cohesion, {r('x.cohesion')} AS distinctive FROM c JOIN x USING (grp)"""
)
def family_cohesion(spark, d):
    """How alike the variants of each maker sell, raw and beyond the rhythm that all share."""
    products, _, signatures = _variants(spark, d)
    members = products.where("days >= 180").select(F.col("base").alias("group"), "sku")
    own = families.cohesion(members, families.distinctive(signatures)).select("group", F.col("cohesion").alias("distinctive"))
    return rounded(families.cohesion(members, signatures).join(own, "group"), "cohesion", "distinctive")


@query(
    FAMILIES_SQL
    + f""", combos AS (SELECT sku, base, base || ' | type:' || type AS grp, 1 AS rank, 1 AS depth, [base] AS above FROM parts UNION ALL SELECT sku, base, base || ' | brand:' || brand, 10, 1, [base] FROM parts
  UNION ALL SELECT sku, base, base || ' | type:' || type || ' | brand:' || brand, 1, 2, [base, base || ' | type:' || type, base || ' | brand:' || brand] FROM parts),
mem AS (SELECT grp, sku FROM combos JOIN usable USING (sku) UNION ALL SELECT base, sku FROM usable), c AS ({_cohesion_sql('mem', 'sig')}), x AS ({_cohesion_sql('mem', 'dist')}),
defs AS (SELECT DISTINCT grp, base, rank, depth, above FROM combos),
par AS (SELECT g.grp, max(c.cohesion) AS above FROM (SELECT grp, base, unnest(above) AS p FROM defs) g JOIN c ON c.grp = g.p WHERE g.p = g.base OR c.members >= 2 GROUP BY 1),
pass AS (SELECT defs.grp, rank, depth, c.members, c.cohesion, c.cohesion - coalesce(par.above, 0) AS gain FROM defs JOIN c USING (grp) JOIN x USING (grp) LEFT JOIN par USING (grp)
  WHERE c.members >= 2 AND x.cohesion >= 0.35 AND c.cohesion - coalesce(par.above, 0) >= CASE WHEN rank < 10 THEN 0.08 ELSE 0.20 END),
best AS (SELECT sku, pass.* FROM combos JOIN pass USING (grp) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY pass.rank, members DESC, cohesion DESC, gain DESC, pass.depth, grp) = 1)
SELECT p.sku, p.base, coalesce(b.grp, p.base) AS "group", CASE WHEN b.grp IS NULL THEN 'base' ELSE 'subgroup' END AS level, coalesce(b.members, f.members, 0) AS members, {r('coalesce(b.cohesion, f.cohesion, 0)')} AS cohesion, {r('b.gain')} AS gain
FROM parts p LEFT JOIN best b USING (sku) LEFT JOIN c f ON f.grp = p.base"""
)
def adaptive_groups(spark, d):
    """The group of each variant: its maker, or a subgroup by brand and type that behaves more alike."""
    return rounded(families.adaptive_groups(*_variants(spark, d)), "cohesion", "gain")


@query(None)
def family_clusters(spark, d):
    """Variants of a maker that all agree with each other, by complete linkage; held against a table of pairs in its test."""
    products, _, signatures = _variants(spark, d)
    return families.clusters(products.where("days >= 180").select(F.col("base").alias("group"), "sku"), signatures)


@query(None)
def cluster_report(spark, d):
    """Members and cohesion of every cluster."""
    _, _, signatures = _variants(spark, d)
    return rounded(families.cluster_report(staged(family_clusters(spark, d)), signatures), "cohesion", "distinctive")


RESAMPLES = 200
DRAWS = f"""(SELECT *, {' + '.join(f'CAST(u > {p!r} AS INTEGER)' for p in backtest.POISSON)} AS times FROM (SELECT *, CAST('0x' || md5(sku || '|' || rep)[1:8] AS BIGINT) / 4294967296.0 AS u FROM {{rows}}, (SELECT unnest(range(1, {RESAMPLES + 1})) AS rep)))"""


@query(
    with_(LINES, DAILY, FILLED, SCORES)
    + f""", long AS (UNPIVOT (SELECT sku, mase, wape, bias FROM scores) ON mase, wape, bias INTO NAME metric VALUE value),
sums AS (SELECT metric, sku, sum(value) AS s, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
means AS (SELECT metric, rep, sum(s * times) / sum(n * times) AS m FROM {DRAWS.format(rows='sums')} WHERE times > 0 GROUP BY 1, 2),
edges AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY 1)
SELECT metric, {r('sum(s) / sum(n)')} AS mean, {r('CASE WHEN count(*) >= 2 THEN any_value(lo) END')} AS lo, {r('CASE WHEN count(*) >= 2 THEN any_value(hi) END')} AS hi FROM sums JOIN edges USING (metric) GROUP BY metric"""
)
def accuracy_interval(spark, d):
    """95% intervals of mean accuracy over resamples of products."""
    return rounded(backtest.intervals(backtest.score(filled(spark, d)), ("mase", "wape", "bias"), RESAMPLES), "mean", "lo", "hi")


@query(
    with_(LINES, DAILY, FILLED, SCORES, TESTED)
    + f""", p AS (SELECT tier, sku, avg(cost) AS cost FROM costed GROUP BY 1, 2), totals AS (SELECT rep, tier, sum(cost * times) AS total FROM {DRAWS.format(rows='p')} WHERE times > 0 GROUP BY 1, 2),
firsts AS (SELECT *, lead(total) OVER w AS nxt FROM totals WINDOW w AS (PARTITION BY rep ORDER BY round(total, 6), tier) QUALIFY row_number() OVER w = 1),
chances AS (SELECT tier, 100.0 * count(firsts.rep) / (SELECT count(*) FROM firsts) AS p FROM (SELECT DISTINCT tier FROM p) LEFT JOIN firsts USING (tier) GROUP BY tier),
marked AS (SELECT *, row_number() OVER (ORDER BY p DESC, tier) AS place, lead(p) OVER (ORDER BY p DESC, tier) AS second FROM chances)
SELECT tier, {r('p')} AS p_cheapest, place = 1 AS winner, coalesce(place = 1 AND p >= 2 * second AND p >= 50, false) AS decisive, {r('(SELECT median(CASE WHEN nxt > 0 THEN 100 * (nxt - total) / nxt END) FROM firsts)')} AS median_margin FROM marked"""
)
def tier_ranking(spark, d):
    """How often each service level is the cheapest over resamples of products."""
    return rounded(backtest.tier_ranking(_costed(spark, d), RESAMPLES), "p_cheapest", "median_margin")


#: Lead times and the days that an order covers, as backtests are scored.
COMBOS = ((14, 30), (28, 30))


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    rows = filled(spark, d, "p_brand").select("sku", "ds", "y")
    keys = rows.select("sku", F.substring("sku", 1, 7).alias("category")).distinct()
    return replay.run(rows, keys, COMBOS)


@query(None)
def backtest_engines(spark, d):
    """Every engine on every window as of its cutoff, and the engine that would have been chosen; held against refits by hand in its tests."""
    return rounded(replay.summary(_replayed(spark, d)), "wape", "mase", "bias", "inside_pct", "service_pct", "order_err")


@query(None)
def engine_intervals(spark, d):
    """95% intervals of service, scaled error and band coverage of the chosen engines, over resamples of products."""
    chosen = _replayed(spark, d).where("routed AND lead = 14")
    return rounded(backtest.intervals(chosen, ("covered", "mase", "inside"), RESAMPLES), "mean", "lo", "hi")


def _relatives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = filled(spark, d, VARIANT)
    products, _, signatures = _variants(spark, d)
    clustered = staged(families.clusters(products.where("days >= 180").select(F.col("base").alias("group"), "sku"), signatures))
    means = rows.groupBy("sku").agg(F.avg("y").alias("mean"))
    return clustered, staged(families.relatives(products.withColumnRenamed("base", "group").join(means, "sku"), clustered, signatures))


@query(None)
def behavioural_relatives(spark, d):
    """The family among its maker's variants that each variant would borrow from; held against a search by hand in its test."""
    return rounded(_relatives(spark, d)[1], "fit")


@query(None)
def donor_list(spark, d):
    """The products that each variant would borrow from."""
    clustered, chosen = _relatives(spark, d)
    return families.donors(chosen, clustered)


STUDY_SQL = (
    "WITH RECURSIVE "
    + STEPPED
    + """, u AS (SELECT sku, ds, y, price, row_number() OVER (PARTITION BY sku ORDER BY ds) AS i FROM stepped WHERE price > 0 AND price_mixed < 1),
scan(sku, i, ds, y, anchor) AS (SELECT sku, i, ds, y, price FROM u WHERE i = 1 UNION ALL SELECT u.sku, u.i, u.ds, u.y, CASE WHEN abs(ln(u.price / s.anchor)) < 0.01 THEN s.anchor ELSE u.price END FROM scan s JOIN u ON u.sku = s.sku AND u.i = s.i + 1),
seg AS (SELECT sku, ds, y, anchor, sum(t) OVER (PARTITION BY sku ORDER BY ds) AS k FROM (SELECT *, CAST(coalesce(lag(anchor) OVER (PARTITION BY sku ORDER BY ds) <> anchor, true) AS INTEGER) AS t FROM scan)),
st AS (SELECT *, row_number() OVER (PARTITION BY sku, k ORDER BY ds) AS place, row_number() OVER (PARTITION BY sku, k ORDER BY ds DESC) AS rest FROM seg),
wmean AS (SELECT sku, avg(y) AS mean, count(*) AS n FROM u GROUP BY sku),
wday AS (SELECT sku, g.wd, CASE WHEN o.n >= 4 AND m.n >= 28 AND mean > 0 THEN 1 + (o.m / mean - 1) * units / (units + 20) ELSE 1 END AS raw FROM wmean m CROSS JOIN (SELECT unnest(range(0, 7)) AS wd) g
  LEFT JOIN (SELECT sku, dayofweek(ds) AS wd, avg(y) AS m, sum(y) AS units, count(*) AS n FROM u GROUP BY 1, 2) o USING (sku, wd)),
ww AS (SELECT sku, wd, raw / avg(raw) OVER (PARTITION BY sku) AS weight FROM wday),
sd AS (SELECT sku, k + 1 AS k, ds, y, anchor, 0 AS side FROM st WHERE rest <= 91 UNION ALL SELECT sku, k, ds, y, anchor, 1 FROM st WHERE place <= 91),
sums AS (SELECT sku, k, side, min(ds) AS a, max(ds) AS b, count(*) AS n, sum(y) AS y, sum(weight) AS w, min(anchor) AS p FROM sd JOIN ww USING (sku) WHERE wd = dayofweek(ds) GROUP BY 1, 2, 3 HAVING count(*) >= 7),
ch AS (SELECT s.sku, s.k, s.p AS p0, t.p AS p1, ln(t.p / s.p) AS step, s.a AS first, t.b AS last, s.n AS n0, t.n AS n1, s.y AS y0, s.y / s.w * t.w AS expected, t.y AS y1 FROM sums s JOIN sums t ON s.sku = t.sku AND s.k = t.k AND s.side = 0 AND t.side = 1 WHERE abs(ln(t.p / s.p)) >= 0.05 AND s.y > 0),
ends AS (SELECT sku AS peer, min(ds) AS since, max(ds) AS until FROM stepped GROUP BY 1),
pr AS (SELECT ch.sku, ch.k, peer, substring(peer, 1, 7) = substring(ch.sku, 1, 7) AS preferred, min(q.price) FILTER (q.price > 0) AS lo, max(q.price) FILTER (q.price > 0) AS hi, coalesce(sum(q.y) FILTER (side = 0), 0) AS c0, coalesce(sum(q.y) FILTER (side = 1), 0) AS c1, any_value(n0) AS n0, any_value(n1) AS n1
  FROM ch JOIN ends ON peer <> ch.sku AND since <= first AND until >= last JOIN stepped q ON q.sku = peer AND q.ds BETWEEN first AND last LEFT JOIN sd ON sd.sku = ch.sku AND sd.k = ch.k AND sd.ds = q.ds GROUP BY 1, 2, 3, 4),
yard AS (SELECT sku, k, CASE WHEN count(*) FILTER (preferred) >= 3 THEN median(x) FILTER (preferred) WHEN count(*) >= 3 THEN median(x) END AS moved FROM (SELECT *, ln((c1 / n1) / (c0 / n0)) AS x FROM pr WHERE hi / lo < 1.01 AND c0 >= 5 AND c1 >= 5) GROUP BY 1, 2),
est AS (SELECT ch.*, (ln((y1 + 0.5) / (expected + 0.5)) - coalesce(moved, 0)) / step AS e, step * step / (2.0 * (1 / greatest(y0, 1) + 1 / greatest(expected, 1))) AS w FROM ch LEFT JOIN yard USING (sku, k)),
study AS (SELECT sku, sum(w * e) / sum(w) AS elasticity, 1 / sqrt(sum(w)) AS se, count(*) AS changes, min(least(p0, p1)) AS lo, max(greatest(p0, p1)) AS hi FROM est GROUP BY sku)"""
)


def _study(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Brands at listed prices, and the reading of their price changes beside the other brands, those of the same maker first."""
    rows = staged(stepped(spark, d))
    volume = rows.select("sku", F.col("y").alias("units"))
    near = demand.nearest_peers(volume.withColumn("category", F.substring("sku", 1, 7))).select("sku", "peer", F.lit(True).alias("preferred"))
    every = demand.nearest_peers(volume.withColumn("category", F.lit("store")), 40).select("sku", "peer", F.lit(False).alias("preferred"))
    return rows, pricestudy.before_after(rows, near.unionByName(every))


@query(STUDY_SQL + f" SELECT sku, {r('elasticity')} AS elasticity, {r('se')} AS se, changes, lo, hi FROM study")
def price_study(spark, d):
    """Elasticity at each brand's own price changes."""
    return rounded(_study(spark, d)[1], "elasticity", "se")


@query(
    STUDY_SQL
    + f""", {ELASTICITY_SQL}, both_r AS (SELECT coalesce(e.sku, s.sku) AS sku, basis, CASE WHEN basis = 'measured' AND e.elasticity < 0 THEN e.elasticity END AS a, se <= 1.5 AND s.elasticity >= -4 AS clear, s.elasticity AS x FROM elasticities e FULL JOIN study s ON s.sku = e.sku),
rd AS (SELECT *, CASE WHEN clear AND x < 0 THEN x END AS b FROM both_r)
SELECT sku, {r('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) <= 0.75 THEN (a + b) / 2 END ELSE coalesce(a, b) END', 3)} AS elasticity,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) <= 0.75 THEN 'both' ELSE 'readings-disagree' END WHEN a IS NOT NULL THEN 'same-months' WHEN b IS NOT NULL THEN 'before-after' WHEN clear AND x >= 0 THEN 'positive-elasticity-ignored' ELSE basis END AS basis,
  {r('a')} AS same_months, {r('b')} AS before_after FROM rd"""
)
def price_reading(spark, d):
    """Each brand's price response, read two ways and cross-checked."""
    rows, study = _study(spark, d)
    return rounded(pricestudy.reading(pricing.elasticity(rows), study), "same_months", "before_after")


#: Products in stock by their last reading, what they sell a day, and every order of theirs that has not come, by days from the last reading of all.
COVER_SQL = (
    with_(READINGS, PLACED)
    + """, now AS (SELECT CAST(max(ts) AS DATE) AS today FROM readings), onhand AS (SELECT sku, arg_max(on_hand, ts) AS on_hand FROM readings GROUP BY sku),
rates AS (SELECT user_id AS sku, count(*) / 30.0 AS yhat FROM events WHERE event_type = 'purchase' GROUP BY 1),
landed AS (SELECT sku, greatest(coalesce(date_diff('day', today, expected), 1), 1) AS day, CAST(sum(qty) AS DOUBLE) AS arrived FROM placed, now GROUP BY 1, 2),
days AS (SELECT r.sku, CAST(k AS INTEGER) AS day, yhat AS demand, coalesce(arrived, 0) AS arrived, on_hand FROM rates r JOIN onhand USING (sku) CROSS JOIN (SELECT unnest(range(1, 91)) AS k) LEFT JOIN landed ON landed.sku = r.sku AND landed.day = k),
bal AS (SELECT *, on_hand + sum(arrived - demand) OVER (PARTITION BY sku ORDER BY day) AS balance FROM days),
owe AS (SELECT *, least(min(balance) OVER (PARTITION BY sku ORDER BY day), 0) AS owed FROM bal),
path AS (SELECT *, balance - owed AS level, coalesce(lag(owed) OVER (PARTITION BY sku ORDER BY day), 0) - owed AS lost FROM owe)"""
)


def _path(spark: SparkSession, d: str) -> DataFrame:
    readings = tables.stock_readings(spark, d)
    today = readings.agg(F.to_date(F.max("ts")).alias("today"))
    rates = tables.table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("sku")).agg((F.count("*") / 30.0).alias("yhat"))
    forecast = rates.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(90))))
    coming = _placed(spark, d).join(F.broadcast(today)).select("sku", F.datediff("expected", "today").alias("eta_days"), "qty")
    return planning.cover_path(forecast, telemetry.latest(readings), coming)


@query(COVER_SQL + f"SELECT sku, day, {r('demand')} AS demand, arrived, {r('level', 3)} AS level, {r('lost', 3)} AS lost FROM path")
def cover_path(spark, d):
    """Stock over the coming 90 days with all open orders."""
    return rounded(rounded(_path(spark, d), "demand"), "level", "lost", digits=3)


@query(
    COVER_SQL
    + f""", marked AS (SELECT *, min(day) FILTER (level <= 1e-9) OVER (PARTITION BY sku) AS gone FROM path)
SELECT sku, min(gone) AS days_to_stockout, min(day) FILTER (day > gone AND level > 1e-9) AS back_on, count(*) FILTER (level <= 1e-9) AS days_out, {r('sum(lost)', 3)} AS units_lost, arg_min(day, {{'a': level, 'b': day}}) AS lowest_day, min(day) FILTER (arrived > 0) AS next_arrival
FROM marked GROUP BY sku"""
)
def cover_report(spark, d):
    """When stock runs out, returns, and what is lost meanwhile."""
    return rounded(planning.cover_report(_path(spark, d)), "units_lost", digits=3)


@query("WITH RECURSIVE " + STEPPED + ",\n" + PRICE_LEVELS_SQL + ",\n" + EVIDENCE_SQL + """, lq AS (SELECT sku, count(*) AS n, bool_and(quality = 'reliable') AS rel FROM (SELECT *, CASE WHEN days >= 90 THEN 'reliable' ELSE 'other' END AS quality FROM lv) GROUP BY sku)
SELECT sku, last_price IS NOT NULL AND coalesce(n, 0) > 1 AS varied, last_price IS NOT NULL AND coalesce(n > 1 AND rel, false) AS well_sampled, last_price, CASE WHEN last_price IS NULL THEN 'no_column' WHEN coalesce(n, 0) <= 1 THEN 'never_changed' WHEN NOT rel THEN 'thin_data' END AS warning FROM ev LEFT JOIN lq USING (sku)""")
def price_analysis(spark, d):
    rows = staged(stepped(spark, d))
    levels = pricing.price_levels(rows)
    return pricing.price_analysis(levels, pricing.price_evidence(rows, levels))


@query(
    "WITH RECURSIVE " + STEPPED + ",\n" + PRICE_LEVELS_SQL
    + f""", e AS (SELECT sku, min(price) AS p0, max(price) AS p1, arg_min(days, price) AS d0, arg_max(days, price) AS d1 FROM lv GROUP BY sku), k AS (SELECT sku, avg(price) AS mean, stddev_samp(price) AS sd, count(*) AS n, stddev_samp(y) AS sigma FROM stepped GROUP BY sku),
m AS (SELECT *, least(CASE WHEN p1 > p0 THEN 0.25 * (p1 - p0) ELSE 0.1 * mean END, 0.1 * mean) AS most, CASE WHEN sd > 0 AND sigma > 0 THEN sd * sqrt(n) ELSE 1e18 END AS noise FROM e JOIN k USING (sku))
SELECT sku, {r('greatest(p0 - least(most * least(d0 / 90.0, 1), noise), 0)', 2)} AS lo, {r('p1 + least(most * least(d1 / 90.0, 1), noise)', 2)} AS hi FROM m"""
)
def safe_price_range(spark, d):
    """How far each brand's price may leave the known ones."""
    rows = staged(stepped(spark, d))
    return pricing.safe_range(rows, pricing.price_levels(rows), rows.groupBy("sku").agg(F.stddev_samp("y").alias("sigma")))


SPANS = (7, 14, 30)


@query(
    with_(LINES, DAILY, FILLED, AGED, PROFILE, LEVELS, ERRORS)
    + f""", off AS (SELECT sku, quantile_cont(err, 0.1) AS lo, quantile_cont(err, 0.9) AS hi FROM resid GROUP BY sku), fin AS (SELECT max(ds) AS e FROM filled),
fc AS (SELECT l.sku, CAST(fin.e + CAST(k AS INTEGER) AS DATE) AS ds, level * profile AS yhat, greatest(level * profile + lo, 0) AS lower, level * profile + hi AS upper FROM levels l JOIN off USING (sku), fin, (SELECT unnest(range(1, 46)) AS k), profile p
  WHERE p.sku = l.sku AND p.weekday = dayofweek(CAST(fin.e + CAST(k AS INTEGER) AS DATE)) + 1),
sp AS (SELECT sku, CAST(e + 1 AS DATE) AS first, CAST(e + CAST(n AS INTEGER) AS DATE) AS last FROM (SELECT DISTINCT sku FROM fc), fin, (SELECT unnest([{', '.join(map(str, SPANS))}]) AS n) UNION ALL SELECT sku, min(ds), max(ds) FROM fc GROUP BY sku, date_trunc('month', ds)),
""" + ",\n".join(f"""b{n} AS (SELECT sku, win, ds, sum(err) OVER w AS s, count(*) OVER w AS n, count(*) OVER (PARTITION BY sku, win) AS len FROM er WINDOW w AS (PARTITION BY sku, win ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
v{n} AS (SELECT sku, var_samp(s) AS vk FROM b{n} WHERE n = {n} AND len >= {n + 5} GROUP BY sku)""" for n in SPANS) + f""",
o AS (SELECT sku, var_samp(err) AS s2 FROM er GROUP BY sku),
rho AS ({' UNION ALL '.join(f'SELECT sku, {n} AS n, coalesce(least(greatest((vk / ({n} * s2) - 1) / {n - 1}, 0), 1), 0) AS rho FROM o LEFT JOIN v{n} USING (sku)' for n in SPANS)}),
mm AS (SELECT sku, win, avg(err) AS m, count(*) AS len FROM er GROUP BY 1, 2 HAVING count(*) >= 7), lev AS (SELECT sku, sqrt(greatest(avg(m * m) - any_value(s2) / avg(len), 0)) AS level_sd FROM mm JOIN o USING (sku) GROUP BY sku),
ref AS (SELECT sku, avg(y) AS ref_mean FROM aged WHERE age < 225 GROUP BY sku),
t AS (SELECT sp.sku, first, last, count(*) AS n, sum(yhat) AS point, sum(pow(greatest(yhat - lower, 0), 2)) AS lo2, sum(greatest(yhat - lower, 0)) AS lo1, sum(pow(greatest(upper - yhat, 0), 2)) AS hi2, sum(greatest(upper - yhat, 0)) AS hi1 FROM sp JOIN fc ON fc.sku = sp.sku AND ds BETWEEN first AND last GROUP BY 1, 2, 3),
zz AS (SELECT t.*, coalesce(rho, 0) AS rho, 1.2816 * t.n * coalesce(level_sd, 0) * CASE WHEN ref_mean > 0 AND point > 0 THEN least(greatest(point / t.n / ref_mean, 0.25), 4) ELSE 1 END AS lvl FROM t LEFT JOIN rho ON rho.sku = t.sku AND rho.n = t.n LEFT JOIN lev ON lev.sku = t.sku LEFT JOIN ref ON ref.sku = t.sku)
SELECT sku, first, last, n AS days, {r('point', 3)} AS point, {r('greatest(point - sqrt(greatest(lo2 + rho * (lo1 * lo1 - lo2), 0) + lvl * lvl), 0)', 3)} AS lo, {r('point + sqrt(greatest(hi2 + rho * (hi1 * hi1 - hi2), 0) + lvl * lvl)', 3)} AS hi FROM zz"""
)
def horizon_totals(spark, d):
    """Units of the next week, fortnight, 30 days and calendar months, with bands for the totals."""
    rows = filled(spark, d)
    end = F.broadcast(rows.agg(F.max("ds").alias("end")))
    levels = forecast.recent_level(rows).join(forecast.conformal_offsets(_residuals(rows)), "sku").join(end)
    days = levels.withColumn("ds", F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", 45)))).withColumn("weekday", F.dayofweek("ds")).join(forecast.weekday_profile(rows), ["sku", "weekday"])
    yhat = F.col("level") * F.col("profile")
    days = staged(days.select("sku", "ds", "end", yhat.alias("yhat"), F.greatest(yhat + F.col("lower"), F.lit(0.0)).alias("lower"), (yhat + F.col("upper")).alias("upper")))
    ahead = days.select("sku", "end").distinct().withColumn("n", F.explode(F.array(*map(F.lit, SPANS)))).select("sku", F.date_add("end", 1).alias("first"), F.expr("date_add(end, n)").alias("last"))
    errors = staged(_errors(spark, d))
    reference = forecast.aged(rows).where("age < 225").groupBy("sku").agg(F.avg("y").alias("ref_mean"))
    stats = bands.level_error(errors).join(reference, "sku", "full_outer")
    found = bands.horizon_totals(days.drop("end"), ahead.unionByName(bands.month_spans(days)), bands.rho_by_length(errors, list(SPANS)), stats)
    return rounded(found, "point", "lo", "hi", digits=3)


def _holidays(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brands' days, the days of all holidays of their years, and what each holiday does to each brand."""
    rows = filled(spark, d, "p_brand")
    rows = staged(rows.select("sku", "ds", "y", (2 * F.col("promo_units") > F.col("y")).cast("int").alias("on_promotion")))
    first, last = rows.agg(F.year(F.min("ds")), F.year(F.max("ds"))).first()
    days = staged(holidays.assigned(spark, first, last + 1))
    return rows, days, holidays.shape(rows, days, _makers(rows))


def _makers(rows: DataFrame) -> DataFrame:
    return rows.select("sku", F.substring("sku", 1, 7).alias("category")).distinct()


@query(None)
def holiday_levels(spark, d):
    """Sales over the usual on every day around a holiday, own and of the maker's brands; held against the rule by hand in its test."""
    return rounded(_holidays(spark, d)[2], "level", "z")


@query(None)
def holiday_significance(spark, d):
    """Holidays that stand clearly apart from a typical day of their stretch."""
    return rounded(holidays.significant(_holidays(spark, d)[2]), "high", "low")


@query(None)
def holiday_forecast(spark, d):
    """The coming 120 days at the recent level and weekday profile, split anew within holidays; totals of a stretch stay."""
    rows, days, found = _holidays(spark, d)
    profile = forecast.weekday_profile(rows)
    ahead = forecast.recent_level(rows).join(F.broadcast(rows.agg(F.max("ds").alias("end")))).withColumn("ds", F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", 120)))).withColumn("weekday", F.dayofweek("ds"))
    plain = ahead.join(profile, ["sku", "weekday"]).select("sku", "ds", (F.col("level") * F.col("profile")).alias("yhat"))
    by_monday = profile.select("sku", ((F.col("weekday") + 5) % 7).alias("weekday"), "profile")
    return rounded(holidays.redistribute(plain, days, found, by_monday), "yhat")


@query(
    """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS sku, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS origin, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.sku, CAST(e.origin + 7 AS DATE) AS origin, CAST(e.n AS DOUBLE) AS predicted, CAST(e.n AS DOUBLE) AS original, CAST(e.n AS DOUBLE) / 2 AS lo, CAST(e.n * 1.5 AS DOUBLE) AS hi, CAST(coalesce(a.n, 0) AS DOUBLE) AS actual, 7 AS days_counted, false AS revised FROM b e LEFT JOIN b a ON a.sku = e.sku AND a.origin = e.origin + 7"""
)
def graded_weeks(spark, d):
    """Weeks sealed at the week before's purchases and graded, by the batch form of the stream."""
    bought = tables.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("sku"), "ts", F.lit(1.0).alias("value"))
    before = bought.groupBy("sku", grades.period_origin(F.to_date("ts")).alias("w")).agg(F.sum("value").alias("n"))
    origin = F.date_add("w", 7)
    sealed = before.select("sku", origin.cast("timestamp").alias("ts"), origin.alias("origin"), F.col("n").alias("predicted"), (F.col("n") / 2).alias("lo"), (F.col("n") * 1.5).alias("hi"), F.array_repeat(F.col("n") / 7, 7).alias("daily"))
    return grades.graded_batch(grades.messages(sealed, bought))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

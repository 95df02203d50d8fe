"""Small rules that no query of their own runs: calendars, scores, stored results, prices, counts, sheets and sinks."""

from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import backtest, bands, bundles, calendar, demand, engines, holidays, livelog, planning, pricing, seasonality, telemetry
from millrace.plans import decisions
from millrace.plans import queries as plans
from millrace.sources import ingest
from millrace.streaming import events as stream

DAY = date(2024, 3, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_days_move_and_move_back(spark):
    rows = frame(spark, [("a", DAY, 1.0), ("a", DAY + timedelta(days=5), 2.0), ("b", DAY + timedelta(days=2), 3.0)], "sku string, ds date, y double")
    moved = calendar.reanchored(rows, F.lit(date(2025, 1, 10)))
    assert moved.agg(F.max("ds")).first()[0] == date(2025, 1, 10) and {r["shift"] for r in moved.collect()} == {(date(2025, 1, 10) - DAY).days - 5}
    assert sorted(map(tuple, calendar.true_days(moved).select("sku", "ds", "y").collect())) == sorted(map(tuple, rows.collect()))


def test_closed_days_ahead_sell_nothing(spark):
    ahead = frame(spark, [("a", DAY + timedelta(days=k), 5.0, 3.0, 7.0) for k in range(3)], "sku string, ds date, yhat double, lower double, upper double")
    closed = frame(spark, [(DAY + timedelta(days=1),), (DAY + timedelta(days=1),)], "ds date")
    got = [(r["yhat"], r["lower"], r["upper"]) for r in calendar.zero_closed_days(ahead, closed, "yhat", "lower", "upper").orderBy("ds").collect()]
    assert got == [(5.0, 3.0, 7.0), (0.0, 0.0, 0.0), (5.0, 3.0, 7.0)]


def test_only_days_with_something_to_sell_are_scored(spark):
    days = frame(spark, [("s", DAY + timedelta(days=i), y, h, c) for i, (y, h, c) in enumerate([(5.0, None, None), (0.0, 0.0, None), (4.0, 3.0, 0)])], "sku string, ds date, y double, hours double, closing int")
    assert [r["ds"].day for r in calendar.scoreable_days(telemetry.demand_estimate(days)).orderBy("ds").collect()] == [1, 3]


def test_a_forecast_from_a_day_on(spark):
    rows = frame(spark, [("a", DAY + timedelta(days=k)) for k in range(4)] + [("ended", DAY - timedelta(days=k)) for k in (9, 8)], "sku string, ds date")
    got = calendar.from_day(rows, F.lit(DAY + timedelta(days=2))).groupBy("sku").count().collect()
    assert {r["sku"]: r["count"] for r in got} == {"a": 2, "ended": 2}


def test_stored_backtests(spark):
    assert backtest.effective_horizon(44, [(14, 30), (40, 20)]) == 60 and backtest.effective_horizon(44, []) == 44
    windows = frame(spark, [("a", 10.0, 100.0), ("a", 30.0, 100.0), ("b", 5.0, 50.0), ("c", 9.0, 10.0)], "sku string, abs_err double, sum_y double")
    got = {r["source"]: (r["products"], r["windows"], r["wape"]) for r in backtest.by_source(windows, frame(spark, [("a", "x.csv"), ("b", "x.csv")], "sku string, source string")).collect()}
    assert got == {"x.csv": (2, 3, pytest.approx(18.0)), "(unknown file)": (1, 1, pytest.approx(90.0))}
    old = frame(spark, [("a", 14, 30, 1.0), ("a", 28, 30, 2.0), ("b", 14, 30, 3.0)], "sku string, lead int, coverage int, mase double")
    new = frame(spark, [("a", 14, 30, 9.0), ("a", 14, 30, 8.0)], "sku string, lead int, coverage int, mase double")
    assert sorted(r["mase"] for r in backtest.merge_rows(old, new).collect()) == [2.0, 3.0, 8.0, 9.0]
    tested = frame(spark, [("a", 7), ("a", 6), ("a", 20), ("b", 3)], "sku string, n int")
    assert {r["sku"]: r["windows"] for r in backtest.testable_windows(tested, 14).collect()} == {"a": 2, "b": 0}
    stored = frame(spark, [("a", DAY, 120.0, 100.0, 10.0), ("a", DAY + timedelta(days=9), 100.0, 100.0, 10.0)], "sku string, cutoff date, actual double, forecast double, basis double")
    at = lambda price: {r["tier"]: r for r in backtest.recost(stored, frame(spark, [("a", price, 5.0, 0.0)], "sku string, price double, unit_cost double, fees double")).collect()}
    cheap, dear = at(6.0), at(60.0)
    assert set(cheap) == {k for k, _, _ in rules.TIERS} and all(cheap[k]["service"] == dear[k]["service"] for k in cheap)
    short = [k for k in cheap if cheap[k]["shortage"] > 0]
    assert short and all(dear[k]["cost"] > cheap[k]["cost"] for k in short)


def test_units_of_closed_windows(spark):
    daily = frame(spark, [("a", DAY + timedelta(days=k), float(k)) for k in range(5)], "sku string, ds date, y double")
    windows = frame(spark, [("a", DAY, DAY + timedelta(days=2)), ("a", DAY + timedelta(days=4), DAY + timedelta(days=9)), ("b", DAY, DAY)], "sku string, start date, end date")
    assert sorted((r["sku"], r["units"]) for r in livelog.window_units(windows, daily).collect()) == [("a", 3.0), ("a", 4.0), ("b", 0.0)]


def test_bands_widen_in_squares(spark):
    days = frame(spark, [("a", DAY, 10.0, 7.0, 14.0), ("a", DAY + timedelta(days=1), 10.0, 7.0, 14.0)], "sku string, ds date, yhat double, lower double, upper double")
    got = bands.widened(days, frame(spark, [("a", DAY, 5.0)], "sku string, ds date, x_sd double")).orderBy("ds").collect()
    e = 5.0 * 1.2816
    assert (got[0]["lower"], got[0]["upper"]) == (pytest.approx(10 - (9 + e * e) ** 0.5), pytest.approx(10 + (16 + e * e) ** 0.5)) and (got[1]["lower"], got[1]["upper"]) == (7.0, 14.0)


def test_a_borrowed_year_moves_a_forecast_by_its_weight(spark):
    ahead = frame(spark, [(s, "c", DAY, 10.0, 8.0, 12.0) for s in ("half", "none")], "sku string, category string, ds date, yhat double, lower double, upper double")
    indices = frame(spark, [("c", "m", m, 1.6 if m == 3 else 0.9) for m in range(1, 13)] + [("c", "w", 0, 1.0)], "category string, kind string, slot int, index double")
    weights = frame(spark, [("half", 0.5), ("none", 0.0)], "sku string, weight double")
    got = {r["sku"]: (r["yhat"], r["lower"], r["upper"]) for r in engines.apply_pooled_year(ahead, indices, weights).collect()}
    assert got == {"half": (pytest.approx(13.0), pytest.approx(10.4), pytest.approx(15.6)), "none": (10.0, 8.0, 12.0)}


def test_multipliers_scale_their_days(spark):
    ahead = frame(spark, [("a", DAY + timedelta(days=k), 10.0, 12.0) for k in range(2)], "sku string, ds date, yhat double, upper double")
    got = pricing.apply_multipliers(ahead, frame(spark, [("a", DAY, 1.5)], "sku string, ds date, multiplier double"), "yhat", "upper").orderBy("ds").collect()
    assert [(r["yhat"], r["upper"]) for r in got] == [(15.0, 18.0), (10.0, 12.0)]


def test_prices_at_the_till_become_events(spark):
    schema = "sku string, list_price double, current_price double, recorded_price double, discount_from date, discount_to date, first_day date, last_day date"
    last = DAY + timedelta(days=30)
    rows = [("same", 10.0, 10.0, 10.04, None, None, DAY, last), ("moved", 12.0, 12.0, 10.0, None, None, DAY, last), ("sale", 10.0, 7.5, 10.0, DAY - timedelta(days=5), DAY + timedelta(days=3), DAY, last), ("open", 10.0, 9.0, 10.0, None, None, DAY, last), ("over", 10.0, 5.0, 10.0, None, DAY - timedelta(days=1), DAY, last)]
    got = sorted((r["sku"], r["kind"], r["start"], r["end"], r["new_price"], r["discount_pct"]) for r in pricing.price_events(frame(spark, rows, schema)).collect())
    assert got == [("moved", "price_change_permanent", DAY, None, 12.0, None), ("open", "promotion", DAY, last, None, 10.0), ("sale", "promotion", DAY, DAY + timedelta(days=3), None, 25.0)]


@pytest.mark.parametrize(("price", "lo", "hi", "distance", "unsure"), [(20.0, 40.0, 50.0, 2.0, 1.0), (45.0, 40.0, 50.0, 0.0, 0.25), (55.0, 40.0, 50.0, 0.5, 0.45), (41.0, 40.0, 40.0, 0.5, 0.45), (None, 40.0, 50.0, 0.0, 0.25)])
def test_how_far_and_how_unsure_a_price_is(spark, price, lo, hi, distance, unsure):
    row = frame(spark, [(price, lo, hi)], "price double, range_lo double, range_hi double").withColumn("x", F.expr(rules.EXTRAPOLATION_DISTANCE))
    r = row.withColumn("u", F.expr(rules.extrapolation_uncertainty("x"))).first()
    assert (r["x"], r["u"]) == (pytest.approx(distance), pytest.approx(unsure))


def test_units_sold_since_a_count(spark):
    counts = frame(spark, [("a", DAY), ("b", DAY), ("c", DAY)], "sku string, counted_on date")
    daily = frame(spark, [("a", DAY - timedelta(days=1), 9.0), ("a", DAY, 2.0), ("a", DAY + timedelta(days=1), 3.0), ("b", DAY - timedelta(days=2), 4.0)], "sku string, ds date, y double")
    got = {r["sku"]: r["units"] for r in telemetry.units_sold_since(counts, daily, frame(spark, [("a", 1.0), ("c", 6.0)], "sku string, units double")).collect()}
    assert got == {"a": 6.0, "b": 0.0, "c": 6.0}


def test_an_index_is_its_own_its_family_s_or_flat(spark):
    wave = lambda name, high: [(name, m, high if m <= 6 else 2 - high) for m in range(1, 13)]
    own = frame(spark, wave("strong", 1.5) + wave("weak", 1.05) + wave("odd", 1.02), "sku string, month int, index double")
    cohort = frame(spark, wave("c", 1.3) + wave("flat", 1.0), "category string, month int, index double")
    keys = frame(spark, [("strong", "c"), ("weak", "c"), ("odd", "flat"), ("new", "c")], "sku string, category string")
    got = {(r["sku"], r["month"]): (r["index"], r["source"]) for r in seasonality.resolved_index(own, cohort, keys).collect()}
    assert len(got) == 48 and got["strong", 1] == (1.5, "own") and got["weak", 1] == (1.3, "cohort") and got["new", 12] == (0.7, "cohort") and got["odd", 3] == (1.0, "none")


def test_orders_due_come_soonest_first(spark):
    plan = frame(spark, [(1, 9), (2, None), (3, 2), (4, 9)], "sku int, days_to_reorder int")
    assert [r["sku"] for r in planning.reorder_sheet(plan).collect()] == [3, 1, 4]


def test_holidays_that_touch_a_range(spark):
    got = holidays.windows(spark, "2024-12-20", "2025-01-05").collect()
    assert any(r["core_start"] <= date(2024, 12, 25) <= r["core_end"] for r in got)
    assert all(r["core_end"] >= date(2024, 12, 20) and r["core_start"] <= date(2025, 1, 5) for r in got)
    assert holidays.windows(spark, "2025-08-01", "2025-08-10").count() == 0


def test_sheets_and_sinks_keep_what_they_hold(spark, tmp_path):
    rows = frame(spark, [("007", date(2024, 1, 2), 3.5), ("008", date(2024, 2, 3), None)], "sku string, ds date, y double")
    for _ in range(2):  # the second call replaces the first
        ingest.write_sheet(rows, f"{tmp_path}/sheet")
        ingest.write_table(rows.withColumn("month", F.month("ds")), f"{tmp_path}/table", "month")
    sheet = ingest.read_sheet(spark, f"{tmp_path}/sheet")
    assert dict(sheet.dtypes) == {"sku": "string", "ds": "string", "y": "string"} and sorted(tuple(r) for r in sheet.collect()) == [("007", "2024-01-02", "3.5"), ("008", "2024-02-03", None)]
    table = spark.read.parquet(f"{tmp_path}/table")
    assert {f.split("month=")[1][0] for f in table.inputFiles()} == {"1", "2"} and sorted(map(tuple, table.select("sku", "ds", "y").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_a_day_s_counts_are_replaced_never_added(spark, tmp_path):
    at = lambda d, h: datetime(2024, 3, d, h)
    first = frame(spark, [("a", DAY, 3, at(1, 9)), ("a", DAY, 5, at(1, 12)), ("b", DAY, 1, at(1, 9))], "sku string, ds date, units int, ts timestamp")
    second = frame(spark, [("a", DAY, 9, at(1, 20)), ("b", DAY, 0, at(1, 8)), ("a", DAY + timedelta(days=1), 2, at(2, 9))], "sku string, ds date, units int, ts timestamp")
    for k, part in enumerate((first, second)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(first.schema).parquet(f"{tmp_path}/in")
        stream.keep_daily_sales(read, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
        got = {(r["sku"], str(r["ds"])): r["units"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == [{("a", "2024-03-01"): 5, ("b", "2024-03-01"): 1}, {("a", "2024-03-01"): 9, ("b", "2024-03-01"): 1, ("a", "2024-03-02"): 2}][k]


def weeks_by_hand(rows, horizon):
    """Past years' same weeks of one product {day: units}, by the rule as it is stated; None where it can't be used."""
    first, last = min(rows), max(rows)
    back = lambda d, n: d - timedelta(days=n)
    within = lambda a, b: [rows[d] for d in rows if a <= d <= b]
    if sum(within(back(last, 90), last)) <= 0 or len(within(back(last, 27), last)) < 14:
        return None
    years = []
    for k in (1, 2, 3):
        if first > back(last, 364 * k + 182):
            break
        now, then = within(back(last, 181), last), within(back(last, 364 * k + 181), back(last, 364 * k))
        if min(len(now), len(then)) < 20:
            break
        g, n = 1.0, min(sum(now), sum(then))
        if sum(then) > 0:
            g = min(max(((sum(now) / len(now)) / (sum(then) / len(then))) ** (n / (n + 30)), 1 / 3), 3.0)
        if k == 1:
            got, was = within(back(last, 27), last), within(back(last, 364 + 27), back(last, 364))
            if len(got) >= 7 and len(was) >= 7:
                e, a = sum(was) / len(was) * g * len(got), sum(got)
                if (2 * a < e or a > 2 * e) and abs(e - a) > 2 * (2 * max(e, 1.0)) ** 0.5:
                    return None
        means = []
        for day in range(1, horizon + 1):
            centre = back(last, 364 * k - day)
            v = within(back(centre, 14), back(centre, -14))
            means.append(sum(v) / len(v) if len(v) >= 7 else None)
        known = [m for m in means if m is not None]
        if not known:
            break
        years.append([g * (m if m is not None else sum(known) / len(known)) for m in means])
    return [sum(y[i] for y in years) / len(years) for i in range(horizon)] if years else None


def test_past_years_same_weeks_by_hand(spark):
    import math

    season = lambda k: round(6 + 5 * math.sin(2 * math.pi * k / 365.25), 2)
    end, days = date(2024, 6, 30), 1500
    products = {"whole": lambda k: season(k), "one year": lambda k: season(k) if k < 600 else None, "gone": lambda k: season(k) if k > 95 else 0.0, "unseen": lambda k: season(k) if k == 0 or k > 15 else None,
                "gap": lambda k: None if 364 - 25 < k < 364 + 25 else season(k), "fading": lambda k: 0.2 if k < 28 else season(k), "short": lambda k: season(k) if k < 500 else None}
    rows = {s: {end - timedelta(days=k): f(k) for k in range(days) if f(k) is not None} for s, f in products.items()}
    frame_ = frame(spark, [(s, d, y) for s, by in rows.items() for d, y in by.items()], "sku string, ds date, y double")
    got = {}
    for r in seasonality.same_weeks(frame_, 30).collect():
        got.setdefault(r["sku"], {})[r["day"]] = r["yhat"]
    wanted = {s: weeks_by_hand(by, 30) for s, by in rows.items()}
    assert set(got) == {s for s, w in wanted.items() if w} == {"whole", "one year", "gap"}
    for s, by_day in got.items():
        assert [by_day[k] for k in range(1, 31)] == pytest.approx(wanted[s])


def at_the_bounds(spark):
    """Readings and sales of days that are in stock for exactly a tenth and exactly 95% of 24 hours."""
    readings = [(1, datetime(2024, 1, 1), 5), (1, datetime(2024, 1, 1, 2, 24), 0), (1, datetime(2024, 1, 2), 5), (1, datetime(2024, 1, 2, 22, 48), 0), (1, datetime(2024, 1, 3), 5)]
    hours = telemetry.hours_in_stock(frame(spark, readings, "sku long, ts timestamp, on_hand long")).where("ds < '2024-01-03'")
    return telemetry.demand_estimate(hours.withColumns({"y": F.lit(2.0), "closing": F.lit(None).cast("long")}))


def test_days_at_the_bounds_are_partial_and_whole(spark):
    got = [(r["ds"].day, r["kind"], r["estimate"], round(r["weight"], 9)) for r in at_the_bounds(spark).orderBy("ds").collect()]
    assert got == [(1, "partial", 6.0, 0.1), (2, "normal", 2.0, 1.0)]


def test_summary_of_days_at_the_bounds(spark):
    r = telemetry.censoring_summary(at_the_bounds(spark)).first()
    assert (r["days"], r["normal"], r["capped"], r["partial"], r["censored_share"], r["observed"], r["hidden_units"], r["understated_pct"]) == (2, 1, 0, 1, 50.0, 4.0, pytest.approx(4.0), pytest.approx(100.0))


def test_lowest_day_is_the_first_of_equal_levels(spark):
    path = frame(spark, [("a", k, 1.0, 0.0, x, 0.0) for k, x in enumerate((1.0, 2e-15, 0.0, 3.0), 1)] + [("b", k, 1.0, 0.0, x, 0.0) for k, x in enumerate((0.5, 0.1 + 0.2, 0.3, 0.4), 1)], "sku string, day int, demand double, arrived double, level double, lost double")
    got = {r["sku"]: (r["days_to_stockout"], r["days_out"], r["lowest_day"]) for r in planning.cover_report(path).collect()}
    assert got == {"a": (2, 2, 2), "b": (None, 0, 2)}


def test_peers_meet_in_blocks(spark, monkeypatch):
    import math

    monkeypatch.setattr(demand, "PEER_BLOCK", 4)
    rows = [(c, f"{c}{k:02d}", float(1 + k * k % 23)) for c, n in (("a", 19), ("b", 1), ("c", 3)) for k in range(n)]
    found = demand.nearest_peers(frame(spark, rows, "category string, sku string, units double"), 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = set()
    for c in "abc":
        order = sorted((math.log(u), s) for k, s, u in rows if k == c)
        for i, (v, s) in enumerate(order):
            near = sorted((round(abs(v - w), 9), abs(i - j), p) for j, (w, p) in enumerate(order) if i != j)[:3]
            wanted |= {(s, c, p, x, r) for r, (x, _, p) in enumerate(near, 1)}
    assert {tuple(r) for r in found.select("sku", "category", "peer", "distance", "rank").collect()} == wanted


def test_bundle_units_by_dealt_rows(spark):
    daily = frame(spark, [(k, DAY + timedelta(days=d), float(k + d)) for k in range(1, 30) for d in range(5) if (k + d) % 3], "sku long, ds date, y double")
    flat = frame(spark, [(k, k // 2 + 100 * (k % 2), 2.0) for k in range(2, 30, 3)] + [(5, 5, 1.0)], "bundle long, sku long, qty double")
    dealt = bundles.attribute(daily.repartition(7, "sku", "ds"), flat, 7)
    assert dealt.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, bundles.attribute(daily, flat).collect()))


def test_summary_has_the_columns_of_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    held = duckdb.connect()
    held.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert plans.censoring_summary(spark, folder).columns == [r[0] for r in held.execute("DESCRIBE " + plans.CENSORING_SUMMARY).fetchall()]


def test_bundles_are_followed_to_their_end(spark):
    """Nine bundles in one another, beside a loop of six and a product that is reached by two ways."""
    chain = [(k, k + 1, 2.0) for k in range(1, 10)]
    loop = [(20 + k, 20 + (k + 1) % 6, 3.0) for k in range(6)]
    ways = [(40, 41, 2.0), (40, 42, 3.0), (41, 43, 5.0), (42, 43, 7.0)]
    got = {tuple(r) for r in bundles.expand_whole(bundles.normalise(frame(spark, chain + loop + ways, "bundle long, component long, qty double"))).collect()}
    wanted = {(k, 10, 2.0 ** (10 - k)) for k in range(1, 10)} | {(20 + k, 20 + k, 3.0**6) for k in range(6)}
    assert got == wanted | {(40, 43, 31.0), (41, 43, 5.0), (42, 43, 7.0)}
    assert bundles.expand_whole(frame(spark, [], "bundle long, component long, qty double")).count() == 0


def test_attribution_and_its_sql_have_no_depth():
    sql = decisions.oracle_sql()["bundle_attribution"]
    assert "depth <" not in sql and "depth =" not in sql and "depth < 4" in plans.oracle_sql()["bundle_expansion"]

"""The further planning queries against their SQL, golden cases from the rules, and the streams."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import bands, calendar, demand, engines, holidays, livelog, planning, pricing, seasonality, telemetry, trend
from millrace.plans import decisions, relations
from millrace.sources import ingest
from millrace.streaming import events as stream

from .test_queries import DATA, duck, rows_of, series  # noqa: F401

MORE = {**decisions.queries(), **relations.queries()}
MORE_SQL = {**decisions.oracle_sql(), **relations.oracle_sql()}


@pytest.mark.parametrize("name", sorted(MORE_SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    df = MORE[name](spark, str(DATA))
    got = duck.execute(MORE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, got.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-3) for x, y in zip(a, b, strict=True)), (a, b)


def days_of(spark, rows):
    return spark.createDataFrame([("s", date(2024, 1, 1) + timedelta(days=i), *r) for i, r in enumerate(rows)], "sku string, ds date, y double, hours double, closing int")


def test_day_kinds(spark):
    rows = [(5.0, None, None), (0.0, 0.0, None), (2.0, 1.0, None), (4.0, 12.0, 3), (4.0, 3.0, 3), (3.0, 24.0, 0), (0.0, None, 5)]
    got = [(r["kind"], r["estimate"], r["weight"]) for r in telemetry.demand_estimate(days_of(spark, rows)).orderBy("ds").collect()]
    assert got == [("normal", 5.0, 1.0), ("unavailable", None, 0.0), ("capped", 2.0, 0.5), ("partial", 8.0, 0.5), ("partial", 12.0, 0.125), ("capped", 3.0, 0.5), ("normal", 0.0, 1.0)]


def test_demand_frame_drops_days_that_stayed_empty(spark):
    rows = [(3.0, None, 0), (0.0, None, 0), (0.0, None, 0), (1.0, None, 0), (0.0, None, 4)]
    got = [(r["ds"].day, r["y"], r["kind"]) for r in telemetry.demand_frame(days_of(spark, rows)).orderBy("ds").collect()]
    assert got == [(1, 3.0, "capped"), (4, 1.0, "capped"), (5, 0.0, "normal")]


def prices(spark, rows):
    return spark.createDataFrame([("s", date(2024, 1, 1) + timedelta(days=i), float(y), p, m, o) for i, (y, p, m, o) in enumerate(rows)], "sku string, ds date, y double, price double, price_mixed int, on_promotion int")


def test_price_levels_run_from_their_anchor(spark):
    rows = [(1, 49.99, 0, 0)] * 20 + [(1, 50.0, 0, 0)] * 15 + [(1, 50.2, 0, 0)] * 3 + [(1, 60.0, 0, 0)] * 31 + [(9, 70.0, 1, 0)] * 5
    filled = prices(spark, rows)
    levels = pricing.price_levels(filled)
    assert [(r["price"], r["days"], r["quality"]) for r in levels.orderBy("level").collect()] == [(49.99, 38, "weak"), (60.0, 31, "weak")]
    e = pricing.price_evidence(filled, levels).first()
    assert (e["usable"], e["mixed_days"], e["range_lo"], e["range_hi"], e["last_price"]) == (True, 5, 49.99, 60.0, 60.0)
    close = prices(spark, [(1, 50.0, 0, 0)] * 40 + [(1, 51.0, 0, 0)] * 40)
    assert pricing.price_evidence(close, pricing.price_levels(close)).first()["reason"] == "levels-too-close"


def test_elasticity_counts_days_of_no_sale(spark):
    # 10 a day at 10; at 20, 10 on every fourth day: 2.5 a day, which is an elasticity of -2
    rows = [(10, 10.0, 0, 0)] * 200 + [(10 if k % 4 == 0 else 0, 20.0, 0, 0) for k in range(200)]
    r = pricing.elasticity(prices(spark, rows)).first()
    points = 200 + 50
    assert r["basis"] == "measured" and r["elasticity"] == pytest.approx(-2 * points / (points + 60), abs=0.15)
    assert pricing.elasticity(prices(spark, [(1, 10.0, 0, 0)] * 10 + [(1, 20.0, 0, 0)] * 10)).first()["basis"] == "too-few-points"
    assert pricing.elasticity(prices(spark, [(1, 10.0, 0, 0)] * 40 + [(9, 20.0, 0, 0)] * 40)).first()["basis"] == "positive-elasticity-ignored"


def test_promotion_lift_has_a_floor_of_three_days(spark):
    rows = [(2, 5.0, 0, 0)] * 20 + [(0, 5.0, 0, 0)] * 20 + [(4, 5.0, 0, 1)] * 5
    r = pricing.promotion_lift(prices(spark, rows)).first()
    assert r["lift"] == pytest.approx(1 + 3 * 5 / 10) and r["basis"] == "own-history"
    assert pricing.promotion_lift(prices(spark, rows[:42])).first()["basis"] == "too-few-promo-days"


def test_price_response_tapers(spark):
    e = lambda new, el="-2.0D": spark.sql(f"SELECT {rules.price_response(el, '10.0D', f'{new}D', '8.0D', '12.0D')} AS m").first()["m"]
    assert e(10.0) == 1.0 and e(9.0) == pytest.approx((0.9) ** -2)
    assert (0.8) ** -2 < e(4.0) < (0.4) ** -2 and e(0.5) <= 5.0 and 0.2 <= e(100.0) < (1.2) ** -2


def test_deepest_promotion_applies_alone(spark):
    d = date(2024, 1, 1)
    days = spark.createDataFrame([("s", d + timedelta(days=i), 50.0) for i in range(6)], "sku string, ds date, base_price double")
    events = spark.createDataFrame(
        [("s", "promotion", d, d + timedelta(days=3), None, 25.0), ("s", "promotion", d + timedelta(days=1), None, None, 40.0), ("s", "price_change_permanent", d + timedelta(days=2), None, 40.0, None), ("s", "price_change_temporary", d + timedelta(days=4), None, 45.0, None)],
        "sku string, kind string, start date, end date, new_price double, discount_pct double",
    )
    assert [r["price"] for r in pricing.scheduled_prices(days, events).orderBy("ds").collect()] == [37.5, 30.0, 30.0, 30.0, 45.0, 40.0]


def test_detrending_leaves_a_season_flat_growth_gone(spark):
    growing = [10 * 1.5 ** (i / 365.25) for i in range(900)]
    rows = series(spark, growing)
    found = trend.slope(rows).first()
    assert found["basis"] == "seasonal-fit" and found["slope"] == pytest.approx(0.4055, abs=0.06)
    level = [r["y"] for r in trend.detrend(rows).orderBy("ds").collect()]
    assert max(level) / min(level) < 1.2
    assert trend.slope(series(spark, growing[:200]), short_history=False).first()["basis"] == "none"
    assert trend.slope(series(spark, growing[:50])).first()["slope"] == 0.0


def test_growth_is_shrunk_in_logs(spark):
    rows = [1.0] * 364 + [2.0] * 364
    g = seasonality.year_on_year(series(spark, rows)).first()["growth"]
    assert g == pytest.approx(2 ** (182 / (182 + 30)))


def test_dormant_without_a_sale(spark):
    both = series(spark, [1.0] * 100).union(series(spark, [0.0] * 100, sku="never"))
    assert {r["sku"]: r["dormant"] for r in demand.dormancy(both).collect()} == {"s": False, "never": True}


def test_off_season(spark):
    year = [0.0] * 330 + [5.0] * 35
    seasonal = series(spark, (year * 3)[: 365 * 3 - 60])
    assert demand.off_season(seasonal).first()["off_season"] is True
    assert demand.off_season(series(spark, [1.0] * 1000)).first()["off_season"] is False


def test_store_zero_days(spark):
    rows = [(s, date(2024, 1, 1) + timedelta(days=i), 4.0) for s in "abc" for i in range(30) if i not in (10, 11)]
    found = calendar.store_zero_days(spark.createDataFrame(rows, "sku string, ds date, y double")).collect()
    assert sorted((r["ds"].day, r["on_file"]) for r in found) == [(11, 3), (12, 3)]


def test_holidays_by_hand(spark):
    found = {(r["holiday"], r["anchor"].year): (r["core_start"], r["core_end"]) for r in holidays.occurrences(spark, 2019, 2026).collect()}
    assert [found["easter", y][0] for y in (2019, 2023, 2024, 2025)] == [date(2019, 4, 21), date(2023, 4, 9), date(2024, 3, 31), date(2025, 4, 20)]
    assert found["thanksgiving_week", 2024] == (date(2024, 11, 28), date(2024, 12, 2))
    assert found["memorial_day", 2024] == (date(2024, 5, 25), date(2024, 5, 27)) and found["labor_day", 2025] == (date(2025, 8, 30), date(2025, 9, 1))
    assert found["super_bowl", 2021][0] == date(2021, 2, 7) and found["super_bowl", 2024][0] == date(2024, 2, 11)
    days = holidays.assigned(spark, 2024, 2024).collect()
    assert len({r["ds"] for r in days}) == len(days)


def test_holiday_shape_finds_a_lift(spark):
    rows = []
    for i in range(365 * 3):
        d = date(2022, 1, 1) + timedelta(days=i)
        rows.append(("s", d, 80.0 if (d.month, d.day) == (2, 14) else 10.0, 0))
    filled = spark.createDataFrame(rows, "sku string, ds date, y double, on_promotion int")
    own = holidays.measure(filled, holidays.assigned(spark, 2022, 2024))
    keys = spark.createDataFrame([("s", "c")], "sku string, category string")
    got = {r["holiday"]: r["significant"] for r in holidays.significant(holidays.levels(own, holidays.pool(own, keys), keys)).collect()}
    assert got["valentines"] and not got["july_4"]


def test_fitted_engine_follows_season_and_trend(spark):
    import math

    values = [100 + 0.05 * i + 40 * math.sin(2 * math.pi * i / 365.25) + (20 if i % 7 == 0 else 0) for i in range(1000)]
    got = [r["yhat"] for r in engines.fitted_forecast(series(spark, values), 28).orderBy("day").collect()]
    truth = [100 + 0.05 * i + 40 * math.sin(2 * math.pi * i / 365.25) + (20 if i % 7 == 0 else 0) for i in range(1000, 1028)]
    assert sum(abs(a - b) for a, b in zip(got, truth, strict=True)) / sum(truth) < 0.05


def test_bands_of_totals(spark):
    days = spark.createDataFrame([("s", date(2024, 1, i + 1), 10.0, 6.0, 14.0) for i in range(4)], "sku string, ds date, yhat double, lower double, upper double")
    at = lambda rho: bands.total_band(days, spark.createDataFrame([("s", rho, 0.0, None)], "sku string, rho double, level_sd double, ref_mean double")).first()
    assert (at(0.0)["lo"], at(0.0)["hi"]) == (32.0, 48.0) and (at(1.0)["lo"], at(1.0)["hi"]) == (24.0, 56.0)


def test_log_is_sealed_amended_and_graded_once(spark):
    d = date(2024, 1, 7)
    made = spark.createDataFrame([(None, "s", d, 7, 14.0, 10.0, 18.0, 80, d, None, None, None, [(d + timedelta(days=i), 2.0) for i in range(7)])],
        "store string, sku string, origin date, horizon_days int, predicted double, lo double, hi double, band int, created_at date, count_from date, scored_at date, actual double, daily array<struct<ds:date,yhat:double>>")
    log = livelog.sealed(made)
    assert livelog.snapshot(log, log).count() == 1
    actuals = spark.createDataFrame([("s", d + timedelta(days=i), 3.0) for i in range(7)], "sku string, ds date, y double")
    open_ = livelog.score_due(log, actuals, F.lit(d + timedelta(days=6)))
    assert open_.first()["scored_at"] is None
    done = livelog.score_due(log, actuals, F.lit(d + timedelta(days=7)))
    r = livelog.graded(done).first()
    assert (r["actual"], r["abs_err"], r["in_band"], r["band_z"]) == (21.0, 7.0, False, 1.75)
    changes = spark.createDataFrame([(r["id"], 99.0, "late")], "id string, new_predicted double, reason string")
    assert livelog.amend(done, changes).first()["predicted"] == 14.0 and livelog.amend(log, changes).first()["original"] == 14.0
    factors = spark.createDataFrame([("s", d + timedelta(days=2), 2.0)], "sku string, ds date, factor double")
    v = livelog.revise_days(log, factors).first()
    assert (v["predicted"], v["lo"], v["hi"], v["daily"][2]["yhat"]) == (16.0, 12.0, 20.0, 4.0)
    again = log.union(log.withColumn("created_at", F.date_add("created_at", 1)))
    assert livelog.dedupe(again).collect()[0]["created_at"] == d


@pytest.mark.parametrize(("dates", "dialect", "ambiguous"), [
    (["01/02/2024", "05/02/2024", "13/02/2024"], "day_first", False), (["01/02/2024", "02/13/2024"], "month_first", False), (["1/2/2024", "3/4/2024"], "month_first", True),
    (["2024-01-02", "2024-02-03", ""], "iso", False), (["yesterday", "2024-01-01"], "mixed", False), ([None, ""], "none", False),
])
def test_date_dialects(spark, dates, dialect, ambiguous):
    sheet = spark.createDataFrame([(x,) for x in dates], "date string")
    r = ingest.date_dialect(sheet).first()
    assert (r["dialect"], r["ambiguous"]) == (dialect, ambiguous)


def test_parsed_dates_and_collapse(spark):
    sheet = ingest.normalised_columns(spark.createDataFrame([(" 13/02/2024", "007", "2", 1), ("1/2/24", "007", "-4", 2), ("13/02/2024", "007", "x", 3), ("14/02/2024", "008", "1", 4), ("soon", "007", "1", 5)], "` Date ` string, SKU string, `Units Sold` string, line int"))
    got = {(r["sku"], str(r["ds"]), r["y"], r["line"]) for r in ingest.collapsed(ingest.parsed_dates(sheet), "line", "line").collect()}
    assert got == {("007", "2024-02-13", 2.0, 3), ("007", "2024-02-01", 0.0, 2), ("008", "2024-02-14", 1.0, 4)}
    with pytest.raises(ValueError, match="units_sold"):
        ingest.normalised_columns(spark.createDataFrame([("x",)], "date string"))


def test_repeats_next_to_each_other_are_sales(spark):
    rows = [("a", 1), ("a", 1), ("b", 2), ("c", 3)]
    once = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line int, sku string, n int")
    twice = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 2)], "line int, sku string, n int")
    assert ingest.repeated_block(once, "line").first()["copies"] == 1 and ingest.repeated_block(twice, "line").first()["copies"] == 2
    assert ingest.without_repeats(twice, "line").count() == 4 and ingest.repeated_block(once.limit(0), "line").first()["copies"] == 1


def test_statuses_follow_their_order(spark):
    base = {"sku": 1, "on_hand": 10, "price": 10.0, "unit_cost": 5.0, "days_of_cover": 20, "days_to_reorder": 6, "lead": 14, "coverage": 30, "sold_30": 10.0, "stock_counted": True, "dormant": False, "ever_sold": True, "on_order": False, "excused": False}
    cases = [({}, "Stockout risk"), ({"days_to_reorder": 7}, "Reorder due"), ({"days_to_reorder": 22}, "Healthy"), ({"on_order": True}, "Healthy"), ({"dormant": True}, "Dead stock"), ({"stock_counted": False, "dormant": True}, "Stock not counted"),
             ({"days_of_cover": None, "days_to_reorder": None, "sold_30": 0.0}, "Dead stock"), ({"days_of_cover": None, "days_to_reorder": None, "sold_30": 0.0, "excused": True}, "Overstocked"), ({"days_of_cover": 60, "days_to_reorder": 46}, "Overstocked")]
    schema = "sku int, on_hand int, price double, unit_cost double, days_of_cover int, days_to_reorder int, lead int, coverage int, sold_30 double, stock_counted boolean, dormant boolean, ever_sold boolean, on_order boolean, excused boolean"
    rows = [tuple({**base, **change, "sku": i}.values()) for i, (change, _) in enumerate(cases)]
    got = {r["sku"]: r["status"] for r in planning.scorecard(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_stream_of_readings_keeps_changes(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for k, rows in enumerate([[(1, 50), (2, 50), (3, 70)], [(4, 70), (5, 10)]]):
        made = spark.createDataFrame([(h, t + timedelta(hours=h), 7, "reading", float(v), "{}") for h, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 0:
            schema = made.schema
    changes = stream.level_changes(stream.readings_of(stream.distinct_events(stream.event_stream(spark, f"{tmp_path}/in", schema))))
    q = changes.writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["ts"].hour, r["on_hand"]) for r in spark.table("changes").collect())
    assert got == [(1, 5), (3, 7), (5, 1)]


def test_stream_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    q = stream.hourly_sales(stream.event_stream(spark, f"{tmp_path}/in", events.schema, 10)).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, stream.hourly_sales(events).collect()))

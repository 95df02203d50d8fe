"""Every planning query against its SQL in DuckDB on the smallest tables, and golden cases of the operators."""

import math
from datetime import date, datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import bundles, calendar, demand, forecast, planning, telemetry
from millrace.plans import queries

DATA = Path("/root/testdata/sf0.001")


def norm(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 3) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", queries.NAMES)
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, str(DATA))
    got = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, got.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-3) for x, y in zip(a, b, strict=True)), (a, b)


def series(spark, values, sku="s", start=date(2024, 1, 1)):
    return spark.createDataFrame([(sku, start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "sku string, ds date, y double")


@pytest.mark.parametrize(
    ("values", "kind"), [([5] * 40, "smooth"), ([1, 9] * 20, "erratic"), ([5, 0, 0] * 20, "intermittent"), ([1, 0, 9, 0] * 20, "lumpy"), ([0] * 20, "no_demand")]
)
def test_demand_classes(spark, values, kind):
    assert demand.classify(series(spark, values)).first()["demand_class"] == kind


def test_daily_price_prefers_the_dominant_price(spark):
    rows = [("s", date(2024, 1, 1), u, p, m) for u, p, m in [(8.0, 10.0, 1), (1.0, 10.01, 0), (1.0, 5.0, 0)]] + [("s", date(2024, 1, 2), 1.0, 4.0, 0), ("s", date(2024, 1, 2), 1.0, 8.0, 1)]
    lines = spark.createDataFrame(rows, "sku string, ds date, units double, price double, on_promotion int")
    one, two = calendar.daily_price_rollup(lines).orderBy("ds").collect()
    assert (one["price_mixed"], one["on_promotion"]) == (0, 1) and one["price"] == pytest.approx((80 + 10.01) / 9)
    assert (two["price"], two["price_mixed"], two["on_promotion"]) == (6.0, 1, 1)


def test_calendar_carries_unmixed_prices(spark):
    rows = [("s", date(2024, 1, 1), 1.0, 9.0, 1), ("s", date(2024, 1, 3), 1.0, 5.0, 0), ("s", date(2024, 1, 5), 1.0, 7.0, 1), ("t", date(2024, 1, 7), 1.0, 1.0, 0)]
    got = calendar.fill_calendar(spark.createDataFrame(rows, "sku string, ds date, y double, price double, price_mixed int")).where("sku = 's'").orderBy("ds")
    assert [r["price"] for r in got.collect()] == [9.0, 5.0, 5.0, 5.0, 7.0, 5.0, 5.0]


def test_level_in_closed_form_is_the_recursion(spark):
    values = [3, 8, 1, 4, 4, 9, 2] * 9
    rows = series(spark, values)
    profile = {r["weekday"]: r["profile"] for r in forecast.weekday_profile(rows).collect()}
    z = [v / profile[(i + 1) % 7 + 1] for i, v in enumerate(values)]
    level = sum(z[:28]) / 28
    for x in z:
        level += forecast.LEVEL_WEIGHT * (x - level)
    assert forecast.recent_level(rows).first()["level"] == pytest.approx(level)


def test_croston_in_closed_form_is_the_recursion(spark):
    values = [0, 4, 0, 0, 6, 1, 0, 3]
    size = gap = None
    last = -1
    for i, v in enumerate(values):
        if v:
            g = i - last
            size, gap = (v, g) if size is None else (size + 0.1 * (v - size), gap + 0.1 * (g - gap))
            last = i
    r = forecast.sparse_demand(series(spark, values)).first()
    assert (r["size"], r["interval"], r["corrected"]) == pytest.approx((size, gap, 0.95 * size / gap))


def test_reorder_plan(spark):
    plan = spark.createDataFrame([("s", d, 2.0) for d in range(1, 121)], "sku string, day int, yhat double")
    stock = spark.createDataFrame([("s", 50.0)], "sku string, on_hand double")
    r = planning.reorder_plan(stock, plan, spark.createDataFrame([("s", 5.0)], "sku string, safety double"), 14, 30).first()
    assert (r["days_to_stockout"], r["days_to_reorder"], r["coverage_qty"], r["stock_at_delivery"], r["order_qty"]) == (25, 11, 60.0, 0.0, 65.0)


def test_hours_in_stock_and_estimates(spark):
    rows = [("s", datetime(2024, 1, 1, 0), 5), ("s", datetime(2024, 1, 1, 12), 0), ("s", datetime(2024, 1, 2, 0), 5), ("s", datetime(2024, 1, 4, 0), 5)]
    days = telemetry.hours_in_stock(spark.createDataFrame(rows, "sku string, ts timestamp, on_hand long")).orderBy("ds").collect()
    assert [(str(r["ds"]), r["hours"]) for r in days] == [("2024-01-01", 12.0), ("2024-01-02", 24.0), ("2024-01-03", 24.0), ("2024-01-04", 24.0)]
    y = spark.createDataFrame([("s", 4.0, 12.0), ("s", 4.0, 1.0), ("s", 0.0, 0.0), ("s", 4.0, None)], "sku string, y double, hours double").withColumn("closing", F.lit(None).cast("int"))
    got = [(r["kind"], r["estimate"]) for r in telemetry.demand_estimate(y).collect()]
    assert got == [("partial", 8.0), ("capped", 4.0), ("unavailable", None), ("normal", 4.0)]


def test_bundles_end_at_loops_and_drop_themselves(spark):
    parts = bundles.normalise(spark.createDataFrame([(1, 2, 2.0), (2, 3, 3.0), (3, 1, 1.0), (4, 4, 5.0), (5, 3, 0.0), (6, 1, 1.0)], "bundle long, component long, qty double"))
    assert {tuple(r) for r in bundles.expand(parts).collect()} == {(1, 1, 6.0), (2, 2, 6.0), (3, 3, 6.0), (6, 1, 6.0)}


def test_bundle_share(spark):
    flat = spark.createDataFrame([(9, 1, 2.0)], "bundle long, sku long, qty double")
    units = spark.createDataFrame([(9, 5.0), (1, 10.0)], "sku long, units double")
    assert tuple(bundles.dependency(units, flat).first()) == (1, 10.0, 10.0, 50.0, True)


def readings(spark, *levels):
    return spark.createDataFrame([("s", datetime(2024, 1, 1, 6) + timedelta(hours=8 * i), v) for i, v in enumerate(levels)], "sku string, ts timestamp, on_hand long")


def test_out_since_begins_with_the_last_empty_run(spark):
    row = telemetry.state(readings(spark, 0, 4, 0, 0)).first()
    assert (row["level"], row["state"], row["out_since"], row["readings_today"], row["went_out_today"]) == (0, "out", datetime(2024, 1, 1, 22), 1, True)
    row = telemetry.state(readings(spark, 0, 4)).first()
    assert (row["state"], row["out_since"], row["went_out_today"]) == ("in", None, True)


def test_retention_keeps_one_older_reading(spark):
    kept = telemetry.retain(readings(spark, 1, 2, 3, 4, 5, 6), 1).orderBy("ts")
    assert [r["on_hand"] for r in kept.collect()] == [2, 3, 4, 5, 6]


def test_margins_without_a_price_are_standard(spark):
    rows = planning.margins(spark.createDataFrame([(1, None, 5.0), (2, 10.0, 5.0), (3, 10.0, 12.0)], "sku long, price double, unit_cost double"))
    assert [(r["return_tier"], r["protection"]) for r in rows.orderBy("sku").collect()] == [(None, "standard"), ("A", "max"), ("F", "light")]

"""Rushes, families, price changes and engine backtests: queries against their SQL, and golden cases."""

import hashlib
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import backtest, bands, engines, families, holidays, livelog, planning, pricestudy, pricing, replay, rush, seasonality, telemetry, trend
from millrace.plans import studies

from .test_queries import DATA, duck, rows_of  # noqa: F401

START = date(2021, 1, 4)


@pytest.mark.parametrize("name", sorted(studies.oracle_sql()))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    df = studies.queries()[name](spark, str(DATA))
    got = duck.execute(studies.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, got.fetchall())
    assert len(ours) == len(theirs) and ours
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-3) for x, y in zip(a, b, strict=True)), (a, b)


def weekly(spark, products, weeks=160):
    """Daily rows of products {sku: (first week, {week: multiple})} that sell 20 a day."""
    rows = [(sku, START + timedelta(days=7 * w + k), 20.0 * high.get(w, 1.0)) for sku, (first, high) in products.items() for w in range(first, weeks) for k in range(7)]
    return spark.createDataFrame(rows, "sku string, ds date, y double")


def peers_of(spark, pairs):
    return spark.createDataFrame(pairs, "sku string, peer string")


def test_rush_is_found_and_taken_out(spark):
    days = weekly(spark, {"a": (0, {140: 3.0, 141: 4.0, 142: 1.3}), "yearly": (0, {w + 52 * k: 3.0 for w in (36, 37, 38) for k in range(3)}), "going on": (0, {157: 3.0, 158: 3.0, 159: 3.0}), "level": (0, {w: 3.0 for w in range(120, 160)})})
    found = rush.find(days, peers_of(spark, []))
    got = {r["sku"]: r for r in found.collect()}
    assert set(got) == {"a"}
    a = got["a"]
    assert (a["start"], a["end"], a["weeks"], a["source"], a["past"]) == (START + timedelta(days=980), START + timedelta(days=1000), 3, "own", 1.0)
    assert a["ratio"] == pytest.approx((3 + 4 + 1.3) / 3) and a["units"] == pytest.approx(140 * (3 + 4 + 1.3 - 3))
    flat = seasonality.rush_deflate(days, rush.factors(found)).where("sku = 'a'").collect()
    assert {round(r["y"], 6) for r in flat} == {20.0}


def test_only_the_unusual_part_of_a_season_goes(spark):
    days = weekly(spark, {"a": (0, {**{w + 52 * k: 1.6 for w in (36, 37) for k in range(2)}, 140: 4.8, 141: 4.8})})
    a = rush.find(days, peers_of(spark, [])).first()
    assert a["past"] == pytest.approx(1.6) and a["ratio"] == pytest.approx(4.8)
    flat = seasonality.rush_deflate(days, rush.factors(rush.find(days, peers_of(spark, [])))).where("y > 20.001").collect()
    assert {round(r["y"], 4) for r in flat} == {32.0}


@pytest.mark.parametrize(
    ("others", "source"),
    [
        ({"p": (0, {140: 2.0, 141: 2.0}), "q": (0, {140: 2.0, 141: 2.0})}, "similar products"),  # only now: a one-off
        ({"p": (0, {36: 2.0, 37: 2.0, 88: 2.0, 89: 2.0, 140: 2.0, 141: 2.0})} | {"q": (0, {88: 2.0, 89: 2.0, 140: 2.0, 141: 2.0, 36: 2.0, 37: 2.0})}, None),  # every year: a season
        ({"p": (0, {}), "q": (0, {})}, None),  # they can't tell
        ({"p": (0, {140: 2.0, 141: 2.0}), "young": (120, {140: 2.0, 141: 2.0})}, None),  # one peer alone
    ],
)
def test_peers_decide_for_a_young_product(spark, others, source):
    days = weekly(spark, {"new": (110, {140: 3.0, 141: 3.0})} | others)
    found = rush.find(days, peers_of(spark, [("new", p) for p in others])).where("sku = 'new'").collect()
    assert [r["source"] for r in found] == ([source] if source else [])


def like(a, b):
    """Correlation over joint slots, by the rule as it is stated."""
    m = np.isfinite(a) & np.isfinite(b)
    if m[7:].sum() < 5 or m.sum() < 3:
        return 0.0
    a, b = a[m], b[m]
    flat = [np.std(v) < 1e-9 for v in (a, b)]
    return float(all(flat)) if any(flat) else float(np.corrcoef(a, b)[0, 1])


def signatures_of(spark, vectors):
    rows = [(sku, slot + 1, float(v)) for sku, vector in vectors.items() for slot, v in enumerate(vector) if np.isfinite(v)]
    return spark.createDataFrame(rows, "sku string, slot int, value double")


def vectors_of(n, seed, shapes=6):
    """n signatures around a few shapes, some with months never seen, some flat, some twice."""
    rng = np.random.default_rng(seed)
    kinds = 1 + 0.4 * rng.normal(size=(shapes, 19))
    out = {}
    for k in range(n):
        v = kinds[k % shapes] + 0.15 * rng.normal(size=19)
        if k % 11 == 0:
            v = np.ones(19)
        if k % 5 == 0:
            v[7 + rng.integers(0, 12, rng.integers(1, 10))] = np.nan
        out[f"p{k:03d}"] = v
    out["p001"] = out["p007"].copy()
    return out


def test_cohesion_equals_all_pairs(spark):
    vectors = vectors_of(60, 1)
    groups = {sku: f"g{k % 4}" for k, sku in enumerate(vectors)} | {"p059": "alone"}
    members = spark.createDataFrame([(g, s) for s, g in groups.items()] + [("g0", "no signature")], "group string, sku string")
    got = {r["group"]: (r["members"], r["cohesion"]) for r in families.cohesion(members, signatures_of(spark, vectors)).collect()}
    for g in set(groups.values()):
        own = [vectors[s] for s in groups if groups[s] == g]
        pairs = [like(own[i], own[j]) for i in range(len(own)) for j in range(i)]
        assert got[g] == (len(own), pytest.approx(np.mean(pairs) if pairs else 0.0, abs=1e-9))


def clusters_by_pairs(vectors, alike):
    names = sorted(vectors)
    c = np.array([[1.0 if a == b else like(vectors[a], vectors[b]) for b in names] for a in names])
    out, used = [], set()
    for i in np.lexsort((np.arange(len(names)), -np.round(c.sum(1), 9))):
        if i in used:
            continue
        own = [i]
        used.add(i)
        for j in np.lexsort((np.arange(len(names)), -np.round(c[i], 12))):
            if j not in used and all(round(c[j, k], 12) >= alike for k in own):
                own.append(j)
                used.add(j)
        out.append(sorted(names[k] for k in own))
    return sorted(out)


@pytest.mark.parametrize("seed", [2, 3])
def test_clusters_equal_the_table_of_pairs(spark, seed):
    vectors = vectors_of(200, seed)
    members = spark.createDataFrame([(g, s) for s in vectors for g in ("all", "odd" if int(s[1:]) % 2 else "even")], "group string, sku string")
    base = np.nanmean(np.vstack(list(vectors.values())), axis=0)
    got = {}
    for r in families.clusters(members, signatures_of(spark, vectors)).collect():
        got.setdefault(r["group"], {}).setdefault(r["cluster"], []).append(r["sku"])
    for group, pick in (("all", lambda k: True), ("odd", lambda k: k % 2), ("even", lambda k: not k % 2)):
        own = {s: v - base for s, v in vectors.items() if pick(int(s[1:]))}
        assert sorted(sorted(c) for c in got[group].values()) == clusters_by_pairs(own, 0.35)
    assert 5 < len(got["all"]) < 60


def test_a_large_family_is_clustered_without_pairs():
    rng = np.random.default_rng(4)
    kinds = rng.normal(size=(40, 19))
    vectors = kinds[rng.integers(0, 40, 30_000)] + 0.05 * rng.normal(size=(30_000, 19))
    numbers = families.complete_linkage(vectors, 0.35)
    assert numbers.min() == 0 and numbers.max() < 40


def test_adaptive_groups_by_hand(spark):
    """Sizes behave alike: a trait needs the larger gain; a type that gains little is taken, a gain too small is not; no value of NO_GROUP makes a group."""
    rng = np.random.default_rng(5)
    summer, winter = np.ones(19), np.ones(19)
    summer[13:15] += 2
    winter[7:9] += 2
    vectors, products, attributes = {}, [], []
    for k in range(12):
        sku = f"p{k:02d}"
        vectors[sku] = (summer if k % 2 else winter) + 0.02 * rng.normal(size=19)
        products.append((sku, "Chairs", 400 if k < 11 else 100))
        attributes += [(sku, "type", "garden" if k % 2 else "indoor"), (sku, "color", "red" if k < 6 else "blue"), (sku, "label", "Misc")]
    products += [("lone", None, 400), ("junk", "Misc", 400)]
    got = {r["sku"]: r for r in families.adaptive_groups(spark.createDataFrame(products, "sku string, base string, days int"), spark.createDataFrame(attributes, "sku string, name string, value string"), signatures_of(spark, vectors)).collect()}
    assert got["lone"]["level"] == got["junk"]["level"] == "none" and got["junk"]["group"] is None
    assert {got[f"p{k:02d}"]["group"] for k in range(1, 12, 2)} == {"Chairs | type:garden"} and {got[f"p{k:02d}"]["group"] for k in range(0, 12, 2)} == {"Chairs | type:indoor"}
    assert got["p01"]["members"] == 5 and got["p01"]["gain"] > 0.08
    # the same by colour alone: its two groups agree no better than the family
    plain = [a for a in attributes if a[1] != "type"]
    flat = families.adaptive_groups(spark.createDataFrame(products, "sku string, base string, days int"), spark.createDataFrame(plain, "sku string, name string, value string"), signatures_of(spark, vectors)).where("base = 'Chairs'")
    assert {(r["group"], r["level"], r["members"]) for r in flat.collect()} == {("Chairs", "base", 11)}
    # a trait that parts the two shapes gains far more than it needs
    by_trait = [(s, "color", "red" if int(s[1:]) % 2 else "blue") for s, _, _ in products if s[0] == "p"]
    some = families.adaptive_groups(spark.createDataFrame(products, "sku string, base string, days int"), spark.createDataFrame(by_trait, "sku string, name string, value string"), signatures_of(spark, vectors)).where("base = 'Chairs'")
    assert {(r["group"], r["level"]) for r in some.collect()} == {("Chairs | color:red", "subgroup"), ("Chairs | color:blue", "subgroup")}


def times_of(sku, rep):
    u = int(hashlib.md5(f"{sku}|{rep}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u > p for p in backtest.POISSON)


def test_intervals_and_ranking_by_hand(spark):
    rng = np.random.default_rng(8)
    windows = [(f"s{k}", None if rng.random() < 0.2 else float(rng.random() < 0.5 + k / 80), float(rng.normal(1, 0.2))) for k in range(30) for _ in range(5)]
    got = {r["metric"]: r for r in backtest.intervals(spark.createDataFrame(windows, "sku string, covered double, mase double"), ("covered", "mase"), 300).collect()}
    for place, metric in ((1, "covered"), (2, "mase")):
        by = {}
        for w in windows:
            if w[place] is not None:
                by.setdefault(w[0], []).append(w[place])
        means = [sum(times_of(s, rep) * sum(v) for s, v in by.items()) / sum(times_of(s, rep) * len(v) for s, v in by.items()) for rep in range(1, 301)]
        assert (got[metric]["lo"], got[metric]["hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
        assert got[metric]["lo"] < got[metric]["mean"] < got[metric]["hi"]
    costs = [(f"s{k}", date(2024, 1, 1), tier, float(base + rng.normal(0, 4))) for k in range(30) for tier, base in (("t95", 10.0), ("t99", 11.0), ("t90", 14.0))] + [("s0", date(2024, 1, 1), "some", 0.0)]
    ranked = {r["tier"]: r for r in backtest.tier_ranking(spark.createDataFrame(costs, "sku string, cutoff date, tier string, cost double"), 300).collect()}
    wins = {"t95": 0, "t99": 0, "t90": 0}
    for rep in range(1, 301):
        wins[min(wins, key=lambda t: (round(sum(times_of(s, rep) * c for s, _, u, c in costs if u == t), 6), t))] += 1
    assert {t: round(r["p_cheapest"] * 3) for t, r in ranked.items()} == wins  # "some" isn't measured for all products
    one = backtest.intervals(spark.createDataFrame(windows[:5], "sku string, covered double, mase double"), ("mase",), 50).first()
    assert one["lo"] is None and one["mean"] is not None


def test_lead_time_ladder(spark):
    day = date(2024, 1, 1)
    orders = [("A", "sea", 0, 40), ("A", "sea", 10, 44), ("A", "sea", 20, 42), ("A", "air", 0, 7), ("B", "sea", 0, 44), ("C", "sea", 0, 90), ("C", "sea", 5, 90), ("C", "sea", 9, 90), ("D", "sea", 0, 50), ("D", "sea", 100, 20), ("D", "sea", 110, 22), ("D", "sea", 120, 24), ("E", None, 0, 30), ("F", "sea", 0, 10)]
    rows = [("x", sku, lane, day + timedelta(days=a), day + timedelta(days=a + n)) for sku, lane, a, n in orders]
    frame = spark.createDataFrame(rows, "supplier string, sku string, lane string, ordered date, received date")
    settings = spark.createDataFrame(
        [("A", None, None, None, None, None), ("D", None, None, None, day + timedelta(days=100), None), ("F", None, 12.0, "manual", None, None), ("G", "air", 9.0, None, None, 33.0), ("C", "air", 25.0, None, None, None), ("H", None, None, None, None, None)],
        "sku string, lane string, own_lead double, mode string, changed_at date, slow_days double",
    )
    base = spark.createDataFrame([(None, "x", "sea", 44.0), ("C", None, "air", 8.0)], "sku string, supplier string, lane string, days double")
    got = {r["sku"]: (r["lane"], r["lead"], r["source"], r["n"]) for r in planning.planning_lead(frame, settings, base).collect()}
    assert got["A"] == ("sea", 43.0, "measured", 3)  # the air delivery doesn't count
    assert got["B"] == ("sea", 44.0, "baseline", 1)  # its supplier's baseline, not C's 90 days
    assert got["C"] == ("air", 8.0, "baseline", 0) and got["D"] == ("sea", 23.0, "measured", 3)  # only since the change
    assert got["E"] == (None, 14.0, "baseline", 1) and got["F"] == ("sea", 44.0, "manual", 1)
    assert got["G"] == ("air", 33.0, "next-order", 0) and got["H"] == (None, 14.0, "baseline", 0)


def test_hours_count_on_the_store_s_day(spark):
    """Sold out at 11 pm Eastern on Saturday, restocked on Monday: an empty Sunday has no hours in stock."""
    rows = [("s", datetime(2024, 3, 1, 17, 0), 5), ("s", datetime(2024, 3, 3, 4, 0), 0), ("s", datetime(2024, 3, 4, 15, 0), 9), ("s", datetime(2024, 3, 6, 5, 0), 9)]
    got = {r["ds"]: r["hours"] for r in telemetry.hours_in_stock(spark.createDataFrame(rows, "sku string, ts timestamp, on_hand long"), "America/New_York").collect()}
    assert got[date(2024, 3, 3)] == 0.0 and got[date(2024, 3, 2)] == pytest.approx(23.0) and got[date(2024, 3, 4)] == pytest.approx(14.0)


def test_arrivals_go_to_their_best_order_first(spark):
    readings = spark.createDataFrame([("s", datetime(2024, 1, d, 12), n) for d, n in ((1, 10), (5, 110), (6, 105), (8, 109), (9, 108), (10, 123))], "sku string, ts timestamp, on_hand long")
    orders = spark.createDataFrame(
        [("s", 1, 100.0, date(2023, 12, 1), date(2024, 1, 3), None), ("s", 2, 100.0, date(2024, 1, 7), None, None), ("s", 3, 100.0, date(2023, 12, 1), date(2024, 1, 5), date(2024, 1, 5)), ("s", 4, 6.0, None, None, None), ("s", 5, 100.0, date(2023, 12, 1), date(2023, 10, 1), None)],
        "sku string, order_id long, qty double, ordered date, expected date, received date",
    )
    daily = spark.createDataFrame([("s", 5.0)], "sku string, rate double")
    got = [(r["arrived_on"].day, r["order_id"], r["match"], r["lead_days"], r["days_late"]) for r in telemetry.arrivals(readings, orders, daily).orderBy("ts").collect()]
    assert got == [(5, 1, "exact", 35, 2)]  # 4 units fit order 4 but are under two days of sales; 15 fit no order by half
    plain = telemetry.arrivals(readings, orders).orderBy("ts").collect()
    assert [(r["arrived_on"].day, r["order_id"], r["match"], r["lead_days"]) for r in plain] == [(5, 1, "exact", 35), (8, 4, "partial", None)]
    assert plain[1]["confidence"] == pytest.approx(0.75 * 4 / 6 + 0.25)


def test_amended_twice_keeps_what_was_sealed(spark):
    d = date(2024, 6, 2)
    rows = [("a", None, 14.0), ("b", None, 5.0), ("c", d, 8.0)]
    log = spark.createDataFrame(rows, "id string, scored_at date, predicted double")
    change = lambda i, p: spark.createDataFrame([(i, p, "why")], "id string, new_predicted double, reason string")
    twice = livelog.amend(livelog.amend(livelog.amend(livelog.amend(log, change("a", 20.0)), change("a", 30.0)), change("b", 6.0)), change("c", 1.0))
    got = {r["id"]: (r["predicted"], r["original"], r["amended"], r["amend_reason"]) for r in twice.collect()}
    assert got == {"a": (30.0, 14.0, True, "why"), "b": (6.0, 5.0, True, "why"), "c": (8.0, None, False, None)}


def test_factors_of_one_day_multiply(spark):
    d = date(2024, 6, 2)
    log = spark.createDataFrame([("s", None, 4.0, 2.0, 6.0, [(d, 2.0), (d + timedelta(days=1), 2.0)])], "sku string, scored_at date, predicted double, lo double, hi double, daily array<struct<ds:date,yhat:double>>")
    r = livelog.revise_days(log, spark.createDataFrame([("s", d, 2.0), ("s", d, 1.5)], "sku string, ds date, factor double")).first()
    assert (r["predicted"], r["daily"][0]["yhat"], r["daily"][1]["yhat"]) == (8.0, 6.0, 2.0)


def shop(spark, days=700, seed=1):
    """Six products of two families: steady, seasonal, growing, and sparse ones."""
    rng = np.random.default_rng(seed)
    t = np.arange(days)
    make = {
        "a1": 20 + 6 * np.sin(2 * np.pi * t / 365.25) + rng.normal(0, 2, days), "a2": 15 + 5 * np.sin(2 * np.pi * t / 365.25) + rng.normal(0, 2, days), "a3": (10 + 4 * np.sin(2 * np.pi * t / 365.25) + 0.01 * t + rng.normal(0, 1, days))[-320:],
        "b1": rng.poisson(0.15, days) * 3.0, "b2": rng.poisson(0.3, days) * 1.0, "b3": 8 + 2.0 * (t % 7 == 5) + rng.normal(0, 1, days),
    }
    rows = [(sku, START + timedelta(days=days - len(y) + k), float(max(0.0, round(v, 3)))) for sku, y in make.items() for k, v in enumerate(y)]
    keys = spark.createDataFrame([(s, s[0]) for s in make], "sku string, category string")
    return spark.createDataFrame(rows, "sku string, ds date, y double"), keys


def test_nothing_after_the_cutoff_reaches_a_forecast(spark):
    filled, keys = shop(spark)
    cutoffs = [START + timedelta(days=500), START + timedelta(days=640)]
    schedule = filled.select("sku").distinct().withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).withColumn("block", F.lit("recent"))
    changed = filled.withColumn("y", F.when(F.col("ds") > F.lit(cutoffs[0]), F.col("y") * 7 + 100).otherwise(F.col("y")))
    one, two = ({(r["sku"], r["cutoff"], r["engine"]): r for r in replay.forecasts_as_of(f, keys, schedule, 44, (14, 28)).collect()} for f in (filled, changed))
    assert set(one) == set(two) and {k[2] for k in one} == set(replay.ENGINES)
    for key, row in one.items():
        if key[1] == cutoffs[0]:
            assert row == two[key]
        else:
            assert row["yhat"] != two[key]["yhat"]


def test_engines_as_of_the_last_day_are_the_engines(spark):
    filled, keys = shop(spark)
    end = START + timedelta(days=699)
    schedule = filled.select("sku").distinct().withColumns({"cutoff": F.lit(end), "block": F.lit("recent")})
    got = {(r["sku"], r["engine"]): r for r in replay.routed(replay.forecasts_as_of(filled, keys, schedule, 30, (14,))).collect()}
    fitted = {}
    for r in engines.fitted_forecast(filled, 30).collect():
        fitted.setdefault(r["sku"], {})[r["day"]] = r["yhat"]
    subtypes = spark.createDataFrame([], "sku string, subtype string")
    for r in engines.sparse_forecast(filled, subtypes).collect():
        row = got[r["sku"], "sparse"]
        assert (row["yhat"][0], row["lower"][0], row["upper"][0]) == pytest.approx((r["rate"], r["lower"], r["upper"]))
    for sku, days in fitted.items():
        assert got[sku, "regular"]["yhat"] == pytest.approx([days[k] for k in range(1, 31)])
    assert {s: r for (s, e), r in got.items() if r["routed"]}.keys() >= {"a1", "a2", "b3"} and got["b1", "sparse"]["routed"] and got["a1", "regular"]["routed"]
    # the pooled engine lends the other two members' mean shape, growth taken out
    series = {}
    for r in filled.orderBy("ds").collect():
        series.setdefault(r["sku"], []).append(r["y"])
    start = {s: START + timedelta(days=700 - len(y)) for s, y in series.items()}
    shapes = [replay.shape(np.array(series[s]), *replay._calendar(start[s], len(series[s]))) for s in ("a2", "a3")]
    day, weekday, month = replay._calendar(start["a1"], 730)
    wanted = replay.pooled_series(np.array(series["a1"]), np.mean(shapes, axis=0), weekday, month, 30)[0]
    assert got["a1", "pooled"]["yhat"] == pytest.approx(wanted.tolist()) and got["a1", "pooled"]["relatives"] == 2
    growth = {r["sku"]: r["slope"] for r in trend.slope(filled, False).collect()}
    assert {s: replay.growth(np.array(y), *replay._calendar(start[s], len(y))[::2]) for s, y in series.items()} == pytest.approx(growth)


def test_windows_are_scored_over_lead_and_coverage(spark):
    days = spark.createDataFrame([("s", START + timedelta(days=k), float(k % 5 + 1)) for k in range(1, 61)], "sku string, ds date, y double")
    made = spark.createDataFrame([("s", START, "recent", "regular", 100, 80, 1.0, 1.0, 1.0, 0, 2.0, 1.5, [6.0, 9.0], [3.0] * 44, [2.0] * 44, [4.0] * 44)], replay._FORECAST)
    y = np.array([k % 5 + 1 for k in range(1, 61)], float)
    for r in replay.score(made, days, ((14, 30), (20, 10)), z=1.0).collect():
        lead, cover, basis = (14, 30, 6.0) if r["lead"] == 14 else (20, 10, 9.0)
        gap = y[:lead].sum() - 3.0 * lead - basis
        assert (r["n"], r["coverage"]) == (44, cover) and r["mase"] == pytest.approx(np.abs(y[:44] - 3).mean() / 2)
        assert (r["covered"], r["short"]) == (float(gap <= 0), pytest.approx(max(gap, 0.0)))
        assert r["inside"] == pytest.approx(((y[:44] >= 2) & (y[:44] <= 4)).mean()) and r["order_err"] == pytest.approx(100 * (3.0 * cover / y[lead : lead + cover].sum() - 1))


def test_a_whole_backtest_prefers_the_engine_that_fits(spark):
    filled, keys = shop(spark)
    got = {(r["engine"], r["lead"]): r for r in replay.summary(replay.run(filled, keys, ((14, 30), (28, 30)))).collect()}
    assert {k[0] for k in got} == {"regular", "sparse", "pooled", "routed"} and {k[1] for k in got} == {14, 28}
    assert got["routed", 14]["mase"] < got["sparse", 14]["mase"] and got["routed", 14]["windows"] >= got["pooled", 14]["windows"] // 2
    assert 50 < got["routed", 14]["service_pct"] <= 100 and got["routed", 14]["products"] == 6


def priced(spark, make, days=400):
    """Daily rows of make: {sku: (price of a day, units of a day)}."""
    rows = [(sku, START + timedelta(days=k), float(units(k)), float(price(k)), 0) for sku, (price, units) in make.items() for k in range(days)]
    return spark.createDataFrame(rows, "sku string, ds date, y double, price double, price_mixed int")


def test_a_planted_elasticity_is_found_beside_a_season(spark):
    """Sales turn with a season that the others share; price alone moves them by -1.5."""
    rng = np.random.default_rng(3)
    season = lambda k: 1 + 0.5 * np.sin(2 * np.pi * k / 365.25)
    price = lambda k: 10.0 if k < 120 or k >= 260 else 12.0
    make = {"moved": (price, lambda k: rng.poisson(80 * season(k) * (price(k) / 10) ** -1.5))}
    make |= {f"still{j}": (lambda k: 7.0, lambda k: rng.poisson(40 * season(k))) for j in range(4)}
    filled = priced(spark, make)
    peers = spark.createDataFrame([("moved", f"still{j}", True) for j in range(4)], "sku string, peer string, preferred boolean")
    got = pricestudy.before_after(filled, peers).where("sku = 'moved'").first()
    alone = pricestudy.before_after(filled, peers.limit(0)).where("sku = 'moved'").first()
    assert abs(got["elasticity"] + 1.5) < 0.2 and abs(alone["elasticity"] + 1.5) > 0.4
    assert (got["changes"], got["lo"], got["hi"]) == (2, 10.0, 12.0) and got["se"] < 0.3


def test_only_changes_that_can_be_read_count(spark):
    price = lambda k: 10.0 + 0.02 * (k % 2) if k < 100 else 13.0 if k < 104 else 10.4 if k < 200 else 13.0
    filled = priced(spark, {"a": (price, lambda k: 20), "flat": (lambda k: 5.0, lambda k: 9)}, 300)
    got = pricestudy.changes(filled).collect()
    # 10.00 and 10.02 are one price; four days at 13 are too few on their side; 10.4 to 13 can be read
    assert [(r["sku"], r["p0"], r["p1"], r["n0"], r["n1"]) for r in got] == [("a", 10.4, 13.0, 91, 91)]
    masked = filled.where(F.col("ds") >= F.lit(START + timedelta(days=205))).select("sku", "ds")
    assert pricestudy.changes(filled, masked).count() == 0

@pytest.mark.parametrize(
    ("own", "study", "usable", "wanted"),
    [
        ((-1.0, "measured"), (-1.4, 0.5), True, (-1.2, "both")),
        ((-1.0, "measured"), (-2.0, 0.5), True, (None, "readings-disagree")),
        ((-1.0, "measured"), (-2.0, 1.6), True, (-1.0, "same-months")),
        ((-1.0, "measured"), (-1.4, 0.5), False, (-1.4, "before-after")),
        ((-1.0, "measured"), (0.3, 0.5), False, (None, "too-few-price-levels")),
        ((0.0, "price-never-varied"), (0.3, 0.5), True, (None, "positive-elasticity-ignored")),
        ((0.0, "too-few-points"), (-5.0, 0.5), True, (None, "too-few-points")),
        (None, (-0.8, 0.2), True, (-0.8, "before-after")),
    ],
)
def test_two_readings_are_cross_checked(spark, own, study, usable, wanted):
    first = spark.createDataFrame([("s", *own)] if own else [], "sku string, elasticity double, basis string")
    second = spark.createDataFrame([("s", *study)], "sku string, elasticity double, se double")
    r = pricestudy.reading(first, second, spark.createDataFrame([("s", usable)], "sku string, usable boolean")).first()
    assert (r["elasticity"], r["basis"]) == wanted


def family_by_hand(sku, vectors, base, days, means, clusters):
    """The rule as it is stated, from the members' own signatures."""
    others = [(k, [m for m in c if m != sku]) for k, c in sorted(clusters.items())]
    others = [(k, c) for k, c in others if c]
    if not others:
        return None, "no relatives"
    several = [x for x in others if len(x[1]) >= 2] or others
    centre = {k: np.nanmean(np.vstack([vectors[m] for m in c]), axis=0) for k, c in several}
    own = vectors.get(sku)
    if own is not None and days[sku] >= 60 and any((np.isfinite(own) & np.isfinite(centre[k]))[7:].sum() >= 5 for k, _ in several):
        fit = {k: like(own - base, centre[k] - base) for k, _ in several}
        best = max(fit, key=lambda k: (round(fit[k], 9), -k))
        return (best, "own shape") if fit[best] >= 0.35 else (None, "own shape matches none")
    if len(others) == 1:
        return others[0][0], "one family"
    return min(((abs(np.log(np.median([means[m] for m in c]) / means[sku])), k) for k, c in several))[1], "volume"


@pytest.mark.filterwarnings("ignore:Mean of empty slice")
def test_relatives_equal_a_search_by_hand(spark):
    vectors = vectors_of(120, 9)
    rng = np.random.default_rng(9)
    signatures = signatures_of(spark, vectors)
    members = spark.createDataFrame([(f"g{int(s[1:]) % 3}", s) for s in vectors], "group string, sku string")
    clustered = families.clusters(members, signatures)
    clusters = {}
    for r in clustered.collect():
        clusters.setdefault(r["group"], {}).setdefault(r["cluster"], []).append(r["sku"])
    young = {f"y{k}": np.where(np.arange(19) < 7 + 2 * k, vectors["p002"] + 0.02 * rng.normal(size=19), np.nan) for k in range(7)}
    young |= {f"x{k}": 1 + 0.4 * rng.normal(size=19) for k in range(8)}
    names = [*vectors, *young, "bare"]
    means = {s: float(np.round(rng.lognormal(2, 1), 4)) for s in names}
    days = {s: 30 if s in ("y6", "bare", "p004") else 400 for s in names}
    groups = {s: f"g{int(s[1:]) % 3}" if s[0] == "p" else "g2" for s in names}
    products = spark.createDataFrame([(s, groups[s], days[s], means[s]) for s in names] + [("far", "no such group", 400, 1.0)], "sku string, group string, days int, mean double")
    chosen = families.relatives(products, clustered, signatures, signatures_of(spark, young))
    got = {r["sku"]: (r["cluster"], r["basis"]) for r in chosen.collect()}
    base = np.nanmean(np.vstack(list(vectors.values())), axis=0)
    assert got == {s: family_by_hand(s, vectors | young, base, days, means, clusters[groups[s]]) for s in names}
    assert {b for _, b in got.values()} >= {"own shape", "own shape matches none", "volume"}
    pairs = {(r["sku"], r["donor"]) for r in families.donors(chosen, clustered).collect()}
    assert pairs == {(s, m) for s, (k, _) in got.items() if k is not None for m in clusters[groups[s]][k] if m != s}


def test_stock_over_several_arrivals(spark):
    """10 in stock, 4 a day; 6 come on day 2, 20 on day 6, 1 without a day."""
    forecast = spark.createDataFrame([("s", k, 4.0) for k in range(1, 11)] + [("t", k, 1.0) for k in range(1, 4)], "sku string, day int, yhat double")
    stock = spark.createDataFrame([("s", 10), ("t", 50)], "sku string, on_hand int")
    arrivals = spark.createDataFrame([("s", 2, 6.0), ("s", 6, 20.0), ("s", None, 1.0), ("s", -3, 0.0), ("t", 40, 5.0)], "sku string, eta_days int, qty double")
    path = planning.cover_path(forecast, stock, arrivals)
    rows = path.where("sku = 's'").orderBy("day").collect()
    level, wanted = 10.0, []
    for day in range(1, 11):
        level += {1: 1.0, 2: 6.0, 6: 20.0}.get(day, 0.0)
        lost = max(4.0 - level, 0.0)
        level = max(level - 4.0, 0.0)
        wanted.append((day, pytest.approx(level), pytest.approx(lost)))
    assert [(r["day"], r["level"], r["lost"]) for r in rows] == wanted
    report = {r["sku"]: r for r in planning.cover_report(path).collect()}
    s = report["s"]
    assert (s["days_to_stockout"], s["back_on"], s["days_out"], s["units_lost"], s["next_arrival"]) == (5, 6, 2, 3.0, 1)
    assert (report["t"]["days_to_stockout"], report["t"]["lowest_day"]) == (None, 3)


def test_safe_range_and_analysis(spark):
    at = lambda prices: spark.createDataFrame([("s", START + timedelta(days=k), 5.0, p, 0) for k, p in enumerate(prices)], "sku string, ds date, y double, price double, price_mixed int")
    sigma = spark.createDataFrame([("s", 2.0)], "sku string, sigma double")
    wide = at([10.0] * 120 + [14.0] * 45)
    r = pricing.safe_range(wide, pricing.price_levels(wide), sigma).first()
    assert (r["lo"], r["hi"]) == (9.0, 14.5)  # a quarter of the spread; half of it above, where 45 of 90 days are known
    steep = pricing.safe_range(wide, pricing.price_levels(wide), sigma, spark.createDataFrame([("s", -4.0)], "sku string, coefficient double")).first()
    assert (steep["lo"], steep["hi"]) == (9.5, 14.5)
    one = at([10.0] * 200)
    r = pricing.safe_range(one, pricing.price_levels(one), sigma).first()
    assert (r["lo"], r["hi"]) == (9.0, 11.0)
    said = lambda rows: pricing.price_analysis(pricing.price_levels(rows), pricing.price_evidence(rows, pricing.price_levels(rows))).first()["warning"]
    assert (said(wide), said(one), said(at([10.0] * 95 + [12.0] * 95))) == ("thin_data", "never_changed", None)


def test_totals_of_spans_equal_the_band_of_their_days(spark):
    rng = np.random.default_rng(6)
    rows = [(s, START + timedelta(days=k), float(y), float(max(y - lo, 0)), float(y + hi)) for s in "ab" for k, (y, lo, hi) in enumerate(zip(rng.gamma(3, 4, 60), rng.gamma(2, 2, 60), rng.gamma(2, 3, 60), strict=True))]
    days = spark.createDataFrame(rows, "sku string, ds date, yhat double, lower double, upper double")
    stats = spark.createDataFrame([("a", 0.3, 0.7, 10.0)], "sku string, rho double, level_sd double, ref_mean double")
    wanted = [("a", 0, 6), ("a", 10, 39), ("a", -5, 3), ("a", 55, 90), ("b", 3, 3), ("a", 70, 80)]
    spans = spark.createDataFrame([(s, START + timedelta(days=i), START + timedelta(days=j)) for s, i, j in wanted], "sku string, first date, last date")
    rhos = spark.createDataFrame([("a", n, 0.3) for n in (4, 5, 7, 30)], "sku string, days int, rho double")
    got = {(r["sku"], r["first"]): r for r in bands.horizon_totals(days, spans, rhos, stats).collect()}
    assert len(got) == 5
    for s, i, j in wanted[:5]:
        inside = days.where((F.col("sku") == s) & F.col("ds").between(F.lit(START + timedelta(days=i)), F.lit(START + timedelta(days=j))))
        want, r = bands.total_band(inside, stats).first(), got[s, START + timedelta(days=i)]
        assert (r["point"], r["lo"], r["hi"]) == pytest.approx((want["point"], want["lo"], want["hi"])) and r["days"] == inside.count()
    months = {(r["first"], r["last"]) for r in bands.month_spans(days).where("sku = 'a'").collect()}
    assert months == {(date(2021, 1, 4), date(2021, 1, 31)), (date(2021, 2, 1), date(2021, 2, 28)), (date(2021, 3, 1), date(2021, 3, 4))}


def test_holiday_evidence_by_hand(spark):
    """Three years of a steady product that sells double on the core of one holiday, one promotion day among them."""
    days = holidays.assigned(spark, 2021, 2023)
    calendar = {r["ds"]: r for r in days.collect()}
    holiday = next(r["holiday"] for r in sorted(calendar.values(), key=lambda r: r["ds"]) if r["core"])
    rng = np.random.default_rng(2)
    span = [START + timedelta(days=k) for k in range(1000)]
    rows = [("s", d, float(10 * (2 if d in calendar and calendar[d]["holiday"] == holiday and calendar[d]["core"] else 1) + rng.integers(0, 3)), int(k % 97 == 5)) for k, d in enumerate(span)]
    filled = spark.createDataFrame(rows, "sku string, ds date, y double, on_promotion int")
    got = {r["offset"]: r for r in holidays.measure(filled, days).where(F.col("holiday") == holiday).collect()}
    clean = [(d, y) for _, d, y, p in rows if not p and d not in calendar]
    mean = np.mean([y for _, y in clean])
    raw = []
    for w in range(7):
        v = [y for d, y in clean if d.weekday() == w]
        raw.append(1 + (np.mean(v) / mean - 1) * sum(v) / (sum(v) + 20))
    profile = np.array(raw) / np.mean(raw)
    years = {}
    for _, d, y, p in rows:
        if d in calendar and calendar[d]["holiday"] == holiday:
            years.setdefault(calendar[d]["anchor"], []).append((d, y, p))
    sizes = {a: sum(1 for r in calendar.values() if r["holiday"] == holiday and r["anchor"] == a) for a in years}
    ends = {a: max(r["ds"] for r in calendar.values() if r["holiday"] == holiday and r["anchor"] == a) for a in years}
    years = {a: v for a, v in years.items() if ends[a] <= span[-1] and len(v) >= holidays.COVER * sizes[a]}
    wanted = {}
    for a, v in years.items():
        w = holidays.YEAR_DECAY ** round((max(years) - a).days / 365.25)
        used = [(d, y) for d, y, p in v if not p]
        level = sum(y for _, y in used) / sum(profile[d.weekday()] for d, _ in used)
        for d, y in used:
            x = wanted.setdefault(calendar[d]["offset"], [0.0, 0.0, 0.0])
            e = level * profile[d.weekday()]
            x[0], x[1], x[2] = x[0] + w * y, x[1] + w * e, x[2] + w * w * e
    assert len(years) >= 2 and {o: (r["num"], r["den"], r["var"]) for o, r in got.items()} == {o: pytest.approx(tuple(x)) for o, x in wanted.items()}


def test_a_holiday_s_total_is_split_anew(spark):
    days = holidays.assigned(spark, 2021, 2023)
    rows = [(s, START + timedelta(days=k), 20.0 + (15 if s == "a" and (START + timedelta(days=k)).timetuple().tm_yday in (358, 359) else 0), 0) for s in "ab" for k in range(720)]
    filled = spark.createDataFrame(rows, "sku string, ds date, y double, on_promotion int")
    keys = spark.createDataFrame([("a", "c"), ("b", "c")], "sku string, category string")
    found = holidays.shape(filled, days, keys)
    flat = spark.createDataFrame([("a", START + timedelta(days=720 + k), 10.0) for k in range(365)], "sku string, ds date, yhat double")
    profile = spark.createDataFrame([("a", w, 1.0) for w in range(7)], "sku string, weekday int, profile double")
    moved = holidays.redistribute(flat, days, found, profile).join(days, "ds", "left")
    whole = moved.where("holiday IS NOT NULL").groupBy("holiday", "anchor").agg(F.sum("yhat").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] == pytest.approx(10.0 * r["n"]) for r in whole) and moved.count() == 365
    assert {round(r["yhat"], 6) for r in moved.where("holiday IS NULL").collect()} == {10.0}
    assert moved.agg(F.max("yhat")).first()[0] > 11.5


@pytest.mark.parametrize("seed", [1, 2])
def test_weeks_are_graded_once_whatever_the_order_of_files(spark, tmp_path, seed):
    """Sealed weeks, the given events' purchases and price factors in shuffled files: the stream's rows are the batch's, each once."""
    from millrace.streaming import grades

    bought = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'purchase' AND user_id < 12")
    sales = bought.select(F.col("user_id").cast("string").alias("sku"), "ts", F.lit(1.0).alias("value"))
    first = sales.agg(F.min("ts")).first()[0]
    sunday = first.date() - timedelta(days=(first.weekday() + 1) % 7)
    entries, factors = [], []
    for k in range(9):
        for w in range(3):
            origin = sunday + timedelta(days=7 * w)
            seal = datetime(origin.year, origin.month, origin.day) - timedelta(hours=5)
            entries.append((str(k), seal, origin, 7.0, 3.0, 12.0, origin + timedelta(days=2) if k == 4 else None, [1.0] * 7 if k % 2 else None))
            if k == 5:
                entries.append((str(k), seal + timedelta(days=1), origin, 99.0, None, None, None, None))
            factors += [(str(k), datetime(origin.year, origin.month, origin.day, 9) + timedelta(days=d), f) for d, f in ((1, 2.0), (1, 0.5), (3, 1.5))] if k in (1, 3, 6) else []
    sealed = spark.createDataFrame(entries, "sku string, ts timestamp, origin date, predicted double, lo double, hi double, count_from date, daily array<double>")
    every = grades.messages(sealed, sales, spark.createDataFrame(factors, "sku string, ts timestamp, value double")).cache()
    wanted = sorted(map(tuple, grades.graded_batch(every).collect()))
    parts = every.randomSplit([1.0] * 4, seed)
    for part in sorted(parts, key=lambda p: p.count(), reverse=bool(seed % 2)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("clock", datetime(2030, 1, 1), 0.0)], "sku string, ts timestamp, value double")
    read = lambda: spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run():
        q = grades.graded_weeks(read(), "60 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(150)
        assert q.exception() is None

    run()  # nothing can be graded yet
    assert spark.read.schema(grades.GRADED).parquet(f"{tmp_path}/out").count() == 0
    grades._messages(late, "sale").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = sorted(map(tuple, spark.read.schema(grades.GRADED).parquet(f"{tmp_path}/out").collect()))
    assert len(got) == 27 and got == wanted
    assert any(r[2] != r[3] for r in got) and {r[7] for r in got} == {5, 7} and sum(r[6] for r in got) > 20

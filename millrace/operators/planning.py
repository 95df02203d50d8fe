"""Safety stock, reorder plans and suppliers' lead times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules

#: Normal quantiles by service level in percent.
SERVICE_LEVELS = {90.0: 1.282, 95.0: 1.645, 98.0: 2.054, 99.0: 2.326, 99.5: 2.576}


def safety_stock(sigma: DataFrame, lead: int, z: float) -> DataFrame:
    """sigma has (sku, sigma_day, sigma_lead); the lead window's own deviation counts between once and thrice the root rule."""
    base = F.col("sigma_day") * F.sqrt(F.lit(float(lead)))
    basis = F.when(F.col("sigma_lead").isNull(), base).otherwise(F.least(F.greatest("sigma_lead", base), 3 * base))
    return sigma.select("sku", basis.alias("basis"), F.round(z * basis).alias("safety"))


def reorder_plan(stock: DataFrame, forecast: DataFrame, safety: DataFrame, lead: int, coverage: int) -> DataFrame:
    """(sku, days_to_stockout, days_to_reorder, coverage_qty, stock_at_delivery, safety, order_qty).

    stock has (sku, on_hand), forecast (sku, day, yhat) with day 1 first, safety (sku, safety).
    """
    run = F.sum(F.greatest("yhat", F.lit(0.0))).over(Window.partitionBy("sku").orderBy("day"))
    rows = forecast.withColumn("used", run).join(stock, "sku")
    out = rows.groupBy("sku", "on_hand").agg(F.min(F.when(F.col("used") >= F.col("on_hand"), F.col("day"))).alias("days_to_stockout"), F.max("day").alias("horizon"))
    out = out.withColumn("days_to_reorder", F.coalesce("days_to_stockout", F.col("horizon") + 1) - lead)
    out = out.withColumn("d", F.greatest("days_to_reorder", F.lit(0)) + lead)
    need = forecast.join(out, "sku").groupBy("sku", "on_hand", "days_to_stockout", "days_to_reorder").agg(
        F.sum(F.when(F.col("day") <= F.col("d"), F.greatest("yhat", F.lit(0.0))).otherwise(0.0)).alias("before"),
        F.avg(F.when((F.col("day") > F.col("d")) & (F.col("day") <= F.col("d") + coverage), F.col("yhat"))).alias("rate"),
    )
    left = F.greatest(F.lit(0.0), F.col("on_hand") - F.round("before"))
    wanted = F.round(F.coalesce("rate", F.lit(0.0)) * coverage)
    return need.join(safety, "sku").select(
        "sku",
        F.col("days_to_stockout").cast("long").alias("days_to_stockout"),
        F.col("days_to_reorder").cast("long").alias("days_to_reorder"),
        wanted.alias("coverage_qty"),
        left.alias("stock_at_delivery"),
        "safety",
        F.greatest(F.lit(0.0), wanted + F.col("safety") - left).alias("order_qty"),
    )


def lead_times(orders: DataFrame) -> DataFrame:
    """Orders with lead_days; deliveries before the order are left out."""
    return orders.withColumn("lead_days", F.datediff("received", "ordered")).where("lead_days >= 0")


def supplier_stats(orders: DataFrame) -> DataFrame:
    """(supplier, n, avg_days, p80_days)."""
    return lead_times(orders).groupBy("supplier").agg(F.count("*").alias("n"), F.avg("lead_days").alias("avg_days"), F.expr("percentile(lead_days, 0.8)").alias("p80_days"))


def lane_stats(orders: DataFrame) -> DataFrame:
    """(supplier, lane, n, p80_days) by supplier and lane, and by lane over all suppliers (supplier null)."""
    return lead_times(orders).groupingSets([["supplier", "lane"], ["lane"]], "supplier", "lane").agg(
        F.count("*").alias("n"), F.expr("percentile(lead_days, 0.8)").alias("p80_days")
    )


#: Deliveries of a lane without which its measured time doesn't count.
LEAST_DELIVERIES = 3


def planning_lead(orders: DataFrame, settings: DataFrame | None = None, baselines: DataFrame | None = None, manual: int = 14) -> DataFrame:
    """(sku, lane, lead, source, n): the days to plan with, by the first that holds of
    `next-order`, a one-off expectation; `manual`, the product's own word; `measured`, the 80th percentile of the product's own deliveries in its lane since
    the last declared change, three at least; `baseline`, the lane's days for the product, else for its supplier, else the product's, else `manual`.

    settings has (sku, lane, own_lead, mode, changed_at, slow_days), all but sku may be null; without a declared lane the one with most such deliveries is taken.
    baselines has (sku, supplier, lane, days), either sku or supplier null.  Other products' deliveries never count.
    """
    spark = orders.sparkSession
    kinds = "sku string, lane string, own_lead double, mode string, changed_at date, slow_days double"
    declared = settings if settings is not None else spark.createDataFrame([], kinds)
    declared = declared.withColumn("sku", F.col("sku").cast("string")).withColumnRenamed("lane", "declared")
    rows = lead_times(orders).withColumn("sku", F.col("sku").cast("string"))
    products = orders.select(F.col("sku").cast("string").alias("sku")).union(declared.select("sku")).distinct().join(declared, "sku", "left")
    since = rows.join(products.select("sku", "changed_at"), "sku").where("changed_at IS NULL OR received >= changed_at")
    lanes = since.groupBy("sku", "lane").agg(F.count("*").alias("n"), F.round(F.percentile("lead_days", F.lit(0.8))).alias("p80"))
    most = F.row_number().over(Window.partitionBy("sku").orderBy(F.col("lane").isNull(), F.desc("n"), "lane"))
    used = lanes.withColumn("place", most).where("place = 1").select("sku", F.col("lane").alias("used"))
    chosen = products.join(used, "sku", "left").withColumn("lane", F.coalesce("declared", "used")).drop("used")
    measured = lanes.select(F.col("sku").alias("s"), F.col("lane").alias("l"), "n", "p80")
    met = chosen.join(measured, (F.col("sku") == F.col("s")) & F.col("lane").eqNullSafe(F.col("l")), "left").drop("s", "l")
    if baselines is not None:
        supplier = orders.groupBy(F.col("sku").cast("string").alias("sku")).agg(F.max_by("supplier", "ordered").alias("supplier"))
        own = baselines.where("sku IS NOT NULL AND days > 0").select(F.col("sku").cast("string").alias("sku"), "lane", F.col("days").alias("own_base"))
        theirs = baselines.where("sku IS NULL AND days > 0").select("supplier", "lane", F.col("days").alias("their_base"))
        met = met.join(supplier, "sku", "left").join(own, ["sku", "lane"], "left").join(theirs, ["supplier", "lane"], "left")
    else:
        met = met.withColumns({"own_base": F.lit(None).cast("double"), "their_base": F.lit(None).cast("double")})
    base = F.coalesce("own_base", "their_base", F.when(F.col("own_lead") > 0, F.col("own_lead")), F.lit(float(manual)))
    slow, by_hand, enough = F.col("slow_days") > 0, F.col("mode") == "manual", F.col("n") >= LEAST_DELIVERIES
    lead = F.when(slow, F.round("slow_days")).when(by_hand, base).when(enough, F.col("p80")).otherwise(base)
    source = F.when(slow, "next-order").when(by_hand, "manual").when(enough, "measured").otherwise("baseline")
    return met.select("sku", "lane", lead.cast("double").alias("lead"), source.alias("source"), F.coalesce("n", F.lit(0)).alias("n"))


def margins(costs: DataFrame) -> DataFrame:
    """Adds margin_pct, return_tier and protection to rows with price and unit_cost; an unknown margin has no tier and standard protection."""
    rows = costs.withColumn("margin_pct", F.when(F.col("price") > 0, 100 * (F.col("price") - F.col("unit_cost")) / F.col("price")))
    m = F.col("margin_pct")
    tier = F.when(m >= 40, "A").when(m >= 20, "B").when(m > 0, "C").when(m <= 0, "F")
    protection = F.when(m < 15, "light").when(m < 30, "standard").when(m < 50, "high").when(m >= 50, "max").otherwise("standard")
    return rows.withColumns({"return_tier": tier, "protection": protection})


def cover(plan: DataFrame, lead: int, coverage: int) -> DataFrame:
    """(sku, days_of_cover, direction, band): how long stock lasts against the lead time, and how near the reorder day is.

    Bands are fractions of the lead time: at risk within half of it, due within one and a half.
    """
    days, left = F.col("days_to_stockout"), F.col("days_to_reorder")
    direction = F.when(days.isNull(), "long").when(days < 1.2 * lead, "short").when(days > lead + coverage, "long").otherwise("healthy")
    risk, due = max(1, round(lead / 2)), max(2, round(1.5 * lead))
    band = F.when(left <= 0, "now").when(left <= risk, "risk").when(left <= due, "due").otherwise("later")
    return plan.select("sku", days.alias("days_of_cover"), direction.alias("direction"), band.alias("band"))


def protection_tiers(products: DataFrame, holding: float = 0.25) -> DataFrame:
    """(sku, tier, service, z, safety_units, stockout_cost, holding_cost, total_cost): the yearly cost of each service level.

    products has (sku, price, unit_cost, fees, spread, coverage), spread being the deviation over the lead time.  A shortage costs the margin in each
    of 365 / coverage cycles, a buffer its holding rate.
    """
    tiers = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(s).alias("service"), F.lit(z).alias("z")) for k, s, z in rules.TIERS])
    rows = products.withColumn("t", F.explode(tiers)).select("*", "t.*").drop("t")
    short = F.expr(rules.expected_shortage("spread", "z"))
    margin = F.col("price") - F.col("unit_cost") - F.coalesce("fees", F.lit(0.0))
    rows = rows.withColumns({"safety_units": F.col("z") * F.col("spread"), "stockout_cost": short * 365.0 / F.greatest("coverage", F.lit(1)) * margin, "holding_cost": F.col("z") * F.col("spread") * F.col("unit_cost") * holding})
    return rows.select("sku", "tier", "service", "z", "safety_units", "stockout_cost", "holding_cost", (F.col("stockout_cost") + F.col("holding_cost")).alias("total_cost"))


def economic_protection(products: DataFrame, holding: float = 0.25) -> DataFrame:
    """(sku, protection, source): the cheapest tier of products with 180 days, 100 units, known costs and regular demand; else the margin's rule.

    products has protection_tiers()' columns and (days, units, demand_class).  A margin of nothing or less takes light protection.
    """
    known = products.withColumn("margin_unit", F.col("price") - F.col("unit_cost") - F.coalesce("fees", F.lit(0.0)))
    by_margin = margins(known.select("*")).withColumnRenamed("protection", "by_margin")
    priced = (F.col("price") > 0) & (F.col("unit_cost") > 0)
    tuned = priced & (F.col("margin_unit") > 0) & (F.col("days") >= 180) & (F.col("units") >= 100) & ~F.col("demand_class").isin("intermittent", "lumpy", "no_demand") & (F.col("spread") > 0)
    rows = by_margin.withColumn("tuned", F.coalesce(tuned, F.lit(False)))
    cheapest = protection_tiers(rows.where("tuned"), holding).groupBy("sku").agg(F.min(F.struct(F.round("total_cost", 2).alias("c"), "service", "tier")).getField("tier").alias("best"))
    met = rows.join(cheapest, "sku", "left")
    loses = F.coalesce(priced & (F.col("margin_unit") <= 0), F.lit(False))
    choice = F.when(loses, "light").otherwise(F.coalesce("best", "by_margin"))
    source = F.when(loses | F.col("best").isNotNull(), "economics").when(F.col("margin_pct").isNull(), "default").otherwise("margin")
    return met.select("sku", choice.alias("protection"), source.alias("source"))


def tier_lookup(measured: DataFrame, asked: DataFrame, tolerance: float = 0.25, least_windows: int = 4) -> DataFrame:
    """(sku, tier, measured_lead): a backtest's tier at the asked lead and coverage, else the nearest lead with both within the tolerance.

    measured has (sku, lead, coverage, tier, windows), asked (sku, lead, coverage).
    """
    runs = measured.select("sku", F.col("lead").alias("measured_lead"), F.col("coverage").alias("measured_coverage"), "tier", "windows").where(F.col("windows") >= least_windows)
    near = (F.abs(F.col("measured_lead") - F.col("lead")) <= tolerance * F.col("lead")) & (F.abs(F.col("measured_coverage") - F.col("coverage")) <= tolerance * F.col("coverage"))
    met = asked.join(runs, "sku").where(near)
    order = F.struct(F.abs(F.col("measured_lead") - F.col("lead")).alias("a"), F.abs(F.col("measured_coverage") - F.col("coverage")).alias("b"), "measured_lead", "tier")
    return met.groupBy("sku").agg(F.min(order).alias("r")).select("sku", "r.tier", "r.measured_lead")


def economics_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(sku, drifted): whether cost, fees or holding rate moved since they were stored; a missing value is a value."""
    names = ("unit_cost", "fees", "holding")
    old = stored.select("sku", *(F.col(n).alias(f"old_{n}") for n in names))
    same = F.lit(True)
    for n in names:
        same = same & (F.abs(F.coalesce(n, F.lit(-1.0)) - F.coalesce(f"old_{n}", F.lit(-1.0))) <= 0.005)
    return current.join(old, "sku").select("sku", (~same).alias("drifted"))


def price_drift(stored: DataFrame, current: DataFrame, least: float = 0.01) -> DataFrame:
    """(sku, old_price, price): shelf prices that moved by more than `least` of the stored ones."""
    met = stored.select("sku", F.col("price").alias("old_price")).join(current.select("sku", "price"), "sku")
    return met.where((F.col("old_price") > 0) & (F.abs(F.col("price") - F.col("old_price")) > least * F.col("old_price")))


def effective_costs(sheet: DataFrame, given: DataFrame) -> DataFrame:
    """(sku, unit_cost, fees): given costs over those of the sheet, column by column."""
    other = given.select("sku", F.col("unit_cost").alias("c"), F.col("fees").alias("f"))
    return sheet.join(other, "sku", "full_outer").select("sku", F.coalesce("c", "unit_cost").alias("unit_cost"), F.coalesce("f", "fees").alias("fees"))


def scorecard(products: DataFrame) -> DataFrame:
    """Adds risk, due, sell_through, direction, status, return_tier, carrying_value and action.

    products has (sku, on_hand, price, unit_cost, days_of_cover, days_to_reorder, lead, coverage, sold_30, stock_counted, dormant, ever_sold,
    on_order, excused).  Sell-through is the last 30 days' units over these and the stock.
    """
    rows = rules.with_rules(products, risk=rules.RISK_DAYS, due=rules.DUE_DAYS)
    rows = rows.withColumn("sell_through", F.when(F.col("sold_30") + F.col("on_hand") > 0, F.col("sold_30") / (F.col("sold_30") + F.col("on_hand"))))
    c, room = F.col("days_of_cover"), F.col("lead") + F.col("coverage")
    rows = rows.withColumn("direction", F.when(c.isNull(), "long").when(c < 1.2 * F.col("lead"), "short").when(c > room, "long").otherwise("healthy"))
    rows = margins(rules.with_rules(rows, status=rules.STATUS)).drop("protection")
    order = F.col("status").isin("Stockout risk", "Reorder due")
    action = (
        F.when(F.col("status") == "Stock not counted", "count")
        .when(F.col("status") == "Dead stock", "clear")
        .when(order & (F.coalesce("return_tier", F.lit("B")) == "F"), "review price")
        .when(order, "order")
        .when(F.col("status") == "Overstocked", "hold")
        .otherwise("none")
    )
    return rows.withColumns({"carrying_value": F.greatest("on_hand", F.lit(0)) * F.coalesce("unit_cost", F.lit(0.0)), "action": action})


def fleet_summary(scored: DataFrame) -> DataFrame:
    """(status, products, value): per status, with the total of all (status null)."""
    return scored.rollup("status").agg(F.count("*").alias("products"), F.sum("carrying_value").alias("value"))


def attention(scored: DataFrame, n: int = 5) -> DataFrame:
    """(sku, status, days_to_reorder): the n most urgent products that are at risk or due."""
    urgent = scored.where("status IN ('Stockout risk', 'Reorder due')")
    return urgent.orderBy("days_to_reorder", "sku").limit(n).select("sku", "status", "days_to_reorder")


def most_carried(scored: DataFrame, n: int = 5) -> DataFrame:
    """(sku, carrying_value): the n products that bind the most money."""
    return scored.orderBy(F.desc("carrying_value"), "sku").limit(n).select("sku", "carrying_value")


def settings_in_use(params: DataFrame, n: int = 12) -> DataFrame:
    """(lead, coverage, products): the commonest settings."""
    return params.groupBy("lead", "coverage").agg(F.count("*").alias("products")).orderBy(F.desc("products"), "lead", "coverage").limit(n)


def route_switches(routes: DataFrame) -> DataFrame:
    """(sku, ds, route, previous): days on which a product's engine changed."""
    before = F.lag("route").over(Window.partitionBy("sku").orderBy("ds"))
    return routes.withColumn("previous", before).where("previous <> route").select("sku", "ds", "route", "previous")


def eta_days(orders: DataFrame, today: F.Column) -> DataFrame:
    """(order_id, sku, eta_days): whole days until an open order is expected, none below 0."""
    return orders.select("order_id", "sku", F.greatest(F.datediff("expected", today), F.lit(0)).alias("eta_days"))


def supplier_kpis(orders: DataFrame) -> DataFrame:
    """(supplier, completed, in_transit, avg_days, p80_days, on_time_pct, avg_variance) of orders (supplier, ordered, expected, received)."""
    lead, late = F.datediff("received", "ordered"), F.datediff("received", "expected")
    done = F.col("received").isNotNull()
    good = done & (lead >= 0)
    return orders.groupBy("supplier").agg(
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("in_transit"),
        F.round(F.avg(F.when(good, lead)) + 1e-9).alias("avg_days"),
        F.round(F.percentile(F.when(good, lead), F.lit(0.8)) + 1e-9).alias("p80_days"),
        F.round(100 * F.avg(F.when(late.isNotNull(), (late <= 0).cast("double"))) + 1e-9).alias("on_time_pct"),
        F.round(F.avg(late) + 1e-9, 1).alias("avg_variance"),
    )


def open_orders(plans: DataFrame, transit: DataFrame) -> DataFrame:
    """Open orders (order_id, sku, qty, expected) of plans and suppliers, each order once, the plan's row first."""
    both = plans.withColumn("rank", F.lit(0)).unionByName(transit.withColumn("rank", F.lit(1)))
    return both.groupBy("order_id").agg(F.min(F.struct("rank", "sku", "qty", "expected")).alias("r")).select("order_id", "r.sku", "r.qty", "r.expected")


def reorder_sheet(plan: DataFrame) -> DataFrame:
    """Products with a reorder day, the soonest first."""
    return plan.where("days_to_reorder IS NOT NULL").orderBy("days_to_reorder", "sku")


def arrival_cover(forecast: DataFrame, stock: DataFrame) -> DataFrame:
    """(sku, days_to_stockout): the first day on which demand so far reaches the stock, orders counting from their arrival on.

    stock has (sku, on_hand, on_order, eta_days), forecast (sku, day, yhat).
    """
    run = F.sum(F.greatest("yhat", F.lit(0.0))).over(Window.partitionBy("sku").orderBy("day"))
    have = F.col("on_hand") + F.when(F.col("day") >= F.coalesce("eta_days", F.lit(0)), F.coalesce("on_order", F.lit(0))).otherwise(0)
    rows = forecast.withColumn("used", run).join(stock, "sku")
    return rows.groupBy("sku").agg(F.min(F.when(F.col("used") >= have, F.col("day"))).alias("days_to_stockout"))


def cover_path(forecast: DataFrame, stock: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(sku, day, demand, arrived, level, lost): stock day by day with any number of dated arrivals, in one ordered sweep per product.

    forecast has (sku, day, yhat) with days from 1 on, stock (sku, on_hand), arrivals (sku, eta_days, qty); what has no day, or one past, is there now.  What arrives on a day
    serves that day.  Demand that finds no stock is lost and does not wait: the level is the running balance less its lowest point below zero so far.
    """
    landed = arrivals.where("qty > 0").groupBy("sku", F.greatest(F.coalesce("eta_days", F.lit(1)), F.lit(1)).cast("int").alias("day")).agg(F.sum("qty").cast("double").alias("arrived"))
    demand = forecast.select("sku", F.col("day").cast("int").alias("day"), F.greatest("yhat", F.lit(0.0)).alias("demand"))
    rows = demand.join(landed, ["sku", "day"], "left").join(stock.select("sku", "on_hand"), "sku").withColumn("arrived", F.coalesce("arrived", F.lit(0.0)))
    order = Window.partitionBy("sku").orderBy("day")
    balance = F.col("on_hand") + F.sum(F.col("arrived") - F.col("demand")).over(order)
    swept = rows.withColumn("balance", balance).withColumn("owed", F.least(F.min("balance").over(order), F.lit(0.0)))
    lost = F.coalesce(F.lag("owed").over(order), F.lit(0.0)) - F.col("owed")
    return swept.withColumn("lost", lost).select("sku", "day", "demand", "arrived", (F.col("balance") - F.col("owed")).alias("level"), "lost")


def cover_report(path: DataFrame) -> DataFrame:
    """(sku, days_to_stockout, back_on, days_out, units_lost, lowest_day, next_arrival): what a path holds, nulls where stock lasts.

    days_to_stockout is the first day that ends empty, back_on the next day that doesn't, days_out the days that end empty.  Levels count to nine
    digits, so that of days that end alike lowest_day is the first, whatever their sums left behind.
    """
    empty = F.col("level") <= 1e-9
    marked = path.withColumn("out", F.min(F.when(empty, F.col("day"))).over(Window.partitionBy("sku")))
    return marked.groupBy("sku").agg(
        F.first("out").alias("days_to_stockout"), F.min(F.when((F.col("day") > F.col("out")) & ~empty, F.col("day"))).alias("back_on"), F.count_if(empty).alias("days_out"), F.sum("lost").alias("units_lost"),
        F.min_by("day", F.struct(F.round("level", 9), F.col("day"))).alias("lowest_day"), F.min(F.when(F.col("arrived") > 0, F.col("day"))).alias("next_arrival"),
    )

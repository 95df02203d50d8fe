"""Readers that map the star-schema tables to sales lines, purchase orders and stock readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line whose discount reaches this counts as sold on promotion.
PROMOTION_DISCOUNT = 0.08


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales_lines(spark: SparkSession, folder: str, key: str = "p_type") -> DataFrame:
    """(sku, category, ds, units, price, on_promotion): one row per sold line; the product key is a column of part, or an expression on its columns."""
    part = table(spark, folder, "part").select("p_partkey", F.expr(key).cast("string").alias("sku"), F.col("p_brand").alias("category"), "p_retailprice")
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_discount")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "sku",
        "category",
        F.to_date("l_shipdate").alias("ds"),
        F.col("l_quantity").alias("units"),
        (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"),
        (F.col("l_discount") >= PROMOTION_DISCOUNT).cast("int").alias("on_promotion"),
    )


def purchase_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(supplier, sku, lane, qty, ordered, received): order lines with the order's date and the day they came."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"), F.col("o_orderpriority").alias("lane"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", F.to_date("l_shipdate").alias("received"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("sku"), "lane", F.col("l_quantity").alias("qty"), "ordered", "received"
    )


def stock_readings(spark: SparkSession, folder: str) -> DataFrame:
    """(sku, ts, on_hand): one reading an instant, the greatest where several fall together; levels in whole units."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("sku"), "ts", F.floor(F.col("value") / 10).cast("long").alias("on_hand"))
    return events.groupBy("sku", "ts").agg(F.max("on_hand").alias("on_hand"))


def stepped_sales(spark: SparkSession, folder: str) -> DataFrame:
    """(sku, ds, y, price, price_mixed, on_promotion): brands' daily units at a listed price that moves by quarter, as the tables hold no price levels.

    Every 13th counts as a day of mixed prices, and odd days cost a cent more.
    """
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sku"))
    lines = table(spark, folder, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("ds"), "l_quantity", "l_discount")
    units = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("sku", "ds")
    days = units.agg(F.sum("l_quantity").alias("y"), F.sum(F.when(F.col("l_discount") >= PROMOTION_DISCOUNT, F.col("l_quantity")).otherwise(0.0)).alias("promo_units"))
    step = (F.year("ds") * 4 + F.quarter("ds") + F.substring("sku", 7, 9).cast("int")) % 3
    return days.select(
        "sku", "ds", "y", (20 + 2 * step + 0.01 * (F.dayofmonth("ds") % 2)).alias("price"), (F.dayofmonth("ds") == 13).cast("int").alias("price_mixed"), (2 * F.col("promo_units") > F.col("y")).cast("int").alias("on_promotion")
    )

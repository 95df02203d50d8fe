"""Products sold inside other products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.staging import staged

#: Bundles inside bundles are followed this deep by expand(), and to their end by expand_whole().
MOST_DEPTH = 4
#: Rows of daily sales that one task of attribute() sorts and sums.
TASK_ROWS = 1 << 19


def normalise(parts: DataFrame) -> DataFrame:
    """(bundle, component, qty): one row per pair, without parts of no quantity and bundles inside themselves."""
    return parts.where("qty > 0 and bundle != component").groupBy("bundle", "component").agg(F.sum("qty").alias("qty"))


def expand(parts: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(bundle, sku, qty): what a bundle holds in the end; a loop ends at the product that closes it."""
    rows = parts.select("bundle", F.col("bundle").alias("sku")).distinct().withColumns({"qty": F.lit(1.0), "path": F.array().cast("array<bigint>")})
    inner = parts.select(F.col("bundle").alias("parent"), "component", F.col("qty").alias("times"))
    for _ in range(depth):
        opened = rows.join(inner, (F.col("sku") == F.col("parent")) & ~F.array_contains("path", F.col("sku")), "left")
        rows = opened.select(
            "bundle",
            F.coalesce("component", "sku").alias("sku"),
            (F.col("qty") * F.coalesce("times", F.lit(1.0))).alias("qty"),
            F.when(F.col("component").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("sku"))).alias("path"),
        )
    return rows.groupBy("bundle", "sku").agg(F.sum("qty").alias("qty"))


def expand_whole(parts: DataFrame) -> DataFrame:
    """As expand(), however deep bundles are nested: level by level, each written, until no bundle is left to open."""
    left = parts.select("bundle", F.col("bundle").alias("sku")).distinct().withColumns({"qty": F.lit(1.0), "path": F.array().cast("array<bigint>")})
    inner = parts.select(F.col("bundle").alias("parent"), "component", F.col("qty").alias("times"))
    held = left.select("bundle", "sku", "qty").limit(0)
    while not left.isEmpty():
        opened = staged(left.join(inner, (F.col("sku") == F.col("parent")) & ~F.array_contains("path", F.col("sku")), "left"))
        held = held.union(opened.where("component IS NULL").select("bundle", "sku", "qty"))
        left = opened.where("component IS NOT NULL").select("bundle", F.col("component").alias("sku"), (F.col("qty") * F.col("times")).alias("qty"), F.array_append("path", F.col("sku")).alias("path"))
    return held.groupBy("bundle", "sku").agg(F.sum("qty").alias("qty"))


def dependency(units: DataFrame, flat: DataFrame) -> DataFrame:
    """(sku, own_units, via_bundles, share_pct, bundle_driven) of products that sold through a bundle; units has (sku, units)."""
    pushed = flat.join(units.withColumnsRenamed({"sku": "bundle"}), "bundle").where("bundle != sku")
    via = pushed.groupBy("sku").agg(F.sum(F.col("qty") * F.col("units")).alias("via_bundles")).where("via_bundles > 0")
    rows = via.join(units, "sku", "left").withColumn("own_units", F.coalesce("units", F.lit(0.0)))
    share = 100 * F.col("via_bundles") / (F.col("own_units") + F.col("via_bundles"))
    return rows.select("sku", "own_units", "via_bundles", share.alias("share_pct"), (share >= 50).alias("bundle_driven"))


def faults(parts: DataFrame, known: DataFrame) -> DataFrame:
    """(bundle, component, fault): unknown bundles and components, and components that are bundles themselves; known has (sku)."""
    names = known.select(F.col("sku").alias("bundle"), F.lit(True).alias("has_bundle")), known.select(F.col("sku").alias("component"), F.lit(True).alias("has_component"))
    nested = parts.select(F.col("bundle").alias("component"), F.lit(True).alias("nested")).distinct()
    met = parts.select("bundle", "component").join(names[0], "bundle", "left").join(names[1], "component", "left").join(nested, "component", "left")
    fault = F.when(F.col("has_bundle").isNull(), "unknown bundle").when(F.col("has_component").isNull(), "unknown component").when(F.col("nested"), "nested")
    return met.withColumn("fault", fault).where("fault IS NOT NULL").select("bundle", "component", "fault")


def attribute(daily: DataFrame, flat: DataFrame, tasks: int | None = None) -> DataFrame:
    """(sku, ds, y, bundle_units, from_bundle_only): daily sales with the units that components sold through bundles, on days of their own too.

    daily has one row per product and day, so each day's bundle units are added once.  Bundles keep their rows.
    tasks: into how many daily was dealt by sku and ds; what bundles push is dealt alike, so that a task's memory follows its rows and not the table.
    """
    via = flat.where("bundle != sku").select(F.col("bundle"), F.col("sku").alias("component"), "qty")
    sold = daily.where("y > 0").select(F.col("sku").alias("bundle"), "ds", "y")
    sold = sold.repartition(tasks, "bundle") if tasks else sold
    parts = sold.join(via, "bundle").select(F.col("component").alias("sku"), "ds", (F.col("y") * F.col("qty")).alias("extra"))
    parts = parts.repartition(tasks, "sku", "ds") if tasks else parts
    pushed = parts.groupBy("sku", "ds").agg(F.sum("extra").alias("extra")).where("extra > 0")
    met = daily.select("sku", "ds", "y").join(pushed, ["sku", "ds"], "full_outer")
    return met.select("sku", "ds", (F.coalesce("y", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("y"), F.coalesce("extra", F.lit(0.0)).alias("bundle_units"), F.col("y").isNull().alias("from_bundle_only"))

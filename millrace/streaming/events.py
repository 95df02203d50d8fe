"""Stock readings and sales as streams; the same functions take batches.

Events have (event_id, user_id, event_type, ts, value, props), props being JSON; user_id stands for the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: How late an event may come.
LATENESS = "2 days"
#: Repeated levels are remembered for this long without a reading.
FORGET_MS = 7 * 24 * 3600 * 1000


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as they arrive, late events beyond LATENESS dropped by later windows; times without a zone are the session's."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def with_props(events: DataFrame) -> DataFrame:
    """Adds `k`, the number in the JSON of props; null where there is none."""
    return events.withColumn("k", F.from_json("props", "k int")["k"])


def readings_of(events: DataFrame) -> DataFrame:
    """(sku, ts, on_hand) of events as stock readings."""
    return events.select(F.col("user_id").alias("sku"), "ts", F.floor(F.col("value") / 10).cast("long").alias("on_hand"))


def hourly_sales(events: DataFrame, slide: str | None = None, width: str = "1 hour") -> DataFrame:
    """(sku, start, end, units): purchases per tumbling window, or per sliding one with a slide."""
    bought = events.where("event_type = 'purchase'")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return bought.groupBy(F.col("user_id").alias("sku"), window.alias("w")).agg(F.count("*").alias("units")).select("sku", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "units")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(sku, start, end, events): runs of events with no gap as long as `gap`; the end lies a gap after the last one."""
    found = events.groupBy(F.col("user_id").alias("sku"), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select("sku", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_events(events: DataFrame) -> DataFrame:
    """Events that come again within the lateness are dropped."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Readings whose level differs from the one before, across batches; a state holds the last level and time."""
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get if state.exists else (None, None)
    out = []
    # a product's readings of one micro-batch may come in several parts, in any order
    for ts, level in pd.concat([b[["ts", "on_hand"]] for b in batches]).sort_values("ts").itertuples(index=False):
        if last[1] is not None and ts.value <= last[1]:
            continue
        if last[0] is None or level != last[0]:
            out.append((key[0], ts, level))
        last = (int(level), ts.value)
    if last[0] is not None:
        state.update(last)
        state.setTimeoutDuration(FORGET_MS)
    yield pd.DataFrame(out, columns=["sku", "ts", "on_hand"])


def level_changes(readings: DataFrame) -> DataFrame:
    """(sku, ts, on_hand) of readings with a new level, from a stream; older readings than the last one seen are passed over."""
    return readings.groupBy("sku").applyInPandasWithState(_changes, "sku long, ts timestamp, on_hand long", "level long, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def keep_daily_sales(sales: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each day's newest counts (sku, ds, units, ts) to a table: a day is replaced as a whole, never added to.

    The table lies by day, and a batch rewrites only the days that it holds.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            held = spark.read.parquet(path).select("sku", "units", "ts", "ds").join(batch.select("ds").distinct(), "ds", "left_semi").select("sku", "units", "ts", "ds")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            held = batch.select("sku", "units", "ts", "ds").limit(0)
        newest = held.union(batch.select("sku", "units", "ts", "ds")).groupBy("sku", "ds").agg(F.max_by("units", "ts").alias("units"), F.max("ts").alias("ts")).select("sku", "units", "ts", "ds")
        settled = newest.checkpoint() if spark.sparkContext.getCheckpointDir() else newest
        settled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ds").parquet(path)
        batch.unpersist()

    return sales.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def level_at(readings: DataFrame, moments: DataFrame) -> DataFrame:
    """(sku, at, on_hand): the last reading at or before each moment (sku, at), in one sorted pass over both."""
    both = readings.select("sku", F.col("ts").alias("t"), F.lit(0).alias("asked"), "on_hand").union(moments.select("sku", F.col("at").alias("t"), F.lit(1).alias("asked"), F.lit(None).cast("long").alias("on_hand")))
    last = F.last("on_hand", ignorenulls=True).over(Window.partitionBy("sku").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("level", last).where("asked = 1").select("sku", F.col("t").alias("at"), F.col("level").alias("on_hand"))

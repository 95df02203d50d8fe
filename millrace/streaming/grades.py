"""The forecast log as one stream: sealed weeks, sales and price changes come in any order, and each week is graded once, when no more of it can come.

Messages are (sku, ts, kind, origin, predicted, lo, hi, count_from, daily, value): `entry` seals a week, `sale` counts `value` units at ts, `factor` scales the day of ts by `value`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.livelog import period_origin

#: How late a message may come.
LATENESS = "10 days"
DAYS = 7
_NULLS = {"predicted": "double", "lo": "double", "hi": "double", "count_from": "date", "daily": "array<double>", "value": "double"}
GRADED = "sku string, origin date, predicted double, original double, lo double, hi double, actual double, days_counted int, revised boolean"


def _messages(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (sku, ts, ...) as messages, the columns that they lack null."""
    filled = rows.withColumns({c: F.lit(None).cast(t) for c, t in _NULLS.items() if c not in rows.columns})
    origin = F.col("origin") if "origin" in rows.columns else period_origin(F.to_date("ts"))
    return filled.select(F.col("sku").cast("string").alias("sku"), F.col("ts").cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), origin.cast("date").alias("origin"), *_NULLS)


def messages(entries: DataFrame, sales: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """One stream or batch of entries (sku, ts, origin, predicted, lo, hi, count_from, daily), sales (sku, ts, value) and factors (sku, ts, value)."""
    every = _messages(entries, "entry").unionByName(_messages(sales, "sale"))
    return every if factors is None else every.unionByName(_messages(factors, "factor"))


def _grade(key: tuple, held: dict) -> tuple | None:
    """A week's row, if it was sealed: the prediction moves by what its scaled days moved, the band with it, and days before count_from don't count."""
    entry = held["entry"]
    if entry is None:
        return None
    daily = entry["daily"] or []
    moved = sum(y * (held["factors"].get(str(k), 1.0) - 1.0) for k, y in enumerate(daily))
    first = max(entry["from"], 0)
    actual = sum(held["sales"].get(str(k), 0.0) for k in range(first, DAYS))
    shift = lambda v: None if v is None else max(v + moved, 0.0)
    return (key[0], key[1], shift(entry["predicted"]), entry["predicted"], shift(entry["lo"]), shift(entry["hi"]), actual, DAYS - first, bool(daily) and any(f != 1.0 for f in held["factors"].values()))


def _absorb(held: dict, rows: pd.DataFrame, origin: pd.Timestamp) -> None:
    """Adds messages to a week; sums and products, so that their order does not matter; of two entries the one sealed first stands."""
    for r in rows.itertuples(index=False):
        day = str((r.ts.normalize() - origin).days)
        if r.kind == "sale":
            held["sales"][day] = held["sales"].get(day, 0.0) + float(r.value)
        elif r.kind == "factor":
            held["factors"][day] = held["factors"].get(day, 1.0) * float(r.value)
        elif r.kind == "entry" and (held["entry"] is None or r.ts.value < held["entry"]["ts"]):
            number = lambda v: None if pd.isna(v) else float(v)
            first = 0 if r.count_from is None or pd.isna(r.count_from) else (pd.Timestamp(r.count_from) - origin).days
            held["entry"] = {"ts": r.ts.value, "predicted": float(r.predicted), "lo": number(r.lo), "hi": number(r.hi), "from": min(first, DAYS - 1), "daily": None if r.daily is None else [float(v) for v in r.daily]}


def _week(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in GRADED.split(", ")]
    origin = pd.Timestamp(key[1])
    held = json.loads(state.get[0]) if state.exists else {"entry": None, "sales": {}, "factors": {}}
    if state.hasTimedOut:
        state.remove()
        row = _grade(key, held)
        yield pd.DataFrame([row] if row else [], columns=columns)
        return
    for rows in batches:
        _absorb(held, rows, origin)
    state.update((json.dumps(held),))
    state.setTimeoutTimestamp(int((origin + pd.Timedelta(days=DAYS)).value // 1_000_000))
    yield pd.DataFrame([], columns=columns)


def graded_weeks(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row (GRADED) per product and sealed week, given out once when the watermark has passed the week's end.

    A week's state holds seven sums, seven factors and its entry, and goes with the grade; later messages than `lateness` are dropped.  Weeks that nobody sealed vanish
    without a row.
    """
    keyed = stream.withWatermark("ts", lateness)
    return keyed.groupBy("sku", "origin").applyInPandasWithState(_week, GRADED, "week string", "append", GroupStateTimeout.EventTimeTimeout)


def graded_batch(every: DataFrame) -> DataFrame:
    """The same rows of a whole batch of messages, as joins and sums."""
    place = F.datediff("ts", "origin")
    entry = every.where("kind = 'entry'").groupBy("sku", "origin").agg(F.min_by(F.struct("predicted", "lo", "hi", "count_from", "daily"), "ts").alias("e")).select("sku", "origin", "e.*")
    first = F.least(F.greatest(F.coalesce(F.datediff("count_from", "origin"), F.lit(0)), F.lit(0)), F.lit(DAYS - 1))
    sold = every.where("kind = 'sale'").groupBy("sku", "origin", place.alias("k")).agg(F.sum("value").alias("y"))
    factor = every.where("kind = 'factor'").groupBy("sku", "origin", place.alias("k")).agg(F.product("value").alias("f"))
    days = entry.withColumn("first", first).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1)))).join(sold, ["sku", "origin", "k"], "left").join(factor, ["sku", "origin", "k"], "left")
    yhat = F.coalesce(F.try_element_at("daily", F.col("k") + 1), F.lit(0.0))
    moved = F.sum(yhat * (F.coalesce("f", F.lit(1.0)) - 1))
    counted = F.coalesce(F.sum(F.when(F.col("k") >= F.col("first"), F.col("y"))), F.lit(0.0))
    rows = days.groupBy("sku", "origin", "predicted", "lo", "hi", "first").agg(moved.alias("m"), counted.alias("actual"), F.max((F.coalesce("f", F.lit(1.0)) != 1) & F.col("daily").isNotNull()).alias("revised"))
    shift = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) + F.col("m"), F.lit(0.0)))
    return rows.select("sku", "origin", shift("predicted").alias("predicted"), F.col("predicted").alias("original"), shift("lo").alias("lo"), shift("hi").alias("hi"), "actual", (DAYS - F.col("first")).alias("days_counted"), "revised")

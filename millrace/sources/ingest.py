"""Sales sheets: columns, dates, repeats, collapsing, merging and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.staging import staged

#: A dialect is taken where this share of the dates that are given matches it.
DIALECT_SHARE = 0.8
ISO_DATE, SLASH_DATE = r"^\d{4}-\d{1,2}-\d{1,2}", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
#: Event kinds that a plan may hold.
EVENT_KINDS = ("promotion", "price_change_permanent", "price_change_temporary")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet, all columns as text, so that product codes keep their leading zeros."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def normalised_columns(sheet: DataFrame) -> DataFrame:
    """Names in lower case with `_` for blanks; the sheet must have date and units_sold, and gets one product where it names none."""
    named = sheet.toDF(*[c.strip().lower().replace(" ", "_") for c in sheet.columns])
    missing = {"date", "units_sold"} - set(named.columns)
    if missing:
        raise ValueError(f"the sheet lacks the columns {sorted(missing)}")
    return named if "sku" in named.columns else named.withColumn("sku", F.lit("SERIES"))


def date_dialect(sheet: DataFrame, column: str = "date") -> DataFrame:
    """(dialect, ambiguous): how the column's dates are written, from one pass over all of them.

    'iso'; else with slashes 'day_first' if some first number is over 12 and no second one, 'month_first' otherwise, ambiguous where nothing
    tells them apart; 'mixed' if neither form prevails, 'none' without dates.
    """
    text = F.trim(F.col(column).cast("string"))
    given = sheet.select(text.alias("d")).where("d <> ''")
    a, b = (F.expr(f"try_cast(regexp_extract(d, '{SLASH_DATE}', {i}) AS int)".replace("\\", "\\\\")) for i in (1, 2))
    counts = given.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("d").rlike(ISO_DATE)).alias("iso"),
        F.count_if(F.col("d").rlike(SLASH_DATE)).alias("slash"),
        F.coalesce(F.max(a), F.lit(0)).alias("first"),
        F.coalesce(F.max(b), F.lit(0)).alias("second"),
    )
    slashed = F.col("slash") >= DIALECT_SHARE * F.col("n")
    dialect = (
        F.when(F.col("n") == 0, "none")
        .when(F.col("iso") >= DIALECT_SHARE * F.col("n"), "iso")
        .when(slashed & (F.col("first") > 12) & (F.col("second") <= 12), "day_first")
        .when(slashed, "month_first")
        .otherwise("mixed")
    )
    return counts.select(dialect.alias("dialect"), ((F.col("n") > 0) & slashed & (F.col("first") <= 12) & (F.col("second") <= 12)).alias("ambiguous"))


def parsed_dates(sheet: DataFrame, column: str = "date") -> DataFrame:
    """The sheet with `ds`, its dates by the dialect of the whole column; what can't be read is null."""
    text = F.trim(F.col(column).cast("string"))
    met = sheet.withColumn("_text", text).join(F.broadcast(date_dialect(sheet, column)))
    part = lambda i: F.regexp_extract("_text", SLASH_DATE, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    day_first = F.col("dialect") == "day_first"
    day, month = (F.lpad(F.when(day_first, part(i)).otherwise(part(j)), 2, "0") for i, j in ((1, 2), (2, 1)))
    slashed = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    iso = F.try_to_timestamp(F.regexp_extract("_text", r"^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("yyyy-M-d")).cast("date")
    ds = F.when(F.col("_text").rlike(SLASH_DATE), slashed).when(F.col("_text").rlike(ISO_DATE), iso)
    return met.withColumn("ds", ds).drop("_text", "dialect", "ambiguous")


def numbered(sheet: DataFrame, order_col: str) -> DataFrame:
    """Adds `_i`, the row's place from 0 in the order of order_col, without bringing the sheet into one task.

    Rows are dealt by ranges of the order and numbered within their range; the ranges' sizes, one row each, tell where each begins.
    """
    dealt = sheet.repartitionByRange(order_col).sortWithinPartitions(order_col).withColumn("_m", F.monotonically_increasing_id())
    placed = staged(dealt.withColumns({"_part": F.shiftright("_m", 33).cast("int"), "_k": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row to a range
    return placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("_i", F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def repeated_block(sheet: DataFrame, order_col: str) -> DataFrame:
    """(copies): how many times, two to four, a sheet repeats as a whole in the order of order_col; 1 if it doesn't.

    Row i must equal row i modulo the block's length, which is one aggregate by that number.
    """
    return _copies(numbered(sheet, order_col), order_col)


def _copies(rows: DataFrame, order_col: str) -> DataFrame:
    columns = [c for c in rows.columns if c not in (order_col, "_i")]
    digest = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))
    hashed = rows.select(F.col("_i").alias("i"), digest.alias("h"))
    size = F.broadcast(hashed.agg(F.count("*").alias("n")))
    tried = hashed.join(size).withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).where("n >= 2 AND n % k = 0")
    tried = tried.withColumn("m", (F.col("n") / F.col("k")).cast("long"))
    same = tried.withColumn("j", F.col("i") % F.col("m")).groupBy("k", "j").agg((F.min("h") == F.max("h")).alias("same"))
    whole = same.groupBy("k").agg(F.bool_and("same").alias("whole")).where("whole")
    return whole.agg(F.coalesce(F.min("k"), F.lit(1)).alias("copies"))


def without_repeats(sheet: DataFrame, order_col: str) -> DataFrame:
    """The first block of a sheet that repeats as a whole; rows next to each other that are alike are sales and stay."""
    rows = numbered(sheet, order_col)
    size = rows.agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(_copies(rows, order_col))).join(F.broadcast(size)).where("_i < _n div copies").drop("_i", "_n", "copies")


def collapsed(sheet: DataFrame, order_col: str, *last: str) -> DataFrame:
    """(sku, ds, y, last...): one row per product and day, units summed (none below 0, unreadable ones 0), other columns from the last row."""
    units = F.greatest(F.coalesce(F.expr("try_cast(units_sold AS double)"), F.lit(0.0)), F.lit(0.0))
    rows = sheet.where("ds IS NOT NULL").withColumn("u", units)
    return rows.groupBy("sku", "ds").agg(F.sum("u").alias("y"), *(F.max_by(c, order_col).alias(c) for c in last))


def upsert(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """History with fresh rows, which win on the same product and day."""
    return history.join(fresh.select("sku", "ds"), ["sku", "ds"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def quality_report(sheet: DataFrame) -> DataFrame:
    """(rows, unreadable_dates, unreadable_units, negative_units, blank_skus, products) of a parsed sheet."""
    units = F.expr("try_cast(units_sold AS double)")
    return sheet.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("ds").isNull()).alias("unreadable_dates"),
        F.count_if(units.isNull()).alias("unreadable_units"),
        F.count_if(units < 0).alias("negative_units"),
        F.count_if(F.coalesce(F.trim("sku"), F.lit("")) == "").alias("blank_skus"),
        F.count_distinct("sku").alias("products"),
    )


def fingerprint_parts(daily: DataFrame) -> DataFrame:
    """(sku, rows, first, last, units): what a measurement was taken on."""
    return daily.groupBy("sku").agg(F.count("*").alias("rows"), F.min("ds").alias("first"), F.max("ds").alias("last"), F.round(F.coalesce(F.sum("y"), F.lit(0.0)), 3).alias("units"))


def fingerprint(parts: DataFrame) -> DataFrame:
    """(products, digest): two sums of the parts' hashes, whatever their order, as one SHA-256."""
    h = F.sha2(F.concat_ws("|", "sku", F.col("rows").cast("string"), F.col("first").cast("string"), F.col("last").cast("string"), F.format_string("%.3f", "units")), 256)
    folded = parts.select(F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(h, 13, 12), 16, 10).cast("decimal(38,0)").alias("b"))
    sums = folded.agg(F.count("*").alias("products"), F.coalesce(F.sum("a"), F.lit(0)).cast("decimal(38,0)").alias("a"), F.coalesce(F.sum("b"), F.lit(0)).cast("decimal(38,0)").alias("b"))
    return sums.select("products", F.sha2(F.concat_ws("|", F.col("products").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def grew_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """(grew): no product gone, the same first day, and last day, rows and units not lower."""
    later = new.select("sku", *(F.col(c).alias(f"new_{c}") for c in ("rows", "first", "last", "units")))
    kept = (F.col("new_first") == F.col("first")) & (F.col("new_last") >= F.col("last")) & (F.col("new_rows") >= F.col("rows")) & (F.col("new_units") >= F.col("units"))
    return old.join(later, "sku", "left").agg(F.coalesce(F.bool_and(F.coalesce(kept, F.lit(False))), F.lit(True)).alias("grew"))


def product_list(daily: DataFrame) -> DataFrame:
    """(sku, first, last, days, selling_days, units): one row per product."""
    return daily.groupBy("sku").agg(
        F.min("ds").alias("first"), F.max("ds").alias("last"), (F.datediff(F.max("ds"), F.min("ds")) + 1).alias("days"), F.count_if(F.col("y") > 0).alias("selling_days"), F.sum("y").alias("units")
    )


def monthly_history(daily: DataFrame) -> DataFrame:
    """(sku, month, units, days, complete): units by calendar month; the last month is complete if its last day is there."""
    months = daily.groupBy("sku", F.trunc("ds", "month").alias("month")).agg(F.sum("y").alias("units"), F.count_if(F.col("y") > 0).alias("days"))
    end = F.broadcast(daily.agg(F.max("ds").alias("end")))
    return months.join(end).select("sku", "month", "units", "days", (F.last_day("month") <= F.col("end")).alias("complete"))


def recent_days(daily: DataFrame, days: int = 30) -> DataFrame:
    """(sku, ds, y) of the last `days` days of each product."""
    last = daily.groupBy("sku").agg(F.max("ds").alias("end"))
    return daily.join(last, "sku").where(F.datediff("end", "ds") < days).select("sku", "ds", "y")


def event_faults(events: DataFrame) -> DataFrame:
    """(event_id, fault) of events that a plan must not take: unknown kind, no start, end before start, no price of 0 or more, or discount outside 0 to 100."""
    priced = F.col("kind").isin("price_change_permanent", "price_change_temporary")
    fault = (
        F.when(~F.coalesce(F.col("kind").isin(*EVENT_KINDS), F.lit(False)), "kind")
        .when(F.col("start").isNull(), "date")
        .when(F.col("end") < F.col("start"), "order")
        .when(priced & ~F.coalesce((F.col("new_price") >= 0) & ~F.isnan("new_price"), F.lit(False)), "price")
        .when((F.col("discount_pct") < 0) | (F.col("discount_pct") > 100), "discount")
    )
    return events.withColumn("fault", fault).where("fault IS NOT NULL").select("event_id", "fault")


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replaces a table of parquet files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """Replaces a folder of CSV files with headers."""
    df.write.mode("overwrite").option("header", True).csv(path)

"""One-off rushes: weeks far above normal that ended, that no past year had, and that must not lift the everyday level.

A product's weekly rates are one array, oldest first, null where a week holds too few days; its last week ends on the last day of the calendar, which
all products share.  Ranges of weeks are places in that array, counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import seasonality
from millrace.sources.staging import staged

#: A rush week is at this multiple of the median of NEAR_WEEKS weeks on either side, the next one left out, of which LEAST_NEAR are known; two in a row make a run.
RUSH, NEAR_WEEKS, LEAST_NEAR, LEAST_WEEKS = 1.5, 12, 4, 2
#: Weeks this far above normal belong to a rush's tails; longer runs are seasons; so many weeks after it are normal again.
TAIL, MOST_WEEKS, AFTER_WEEKS, SIDE_WEEKS = 1.2, 10, 2, 8
#: A rush is so many times what the weeks usually are; past weeks under LAST_NORMAL were normal.
UNUSUAL, LAST_NORMAL = 2.0, 1.3
#: The excess is so many deviations of a count with that dispersion.
DEVIATIONS, DISPERSION = 3.0, 2.0
#: Years back, weeks of a year, and the shift within which a past year's weeks may match.
YEARS, YEAR_WEEKS, SLACK = 3, 52, 3
#: Peers that must tell, and how far above normal their median must lie.
LEAST_PEERS, PEER_RUSH = 2, TAIL + 0.1


def weekly_arrays(filled: DataFrame) -> DataFrame:
    """(sku, end, rates): one row per product."""
    last = filled.groupBy("sku").agg(F.max("ds").alias("end"), (F.floor(F.datediff(F.max("ds"), F.min("ds")) / 7) + 1).cast("int").alias("n"))
    by_week = seasonality.weekly_rates(filled).groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("w", "rate"))).alias("by_week"))
    rates = F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: F.try_element_at("by_week", p - F.col("n")))
    return last.join(by_week, "sku").select("sku", "end", rates.alias("rates"))


def _known(rates: Column, first: Column, last: Column) -> Column:
    """The known rates from place first to last; places outside the array are passed over."""
    start = F.greatest(first, F.lit(1))
    return F.filter(F.slice(rates, start, F.greatest(last - start + 1, F.lit(0))), lambda x: x.isNotNull())


def _median(values: Column) -> Column:
    """The middle of two values or more, else null."""
    n, ordered = F.size(values), F.array_sort(values)
    middle = (F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.when(n >= 2, middle)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _beside(rates: Column, first: Column, last: Column) -> Column:
    """The weeks on either side, those next to the range left out."""
    return F.concat(_known(rates, first - SIDE_WEEKS, first - 2), _known(rates, last + 2, last + 1 + SIDE_WEEKS))


def _reach(values: Column, least: Column) -> Column:
    """How many values from the first on reach `least` without a gap."""
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, x: F.struct(F.when(s["on"] & F.coalesce(x >= least, F.lit(False)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & F.coalesce(x >= least, F.lit(False))).alias("on"))
    return F.aggregate(values, state, step, lambda s: s["n"])


def ratios(ranges: DataFrame) -> DataFrame:
    """Adds `ratio` to rows (rates, first, last): the mean of the weeks over the median of those beside; null where it can't be told."""
    rates, first, last = F.col("rates"), F.col("first"), F.col("last")
    inside = (first >= 1) & (last <= F.size(rates))
    met = ranges.withColumns({"_in": F.when(inside, _known(rates, first, last)), "_normal": F.when(inside, _median(_beside(rates, first, last)))})
    enough = F.size("_in") >= F.greatest(F.lit(1), F.floor((last - first + 1) / 2))
    return met.withColumn("ratio", F.when(enough & (F.col("_normal") > 0), _mean(F.col("_in")) / F.col("_normal"))).drop("_in", "_normal")


def past_years(ranges: DataFrame, *keys: str) -> DataFrame:
    """(*keys, past): how far above normal the same weeks usually are: per past year the best match within SLACK weeks, then the middle of the years.

    ranges has the keys and (rates, first, last).  Rows without a year before are left out.
    """
    shifts = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(s - YEAR_WEEKS * y).alias("shift")) for y in range(1, YEARS + 1) for s in range(-SLACK, SLACK + 1)])
    key = F.struct(*keys).alias("key")
    moved = ranges.select(key, "rates", "first", "last", F.inline(shifts)).withColumns({"first": F.col("first") + F.col("shift"), "last": F.col("last") + F.col("shift")}).where("first >= 1")
    best = ratios(moved).where("ratio IS NOT NULL").groupBy("key", "year").agg(F.max("ratio").alias("best"))
    return best.groupBy("key").agg(F.median("best").alias("past")).select("key.*", "past")


def runs(arrays: DataFrame) -> DataFrame:
    """(sku, s, e): places of the first and last week of two or more rush weeks in a row."""
    near = lambda p: F.concat(_known(F.col("rates"), p - NEAR_WEEKS - 1, p - 2), _known(F.col("rates"), p + 2, p + NEAR_WEEKS + 1))
    usual = F.transform(F.sequence(F.lit(1), F.size("rates")), lambda p: F.when(F.size(near(p)) >= LEAST_NEAR, _median(near(p))))
    weeks = arrays.select("sku", F.posexplode(F.arrays_zip(F.col("rates").alias("rate"), usual.alias("usual")))).select("sku", (F.col("pos") + 1).alias("p"), "col.*")
    hot = weeks.where((F.col("usual") > 0) & (F.col("rate") >= RUSH * F.col("usual")))
    run = F.col("p") - F.row_number().over(Window.partitionBy("sku").orderBy("p"))
    return hot.withColumn("run", run).groupBy("sku", "run").agg(F.min("p").alias("s"), F.max("p").alias("e")).where(F.col("e") - F.col("s") + 1 >= LEAST_WEEKS).drop("run")


def candidates(arrays: DataFrame) -> DataFrame:
    """(sku, end, rates, first, last, base, got, expected, ratio): runs widened by their tails that are over, have something ordinary before them, and lie beyond chance."""
    size = F.size("rates")
    met = arrays.join(runs(arrays), "sku")
    met = met.withColumn("base", _median(_beside(F.col("rates"), F.col("s"), F.col("e")))).where("base > 0")
    least = TAIL * F.col("base")
    before = F.reverse(F.slice("rates", F.lit(1), F.col("s") - 1))
    after = F.slice("rates", F.col("e") + 1, F.greatest(size - F.col("e"), F.lit(0)))
    met = met.withColumns({"first": F.col("s") - _reach(before, least), "last": F.col("e") + _reach(after, least)}).where(F.col("last") - F.col("first") + 1 <= MOST_WEEKS)
    over = _known(F.col("rates"), F.col("last") + 1, F.col("last") + AFTER_WEEKS)
    met = met.where((F.size(over) == AFTER_WEEKS) & F.forall(over, lambda x: x < least) & (F.size(_known(F.col("rates"), F.col("first") - SIDE_WEEKS, F.col("first") - 1)) >= 2))
    weeks = _known(F.col("rates"), F.col("first"), F.col("last"))
    met = met.withColumns({"expected": 7.0 * F.size(weeks) * F.col("base"), "got": 7.0 * F.aggregate(weeks, F.lit(0.0), lambda a, x: a + x)})
    beyond = F.col("got") - F.col("expected") >= DEVIATIONS * F.sqrt(DISPERSION * F.greatest("expected", F.lit(1.0)))
    met = met.where(beyond).withColumn("ratio", F.col("got") / F.greatest("expected", F.lit(1e-9)))
    return met.select("sku", "end", "rates", "first", "last", "base", "got", "expected", "ratio")


def peer_verdict(asked: DataFrame, arrays: DataFrame, peers: DataFrame) -> DataFrame:
    """(sku, first, last, one_off, past) for ranges (sku, first, last, n), n the product's weeks; peers has (sku, peer).

    Peers that can tell were high in the same weeks, and usually are or are not.  High in past years too: a season.  High now only: a one-off, past 1.  Else, and with
    fewer than LEAST_PEERS, no row.
    """
    met = asked.join(peers.select("sku", "peer"), "sku").join(arrays.select(F.col("sku").alias("peer"), "rates"), "peer")
    # the same weeks from the end, in the peer's own array
    placed = met.withColumns({"own_first": F.col("first"), "own_last": F.col("last")})
    moved = placed.withColumns({"first": F.col("first") - F.col("n") + F.size("rates"), "last": F.col("last") - F.col("n") + F.size("rates")}).where("first >= 1")
    keys = ("sku", "own_first", "own_last", "peer")
    both = ratios(moved).where("ratio IS NOT NULL").select(*keys, "ratio").join(past_years(moved, *keys), [*keys])
    told = both.groupBy("sku", "own_first", "own_last").agg(F.median("ratio").alias("now"), F.median("past").alias("usual"), F.count("*").alias("peers")).where(F.col("peers") >= LEAST_PEERS)
    season, one_off = F.col("usual") >= PEER_RUSH, F.col("now") >= PEER_RUSH
    rows = told.where(season | one_off)
    return rows.select("sku", F.col("own_first").alias("first"), F.col("own_last").alias("last"), (~season).alias("one_off"), F.when(season, F.col("usual")).otherwise(1.0).alias("past"))


def find(filled: DataFrame, peers: DataFrame) -> DataFrame:
    """(sku, start, end, weeks, ratio, past, source, units, base, rates, first, last): the one-off rushes.

    A product's own past years decide; without one its peers do, and where they can't tell nothing is taken for a rush.
    """
    keys = ("sku", "first", "last")
    arrays = staged(weekly_arrays(filled))  # a row to a product
    found = staged(candidates(arrays))
    own = past_years(found.dropDuplicates([*keys]), *keys)
    judged = found.join(own, [*keys], "left")
    unsure = judged.where("past IS NULL").select(*keys, F.size("rates").alias("n")).distinct()
    told = peer_verdict(unsure, arrays, peers).where("one_off").select(*keys, F.col("past").alias("told"))
    both = judged.join(told, [*keys], "left").withColumn("source", F.when(F.col("past").isNotNull(), "own").otherwise("similar products")).withColumn("past", F.coalesce("past", "told"))
    unusual = both.where("past IS NOT NULL").where(F.col("ratio") >= UNUSUAL * F.greatest("past", F.lit(1.0))).withColumn("past", F.when(F.col("past") < LAST_NORMAL, 1.0).otherwise(F.col("past")))
    back = lambda place: 7 * (F.size("rates") - F.col(place))
    return unusual.select(
        "sku", F.date_sub("end", back("first") + 6).alias("start"), F.date_sub("end", back("last")).alias("end"), (F.col("last") - F.col("first") + 1).alias("weeks"), "ratio", "past", "source",
        (F.col("got") - F.col("expected") * F.col("past")).alias("units"), "base", "rates", "first", "last",
    )


def factors(rushes: DataFrame) -> DataFrame:
    """(sku, start, end, factor): per week of a rush what its days are divided by; what past years had stays."""
    weeks = F.filter(F.transform(F.sequence("first", "last"), lambda p: F.struct((p - F.col("first")).alias("k"), F.element_at("rates", p).alias("rate"))), lambda w: w["rate"].isNotNull())
    rows = rushes.select("sku", "start", "base", "past", F.inline(weeks))
    factor = F.greatest(F.col("rate") / (F.col("base") * F.col("past")), F.lit(1.0))
    first = F.expr("date_add(start, 7 * k)")
    return rows.select("sku", first.alias("start"), F.date_add(first, 6).alias("end"), factor.alias("factor"))

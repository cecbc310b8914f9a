"""Joins by time, subtotals, sets of rows and sketches that Spark has no operator or no scalable plan for.

Cases: a row whose key or time is null matches nothing (left sides keep it, unmatched). Empty tables give no rows, or only unmatched ones.
Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.names import unused
from vellumine.plans.scratch import Scratch


def _bucket(df: DataFrame, ts: str, seconds: int) -> Column:
    """Number of the span of time; of local times without a zone by the clock itself, which no change of the session's zone disturbs."""
    local = df.schema[ts].dataType.typeName() == "timestamp_ntz"
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)) if local else F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.floor(epoch / seconds)


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, seconds: int = 86_400) -> DataFrame:
    """left with the last known `value` of right with the same key at or before its time (as `as_of`, or that name with underscores if left has it; null if none): rows of right whose value is null tell nothing. Of equal times the greatest
    value counts.

    Rows are dealt by key and bucket of time, so one key's rows do not meet in one task; what a bucket begins with comes from the buckets before it,
    of which there is one row for each key and bucket.
    """
    last = F.max_by("v", F.struct("t", "v"))
    known = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(value).alias("v"))
    known = known.withColumn("b", _bucket(known, "t", seconds))
    ask = left.select(F.struct(*left.columns).alias("row"), F.col(key).alias("k"), F.col(ts).alias("t"))
    ask = ask.withColumn("b", _bucket(ask, "t", seconds))
    none = F.lit(None).cast(known.schema["v"].dataType)
    both = known.select("k", "b", "t", "v", F.lit(None).cast(ask.schema["row"].dataType).alias("row")).unionByName(ask.select("k", "b", "t", none.alias("v"), "row"))
    # right rows first at equal times, the greatest value last
    within = Window.partitionBy("k", "b").orderBy("t", F.col("row").isNotNull(), F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("here", F.last("v", ignorenulls=True).over(within)).where("row is not null")
    ends = known.groupBy("k", "b").agg(last.alias("end"))
    marks = ends.unionByName(ask.where("k is not null and t is not null").select("k", "b", none.alias("end")).distinct()).groupBy("k", "b").agg(F.max("end").alias("end"))
    before = marks.withColumn("start", F.last("end", ignorenulls=True).over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("k", "b", "start")
    return own.join(before, ["k", "b"], "left").select("row.*", F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.coalesce("here", "start")).alias(unused("as_of", left)))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, seconds: int = 3600) -> DataFrame:
    """Points and the intervals of the same key that hold them (start <= time < end), as a hash join on key and bucket of time: each interval is sent to the buckets
    that it touches, so `seconds` should be near the intervals' length. Intervals with start >= end hold nothing. Columns other than the key must have names of their own."""
    b = unused("bucket", points, intervals)
    p = points.withColumn(b, _bucket(points, ts, seconds))
    i = intervals.where(F.col(start) < F.col(end)).withColumn(b, F.explode(F.sequence(_bucket(intervals, start, seconds), _bucket(intervals, end, seconds))))
    return p.join(i, [key, b]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop(b)


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points and the ranges that hold their value (low <= value < high), as a hash join on value // width: no nested loop. Empty ranges hold nothing."""
    b = unused("bucket", points, ranges)
    p = points.withColumn(b, F.floor(F.col(value) / width))
    r = ranges.where(F.col(low) < F.col(high)).withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, b).where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop(b)


def subtotals(df: DataFrame, cols: list[str], **sums: str) -> DataFrame:
    """Counts and sums (name=column) by all prefixes of cols; level is the number of columns summed away."""
    out = df.rollup(*cols).agg(F.count("*").alias("n"), *(F.round(F.sum(c), 2).alias(name) for name, c in sums.items()), F.grouping_id().alias("g"))
    return out.withColumn("level", F.length(F.replace(F.bin("g"), F.lit("0"), F.lit(""))).cast("long")).drop("g")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """side and the columns of a: distinct rows that only a has, only b has, or both have."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b"))).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


def sketched(df: DataFrame, by: str, item: str, number: str) -> DataFrame:
    """For each group, about how many distinct items (HyperLogLog) and the middle and ninth tenth of a number (KLL), in state that does not grow with the rows."""
    return df.groupBy(by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(item)).alias("items"), F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(number), F.lit(0.5)).alias("median"), F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(number), F.lit(0.9)).alias("p90"))


def last_rows(left: DataFrame, right: DataFrame, key: str, ts: str, n: int, order: str, seconds: int = 86_400) -> DataFrame:
    """left's row as `row`, and as `past` an array of the last n rows of right with the same key at or before its time, the latest first; of equal times the greatest `order` is later. Rows with a null key or time have an empty array.

    What LATERAL (... ORDER BY ... LIMIT n) says row by row, without pairing a key's rows: rows are dealt by key and bucket of time; within a bucket a row finds how many of right's rows came before it and takes the last by
    their number, and what it lacks comes from the last n rows of the buckets before, kept as one array for each bucket. So one key's rows do not meet in one task, and no more than n rows of right go to a row of left.
    """
    held = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"), F.struct(*right.columns).alias("r"))
    known = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(order).alias("o"), held.alias("h"))
    known = known.withColumn("b", _bucket(known, "t", seconds)).withColumn("nth", F.row_number().over(Window.partitionBy("k", "b").orderBy("t", "o", "h")))
    ask = left.select(F.monotonically_increasing_id().alias("id"), F.struct(*left.columns).alias("row"), F.col(key).alias("k"), F.col(ts).alias("t"))
    ask = Scratch(left.sparkSession, "last").write(ask.withColumn("b", _bucket(ask, "t", seconds)), "asked")  # ids hold from here on
    whole = ask.where("k is not null and t is not null").select("id", "k", "b", "t")
    # how many of right's rows in the bucket are not later: they sort before the row that asks
    both = known.select("k", "b", "t", F.lit(None).cast("long").alias("id")).unionByName(whole)
    upto = Window.partitionBy("k", "b").orderBy("t", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("upto", F.count(F.when(F.col("id").isNull(), 1)).over(upto)).where("id is not null").select("id", "k", "b", "upto")
    near = counted.where("upto > 0").withColumn("nth", F.explode(F.sequence(F.col("upto"), F.greatest(F.col("upto") - (n - 1), F.lit(1).cast("long"))))).select("id", "k", "b", F.col("nth").cast("int").alias("nth"))
    near = near.join(known.select("k", "b", "nth", "h"), ["k", "b", "nth"]).select("id", "h")
    # the last n rows of each bucket, then of all buckets before one: each of them has a row at least, so n of them are enough
    size = known.groupBy("k", "b").agg(F.max("nth").alias("size"))
    ends = known.join(size, ["k", "b"]).where(F.col("nth") > F.col("size") - n).groupBy("k", "b").agg(F.collect_list("h").alias("ends"))
    marks = ends.unionByName(whole.select("k", "b").distinct().select("k", "b", F.lit(None).cast(ends.schema["ends"].dataType).alias("ends"))).groupBy("k", "b").agg(F.first("ends", ignorenulls=True).alias("ends"))
    place = Window.partitionBy("k").orderBy("b")
    marks = marks.withColumn("full", F.count("ends").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    carried = ends.withColumn("full", F.row_number().over(place)).withColumn("before", F.slice(F.sort_array(F.flatten(F.collect_list("ends").over(place.rowsBetween(-(n - 1), 0))), asc=False), 1, n)).select("k", F.col("full").cast("long").alias("full"), "before")
    start = marks.join(carried, ["k", "full"]).select("k", "b", "before")
    far = counted.where(F.col("upto") < n).join(start, ["k", "b"]).select("id", F.explode(F.slice("before", F.lit(1), (n - F.col("upto")).cast("int"))).alias("h"))
    past = near.unionByName(far).groupBy("id").agg(F.sort_array(F.collect_list("h"), asc=False).alias("found"))
    return ask.join(past, "id", "left").select("row", F.transform(F.coalesce("found", F.array().cast(past.schema["found"].dataType)), lambda h: h["r"]).alias("past"))


def moving(df: DataFrame, key: str, ts: str, value: str, seconds: int, width: int | None = None) -> DataFrame:
    """df with `n` and `total`, the count and sum of `value` over the rows of the same key from `seconds` before the row's time up to it, rows of equal time included (RANGE BETWEEN ... PRECEDING AND CURRENT ROW); names that df has get underscores.

    A window over a key would put all of its rows in one task. Rows are dealt by key and bucket of time (`width` seconds, by default and at most as wide as the frame) instead, and the frame is the sum of three: the row's bucket up to the row,
    whole buckets between from one row of sums each, and the end of the bucket in which the frame starts, where the row asks at the frame's start. Both sums within a bucket only ever grow, from its beginning in the order of time and from its end
    against it, so each row is added once: a frame that slides, or that ends at the last row, would be added up anew for each row. Null values are not counted, null keys are a key, rows with a null time have null.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)) if df.schema[ts].dataType.typeName() == "timestamp_ntz" else F.unix_micros(F.col(ts).cast("timestamp"))
    rows = Scratch(df.sparkSession, "moving").write(df.select(F.monotonically_increasing_id().alias("id"), F.struct(*df.columns).alias("row"), F.struct(key).alias("k"), micros.alias("at"), F.col(value).cast("double").alias("v")), "rows")
    # a bucket that is no wider than the frame never holds a frame's start and its end; a frame of no length is a bucket of one moment
    width = min(width or seconds, seconds)
    bucket = lambda at: F.floor(at / (width * 1_000_000)) if width else at
    own = rows.where("at is not null").select("id", "k", "at", "v", bucket(F.col("at")).alias("b"), bucket(F.col("at") - seconds * 1_000_000).alias("first"))
    upto = Window.partitionBy("k", "b").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    head = own.select("id", "k", "b", "first", F.count("v").over(upto).alias("n0"), F.sum("v").over(upto).alias("s0"))
    sums = own.groupBy("k", "b").agg(F.count("v").alias("n1"), F.sum("v").alias("s1"))
    # the whole buckets between are as many for all rows, give or take one: frames of so many buckets, by number
    spans = {m for m in (seconds // width - 1, -(-seconds // width) - 1) if m > 0} if width else set()
    frame = lambda m: Window.partitionBy("k").orderBy("b").rangeBetween(-m, -1)
    between = sums.select("k", "b", *(F.struct(F.sum("n1").over(frame(m)).alias("n1"), F.sum("s1").over(frame(m)).alias("s1")).alias(f"m{m}") for m in spans))
    tail = Window.partitionBy("k", "b").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    asks = own.where("first < b").select("id", "k", (F.col("at") - seconds * 1_000_000).alias("at"), F.lit(None).cast("double").alias("v"), F.col("first").alias("b"))
    ends = own.select(F.lit(None).cast("long").alias("id"), "k", "at", "v", "b").unionByName(asks).select("id", F.count("v").over(tail).alias("n2"), F.sum("v").over(tail).alias("s2")).where("id is not null")
    span = F.col("b") - F.col("first") - 1  # whole buckets between
    middle = lambda part: F.coalesce(F.lit(None).cast("double"), *(F.when(span == m, F.col(f"m{m}")[part].cast("double")) for m in spans))
    each = head.join(between, ["k", "b"]).join(ends, "id", "left").select("id", (F.col("n0") + F.coalesce(middle("n1"), F.lit(0)) + F.coalesce("n2", F.lit(0))).cast("long").alias("n"), _plus(F.col("s0"), middle("s1"), F.col("s2")).alias("total"))
    return rows.join(each, "id", "left").select("row.*", F.col("n").alias(unused("n", df)), F.col("total").alias(unused("total", df)))


def _plus(*parts: Column) -> Column:
    """The sum of those that are not null; null if all are."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))

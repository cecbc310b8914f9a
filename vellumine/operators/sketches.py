"""Sketches that are stored once and merged later: distinct sets with set operations (theta), counts of single items (count-min), and the most frequent items; and distinct sets kept whole, whose counts are exact.

Cases: null items are not counted; a null group is a group; empty tables give no rows (or zero, for totals). Repeated rows count as often as they stand in counts, once in sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.names import unused


def set_sketches(df: DataFrame, item: str, *by: str, lg_k: int = 12) -> DataFrame:
    """by and `sketch`: a theta sketch of the group's distinct items, exact up to about 2^lg_k of them and then within about 2 / sqrt(2^lg_k); to be stored."""
    return df.groupBy(*by).agg(F.theta_sketch_agg(item, lg_k).alias("sketch"))


def audience(sketches: DataFrame, kind: str, has: str, lacks: str, *by: str, lg_k: int = 12) -> DataFrame:
    """by, and about how many items are in sketches of kind `has` (`has`), of kind `lacks` (`lacks`), in both (`both`) and only in the first (`only`), from stored sketches merged over all their other columns. Rows of the items are not read again."""
    none = F.theta_sketch_agg(F.lit(None).cast("long"), lg_k)
    side = lambda value: F.coalesce(F.theta_union_agg(F.when(F.col(kind) == value, F.col("sketch")), lg_k), none)
    merged = sketches.groupBy(*by).agg(side(has).alias("a"), side(lacks).alias("b"))
    size = F.theta_sketch_estimate
    return merged.select(*by, size("a").alias("has"), size("b").alias("lacks"), size(F.theta_intersection("a", "b")).alias("both"), size(F.theta_difference("a", "b")).alias("only"))


def item_sets(df: DataFrame, item: str, *by: str) -> DataFrame:
    """by and the item's column, once for each distinct item of a group; to be stored. As many rows as there are items of groups, so for counts that must be exact."""
    return df.select(*by, item).where(F.col(item).isNotNull()).distinct()


def audience_exact(sets: DataFrame, item: str, kind: str, has: str, lacks: str, *by: str) -> DataFrame:
    """What `audience` tells, exactly, from the rows of `item_sets`; a group is there if it has an item of either kind. Items meet their sides by one hash aggregate, of two flags for each, so no set is held in one place."""
    a, b = unused("a", sets), unused("b", sets)
    sides = sets.where(F.col(kind).isin(has, lacks)).groupBy(*by, item).agg(F.max(F.col(kind) == has).alias(a), F.max(F.col(kind) == lacks).alias(b))
    counted = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    return sides.groupBy(*by).agg(counted(F.col(a), "has"), counted(F.col(b), "lacks"), counted(F.col(a) & F.col(b), "both"), counted(F.col(a) & ~F.col(b), "only"))


def _cells(item: Column, width: int, depth: int) -> Column:
    """(row, cell) of an item in each of the depth rows."""
    return F.array(*(F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), item), F.lit(width)).alias("cell")) for i in range(depth)))


def shape_for(error: float, risk: float) -> tuple[int, int]:
    """Width and depth with which an estimate is too high by more than error x all rows with a chance of at most risk."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / risk))


def count_min(df: DataFrame, item: str, error: float = 1e-4, risk: float = 0.01) -> DataFrame:
    """A count-min sketch as a table (row, cell, n) of at most width x depth rows: rows are added up on the map side, so the shuffle is bounded by the sketch. Two tables merge by union and merge()."""
    width, depth = shape_for(error, risk)
    counted = df.where(F.col(item).isNotNull()).select(F.explode(_cells(F.col(item), width, depth)).alias("at"))
    return counted.groupBy("at.row", "at.cell").agg(F.count("*").alias("n"))


def merge(tables: DataFrame) -> DataFrame:
    return tables.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def counts(sketch: DataFrame, items: DataFrame, item: str, error: float = 1e-4, risk: float = 0.01) -> DataFrame:
    """items with `about`: never less than how often the item was counted; 0 if never (or null)."""
    width, depth = shape_for(error, risk)
    at, about = unused("at", items), unused("about", items)
    asked = items.select(item).distinct().where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.explode(_cells(F.col(item), width, depth)).alias("at"))
    found = asked.select("item", F.col("at.row").alias("row"), F.col("at.cell").alias("cell")).join(sketch, ["row", "cell"], "left").groupBy("item").agg(F.min(F.coalesce("n", F.lit(0))).alias(about))
    return items.join(found.withColumnRenamed("item", at), F.col(item) == F.col(at), "left").drop(at).withColumn(about, F.coalesce(about, F.lit(0).cast("long")))


def frequent_parts(df: DataFrame, item: str, *by: str, tracked: int = 10_000) -> DataFrame:
    """by and `frequent`: the group's most frequent items and their counts in a state of at most `tracked` items, to be stored and merged; counts are off by rows / (0.375 x tracked power of two) at most."""
    return df.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{item}`, {tracked})").alias("frequent"))


def frequent(parts: DataFrame, k: int, *by: str) -> DataFrame:
    """by, rank, item and n of the k most frequent items over all stored parts of a group; equal counts by the item."""
    top = parts.groupBy(*by).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent), {k})").alias("top"))
    ordered = F.array_sort(F.transform("top", lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("item"))))
    return top.select(*by, F.posexplode(ordered).alias("p", "t")).select(*by, (F.col("p") + 1).cast("long").alias("rank"), F.col("t.item").alias("item"), (-F.col("t.n")).alias("n"))

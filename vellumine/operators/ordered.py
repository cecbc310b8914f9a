"""Aggregates over the rows of a key in their order, that no single pass of built-in aggregates gives, for keys of any size.

A window over a key, or a group given to Python, would hold all of a key's rows in one task. Here all rows are sorted by key and order in ranges, so that a key with many rows spans as many ranges as it fills; each task reads its range
once in Arrow batches and keeps one small state for the key it is at; the states of a key, one for each range at most, are merged in order by built-in functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.plans.scratch import ship

#: The state of some neighbouring rows of a key. rise and fall: the most that a later value is above or below an earlier one; head and tail: lengths of the rising runs that the rows begin and end with.
STATE = ("n", "first", "last", "low", "high", "rise", "fall", "run", "head", "tail")


def merge(a: dict, b: dict) -> dict:
    """The state of a's rows followed by b's."""
    joined = a["last"] < b["first"]
    return {
        "n": a["n"] + b["n"],
        "first": a["first"],
        "last": b["last"],
        "low": min(a["low"], b["low"]),
        "high": max(a["high"], b["high"]),
        "rise": max(a["rise"], b["rise"], b["high"] - a["low"]),
        "fall": max(a["fall"], b["fall"], a["high"] - b["low"]),
        "run": max(a["run"], b["run"], a["tail"] + b["head"] if joined else 0),
        "head": a["n"] + b["head"] if joined and a["head"] == a["n"] else a["head"],
        "tail": b["n"] + a["tail"] if joined and b["tail"] == b["n"] else b["tail"],
    }


def _merged(a: Column, b: Column) -> Column:
    """`merge` of two state structs."""
    joined = a["last"] < b["first"]
    parts = {
        "n": a["n"] + b["n"],
        "first": a["first"],
        "last": b["last"],
        "low": F.least(a["low"], b["low"]),
        "high": F.greatest(a["high"], b["high"]),
        "rise": F.greatest(a["rise"], b["rise"], b["high"] - a["low"]),
        "fall": F.greatest(a["fall"], b["fall"], a["high"] - b["low"]),
        "run": F.greatest(a["run"], b["run"], F.when(joined, a["tail"] + b["head"]).otherwise(0)),
        "head": F.when(joined & (a["head"] == a["n"]), a["n"] + b["head"]).otherwise(a["head"]),
        "tail": F.when(joined & (b["tail"] == b["n"]), b["n"] + a["tail"]).otherwise(b["tail"]),
    }
    return F.struct(*(parts[name].alias(name) for name in STATE))


def states(x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The state of each stretch of x, of which each begins at one of starts and none is empty."""
    size = np.diff(np.append(starts, len(x)))
    of = np.repeat(np.arange(len(starts)), size)
    known, rank = np.unique(x, return_inverse=True)
    # extremes so far within a stretch: ranks, lifted above all of the stretches before
    highest = known[np.maximum.accumulate(of * len(known) + rank) % len(known)]
    lowest = known[len(known) - 1 - np.maximum.accumulate(of * len(known) + len(known) - 1 - rank) % len(known)]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] <= x[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(new)
    length = np.diff(np.append(begins, len(x)))
    at = np.searchsorted(begins, starts)  # each stretch begins a run
    return {
        "n": size,
        "first": x[starts],
        "last": x[starts + size - 1],
        "low": np.minimum.reduceat(x, starts),
        "high": np.maximum.reduceat(x, starts),
        "rise": np.maximum.reduceat(x - lowest, starts),
        "fall": np.maximum.reduceat(highest - x, starts),
        "run": np.maximum.reduceat(length, at),
        "head": length[at],
        "tail": length[np.append(at[1:], len(begins)) - 1],
    }


def _summaries(names: list[str]):
    """One row of part, key and state for each key of a sorted partition; of the batches only the state of the last key is kept."""

    def table(place, keys, found):
        columns = [pa.array([place] * len(keys), pa.int64()), keys, *(pa.array(np.asarray(found[name], np.int64)) for name in STATE)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        from pyspark import TaskContext

        place, open_key, state = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode("encode")
            index = code.indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(index[1:] != index[:-1]) + 1])
            found = states(b.column(1).to_numpy(zero_copy_only=False), starts)
            keys = b.column(0).take(pa.array(starts))
            if state is not None:
                if keys[0].as_py() == open_key.as_py():
                    joined = merge(state, {name: int(found[name][0]) for name in STATE})
                    for name in STATE:
                        found[name][0] = joined[name]
                else:
                    yield table(place, pa.array([open_key.as_py()], keys.type), {name: [state[name]] for name in STATE})
            if len(starts) > 1:
                yield table(place, keys.slice(0, len(starts) - 1), {name: found[name][:-1] for name in STATE})
            open_key, state = keys[len(starts) - 1], {name: int(found[name][-1]) for name in STATE}
        if state is not None:
            yield table(place, pa.array([open_key.as_py()], open_key.type), {name: [state[name]] for name in STATE})

    return run


def swings(df: DataFrame, key: str, order: str, value: Column, parts: int | None = None) -> DataFrame:
    """For each key, in the order of `order`: n, first, last, low, high, rise (the most that a later value is above an earlier one), fall (the most that it is below; both 0 if none is), and run, the length of the longest run of
    values of which each is above the one before.

    value is taken as a whole number (cast to bigint), so that sums do not depend on how rows are dealt. Rows with a null order or value are left out, a null key is a key, and a key without rows left has none. Of rows equal in key and order the
    lesser value is first, so repeated rows have one result. An empty table gives no rows. Other columns are ignored, whatever their names. parts: ranges to sort into, by default the session's shuffle partitions. The key is of an atomic type.
    """
    spark = df.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("at"), value.cast("long").alias("value")).where("at is not null and value is not null")
    # key, order and value: the bounds of ranges fall within a key that holds more than a range
    ranged = rows.repartitionByRange(parts, "key", "at", "value").sortWithinPartitions("key", "at", "value").select("key", "value")
    kind = rows.schema["key"].dataType.simpleString()
    pieces = ranged.mapInArrow(_summaries(["part", "key", *STATE]), f"part long, key {kind}, " + ", ".join(f"{name} long" for name in STATE))
    held = F.sort_array(F.collect_list(F.struct("part", F.struct(*STATE).alias("state"))))  # no more than `parts` of them
    of = pieces.groupBy("key").agg(held.alias("held")).select("key", F.transform("held", lambda h: h["state"]).alias("states"))
    whole = F.aggregate(F.slice("states", 2, F.greatest(F.size("states") - 1, F.lit(0))), F.col("states")[0], _merged)
    return of.select(F.col("key").alias(key), whole.alias("whole")).select(key, *(F.col("whole")[name].alias(name) for name in STATE[:8]))

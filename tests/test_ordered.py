"""Aggregates over ordered rows, against plain Python."""

import datetime as dt
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.operators import ordered


def brute(rows):
    """key -> n, first, last, low, high, rise, fall, run of (key, order, value) rows."""
    out = {}
    for key in {r[0] for r in rows}:
        x = [v for _, v in sorted((t, v) for k, t, v in rows if k == key and t is not None and v is not None)]
        if x:
            rises = [b - a for a, b in itertools.combinations(x, 2)]
            run = most = 1
            for a, b in itertools.pairwise(x):
                run = run + 1 if b > a else 1
                most = max(most, run)
            out[key] = (len(x), x[0], x[-1], min(x), max(x), max([0, *rises]), max([0, *(-r for r in rises)]), most)
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_swings(spark, small_batches, parts):
    """A hot key over many ranges and batches, one that only rises, small keys, a null key, nulls, ties, repeated rows."""
    rng = np.random.default_rng(3)
    rows = [("hot", int(rng.integers(0, 300)), int(rng.integers(-50, 50))) for _ in range(400)]
    rows += [("up", i, 3 * i) for i in range(200)] + [("down", i, -i) for i in range(90)] + [("same", i, 4) for i in range(30)]
    rows += [(f"k{int(rng.integers(0, 60))}", int(rng.integers(0, 9)), int(rng.integers(0, 9))) for _ in range(300)]
    rows += [(None, 1, 5), (None, 2, 9), (None, 2, 9), ("", 0, 0), ("gone", None, 3), ("gone", 4, None), ("far", 1, 2**52), ("far", 2, -(2**52))]
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "who string, value long, v long, key string, at string, part int")
    got = found(ordered.swings(df, "who", "value", F.col("v"), parts))
    assert got == brute(rows) and "gone" not in got and got["up"][-1] == 200 and got["down"][6] == 89
    assert ordered.swings(df, "who", "value", F.col("v"), parts).columns == ["who", "n", "first", "last", "low", "high", "rise", "fall", "run"]


def test_a_hot_key_is_split(spark):
    """No range holds more than its share of the rows of one key, and each gives one state for it."""
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 1009).alias("v"))
    ranged = df.repartitionByRange(8, "k", "t", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 1000
    assert found(ordered.swings(df, "k", "t", F.col("v"), 8)) == brute([(1, i, i * 7919 % 1009) for i in range(4000)])


def test_empty_and_other_types(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.5, 2), (dt.date(2024, 1, 1), 0.5, 1), (None, 0.1, 7)], "d date, t double, v int")
    assert found(ordered.swings(df, "d", "t", F.col("v"))) == {dt.date(2024, 1, 1): (2, 1, 2, 1, 2, 1, 0, 2), None: (1, 7, 7, 7, 7, 0, 0, 1)}
    assert ordered.swings(df.limit(0), "d", "t", F.col("v")).count() == 0
    assert ordered.swings(df.withColumn("v", F.lit(None).cast("int")), "d", "t", F.col("v")).count() == 0


values = st.lists(st.integers(-9, 9), min_size=1, max_size=12)


def state(x):
    return {name: int(v[0]) for name, v in ordered.states(np.array(x), np.array([0])).items()}


@settings(max_examples=200, deadline=None)
@given(values, values, values)
def test_states_merge_as_one(a, b, c):
    """Merging states is the state of the whole, however it is cut."""
    whole = state(a + b + c)
    assert ordered.merge(ordered.merge(state(a), state(b)), state(c)) == whole == ordered.merge(state(a), ordered.merge(state(b), state(c)))
    several = ordered.states(np.array(a + b + c), np.array([0, len(a), len(a) + len(b)]))
    assert [{name: int(several[name][i]) for name in ordered.STATE} for i in range(3)] == [state(a), state(b), state(c)]
    assert tuple(whole[name] for name in ordered.STATE[:8]) == brute([(0, i, v) for i, v in enumerate(a + b + c)])[0]

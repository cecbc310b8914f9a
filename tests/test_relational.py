"""Joins by time and the rest against brute force, and on awkward rows."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from vellumine.operators import relational

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=int(minutes))


def test_asof(spark):
    rng = np.random.default_rng(1)
    left = [(i, ("a", "a", "b", None)[i % 4], None if i % 17 == 0 else int(m)) for i, m in enumerate(rng.integers(0, 9000, 80))]
    right = [(("a", "a", "c", None)[i % 4], None if i % 13 == 0 else int(m), i) for i, m in enumerate(rng.integers(0, 9000, 60))] + [("a", 100, 500), ("a", 100, 400), ("b", 50, None)]
    a = spark.createDataFrame([(i, k, at(m), "x") for i, k, m in left], "id long, user string, ts timestamp_ntz, t string")
    b = spark.createDataFrame([(k, at(m), v) for k, m, v in right], "user string, ts timestamp_ntz, v long")
    want = {}
    for i, k, m in left:
        before = [(t, v) for key, t, v in right if k is not None and m is not None and key == k and t is not None and t <= m and v is not None]
        want[i] = max(before)[1] if before else None
    for seconds in (600, 86_400):
        got = relational.asof(a, b, "user", "ts", "v", seconds).collect()
        assert len(got) == len(left) and {r["id"]: r["as_of"] for r in got} == want
    assert {r["as_of"] for r in relational.asof(a, b.limit(0), "user", "ts", "v").collect()} == {None}
    assert relational.asof(a.limit(0), b, "user", "ts", "v").count() == 0


def test_interval_and_range_joins(spark):
    rng = np.random.default_rng(2)
    points = [(i, "ab"[i % 2], int(m)) for i, m in enumerate(rng.integers(0, 2000, 100))] + [(200, None, 5), (201, "a", None)]
    spans = [(i, "ab"[i % 2], int(m), int(m + n)) for i, (m, n) in enumerate(zip(rng.integers(0, 2000, 40), rng.integers(-5, 300, 40), strict=True))]
    p = spark.createDataFrame([(i, k, at(m), m) for i, k, m in points], "id long, user string, ts timestamp_ntz, minute int")
    s = spark.createDataFrame([(i, k, at(x), at(y), x, y) for i, k, x, y in spans], "span long, user string, start timestamp_ntz, stop timestamp_ntz, low int, high int")
    got = {(r["id"], r["span"]) for r in relational.interval_join(p, s, "user", "ts", "start", "stop").collect()}
    assert got == {(i, j) for i, k, m in points for j, u, x, y in spans if m is not None and k == u and x <= m < y}
    ranged = {(r["id"], r["span"]) for r in relational.range_join(p.drop("user"), s.drop("user"), "minute", "low", "high", 60).collect()}
    assert ranged == {(i, j) for i, _, m in points for j, _, x, y in spans if m is not None and x <= m < y}
    assert relational.interval_join(p.limit(0), s, "user", "ts", "start", "stop").count() == 0
    plan = relational.range_join(p.drop("user"), s.drop("user"), "minute", "low", "high", 60)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_and_subtotals(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in (("p", "q", "q", None), ("q", "r", None)))
    assert {(r["x"], r["side"]) for r in relational.overlap(a, b).collect()} == {("p", "a"), ("q", "both"), ("r", "b"), (None, "both")}
    got = relational.subtotals(spark.createDataFrame([("x", 1, 2.0), ("x", 2, 3.0), (None, 1, 1.0)], "a string, b int, v double"), ["a", "b"], total="v").collect()
    assert {(r["a"], r["b"], r["n"], r["total"], r["level"]) for r in got} == {("x", 1, 1, 2.0, 0), ("x", 2, 1, 3.0, 0), (None, 1, 1, 1.0, 0), ("x", None, 2, 5.0, 1), (None, None, 1, 1.0, 1), (None, None, 3, 6.0, 2)}


def test_sketches_are_near(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 5000).alias("item"), F.col("id").cast("double").alias("v"))
    for r in relational.sketched(df, "g", "item", "v").collect():
        assert abs(r["items"] - 2500) < 150 and abs(r["median"] - 10_000) < 600 and abs(r["p90"] - 18_000) < 600


def test_scratch_goes_with_the_driver(tmp_path):
    """Tables are removed when the driver ends, although the session was stopped before; nothing else in the folder is."""
    (tmp_path / "other").mkdir()
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
from vellumine.plans.scratch import Scratch
import os
assert Scratch(spark, "x").write(spark.range(3), "t").count() == 3 and any(x.startswith("vellumine-x-") for x in os.listdir("{tmp_path}"))
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=180)
    left = os.listdir(tmp_path)
    assert "other" in left and not any(x.startswith("vellumine") for x in left)


def test_joins_by_time_keep_columns_of_their_own_names(spark):
    points = spark.createDataFrame([(1, "2024-01-01 00:30:00", 5.0, "b", "a")], "k int, t string, v double, bucket string, as_of string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    spans = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 01:00:00", 0.0, 9.0)], "k int, s string, e string, lo double, hi double")
    spans = spans.withColumn("s", F.col("s").cast("timestamp_ntz")).withColumn("e", F.col("e").cast("timestamp_ntz"))
    assert relational.interval_join(points, spans, "k", "t", "s", "e").select("bucket", "as_of").first() == ("b", "a")
    assert relational.range_join(points.drop("k"), spans, "v", "lo", "hi", 2.0).select("bucket").first() == ("b",)
    got = relational.asof(points, points, "k", "t", "v").first()
    assert (got.as_of, got["_as_of"]) == ("a", 5.0)


def test_buckets_of_local_times_do_not_follow_the_zone_of_the_session(spark):
    rows = [(1, f"2024-10-27 0{h}:{m}0:00", h * 10 + m) for h in range(5) for m in range(6)]
    df = spark.createDataFrame(rows, "k int, t string, v int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")  # the hour from two to three is there twice
        assert all(r.v == r.as_of for r in relational.asof(df, df, "k", "t", "v", 1800).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


AT = "k int, t timestamp_ntz, v double, o int, id int, row int, b int, n int"


def timed(spark, rows):
    """Extra columns with names that the operators use within."""
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, None if s is None else start + dt.timedelta(seconds=s), v, o, 1, 2, 3, 4) for k, s, v, o in rows], AT)


def random_rows(rng, n, span):
    whole = lambda x: None if rng.random() < 0.05 else x
    return [(whole(int(rng.integers(0, 3))), whole(int(rng.integers(0, span))), whole(float(rng.integers(-9, 9))), i) for i in range(n)]


def test_last_rows_against_each_pair(spark):
    rng = np.random.default_rng(8)
    left, right = random_rows(rng, 80, 400), random_rows(rng, 120, 400)
    for n, seconds in ((3, 60), (1, 1000), (7, 7)):
        got = sorted((r["row"].o, [x.o for x in r.past]) for r in relational.last_rows(timed(spark, left), timed(spark, right), "k", "t", n, "o", seconds).collect())
        want = [(o, [r[3] for r in sorted((x for x in right if x[0] == k and x[1] is not None and x[1] <= s), key=lambda x: (x[1], x[3]), reverse=True)][:n] if k is not None and s is not None else []) for k, s, _, o in left]
        assert got == sorted(want)
    none = timed(spark, []).limit(0)
    assert relational.last_rows(none, timed(spark, right), "k", "t", 2, "o").count() == 0
    assert [r.past for r in relational.last_rows(timed(spark, left[:2]), none, "k", "t", 2, "o").collect()] == [[], []]


def test_moving_sums_against_each_frame(spark):
    rng = np.random.default_rng(9)
    rows = random_rows(rng, 150, 500)
    for seconds, width in ((60, None), (60, 7), (60, 1000), (45, 20)):
        got = {r.o: (r["_n"], r["total"]) for r in relational.moving(timed(spark, rows), "k", "t", "v", seconds, width).collect()}
        for k, s, _, o in rows:
            own = [x[2] for x in rows if s is not None and x[1] is not None and x[0] == k and s - seconds <= x[1] <= s and x[2] is not None]
            assert got[o] == ((None, None) if s is None else (len(own), sum(own) if own else None)), (seconds, width, o)
    assert relational.moving(timed(spark, []).limit(0), "k", "t", "v", 60).count() == 0


def test_moving_adds_each_row_once(spark):
    """No frame slides over single rows or runs to the last of them, as Spark adds such frames up anew for each row; 40,000 rows of one key and bucket take time in proportion."""
    rows = spark.range(40_000).selectExpr("1 as k", "timestampadd(MICROSECOND, id * 1000, timestamp_ntz'2024-01-01 00:00:00') as t", "cast(id % 9 as double) as v", "id")
    got = relational.moving(rows, "k", "t", "v", 60)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan
    assert "unboundedfollowing" not in plan and plan.count("specifiedwindowframe") == plan.count("unboundedpreceding$(), currentrow$()")
    found = {r.id: (r.n, r.total) for r in got.where("id in (0, 1, 39999)").collect()}
    assert found == {0: (1, 0.0), 1: (2, 1.0), 39_999: (40_000, float(sum(i % 9 for i in range(40_000))))}
    same = relational.moving(rows.limit(90).unionAll(rows.limit(90)), "k", "t", "v", 0).collect()
    assert {(r.n, r.total) for r in same if r.id == 8} == {(2, 16.0)}

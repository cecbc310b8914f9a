"""Streams over files that appear one by one, among them late and repeated events."""

import pytest

from vellumine.sources import tables
from vellumine.streaming import activity

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def source(spark, tmp_path):
    """A folder with a file for each list of (event_id, time, user, type), read one file a batch."""

    def make(*files):
        path = str(tmp_path / "in")
        for rows in files:
            values = ", ".join(f"({i}L, {'null' if t is None else f"timestamp_ntz'2024-01-{t}'"}, {u}L, {'null' if k is None else repr(k)}, 1.0D, '{{}}')" for i, t, u, k in rows)
            tables.write(spark.sql(f"select * from values {values} as t(event_id, ts, user_id, event_type, value, props)").coalesce(1), path, mode="append")
        return activity.events_stream(spark, path, SCHEMA, per_batch=1)

    return make


def test_late_rows_are_dropped_once_their_window_is_closed(spark, source):
    stream = source([(1, "01 01:00:00", 1, "view")], [(2, "05 00:30:00", 1, "view")], [(8, "05 00:40:00", 1, "view")], [(3, "01 02:00:00", 1, "view"), (4, "05 00:10:00", 1, "view")], [(5, "09 00:00:00", 1, "view"), (6, None, 1, "view")], [(7, "09 00:00:01", 1, "view")])
    got = {(str(r["start"])[:10], r["n"]) for r in activity.settled(spark, activity.activity_stream(stream), "late", "append").collect()}
    assert got == {("2024-01-01", 1), ("2024-01-05", 3)}  # row 3 came after its day was given out; the 9th is still open


def test_sessions(spark, source):
    stream = source([(1, "01 01:00:00", 1, "view"), (2, "01 01:20:00", 1, "view"), (3, "01 02:30:00", 1, "view")], [(4, "01 01:45:00", 1, "view"), (5, "01 01:00:00", 2, "view")], [(6, "03 00:00:00", 9, "view")], [(7, "03 00:00:01", 9, "view")])
    got = {(r["user_id"], str(r["start"])[11:16], r["n"]) for r in activity.settled(spark, activity.sessions_stream(stream), "sessions", "append").collect()}
    assert got == {(1, "01:00", 3), (1, "02:30", 1), (2, "01:00", 1)}  # row 4 came a batch later, within the hour


def test_repeated_events_are_told_once(spark, source):
    stream = source([(1, "01 01:00:00", 1, "view"), (1, "01 01:00:00", 1, "view")], [(1, "01 01:10:00", 1, "view"), (2, "01 01:10:00", 1, "view")])
    assert sorted(r["event_id"] for r in activity.settled(spark, activity.deduplicated_stream(stream), "once", "append").collect()) == [1, 2]


def test_runs_go_on_over_batches(spark, source):
    stream = source([(1, "01 01:00:00", 1, "view"), (2, "01 01:01:00", 1, "view"), (3, "01 01:00:00", 2, None)], [(4, "01 02:00:00", 1, "view"), (5, "01 03:00:00", 1, "click")])
    got = {}
    for r in activity.settled(spark, activity.streaks_stream(stream), "streaks", "update").collect():
        got[r["user_id"]] = max(got.get(r["user_id"], 0), r["longest"])
    assert got == {1: 3, 2: 1}


def test_outcomes_wait_for_the_watermark_and_not_for_order(spark, source):
    from vellumine.streaming import outcomes

    stream = source(
        [(1, "01 01:00:00", 1, "view"), (2, "01 01:00:00", 2, "view"), (3, "01 01:30:00", 1, "view"), (4, "01 01:10:00", 3, "click")],
        [(5, "01 01:45:00", 1, "purchase"), (6, "01 02:00:00", 2, "purchase"), (7, "01 01:59:59", 1, "purchase"), (8, None, 1, "view")],
        [(9, "01 01:40:00", 1, "purchase"), (10, "01 01:20:00", 4, "view"), (10, "01 01:20:00", 4, "view")],  # within the watermark's hour, out of order
        [(11, "01 06:00:00", 5, "view")],
        [(16, "01 06:00:01", 7, "view")],  # by the next batch the hours of all before it are over
        [(12, "01 01:05:00", 2, "purchase"), (13, "01 02:00:00", 6, "view")],  # too late
        [(14, "01 08:00:00", 5, "purchase"), (15, "01 07:59:00", 5, "view")],
    )
    before = spark.conf.get(outcomes.PROVIDER, None)
    got = sorted((r.user_id, r.event_id, str(r.ts)[11:], r.outcome_id) for r in outcomes.outcomes(spark, stream).collect())
    # view 15's hour is still open; view 11's is over at seven, which the watermark has reached
    assert got == [(1, 1, "01:00:00", 9), (1, 3, "01:30:00", 9), (2, 2, "01:00:00", None), (4, 10, "01:20:00", None), (4, 10, "01:20:00", None), (5, 11, "06:00:00", None)]
    assert spark.conf.get(outcomes.PROVIDER, None) == before


def test_a_batch_that_is_run_again_replaces_what_it_wrote(spark, source, monkeypatch):
    from pyspark.sql.streaming import DataStreamWriter

    plain = DataStreamWriter.foreachBatch
    monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda self, put: plain(self, lambda df, n: (put(df, n), put(df, n)) and None))
    stream = source([(1, "01 01:00:00", 1, "view")], [(2, "01 01:10:00", 1, "view")])
    assert sorted(r["event_id"] for r in activity.settled(spark, activity.deduplicated_stream(stream), "twice", "append").collect()) == [1, 2]


class _State:
    """A list state or a handle that counts calls."""

    def __init__(self):
        self.rows, self.timers, self.reads = [], set(), 0

    def getListState(self, name, schema):
        return _State()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def appendList(self, rows):
        self.rows += rows

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_user_has_one_timer_for_all_that_wait():
    """A timer for each view, each of which read all that waited, took time in proportion to the square of a user's views."""
    import pandas as pd

    from vellumine.streaming import outcomes

    handle, second = _State(), 1_000_000
    own = outcomes._Outcomes("view", "purchase", 10 * second)
    own.init(handle)
    at = [i * second for i in range(100)]
    frame = pd.DataFrame({"event_type": ["view"] * 100 + ["purchase"] * 2, "at": at + [5 * second, 60 * second], "event_id": list(range(102))})
    assert list(own.handleInputRows((1,), [frame], handle)) == [] and handle.timers == {10_000}
    handle.now, fired, got = 50_000, [], []
    while due := [t for t in sorted(handle.timers) if t <= handle.now and t not in fired]:
        fired.append(due[0])
        got += [r for x in own.handleExpiredTimer((1,), handle, None) for r in x.itertuples(index=False)]
    assert len(fired) == 1 and own.asked.reads == 1 and handle.timers == {10_000, 51_000}
    want = {i: next((j for j, t in ((100, 5), (101, 60)) if i <= t < i + 10), None) for i in range(41)}
    assert {r.event_id: None if pd.isna(r.outcome_id) else r.outcome_id for r in got} == want
    handle.now = 200_000
    got = list(own.handleExpiredTimer((1,), handle, None))
    assert len(got[0]) == 59 and own.asked.rows == [] and own.told.rows == []
    assert list(own.handleExpiredTimer((1,), handle, None)) == []

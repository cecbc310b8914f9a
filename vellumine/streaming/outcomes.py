"""What became of an event within a span of time, on a stream: list state and event-time timers for each user.

Both sides wait in state until the watermark has passed the end of a row's span; its timer then decides it once, so the outcome does not depend on the order in which rows came. Rows later than the watermark are dropped, as Structured
Streaming defines; rows with a null time or user have no outcome. Rows whose span the watermark has not passed stay in state. State of a user is bounded by what happens within the span and the watermark's delay, and lives in the
checkpoint folder, in RocksDB.
"""

from __future__ import annotations

from bisect import bisect_left
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vellumine.plans.scratch import ship
from vellumine.streaming.activity import settled

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "user_id long, event_id long, at long, outcome_id long"


class _Outcomes(StatefulProcessor):
    """asked: rows that wait for an outcome; told: rows that can be one. Both as (microseconds, event_id)."""

    def __init__(self, asked: str, told: str, span: int):
        self.kinds, self.span = (asked, told), span

    def init(self, handle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "at long, event_id long")
        self.told = handle.getListState("told", "at long, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        """One timer for a batch of a user's rows, at the first end of a span: what is decided then, and when the next is due, follows from state."""
        asked, told = [], []
        for frame in rows:
            for kind, at, i in zip(frame["event_type"].tolist(), frame["at"].tolist(), frame["event_id"].tolist(), strict=True):
                for wanted, own in zip(self.kinds, (asked, told), strict=True):
                    if kind == wanted:
                        own.append((at, i))
        for state, own in ((self.asked, asked), (self.told, told)):
            if own:
                state.appendList(own)
        if asked:
            self.handle.registerTimer(self._due(min(at for at, _ in asked)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All rows whose span the watermark has passed are decided by the first of the user's timers that it has passed."""
        now = timerValues.getCurrentWatermarkInMs()
        asked = sorted(self.asked.get())
        due, left = ([x for x in asked if (self._due(x[0]) <= now) == passed] for passed in (True, False))
        if not due:
            return
        told = sorted(self.told.get())
        found = [told[j][1] if (j := bisect_left(told, (at,))) < len(told) and told[j][0] < at + self.span else None for at, _ in due]
        kept = [x for x in told if x[0] >= min([1000 * now, *(at for at, _ in left)])]
        for state, rows, before in ((self.asked, left, asked), (self.told, kept, told)):
            if len(rows) < len(before):
                state.put(rows) if rows else state.clear()
        if left:
            self.handle.registerTimer(self._due(left[0][0]))
        yield pd.DataFrame({"user_id": pd.array([key[0]] * len(due), "Int64"), "event_id": pd.array([i for _, i in due], "Int64"), "at": [at for at, _ in due], "outcome_id": pd.array(found, "Int64")})

    def close(self) -> None:
        pass

    def _due(self, at: int) -> int:
        """Milliseconds at which the span is over."""
        return -(-(at + self.span) // 1000)


def outcomes_stream(events: DataFrame, asked: str = "view", told: str = "purchase", seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, at (microseconds), outcome_id: for every event of type `asked` the first event of type `told` of the same user in the span from it (at its time or later, before its end), null if there was none.
    events: a stream with user_id, event_id, event_type and ts, a timestamp."""
    ship(events.sparkSession)
    own = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isin(asked, told))
    own = own.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("at"), "user_id", "event_id", "event_type")
    return own.groupBy("user_id").transformWithStateInPandas(_Outcomes(asked, told, seconds * 1_000_000), OUT, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB for streams that start within; the session's own setting holds again after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def outcomes(spark: SparkSession, events: DataFrame, **how) -> DataFrame:
    """All outcomes that are settled by what is there now."""
    with rocks(spark):
        out = settled(spark, outcomes_stream(events, **how), "outcomes", "append")
    return out.select("user_id", "event_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "outcome_id")

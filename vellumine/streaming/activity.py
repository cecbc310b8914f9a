"""Activity over time on a stream.

ts is cast to a timestamp, which a watermark needs. Rows later than the watermark are dropped where state was closed, as Structured Streaming defines; rows with a
null time belong to no window. Each query's state lives in its checkpoint folder, which executors share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumine.plans.scratch import Scratch


def events_stream(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """Files as they appear, at most per_batch at a time; ts as a timestamp."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def activity_stream(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windows of each type; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; in append mode one is given out when the watermark has passed its end."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row of each event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _streaks(key, frames, state: GroupState):
    """state: length of the current run of equal types, the longest so far, and the last type. A batch's runs come from where neighbouring types differ; only the first is joined to the run so far."""
    run, best, last = state.get if state.exists else (0, 0, "")
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    kinds = rows["event_type"].fillna("").to_numpy(str)
    starts = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
    runs = np.diff(starts, append=len(kinds))
    runs[0] += run if kinds[0] == last else 0
    best = max(best, int(runs.max()))
    state.update((int(runs[-1]), best, str(kinds[-1])))
    yield pd.DataFrame({"user_id": [key[0]], "longest": [best]})


def streaks_stream(events: DataFrame) -> DataFrame:
    """user_id, longest: after each batch, the longest run of events of one type of the users that it names. Three values of state a user; a run goes on over batches in their order."""
    return events.groupBy("user_id").applyInPandasWithState(_streaks, "user_id long, longest long", "run long, best long, last string", "update", GroupStateTimeout.NoTimeout)


def settled(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now run through the stream, as a table: of complete mode the last state, of others every row that was given out. Each batch has a folder by its number, so that a batch that is run again after a failure replaces what it
    wrote before."""
    scratch = Scratch(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{scratch.root}/out/batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.root}/out/batch={0 if mode == 'complete' else n}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start().awaitTermination()
    names = [f"{scratch.root}/out/{x.getPath().getName()}" for x in scratch.files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/out")) if x.isDirectory()]
    return spark.read.schema(stream.schema).parquet(*names)

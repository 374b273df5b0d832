"""The event loop as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def triggers(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A file stream of events as triggers with priorities: users before watchers before the rest."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    priority = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return raw.withColumn("priority", priority)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")


def user_states(events: DataFrame, threshold: float) -> DataFrame:
    """Per user a running state over arriving events: cycles, cumulative movement and alerts past the threshold."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, moved, alerts = state.get if state.exists else (0, 0.0, 0)
        for frame in frames:
            n += len(frame)
            moved += float(frame["value"].abs().sum())
        alerts = int(moved // threshold)
        state.update((n, moved, alerts))
        yield pd.DataFrame({"user_id": [key[0]], "cycles": [n], "cumulative": [moved], "alerts": [alerts]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, cycles long, cumulative double, alerts long", "n long, moved double, alerts long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream through all that is available into Parquet at path; restarts continue from the checkpoint."""

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is retried overwrites its own folder
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()

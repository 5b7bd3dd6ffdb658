"""Structured Streaming: metric roll-ups with late data, quotas with state, and sinks in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.metrics import rollup
from sievemark.operators.quota import WINDOWS, Tracker

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: How late an event may be.
LATENESS = "1 hour"
#: Milliseconds that a key's counts are kept after its longest window.
IDLE = 5 * 86_400_000


def event_stream(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """Events in the files of a folder, and in those that come later."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def rolled(stream: DataFrame, width: str = "1 minute", keys: list[str] | None = None) -> DataFrame:
    """Averages, extremes and counts per bucket; late events are taken for an hour."""
    return rollup(stream.withWatermark("ts", LATENESS), width, keys or ["event_type"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, into Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_in_batches(stream: DataFrame, checkpoint: str, write, mode: str = "update") -> None:
    """write(frame, number) for every micro-batch; with the same number a batch comes again after a failure."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quota(stream: DataFrame, limits: dict[str, int], key: str = "user_id") -> DataFrame:
    """The exact quota of operators.quota over a stream: counts are state, and go when the watermark is an idle time after the longest window.

    Requests that are later than the watermark are dropped. A batch's requests of one key are sorted in
    memory, 16 bytes each; maxFilesPerTrigger of the source bounds them. Event time drives the
    timeout, so that a run over what is there now ends.
    """
    windows = list(limits)
    idle = IDLE + max(WINDOWS[w] for w in windows) * 1000

    def decide(who, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else None
        tracker = Tracker(limits, {w: [kept[2 * i] if kept[2 * i] >= 0 else None, kept[2 * i + 1]] for i, w in enumerate(windows)} if kept else None)
        at, event = (np.concatenate(x) for x in zip(*((f["at"].to_numpy(), f["event_id"].to_numpy()) for f in frames), strict=True))
        order = np.lexsort((event, at))
        found = [tracker.request(t) for t in at[order].tolist()]
        state.update(tuple(x for w in windows for x in (tracker.state[w][0] if tracker.state[w][0] is not None else -1, tracker.state[w][1])))
        state.setTimeoutTimestamp(max(int(at.max()) // 1000, state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame({key: who[0], "event_id": event[order], "allowed": [f[0] for f in found], "remaining": [f[1] for f in found]})

    timed = stream.withWatermark("ts", LATENESS).select(F.col(key).cast("long").alias(key), F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("at"), "ts")
    fields = ", ".join(f"{w}_begun long, {w}_count long" for w in windows)
    return timed.groupBy(key).applyInPandasWithState(decide, f"{key} long, event_id long, allowed boolean, remaining long", fields, "append", "EventTimeTimeout")

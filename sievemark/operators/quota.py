"""Quotas: windows that begin at a key's first request after the last one ended; denied requests don't count."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Seconds of the windows, and limits of the tiers.
WINDOWS = {"minute": 60, "hour": 3600, "day": 86_400, "month": 30 * 86_400}
TIERS = {"free": {"minute": 100, "hour": 1000, "day": 10_000}, "pro": {"minute": 1000, "hour": 10_000, "day": 100_000}, "enterprise": {"minute": 10_000, "hour": 100_000, "day": 1_000_000}}
CONCURRENT = {"free": 10, "pro": 50, "enterprise": 200}


class Tracker:
    """Counts of one key."""

    def __init__(self, limits: dict[str, int], state: dict | None = None):
        self.limits, self.state = limits, state if state is not None else {w: [None, 0] for w in limits}

    def request(self, at: int) -> tuple[bool, int, int]:
        """(allowed, how many are left in the tightest window, microseconds until a denied one may be tried again)."""
        for w, (begun, _) in self.state.items():
            if begun is None or at >= begun + WINDOWS[w] * 1_000_000:
                self.state[w] = [at, 0]
        full = [w for w, (_, n) in self.state.items() if n >= self.limits[w]]
        if full:
            return False, 0, max(self.state[w][0] + WINDOWS[w] * 1_000_000 - at for w in full)
        for w in self.state:
            self.state[w][1] += 1
        return True, min(self.limits[w] - n for w, (_, n) in self.state.items()), 0


def exact(requests: DataFrame, limits: dict[str, int], key: str = "user_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    """requests with allowed, remaining, retry_after_us.

    A key's requests depend on each other in order, so that they are read in one task, but as a sorted
    stream: memory holds one batch and the counts of the current key.
    """
    schema = f"{key} long, {order} long, allowed boolean, remaining long, retry_after_us long"

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, tracker = object(), None
        for batch in batches:
            out = []
            for k, at in zip(batch[key].to_pylist(), batch["at"].to_pylist(), strict=True):
                if k != who:
                    who, tracker = k, Tracker(limits)
                out.append(tracker.request(at))
            if out:
                allowed, left, after = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch[key], batch[order], pa.array(allowed), pa.array(left, pa.int64()), pa.array(after, pa.int64())], [key, order, "allowed", "remaining", "retry_after_us"])

    timed = requests.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    return timed.repartition(key).sortWithinPartitions(key, "at", order).mapInArrow(decide, schema)


def calendar(requests: DataFrame, width: str, limit: int, key: str = "user_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds `allowed` by calendar windows: the first requests of each, up to the limit."""
    bucket = F.date_trunc(width, time)
    rank = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(time, order))
    return requests.withColumn("bucket", bucket).withColumn("allowed", rank <= limit)

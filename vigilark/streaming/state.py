"""Keyed, time-bounded state over streams: delivery dedup, job leases, live metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_deliveries(stream: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The first delivery of an id within ttl of event time; state ends with the watermark."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["delivery_id"])


def windowed_counts(stream: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and kind."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count(F.lit(1)).alias("n"))


def leases(stream: DataFrame, lease_seconds: int = 1800) -> DataFrame:
    """Job transitions (job_id, state, ts) to (job_id, action, attempts): leased, done, failed, or requeued when a lease runs out.

    The lease is a timeout in event time, so a job that nobody finishes comes back with the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        attempts = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [job], "action": ["requeued"], "attempts": [attempts]})
            return
        out, until = [], None
        for x in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            if x.state == "processing":
                attempts += 1
                until = int(x.ts.timestamp() * 1000) + lease_seconds * 1000
                out.append((job, "leased", attempts))
            elif x.state in ("done", "failed"):
                until = 0
                out.append((job, x.state, attempts))
        # the state is set once: a removal after a timeout in one call would leave the timeout behind
        if until:
            state.update((attempts,))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        elif until == 0 and state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["job_id", "action", "attempts"])

    return stream.withWatermark("ts", "1 minute").groupBy("job_id").applyInPandasWithState(step, "job_id long, action string, attempts long", "attempts long", "append", GroupStateTimeout.EventTimeTimeout)

"""A queue with leases and the liveness of workers as stateful streams: list, map and value state, timers, initial state.

Both need the RocksDB state store (rocksdb() chooses it for a session). State is checkpointed with the stream, so a
restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB = "queue string, job_id string, action string, attempts int, at long"
BEAT = "worker string, action string, at long"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Queue(StatefulProcessor):
    """One queue: jobs wait in the order they came; a taken one is leased, and comes back at the tail when its lease runs out."""

    def __init__(self, lease_ms: int, inflight: int, most: int):
        self.lease_ms, self.inflight, self.most = lease_ms, inflight, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "job_id string, attempts int")
        self.leased = handle.getMapState("leased", "job_id string", "attempts int, until long")

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:
        self.waiting.appendValue((initialState.job_id, initialState.attempts))

    def _open(self) -> tuple[list, dict]:
        waiting = [(x[0], x[1]) for x in self.waiting.get()] if self.waiting.exists() else []
        leased = {k[0]: (v[0], v[1]) for k, v in self.leased.iterator()} if self.leased.exists() else {}
        return waiting, leased

    def _close(self, waiting: list, leased: dict, before: dict) -> None:
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        for job in before.keys() - leased.keys():
            self.leased.removeKey((job,))
        for job, held in leased.items():
            if before.get(job) != held:
                self.leased.updateValue((job,), held)
                self.handle.registerTimer(held[1])

    def _back(self, queue: str, now: int, waiting: list, leased: dict) -> Iterator[Row]:
        """Jobs whose lease ran out go to the tail, those first whose lease ran out first."""
        for job in sorted((j for j, (_, until) in leased.items() if until <= now), key=lambda j: (leased[j][1], j)):
            attempts, until = leased.pop(job)
            waiting.append((job, attempts))
            yield Row(queue=queue, job_id=job, action="requeued", attempts=attempts, at=until)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        waiting, leased = self._open()
        before = dict(leased)
        for x in sorted(rows, key=lambda r: (r.at, r.seq)):
            yield from self._back(key[0], x.at, waiting, leased)
            told = lambda job, action, attempts: Row(queue=key[0], job_id=job, action=action, attempts=attempts, at=x.at)  # noqa: B023, E731
            if x.action == "enqueue":
                waiting.append((x.job_id, 0))
                yield told(x.job_id, "queued", 0)
            elif x.action == "take":
                if len(leased) >= self.inflight:
                    yield told(None, "held", 0)
                elif waiting:
                    job, attempts = waiting.pop(0)
                    leased[job] = (attempts + 1, x.at + self.lease_ms)
                    yield told(job, "leased", attempts + 1)
            elif x.job_id in leased:  # done or fail of a job whose lease still holds
                attempts, _ = leased.pop(x.job_id)
                if x.action == "fail" and attempts < self.most:
                    waiting.append((x.job_id, attempts))
                    yield told(x.job_id, "retried", attempts)
                else:
                    yield told(x.job_id, "failed" if x.action == "fail" else "done", attempts)
        self._close(waiting, leased, before)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        waiting, leased = self._open()
        before = dict(leased)
        out = list(self._back(key[0], expiredTimerInfo.getExpiryTimeInMs(), waiting, leased))
        if out:
            self._close(waiting, leased, before)
        yield from out

    def close(self) -> None:
        pass


def job_queue(stream: DataFrame, waiting: DataFrame | None = None, lease_seconds: int = 60, inflight: int = 2, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """Requests (queue, action, job_id, seq, ts) to what became of them: queued, leased, held, done, retried, failed, requeued.

    Actions: enqueue, take, done, fail. Not more than inflight jobs of a queue are leased at a time. A failed job comes
    back until its most-th attempt. Time is that of the requests: a lease runs out with the next request after it, or
    with the watermark. waiting (queue, job_id, attempts) are jobs that wait from the start.
    """
    x = stream.withWatermark("ts", late).withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    start = None if waiting is None else waiting.groupBy("queue")
    return x.groupBy("queue").transformWithState(Queue(lease_seconds * 1000, inflight, most), JOB, "Append", "EventTime", start)


class Liveness(StatefulProcessor):
    """One worker: alive from a beat on, dropped when no beat came for as long as its state lives."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "at long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.beat.exists():
            yield Row(worker=key[0], action="alive", at=now)
        self.beat.update((now,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.ttl_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield Row(worker=key[0], action="dropped", at=expiredTimerInfo.getExpiryTimeInMs())
        self.beat.clear()

    def close(self) -> None:
        pass


def liveness(stream: DataFrame, ttl_seconds: float = 30) -> DataFrame:
    """Beats (worker) to when each worker came alive, and when it was dropped after ttl_seconds without a beat, by the clock."""
    return stream.select("worker").groupBy("worker").transformWithState(Liveness(int(ttl_seconds * 1000)), BEAT, "Append", "ProcessingTime")

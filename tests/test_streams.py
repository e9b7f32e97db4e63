"""The queue and the liveness of workers as streams, a restart in between."""

import datetime as dt
import time

import pytest

from vigilark.streaming import queue

BEGIN = dt.datetime(2024, 1, 1, 12)
REQUEST = "queue string, action string, job_id string, seq long, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    queue.rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def asked(spark, folder, rows):
    spark.createDataFrame([(q, a, j, n, BEGIN + dt.timedelta(seconds=s)) for n, (s, q, a, j) in enumerate(rows)], REQUEST).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, waiting=None):
    stream = spark.readStream.schema(REQUEST).parquet(f"{folder}/in")
    q = queue.job_queue(stream, waiting, lease_seconds=60).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    assert q.awaitTermination(180)
    return [(r.queue, r.action, r.job_id, r.attempts, r.at // 1000 - int(BEGIN.replace(tzinfo=dt.timezone.utc).timestamp())) for r in spark.read.parquet(f"{folder}/out").orderBy("at").collect()]


def test_queue_leases_requeues_and_restarts(rocks, tmp_path):
    waiting = rocks.createDataFrame([("q", "old", 1)], "queue string, job_id string, attempts int")
    asked(rocks, tmp_path, [(0, "q", "enqueue", "a"), (1, "q", "enqueue", "b"), (2, "q", "take", None), (3, "q", "take", None), (4, "q", "take", None), (5, "q", "done", "old"), (0, "r", "enqueue", "z")])
    first = run(rocks, tmp_path, waiting)
    assert {x for x in first if x[0] == "q"} >= {("q", "queued", "a", 0, 0), ("q", "leased", "old", 2, 2), ("q", "leased", "a", 1, 3), ("q", "held", None, 0, 4), ("q", "done", "old", 2, 5)}
    # a's lease ends at 63: it comes back behind b and c, which came before
    asked(rocks, tmp_path, [(6, "q", "enqueue", "c"), (70, "q", "take", None), (71, "q", "take", None), (72, "q", "done", "a"), (73, "q", "fail", "b"), (74, "q", "done", "c"), (75, "q", "take", None), (76, "q", "done", "a"), (77, "q", "take", None), (78, "q", "fail", "b"), (79, "q", "take", None), (80, "q", "fail", "b"), (81, "q", "take", None)])
    more = [x for x in run(rocks, tmp_path, waiting) if x not in first]
    assert more == [
        ("q", "queued", "c", 0, 6), ("q", "requeued", "a", 1, 63), ("q", "leased", "b", 1, 70), ("q", "leased", "c", 1, 71), ("q", "retried", "b", 1, 73), ("q", "done", "c", 1, 74),
        ("q", "leased", "a", 2, 75), ("q", "done", "a", 2, 76), ("q", "leased", "b", 2, 77), ("q", "retried", "b", 2, 78), ("q", "leased", "b", 3, 79), ("q", "failed", "b", 3, 80),
    ]


def test_a_lease_runs_out_with_the_watermark(rocks, tmp_path):
    asked(rocks, tmp_path, [(0, "q", "enqueue", "a"), (1, "q", "take", None)])
    run(rocks, tmp_path)
    asked(rocks, tmp_path, [(300, "other", "enqueue", "x")])  # moves the watermark
    run(rocks, tmp_path)
    asked(rocks, tmp_path, [(301, "other", "enqueue", "y")])
    assert ("q", "requeued", "a", 1, 61) in run(rocks, tmp_path)


def test_workers_without_beats_are_dropped(rocks, tmp_path):
    spark = rocks
    beat = lambda *names: spark.createDataFrame([(n,) for n in names], "worker string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    beat("w1", "w2")
    q = queue.liveness(spark.readStream.schema("worker string").parquet(f"{tmp_path}/in"), ttl_seconds=6).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    seen = lambda: [(r.worker, r.action) for r in spark.table("live").orderBy("at").collect()]
    try:
        end = time.time() + 90
        while ("w2", "dropped") not in seen() and time.time() < end:
            beat("w1")  # one goes on, the other doesn't
            time.sleep(1)
        assert seen().count(("w1", "alive")) == 1 and ("w1", "dropped") not in seen() and seen().count(("w2", "dropped")) == 1
        while ("w1", "dropped") not in seen() and time.time() < end:
            time.sleep(1)
        assert ("w1", "dropped") in seen()
        beat("w2")
        while seen().count(("w2", "alive")) < 2 and time.time() < end:
            time.sleep(1)
        assert seen().count(("w2", "alive")) == 2
    finally:
        q.stop()

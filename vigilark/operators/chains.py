"""Events accepted by the last accepted one of their key, also where one key holds a large part of all events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored, stored_with_count

_FOUND = "pid int, key string, at long, seq long, next_at long, next_seq long, border boolean"


def _following(batches):
    """Rows sorted backwards: to each asked time the first event of its key at or after it, as far as this run has one; at the end the run's first event.

    at and seq are those of the event that asks; next_at and next_seq are null where a later run has the answer.
    """
    key, event, pid = None, None, 0
    for b in batches:
        out: list[tuple] = []
        for pid, k, at, asks, seq, own in zip(*(b.column(n).to_pylist() for n in ("pid", "key", "time", "asks", "seq", "own"))):
            if k != key:
                key, event = k, None
            if asks:
                out.append((pid, k, own, seq, *(event or (None, None)), False))
            else:
                event = (at, seq)
        yield _batch(out)
    yield _batch([(pid, key, None, None, *event, True)] if event else [])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["pid", "key", "at", "seq", "next_at", "next_seq", "border"])


def next_events(events: DataFrame, gap: int) -> DataFrame:
    """events (key, at, seq) with next_at and next_seq: of each the first of its key at or after at + gap; none has no row.

    Events and the times that they ask for are sorted together by (key, time) into runs, in which a key takes as many
    as it needs. A run answers what it can; what it can't is answered by the first event of the next run that has one of
    the key, of which there is one row a run.
    """
    spark = events.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("key", F.col("at").alias("time"), F.lit(False).alias("asks"), "seq", F.col("at").alias("own")).unionByName(events.select("key", (F.col("at") + gap).alias("time"), F.lit(True).alias("asks"), "seq", F.col("at").alias("own")))
    # an event comes after the times it answers: an asked time before the events of that very time
    rank = F.when(F.col("asks"), 0).otherwise(1)
    sorted_ = rows.withColumn("rank", rank).repartitionByRange(runs, F.col("key").asc_nulls_first(), "time", "rank", "seq")
    back = sorted_.sortWithinPartitions(F.col("key").desc_nulls_last(), F.desc("time"), F.desc("rank"), F.desc("seq"))
    found = stored(back.select(F.spark_partition_id().alias("pid"), F.col("key").cast("string").alias("key"), "time", "asks", "seq", "own").mapInArrow(_following, _FOUND), "following")
    firsts = found.where("border").select("pid", F.struct("key", "next_at", "next_seq").alias("b"))
    # one row a run
    after = spark.range(runs).select(F.col("id").cast("int").alias("pid")).join(firsts, "pid", "left").select("pid", F.first("b", True).over(W.orderBy("pid").rowsBetween(1, W.unboundedFollowing)).alias("later"))
    asked = found.where("NOT border")
    here = asked.where("next_at IS NOT NULL").select("key", "at", "seq", "next_at", "next_seq")
    there = asked.where("next_at IS NULL").join(F.broadcast(after), "pid").where(F.col("later").isNotNull() & F.col("later.key").eqNullSafe(F.col("key")))
    return here.unionByName(there.select("key", "at", "seq", F.col("later.next_at").alias("next_at"), F.col("later.next_seq").alias("next_seq")))


def accepted(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """events (key, ts, seq) that come seconds or more after the last accepted one of their key, or are its first.

    Each event points to the one that would be accepted after it. Starting from the first event of each key, rounds
    double: what is accepted so far leads as many steps on as it holds, by pointers that are joined with themselves, so
    a chain of n accepted events takes log2(n) rounds, and a key's events lie in as many tasks as they need. Events
    alike in key, time and seq count as one.
    """
    kinds = dict(events.dtypes)
    x = stored(events.select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq")).distinct(), "events")
    jump = stored(next_events(x, seconds * 1_000_000), "next")
    held = x.groupBy("key").agg(F.min(F.struct("at", "seq")).alias("x")).select("key", "x.at", "x.seq")
    on = ["key", "at", "seq"]
    while True:
        meets = lambda a, b: a.withColumnsRenamed({c: f"_{c}" for c in on}).join(b, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_at") == F.col("at")) & (F.col("_seq") == F.col("seq")))
        further = meets(held, jump).select("key", F.col("next_at").alias("at"), F.col("next_seq").alias("seq"), F.lit(True).alias("new"))
        both, n = stored_with_count(held.select(*on, F.lit(False).alias("new")).unionByName(further), "held", F.col("new"))
        held = both.drop("new")
        if not n:
            break
        twice = jump.withColumnsRenamed({"at": "a0", "seq": "s0", "next_at": "at", "next_seq": "seq"})
        jump = stored(meets(twice, jump).select(F.col("_key").alias("key"), F.col("a0").alias("at"), F.col("s0").alias("seq"), "next_at", "next_seq"), "next")
    return held.select(F.col("key").cast(kinds["key"]).alias("key"), F.timestamp_micros("at").cast(kinds["ts"]).alias("ts"), F.col("seq").cast(kinds["seq"]).alias("seq"))

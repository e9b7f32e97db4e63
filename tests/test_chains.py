"""Accepted events by brute force, a hot key over many runs among them; users as bitmaps; whole exports; retries."""

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from vigilark.operators import chains, metrics

BEGIN = dt.datetime(2024, 1, 1)


def brute(rows, seconds):
    out, until = [], {}
    for key, ts, seq in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        if key not in until or (ts - until[key]).total_seconds() >= seconds:
            until[key] = ts
            out.append((key, ts, seq))
    return sorted(out, key=str)


@pytest.mark.parametrize("runs", [1, 4, 23])
def test_accepted_equals_brute_force(spark, runs):
    rnd = random.Random(runs)
    rows = [("hot", BEGIN + dt.timedelta(seconds=rnd.randrange(40_000)), k) for k in range(1500)]
    rows += [(rnd.choice(["a", "b", "c", None]), BEGIN + dt.timedelta(seconds=rnd.randrange(9000)), k) for k in range(300)]
    rows += [("lone", BEGIN, 1), ("twice", BEGIN, 1), ("twice", BEGIN, 1), ("even", BEGIN, 2), ("even", BEGIN, 1), *[("exact", BEGIN + dt.timedelta(seconds=600 * k), k) for k in range(40)]]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq long").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(runs))
    try:
        got = chains.accepted(df, 600)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 600)
        assert dict(got.dtypes) == {"key": "string", "ts": "timestamp", "seq": "bigint"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert chains.accepted(df.limit(0)).count() == 0


def test_next_events_of_one_key_take_many_tasks(spark):
    df = spark.range(4000).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("at"), F.col("id").alias("seq"))
    got = chains.next_events(df, 95)
    assert sorted((r.at, r.next_at) for r in got.collect()) == [(10 * k, 10 * (k + 10)) for k in range(3990)]


def test_numbers_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(metrics, "NUMBERED_AT_ONCE", 40)
    got = metrics.numbered(spark.range(1000).select(F.concat(F.lit("v"), "id").alias("v"))).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and len({r.v for r in got}) == 1000


def test_spans_count_users_exactly(spark):
    rnd = random.Random(6)
    now = dt.datetime(2024, 3, 1, 7, 30)
    rows = [(k, f"u{rnd.randrange(300)}", rnd.choice(metrics.KINDS), now - dt.timedelta(seconds=rnd.choice([0, 86_400, 86_401, 86_400 * 7, 86_400 * 7 + 1, rnd.randrange(2_000_000)]))) for k in range(4000)]
    rows.append((9999, "u1", "other", now))
    e = spark.createDataFrame(rows, "event_id long, email string, event string, created_at timestamp")
    got = {r.span: r for r in metrics.spans(e, {"all": None, "1": 1, "3": 3, "7": 7, "30": 30}).collect()}
    for span, days in (("all", 10_000), ("1", 1), ("3", 3), ("7", 7), ("30", 30)):
        inside = [r for r in rows if now - r[3] <= dt.timedelta(days=days)]
        assert (got[span].events, got[span].users) == (len(inside), len({r[1] for r in inside}))
        assert [got[span][k] for k in metrics.KINDS] == [sum(r[2] == k for r in inside) for k in metrics.KINDS]


def test_exports_read_back(spark):
    at = dt.datetime(2024, 1, 5, 1, 2, 3, 45)
    rows = [(1, "a@b", "s", 5, "bug", 'x, "y"\nz', None, at), (2, "c@d", "t", 1, "other", "", "i2", dt.datetime(2024, 1, 5)), (3, "e", "u", 2, "bug", "a\rb", "i,3", at)]
    f = spark.createDataFrame(rows, "feedback_id long, email string, scan_id string, rating int, category string, comment string, issue_id string, created_at timestamp")
    lines = [r.line for r in metrics.feedback_lines(f).orderBy(F.col("feedback_id").asc_nulls_first()).collect()]
    back = list(csv.reader(io.StringIO("\r\n".join(lines) + "\r\n", newline="")))
    assert back[0] == list(metrics.ITEM) and back[1] == ["1", "a@b", "s", "5", "bug", 'x, "y"\nz', "", "2024-01-05T01:02:03.000045+00:00"]
    assert back[2][5:] == ["", "i2", "2024-01-05T00:00:00+00:00"] and back[3][5:7] == ["a\rb", "i,3"]
    out = io.StringIO()
    csv.writer(out).writerows([back[0], *back[1:]])
    assert out.getvalue() == "\r\n".join(lines) + "\r\n"
    e = spark.createDataFrame([(1, "a", "scan_started", at), (2, "a", "scan_started", at), (3, "b", "scan_completed", at)], "event_id long, email string, event string, created_at timestamp")
    head, row = [r.line for r in metrics.csv_lines(metrics.summary(e), metrics.SUMMARY).collect()]
    told = dict(zip(head.split(","), row.split(",")))
    assert len(told) == 22 and told["total_events"] == "3" and told["unique_users"] == "2" and told["completion_rate_24h"] == "50.00" and told["unlock_conversion_rate"] == "0.00"

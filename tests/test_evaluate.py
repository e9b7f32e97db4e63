"""Scores by hand, attempts and waits by a plain loop, places by a sort, texts of all categories."""

import random

from pyspark.sql import functions as F

from vigilark.operators import classify, evaluate, explain, jobs, report


def test_scores_and_their_change(spark):
    want = spark.createDataFrame([(1, "sql"), (2, "sql"), (3, "xss"), (4, None), (5, None), (6, "sql")], "file long, want string")
    got = spark.createDataFrame([(1, "sql", True), (1, "xss", True), (2, "cmd", True), (4, "cmd", True), (4, "sql", True), (5, "sql", False), (2, "sql", False), (6, "sql", True)], "file long, category string, valid boolean")
    both = evaluate.judged(want, got)
    verdicts = evaluate.of(both, "after")
    assert {(1, "sql", "TP"), (2, "sql", "TP"), (5, "sql", "FP")} <= set(map(tuple, evaluate.of(both, "before").collect()))
    assert sorted(map(tuple, verdicts.collect())) == [(1, "sql", "TP"), (2, "sql", "FN"), (3, "xss", "FN"), (4, "cmd", "FP"), (4, "sql", "FP"), (6, "sql", "TP")]
    after = {r.category: r for r in evaluate.scores(verdicts).collect()}
    assert (after["sql"].tp, after["sql"].fp, after["sql"].fn) == (2, 1, 1) and abs(after["sql"].f1 - 2 / 3) < 1e-9
    assert (after["xss"].precision, after["xss"].recall, after["xss"].f1) == (0, 0, 0) and after["cmd"].fp == 1
    assert (after["all"].tp, after["all"].fp, after["all"].fn) == (2, 2, 2) and after["all"].precision == after["all"].recall == 0.5
    before = evaluate.scores(evaluate.of(evaluate.judged(want, got.limit(0)), "before"))
    delta = {r.category: r for r in evaluate.change(before, evaluate.scores(verdicts)).collect()}
    assert (delta["all"].tp, delta["all"].fp, delta["all"].fn) == (2, 2, -2) and delta["cmd"].fp == 1 and delta["xss"].fn == 0
    assert evaluate.scores(verdicts.limit(0)).collect()[0].asDict() == {"category": "all", "tp": 0, "fp": 0, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_the_policy_drops_false_alarms(spark):
    rows = {r.category: r for r in evaluate._change(spark, "/root/testdata/sf0.001").collect()}
    assert rows["all"].fp < 0 and rows["weak_random"].fp < 0


def test_attempts_and_waits(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(4), k, rnd.random() < 0.2, rnd.choice(["timeout", "HTTP 503", "parser broke", None])) for k in range(300)]
    want, state = set(), {}
    for job, seq, done, message in rows:
        attempt, waited = state.get(job, (1, 0))
        passing = not done and message in ("timeout", "HTTP 503")
        verdict = "done" if done else "retry" if passing and attempt < 3 else "failed"
        wait = min(12, 2**attempt) if verdict == "retry" else 0
        want.add((job, seq, attempt, verdict, wait, waited + wait))
        state[job] = (attempt + 1, waited + wait) if verdict == "retry" else (1, 0)
    df = spark.createDataFrame(rows, "job_id long, seq long, done boolean, message string")
    assert {tuple(r) for r in jobs.attempts(df).select("job_id", "seq", "attempt", "verdict", "wait", "waited").collect()} == want


def test_places_equal_a_sort(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.choice([1, 2, None]), rnd.randrange(4)) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, x int, y int").repartition(4)
    got = {r.k: r.place for r in report.places(df, "g", {"x": F.col("x"), "y": F.col("y")}, ["k"]).collect()}
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), -r[3], r[1]))
        assert [got[r[1]] for r in order] == list(range(1, len(order) + 1))


def test_every_category_is_explained(spark):
    told = {c for _, c, _ in classify.IMPROVEMENTS} | {c for _, c in classify.EXACT} | {classify.UNVERIFIED, "Weak Random Generator Usage", "Exception Detail Exposure", "Insecure HTTP Usage"}
    assert told <= explain.TEXTS.keys()
    rows = [("SQL Injection", "a.py", " q = x + y "), ("Something New", "", None), (None, None, "")]
    r = explain.explained(spark.createDataFrame(rows, "category string, file string, evidence string")).collect()
    assert "a.py" in r[0].explanation and r[0].exact_fix == "Before:\nq = x + y\n\nAfter:\ncursor.execute(query, (value,))" and "bound parameters" in r[0].advice
    assert r[1].explanation == r[2].explanation == "A pattern in this code needs a look." and "# the line that was found" in r[2].exact_fix

"""Cases by hand: artifacts of reports, issues, queues, stores, proposed fixes."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vigilark.operators import artifacts, context, issues, jobs, metrics, proposals

FOUND = "ordinal long, repo string, scan long, severity string, category string, title string, file string, line int, fix_description string, exploitability string, exploitability_level string"


def found(spark, *rows):
    return spark.createDataFrame(list(rows), FOUND)


def test_scenarios_and_their_confidence(spark):
    f = found(
        spark, (1, "r", 1, "HIGH", "SQL Injection", "t", "a", 1, None, "reachable", "high"), (2, "r", 1, "LOW", "SQL Injection", "t", "a", 1, None, "sure", None),
        (3, "r", 1, "MEDIUM", "Odd", "t", "a", 1, None, None, "LOW"), (4, "r", 1, "INFO", None, "t", "a", 1, None, "", ""),
    )
    r = {x.ordinal: x for x in artifacts.with_exploit(f).collect()}
    assert r[1].exploitability == "REACHABLE" and r[1].exploitability_confidence == 0.85 and r[1].exploitability_label == "LIKELY" and len(r[1].scenario) == 4
    assert r[2].exploitability == "UNKNOWN" and r[2].exploitability_label == "UNCLEAR" and r[2].scenario is None
    assert r[3].scenario == artifacts.ANY_SCENARIO and r[4].scenario is None


def test_summary_keeps_counts_whole_and_the_first_findings_in_order(spark):
    f = found(spark, *[(k, "r", k // 40, ["CRITICAL", "high", "odd"][k % 3], "c", "t", f"f{k}", k, None, "", "") for k in reversed(range(80))])
    r = {x.scan: x for x in artifacts.scan_summary(f, "scan").collect()}
    assert r[0].issues_total == 40 and r[0].critical == 14 and r[0].high == 13 and r[0].low == r[0].info == 0
    assert [x["line"] for x in json.loads(r[1].top_findings)] == list(range(40, 65))
    assert artifacts.scan_summary(f.limit(0), "scan").count() == 0


def test_comment_with_and_without_fixes(spark):
    f = found(spark, (2, "r", 1, "odd", "c", "B", "b", None, "", "", ""), (1, "r", 1, "HIGH", "c", "A", "a", 3, "Bind", "", ""))
    body = artifacts.comment(f, "scan", branch=F.lit("fix")).first().body
    assert body == "## 🔒 Security Scan\n\n### 🟠 A\n**File:** `a` - Line 3\n**Severity:** HIGH\n**Fix:** Bind\n\n### ⚪ B\n**File:** `b` - Line ?\n**Severity:** ODD\n\n✅ **Auto-fix committed to branch:** `fix`\nReview and merge to apply the fix.\n\n---"
    assert "Auto-fix" not in artifacts.comment(f, "scan").first().body


def test_badge_of_the_latest_scan(spark):
    scans = spark.createDataFrame([("a", 1, 90), ("a", 2, 49), ("b", 1, 0), ("c", 1, 130)], "repo string, scan long, risk_score int")
    r = {x.repo: x.badge for x in artifacts.badge(scans, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo string")).collect()}
    assert r == {"a": "security%3A49%2F100-red", "b": "security%3A85%2F100-brightgreen", "c": "security%3A100%2F100-brightgreen", "d": "security%3A85%2F100-brightgreen"}


def test_run_artifact_of_no_repository(spark):
    r = artifacts.run_artifact(spark.createDataFrame([], "id string, passed boolean"), "x").collect()
    assert [(x.kind, json.loads(x.line)) for x in r] == [("run", {"run_id": "x", "total_repos": 0, "passed_repos": 0, "failed_repos": 0})]


def test_job_records_ignore_what_has_no_job(spark):
    log = [(1, 1, "run"), (1, 2, "start"), (1, 3, "retry"), (1, 4, "run"), (1, 5, "retry"), (2, 1, "complete"), (3, 1, "start"), (4, 1, "start"), (4, 2, "fail"), (4, 3, "retry"), (5, 1, "retry"), (5, 2, "fail"), (5, 3, "start")]
    r = {x.job_id: (x.status, x.stage, x.retries) for x in jobs.job_records(spark.createDataFrame(log, "job_id long, seq long, action string")).collect()}
    assert r == {1: ("running", "retrying", 2), 3: ("pending", "queued", 0), 4: ("failed", "retrying", 1), 5: ("pending", "queued", 0)}


def test_queue_gives_expired_leases_back_at_its_tail(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, "queued", at(0)), (2, 1, "processing", at(1)), (3, 2, "queued", at(5)), (4, 3, "queued", at(2)), (5, 3, "done", at(3)), (6, 4, "processing", at(30)), (7, 5, "queued", at(31))]
    j = spark.createDataFrame([(a, b, c, d, "w") for a, b, c, d in rows], "seq long, job_id long, state string, ts timestamp_ntz, worker string")
    r = jobs.next_jobs(j).orderBy("requeued", "since").collect()
    assert [(x.job_id, x.requeued, x.attempt) for x in r] == [(2, 0, 1), (5, 0, 1), (1, 1, 2)]


def test_check_runs_are_found_then_stored_then_created(spark):
    req = spark.createDataFrame([("1", "O/R", "A"), ("2", "o/r", "a"), ("3", "o/r", "b"), ("4", "x", "a")], "external_id string, repo string, sha string")
    remote = spark.createDataFrame([("o/r", "a", "1", "scan", 9, 2), ("o/r", "a", "1", "scan", 8, 1), ("o/r", "a", "1", "lint", 7, 0), ("o/r", "b", "1", "scan", 6, 0)], "repo string, sha string, external_id string, name string, run_id long, pos long")
    local = spark.createDataFrame([("o/r", "a", 5, 1), ("o/r", "a", 4, 2)], "repo string, sha string, run_id long, seq long")
    r = {x.external_id: (x.run_id, x.how) for x in jobs.check_runs(req, remote, local, "scan").collect()}
    assert r == {"1": (8, "found"), "2": (4, "stored"), "3": (None, "created"), "4": (None, "created")}


def test_check_runs_without_a_repository_meet_nothing_and_zero_is_no_number(spark):
    req = spark.createDataFrame([("1", None, "a"), ("2", "r", "b"), ("3", "r", None), ("4", "r", "c")], "external_id string, repo string, sha string")
    remote = spark.createDataFrame([(None, "a", "1", "scan", 9, 1), ("r", "b", "2", "scan", 0, 1), ("r", None, "3", "scan", 5, 1)], "repo string, sha string, external_id string, name string, run_id long, pos long")
    local = spark.createDataFrame([("r", "b", 4, 1), ("r", "c", 0, 1)], "repo string, sha string, run_id long, seq long")
    r = {x.external_id: (x.run_id, x.how) for x in jobs.check_runs(req, remote, local, "scan").collect()}
    assert r == {"1": (None, "created"), "2": (0, "stored"), "3": (None, "created"), "4": (0, "created")}


def test_accepted_after_the_time_to_live(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = spark.createDataFrame([("a", at(0), 1), ("a", at(600), 2), ("a", at(900), 3), ("a", at(1700), 4), ("b", at(10), 5), ("b", at(10), 6)], "key string, ts timestamp_ntz, seq long")
    assert sorted(x.seq for x in jobs.accepted(e, 900).collect()) == [1, 3, 5]


def test_three_ways_to_store_a_row_again(spark):
    r = spark.createDataFrame([("a", 1, 10, "x"), ("a", 2, 20, "y"), ("b", 1, 30, None)], "k string, at int, made int, v string")
    assert {(x.k, x.made, x.v) for x in metrics.upserted(r, "k", ["at"], ["made"]).collect()} == {("a", 10, "y"), ("b", 30, None)}
    assert {(x.k, x.v) for x in metrics.first_only(r, ["k"], ["at"]).collect()} == {("a", "x"), ("b", None)}


def test_reasons_and_objects_of_empty_texts(spark):
    x = spark.createDataFrame([(None, None, None), ("High", "before: a\nafter: b", None)], "c string, f string, p string")
    assert [r[0] for r in x.select(proposals.turned_down(F.col("c"), F.col("f"), F.col("p"))).collect()] == ["invalid-fix-format", None]
    y = spark.createDataFrame([(None,), ("{}",), ("```{\"a\": [1, 2]}```",), ("{\"a\": 1",)], "t string")
    assert [r[0] for r in y.select(proposals.json_object(F.col("t"))).collect()] == [None, "{}", '{"a":[1,2]}', None]


def test_fixed_text_changes_the_first_snippet_alone(spark):
    x = spark.createDataFrame([("a.b a.b", " a.b ", "c\n"), ("a", "b", "c"), ("a", "a", "a"), ("a", None, "b"), (None, "a", "b"), ("$1", "$1", "\\0")], "t string, o string, n string")
    assert [r[0] for r in x.select(context.fixed_text(*map(F.col, "ton"))).collect()] == ["c a.b", None, None, None, None, "\\0"]


def test_issues_of_sparse_rows(spark):
    schema = "name string, version string, ecosystem string, manifest_path string, line int, severity string, cve string, summary string, fix_version string, confidence int, network_access boolean, auth_required boolean, public_exploit boolean, score int, exploit_level string, impact string"
    rows = [("Flask", "1", "pypi", None, None, "critical", None, "Known vulnerable dependency detected.", None, None, False, None, None, None, None, None), ("x", "1", "npm", "Docs\\package.json", 0, "HIGH", "CVE-1", "Bad CVE-1", "2", 100, True, False, True, 9, "HIGH", "DoS")]
    a, b = issues.dependency_issues(spark.createDataFrame(rows, schema)).orderBy("name").collect()
    assert (a.title, a.fix_command, a.confidence, a.exploitability, a.exploitability_level, a.rule_id, a.line, a.impact_summary) == ("[HIGH] Dependency Vulnerability", "Upgrade Flask to 3.0.0", 92, "LOCAL_ONLY", "HIGH", "osv.osv-unknown", 1, "Unknown")
    assert (b.severity, b.confidence, b.exploitability_level, b.exploitability, b.impact_summary, b.fix_command, b.danger) == ("INFO", 60, "LOW", "REMOTE", "Remote Code Execution (RCE)", "npm install x@2", "Bad CVE-1 (non-production dependency path)")
    s = issues.secret_issues(spark.createDataFrame([(None, None, None, None, None, None)], "name string, severity string, file string, line int, snippet string, fix string")).first()
    assert (s.title, s.rule_id, s.file, s.line, s.confidence) == ("[HIGH] Hardcoded Secrets", "secret.potential_secret", "unknown", 1, 95) and s.message.startswith("Potential Secret detected. Move")

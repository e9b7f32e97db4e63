"""What a report says and leaves behind: scenarios, risk labels, summaries, run artifacts, comments, check runs, badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import register
from ..sources.fixtures import FINDINGS, findings, read
from .report import FIX_MINUTES, IMPACT, risk_score

# fixed values: how a category is exploited, first match wins; levels of confidence by exploitability
SCENARIOS = [
    (
        ("sql injection",),
        [
            "Attacker sends crafted input through a request parameter.",
            "Input is concatenated into a SQL statement without parameter binding.",
            "Database executes attacker-controlled query logic.",
            "Attacker bypasses filters and reads or modifies sensitive records.",
        ],
    ),
    (
        ("command injection",),
        [
            "Attacker provides payload through user-controlled input.",
            "Application builds a shell command with unsanitized input.",
            "OS executes injected command tokens.",
            "Attacker gains remote command execution on the host.",
        ],
    ),
    (
        ("hardcoded secrets", "credential in url"),
        [
            "Repository or logs expose embedded secret material.",
            "Attacker extracts key or credential from source artifacts.",
            "Credential is reused against target service endpoints.",
            "Attacker performs unauthorized data access or service abuse.",
        ],
    ),
    (
        ("open redirect",),
        [
            "Attacker crafts a malicious redirect target URL.",
            "Application redirects user without strict destination validation.",
            "User is sent to attacker-controlled phishing endpoint.",
            "Credentials or session tokens can be harvested.",
        ],
    ),
    (
        ("dependency vulnerability",),
        [
            "Application includes a dependency with a known public vulnerability.",
            "Attacker targets the vulnerable package behavior in runtime paths.",
            "Exploit leads to data exposure, integrity impact, or service compromise.",
            "Upgrading dependency to fixed version removes the known attack path.",
        ],
    ),
]
ANY_SCENARIO = [
    "Attacker reaches the vulnerable code path using untrusted input.",
    "Input is processed without sufficient security controls.",
    "Application behavior can be manipulated to produce unsafe outcomes.",
    "Issue can lead to confidentiality, integrity, or availability impact.",
]
REACH = ("REMOTE", "AUTHENTICATED", "LOCAL_ONLY", "UNKNOWN", "REACHABLE", "UNREACHABLE")
SURE = {"HIGH": 0.85, "MEDIUM": 0.6, "LOW": 0.35}
MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}
TOP = 25


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def scenario(category: Column) -> Column:
    """The steps of an attack on a finding of a category."""
    low = F.lower(F.coalesce(category, F.lit("")))
    steps = _strings(ANY_SCENARIO)
    for words, told in reversed(SCENARIOS):
        steps = F.when(F.exists(_strings(list(words)), lambda w: F.contains(low, w)), _strings(told)).otherwise(steps)
    return steps


def with_exploit(f: DataFrame) -> DataFrame:
    """Findings with reach, its confidence and label, impact, minutes to fix, and steps of an attack from medium severity on."""
    reach = F.upper(F.coalesce(F.col("exploitability"), F.lit("")))
    sure = F.coalesce(F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])[F.upper(F.coalesce("exploitability_level", F.lit("")))], F.lit(0.25))
    x = f.withColumn("exploitability", F.when(reach.isin(*REACH), reach).otherwise("UNKNOWN")).withColumn("exploitability_confidence", sure)
    return x.withColumns({
        "exploitability_label": F.when(sure > 0.75, "LIKELY").when(sure >= 0.4, "POSSIBLY").otherwise("UNCLEAR"), "impact": F.expr(IMPACT), "fix_minutes": F.expr(FIX_MINUTES),
        "scenario": F.when(F.upper("severity").isin("CRITICAL", "HIGH", "MEDIUM"), scenario(F.col("category"))),
    })


def risk_label(score: Column, critical: Column, insufficient: Column) -> Column:
    return F.when(insufficient, "Limited Coverage").when(critical, "Immediate action required").when(score >= 80, "Low Risk").when(score >= 50, "Moderate risk").otherwise("High risk")


def insufficient(files: Column, checks: Column, issues: Column) -> Column:
    """Nothing was found, and nothing was looked at or for."""
    return (issues == 0) & ((files <= 0) | (checks <= 0))


def scan_summary(f: DataFrame, *keys: str, top: int = TOP) -> DataFrame:
    """Findings of a scan counted by severity, and its first ones in full as JSON."""
    level = F.upper("severity")
    counts = [F.count_if(level == x).alias(x.lower()) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]
    n = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues_total"), *counts)
    # a scan of very many findings gives no more than its first ones to a group
    first = f.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("ordinal"))).where(F.col("_nth") <= top)
    told = F.transform(F.sort_array(F.collect_list(F.struct("_nth", level.alias("severity"), "category", "file", "line"))), lambda x: F.struct(*[x[c].alias(c) for c in ("severity", "category", "file", "line")]))
    return n.join(first.groupBy(*keys).agg(F.to_json(told).alias("top_findings")), list(keys))


def run_artifact(results: DataFrame, run_id: str) -> DataFrame:
    """results (id, passed, ...) as lines of JSON: totals of the run, then a line a repository, so that no line grows with the run."""
    total = results.agg(F.count(F.lit(1)).alias("total_repos"), F.count_if("passed").alias("passed_repos"), F.count_if(~F.col("passed")).alias("failed_repos"))
    head = total.select(F.lit("run").alias("kind"), F.to_json(F.struct(F.lit(run_id).alias("run_id"), "total_repos", "passed_repos", "failed_repos")).alias("line"))
    return head.unionByName(results.select(F.lit("result").alias("kind"), F.to_json(F.struct(*results.columns)).alias("line")))


def comment(f: DataFrame, *keys: str, branch: Column | None = None) -> DataFrame:
    """One text a change: its findings in order with severity, place and fix, and the branch that holds fixes."""
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.lower("severity")], F.lit("⚪"))
    fix = F.when(F.coalesce("fix_description", F.lit("")) != "", F.concat(F.lit("**Fix:** "), "fix_description"))
    lines = [F.concat(F.lit("### "), mark, F.lit(" "), "title"), F.concat(F.lit("**File:** `"), "file", F.lit("` - Line "), F.coalesce(F.col("line").cast("string"), F.lit("?"))), F.concat(F.lit("**Severity:** "), F.upper("severity")), fix, F.lit("")]
    each = F.struct("ordinal", F.concat_ws("\n", *lines).alias("text"))
    fixed = [] if branch is None else [F.when(F.coalesce(branch, F.lit("")) != "", F.concat(F.lit("✅ **Auto-fix committed to branch:** `"), branch, F.lit("`\nReview and merge to apply the fix.")))]
    body = F.concat_ws("\n", F.lit("## 🔒 Security Scan\n"), F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["text"]), "\n"), *[F.max(b) for b in fixed], F.lit("\n---"))
    return f.groupBy(*keys).agg(body.alias("body"))


def check_run(severity_counts: DataFrame, finished: Column, failed: Column) -> DataFrame:
    """status and conclusion of a scan's check run, with its summary."""
    conclusion = F.when(finished, F.when(failed, "failure").otherwise("success"))
    return severity_counts.withColumns({"status": F.when(finished, "completed").otherwise("in_progress"), "conclusion": conclusion, "summary": F.format_string("HIGH: %d, MEDIUM: %d, LOW: %d", "high", "medium", "low")})


def badge(scans: DataFrame, repos: DataFrame) -> DataFrame:
    """repos with the label of their latest scan (repo, scan, risk_score); 85 without one, and for a score of 0."""
    latest = scans.groupBy("repo").agg(F.max_by("risk_score", "scan").alias("score"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.nullif("score", F.lit(0)), F.lit(85))))
    x = repos.join(latest, "repo", "left").withColumn("score", score)
    return x.withColumn("badge", F.concat(F.lit("security%3A"), F.col("score").cast("string"), F.lit("%2F100-"), F.when(F.col("score") >= 80, "brightgreen").when(F.col("score") >= 50, "yellow").otherwise("red")))


_FOUND = FINDINGS + ", scanned AS (SELECT *, ordinal // 50 AS scan FROM findings)"


def _q(name: str, fn, sql: str) -> None:
    register(name, lambda s, d: fn(findings(s, d).withColumn("scan", F.expr("ordinal DIV 50"))), f"WITH {_FOUND}{sql}")


_REACHED = "CASE ordinal % 4 WHEN 0 THEN 'reachable' WHEN 1 THEN 'remote' WHEN 2 THEN 'likely' END"
_told = lambda xs: "['" + "', '".join(xs) + "']"
_q(
    "c25_exploit_texts",
    lambda f: with_exploit(f.withColumn("exploitability", F.expr(_REACHED))).select("ordinal", "exploitability", "exploitability_confidence", "exploitability_label", "impact", "fix_minutes", F.array_join("scenario", "|").alias("scenario")),
    f""", sure(exploitability_level, exploitability_confidence, exploitability_label) AS (VALUES ('HIGH', 0.85::DOUBLE, 'LIKELY'), ('MEDIUM', 0.6, 'POSSIBLY'), ('LOW', 0.35, 'UNCLEAR'), ('', 0.25, 'UNCLEAR')),
minutes(severity, fix_minutes) AS (VALUES ('CRITICAL', 30), ('HIGH', 20), ('MEDIUM', 12), ('LOW', 8), ('INFO', 8)),
texts(category, impact, steps) AS (VALUES
  ('SQL Injection', 'May allow attackers to read or modify sensitive data.', {_told(SCENARIOS[0][1])}), ('Command Injection', 'May allow attackers to read or modify sensitive data.', {_told(SCENARIOS[1][1])}),
  ('Hardcoded Secrets', 'May enable account takeover or unauthorized access.', {_told(SCENARIOS[2][1])}), ('Open Redirect', 'May allow attackers to compromise confidentiality, integrity, or availability.', {_told(SCENARIOS[3][1])}),
  ('Weak Input Validation', 'May allow attackers to compromise confidentiality, integrity, or availability.', {_told(ANY_SCENARIO)}), ('Insecure HTTP Usage', 'May allow attackers to compromise confidentiality, integrity, or availability.', {_told(ANY_SCENARIO)}))
SELECT ordinal, ['REACHABLE', 'REMOTE', 'UNKNOWN', 'UNKNOWN'][(ordinal % 4)::INT + 1] AS exploitability, exploitability_confidence, exploitability_label, impact, fix_minutes,
  CASE WHEN fix_minutes > 8 THEN array_to_string(steps, '|') END AS scenario
FROM scanned JOIN sure USING (exploitability_level) JOIN minutes USING (severity) JOIN texts USING (category)""",
)


def _labelled(f: DataFrame) -> DataFrame:
    g = f.groupBy("repo", "file").agg(
        F.count_if(F.col("ordinal") % 2 == 0).alias("issues"), F.count_if(F.col("line") > 10).alias("files"), F.count_if(F.col("confidence") > 70).alias("checks"),
        F.max(F.col("confidence")).alias("score"), F.bool_or(F.col("severity") == "CRITICAL").alias("critical"),
    )
    gap = insufficient(F.col("files"), F.col("checks"), F.col("issues"))
    return g.select("repo", "file", gap.alias("insufficient"), risk_label(F.col("score"), F.col("critical"), gap).alias("label"))


_q(
    "c32_coverage_state",
    _labelled,
    """, g AS (SELECT repo, file, NOT bool_or(ordinal % 2 = 0) AND NOT (bool_or(line > 10) AND bool_or(confidence > 70)) AS insufficient, max(confidence) AS score, bool_or(severity = 'CRITICAL') AS critical FROM scanned GROUP BY 1, 2)
SELECT repo, file, insufficient, CASE WHEN insufficient THEN 'Limited Coverage' WHEN critical THEN 'Immediate action required' WHEN score < 50 THEN 'High risk' WHEN score < 80 THEN 'Moderate risk' ELSE 'Low Risk' END AS label FROM g""",
)
_q(
    "n3_scan_summary",
    lambda f: scan_summary(f, "scan", top=5),
    """, c AS (SELECT scan, count(*) AS issues_total, sum((severity = 'CRITICAL')::BIGINT)::BIGINT AS critical, sum((severity = 'HIGH')::BIGINT)::BIGINT AS high, sum((severity = 'MEDIUM')::BIGINT)::BIGINT AS medium,
  sum((severity = 'LOW')::BIGINT)::BIGINT AS low, sum((severity = 'INFO')::BIGINT)::BIGINT AS info FROM scanned GROUP BY 1),
t AS (SELECT scan, to_json(list({'severity': severity, 'category': category, 'file': file, 'line': line} ORDER BY ordinal)[:5])::VARCHAR AS top_findings FROM scanned GROUP BY 1) SELECT * FROM c JOIN t USING (scan)""",
)
_q(
    "n5_comment",
    lambda f: comment(f.withColumns({"title": F.concat(F.lit("["), "severity", F.lit("] "), "category"), "fix_description": F.expr("CASE WHEN line % 3 = 0 THEN 'Bind ' || file END")}), "scan", branch=F.expr("CASE WHEN scan % 2 = 0 THEN 'fix-' || scan END")),
    """, l AS (SELECT scan, ordinal, '### ' || CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' WHEN 'LOW' THEN '🟢' ELSE '⚪' END || ' [' || severity || '] ' || category || chr(10) || '**File:** `' || file || '` - Line ' || line || chr(10)
  || '**Severity:** ' || severity || chr(10) || CASE WHEN line % 3 = 0 THEN '**Fix:** Bind ' || file || chr(10) ELSE '' END AS t FROM scanned)
SELECT scan, '## 🔒 Security Scan' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY ordinal) || chr(10) || CASE WHEN scan % 2 = 0 THEN '✅ **Auto-fix committed to branch:** `fix-' || scan || '`' || chr(10) || 'Review and merge to apply the fix.' || chr(10) ELSE '' END || chr(10) || '---' AS body FROM l GROUP BY scan""",
)


def _checks(f: DataFrame) -> DataFrame:
    n = f.groupBy("scan").agg(*[F.count_if(F.col("severity") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")])
    return check_run(n, F.col("scan") % 3 != 0, F.col("scan") % 5 == 0).select("scan", "status", "conclusion", "summary")


_q(
    "n5_check_run",
    _checks,
    """ SELECT scan, if(scan % 3 = 0, 'in_progress', 'completed') AS status, CASE WHEN scan % 3 = 0 THEN NULL WHEN scan % 5 = 0 THEN 'failure' ELSE 'success' END AS conclusion,
  'HIGH: ' || count(*) FILTER (severity = 'HIGH') || ', MEDIUM: ' || count(*) FILTER (severity = 'MEDIUM') || ', LOW: ' || count(*) FILTER (severity = 'LOW') AS summary FROM scanned GROUP BY scan""",
)
_q(
    "n5_badge",
    lambda f: badge(risk_score(f.withColumn("scan", F.expr("ordinal DIV 9")), "repo", "scan"), f.select("repo").distinct().unionByName(f.sparkSession.range(1).select(F.lit("none").alias("repo")))),
    """, p AS (SELECT repo, ordinal // 9 AS scan, 100 - sum(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 ELSE 1 END) AS s FROM findings GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY scan DESC) = 1),
b AS (SELECT repo, CASE WHEN s <= 0 THEN 85 ELSE s END::INT AS score FROM p UNION ALL SELECT 'none', 85)
SELECT repo, score, 'security%3A' || score || '%2F100-' || CASE WHEN score < 50 THEN 'red' WHEN score < 80 THEN 'yellow' ELSE 'brightgreen' END AS badge FROM b""",
)


def _validated(s, d: str) -> DataFrame:
    g = read(s, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("id")).agg(F.count(F.lit(1)).alias("actual"), F.count_if(F.col("lang") == "en").alias("expected"))
    return g.select("id", "actual", "expected", (F.abs(F.col("actual") - F.col("expected")) <= 2).alias("passed"))


register(
    "n3_run_artifact",
    lambda s, d: run_artifact(_validated(s, d), "run-1"),
    """WITH v AS (SELECT coalesce(source, '') AS id, count(*) AS actual, count(*) FILTER (lang = 'en') AS expected FROM documents GROUP BY 1), r AS (SELECT *, actual - expected BETWEEN -2 AND 2 AS passed FROM v)
SELECT 'run' AS kind, to_json({'run_id': 'run-1', 'total_repos': count(*), 'passed_repos': count(*) FILTER (passed), 'failed_repos': count(*) FILTER (NOT passed)})::VARCHAR AS line FROM r UNION ALL SELECT 'result', to_json(r)::VARCHAR FROM r""",
)

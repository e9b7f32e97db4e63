"""Report operators over findings: dedup, arg-max, scores, summaries, ranking.

Every pick has the ordinal as its last key, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cases, has
from ..registry import register
from ..sources.fixtures import FINDINGS, findings
from ..sources.readers import json_report

PENALTY = "CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 WHEN 'INFO' THEN 1 ELSE 2 END"
RANK = "CASE upper(severity) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'INFO' THEN 0 ELSE 1 END"
EXPLOIT_RANK = "CASE upper(exploitability_level) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
TEST_MARKERS = ("/test", "test/", "tests/", ".test.", ".spec.", "_test.", "/__tests__/", "fixtures/")


def count_columns() -> list[Column]:
    """Findings by severity; other levels count as low."""
    level = F.upper(F.coalesce("severity", F.lit("LOW")))
    n = lambda cond: F.count_if(cond).cast("long")
    return [n(level == "CRITICAL").alias("critical"), n(level == "HIGH").alias("high"), n(level == "MEDIUM").alias("medium"), n(~level.isin("CRITICAL", "HIGH", "MEDIUM")).alias("low")]


def risk_column() -> Column:
    """100 less the penalties, never under 0."""
    return F.greatest(F.lit(0), F.lit(100) - F.sum(F.expr(PENALTY))).cast("int").alias("risk_score")


def severity_counts(f: DataFrame, *keys: str) -> DataFrame:
    return f.groupBy(*keys).agg(*count_columns())


def risk_score(f: DataFrame, *keys: str) -> DataFrame:
    return f.groupBy(*keys).agg(risk_column())


def display_score(f: DataFrame, *keys: str) -> DataFrame:
    """The score that a report shows: a curve for critical ones, a floor where only dependencies weigh. One shuffle on the keys."""
    dep = F.expr("lower(finding_type) = 'dependency_vuln' AND upper(severity) IN ('HIGH', 'MEDIUM')")
    a = f.groupBy(*keys).agg(*count_columns(), risk_column(), F.count_if(dep).alias("dep"), F.count(F.lit(1)).alias("n"))
    score = """CASE WHEN n = 0 THEN 100 WHEN critical = 0 AND high = 0 AND medium = 0 THEN greatest(90, 100 - least(low, 5) * 2)
      WHEN critical > 0 THEN least(risk_score, CASE critical WHEN 1 THEN 40 WHEN 2 THEN 32 WHEN 3 THEN 25 WHEN 4 THEN 18 ELSE 10 END)
      WHEN dep > 0 AND high + medium = dep THEN greatest(CASE WHEN dep >= 20 THEN 45 ELSE 55 END, risk_score) ELSE risk_score END"""
    label = "CASE WHEN critical > 0 THEN 'Immediate action required' WHEN display_score >= 80 THEN 'Low Risk' WHEN display_score >= 50 THEN 'Moderate risk' ELSE 'High risk' END"
    return a.withColumn("display_score", F.expr(score).cast("int")).withColumn("risk_label", F.expr(label)).select(*keys, "critical", "high", "medium", "low", "risk_score", "display_score", "risk_label")


_DISPLAY_SQL = f"""g AS (SELECT scan, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS low, greatest(0, 100 - sum({PENALTY}))::INT AS risk_score, count(*) AS n,
  count(*) FILTER (finding_type = 'dependency_vuln' AND severity IN ('HIGH', 'MEDIUM')) AS dep FROM (SELECT *, ordinal // 50 AS scan FROM findings) GROUP BY 1),
d AS (SELECT *, (CASE WHEN critical + high + medium = 0 THEN greatest(90, 100 - 2 * least(low, 5)) WHEN critical > 0 THEN least(risk_score, coalesce([40, 32, 25, 18][critical], 10))
  WHEN dep > 0 AND high + medium = dep THEN greatest(if(dep >= 20, 45, 55), risk_score) ELSE risk_score END)::INT AS display_score FROM g)"""


def _by_scan(f: DataFrame) -> DataFrame:
    return f.withColumn("scan", F.floor(F.col("ordinal") / 50).cast("long"))


def merge_keys() -> list[Column]:
    """What makes two findings the same: package, advisory and file, or file, line and category."""
    dep = F.lower(F.trim("finding_type")) == "dependency_vuln"
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return [dep.alias("k1"), F.when(dep, low("package")).otherwise(low("file")).alias("k2"), F.when(dep, low("cve")).otherwise(F.col("line").cast("string")).alias("k3"), F.when(dep, low("file")).otherwise(low("category")).alias("k4")]


def merge_duplicates(f: DataFrame) -> DataFrame:
    """One finding a key: the gravest, then surest, then first; at the place of the first, with the count."""
    rest = [c for c in f.columns if c != "repo"]
    keyed = f.select("repo", F.struct(*rest).alias("x"), *merge_keys(), F.struct((-F.expr(RANK)).alias("a"), F.coalesce(-F.col("confidence"), F.lit(1)).alias("b"), "ordinal").alias("_order"))
    # all three combine before the shuffle, so a place that is found very often is a row a task
    g = keyed.groupBy("repo", "k1", "k2", "k3", "k4").agg(F.min_by("x", "_order").alias("x"), F.count(F.lit(1)).alias("occurrence_count"), F.min("x.ordinal").alias("first_ordinal"))
    return g.select("repo", "x.*", "occurrence_count", "first_ordinal").select(*f.columns, "occurrence_count", "first_ordinal")


_MERGE_SQL = f"""m AS (SELECT *, CASE WHEN finding_type = 'dependency_vuln' THEN ['d', lower(trim(package)), lower(trim(cve)), lower(trim(file))] ELSE ['c', lower(trim(file)), line::VARCHAR, lower(trim(category))] END AS k FROM findings),
merged AS (SELECT *, count(*) OVER w AS occurrence_count, min(ordinal) OVER w AS first_ordinal FROM m WINDOW w AS (PARTITION BY repo, k)
  QUALIFY row_number() OVER (PARTITION BY repo, k ORDER BY {RANK} DESC, confidence DESC, ordinal) = 1)"""
_MERGED = ["repo", "ordinal", "first_ordinal", "severity", "confidence", "occurrence_count"]


def cross_scanner_dedup(f: DataFrame) -> DataFrame:
    """Places that one scanner reports keep all findings; places of several keep the surest, the first of equals."""
    w = W.partitionBy("repo", "file", "line", "category")
    several = F.size(F.collect_set("scanner").over(w)) > 1  # at most one entry a scanner
    nth = F.row_number().over(w.orderBy(F.desc("confidence"), "ordinal"))
    return f.withColumn("_many", several).withColumn("_nth", nth).where("NOT _many OR _nth = 1").drop("_many", "_nth")


COMPLEXITY = (
    "(CASE WHEN lower(category) IN ('sql injection', 'command injection', 'unsafe yaml deserialization', 'unsafe pickle deserialization') THEN 3 ELSE 0 END"
    " + CASE WHEN data_source = 'user_input' THEN 2 ELSE 0 END + CASE WHEN usage_context IN ('executed', 'database', 'parsed') THEN 2 ELSE 0 END"
    f" + CASE WHEN {has('lower(message || chr(32) || evidence)', ('request', 'input', 'argv', 'payload', 'query'))} THEN 1 ELSE 0 END"
    " + CASE WHEN occurrence_count > 1 THEN least(2, occurrence_count - 1) ELSE 0 END)"
)
IMPACT = cases(
    [
        (has("lower(category)", ("sql", "injection")), "'May allow attackers to read or modify sensitive data.'"),
        (has("lower(category)", ("command", "remote code")), "'May allow attackers to execute code on your server.'"),
        (has("lower(category)", ("auth", "credential", "secret")), "'May enable account takeover or unauthorized access.'"),
        (has("lower(category)", ("dependency vulnerability",)), "'May expose exploitable paths through vulnerable package behavior.'"),
    ],
    "'May allow attackers to compromise confidentiality, integrity, or availability.'",
)
FIX_MINUTES = "CASE upper(severity) WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 12 ELSE 8 END"


def places(x: DataFrame, group: str, classes: dict[str, Column], last: list) -> DataFrame:
    """x with `place`: 1, 2, ... in each group by classes, all descending, then by last.

    Classes are few, so their sizes tell where each begins, and only rows alike in all of them are ordered in one task,
    not a whole group.
    """
    x = x.withColumns({f"_c{k}": c for k, c in enumerate(classes.values())})
    names = [f"_c{k}" for k in range(len(classes))]
    before = W.partitionBy(group).orderBy(*[F.desc(c) for c in names]).rowsBetween(W.unboundedPreceding, -1)
    sizes = x.groupBy(group, *names).agg(F.count(F.lit(1)).alias("_n"))
    begin = sizes.select(group, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    same = F.col(f"x.{group}").eqNullSafe(F.col(f"b.{group}"))
    for c in names:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}"))
    nth = F.row_number().over(W.partitionBy(group, *names).orderBy(*last))
    return x.alias("x").join(begin.alias("b"), same).select("x.*", "_begin").withColumn("place", (F.col("_begin") + nth).cast("int")).drop("_begin", *names)


def ranked(merged: DataFrame) -> DataFrame:
    """Findings with their place in the report: five keys, all descending, ties in input order."""
    keys = {"exploit": F.expr(EXPLOIT_RANK), "rank": F.expr(RANK), "occurrences": F.col("occurrence_count"), "confidence": F.col("confidence"), "complexity": F.expr(COMPLEXITY)}
    return places(merged, "repo", keys, ["first_ordinal"])


_ORDER = f"{EXPLOIT_RANK} DESC, {RANK} DESC, occurrence_count DESC, confidence DESC, {COMPLEXITY} DESC, first_ordinal"


def file_summary(f: DataFrame) -> DataFrame:
    return f.groupBy("repo", "file").agg(F.sum("occurrence_count").alias("n"), F.min("first_ordinal").alias("o")).withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("n"), "o"))).drop("o")


def score_breakdown(f: DataFrame) -> DataFrame:
    """Three scores of 100 less penalties over distinct (file, line, category), test paths aside."""
    file = F.lower(F.replace("file", F.lit("\\"), F.lit("/")))
    first = F.row_number().over(W.partitionBy("repo", file, "line", F.lower("category")).orderBy("ordinal"))
    own = f.withColumn("_nth", first).where("_nth = 1").withColumn("_file", file).where(~F.expr(has("_file", TEST_MARKERS)))
    pen = "CASE upper(severity) WHEN 'CRITICAL' THEN 16 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 7 ELSE 3 END"
    total = lambda tokens: F.greatest(F.lit(0), F.lit(100) - F.sum(F.expr(f"CASE WHEN {has('lower(category)', tokens)} THEN {pen} ELSE 0 END"))).cast("int")
    return own.groupBy("repo").agg(
        total(("secret", "credential")).alias("secrets_management"),
        total(("sql", "xss", "input", "yaml", "pickle", "command", "eval", "ssti", "template injection")).alias("input_handling"),
        total(("command", "eval", "exception", "debug", "ssti")).alias("code_safety"),
    )


_BREAKDOWN_SQL = """u AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 16 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 7 ELSE 3 END AS pen FROM findings
  QUALIFY row_number() OVER (PARTITION BY repo, lower(file), line, lower(category) ORDER BY ordinal) = 1)
SELECT repo, greatest(0, 100 - coalesce(sum(pen) FILTER (regexp_matches(lower(category), 'secret|credential')), 0))::INT AS secrets_management,
  greatest(0, 100 - coalesce(sum(pen) FILTER (regexp_matches(lower(category), 'sql|xss|input|yaml|pickle|command|eval|ssti|template injection')), 0))::INT AS input_handling,
  greatest(0, 100 - coalesce(sum(pen) FILTER (regexp_matches(lower(category), 'command|eval|exception|debug|ssti')), 0))::INT AS code_safety
FROM u WHERE NOT regexp_matches(lower(file), '/test|test/|tests/|\\.test\\.|\\.spec\\.|_test\\.|/__tests__/|fixtures/') GROUP BY repo"""


def _q(name: str, fn, sql: str) -> None:
    register(name, lambda spark, d: fn(findings(spark, d)), f"WITH {FINDINGS}{sql}")


_q("a1_severity_counts", lambda f: severity_counts(_by_scan(f), "scan"), "\nSELECT ordinal // 50 AS scan, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity IN ('LOW', 'INFO')) AS low FROM findings GROUP BY 1")
_q("a2_risk_score", lambda f: risk_score(_by_scan(f), "scan"), f"\nSELECT ordinal // 50 AS scan, greatest(0, 100 - sum({PENALTY}))::INT AS risk_score FROM findings GROUP BY 1")
_q("a3_display_score", lambda f: display_score(_by_scan(f), "scan"), f", {_DISPLAY_SQL} SELECT scan, critical, high, medium, low, risk_score, display_score, CASE WHEN critical > 0 THEN 'Immediate action required' WHEN display_score >= 80 THEN 'Low Risk' WHEN display_score >= 50 THEN 'Moderate risk' ELSE 'High risk' END AS risk_label FROM d")
_q("a4_score_breakdown", score_breakdown, f", {_BREAKDOWN_SQL}")
_q("a5_file_summary", lambda f: file_summary(merge_duplicates(f)), f", {_MERGE_SQL} SELECT repo, file, sum(occurrence_count)::BIGINT AS n, row_number() OVER (PARTITION BY repo ORDER BY sum(occurrence_count) DESC, min(first_ordinal)) AS place FROM merged GROUP BY 1, 2")
_q("a6_merge_duplicates", lambda f: merge_duplicates(f).select(*_MERGED), f", {_MERGE_SQL} SELECT {', '.join(_MERGED)} FROM merged")
_q("a7_cross_scanner_dedup", lambda f: cross_scanner_dedup(f).select("ordinal", "repo", "scanner", "confidence"), "\nSELECT ordinal, repo, scanner, confidence FROM (SELECT *, count(DISTINCT scanner) OVER (PARTITION BY repo, file, line, category) AS n, row_number() OVER (PARTITION BY repo, file, line, category ORDER BY confidence DESC, ordinal) AS nth FROM findings) WHERE n = 1 OR nth = 1")
_q("a11_distinct_sets", lambda f: f.groupBy("repo").agg(F.countDistinct("cve").alias("cves"), F.countDistinct("scanner").alias("scanners"), F.countDistinct("file").alias("files")), "\nSELECT repo, count(DISTINCT cve) AS cves, count(DISTINCT scanner) AS scanners, count(DISTINCT file) AS files FROM findings GROUP BY 1")
_q("a19_worker_summary", lambda f: f.groupBy("repo").agg(F.count_if(F.col("severity") == "HIGH").alias("h"), F.count_if(F.col("severity") == "MEDIUM").alias("m"), F.count_if(F.col("severity").isin("LOW", "INFO")).alias("l")).select("repo", F.format_string("HIGH: %d, MEDIUM: %d, LOW: %d", "h", "m", "l").alias("summary")), "\nSELECT repo, format('HIGH: {}, MEDIUM: {}, LOW: {}', count(*) FILTER (severity = 'HIGH'), count(*) FILTER (severity = 'MEDIUM'), count(*) FILTER (severity IN ('LOW', 'INFO'))) AS summary FROM findings GROUP BY 1")
_q("a20_client_counts", lambda f: f.groupBy("repo", F.when(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.col("severity")).otherwise("INFO").alias("level")).count().withColumnRenamed("count", "n"), "\nSELECT repo, CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN severity ELSE 'INFO' END AS level, count(*) AS n FROM findings GROUP BY 1, 2")
_q("o1_report_sort", lambda f: ranked(merge_duplicates(f)).select("repo", "ordinal", "place"), f", {_MERGE_SQL} SELECT repo, ordinal, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS place FROM merged")
_q("o2_scan_limit", lambda f: f.orderBy("ordinal").limit(200).select("ordinal", "severity"), "\nSELECT ordinal, severity FROM findings ORDER BY ordinal LIMIT 200")
_q("o3_review_candidates", lambda f: merge_duplicates(f).where("finding_type <> 'dependency_vuln' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')").orderBy(F.expr(RANK).desc(), F.desc("confidence"), F.expr(COMPLEXITY).desc(), F.desc("occurrence_count"), "first_ordinal").limit(6).select("ordinal", "severity", "confidence"), f", {_MERGE_SQL} SELECT ordinal, severity, confidence FROM merged WHERE finding_type <> 'dependency_vuln' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM') ORDER BY {RANK} DESC, confidence DESC, {COMPLEXITY} DESC, occurrence_count DESC, first_ordinal LIMIT 6")
_q("o8_free_view", lambda f: f.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.expr("CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END"), "ordinal"))).where("place <= 2").select("repo", "ordinal", "place"), "\nSELECT repo, ordinal, row_number() OVER (PARTITION BY repo ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, ordinal) AS place FROM findings QUALIFY place <= 2")
_q("o9_client_sort", lambda f: places(f, "repo", {"rank": F.expr(RANK)}, ["ordinal"]).select("repo", "ordinal", "place"), f"\nSELECT repo, ordinal, row_number() OVER (PARTITION BY repo ORDER BY {RANK} DESC, ordinal) AS place FROM findings")
_q("o10_delete_latest", lambda f: f.join(f.groupBy("repo").agg(F.max("ordinal").alias("ordinal")), ["repo", "ordinal"], "left_anti").select("repo", "ordinal"), "\nSELECT repo, ordinal FROM findings f WHERE ordinal <> (SELECT max(ordinal) FROM findings g WHERE g.repo = f.repo)")
_q("w8_previews", lambda f: ranked(merge_duplicates(f)).where("place <= 3").select("repo", "place", "ordinal"), f", {_MERGE_SQL} SELECT repo, ordinal, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS place FROM merged QUALIFY place <= 3")
_q("f14_candidate_filter", lambda f: f.where("finding_type <> 'dependency_vuln' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')").select("ordinal"), "\nSELECT ordinal FROM findings WHERE finding_type <> 'dependency_vuln' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM')")
_q("c26_complexity", lambda f: merge_duplicates(f).select("ordinal", F.expr(COMPLEXITY).cast("long").alias("complexity")), f", {_MERGE_SQL} SELECT ordinal, ({COMPLEXITY})::BIGINT AS complexity FROM merged")
_q("c27_rank_keys", lambda f: f.select("ordinal", F.expr(RANK).alias("severity_rank"), F.expr(EXPLOIT_RANK).alias("exploit_rank")), f"\nSELECT ordinal, {RANK} AS severity_rank, {EXPLOIT_RANK} AS exploit_rank FROM findings")
_q("u1_union_scanners", lambda f: f.where("scanner = 'dependency'").select("ordinal", F.lit(1).alias("stage")).unionByName(f.where("scanner = 'regex'").select("ordinal", F.lit(3).alias("stage"))).unionByName(f.where("scanner = 'ast'").select("ordinal", F.lit(4).alias("stage"))).unionByName(f.where("scanner = 'semgrep'").select("ordinal", F.lit(5).alias("stage"))), "\nSELECT ordinal, CASE scanner WHEN 'dependency' THEN 1 WHEN 'regex' THEN 3 WHEN 'ast' THEN 4 ELSE 5 END AS stage FROM findings")
_q("u2_distinct_union", lambda f: f.select("category").union(f.select("scanner")).distinct(), "\nSELECT category FROM findings UNION SELECT scanner FROM findings")
_q("u3_difference", lambda f: f.select("file", "line").distinct().join(f.where("severity = 'CRITICAL'").select("file", "line").distinct(), ["file", "line"], "left_anti"), "\nSELECT file, line FROM findings EXCEPT SELECT file, line FROM findings WHERE severity = 'CRITICAL'")
_q("w1_first_wins", lambda f: f.withColumn("nth", F.row_number().over(W.partitionBy("repo", "category").orderBy("ordinal"))).where("nth = 1").select("repo", "category", "ordinal"), "\nSELECT repo, category, min(ordinal) AS ordinal FROM findings GROUP BY 1, 2")
_q("w2_arg_max", lambda f: f.groupBy("repo").agg(F.max_by("ordinal", F.struct("confidence", -F.col("ordinal"))).alias("ordinal"), F.max("confidence").alias("confidence")), "\nSELECT repo, ordinal, confidence FROM findings QUALIFY row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ordinal) = 1")
register("n3_json_report", lambda s, d: json_report(findings(s, d).selectExpr("ordinal DIV 20 AS scan", "ordinal", "severity", "file"), "scan").selectExpr("scan", "length(report) AS n_chars", "json_array_length(get_json_object(report, '$.issues')) AS n"), f"WITH {FINDINGS} SELECT ordinal // 20 AS scan, (13 + sum(length('{{\"ordinal\":' || ordinal || ',\"severity\":\"' || severity || '\",\"file\":\"' || file || '\"}},')) - 1)::INT AS n_chars, count(*)::INT AS n FROM findings GROUP BY 1")

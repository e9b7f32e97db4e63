"""Findings of dependencies and of secrets as issues of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import segment_in
from ..registry import register
from ..sources.fixtures import FINDINGS, findings
from .advisories import _DESC, _FIX, _HIT, _ROLL, ADVS, DEPS, advisories, dependencies, impact_name, known_fix, rolled_up
from .classify import LABEL
from .context import ATTENTION
from .guidance import proof

# fixed values: folders of manifests that don't reach production, texts where nothing is known
ASIDE = ("example", "examples", "demo", "demos", "sample", "samples", "test", "tests", "spec", "specs", "doc", "docs", "benchmark", "benchmarks")
DETECTED = "Known vulnerable dependency detected"
NO_FIX, NO_PROOF = "No verified fixed version available from advisory data.", "No verified PoC template available for this advisory."
ROTATE = "Move this value to an environment variable and rotate/revoke this credential."
REACHED = "Remote Code Execution (RCE)"


def _or(c: Column, other: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)


def dependency_issues(x: DataFrame) -> DataFrame:
    """Vulnerable dependencies (name, version, ecosystem, manifest_path, line, severity, cve, summary, fix_version, confidence, network_access, auth_required, public_exploit, score, exploit_level, impact) as issues.

    A fix that advisories don't name is that of a known package, if any. A manifest off production caps the issue.
    """
    up = F.upper(F.coalesce("severity", F.lit("MEDIUM")))
    severity = F.when(up == "CRITICAL", "HIGH").when(up.isin("HIGH", "MEDIUM", "LOW", "INFO"), up).otherwise("MEDIUM")
    path = _or(F.col("manifest_path"), "dependency-manifest")
    x = x.withColumns({"severity": severity, "manifest_path": path, "cve": _or(F.col("cve"), "OSV-UNKNOWN"), "line": F.greatest(F.lit(1), F.coalesce("line", F.lit(1)))})
    x = x.withColumn("aside", F.expr(segment_in("trim(replace(manifest_path, chr(92), '/'))", ASIDE)))
    usual = F.when(F.col("severity") == "HIGH", 92).when(F.col("severity") == "MEDIUM", 78).when(F.col("severity") == "LOW", 64).otherwise(52)
    sure = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.nullif("confidence", F.lit(0)), usual)))
    level = F.coalesce(F.nullif(F.upper(F.trim("exploit_level")), F.lit("")), F.when(F.col("severity").isin("HIGH", "MEDIUM"), F.col("severity")).otherwise("LOW"))
    told = F.when(F.col("aside"), F.concat(_or(F.col("summary"), DETECTED), F.lit(" (non-production dependency path)"))).otherwise(_or(F.col("summary"), DETECTED))
    x = x.withColumns({
        "fix_version": F.coalesce(F.nullif(F.trim("fix_version"), F.lit("")), known_fix(F.col("ecosystem"), F.col("name"))), "confidence": F.when(F.col("aside"), F.least(sure, F.lit(60))).otherwise(sure).cast("int"),
        "exploitability_level": F.when(F.col("aside"), "LOW").otherwise(level), "severity": F.when(F.col("aside"), "INFO").otherwise(F.col("severity")), "issue": told,
        "exploitability": F.when(F.col("network_access"), F.when(F.coalesce("auth_required", F.lit(True)), "AUTHENTICATED").otherwise("REMOTE")).otherwise("LOCAL_ONLY"),
        "exploitability_confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0)) / 9.0)),
    })
    bare = F.regexp_replace(F.trim("issue"), r"\.+$", "")
    x = x.withColumn("message", F.when((bare == "") | (F.lower(bare) == DETECTED.lower()), "Dependency Vulnerability").otherwise(bare))
    version = F.col("fix_version")
    exact = F.when(version.isNull(), "").when(F.lower(F.trim("ecosystem")) == "npm", F.concat(F.lit("npm install "), "name", F.lit("@"), version)).otherwise(F.concat(F.lit("Upgrade "), "name", F.lit(" to "), version))
    x = x.withColumns({"exact_fix": exact, "poc": proof(F.col("message"), None, F.col("name"))}).withColumn("fix_command", _or(F.col("exact_fix"), NO_FIX))
    all_three = F.col("public_exploit") & F.col("network_access") & ~F.col("auth_required")
    danger = F.when((F.col("cve") != "OSV-UNKNOWN") & ~F.contains("issue", F.col("cve")), F.concat("issue", F.lit(" ("), "cve", F.lit(")"))).otherwise(F.col("issue"))
    block = F.coalesce(*[F.nullif(F.col(f"poc.{c}"), F.lit("")) for c in ("payload", "command", "snippet")], F.lit(NO_PROOF))
    cli = F.format_string(
        "🚨 %s: %s\n\nPackage: %s (%s)\nInstalled: %s\nSafe: %s\n\nExploitability: %s\nImpact: %s\nConfidence: %s%%\n\nFix:\n%s\n\nPoC:\n%s",
        "severity", "message", "name", "version", "version", F.coalesce(version, F.lit("unknown")), "exploitability_level", _or(F.col("impact"), "Unknown"), F.col("confidence").cast("string"), "fix_command", block,
    )
    return x.withColumns({
        "title": F.concat(F.lit("["), "severity", F.lit("] "), "message"), "rule_id": F.concat(F.lit("osv."), F.lower("cve")), "evidence": F.concat("name", F.lit("@"), "version"), "danger": danger,
        "confidence_label": F.expr(LABEL), "attention_level": F.expr(ATTENTION.format("confidence", "exploitability_level")), "impact_summary": F.when(all_three, REACHED).otherwise(impact_name(F.col("impact"))), "cli_output": cli,
    }).drop("aside", "poc")


def secret_issues(x: DataFrame) -> DataFrame:
    """Secrets (name, severity, file, line, snippet, fix) as issues."""
    up = F.upper(F.coalesce("severity", F.lit("HIGH")))
    x = x.withColumn("severity", F.when(up.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), up).otherwise("HIGH"))
    blank = lambda c, other: _or(F.trim(F.coalesce(c, F.lit(""))), other).alias(c)
    rest = [c for c in x.columns if c not in ("name", "file", "line", "snippet", "fix")]
    x = x.select(*rest, blank("name", "Potential Secret"), blank("file", "unknown"), F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("line"), blank("snippet", ""), blank("fix", ROTATE))
    grave = F.col("severity").isin("CRITICAL", "HIGH")
    return x.withColumns({
        "title": F.concat(F.lit("["), "severity", F.lit("] Hardcoded Secrets")), "category": F.lit("Hardcoded Secrets"), "rule_id": F.concat(F.lit("secret."), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))),
        "message": F.concat("name", F.lit(" detected. "), "fix"), "confidence": F.when(grave, 95).otherwise(85), "confidence_label": F.lit("HIGH"), "attention_level": F.when(grave, "HIGH").otherwise("MEDIUM"),
    })


_PATHS = ("'package.json'", "'web/Tests/package.json'", "'docs' || chr(92) || 'pom.xml'", "'latest/go.mod'", "''")


def _dependency_rows(s: SparkSession, d: str) -> DataFrame:
    x = rolled_up(dependencies(s, d), advisories(s, d))
    return x.withColumns({
        "ecosystem": F.expr("element_at(array('npm', 'PyPI'), CAST(dep_id % 2 + 1 AS INT))"), "manifest_path": F.expr(f"element_at(array({', '.join(_PATHS)}), CAST(dep_id % 5 + 1 AS INT))"),
        "line": F.expr("CAST(dep_id % 3 AS INT)"), "confidence": F.lit(100),
    })


_SHOWN = ("title", "exploitability", "exploitability_confidence", "exploitability_level", "confidence", "attention_level", "fix_command", "danger", "impact_summary", "manifest_path")
register(
    "c13_dependency_issue",
    lambda s, d: dependency_issues(_dependency_rows(s, d)).select("dep_id", "line", *_SHOWN, F.length("cli_output").alias("n_cli")),
    f"""WITH {DEPS}, {ADVS}, {_DESC}, {_HIT}, {_ROLL}, {_FIX},
p AS (SELECT s.*, fix_version, dep_id % 5 IN (1, 2) AS aside, CASE WHEN n_cves > 1 THEN name || '@' || version || ' has ' || n_cves || ' known vulnerabilities (e.g., ' || cve || ').' ELSE s.summary END AS told FROM s LEFT JOIN best USING (dep_id)),
q AS (SELECT *, rtrim(told, '.') AS bare, CASE WHEN aside THEN 'LOW' WHEN score >= 6 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS lev, CASE WHEN aside THEN 'INFO' ELSE severity END AS sev FROM p),
r AS (SELECT *, CASE WHEN aside THEN told || ' (non-production dependency path)' ELSE bare END AS msg, CASE WHEN aside THEN told || ' (non-production dependency path)' ELSE told END AS issue,
  CASE dep_id % 2 WHEN 0 THEN 'npm install ' || name || '@' || fix_version ELSE 'Upgrade ' || name || ' to ' || fix_version END AS cmd FROM q)
SELECT dep_id, greatest(1, dep_id % 3)::INT AS line, '[' || sev || '] ' || msg AS title, CASE WHEN NOT network_access THEN 'LOCAL_ONLY' WHEN auth_required THEN 'AUTHENTICATED' ELSE 'REMOTE' END AS exploitability,
  score::DOUBLE / 9 AS exploitability_confidence, lev AS exploitability_level, CASE WHEN aside THEN 60 ELSE 100 END AS confidence, lev AS attention_level, cmd AS fix_command,
  CASE WHEN contains(issue, cve) THEN issue ELSE issue || ' (' || cve || ')' END AS danger,
  CASE WHEN public_exploit AND network_access AND NOT auth_required THEN 'Remote Code Execution (RCE)' ELSE ['Remote Code Execution (RCE)', 'Denial of Service (DoS)', 'Sensitive Information Exposure (Data Leak)', 'Authentication Bypass (Auth Bypass)', 'Injection', 'Unknown'][list_position(['RCE', 'DoS', 'Data Leak', 'Auth Bypass', 'Injection', 'Unknown'], impact)] END AS impact_summary,
  ['package.json', 'web/Tests/package.json', 'docs' || chr(92) || 'pom.xml', 'latest/go.mod', 'dependency-manifest'][(dep_id % 5)::INT + 1] AS manifest_path,
  (length('X ' || sev || ': ' || msg) + 2 + length('Package: ' || name || ' (' || version || ')') + 1 + length('Installed: ' || version) + 1 + length('Safe: ' || fix_version) + 2 + length('Exploitability: ' || lev) + 1 + length('Impact: ' || impact) + 1
    + length('Confidence: %') + CASE WHEN aside THEN 2 ELSE 3 END + 2 + 5 + length(cmd) + 2 + 5 + CASE WHEN contains(lower(msg), 'injection') THEN 31 ELSE length('{NO_PROOF}') END)::INT AS n_cli FROM r""",
)

_SECRETS = (
    "ordinal", "CASE ordinal % 4 WHEN 0 THEN 'API Key' WHEN 1 THEN ' ' WHEN 2 THEN 'Private Key Block ' END AS name", "CASE WHEN ordinal % 7 = 0 THEN 'odd' ELSE lower(severity) END AS severity",
    "CASE WHEN ordinal % 6 > 0 THEN file END AS file", "line - 2 AS line", "evidence AS snippet", "CASE WHEN ordinal % 3 = 0 THEN 'Rotate it.' END AS fix",
)
register(
    "c14_secret_issue",
    lambda s, d: secret_issues(findings(s, d).selectExpr(*_SECRETS)).select("ordinal", "title", "rule_id", "message", "file", "line", "confidence", "attention_level"),
    f"""WITH {FINDINGS}, names(k, name, slug) AS (VALUES (0, 'API Key', 'api_key'), (1, 'Potential Secret', 'potential_secret'), (2, 'Private Key Block', 'private_key_block'), (3, 'Potential Secret', 'potential_secret')),
x AS (SELECT *, if(ordinal % 7 = 0, 'HIGH', severity) AS sev FROM findings JOIN names ON k = ordinal % 4)
SELECT ordinal, '[' || sev || '] Hardcoded Secrets' AS title, 'secret.' || slug AS rule_id, name || ' detected. ' || if(ordinal % 3 = 0, 'Rotate it.', '{ROTATE}') AS message, if(ordinal % 6 = 0, 'unknown', file) AS file,
  if(line > 3, line - 2, 1)::INT AS line, if(sev IN ('CRITICAL', 'HIGH'), 95, 85) AS confidence, if(sev IN ('CRITICAL', 'HIGH'), 'HIGH', 'MEDIUM') AS attention_level FROM x""",
)

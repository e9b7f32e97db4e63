"""Classification of findings: category, source, usage, severity, confidence, emission. First branch that holds wins.

All of it is expressions over rule_id, title, message, snippet and file_path, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import among, begins, blob, cases, ends, has, lit, segment_in
from ..registry import register
from ..sources.fixtures import CODE_LINES, code_lines, read
from .rules import MATCHES, VALID, matches, scanned, valid

UNVERIFIED = "Unverified Security Signal"
# fixed values: categories by rule id, and the severities of improvement categories
IMPROVEMENTS = [
    ("debug-enabled", "Debug Mode Enabled (Improvement)", "LOW"),
    ("hardcoded-url", "Hardcoded URL Configuration", "INFO"),
    ("env-default-secret", "Environment Secret Fallback", "LOW"),
    ("debug-logging", "Debug Logging Hygiene", "INFO"),
    ("broad-except", "Broad Exception Handling", "LOW"),
    ("input-validation-hint", "Input Validation Coverage Hint", "INFO"),
    ("weak-random", "Weak Randomness Hygiene", "INFO"),
    ("insecure-http", "HTTPS Migration Opportunity", "LOW"),
    ("large-function", "Large Function Complexity", "INFO"),
    ("credential-placeholder", "Credential Placeholder Cleanup", "LOW"),
    ("unused-import-hint", "Unused Import Hygiene", "INFO"),
    ("missing-error-boundary", "Error Boundary Coverage", "INFO"),
    ("open-no-context-manager", "File Context Manager Hygiene", "LOW"),
    ("no-rate-limit-hint", "Rate Limiting Coverage Hint", "INFO"),
    ("critical-action-logging", "Critical Action Audit Logging", "INFO"),
]
EXACT = [
    ("regex.sql-injection", "SQL Injection"),
    ("regex.command-injection", "Command Injection"),
    ("regex.hardcoded-secret", "Hardcoded Secrets"),
    ("regex.open-redirect", "Open Redirect"),
    ("regex.insecure-auth", "Insecure Auth Logic"),
    ("regex.eval-usage", "Dynamic Code Execution (eval/exec)"),
    ("regex.insecure-cors", "Insecure CORS Configuration"),
    ("regex.credential-url", "Credential in URL"),
    ("regex.ssti", "Server-Side Template Injection"),
    ("bandit.b301", "Unsafe Pickle Deserialization"),
    ("flask-debug", "Flask Debug Mode Enabled"),
    ("yaml.load", "Unsafe YAML Deserialization"),
    ("jinja.template.safe-filter", "Unescaped HTML in Template (Potential XSS)"),
    ("semgrep.weak-input", "Weak Input Validation"),
]
NON_PRODUCTION = ("test", "tests", "spec", "specs", "fixture", "fixtures", "example", "examples", "demo", "demos", "sample", "samples", "script", "scripts", "benchmark", "benchmarks")
SOURCE_HINTS = ("request.", "request[", "req.", "params", "argv", "user input", "untrusted", "input(", "httpcontext.request", "request.query", "request.form", "r.url.query", "queryparam(")
SINK_HINTS = ("cursor.execute", "select ", "eval(", "exec(", "os.system", "subprocess", "yaml.load", "pickle.load", "pickle.loads", "fromsqlraw", "executesqlraw", "sqlcommand", "queryrow(", "db.query(", "db.exec(", "exec.command", "process.start")
LOCAL_HTTP = ("http://localhost", "http://127.0.0.1", "localhost:", "127.0.0.1:")
SHELL_WORDS = ("child_process", "execsync", "spawnsync", "os.system", "subprocess")

_R = "lower(trim(rule_id))"
_EVAL, _CMD, _SQL, _SECRET = "Dynamic Code Execution (eval/exec)", "Command Injection", "SQL Injection", "Hardcoded Secrets"
CATEGORY = cases(
    [(f"{_R} = {lit('regex.improvement.' + i)}", lit(c)) for i, c, _ in IMPROVEMENTS]
    + [(f"{_R} = {lit(i)}", lit(c)) for i, c in EXACT]
    + [
        (f"contains({_R}, 'yaml') AND contains({_R}, 'load')", lit("Unsafe YAML Deserialization")),
        (f"contains({_R}, 'pickle') OR {begins(_R, 'bandit.b301')}", lit("Unsafe Pickle Deserialization")),
        (has(_R, ("sql", "sqli", "fromsqlraw", "executesqlraw", "sqlcommand", "db.query", "queryrow")), lit(_SQL)),
        (has(_R, ("command", "exec-command", "process-start", "os.system", "subprocess", "popen")), lit(_CMD)),
        (has(_R, ("credential-url", "secret", "hardcoded", "api-key", "apikey")), lit(_SECRET)),
        (has(_R, ("open-redirect",)), lit("Open Redirect")),
        (f"contains(key, 'render_template_string') OR contains({_R}, 'ssti')", lit("Server-Side Template Injection")),
        (has(_R, ("eval",)), lit(_EVAL)),
        (f"contains({_R}, 'exec') AND {has('key', SHELL_WORDS)}", lit(_CMD)),
        (has(_R, ("exec",)), lit(_EVAL)),
        (has(_R, ("cors",)), lit("Insecure CORS Configuration")),
        (has(_R, ("logging",)), lit("Debug Logging Hygiene")),
        (has("key", ("|safe", "innerhtml", "dangerouslysetinnerhtml", "mark_safe(", "autoescape=false")), lit("Unescaped HTML in Template (Potential XSS)")),
        (has("key", ("flask debug", "debug=true", "app.run(debug=true)", "werkzeug debugger", "use_debugger")), lit("Flask Debug Mode Enabled")),
        (has("key", ("yaml.load", "loader=yaml.loader", "unsafe yaml")), lit("Unsafe YAML Deserialization")),
        (has("key", ("pickle.load", "pickle.loads", "unsafe pickle")), lit("Unsafe Pickle Deserialization")),
        (f"{has('key', ('credential-url', 'credentials embedded'))} OR has_credential_url", lit("Credential in URL")),
        (has("key", ("command injection", "shell=true", "os.system", "subprocess", "exec.command", "process.start", "runtime.getruntime().exec")), lit(_CMD)),
        (has("key", ("sql injection", "sqli", "cursor.execute(", "fromsqlraw(", "executesqlraw(", "sqlcommand", "db.query(", "db.exec(", "queryrow(")), lit(_SQL)),
        (f"{has('key', ('hardcoded', 'hard-coded', 'secret', 'api key', 'apikey', 'password'))} AND {has('key', (' = ', chr(61) + chr(39), '= ' + chr(34), 'token', 'secret', 'apikey', 'api_key'))}", lit(_SECRET)),
        (has("key", ("open redirect", "regex.open-redirect", "res.redirect", "redirect(")), lit("Open Redirect")),
        (has("key", ("insecure auth", "regex.insecure-auth", "auth = false", "password ==")), lit("Insecure Auth Logic")),
        (has("key", ("eval(", "regex.eval-usage")), lit(_EVAL)),
        (f"contains(key, 'exec(') AND {has('key', ('child_process', 'require', 'execsync', 'spawnsync', 'os.system', 'subprocess'))}", lit(_CMD)),
        (has("key", ("exec(",)), lit(_EVAL)),
        (has("key", ("insecure-cors", "cors(app)", "access-control-allow-origin", "allow-origin")), lit("Insecure CORS Configuration")),
        (has("key", ("weak-random", "random.randint", "random.random", "random.choice")), lit("Weak Random Generator Usage")),
        (has("key", ("exception-leak", "stack trace", "traceback", "str(exc)", "str(exception)")), lit("Exception Detail Exposure")),
        (has("key", ("missing-https", "hardcoded-http-url", "http://")), lit("Insecure HTTP Usage")),
        (has("key", ("console.log", "logging.debug", "print(", "debug log", "debug print")), lit("Debug Logging Hygiene")),
        (has("key", ("unsanitized", "unvalidated", "input validation", "weak validation", "sanitize")), lit("Weak Input Validation")),
    ],
    lit(UNVERIFIED),
)
KEY = blob("rule_id", "title", "message", "snippet")
_CREDENTIAL = r"""https?://[^\s"']*:[^\s"']*@"""

DATA_SOURCE = cases(
    [
        (has("part", ("request.", "request[", "query_params", "json()", "form", "body", "params", "argv", "user input", "untrusted", "httpcontext.request", "request.query", "request.form", "r.url.query", "queryparam(", "req.query", "req.body", "req.params", "next", "url", "term", "report_name")), "'user_input'"),
        (has("part", ("open(", "read(", "readfile(", "yaml.load", "pickle.load", "pickle.loads")), "'file'"),
        (has("part", ('= "', "= '\"", "hardcoded", "literal", "const ")), "'hardcoded'"),
    ],
    "'internal'",
)
USAGE = cases(
    [
        (has("part", ("yaml.load", "pickle.load", "pickle.loads", "deserialize")), "'parsed'"),
        (has("part", ("eval(", "exec(", "os.system", "shell=true", "subprocess", "popen", "command", "exec.command", "process.start", "runtime.getruntime().exec")), "'executed'"),
        (has("part", ("sql", "cursor.execute", "select", "insert", "update", "delete", "fromsqlraw", "executesqlraw", "sqlcommand", "queryrow", "db.query", "db.exec")), "'database'"),
        (has("part", ("sanitize", "validated", "validator", "regex")), "'validated'"),
    ],
    "'unknown'",
)
PART = blob("rule_id", "message", "snippet")

NON_PROD_PATH = segment_in("file_path", NON_PRODUCTION)
_E = "lower(evidence)"
DANGEROUS_COMMAND = (
    f"({has(_E, ('shell=true', 'os.system', 'exec.command', 'process.start'))} OR {has(_E, ('exec(' + chr(34), 'exec(' + chr(39), 'execsync(', 'spawn(', 'spawnsync('))}"
    f" OR ({has(_E, (' + ', '+', 'f' + chr(34), 'f' + chr(39), '.format(', '%s', '${'))} AND {has(_E, ('subprocess', 'exec(', 'spawn(', 'command', 'os.system'))}))"
)
_UNTRUSTED, _RISKY = "data_source = 'user_input'", among("usage_context", ("executed", "database", "parsed"))
_PROD = lambda a, b: f"CASE WHEN non_prod THEN '{b}' ELSE '{a}' END"
_is = lambda c: f"category = {lit(c)}"
SEVERITY = cases(
    [(_is(c), f"'{s}'") for _, c, s in IMPROVEMENTS]
    + [
        (_is(UNVERIFIED), "'INFO'"),
        (f"{among('category', ('Unsafe YAML Deserialization', 'Unsafe Pickle Deserialization'))}", f"CASE WHEN {_UNTRUSTED} THEN 'HIGH' WHEN data_source = 'hardcoded' THEN 'LOW' ELSE 'MEDIUM' END"),
        (f"{_is(_CMD)} AND {_UNTRUSTED} AND usage_context = 'executed' AND {DANGEROUS_COMMAND}", _PROD("HIGH", "MEDIUM")),
        (f"{_is(_CMD)} AND {_UNTRUSTED} AND usage_context = 'executed'", _PROD("MEDIUM", "LOW")),
        (_is(_CMD), "CASE WHEN usage_context = 'executed' THEN 'LOW' ELSE 'INFO' END"),
        (f"{_is(_SQL)} AND {_UNTRUSTED} AND usage_context = 'database'", _PROD("HIGH", "MEDIUM")),
        (_is(_SQL), "'LOW'"),
        (f"{_is(_EVAL)} AND ({_UNTRUSTED} OR usage_context = 'executed')", _PROD("HIGH", "MEDIUM")),
        (_is(_EVAL), "'MEDIUM'"),
        (_is(_SECRET), "CASE WHEN contains(upper(scanner_severity), 'HIGH') OR contains(upper(scanner_severity), 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END"),
        (_is("Credential in URL"), "'HIGH'"),
        (_is("Insecure CORS Configuration"), "'MEDIUM'"),
        (_is("Weak Random Generator Usage"), "'LOW'"),
        (_is("Exception Detail Exposure"), "'MEDIUM'"),
        (_is("Insecure HTTP Usage"), "CASE WHEN usage_context IN ('executed', 'database') THEN 'MEDIUM' ELSE 'LOW' END"),
        (_is("Flask Debug Mode Enabled"), "CASE WHEN upper(scanner_severity) = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END"),
        (_is("Unescaped HTML in Template (Potential XSS)"), f"CASE WHEN {_UNTRUSTED} THEN 'MEDIUM' ELSE 'LOW' END"),
        (f"{_is('Weak Input Validation')} AND {_UNTRUSTED} AND {_RISKY}", _PROD("HIGH", "MEDIUM")),
        (f"{_is('Weak Input Validation')} AND {_UNTRUSTED}", _PROD("MEDIUM", "LOW")),
        (_is("Weak Input Validation"), "'LOW'"),
        (among("upper(scanner_severity)", ("HIGH", "MEDIUM", "LOW", "INFO")), "upper(scanner_severity)"),
    ],
    "'LOW'",
)
STRENGTH = cases(
    [
        (f"{begins(_R, 'regex.')} AND contains({_R}, 'improvement')", "'weak'"),
        (has("lower(category)", ("sql injection", "command injection", "hardcoded secrets", "credential in url")), "'exact'"),
        (f"{begins(_R, 'regex.')} OR {begins(_R, 'bandit')}", "'partial'"),
        (begins(_R, "semgrep"), "'exact'"),
    ],
    "'weak'",
)
VALIDATED = among("usage_context", ("executed", "database", "parsed", "validated"))
_BASE = f"CASE WHEN strength = 'exact' AND {VALIDATED} THEN 90 WHEN strength = 'exact' THEN 78 WHEN strength = 'partial' THEN 62 ELSE 42 END"
_SCORE = f"greatest(0, least(100, {_BASE} + CASE WHEN {has('lower(file_path)', ('.env', 'config', 'auth'))} THEN 8 ELSE 0 END + CASE WHEN {has(_E, ('eval(', 'exec(', 'os.system', 'subprocess', 'db.query', 'cursor.execute'))} THEN 7 ELSE 0 END))"
CONFIDENCE = f"CASE WHEN {_is(UNVERIFIED)} THEN least({_SCORE}, 35) ELSE {_SCORE} END"
LABEL = "CASE WHEN confidence >= 80 THEN 'HIGH' WHEN confidence >= 60 THEN 'MEDIUM' ELSE 'LOW' END"
REASONS = [
    "'Data source reliability: ' || CASE data_source WHEN 'dependency' THEN 'OSV advisory database correlation.' WHEN 'user_input' THEN 'untrusted input source identified in code path.' WHEN 'file' THEN 'file-derived input source detected.' WHEN 'hardcoded' THEN 'hardcoded value detected directly in source.' ELSE 'internal static analysis signal.' END",
    "'Match accuracy: ' || CASE strength WHEN 'exact' THEN 'exact vulnerability pattern match.' WHEN 'partial' THEN 'partial pattern match with corroborating context.' WHEN 'weak' THEN 'weak heuristic pattern; requires manual review.' ELSE 'heuristic pattern; requires manual review.' END",
    f"CASE WHEN {VALIDATED} THEN 'Match context: sink/source usage validated in execution path.' ELSE 'Match context: limited execution context evidence available.' END",
]
RANKED = "CASE upper({0}) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'INFO' THEN 0 ELSE 1 END"


def cap(severity: str, limit: str) -> str:
    """The lesser of two severities; a critical one ranks as a low one."""
    r = f"least({RANKED.format(severity)}, {RANKED.format(limit)})"
    return f"CASE WHEN {r} >= 3 THEN 'HIGH' WHEN {r} = 2 THEN 'MEDIUM' WHEN {r} = 1 THEN 'LOW' ELSE 'INFO' END"


_B = blob("rule_id", "message", "evidence", "file_path")
_TEST_PATH = has("lower(file_path)", ("/test", "tests/", "test/", "/spec", "spec/", "_test.", ".test.", ".spec."))
_NO_HINT = f"data_source <> 'user_input' AND NOT {has(_B, SOURCE_HINTS)}"
EMITTED = cases(
    [
        (_is(UNVERIFIED), "false"),
        (f"{_is(_SECRET)} AND ({has(_B, ('http://', 'https://', 'localhost', '127.0.0.1'))} OR {_TEST_PATH})", "false"),
        (f"{_is(_SECRET)} AND length(quoted) > 0 AND (length(quoted) < 12 OR {among('lower(trim(quoted))', ('test', 'example', 'changeme', 'dummy', 'sample', 'placeholder', 'your_key_here', 'insert_here', 'replace_me', 'xxx', 'abc123'))} OR {' OR '.join(begins('lower(trim(quoted))', p) for p in ('changeme', 'dummy', 'sample', 'placeholder'))})", "false"),
        (f"{among('category', (_SQL, _CMD))} AND ({begins(f'trim({_E})', 'import ')} OR {begins(f'trim({_E})', 'from ')})", "false"),
        (f"{among('category', (_SQL, _CMD))} AND scanner <> 'ast_scanner' AND {_NO_HINT}", "false"),
        (f"{_is(_EVAL)} AND {_NO_HINT}", "false"),
        (f"{_is('Open Redirect')} AND {has(_E, ('redirect(', 'res.redirect', 'return redirect'))} AND NOT literal_target", "true"),
        (f"{_is('Open Redirect')} AND data_source <> 'user_input'", "false"),
        (f"{_is('Weak Input Validation')} AND ({has(_B, ('console.log', 'logging.debug', 'print('))} OR data_source <> 'user_input' OR NOT {_RISKY} OR NOT {has(_B, SINK_HINTS)})", "false"),
        (f"{among('category', ('Insecure HTTP Usage', 'HTTPS Migration Opportunity'))} AND {has(_B, LOCAL_HTTP)}", "false"),
    ],
    "true",
)
STRICT = cases([(_is(UNVERIFIED), "false"), (f"{among('category', ('Insecure HTTP Usage', 'HTTPS Migration Opportunity'))} AND {has(_B, LOCAL_HTTP)}", "false")], "true")
_TARGET = r"""(?:res\.)?redirect\s*\(\s*("[^)]*"|'[^)]*')\s*\)"""


# fixed values: categories whose fix is always shown
ALWAYS_FIXED = ("Command Injection", "SQL Injection", "Credential in URL", "Weak Random Generator Usage", "Server-Side Template Injection", "Dynamic Code Execution (eval/exec)")
POLICY = f"CASE WHEN severity IN ('LOW', 'INFO') AND NOT {among('category', ALWAYS_FIXED)} THEN 'template-only' ELSE 'full-safe' END"
REASON = f"CASE WHEN severity IN ('LOW', 'INFO') AND NOT {among('category', ALWAYS_FIXED)} THEN 'low-severity-template-policy' END"


def finalize(m: DataFrame) -> DataFrame:
    """Findings (rule_id, title, message, snippet, file_path, scanner, scanner_severity) with all derived columns."""
    x = m.withColumn("key", F.expr(KEY)).withColumn("part", F.expr(PART)).withColumn("has_credential_url", F.rlike("key", F.lit(_CREDENTIAL)))
    x = x.withColumn("category", F.expr(CATEGORY))
    unsure = F.col("category") == UNVERIFIED
    x = x.withColumn("data_source", F.when(unsure, "internal").otherwise(F.expr(DATA_SOURCE))).withColumn("usage_context", F.when(unsure, "unknown").otherwise(F.expr(USAGE)))
    x = x.withColumn("evidence", F.expr("CASE WHEN snippet <> '' THEN trim(snippet) ELSE message END")).withColumn("non_prod", F.expr(NON_PROD_PATH))
    x = x.withColumn("severity", F.expr(SEVERITY)).withColumn("strength", F.expr(STRENGTH)).withColumn("confidence", F.expr(CONFIDENCE)).withColumn("confidence_label", F.expr(LABEL))
    x = x.withColumn("quoted", F.regexp_extract("evidence", r"""["']([^"']+)["']""", 1)).withColumn("literal_target", F.rlike(F.lower("evidence"), F.lit(_TARGET)))
    return x.drop("key", "part", "has_credential_url")


def where_computed(x: DataFrame, condition: str) -> DataFrame:
    """The rows of x that meet a condition over derived columns.

    A filter is pushed below the columns that it reads and repeats their long expressions at each use, beyond what
    can be compiled; a generator of one element or none stays above them.
    """
    return x.select("*", F.explode(F.when(F.expr(condition), F.array(F.lit(1)))).alias("_met")).drop("_met")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rule matches as findings."""
    v = valid(matches(scanned(code_lines(spark, sf_dir))))
    return finalize(v.select("ordinal", "repo", "nth", "rule_no", "file_path", "line_no", "rule_id", F.lit("").alias("title"), F.lit("").alias("message"), F.col("text").alias("snippet"), F.lit("regex").alias("scanner"), F.col("severity").alias("scanner_severity")))


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line under a rule id that names no category, so that the text decides."""
    x = code_lines(spark, sf_dir)
    return finalize(x.select("ordinal", "repo", F.lit(1).alias("nth"), F.lit(0).alias("rule_no"), "file_path", "line_no", F.lit("other.signal").alias("rule_id"), F.lit("").alias("title"), F.lit("").alias("message"), F.col("text").alias("snippet"), F.lit("semgrep").alias("scanner"), F.lit("HIGH").alias("scanner_severity")))


def _steps(source: str) -> str:
    return f"""f0 AS ({source}), f1 AS (SELECT *, {KEY} AS key, {PART} AS part FROM f0), f2 AS (SELECT *, regexp_matches(key, {lit(_CREDENTIAL)}) AS has_credential_url FROM f1),
f3 AS (SELECT *, {CATEGORY} AS category FROM f2), f4 AS (SELECT *, CASE WHEN category = '{UNVERIFIED}' THEN 'internal' ELSE {DATA_SOURCE} END AS data_source, CASE WHEN category = '{UNVERIFIED}' THEN 'unknown' ELSE {USAGE} END AS usage_context,
  CASE WHEN snippet <> '' THEN trim(snippet) ELSE message END AS evidence, {NON_PROD_PATH} AS non_prod FROM f3),
f5 AS (SELECT *, {SEVERITY} AS severity, {STRENGTH} AS strength FROM f4), f6 AS (SELECT *, {CONFIDENCE} AS confidence FROM f5),
final AS (SELECT *, {LABEL} AS confidence_label, regexp_extract(evidence, {lit(chr(91) + chr(34) + chr(39) + "]([^" + chr(34) + chr(39) + "]+)[" + chr(34) + chr(39) + chr(93))}, 1) AS quoted, regexp_matches(lower(evidence), {lit(_TARGET)}) AS literal_target FROM f6)"""


ISSUES = f"{MATCHES}, {VALID}, " + _steps("SELECT ordinal, repo, nth, rule_no, file_path, line_no, rule_id, '' AS title, '' AS message, text AS snippet, 'regex' AS scanner, severity AS scanner_severity FROM valid")
ALL = _steps("SELECT ordinal, repo, 1 AS nth, 0 AS rule_no, file_path, line_no, 'other.signal' AS rule_id, '' AS title, '' AS message, text AS snippet, 'semgrep' AS scanner, 'HIGH' AS scanner_severity FROM code_lines")
ID = ("ordinal", "rule_id", "nth")


def _q(name, columns: dict[str, str], where: str = "true", every: bool = False) -> None:
    """A projection of findings: of rule matches, or of every line."""
    picked = [*ID, *(f"{e} AS {n}" if e != n else n for n, e in columns.items())]
    source, sql = (all_lines, ALL) if every else (issues, ISSUES)
    met = (lambda x: x) if where == "true" else (lambda x: where_computed(x, where))
    register(name, lambda spark, d: met(source(spark, d)).selectExpr(*picked), f"WITH {CODE_LINES}, {sql} SELECT {', '.join(picked)} FROM final WHERE {where}")


_q("c1_category", {"category": "category"})
_q("c1_category_by_text", {"category": "category"}, every=True)
_q("c2_text_blob", {"issue_text": blob("rule_id", "title", "message", "snippet")})
_q("c3_data_source", {"data_source": "data_source"}, every=True)
_q("c4_usage_context", {"usage_context": "usage_context"}, every=True)
_q("c5_policy_severity", {"severity": "severity"}, every=True)


def _improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line under the id of one improvement, or of none of them."""
    ids = F.array(*[F.lit(f"regex.improvement.{i}") for i, _, _ in IMPROVEMENTS], F.lit("regex.improvement.other"))
    x = code_lines(spark, sf_dir).withColumn("rule_id", F.element_at(ids, (F.col("ordinal") % (len(IMPROVEMENTS) + 1) + 1).cast("int")))
    blank = F.lit("")
    return finalize(x.select("ordinal", "rule_id", blank.alias("title"), blank.alias("message"), blank.alias("snippet"), "file_path", F.lit("regex").alias("scanner"), F.lit("HIGH").alias("scanner_severity")))


_KNOWN = ", ".join(f"({k}, '{c}', '{v}')" for k, (_, c, v) in enumerate(IMPROVEMENTS))
register(
    "c6_improvement_severity",
    lambda spark, d: _improvements(spark, d).select("ordinal", "category", "severity"),
    f"WITH known(k, category, severity) AS (VALUES {_KNOWN}) SELECT event_id AS ordinal, coalesce(category, 'Unverified Security Signal') AS category, coalesce(severity, 'INFO') AS severity FROM events LEFT JOIN known ON k = event_id % {len(IMPROVEMENTS) + 1}",
)
_q("c7_pattern_strength", {"strength": "strength"})
_q("c8_confidence", {"confidence": "confidence"}, every=True)
_q("c9_labels", {"confidence_label": "confidence_label", "attention_level": "confidence_label"})
_q("c11_severity_cap", {"capped": cap("severity", "'MEDIUM'"), "low": cap("severity", "'LOW'"), "critical": cap("'CRITICAL'", "severity")}, every=True)
_q("c12_finalized", {"category": "category", "severity": "severity", "confidence": "confidence", "evidence": "evidence", "title": "'[' || severity || '] ' || category"})
_q("f10_emitted", {"emitted": EMITTED, "strict": STRICT}, every=True)
_q("f10_emitted_matches", {"category": "category"}, where=EMITTED)
_q("f11_non_production", {"non_prod": "non_prod"}, every=True)
_q("f13_command_construction", {"dangerous": DANGEROUS_COMMAND}, every=True)
register("c10_confidence_reasons", lambda spark, d: issues(spark, d).select(*ID, *[F.expr(r).alias(f"reason{k}") for k, r in enumerate(REASONS)]), f"WITH {CODE_LINES}, {ISSUES} SELECT ordinal, rule_id, nth, {', '.join(f'{r} AS reason{k}' for k, r in enumerate(REASONS))} FROM final")
_SEM = "CASE WHEN upper(trim(raw)) IN ('ERROR', 'HIGH') THEN 'HIGH' WHEN upper(trim(raw)) IN ('WARNING', 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END"
_BAN = "CASE WHEN upper(trim(raw)) IN ('HIGH', 'MEDIUM') THEN upper(trim(raw)) ELSE 'LOW' END"
_RAW = "element_at(array(' error ', 'Warning', 'high', 'medium', 'info', ''), CAST(ordinal % 6 + 1 AS INT))"
register("c15_scanner_severity", lambda spark, d: code_lines(spark, d).withColumn("raw", F.expr(_RAW)).selectExpr("ordinal", f"{_SEM} AS semgrep", f"{_BAN} AS bandit"), f"WITH {CODE_LINES}, r AS (SELECT ordinal, [' error ', 'Warning', 'high', 'medium', 'info', ''][(ordinal % 6)::INT + 1] AS raw FROM code_lines) SELECT ordinal, {_SEM} AS semgrep, {_BAN} AS bandit FROM r")
# levels as analyzers write them, from the priorities of orders
register("c15_priority_levels", lambda spark, d: read(spark, d, "orders").withColumn("raw", F.concat(F.lit(" "), F.substring_index("o_orderpriority", "-", -1), F.lit(" "))).selectExpr("o_orderkey", f"{_SEM} AS semgrep", f"{_BAN} AS bandit"), "SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS semgrep, CASE o_orderpriority WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS bandit FROM orders")
_TYPE = cases([(has("lower(category)", (t,)), f"'{v}'") for t, v in (("sql", "sql_injection"), ("command", "command_injection"), ("redirect", "open_redirect"), ("secret", "hardcoded_secret"), ("eval", "code_execution"), ("xss", "xss"))], "'other'")
_LANG = cases([(ends("lower(file_path)", e), f"'{v}'") for e, v in (((".py",), "python"), ((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), "node"), ((".go",), "go"), ((".cs",), "csharp"), ((".rb",), "ruby"))], "'unknown'")
_q("c19_type_and_language", {"vuln_type": _TYPE, "language": _LANG}, every=True)
_q("c21_guidance_policy", {"guidance_type": POLICY, "fallback_reason": REASON}, every=True)
_q("n6_custom_rule", {"hit": "contains(lower(evidence), 'innerhtml')"}, every=True)
_EXPECTED = cases([(has("lower(category)", (c,)), f"'{c.replace(' ', '_')}'") for c in ("sql injection", "command injection", "open redirect")], "''")
_q("j1_flow_kind", {"kind": _EXPECTED}, every=True)

# cases by hand: rule, message, snippet, file, scanner's severity, scanner, and what is told of each
_CASES = [
    ("regex.sql-injection", "", 'db.query("SELECT " + req.query.id)', "src/a.js", "HIGH", "regex", _SQL, "user_input", "database", "HIGH", "exact", 97, "HIGH", True),
    ("regex.sql-injection", "", 'db.query("SELECT " + req.query.id)', "tests/a.js", "HIGH", "regex", _SQL, "user_input", "database", "MEDIUM", "exact", 97, "HIGH", True),
    ("regex.sql-injection", "", 'db.query("SELECT 1")', "src/config/a.js", "HIGH", "regex", _SQL, "internal", "database", "LOW", "exact", 100, "HIGH", False),
    ("regex.command-injection", "", "import subprocess", "a.py", "HIGH", "regex", _CMD, "internal", "executed", "LOW", "exact", 97, "HIGH", False),
    ("regex.hardcoded-secret", "", 'apiKey = "k9f3b7c1d5e8a2460917bd"', "src/a.js", "HIGH", "regex", _SECRET, "hardcoded", "validated", "HIGH", "exact", 90, "HIGH", True),
    ("regex.hardcoded-secret", "", 'token = "short1"', "src/a.js", "MEDIUM", "regex", _SECRET, "hardcoded", "validated", "MEDIUM", "exact", 90, "HIGH", False),
    ("regex.hardcoded-secret", "", 'token = "abcdefghijklmnop"', "tests/a.js", "LOW", "regex", _SECRET, "hardcoded", "validated", "MEDIUM", "exact", 90, "HIGH", False),
    ("regex.eval-usage", "", "eval(req.body.code)", "a.js", "HIGH", "regex", _EVAL, "user_input", "executed", "HIGH", "partial", 69, "MEDIUM", True),
    ("semgrep.weak-input", "unvalidated", "save(req.body.a)", "a.js", "", "semgrep", "Weak Input Validation", "user_input", "validated", "MEDIUM", "exact", 90, "HIGH", False),
    ("flask-debug", "", "app.run(debug=True)", "app.py", "HIGH", "bandit", "Flask Debug Mode Enabled", "internal", "unknown", "MEDIUM", "weak", 42, "LOW", True),
    ("bandit.b301", "", "pickle.loads(body)", "a.py", "MEDIUM", "bandit", "Unsafe Pickle Deserialization", "user_input", "parsed", "HIGH", "partial", 62, "MEDIUM", True),
    ("yaml.load", "", "cfg = yaml.load(f)", "a.py", "HIGH", "semgrep", "Unsafe YAML Deserialization", "file", "parsed", "MEDIUM", "weak", 42, "LOW", True),
    ("regex.insecure-cors", "", "app.use(cors())", "src/auth/a.js", "HIGH", "regex", "Insecure CORS Configuration", "internal", "validated", "MEDIUM", "partial", 70, "MEDIUM", True),
    ("other.signal", "", 'fetch("http://localhost:3000/ping")', "a.js", "HIGH", "semgrep", "Insecure HTTP Usage", "internal", "unknown", "LOW", "weak", 42, "LOW", False),
    ("other.signal", "", 'fetch("http://api.invalid/ping")', "a.js", "HIGH", "semgrep", "Insecure HTTP Usage", "internal", "unknown", "LOW", "weak", 42, "LOW", True),
    ("regex.open-redirect", "", "res.redirect(req.query.next)", "a.js", "HIGH", "regex", "Open Redirect", "user_input", "validated", "HIGH", "partial", 62, "MEDIUM", True),
    ("regex.open-redirect", "", 'res.redirect("/home")', "a.js", "LOW", "regex", "Open Redirect", "internal", "validated", "LOW", "partial", 62, "MEDIUM", False),
    ("other.signal", "", "let color = pick()", "a.ts", "HIGH", "semgrep", UNVERIFIED, "internal", "unknown", "INFO", "weak", 35, "LOW", False),
    ("regex.improvement.weak-random", "", "Math.random()", "a.js", "HIGH", "regex", "Weak Randomness Hygiene", "internal", "validated", "INFO", "weak", 42, "LOW", True),
    ("regex.credential-url", "", '"https://u:p@h/x"', "a.js", "LOW", "regex", "Credential in URL", "user_input", "validated", "HIGH", "exact", 90, "HIGH", True),
    ("python.exec_usage", "", "exec(code)", "a.py", "HIGH", "ast_scanner", _EVAL, "internal", "executed", "HIGH", "weak", 49, "LOW", False),
    ("node.sql_injection", "", 'q("SELECT a" + b)', "a.js", "HIGH", "ast_scanner", _SQL, "internal", "database", "LOW", "exact", 90, "HIGH", True),
]
_TOLD = ("category", "data_source", "usage_context", "severity", "strength", "confidence", "confidence_label", "emitted")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one of the cases, by its number."""
    given = spark.createDataFrame([(k, *c[:6]) for k, c in enumerate(_CASES)], "k long, rule_id string, message string, snippet string, file_path string, scanner_severity string, scanner string")
    x = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(_CASES)).alias("k")).join(F.broadcast(given), "k")  # a fixed table
    return finalize(x.withColumn("title", F.lit(""))).selectExpr("o_orderkey", *_TOLD[:-1], f"{EMITTED} AS emitted")


_ROWS = ", ".join("(" + ", ".join([str(k), *(f"'{v}'" if isinstance(v, str) else str(v) for v in c[6:])]) + ")" for k, c in enumerate(_CASES))
register("c12_issue_cases", _cases, f"WITH told(k, {', '.join(_TOLD)}) AS (VALUES {_ROWS}) SELECT o_orderkey, {', '.join(_TOLD)} FROM orders JOIN told ON k = o_orderkey % {len(_CASES)}")

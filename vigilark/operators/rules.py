"""Pattern rules over source lines: scan filters, matching, validity, secrets.

Each rule is a literal pattern in its own projected column, so the patterns compile once and the scan of the lines
stays in generated code; only lines that match leave the projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import among, begins, cases, ends, has, lit, py_pattern, segment_in
from ..registry import register
from ..sources.fixtures import CODE_LINES, code_lines, read
from . import rule_index

# fixed values: rule ids, severities and patterns
RULES = [
    ("regex.hardcoded-secret", "HIGH", r"""(?:api[_-]?key|secret[_-]?key|secret|token|password|passwd|jwt[_-]?secret|auth[_-]?token|access[_-]?key)\s*(?:=|:)\s*["']([^"']{16,})["']"""),
    ("regex.command-injection", "HIGH", r"""(os\.system|os\.popen|subprocess\.(run|Popen|call)\(|Runtime\.getRuntime\(\)\.exec|(?<!\w)exec\s*\(|execSync\s*\(|execFile\s*\(|spawn\s*\(|spawnSync\s*\()"""),
    ("regex.sql-injection", "HIGH", r"""(SELECT|INSERT|UPDATE|DELETE)[^\n;]*(\+|`|\$\{)"""),
    ("regex.insecure-auth", "MEDIUM", r"""(if\s*\(?\s*password\s*==\s*['"]|auth\s*=\s*false|verify\s*=\s*false|password\s*===?\s*['"][^'"]{1,30}['"])"""),
    ("regex.open-redirect", "MEDIUM", r"""(redirect\(|res\.redirect\(|window\.location\s*=).*(req\.|request\.|query|params|next)"""),
    ("regex.unsafe-yaml-load", "HIGH", r"""yaml\.load\s*\("""),
    ("regex.unsafe-pickle-load", "HIGH", r"""pickle\.loads?\s*\("""),
    ("regex.insecure-cors", "MEDIUM", r"""\bcors\s*\("""),
    ("regex.credential-url", "HIGH", r"""https?://[^\s"']+:[^@\s"']+@"""),
    ("regex.weak-random", "LOW", r"""Math\.random\(\)|random\.randint|random\.random\(\)|random\.choice\b|rand\(\)|mt_rand\("""),
    ("regex.ssti", "HIGH", r"""render_template_string\s*\(.*(?:f['"]|request\.|%|\+)"""),
    ("regex.jwt-no-expiry", "MEDIUM", r"""jwt\.sign\s*\([^)]*\)"""),
    ("regex.path-traversal", "HIGH", r"""(?:send_file|sendFile|open|readFile|readFileSync|createReadStream)\s*\([^)]*(?:\+|`|\$\{|os\.path\.join|path\.join)"""),
    ("regex.nosql-injection", "HIGH", r"""\.(?:find|findone|update|updateone|deleteone|delete|aggregate)\s*\(\s*\{[^}]*(?:req\.(?:body|query|params)|request\.)"""),
    ("node.eval_usage", "HIGH", r"""\beval\s*\("""),
    ("node.sql_injection", "HIGH", r"""(SELECT|INSERT|UPDATE|DELETE)[^\n;]*(\+|`|\$\{)"""),
    ("python.exec_usage", "HIGH", r"""\bexec\s*\("""),
    ("python.sql_injection", "HIGH", r"""(SELECT|INSERT|UPDATE|DELETE)[^\n;]*(\+|%\s*\(|f"|f'|\{[^}]+\})|f['"][^'"]*(?:SELECT|INSERT|UPDATE|DELETE)[^'"]*\{"""),
]
# fixed values: file kinds, folders and words of the validity policy
EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".env", ".yaml", ".yml", ".json", ".ini", ".cfg", ".conf")
EXCLUDED = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendors", "third_party", "third-party", "dist", "build", "out", "target", "bin", "obj",
    ".venv", "venv", "env", "virtualenv", "site-packages", "__pycache__", ".git", ".svn", ".hg", ".tox", ".mypy_cache", ".pytest_cache", ".next", ".nuxt",
    ".cache", "coverage", ".gradle", ".idea", ".vscode",
)
BUNDLES = (".min.js", ".min.css", ".bundle.js", ".chunk.js")
PLACEHOLDERS = ("test", "example", "changeme", "dummy", "sample", "placeholder", "your_key_here", "insert_here", "replace_me", "xxx", "abc123", "fake", "mock", "redacted")
EMBEDDED = ("placeholder", "changeme", "your_key_here", "replace_me", "insert_here", "redacted", "example")
LOG_WORDS = ("logging.", "logger.", "log.info", "log.debug", "log.warn", "log.error", "print(", "console.log")
COSMETIC = ("color", "colour", "confetti", "animation", "animate", "particle", "shuffle", "jitter", "delay", "css", "style", "pixel", "rgb", "hsl", "emoji", "sample text", "backoff", "retry", "sleep", "timeout", "fuzz")
DATA_FILES = ("generate", "dataset", "seed", "mock", "fixture", "sample", "factory", "/data/", "/test")
TAINT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".cs")
AST_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
TRIGGERS = ("eval(", "exec(", "pickle", "yaml.load", "subprocess", "os.system", "random.")

MAX_FILE_BYTES = 300_000
EXCLUDED_PATH = f"({segment_in('file_path', EXCLUDED)} OR {ends('lower(file_path)', BUNDLES)})"
SCANNED = f"({ends('lower(file_path)', EXTENSIONS)} AND NOT {EXCLUDED_PATH})"
# the same for Spark: a path is cut once, and its parts are looked up in sets
_PARTS = lambda xs: ", ".join(lit(x) for x in xs)
EXCLUDED_PARTS = f"(arrays_overlap(split(lower(file_path), '/'), array({_PARTS(EXCLUDED)})) OR {ends('lower(file_path)', BUNDLES)})"
SCANNED_PARTS = f"(instr(file_path, '.') > 0 AND substring_index(lower(file_path), '.', -1) IN ({_PARTS(e[1:] for e in EXTENSIONS)}) AND NOT {EXCLUDED_PARTS})"
TEST_FILE = has("lower(file_path)", ("/test", "tests/", "spec.", "_test."))
_LOW = "lower(text)"


def _secret(quoted: str) -> str:
    """The value is no placeholder, holds no marker of one, and is long enough."""
    v = f"trim({quoted})"
    return f"(length({quoted}) > 0 AND NOT {among(f'lower({v})', PLACEHOLDERS)} AND NOT {has(f'lower({v})', EMBEDDED)} AND length({v}) >= 12)"


def validity(quoted: str, key_lookup: str, method_lookup: str) -> str:
    """Whether a match counts, from rule_id, text and file_path; the arguments are the engine's pattern calls."""
    py = "right(file_path, 3) = '.py'"
    some = lambda *t: has(_LOW, t)
    return cases(
        [
            (TEST_FILE, "false"),
            (f"{py} AND {among('rule_id', ('regex.unsafe-pickle-load', 'regex.unsafe-yaml-load', 'regex.command-injection', 'regex.weak-random'))}", "false"),
            (f"{has(_LOW, LOG_WORDS)} AND contains(lower(rule_id), 'sql')", "false"),
            ("rule_id = 'regex.hardcoded-secret'", _secret(quoted)),
            ("rule_id = 'regex.sql-injection'", f"NOT {some('logging.', 'logger.', 'log.info', 'log.debug', 'print(', 'console.log', '# ', '-style', 'example')} AND {some('request', 'input', 'user', 'query', 'params', '+')}"),
            ("rule_id = 'regex.path-traversal'", some("request", "req.", "input", "args", "params", "query", "+", "join")),
            ("rule_id = 'regex.command-injection'", f"NOT ({begins(f'trim({_LOW})', 'import ')} OR {begins(f'trim({_LOW})', 'from ')}) AND {some('request', 'input', 'args', 'shell=true', '+', 'os.system(', 'exec(')}"),
            ("rule_id = 'regex.jwt-no-expiry'", f"NOT {some('expiresin')}"),
            ("rule_id = 'regex.open-redirect'", f"{some('next', 'returnurl', 'redirect', 'req.', 'request.', 'query')} AND NOT {key_lookup} AND NOT {method_lookup}"),
            ("rule_id = 'regex.weak-random'", f"NOT {has('lower(file_path)', DATA_FILES)} AND NOT {has(_LOW, COSMETIC)}"),
            (among("rule_id", ("regex.unsafe-yaml-load", "regex.unsafe-pickle-load")), some("request", "input", "payload", "body", "file", "yaml.load", "pickle.load", "pickle.loads")),
            ("rule_id = 'regex.credential-url'", f"{some('@')} AND {some('://')}"),
        ],
        "true",
    )


_KEY, _METHOD = r"\[\s*(req|request)\.[^\]]+\]", r"\.(?:get|has|includes|find|indexof)\s*\(\s*(req|request)\."
_QUOTED = r"""["']([^"']+)["']"""


#: Characters beyond ASCII that a pattern without regard to case takes for a Latin letter, and that letter.
FOLDED = "lower(translate(text, '\u0130\u0131\u017f\u212a', 'iisk'))"


def matches(lines: DataFrame) -> DataFrame:
    """One row a match of a rule in a line (ordinal, rule_no, nth), with the rule's id and severity.

    A pattern is tried only on lines that hold one of the literals of which any match of it must hold one; those are
    looked for in the folded line, by substring tests in generated code.
    """
    covers = [rule_index.cover(p) for _, _, p in RULES]
    met = lambda cover: F.expr(has("_low", cover)) if cover else F.lit(True)
    count = lambda p, cover: F.when(met(cover), F.regexp_count("text", F.lit(py_pattern(p)))).otherwise(0)
    hits = F.array(*[F.struct(F.lit(k).alias("rule_no"), F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), count(p, c).alias("n")) for k, ((i, s, p), c) in enumerate(zip(RULES, covers))])
    # a generator of one element, as a filter would be pushed below a projection and fold the line anew for each test
    x = lines.select("*", F.explode(F.array(F.expr(FOLDED))).alias("_low"))
    if all(covers):
        every = sorted({x for c in covers for x in c})
        x = x.where(met([a for a in every if not any(b != a and b in a for b in every)]))
    each = x.select("*", F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h"))
    return each.select(*lines.columns, "h.rule_no", "h.rule_id", "h.severity", F.explode(F.sequence(F.lit(1), F.col("h.n"))).alias("nth"))


#: Ids, patterns and severities of a rule file, as plain values.
Rule = tuple[str, str, str]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def usable(rules: list[Rule]) -> list[Rule]:
    """Rules whose pattern is one."""
    kept = []
    for rule in rules:
        try:
            re.compile(rule[2])
        except re.error:
            continue
        kept.append(rule)
    return kept


def placed(text: Column, pattern: str) -> Column:
    """The line, from 1, of each match of a pattern in a text, in order.

    A text is cut at its matches: what lies before a match are the pieces up to it and the matches between them, so a
    match's line is one more than their line feeds.
    """
    p = F.lit(py_pattern(pattern))
    feeds = lambda xs: F.transform(xs, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    # the whole match as a group of its own, as patterns number theirs from one
    found = F.regexp_extract_all(text, p, F.lit(0))
    pieces, inside = feeds(F.split(text, py_pattern(pattern))), feeds(found)
    return F.transform(found, lambda _, k: 1 + total(F.slice(pieces, F.lit(1), k + 1)) + total(F.slice(inside, F.lit(1), k)))


def file_matches(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """files (file_path, text, ...) to one row a match in the whole text: rule_no, rule_id, severity, nth, line_no, text (the line)."""
    rules = RULES if rules is None else usable(rules)
    if not rules:
        return files.select(*[c for c in files.columns if c != "text"], *[F.lit(None).cast(t).alias(n) for n, t in (("rule_no", "int"), ("rule_id", "string"), ("severity", "string"), ("nth", "int"), ("line_no", "int"), ("text", "string"))]).limit(0)
    hits = F.array(*[F.struct(F.lit(k).alias("rule_no"), F.lit(i).alias("rule_id"), F.lit(v).alias("severity"), placed(F.col("text"), p).alias("at")) for k, (i, v, p) in enumerate(rules)])
    lines = F.split("text", LINE_END)
    each = files.select(*files.columns, lines.alias("_lines"), F.explode(F.filter(hits, lambda h: F.size(h["at"]) > 0)).alias("h"))
    each = each.select("*", F.posexplode("h.at").alias("_n", "line_no"))
    return each.select(*[c for c in files.columns if c != "text"], "h.rule_no", "h.rule_id", "h.severity", (F.col("_n") + 1).alias("nth"), "line_no", F.trim(F.coalesce(F.get("_lines", F.col("line_no") - 1), F.lit(""))).alias("text"))


def rule_rows(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """Rules as rows (rule_no, rule_id, severity, pattern) for the index of rules."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RULES if rules is None else rules)], "rule_no int, rule_id string, severity string, pattern string")


def judged_matches(m: DataFrame) -> DataFrame:
    """m with `valid`: whether a match counts."""
    m = m.withColumn("_q", F.regexp_extract("text", _QUOTED, 1)).withColumn("_k", F.rlike("text", F.lit(py_pattern(_KEY)))).withColumn("_m", F.rlike("text", F.lit(py_pattern(_METHOD))))
    return m.withColumn("valid", F.expr(validity("_q", "_k", "_m"))).drop("_q", "_k", "_m")


def valid(m: DataFrame) -> DataFrame:
    return judged_matches(m).where("valid").drop("valid")


def scanned(lines: DataFrame) -> DataFrame:
    return lines.where(F.expr(SCANNED_PARTS))


def _duck(p: str) -> str:
    """RE2 has no look-behind; a match may take in the character before, which leaves the number of matches alone."""
    return lit("(?i)" + p.replace(r"(?<!\w)exec", r"(?:^|[^\w])exec"))


_HITS = "[" + ", ".join(f"{{'rule_no': {k}, 'rule_id': '{i}', 'severity': '{s}', 'n': len(regexp_extract_all(text, {_duck(p)}))}}" for k, (i, s, p) in enumerate(RULES)) + "]"
MATCHES = f"""hits AS (SELECT *, unnest({_HITS}) AS h FROM code_lines WHERE {SCANNED}),
matches AS (SELECT ordinal, repo, scan_id, file_path, line_no, text, h.rule_no AS rule_no, h.rule_id AS rule_id, h.severity AS severity, unnest(range(1, h.n + 1))::INT AS nth FROM hits WHERE h.n > 0)"""
VALID = f"valid AS (SELECT * FROM matches WHERE {validity(f'regexp_extract(text, {lit(_QUOTED)}, 1)', f'regexp_matches(text, {lit('(?i)' + _KEY)})', f'regexp_matches(text, {lit('(?i)' + _METHOD)})')})"


def _q(name, fn, sql):
    register(name, lambda spark, d: fn(code_lines(spark, d)), f"WITH {CODE_LINES}{sql}")


_KEYS = ("ordinal", "rule_id", "nth")
_q("s1_source_scan", lambda x: scanned(x).select("ordinal", "file_path"), f"\nSELECT ordinal, file_path FROM code_lines WHERE {SCANNED}")
_q("s2_path_exclusion", lambda x: x.select("file_path").distinct().select("file_path", F.expr(EXCLUDED_PARTS).alias("excluded")), "\nSELECT DISTINCT file_path, regexp_matches(file_path, '(^|/)node_modules(/|$)') AS excluded FROM code_lines")
_q("s3_taint_scan", lambda x: x.where(F.expr(ends("lower(file_path)", TAINT_EXTENSIONS))).select("file_path").distinct(), "\nSELECT DISTINCT file_path FROM code_lines WHERE regexp_matches(lower(file_path), '\\.(jsx?|tsx?|mjs|cjs|go|cs)$')")
_q("s4_ast_scan", lambda x: x.where(F.expr(ends("lower(file_path)", AST_EXTENSIONS))).select("file_path").distinct(), "\nSELECT DISTINCT file_path FROM code_lines WHERE regexp_matches(lower(file_path), '\\.(py|jsx?|tsx?|mjs|cjs)$')")
_q("s6_repo_gate", lambda x: x.groupBy("repo").agg(F.bool_or(F.expr(ends("lower(file_path)", (".js", ".jsx", ".ts", ".tsx", ".py")))).alias("scannable")), "\nSELECT repo, bool_or(regexp_matches(lower(file_path), '\\.(jsx?|tsx?|py)$')) AS scannable FROM code_lines GROUP BY 1")
_q("f1_rule_matches", lambda x: matches(scanned(x)).select(*_KEYS), f", {MATCHES} SELECT ordinal, rule_id, nth FROM matches")
_q("f2_builtin_rules", lambda x: matches(scanned(x)).where("rule_no < 14").groupBy("rule_id").count().withColumnRenamed("count", "n"), f", {MATCHES} SELECT rule_id, count(*) AS n FROM matches WHERE rule_no < 14 GROUP BY 1")
_q("f3_external_rules", lambda x: matches(scanned(x)).where("rule_no >= 14").groupBy("rule_id").count().withColumnRenamed("count", "n"), f", {MATCHES} SELECT rule_id, count(*) AS n FROM matches WHERE rule_no >= 14 GROUP BY 1")
_q("f6_test_files", lambda x: x.select("file_path").distinct().where(F.expr(TEST_FILE)), "\nSELECT DISTINCT file_path FROM code_lines WHERE regexp_matches(lower(file_path), '/test|tests/|spec\\.|_test\\.')")
_q("f7_secret_values", lambda x: x.withColumn("q", F.regexp_extract("text", _QUOTED, 1)).where("length(q) > 0").select("ordinal", F.expr(_secret("q")).alias("is_secret")), f"\nSELECT ordinal, (SELECT NOT {among('lower(v)', PLACEHOLDERS)} AND NOT regexp_matches(lower(v), '{'|'.join(EMBEDDED)}') AND length(v) >= 12) AS is_secret FROM (SELECT ordinal, trim(regexp_extract(text, {lit(_QUOTED)}, 1)) AS v FROM code_lines) WHERE length(v) > 0")
_q("f8_valid_matches", lambda x: valid(matches(scanned(x))).select(*_KEYS), f", {MATCHES}, {VALID} SELECT ordinal, rule_id, nth FROM valid")
_IMPORT = "rule_id = 'regex.command-injection' AND (left(trim(lower(text)), 7) = 'import ' OR left(trim(lower(text)), 5) = 'from ')"
_q("f9_import_guard", lambda x: matches(scanned(x)).where(f"NOT ({_IMPORT})").select(*_KEYS), f", {MATCHES} SELECT ordinal, rule_id, nth FROM matches WHERE NOT ({_IMPORT})")
_q("f19_trigger_filter", lambda x: x.where(F.expr(has("lower(text)", TRIGGERS))).select("ordinal"), "\nSELECT ordinal FROM code_lines WHERE regexp_matches(lower(text), 'eval\\(|exec\\(|pickle|yaml\\.load|subprocess|os\\.system|random\\.')")
_q("a21_scan_counters", lambda x: scanned(x).select("repo", "file_path").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("files"), (F.count(F.lit(1)) * len(RULES)).alias("checks")), f"\nSELECT repo, count(DISTINCT file_path) AS files, count(DISTINCT file_path) * {len(RULES)} AS checks FROM code_lines WHERE {SCANNED} GROUP BY 1")
# every file meets every rule as a column of its row, so that no product is made; pairs that match stay
_RULE_ROWS = ", ".join(f"({lit(i)}, {_duck(p)})" for i, _, p in RULES)
_q("j8_files_by_rules", lambda x: matches(scanned(x)).select("file_path", "rule_id").distinct(), f"\n, r(rule_id, pattern) AS (VALUES {_RULE_ROWS}) SELECT DISTINCT file_path, rule_id FROM code_lines, r WHERE {SCANNED} AND regexp_matches(text, pattern)")
_q("w7_carry_forward", lambda x: _carried(x), "\nSELECT ordinal, last_value(CASE WHEN contains(text, 'app.') OR contains(text, 'cors') THEN text END IGNORE NULLS) OVER (PARTITION BY repo, file_path ORDER BY line_no) AS context FROM code_lines")


def _carried(x: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    mark = F.when(F.col("text").contains("app.") | F.col("text").contains("cors"), F.col("text"))
    return x.select("ordinal", F.last(mark, ignorenulls=True).over(W.partitionBy("repo", "file_path").orderBy("line_no")).alias("context"))


def scan_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: valid matches of all rules by scan, with counts and the risk score, from one aggregation."""
    from .report import count_columns, risk_column

    v = valid(matches(scanned(code_lines(spark, sf_dir))))
    return v.groupBy("repo", "scan_id").agg(*count_columns(), risk_column())


register("scan_risk_score", scan_risk, f"WITH {CODE_LINES}, {MATCHES}, {VALID} SELECT repo, scan_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, greatest(0, 100 - sum(CASE severity WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 2 END))::INT AS risk_score FROM valid GROUP BY 1, 2")


def _secrets(spark, d):
    docs = read(spark, d, "documents")
    p = F.lit(py_pattern(RULES[0][2]))
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", p, F.lit(1))).alias("nth", "secret")).select("doc_id", "nth", "secret")


register("f1_document_secrets", _secrets, f"SELECT doc_id, generate_subscripts(s, 1)::INT - 1 AS nth, unnest(s) AS secret FROM (SELECT doc_id, regexp_extract_all(text, {_duck(RULES[0][2])}, 1) AS s FROM documents)")
# offsets: every ".\n" of a text, and the line that follows it
_ENDS = r"\.\n"
register("f4_line_of_offset", lambda spark, d: read(spark, d, "documents").select("doc_id", F.posexplode(placed(F.col("text"), _ENDS)).alias("nth", "line")), "WITH p AS (SELECT doc_id, string_split(text, '.' || chr(10)) AS p FROM documents), e AS (SELECT doc_id, p, unnest(range(0, len(p) - 1))::INT AS nth FROM p) SELECT doc_id, nth, len(string_split(array_to_string(p[1:nth + 1], '.' || chr(10)), chr(10)))::INT AS line FROM e")
register("f5_snippet_of_line", lambda spark, d: read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("k", "s")).selectExpr("doc_id", "k", "trim(s) AS snippet"), "SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS k, trim(unnest(s)) AS snippet FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS s FROM documents)")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a few lines: the lines of code of a scan in one path."""
    x = scanned(code_lines(spark, d)).groupBy("scan_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda v: v["text"]), "\n").alias("text"))
    return x


_WHOLE = f"""WITH {CODE_LINES}, files AS (SELECT scan_id, file_path, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM code_lines WHERE {SCANNED} GROUP BY 1, 2),
rules(rule_id, pattern) AS (VALUES {", ".join(f"({lit(i)}, {_duck(p)})" for i, _, p in RULES)}),
cut AS (SELECT scan_id, file_path, rule_id, regexp_extract_all(text, pattern) AS m, text FROM files, rules WHERE regexp_matches(text, pattern)),
walk AS (SELECT scan_id, file_path, rule_id, unnest(m) AS hit, generate_subscripts(m, 1)::INT AS nth, text, m FROM cut)"""
register("f1_whole_text_matches", lambda spark, d: file_matches(_files(spark, d)).select("scan_id", "file_path", "rule_id", "nth"), f"{_WHOLE} SELECT scan_id, file_path, rule_id, nth FROM walk")
# the line of a file's first match of a rule: what lies before its text
register("f4_first_match_line", lambda spark, d: file_matches(_files(spark, d)).where("nth = 1").select("scan_id", "file_path", "rule_id", "line_no", F.col("text").alias("snippet")), f"{_WHOLE}, f AS (SELECT *, len(string_split(left(text, strpos(text, hit) - 1 + (left(hit, 1) = chr(10))::INT), chr(10))) AS line_no FROM walk WHERE nth = 1) SELECT scan_id, file_path, rule_id, line_no::INT AS line_no, trim(string_split(text, chr(10))[line_no]) AS snippet FROM f")

# rules of users beside or in place of the built-in ones; one whose pattern is none is left out
_CUSTOM = [("custom.inner-html", "LOW", r"\.innerHTML\s*="), ("custom.broken", "LOW", "("), ("custom.request", "HIGH", r"req\.(query|body)")]
register(
    "n6_custom_rules",
    lambda spark, d: file_matches(_files(spark, d), _CUSTOM).select("scan_id", "file_path", "rule_id", "severity", "nth"),
    f"""WITH {CODE_LINES}, files AS (SELECT scan_id, file_path, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM code_lines WHERE {SCANNED} GROUP BY 1, 2), own(rule_id, severity, mark) AS (VALUES ('custom.inner-html', 'LOW', '[.]innerhtml\\s*='), ('custom.request', 'HIGH', 'req[.](?:query|body)'))
SELECT scan_id, file_path, rule_id, severity, unnest(range(1, len(regexp_extract_all(lower(text), mark)) + 1))::INT AS nth FROM files, own""",
)

# the same by the index of rules
register("f1_indexed_matches", lambda spark, d: rule_index.file_matches(_files(spark, d), rule_rows(spark)).select("scan_id", "file_path", "rule_id", "nth", "line_no"), f"{_WHOLE}, b AS (SELECT *, string_split(text, chr(10)) AS ls FROM walk) SELECT scan_id, file_path, rule_id, nth, len(string_split(regexp_extract(text, '^(?:[\\s\\S]*?(?:' || p.pattern || ')){{' || nth || '}}'), chr(10))) - len(string_split(hit, chr(10))) + 1 + (left(hit, 1) = chr(10))::INT AS line_no FROM b JOIN rules p USING (rule_id)")
# rules as rows, one a supplier: a word of the snippets and what may follow it; some have no literal, some are no pattern
_WORDS = ("child_process", "innerHTML", "render_template", "jwt.sign", "expiresIn", "encodeURIComponent", "traceback", "parseInt", "localhost", "debug=True", "yaml.load", "pickle.load", "Math.random", "hunter22", "total = items")
_RULE_OF = """CASE WHEN s_suppkey % 11 = 5 THEN '(' WHEN s_suppkey % 97 = 3 THEN concat('[0-9]{', 1 + s_suppkey % 3, '}.') WHEN s_suppkey % 3 = 0 THEN concat('(?:', {word}, '|nowhere', s_suppkey, ').{0,', s_suppkey % 40, '}[a-z(]')
  ELSE concat({word}, '[^;]{', s_suppkey % 17, '}') END"""


def _supplied(spark: SparkSession, d: str) -> DataFrame:
    word = "replace(element_at(array(" + ", ".join(lit(w) for w in _WORDS) + f"), CAST(s_suppkey % {len(_WORDS)} + 1 AS INT)), '.', '[.]')"
    return read(spark, d, "supplier").selectExpr("CAST(s_suppkey AS INT) AS rule_no", "concat('supplied.', s_suppkey) AS rule_id", "'LOW' AS severity", f"{_RULE_OF.replace('{word}', word)} AS pattern")


register(
    "f3_rule_rows",
    lambda spark, d: rule_index.rule_counts(scanned(code_lines(spark, d)), _supplied(spark, d)),
    f"""WITH {CODE_LINES}, texts AS (SELECT text, count(*) AS c FROM code_lines WHERE {SCANNED} GROUP BY 1),
r AS (SELECT concat('supplied.', s_suppkey) AS rule_id, {_RULE_OF.replace('{word}', f"replace([{', '.join(lit(w) for w in _WORDS)}][(s_suppkey % {len(_WORDS)})::INT + 1], '.', '[.]')")} AS pattern FROM supplier),
m AS (SELECT rule_id, c, len(regexp_extract_all(text, '(?i)' || pattern)) AS k FROM texts, (SELECT * FROM r WHERE pattern <> '('))
SELECT rule_id, sum(c)::BIGINT AS lines, sum(c * k)::BIGINT AS n FROM m WHERE k > 0 GROUP BY 1""",
)

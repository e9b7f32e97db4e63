"""Logical relations of the scanner, derived from the tables that are given: each as a DataFrame and as SQL.

A snippet table stands for source lines, so that every rule has lines that match and look-alikes that don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lit

#: (extension, line of code): two or more for each rule, and safe ones.
SNIPPETS = [
    (".js", "const apiKey = \"k9f3b7c1d5e8a2460917bd\";"),
    (".js", "const password = \"changeme_placeholder_value\";"),
    (".py", "os.system(\"tar cf out.tar \" + request.args[0])"),
    (".js", "child_process.exec(\"ls \" + req.query.dir)"),
    (".js", "db.query(\"SELECT name FROM t WHERE id=\" + req.query.id)"),
    (".js", "console.log(\"UPDATE done\" + user)"),
    (".js", "if (password == \"letmein\") { grant(); }"),
    (".py", "requests.get(target, verify = False)"),
    (".js", "res.redirect(req.query.next)"),
    (".js", "res.redirect(ROUTES[req.query.next])"),
    (".py", "cfg = yaml.load(request.body)"),
    (".rb", "conf = yaml.load(payload)"),
    (".py", "obj = pickle.loads(body)"),
    (".rb", "state = pickle.load(file)"),
    (".js", "app.use(cors())"),
    (".js", "const feed = \"https://bob:hunter22@feeds.invalid/x\";"),
    (".js", "const sid = Math.random()"),
    (".js", "const color = Math.random()"),
    (".py", "return render_template_string(\"<p>%s</p>\" % request.args)"),
    (".js", "const t = jwt.sign(claims, SECRET)"),
    (".js", "const t = jwt.sign(claims, k, { expiresIn: 60 })"),
    (".js", "fs.readFile(base + req.query.file, done)"),
    (".js", "users.find({ name: req.body.name })"),
    (".js", "eval(req.body.code)"),
    (".py", "exec(user_code)"),
    (".py", "cur.execute(f\"SELECT a FROM t WHERE u={uid}\" + tail)"),
    (".js", "el.innerHTML = req.query.bio"),
    (".py", "app.run(debug=True)"),
    (".js", "fetch(\"http://localhost:3000/ping\")"),
    (".js", "fetch(\"http://api.invalid/ping\")"),
    (".py", "traceback.print_exc() # stack trace to client"),
    (".go", "exec.Command(\"sh\", r.URL.Query().Get(\"c\"))"),
    (".ts", "const safe = encodeURIComponent(name)"),
    (".ts", "let total = items.length"),
    (".py", "import subprocess"),
    (".py", "subprocess.run(args, shell=True)"),
    (".env", "TOKEN=\"a81f0c3e55d94b7f8e21\""),
    (".json", "{\"secret\": \"zx81mn45qp67rt90vb12\"}"),
    (".md", "password = \"docs are not scanned here\""),
    (".js", "const n = parseInt(req.params.n)"),
    (".js", "db.query(\"SELECT a FROM t WHERE b=\" + req.query['b'])"),
    (".js", "const t = jwt.sign(\n  claims,\n  SECRET\n)"),
    (".cs", "var q = Request.Query[\"q\"];"),
    (".py", "q = \"SELECT a FROM table_x WHERE b=\" + c"),
    (".js", "const n = exec(cmd) + readFile(path)"),
    (".py", "token = random.random()"),
    (".py", "def new_token():\n    x = random.choice(\"ab\")"),
]
DIRS = ("src", "tests", "scripts", "config", "node_modules")
EVENTS = (("view", "scan_started"), ("purchase", "scan_completed"), ("error", "scan_failed"), ("click", "unlock_clicked"), ("signup", "audit_unlocked"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, repo, scan_id, file_path, line_no, text): one line of code an event.

    The snippets are joined, so that text is a column of a relation, as it is in a scan, and no expression that each
    condition on it would repeat.
    """
    sn = F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(t).alias("text")) for e, t in SNIPPETS])
    snippets = spark.range(0, 1, 1, 1).select(F.posexplode(sn)).select("pos", "col.ext", "col.text")
    dirs = F.array(*[F.lit(d) for d in DIRS])
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    e = e.join(F.broadcast(snippets), (F.col("event_id") % len(SNIPPETS)).cast("int") == F.col("pos"))  # a fixed number of rows
    place = F.concat(F.element_at(dirs, (F.col("user_id") % len(DIRS) + 1).cast("int")), F.lit("/f"), F.col("user_id").cast("string"), F.col("ext"))
    lines = e.select(
        F.col("event_id").alias("ordinal"), F.concat(F.lit("r"), (F.floor(F.col("user_id") / 5) % 10).cast("string")).alias("repo"),
        F.floor(F.col("event_id") / 20).cast("long").alias("scan_id"), place.alias("file_path"), "text",
    )
    number = F.row_number().over(W.partitionBy("repo", "file_path").orderBy("ordinal"))
    return lines.withColumn("line_no", number.cast("int"))


_VALUES = ", ".join(f"({k}, {lit(e)}, {lit(t)})" for k, (e, t) in enumerate(SNIPPETS))
_DIRS = "['" + "', '".join(DIRS) + "']"
CODE_LINES = f"""snippets(id, ext, text) AS (VALUES {_VALUES}),
code_lines AS (
  SELECT event_id AS ordinal, 'r' || (user_id // 5 % 10) AS repo, event_id // 20 AS scan_id,
    {_DIRS}[(user_id % 5)::INT + 1] || '/f' || user_id || ext AS file_path, text,
    row_number() OVER (PARTITION BY 'r' || (user_id // 5 % 10), {_DIRS}[(user_id % 5)::INT + 1] || '/f' || user_id || ext ORDER BY event_id)::INT AS line_no
  FROM events JOIN snippets ON event_id % {len(SNIPPETS)} = id)"""

_STATEMENT = """CASE WHEN j % 500 = 0 THEN concat('q', j, ' = "SELECT a FROM t WHERE b="') WHEN j % 500 = 499 THEN concat('q', j, ' = "plain"') WHEN j % 20 = 7 THEN concat('cur.execute(q', j - 1, ')')
  WHEN j % 20 = 8 THEN concat('cur.execute(q', j - 2, ', args)') WHEN j % 20 = 9 THEN concat('q', j, ' = q', j - 3, ' + part') WHEN j % 20 = 13 THEN concat('q', j, ' = q', j - 1, ' + q', j - 4)
  WHEN j % 20 = 15 THEN concat('q', j, ' = part + q', j - 1) WHEN j % 100 = 57 AND event_id % 2 = 0 THEN concat('q', j, ' = other') ELSE concat('q', j, ' = q', j - 1, ' + part') END"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line_no, text): a Python statement an event, which mostly pass an SQL text on from variable to variable; 40 files."""
    e = read(spark, sf_dir, "events").selectExpr("event_id", "event_id div 40 AS j")
    return e.selectExpr("concat('src/s', event_id % 40, '.py') AS file_path", "CAST(j + 1 AS INT) AS line_no", f"{_STATEMENT} AS text")


STATEMENTS = f"statements AS (SELECT 'src/s' || (event_id % 40) || '.py' AS file_path, (j + 1)::INT AS line_no, {_STATEMENT} AS text FROM (SELECT event_id, event_id // 40 AS j FROM events))"

SCANNERS = ("dependency", "regex", "ast", "semgrep")
CATEGORIES = ("SQL Injection", "Command Injection", "Hardcoded Secrets", "Open Redirect", "Weak Input Validation", "Insecure HTTP Usage")
PRIORITY = (("1-URGENT", "CRITICAL"), ("2-HIGH", "HIGH"), ("3-MEDIUM", "MEDIUM"), ("5-LOW", "LOW"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, repo, scanner, severity, file, line, category, confidence, finding_type, package, cve, message, evidence, data_source, usage_context, exploitability_level): one an order."""
    o = read(spark, sf_dir, "orders")
    severity = F.create_map(*[F.lit(x) for kv in PRIORITY for x in kv])[F.col("o_orderpriority")]
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scanner = F.when(c % 3 == 0, 0).otherwise(k % 4)
    array = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return o.select(
        k.alias("ordinal"), (c % 10).cast("string").alias("repo"), array(SCANNERS, scanner).alias("scanner"), F.coalesce(severity, F.lit("INFO")).alias("severity"),
        F.concat(F.array(F.lit("src/f"), F.lit("tests/f"))[F.when(c % 50 == 7, 1).otherwise(0)], (c % 50).cast("string"), F.lit(".js")).alias("file"),
        (F.floor(c / 50) % 20 + 1).cast("int").alias("line"), array(CATEGORIES, c % 6).alias("category"),
        (F.lit(40) + F.floor("o_totalprice") % 61).cast("int").alias("confidence"), F.when(scanner == 0, "dependency_vuln").otherwise("code").alias("finding_type"),
        F.when(scanner == 0, F.concat(F.lit("pkg"), (c % 40).cast("string"))).alias("package"), F.when(scanner == 0, F.concat(F.lit("CVE-"), (c % 90).cast("string"))).alias("cve"),
        F.concat(F.lit("finding in "), F.when(k % 2 == 0, "request handler").otherwise("helper")).alias("message"), F.when(k % 3 == 0, "argv").when(k % 7 == 1, "cursor.execute(q)").otherwise("const").alias("evidence"),
        array(("user_input", "file", "internal", "user_input"), k % 4).alias("data_source"), array(("executed", "database", "parsed", "unknown"), F.floor(k / 2) % 4).alias("usage_context"),
        array(("HIGH", "MEDIUM", "LOW", ""), F.floor(k / 4) % 4).alias("exploitability_level"),
    )


def _pick(xs, i: str) -> str:
    return "['" + "', '".join(xs) + f"'][({i})::INT + 1]"


FINDINGS = f"""findings AS (
  SELECT *, CASE WHEN sc = 0 THEN 'dependency_vuln' ELSE 'code' END AS finding_type, CASE WHEN sc = 0 THEN 'pkg' || (o_custkey % 40) END AS package,
    CASE WHEN sc = 0 THEN 'CVE-' || (o_custkey % 90) END AS cve, {_pick(SCANNERS, 'sc')} AS scanner
  FROM (SELECT o_custkey, o_orderkey AS ordinal, (o_custkey % 10)::VARCHAR AS repo, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS sc,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END AS severity,
    CASE WHEN o_custkey % 50 = 7 THEN 'tests/f' ELSE 'src/f' END || (o_custkey % 50) || '.js' AS file, (o_custkey // 50 % 20 + 1)::INT AS line,
    {_pick(CATEGORIES, 'o_custkey % 6')} AS category, (40 + floor(o_totalprice)::BIGINT % 61)::INT AS confidence,
    'finding in ' || CASE WHEN o_orderkey % 2 = 0 THEN 'request handler' ELSE 'helper' END AS message, CASE WHEN o_orderkey % 3 = 0 THEN 'argv' WHEN o_orderkey % 7 = 1 THEN 'cursor.execute(q)' ELSE 'const' END AS evidence,
    {_pick(('user_input', 'file', 'internal', 'user_input'), 'o_orderkey % 4')} AS data_source, {_pick(('executed', 'database', 'parsed', 'unknown'), 'o_orderkey // 2 % 4')} AS usage_context,
    {_pick(('HIGH', 'MEDIUM', 'LOW', ''), 'o_orderkey // 4 % 4')} AS exploitability_level
    FROM orders))"""


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    name = F.create_map(*[F.lit(x) for kv in EVENTS for x in kv])[F.col("event_type")]
    return e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), name.alias("event"), F.floor(F.col("event_id") / 20).cast("string").alias("scan_id"), F.col("ts").alias("created_at"))


METRIC_EVENTS = "metric_events AS (SELECT event_id, 'u' || user_id || '@example.com' AS email, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENTS) + " END AS event, (event_id // 20)::VARCHAR AS scan_id, ts AS created_at FROM events)"

FEEDBACK_KINDS = ("bug", "false_positive", "feature", "other")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item an event: rating, category and comment follow its numbers."""
    e = metric_events(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(x) for x in FEEDBACK_KINDS]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("feedback_id"), "email", "scan_id", (F.col("event_id") % 5 + 1).cast("int").alias("rating"), kind.alias("category"), F.concat(F.lit(" Note "), (F.col("event_id") % 3).cast("string"), F.lit(" ")).alias("comment"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("i"), F.col("event_id").cast("string"))).alias("issue_id"), "created_at")


FEEDBACK = METRIC_EVENTS + f""", feedback AS (SELECT event_id AS feedback_id, email, scan_id, (event_id % 5 + 1)::INT AS rating, {_pick(FEEDBACK_KINDS, 'event_id % 4')} AS category,
  ' Note ' || (event_id % 3) || ' ' AS comment, CASE WHEN event_id % 7 = 0 THEN 'i' || event_id END AS issue_id, created_at FROM metric_events)"""

JOB_STATES = ("queued", "processing", "done", "failed", "queued")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, job_id, state, ts): a log of transitions."""
    e = read(spark, sf_dir, "events")
    state = F.create_map(*[F.lit(x) for (k, _), s in zip(EVENTS, JOB_STATES) for x in (k, s)])[F.col("event_type")]
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 499).alias("job_id"), state.alias("state"), "ts", F.concat(F.lit("w"), (F.col("user_id") % 6).cast("string")).alias("worker"))


JOB_EVENTS = "job_events AS (SELECT event_id AS seq, event_id * 7 % 499 AS job_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for (k, _), s in zip(EVENTS, JOB_STATES)) + " END AS state, ts, 'w' || (user_id % 6) AS worker FROM events)"

FLOW_KINDS = ("sql_injection", "command_injection", "open_redirect")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow facts (file, kind, line, sanitized, depth, uncertain, tier): one a line item; a fifth of the files that have some hold no finding, and as many with findings have no flow."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    item = read(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in FLOW_KINDS]), (F.col("l_partkey") % 3 + 1).cast("int"))
    tier = F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return item.select(F.concat(F.when(F.col("l_partkey") % 50 < 40, "src/f").otherwise("lib/g"), (F.col("l_partkey") % 50).cast("string"), F.lit(".js")).alias("flow_file"), kind.alias("kind"), (k % 20 + 1).cast("int").alias("flow_line"), (F.col("l_suppkey") % 4 != 0).alias("sanitized"), (n % 3).cast("int").alias("depth"), (F.col("l_partkey") % 2 == 0).alias("uncertain"), tier.alias("tier")).distinct()


FLOWS = f"""flows AS (SELECT DISTINCT CASE WHEN l_partkey % 50 < 40 THEN 'src/f' ELSE 'lib/g' END || (l_partkey % 50) || '.js' AS flow_file, {_pick(FLOW_KINDS, 'l_partkey % 3')} AS kind, (l_orderkey % 20 + 1)::INT AS flow_line,
  l_suppkey % 4 <> 0 AS sanitized, (l_linenumber % 3)::INT AS depth, l_partkey % 2 = 0 AS uncertain, {_pick(('HIGH', 'MEDIUM', 'LOW'), 'l_suppkey % 3')} AS tier
  FROM lineitem)"""

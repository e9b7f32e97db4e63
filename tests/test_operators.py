"""Cases by hand: classification, manifests, versions, data flow, syntax trees, merging, streams, readers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vigilark.operators import advisories, classify, manifests, report, rules, taint
from vigilark.sources import readers
from vigilark.streaming import state


def lines(spark, *rows):
    return spark.createDataFrame([(k, "r", p, 1, t) for k, (p, t) in enumerate(rows)], "ordinal long, repo string, file_path string, line_no int, text string")


def test_rules_match_and_validate(spark):
    x = lines(
        spark, ("a.js", "const token = 'abcdefghijklmnopqr'"), ("a.js", "token = 'placeholder_value_here_x'"), ("tests/a.js", "const token = 'abcdefghijklmnopqr'"), ("a.py", "os.system('x' + input)"),
        ("a.js", "myexec (x + 1)"), ("a.js", "exec(req.query.a); exec(b)"), ("a.js", "PASSWORD = \"abcdefghijklmnopqrs\""), ("a.js", "res.redirect(MAP[req.query.next])"),
    )
    m = rules.matches(x)
    found = {(r.ordinal, r.rule_id): r.nth for r in m.collect()}
    assert (4, "regex.command-injection") not in found and found[5, "regex.command-injection"] == 2 and (6, "regex.hardcoded-secret") in found
    ok = {(r.ordinal, r.rule_id) for r in rules.valid(m).collect()}
    assert (0, "regex.hardcoded-secret") in ok and (6, "regex.hardcoded-secret") in ok
    assert not ok & {(1, "regex.hardcoded-secret"), (2, "regex.hardcoded-secret"), (3, "regex.command-injection"), (7, "regex.open-redirect")}


@pytest.mark.parametrize(
    "rule, text, path, category, severity",
    [
        ("regex.sql-injection", "db.query('SELECT ' + req.query.id)", "src/a.js", "SQL Injection", "HIGH"),
        ("regex.sql-injection", "db.query('SELECT ' + req.query.id)", "tests/a.js", "SQL Injection", "MEDIUM"),
        ("regex.nosql-injection", "users.find({a: req.body.a})", "a.js", "SQL Injection", "HIGH"),
        ("regex.path-traversal", "open(base + name)", "a.py", "Unverified Security Signal", "INFO"),
        ("python.exec_usage", "exec(code)", "a.py", "Dynamic Code Execution (eval/exec)", "HIGH"),
        ("python.exec_usage", "child_process.exec(x)", "a.js", "Command Injection", "LOW"),
        ("regex.improvement.debug-enabled", "DEBUG = True", "a.py", "Debug Mode Enabled (Improvement)", "LOW"),
        ("x", "el.innerHTML = a", "a.js", "Unescaped HTML in Template (Potential XSS)", "LOW"),
        ("x", "https://u:p@h/", "a.js", "Credential in URL", "HIGH"),
        ("x", "nothing here", "a.js", "Unverified Security Signal", "INFO"),
    ],
)
def test_classification(spark, rule, text, path, category, severity):
    df = spark.createDataFrame([(rule, "", "", text, path, "regex", "HIGH")], "rule_id string, title string, message string, snippet string, file_path string, scanner string, scanner_severity string")
    r = classify.finalize(df).first()
    assert (r.category, r.severity) == (category, severity)


def test_a_critical_finding_is_capped_as_a_low_one(spark):
    assert spark.range(1).select(F.expr(classify.cap("'CRITICAL'", "'HIGH'"))).first()[0] == "LOW"


def test_versions(spark):
    vs = ["1.10.0", "1.9", "v1.9.1", "1.9rc1", "2.0.0-beta", "1.9.0", "01.10"]
    df = spark.createDataFrame([(v,) for v in vs], "v string").orderBy(advisories.version_key(F.col("v")), "v")
    assert [r.v for r in df.collect()] == ["1.9", "1.9.0", "v1.9.1", "1.9rc1", "01.10", "1.10.0", "2.0.0-beta"]
    pick = lambda pool, now: spark.range(1).select(advisories.least_upgrade(F.array(*map(F.lit, pool)), F.lit(now))).first()[0]
    assert pick(["3.0.0", "2.1.0", "2.0.0-rc1"], "2.0.5") == "2.1.0" and pick(["1.0.0"], "2.0.0") == "1.0.0" and pick(["3.0.0-rc1"], "1") == "3.0.0-rc1"


def test_manifest_edge_cases(spark):
    m = lambda t: spark.createDataFrame([("p", t)], "manifest_path string, text string")
    names = lambda df: sorted((r.name, r.version) for r in df.collect())
    assert names(manifests.package_json(m('{"dependencies":{"a":"^1.0","b":"npm:@s/c@~2","d":null,"e":"workspace:*","f":"git+ssh://x"},"devDependencies":[1]}'))) == [("@s/c", "2"), ("a", "1.0")]
    assert manifests.package_json(m("not json")).count() == 0
    assert names(manifests.package_lock(m('{"packages":{"":{"version":"9"},"node_modules/x/node_modules/@s/y":{"version":"1.2"}},"dependencies":{"z":{"version":"3"}}}'))) == [("@s/y", "1.2"), ("z", "3")]
    assert names(manifests.requirements(m("a[x]==1.0 ; python\n# c\n-e .\nb>=2,<3\nc\nhttps://q==1"))) == [("a", "1.0"), ("b", "2")]
    assert names(manifests.go_mod(m("require a/b v1.2.3 // indirect\nrequire (\nc/d v2.0.0\n)\ne/f v9.0.0"))) == [("a/b", "v1.2.3"), ("c/d", "v2.0.0")]
    assert names(manifests.pyproject(m('[project]\ndependencies = ["a>=1.2", "b"]\n[tool.poetry.dependencies]\npython = "^3"\nc = {version = "^4.1"}'))) == [("a", "1.2"), ("c", "4.1")]
    assert manifests.pyproject(m("= broken")).count() == 0
    assert names(manifests.pom(m("<p xmlns='u'><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency><dependency><groupId>h</groupId></dependency></p>"))) == [("g:a", "1.0")]


FLOWS = [
    ("app.get('/u', h)\nconst id = req.query.id;\ndb.query('SELECT ' + id);", "js", [("sql_injection", 3, "HIGH", 0, False)]),
    ("const id = req.query.id;\nconst q = 'S' + id;\ndb.query(q)", "js", [("sql_injection", 3, "MEDIUM", 1, False)]),
    ("let a = req.body.x;\na = 'fixed';\nexec(a)", "js", []),
    ("res.redirect(MAP[req.query.to])", "js", [("open_redirect", 1, "LOW", 0, True)]),
    ("const a = req.query.a;\ndb.query(`id = ${a}`)", "js", []),  # a template is a string literal here
    ("function run(c) {\n  exec(c)\n}\nrun(req.body.cmd)", "js", [("command_injection", 4, "MEDIUM", 1, False)]),
    ("run(req.body.cmd)\nconst run = (c) => {\n  if (c) {\n  }\n  exec(c)\n}\nexec(d)", "js", [("command_injection", 1, "MEDIUM", 1, False)]),
    ("function run(c) {\n}\nfunction other(c) {\n exec(c)\n}\nrun(req.body.cmd)", "js", []),
    ("const a = req.query['x'];\nconst b = a;\nconst c = b;\nconst d = c;\nexec(d)", "js", [("command_injection", 5, "MEDIUM", 2, False)]),
    ("const a = req.query.a;\nconst ab = escape(a);\ndb.query(ab)", "js", [("sql_injection", 3, "LOW", 1, True)]),
    ("const a = req.query.a;\nconst b = String(a);\ndb.query(b)", "js", [("sql_injection", 3, "MEDIUM", 1, False)]),
    ('id := r.URL.Query().Get("id")\ndb.Query("S" + id)', "go", [("sql_injection", 2, "HIGH", 0, False)]),
    ('exec.Command("sh", c.Param("x"))', "go", [("command_injection", 1, "HIGH", 0, False)]),
    ('var u = Request.Query["u"];\nProcess.Start(u)', "cs", [("command_injection", 2, "HIGH", 0, False)]),
    ("string s = Console.ReadLine();\nvar q = WebUtility.UrlEncode(s);\nx.FromSqlRaw(q)", "cs", [("sql_injection", 3, "LOW", 1, True)]),
    ("const x = 1;\ndb.query(x)", "js", []),
]


def test_data_flow(spark):
    df = spark.createDataFrame([(f"f{k}.{lang}", text) for k, (text, lang, _) in enumerate(FLOWS)], "file_path string, text string")
    got = {}
    for f in taint.taint_flows(df).collect():
        got.setdefault(f.file_path, []).append((f.kind, f.line, f.tier, f.depth, f.sanitized))
    for k, (text, lang, want) in enumerate(FLOWS):
        assert got.get(f"f{k}.{lang}", []) == want, text


def test_data_flow_keeps_route_chain_and_certainty(spark):
    df = spark.createDataFrame([("a.js", "router.post('/p', h)\nconst a = req.body.q;\nconst b = a;\nconst c = b + 1;\ndb.query(c)")], "file_path string, text string")
    (r,) = taint.taint_flows(df).collect()
    assert (r.route, r.source, r.chain, r.uncertain, r.sink) == ("POST /p", "req.body.q", ["req.body.q", "a", "a", "b"], True, "db")


def test_data_flow_over_files(spark):
    df = spark.createDataFrame([("a.js", "const id = req.query.id;\ndb.query(id)"), ("b.rb", "req.query.id"), ("c.js", None)], "file_path string, text string")
    assert [(r.file_path, r.source, r.chain) for r in taint.taint_flows(df).collect()] == [("a.js", "req.query.id", ["req.query.id", "id"])]


def test_merge_keeps_the_place_of_the_first_and_counts(spark):
    cols = "ordinal long, repo string, scanner string, severity string, file string, line int, category string, confidence int, finding_type string, package string, cve string"
    rows = [(1, "r", "a", "LOW", "F", 1, "X", 50, "code", None, None), (2, "r", "b", "HIGH", "f ", 1, "x", 10, "code", None, None), (3, "r", "b", "HIGH", "f", 1, "x", 10, "code", None, None), (4, "r", "d", "LOW", "p", 1, "y", 9, "dependency_vuln", "Q", "C"), (5, "r", "d", "LOW", "p", 7, "z", 9, "dependency_vuln", "q", "c")]
    got = {r.ordinal: (r.first_ordinal, r.occurrence_count) for r in report.merge_duplicates(spark.createDataFrame(rows, cols)).collect()}
    assert got == {2: (1, 3), 4: (4, 2)}


def test_results_do_not_depend_on_partitioning(spark):
    from vigilark.sources.fixtures import findings

    f = findings(spark, "/root/testdata/sf0.001")
    a = report.ranked(report.merge_duplicates(f)).select("ordinal", "place")
    b = report.ranked(report.merge_duplicates(f.repartition(7, F.rand(3)))).select("ordinal", "place")
    assert sorted(a.collect()) == sorted(b.collect())


def run_stream(spark, out, mode, name):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_stream_dedup_and_windows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    spark.createDataFrame([("a", "push", at(0)), ("a", "push", at(1)), ("b", "push", at(20))], "delivery_id string, event string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("delivery_id string, event string, ts timestamp").parquet(f"{tmp_path}/in")
    assert sorted(r.delivery_id for r in run_stream(spark, state.dedup_deliveries(stream), "append", "dedup")) == ["a", "b"]
    assert sorted(r.n for r in run_stream(spark, state.windowed_counts(stream), "complete", "counts")) == [1, 2]


def test_stream_leases_requeue_what_nobody_finishes(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    kind = "job_id long, state string, ts timestamp"
    for k, rows in enumerate([[(1, "processing", at(0)), (2, "processing", at(1)), (2, "done", at(2))], [(3, "processing", at(90))], [(4, "processing", at(200))]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1 if k < 2 else 0)  # files are taken in the order of their times
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.job_id, r.action) for r in run_stream(spark, state.leases(stream), "append", "leases")}
    assert {(1, "leased"), (2, "done"), (1, "requeued")} <= got and (2, "requeued") not in got


def test_readers(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/b.md").write_text("x")
    (tmp_path / "src/big.js").write_text("x" * 300_001)
    (tmp_path / "src/node_modules/c.js").write_text("x")
    assert [(r.file_path, r.text) for r in readers.source_files(spark, str(tmp_path / "src")).collect()] == [("a.py", "x = 1")]
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.json").write_text(json.dumps({"id": "q.a", "name": "A", "pattern": "x", "severity": "high", "description": "d"}))
    (tmp_path / "rules/b.json").write_text("{ broken")
    assert [(r.id, r.severity) for r in readers.external_rules(spark, str(tmp_path / "rules")).collect()] == [("q.a", "HIGH")]
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"check_id": "c", "path": "a.js", "start": {"line": 3}, "extra": {"severity": "ERROR", "lines": "l"}}, {"check_id": "c", "path": "a.py"}]}))
    assert [(r.rule_id, r.line, r.severity) for r in readers.semgrep_report(spark, str(tmp_path / "s.json")).collect()] == [("c", 3, "HIGH")]
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"test_id": "B101", "filename": "/r/tests/a.py", "line_number": 1, "issue_severity": "LOW"}, {"test_id": "B602", "filename": "a.py", "line_number": 2, "issue_severity": "High"}]}))
    assert [(r.rule_id, r.severity) for r in readers.bandit_report(spark, str(tmp_path / "b.json")).collect()] == [("bandit.b602", "HIGH")]
    (tmp_path / "f.json").write_text(json.dumps([{"feedback_id": "1", "email": "a", "rating": 3}, {"feedback_id": "2", "email": "b", "rating": 9}]))
    assert [r.feedback_id for r in readers.feedback_items(spark, str(tmp_path / "f.json")).collect()] == ["1"]
    (tmp_path / "m.json").write_text(json.dumps({"repos": [{"id": "a", "path": "x"}, {"id": "b", "path": "../y"}]}))
    assert [r.id for r in readers.validation_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a"]
    readers.write_csv(spark.createDataFrame([("a", "")], "x string, y string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["x", "y"]


def test_entry_survives_without_the_corpus_folder(monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("vigilark.llm") else find(n, *a))
    assert "scan_risk_score" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())


def test_scan_of_a_source_tree(spark, tmp_path):
    from vigilark.plans.scan import scan

    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.json").write_text(json.dumps({"id": "custom.sql-raw", "name": "A", "pattern": "rawSql\\(", "severity": "high", "description": "d"}))
    (tmp_path / "rules/b.json").write_text(json.dumps({"id": "custom.broken", "name": "B", "pattern": "(", "severity": "high", "description": "d"}))
    (tmp_path / "src/a.js").write_text("app.get('/u', h)\nconst id = req.query.id;\n\ndb.query('SELECT a FROM t WHERE b=' + id + req.query.x);\nconst token =\n  'abcdefghijklmnopqr';\nrawSql(req.query.z)\n")
    (tmp_path / "src/b.js").write_text("db.query('SELECT ' + user)\n")
    (tmp_path / "src/node_modules/c.js").write_text("const token = 'abcdefghijklmnopqr'")
    rows = {(r.file, r.line, r.rule_id): r for r in scan(spark, str(tmp_path / "src"), str(tmp_path / "rules")).collect()}
    sql = rows["a.js", 4, "regex.sql-injection"]
    assert (sql.category, sql.severity, sql.exploitability, sql.route_hint, sql.source_symbol, sql.attention_level) == ("SQL Injection", "HIGH", "reachable", "GET /u", "req.query.x", "HIGH")
    assert sql.occurrence_count == 3 and sql.data_source == "user_input" and sql.usage_context == "database"  # three rules see the statement
    # a match over two lines is placed at its first; its line alone holds no secret, so it isn't one
    assert ("a.js", 7, "custom.sql-raw") in rows and not any(f != "a.js" for f, *_ in rows)  # no flow and no shown input: b.js has none
    assert sorted(r.place for r in rows.values()) == list(range(1, len(rows) + 1))


def test_matches_in_whole_texts(spark):
    text = "jwt.sign(\n a)\nx\njwt.sign(b); jwt.sign(\n\n c)\npassword =\r\n 'abcdefghijklmnopq'"
    m = rules.file_matches(spark.createDataFrame([("a.js", text)], "file_path string, text string")).collect()
    assert [(r.line_no, r.nth, r.text) for r in m if r.rule_id == "regex.jwt-no-expiry"] == [(1, 1, "jwt.sign("), (4, 2, "jwt.sign(b); jwt.sign("), (4, 3, "jwt.sign(b); jwt.sign(")]
    assert [(r.line_no, r.text) for r in m if r.rule_id == "regex.hardcoded-secret"] == [(7, "password =")]
    assert rules.file_matches(spark.createDataFrame([("a", "x")], "file_path string, text string"), []).count() == 0
    assert rules.usable([("a", "LOW", "("), ("b", "LOW", "x")]) == [("b", "LOW", "x")]


def test_dedup_goes_by_the_last_accepted(spark):
    from vigilark.operators.jobs import accepted

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, at(h), k) for k, h in enumerate((0, 20, 40, 63.9, 64))] + [(2, at(5), 9)]
    assert sorted(r.seq for r in accepted(spark.createDataFrame(rows, "key long, ts timestamp, seq long")).collect()) == [0, 2, 4, 9]


def test_xml_manifests_by_element(spark):
    m = lambda t: spark.createDataFrame([("p", t)], "manifest_path string, text string")
    names = lambda df: sorted((r.name, r.version) for r in df.collect())
    assert names(manifests.csproj(m('<P xmlns="u"><PackageReference Update="a" Version="1.0"/><PackageReference Include="b" Version="2.0"/><PackageReference Include="c"><Version>3.0</Version></PackageReference><PackageReference Include="d"/></P>'))) == [("a", "1.0"), ("b", "2.0"), ("c", "3.0")]
    assert names(manifests.packages_config(m('<packages><package id="a"/><package id="b" version="2.0"/></packages>'))) == [("b", "2.0")]
    for parse in (manifests.pom, manifests.csproj, manifests.packages_config):
        assert parse(m("<broken")).count() == parse(m("")).count() == parse(m(None)).count() == 0

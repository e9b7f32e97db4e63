"""Syntax trees, scripts by bracket matching, and SQL texts followed through variables, by hand and by brute force."""

import ast
import collections
import random
import re

import pytest

from vigilark.operators import pyast, reach, scripts
from vigilark.sources.fixtures import statements

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("import pickle\npickle.loads(x)\n'pickle.loads(x)'", [(2, "pickle")]),
        ("yaml.load(a, Loader=yaml.SafeLoader)", []),
        ("yaml.load(a)", [(1, "yaml")]),
        ("eval('1')", []),
        ("eval(x)", [(1, "eval")]),
        ("subprocess.run(a, shell=True)\nsubprocess.run(a)", [(1, "shell")]),
        ("os.popen(a)\nos.system(b)", [(1, "os.popen"), (2, "os.system")]),
        ("def new_token():\n    return random.random()\npassword = random.choice(x)\ny = random.random()", [(3, "random_value"), (2, "random_function")]),
        ("def new_token():\n    pin = random.random() + random.random()\n    return random.choice(x)", [(2, "random_value"), (2, "random_value"), (3, "random_function")]),
        ("self.token: str = random.random()", []),
        ("a = 'SELECT x FROM t'\nb = a + u\nc = b + v\ncur.execute(c)\ncur.execute(c, p)", [(4, "sql_variable")]),
        ("c = b + v\nb = a + u\na = 'from t'\ndb.executemany(c)\ndb.execute(d)", [(4, "sql_variable")]),
        ("q = ('SELECT a '\n     'FROM sql')", [(1, "sql_sum")]),
        ("q = f'SELECT a FROM table {x}' % y", [(1, "sql_sum")]),
        ("q = 'SELECT a FROM table'", []),
        ("def broken(:", []),
    ],
)
def test_python_trees(text, want):
    assert [(no, kind) for no, kind, _ in pyast.python_findings(text)] == want


def test_findings_tell_all(spark):
    rows = [("a.py", "x = 1\n  \n" + "os.system(" + "y" * 300 + ")"), ("b.JS", "a\n  .exec(b)"), ("c.rb", "eval(x)"), ("d.py", None), ("e.js", None), ("f.py", "q = 'UPDATE t SET query=' + v")]
    got = {(r.file_path, r.line): r for r in pyast.tree_findings(spark.createDataFrame(rows, "file_path string, text string")).collect()}
    assert got.keys() == {("a.py", 3), ("b.JS", 1), ("f.py", 1)}
    r = got["a.py", 3]
    assert (r["pass"], r.type, r.name, r.severity, r.language, r.snippet) == (1, "command_injection", "Command execution via os.system", "high", "python", ("os.system(" + "y" * 300)[:200])
    assert r.fix.startswith("Replace with subprocess.run") and got["b.JS", 1].snippet == "a\n  .exec(b)" and got["b.JS", 1].language == "node"
    assert got["f.py", 1]["pass"] == 5 and got["f.py", 1].snippet == "'UPDATE t SET query=' + v"



def test_a_path_is_named_few_times(spark):
    """What makes a path is made again wherever the plan names it, so a suffix names it once."""
    rows = [(1, "eval(a)", ".py"), (2, "eval(b)", ".JS"), (3, "eval(c)", "py"), (4, "eval(d)", ".pyc"), (5, "eval(e)", ".py\n"), (6, "eval(a)", ".x.py")]
    files = spark.createDataFrame(rows, "id long, text string, ext string").selectExpr("concat('marked', id, ext) AS file_path", "text")
    got = pyast.tree_findings(files)
    assert sorted(r.file_path for r in got.collect()) == ["marked1.py", "marked2.JS", "marked6.x.py"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("marked") <= 4


# text, and what it holds: line, kind, own text
SCRIPTS = [
    ("eval(req.body.code)", [(1, "eval", "eval(req.body.code)")]),
    ("child_process\n  .exec(\n 'ls ' +\n dir)", [(1, "exec", "child_process\n  .exec(\n 'ls ' +\n dir)")]),
    ("db.query('SELECT a FROM t ' +\n  'WHERE sql=' + id)", [(1, "sql", "'SELECT a FROM t ' +\n  'WHERE sql='"), (1, "sql", "'SELECT a FROM t ' +\n  'WHERE sql=' + id")]),
    ("const q = `a ${exec(`b ${eval(x)}`)} c`;", [(1, "eval", "exec(`b ${eval(x)}`)"), (1, "exec", "exec(`b ${eval(x)}`)"), (1, "eval", "eval(x)")]),
    ("`\n${a}\n${ {b: `}`} }${eval(\n c)}`", [(3, "eval", "eval(\n c)")]),
    ("function exec(a) { return 1 }", []),
    ("class A { exec(a) {\n } }", []),
    ("new exec(x)", []),
    ("// eval(x)\n'eval(y)'; /* exec(z) */ /re'eval(/.test(x); 'it\\'s eval(q)'", []),
    ("readFile(p); fs.readFile(q); execSync(a, eval(b)); readFileSync()", [(1, "read", "readFile(p)"), (1, "exec", "execSync(a, eval(b))"), (1, "eval", "eval(b)"), (1, "read", "readFileSync()")]),
    ("if (a == 'SELECT x FROM sql' + b && c) {}", [(1, "sql", "'SELECT x FROM sql' + b"), (1, "sql", "a == 'SELECT x FROM sql' + b"), (1, "sql", "a == 'SELECT x FROM sql' + b && c")]),
    ("x = { a: exec(b), c: [eval(d)] }", [(1, "eval", "exec(b)"), (1, "exec", "exec(b)"), (1, "eval", "eval(d)")]),
    ("foo\nexec(x)\nconst y = 'select 1 from query' + z\nconst w = 2", [(2, "eval", "exec(x)"), (2, "exec", "exec(x)"), (3, "sql", "'select 1 from query' + z")]),
    ("eval(\n  a(b(c)),\n  d)\n", [(1, "eval", "eval(\n  a(b(c)),\n  d)")]),
    ('const s = "' + "x" * 40000 + '"; eval(s)', [(1, "eval", "eval(s)")]),
    ("eval(x", [(1, "eval", "eval(x")]),
    ("a?.exec(b); b.eval(c); b\n.\nexec(d)", [(1, "exec", "a?.exec(b)")]),  # the last one's name isn't written in one
    ("x = y - `SELECT ${a + b} FROM query`", [(1, "sql", "y - `SELECT ${a + b} FROM query`")]),
    ("a('SELECT 1 FROM sql' + b * c, d + (e))", [(1, "sql", "'SELECT 1 FROM sql' + b * c")]),
    ("a = b ? 'SELECT 1 FROM sql' + c : d - e; return 'x' + f", [(1, "sql", "'SELECT 1 FROM sql' + c")]),
    ("eval(x) } ) ] { ( eval(y)", [(1, "eval", "eval(x)"), (1, "eval", "eval(y)")]),
    ("", []),
    ("  // SELECT ", []),
]


def test_scripts_by_bracket_matching(spark):
    df = spark.createDataFrame([(f"f{k}.js", t) for k, (t, _) in enumerate(SCRIPTS)], "file_path string, text string")
    got = collections.defaultdict(list)
    for r in scripts.script_findings(df).collect():
        got[r.file_path].append((r.line, r.kind.removeprefix("script_"), r.snippet))
    for k, (text, want) in enumerate(SCRIPTS):
        assert sorted(got[f"f{k}.js"]) == sorted(want), text
    assert scripts.script_findings(df.limit(0)).count() == 0


def brute(seeds, edges):
    held = set(seeds)
    while more := {(g, d) for g, a, d in edges if (g, a) in held} - held:
        held |= more
    return held


def test_reach_equals_brute_force(spark):
    rnd = random.Random(8)
    edges = [(g, f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}") for g, n, m in (("a", 30, 25), ("b", 200, 240), ("c", 40, 160)) for _ in range(m)]
    edges += [("chain", f"v{k}", f"v{k + 1}") for k in range(600)] + [("ring", f"v{k}", f"v{(k + 1) % 20}") for k in range(20)] + [("ring", "v3", "out")]
    edges += [("lens", f"{side}{k}", f"{other}{k + 1}") for k in range(4) for side in "xy" for other in "xy"] + [("a", "v1", "v1"), ("loop", "s", "s")]
    seeds = [(g, f"v{rnd.randrange(n)}") for g, n in (("a", 30), ("b", 200), ("b", 200), ("c", 40))] + [("chain", "v7"), ("lens", "x0"), ("loop", "s"), ("lone", "z"), ("lone", "z")]
    got = reach.reached(spark.createDataFrame(seeds, "g string, v string"), spark.createDataFrame(edges * 2, "g string, src string, dst string")).collect()
    assert len(got) == len({(r.g, r.v) for r in got}) and {(r.g, r.v) for r in got} == brute(seeds, edges)
    none = spark.createDataFrame([], "g string, src string, dst string")
    assert reach.reached(spark.createDataFrame(seeds[:1], "g string, v string"), none).count() == 1
    assert reach.reached(spark.createDataFrame([], "g string, v string"), spark.createDataFrame(edges, "g string, src string, dst string")).count() == 0


def test_sql_flows_equal_the_variables_of_each_file(spark):
    lines = statements(spark, SF)
    files = collections.defaultdict(list)
    for r in lines.orderBy("line_no").collect():
        files[r.file_path].append(r.text)
    want = set()
    for path, rows in files.items():
        tree = ast.parse("\n".join(rows))
        held = pyast.sql_variables(tree)
        want |= {(path, line, name) for kind, line, _, name in pyast.sql_facts(tree) if kind == "call" and name in held}
    assert want and {(r.file_path, r.line, r.variable) for r in pyast.sql_flows(lines).collect()} == want


def test_files_of_one_text_are_read_once_and_told_each(spark):
    from vigilark.operators import pyast, taint

    code = "CASE WHEN id % 2 = 0 THEN 'import pickle\\nx = pickle.loads(y)' ELSE 'const v = req.query.id;\\ndb.query(v)\\neval(v)' END AS text"
    files = spark.range(20_000).selectExpr("concat('d/', id, CASE WHEN id % 2 = 0 THEN '.PY' WHEN id % 4 = 1 THEN '.ts' ELSE '.txt' END) AS file_path", code)
    found = pyast.tree_findings(files).groupBy("type", "line", "language").agg({"file_path": "count"}).collect()
    assert sorted(tuple(r) for r in found) == [("dangerous_eval", 3, "node", 5000), ("unsafe_pickle", 2, "python", 10_000)]
    flows = taint.taint_flows(files)
    assert {r.file_path[-3:] for r in flows.select("file_path").distinct().collect()} == {".ts"} and flows.count() == 5000
    # what is stored of the texts is a row for each, not for each file
    files = {f for x in (pyast.tree_findings(files), flows) for f in x.inputFiles() if "/told-" in f}
    assert files and spark.read.parquet(*files).count() == 3


def test_scripts_are_dealt_by_their_characters(spark):
    """Twice the different texts are read by twice the tasks, whatever the setting of shuffle partitions."""
    files = lambda n: spark.range(n).selectExpr("concat('f', id, '.js') AS file_path", "concat('const v', 1000000 + id, ' = eval(x); exec(y)') AS text")
    for n in (50, 100):
        got = scripts.script_findings(files(n), task_chars=400)
        dealt = [int(x) for x in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", got._jdf.queryExecution().optimizedPlan().toString())]
        assert dealt and set(dealt) == {n * 33 // 400 + 1}
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scripts.script_findings(files(n)).collect())) and got.count() == 3 * n


def test_only_what_the_passes_need_is_read(spark):
    rows = [("a.py", "token = random.random()\neval(x)"), ("b.js", "eval(x)")]
    files = spark.createDataFrame(rows, "file_path string, text string")
    found = {p: pyast.tree_findings(files, p) for p in ((2,), (6,), (1, 6))}
    assert {p: sorted((r["pass"], r.file_path) for r in df.collect()) for p, df in found.items()} == {(2,): [(2, "a.py")], (6,): [(6, "b.js")], (1, 6): [(1, "a.py"), (6, "b.js")]}


def test_statements_that_read_alike_are_parsed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(pyast, "parsed", lambda text: seen.append(text) or ast.parse(text))
    pyast.facts_of_text.cache_clear()
    got = [pyast.facts_of_text(t) for t in ("alike = 'SELECT 1'", "x = alike + y", "alike = 'SELECT 1'", "\ncur.execute(x)")]
    assert len(seen) == 3 and got[0] == got[2] == (("text", 1, "alike", "", "alike = 'SELECT 1'"),) and got[3] == (("call", 2, "cur.execute", "x", "cur.execute(x)"),)

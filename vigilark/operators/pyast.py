"""Findings in syntax trees: Python files parsed one a row, scripts by bracket matching, and SQL texts followed through variables."""

from __future__ import annotations

import ast
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ends, has
from ..registry import register
from ..sources.fixtures import CODE_LINES, STATEMENTS, code_lines, statements
from ..sources.shared import once_a_text, stored
from .reach import reached
from .scripts import SCRIPT_SUFFIXES, SNIPPET, SQL_CLAUSE as CLAUSE, SQL_TOKENS, SQL_VERB as VERB, script_findings

# fixed values: calls and words
PICKLE = {"pickle.load", "pickle.loads", "cPickle.load", "cPickle.loads"}
PROCESS = {"subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call"}
SECURITY = ("token", "password", "secret", "nonce", "salt", "key", "otp", "session", "csrf", "auth", "passwd", "pin")
PYTHON_TRIGGERS = ("eval(", "exec(", "subprocess", "os.system(", "pickle.load", "yaml.load(", "open(", "SELECT ", "INSERT ", "UPDATE ", "DELETE ")
# fixed values: what is told of each kind: pass, type, name, severity, what mends it
_SECRETS = "Use the secrets module (secrets.token_hex / secrets.randbelow) for security values."
_RUN = "Replace with subprocess.run([...], shell=False) and validate inputs."
TOLD = {
    "pickle": (1, "unsafe_pickle", "Unsafe pickle deserialization", "high", "Avoid pickle on untrusted data. Use json, or verify the source is trusted."),
    "yaml": (1, "unsafe_yaml", "Unsafe yaml.load() - missing SafeLoader", "high", "Use yaml.safe_load(data) or yaml.load(data, Loader=yaml.SafeLoader)."),
    "eval": (1, "code_execution", "Dynamic code execution (eval/exec)", "high", "Avoid eval/exec. Use ast.literal_eval for data, or an explicit dispatch table."),
    "shell": (1, "command_injection", "subprocess with shell=True", "high", "Use a list of args with shell=False (the default), never a shell string."),
    "os.system": (1, "command_injection", "Command execution via os.system", "high", _RUN),
    "os.popen": (1, "command_injection", "Command execution via os.popen", "high", _RUN),
    "random_value": (2, "weak_random", "Weak RNG for a security value", "medium", _SECRETS),
    "random_function": (3, "weak_random", "Weak RNG in security function", "medium", _SECRETS),
    "sql_variable": (4, "sql_injection", "SQL injection via intermediate variable", "high", "Use parameterized queries: cursor.execute('SELECT ... WHERE x = %s', (value,))"),
    "sql_sum": (5, "sql_injection", "SQL injection via string formatting", "high", "cursor.execute('SELECT * FROM table WHERE id = %s', (user_input,))"),
    "script_eval": (6, "dangerous_eval", "Dangerous eval() usage", "high", "JSON.parse(userInput)"),
    "script_exec": (6, "command_injection", "Command injection via exec()", "high", "execFile(command, args, callback)"),
    "script_read": (6, "path_traversal", "Potential path traversal in file read", "medium", "path.join(__dirname, 'base', path.basename(userInput))"),
    "script_sql": (6, "sql_injection", "SQL injection via string concatenation", "high", "db.query('SELECT * FROM table WHERE id = ?', [userInput])"),
}
PASSES, SCRIPT_PASS = (1, 2, 3, 4, 5, 6), 6

SQL_VERB, SQL_CLAUSE = re.compile(VERB), re.compile(CLAUSE)
#: Words of which a Python file holds one if a parser can find anything in it.
HINTS = ("pickle", "yaml", "eval", "exec", "subprocess", "os.system", "os.popen", "random.", "select", "insert", "update", "delete")
_LITERAL = r"""[rbfuRBFU]{0,2}(?:\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*')"""
SIDE_BY_SIDE = re.compile(rf"(?:{_LITERAL}[\s\\]*){{2,}}")
#: Texts up to so many characters are kept with their facts, 4096 of them a worker.
CACHED_CHARS = 1000
FINDING = ("pass", "type", "name", "severity", "fix")


def dotted(node: ast.AST) -> str:
    return f"{dotted(node.value)}.{node.attr}".lstrip(".") if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def call_kind(call: ast.Call) -> str | None:
    """The key of what is told of a dangerous call."""
    name = dotted(call.func)
    if name in PICKLE:
        return "pickle"
    if name == "yaml.load":
        return None if "safe" in dotted(keyword(call, "Loader") or ast.Constant(0)).lower() else "yaml"
    if name in ("eval", "exec"):
        return None if len(call.args) == 1 and isinstance(call.args[0], ast.Constant) else "eval"
    if name in PROCESS:
        shell = keyword(call, "shell")
        return "shell" if isinstance(shell, ast.Constant) and shell.value is True else None
    return name if name in ("os.system", "os.popen") else None


def random_calls(node: ast.AST | None) -> list[ast.Call]:
    return [c for c in ast.walk(node) if isinstance(c, ast.Call) and dotted(c.func).startswith("random.")] if node is not None else []


def secure_name(name: str) -> bool:
    return any(w in name.lower() for w in SECURITY)


def weak_random(tree: ast.AST) -> list[tuple[str, ast.Call]]:
    """Random numbers for variables, or in functions, that a security word names; a line once for the latter."""
    found = []
    for n in ast.walk(tree):
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) else []
        if any(secure_name(getattr(t, "id", None) or getattr(t, "attr", "")) for t in targets):
            found += [("random_value", c) for c in random_calls(n.value)]
    lines = {c.lineno for _, c in found}
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and secure_name(n.name):
            for c in random_calls(n):
                if c.lineno not in lines:
                    lines.add(c.lineno)
                    found.append(("random_function", c))
    return found


def looks_like_sql(text: str) -> bool:
    """A verb, a clause, and a word of a database."""
    up = text.upper()
    return bool(SQL_VERB.search(up) and SQL_CLAUSE.search(up)) and any(t in up for t in SQL_TOKENS)


def sql_facts(tree: ast.AST) -> list[tuple[str, int, str, str]]:
    """What an SQL text's way through variables is made of: (kind, line, name, other).

    text: name holds a constant with a verb or clause; sum: name is a sum with other; call: a call named so executes
    its only argument, the variable other.
    """
    found = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign):
            names, x = [t.id for t in n.targets if isinstance(t, ast.Name)], n.value
            if isinstance(x, ast.Constant) and isinstance(x.value, str) and (SQL_VERB.search(x.value.upper()) or SQL_CLAUSE.search(x.value.upper())):
                found += [("text", n.lineno, v, "") for v in names]
            elif isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add):
                found += [("sum", n.lineno, v, s.id) for v in names for s in (x.left, x.right) if isinstance(s, ast.Name)]
        elif isinstance(n, ast.Call) and "execute" in dotted(n.func).lower() and len(n.args) == 1 and isinstance(n.args[0], ast.Name):
            found.append(("call", n.lineno, dotted(n.func), n.args[0].id))
    return found


@functools.lru_cache(maxsize=4096)
def facts_of_text(text: str) -> tuple[tuple[str, int, str, str, str], ...]:
    """sql_facts of a text with the line of each; statements that read alike often stand near each other."""
    tree, rows = parsed(text), text.splitlines()
    return tuple((kind, line, name, other, rows[line - 1].strip()[:SNIPPET]) for kind, line, name, other in (sql_facts(tree) if tree else []))


def sql_variables(tree: ast.AST) -> set[str]:
    """Variables of one file that hold an SQL text, and those that a sum with one of them reaches."""
    facts = sql_facts(tree)
    held = {name for kind, _, name, _ in facts if kind == "text"}
    while more := {name for kind, _, name, other in facts if kind == "sum" and other in held} - held:
        held |= more
    return held


def parsed(text: str) -> ast.AST | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_findings(text: str, sums: bool = True) -> list[tuple[int, str, str]]:
    """(line, kind, snippet) of what is dangerous; a text that isn't Python has none.

    The snippet is the line, cut to SNIPPET characters; that of a sum or of literals side by side that read like SQL is
    their own text.
    """
    if (tree := parsed(text)) is None:
        return []
    lines = text.splitlines()
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    found = [(c.lineno, k) for c in calls if (k := call_kind(c))]
    found += [(c.lineno, k) for k, c in weak_random(tree)]
    held = sql_variables(tree)
    found += [(line, "sql_variable") for kind, line, _, name in sql_facts(tree) if kind == "call" and name in held]
    out = [(no, k, lines[no - 1].strip()[:SNIPPET] if no <= len(lines) else "") for no, k in found]
    if sums:
        joined = lambda n: isinstance(n, ast.BinOp) or (isinstance(n, (ast.Constant, ast.JoinedStr)) and SIDE_BY_SIDE.fullmatch(ast.get_source_segment(text, n) or ""))
        parts = [(n.lineno, ast.get_source_segment(text, n) or "") for n in ast.walk(tree) if joined(n)]
        out += [(no, "sql_sum", x[:SNIPPET]) for no, x in parts if looks_like_sql(x)]
    return out


def told(found: DataFrame) -> DataFrame:
    """Findings of a kind with all that is told of it."""
    held = F.create_map(*[x for k, v in TOLD.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for n, y in zip(FINDING, v)]))])
    language = F.when(F.startswith("kind", F.lit("script_")), "node").otherwise("python")
    x = found.withColumn("_told", held[F.col("kind")])
    return x.select(*found.columns, *[F.col("_told")[n].alias(n) for n in FINDING], language.alias("language")).drop("kind")


def tree_findings(files: DataFrame, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """(file_path, line, snippet, pass, type, name, severity, fix, language) of files (file_path, text), by their suffix.

    Passes: 1 calls, 2 random numbers for variables, 3 in functions, 4 variables that hold SQL, 5 sums that read like
    SQL, 6 scripts; findings of other passes than those asked for aren't told, nor files read that they alone need. Files
    without any word that a finding needs never reach a parser; of files with the same text one does.
    """

    def run(batches):
        for b in batches:
            out = [(p, *x) for p, t, sums in zip(*(c.to_pylist() for c in b.columns)) for x in python_findings(t or "", sums)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["file_path", "line", "kind", "snippet"])

    def parsers(files: DataFrame) -> DataFrame:
        low = "lower(file_path)"
        python = files.where(F.expr(ends(low, [".py"]))).where(F.expr(has("lower(text)", HINTS)))
        python = python.select("file_path", "text", F.expr(has("lower(text)", [t.lower() for t in PYTHON_TRIGGERS])).alias("sums")).mapInArrow(run, "file_path string, line int, kind string, snippet string")
        of_scripts = lambda: script_findings(files.where(F.expr(ends(low, SCRIPT_SUFFIXES))).select("file_path", "text"))
        found = of_scripts() if not in_python else python.unionByName(of_scripts()) if in_scripts else python
        return told(found).where(F.col("pass").isin(*passes))

    # the path is named once, as what makes it is made again wherever it is named
    in_scripts, in_python = SCRIPT_PASS in passes, any(p != SCRIPT_PASS for p in passes)
    read = ({".py": ".py"} if in_python else {}) | (dict.fromkeys(SCRIPT_SUFFIXES, ".js") if in_scripts else {})
    kinds = F.create_map(*[F.lit(x) for kv in read.items() for x in kv])
    suffix = kinds[F.regexp_extract(F.lower("file_path"), r"[.][a-z]+\z", 0)]
    return once_a_text(files.select("file_path", "text"), suffix, parsers)


def statement_facts(lines: DataFrame) -> DataFrame:
    """(file_path, line, kind, name, other, snippet) of lines (file_path, line_no, text), each a whole statement or a whole file."""

    def run(batches):
        for b in batches:
            out = []
            for path, no, text in zip(*(c.to_pylist() for c in b.columns)):
                facts = facts_of_text(text or "") if len(text or "") <= CACHED_CHARS else facts_of_text.__wrapped__(text)
                out += [(path, no + line - 1, kind, name, other, snippet) for kind, line, name, other, snippet in facts]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.string()) for k, c in enumerate(cols)], ["file_path", "line", "kind", "name", "other", "snippet"])

    return lines.select("file_path", F.col("line_no").cast("int"), "text").mapInArrow(run, "file_path string, line int, kind string, name string, other string, snippet string")


def sql_flows(lines: DataFrame) -> DataFrame:
    """Calls that execute nothing but a variable which some SQL text of the file reaches, over sums in any order and number."""
    facts = stored(statement_facts(lines), "facts")  # statements are parsed once
    of = lambda kind: facts.where(F.col("kind") == kind)
    held = reached(of("text").select(F.col("file_path").alias("g"), F.col("name").alias("v")), of("sum").select(F.col("file_path").alias("g"), F.col("other").alias("src"), F.col("name").alias("dst")))
    calls = of("call").select("file_path", "line", "snippet", F.col("other").alias("variable"))
    return told(calls.join(held.select(F.col("g").alias("file_path"), F.col("v").alias("variable")), ["file_path", "variable"]).withColumn("kind", F.lit("sql_variable")))


# ---- queries: each line of code is a file of its own ----

_single = lambda s, d: code_lines(s, d).selectExpr("CONCAT(file_path, '#', ordinal, CASE WHEN right(file_path, 3) = '.py' THEN '.py' ELSE '.js' END) AS file_path", "replace(text, 'return ', '') AS text")
# what the trees of the snippets hold, read by hand: word of the snippet, line, kind, own text if it isn't the line
_PY = [
    ("os.system(", 1, "os.system", ""), ("yaml.load(request.body)", 1, "yaml", ""), ("pickle.loads(body)", 1, "pickle", ""), ("exec(user_code)", 1, "eval", ""), ("shell=True", 1, "shell", ""),
    ("table_x", 1, "sql_sum", '"SELECT a FROM table_x WHERE b=" + c'), ("token = random", 1, "random_value", ""), ("def new_token", 2, "random_function", ""),
]
_JS = [
    ("child_process.exec(", 1, "script_exec", ""), ("eval(req", 1, "script_eval", ""), ("exec(cmd)", 1, "script_eval", "exec(cmd)"), ("exec(cmd)", 1, "script_exec", "exec(cmd)"), ("readFile(path)", 1, "script_read", "readFile(path)"),
    ("+ req.query.id", 1, "script_sql", '"SELECT name FROM t WHERE id=" + req.query.id'), ("+ req.query[", 1, "script_sql", '"SELECT a FROM t WHERE b=" + req.query[\'b\']'),
]
_quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
_TOLD = "told(kind, pass, type, name, severity, fix) AS (VALUES " + ", ".join(f"({_quoted(k)}, {v[0]}, {', '.join(map(_quoted, v[1:]))})" for k, v in TOLD.items()) + ")"
_BY_HAND = "byhand(word, line, kind, own, python) AS (VALUES " + ", ".join(f"({_quoted(w)}, {n}, {_quoted(k)}, {_quoted(x)}, {python})" for rows, python in ((_PY, True), (_JS, False)) for w, n, k, x in rows) + ")"
_FOUND = f"""WITH {CODE_LINES}, {_TOLD}, {_BY_HAND},
found AS (SELECT file_path || '#' || ordinal || CASE WHEN python THEN '.py' ELSE '.js' END AS file_path, line, CASE own WHEN '' THEN trim(string_split(text, chr(10))[line]) ELSE own END AS snippet, pass::INT AS pass, type, name, severity, fix, CASE WHEN python THEN 'python' ELSE 'node' END AS language
  FROM code_lines JOIN byhand ON contains(text, word) AND ends_with(file_path, '.py') = python JOIN told USING (kind))"""


def _t(name: str, where: str, *passes: int) -> None:
    register(name, lambda s, d: tree_findings(_single(s, d), passes or PASSES), f"{_FOUND} SELECT * FROM found WHERE {where}")


_t("t1_python_calls", "pass = 1", 1)
_t("t2_weak_random_assignment", "pass = 2", 2)
_t("t3_weak_random_function", "pass = 3", 3)
register(
    "t4_sql_variables",
    lambda s, d: sql_flows(statements(s, d)),
    f"""WITH RECURSIVE {STATEMENTS}, {_TOLD}, f AS (SELECT *, regexp_extract(text, '^(\\w+) = ', 1) AS v, regexp_extract(text, '^\\w+ = (.*)$', 1) AS x FROM statements),
seeds AS (SELECT file_path, v FROM f WHERE left(x, 1) = '"' AND regexp_matches(x, 'SELECT|FROM')),
edges AS (SELECT file_path, v AS dst, unnest(string_split(x, ' + ')) AS src FROM f WHERE contains(x, ' + ')),
held(file_path, v) AS (SELECT file_path, v FROM seeds UNION SELECT e.file_path, e.dst FROM held h JOIN edges e ON e.file_path = h.file_path AND e.src = h.v)
SELECT file_path, line_no AS line, text AS snippet, v AS variable, pass::INT AS pass, type, name, severity, fix, 'python' AS language
FROM (SELECT file_path, line_no, text, regexp_extract(text, 'execute\\((\\w+)\\)', 1) AS v FROM statements) JOIN held USING (file_path, v), told WHERE kind = 'sql_variable'""",
)
_t("t5_hybrid_dispatch", "true")
_t("t6_script_calls", "pass = 6", 6)
_t("t7_sql_concatenation", "pass = 5", 5)

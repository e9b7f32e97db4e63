"""Guidance of findings: what a category means, why it matters, what to do, and the change from the evidence on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from ..sources.fixtures import CODE_LINES, FINDINGS, findings
from .classify import IMPROVEMENTS, ISSUES, issues
from .guidance import ADVICE, NO_ADVICE, advice

#: Of each category what the code does (with the file in place of %s), what can come of it, and the line that takes its place.
TEXTS = {
    "SQL Injection": ("A query in %s is put together from text that a user can choose.", "Whoever chooses the text can read or change what the query never meant to touch.", "cursor.execute(query, (value,))"),
    "Command Injection": ("A command in %s reaches a shell together with outside text.", "Outside text can end the command and begin another, with the rights of the service.", "subprocess.run([command, value], shell=False)"),
    "Hardcoded Secrets": ("A secret stands in the source of %s.", "All who read the source, its history or a copy can use it.", "secret = os.environ['SECRET']"),
    "Open Redirect": ("The destination of a redirect in %s comes from the request.", "A link to this site can lead to any other, under this site's name.", "redirect(KNOWN.get(name, '/'))"),
    "Insecure Auth Logic": ("A check of who asks in %s compares plain values or is switched off.", "The check can be guessed, timed or skipped.", "if verify(password, stored_hash):"),
    "Dynamic Code Execution (eval/exec)": ("Text is run as code in %s.", "Whoever can write the text can run anything here.", "value = ast.literal_eval(text)"),
    "Insecure CORS Configuration": ("Other origins may call %s without a list of them.", "Any page that a user opens can ask in the user's name.", "cors({ origin: KNOWN_ORIGINS })"),
    "Credential in URL": ("An address in %s holds a user name and a password.", "Addresses end up in logs, histories and referrers.", "url = os.environ['SERVICE_URL']"),
    "Server-Side Template Injection": ("A template in %s is made from outside text.", "Template syntax in that text runs on the server.", "render_template('page.html', name=name)"),
    "Unsafe Pickle Deserialization": ("Objects are unpickled in %s.", "A pickle says which code to run as it is read.", "data = json.loads(text)"),
    "Unsafe YAML Deserialization": ("YAML is loaded in %s by a loader that builds any object.", "A document can name objects whose making runs code.", "data = yaml.safe_load(text)"),
    "Flask Debug Mode Enabled": ("The server in %s starts in debug mode.", "Its console answers anyone who can reach it.", "app.run(debug=False)"),
    "Unescaped HTML in Template (Potential XSS)": ("Markup in %s is shown as it comes.", "Scripts inside it run in the reader's browser.", "element.textContent = value"),
    "Weak Input Validation": ("Outside values are used in %s before they are tested.", "Values that nobody thought of decide what happens next.", "value = schema.parse(raw)"),
    "Weak Random Generator Usage": ("Numbers that must not be guessed come from an ordinary generator in %s.", "A few of its numbers tell the next ones.", "value = secrets.token_hex(16)"),
    "Exception Detail Exposure": ("Details of an error leave %s with the answer.", "Paths, versions and queries help the next attempt.", "return {'error': 'internal'}, 500"),
    "Insecure HTTP Usage": ("A connection in %s isn't encrypted.", "Others on the way can read and change what is sent.", "url = url.replace('http://', 'https://')"),
    "Debug Mode Enabled (Improvement)": ("Debugging is switched on in %s.", "It slows the service down and tells too much.", "DEBUG = False"),
    "Hardcoded URL Configuration": ("An address is written into %s.", "It has to be edited for every place that the code runs in.", "base = os.environ['BASE_URL']"),
    "Environment Secret Fallback": ("A secret in %s has a default.", "Where the setting is forgotten the default is the secret.", "secret = os.environ['SECRET']"),
    "Debug Logging Hygiene": ("Debug output is left in %s.", "It fills logs, and may hold personal data.", "logger.debug(message)"),
    "Broad Exception Handling": ("All errors are caught alike in %s.", "Faults that nobody expected go unseen.", "except ValueError as error:"),
    "Input Validation Coverage Hint": ("Input of %s isn't tested near its entry.", "Later code has to guess what it can rely on.", "value = schema.parse(raw)"),
    "Weak Randomness Hygiene": ("An ordinary generator is used in %s.", "It mustn't be copied to where numbers have to be secret.", "value = secrets.token_hex(16)"),
    "HTTPS Migration Opportunity": ("An address in %s begins with http.", "The same place mostly answers to https.", "url = url.replace('http://', 'https://')"),
    "Large Function Complexity": ("A function in %s is long.", "What is long is seldom read or tested in full.", "def part(value):"),
    "Credential Placeholder Cleanup": ("A placeholder of a credential stands in %s.", "Placeholders get filled in where they stand.", "token = os.environ['TOKEN']"),
    "Unused Import Hygiene": ("A module is imported in %s and not used.", "It costs time, and hides what the code depends on.", "# removed"),
    "Error Boundary Coverage": ("Parts of the page in %s have no boundary for errors.", "One part's error takes all of the page away.", "<ErrorBoundary><Part /></ErrorBoundary>"),
    "File Context Manager Hygiene": ("A file is opened in %s without a block that closes it.", "Open files run out, and writes may be lost.", "with open(path) as file:"),
    "Rate Limiting Coverage Hint": ("A route in %s may be asked without limit.", "Guessing and flooding cost the asker nothing.", "app.use(limit({ max: 100 }))"),
    "Critical Action Audit Logging": ("An important action in %s leaves no record.", "Afterwards nobody can tell who did what.", "audit.record(user, action)"),
    "Unverified Security Signal": ("Something in %s looks like a risk that couldn't be confirmed.", "It may be harmless; a look at the code decides.", "# reviewed"),
}
OTHER = ("A pattern in %s needs a look.", "What can come of it depends on where the value comes from.", "# reviewed")
assert {c for _, c, _ in IMPROVEMENTS} <= TEXTS.keys()


def explained(f: DataFrame) -> DataFrame:
    """f (category, file, evidence and others) with explanation, danger, advice and exact_fix; categories without a text of their own have a general one, so no finding goes."""
    told = F.create_map(*[x for k, v in TEXTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    text = F.coalesce(told[F.trim(F.coalesce("category", F.lit("")))], F.array(*map(F.lit, OTHER)))
    place = F.when(F.coalesce(F.trim("file"), F.lit("")) == "", "this code").otherwise(F.trim("file"))
    shown = F.when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "# the line that was found").otherwise(F.trim("evidence"))
    return f.withColumn("_t", text).withColumns({
        "explanation": F.replace(F.col("_t")[0], F.lit("%s"), place), "danger": F.col("_t")[1], "advice": advice(F.col("category")),
        "exact_fix": F.concat(F.lit("Before:\n"), shown, F.lit("\n\nAfter:\n"), F.col("_t")[2]),
    }).drop("_t")


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_TABLE = "texts(category, explanation, danger, line, advice) AS (VALUES " + ", ".join("(" + ", ".join(map(_quoted, (k, *v, ADVICE.get(k, NO_ADVICE)))) + ")" for k, v in TEXTS.items()) + ")"
_COLUMNS = f"""replace(coalesce(t.explanation, {_quoted(OTHER[0])}), '%s', place) AS explanation, coalesce(t.danger, {_quoted(OTHER[1])}) AS danger, coalesce(t.advice, {_quoted(NO_ADVICE)}) AS advice,
  'Before:' || chr(10) || shown || chr(10) || chr(10) || 'After:' || chr(10) || coalesce(t.line, {_quoted(OTHER[2])}) AS exact_fix"""
_KEYS = ("explanation", "danger", "advice", "exact_fix")
register("c20_guidance_texts", lambda s, d: explained(findings(s, d)).select("ordinal", *_KEYS), f"WITH {FINDINGS}, {_TABLE}, f AS (SELECT *, file AS place, evidence AS shown FROM findings) SELECT ordinal, {_COLUMNS} FROM f LEFT JOIN texts t USING (category)")
register(
    "c20_guidance_of_issues",
    lambda s, d: explained(issues(s, d).withColumn("file", F.col("file_path"))).select("ordinal", "rule_id", "nth", *_KEYS),
    f"WITH {CODE_LINES}, {ISSUES}, {_TABLE}, f AS (SELECT *, file_path AS place, evidence AS shown FROM final) SELECT ordinal, rule_id, nth, {_COLUMNS} FROM f LEFT JOIN texts t USING (category)",
)

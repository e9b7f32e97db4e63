"""Detection quality: what rules, trees and data flow find in planted lines of code, against labels.

Each line of code is a file of its own, planted with a category or safe. A label is a true positive where some layer
finds its category in the file, else a false negative; each category found in a safe file is a false positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has, lit
from ..registry import register
from ..sources import readers
from ..sources.fixtures import CODE_LINES, SNIPPETS, code_lines
from .inputs import _BAN, _PATH, parsed
from .pyast import _BY_HAND, _TOLD, tree_findings
from .rules import EXCLUDED_PARTS, EXCLUDED_PATH, MATCHES, VALID, judged_matches, matches, scanned
from .taint import taint_flows

# fixed values: categories of rules and of tree findings
RULE_CATEGORY = {
    "regex.sql-injection": "sql_injection", "regex.command-injection": "command_injection", "regex.eval-usage": "code_injection", "node.eval_usage": "code_injection", "python.exec_usage": "code_injection",
    "node.sql_injection": "sql_injection", "python.sql_injection": "sql_injection", "regex.hardcoded-secret": "hardcoded_secret", "regex.credential-url": "credential_url", "regex.weak-random": "weak_random",
    "regex.unsafe-yaml-load": "unsafe_deserialization", "regex.unsafe-pickle-load": "unsafe_deserialization", "regex.ssti": "ssti", "regex.open-redirect": "open_redirect", "regex.insecure-auth": "insecure_auth",
    "regex.jwt-no-expiry": "jwt_no_expiry", "regex.insecure-cors": "insecure_cors", "regex.path-traversal": "path_traversal", "regex.nosql-injection": "nosql_injection",
}
TREE_CATEGORY = {
    "unsafe_pickle": "unsafe_deserialization", "unsafe_yaml": "unsafe_deserialization", "unsafe_deserialization": "unsafe_deserialization", "command_injection": "command_injection", "weak_random": "weak_random",
    "code_execution": "code_injection", "dangerous_eval": "code_injection", "sql_injection": "sql_injection", "path_traversal": "path_traversal",
}
#: What each snippet was planted with, by its number; the others are safe. Some are of categories that no layer knows.
PLANTED = {
    0: "hardcoded_secret", 2: "command_injection", 3: "command_injection", 4: "sql_injection", 6: "insecure_auth", 7: "insecure_auth", 8: "open_redirect", 10: "unsafe_deserialization", 11: "unsafe_deserialization",
    12: "unsafe_deserialization", 13: "unsafe_deserialization", 14: "insecure_cors", 15: "credential_url", 16: "weak_random", 18: "ssti", 19: "jwt_no_expiry", 21: "path_traversal", 22: "nosql_injection", 23: "code_injection",
    24: "code_injection", 25: "sql_injection", 26: "xss", 27: "debug_mode", 29: "insecure_http", 30: "exception_leak", 31: "command_injection", 35: "command_injection", 36: "hardcoded_secret", 37: "hardcoded_secret",
    40: "sql_injection", 41: "jwt_no_expiry", 43: "sql_injection", 44: "command_injection", 45: "weak_random", 46: "weak_random",
}


def _named(table: dict[str, str], of: str):
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(of)]


def labels(lines: DataFrame) -> DataFrame:
    """(file, want): one row a line, want is null of a safe one."""
    return lines.select(F.col("ordinal").alias("file"), F.create_map(*[F.lit(x) for kv in PLANTED.items() for x in kv])[(F.col("ordinal") % len(SNIPPETS)).cast("int")].alias("want"))


def found(lines: DataFrame) -> DataFrame:
    """(file, category, valid), each file and category once: what the layers find in lines (ordinal, file_path, text), and whether that holds with the validity policy of rules."""
    by_rule = judged_matches(matches(scanned(lines))).select(F.col("ordinal").alias("file"), F.coalesce(_named(RULE_CATEGORY, "rule_id"), F.col("rule_id")).alias("category"), "valid")
    own = lines.where(f"NOT {EXCLUDED_PARTS}").select(F.concat(F.col("ordinal").cast("string"), F.lit("/x."), F.substring_index("file_path", ".", -1)).alias("file_path"), "text")
    number = F.substring_index("file_path", "/", 1).cast("bigint").alias("file")
    by_tree = tree_findings(own).select(number, _named(TREE_CATEGORY, "type").alias("category")).where("category IS NOT NULL")
    by_flow = taint_flows(own).where("NOT sanitized").select(number, F.col("kind").alias("category"))
    every = by_rule.unionByName(by_tree.unionByName(by_flow).withColumn("valid", F.lit(True)))
    return every.groupBy("file", "category").agg(F.bool_or("valid").alias("valid"))


def judged(want: DataFrame, got: DataFrame) -> DataFrame:
    """(file, category, before, after) from labels (file, want) and findings (file, category, valid): TP and FN of labels, FP of safe files, without the policy and with it.

    A false alarm that the policy takes away has no verdict after it.
    """
    met = want.where("want IS NOT NULL").join(got.withColumnRenamed("category", "want"), ["file", "want"], "left")
    told = met.select("file", F.col("want").alias("category"), F.when(F.col("valid").isNotNull(), "TP").otherwise("FN").alias("before"), F.when(F.col("valid"), "TP").otherwise("FN").alias("after"))
    wrong = got.join(want.where("want IS NULL").select("file"), "file", "left_semi").select("file", "category", F.lit("FP").alias("before"), F.when(F.col("valid"), "FP").alias("after"))
    return told.unionByName(wrong)


def of(verdicts: DataFrame, when: str) -> DataFrame:
    """The verdicts before or after."""
    return verdicts.where(F.col(when).isNotNull()).select("file", "category", F.col(when).alias("verdict"))


def scores(verdicts: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each category, and of `all`; 0 where nothing was found or to be found."""
    counts = verdicts.groupBy("category").agg(*[F.count_if(F.col("verdict") == v.upper()).alias(v) for v in ("tp", "fp", "fn")])
    counts = counts.unionByName(counts.agg(F.lit("all").alias("category"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("tp", "fp", "fn")]))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    g = counts.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two sets of scores what the second has more, by category."""
    names = ("tp", "fp", "fn", "precision", "recall", "f1")
    old = before.select("category", *[F.col(n).alias(f"_{n}") for n in names])
    x = after.join(old, "category", "full")
    return x.select("category", *[(F.coalesce(n, F.lit(0)) - F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])


# fixed values: the noisy rules and names before the policy was widened
NOISE_BEFORE = ("B311", "B322", "B330")
NAMES_BEFORE = ("generate", "dataset", "seed", "mock", "fixture", "sample", "factory", "/data/", "/scripts/", "_test", "test_", "/tests/")


def noise_counts(report: DataFrame) -> DataFrame:
    """Of an analyzer's findings how many two policies leave, and where those of one rule lie; one row."""
    r = report.select(F.explode("results").alias("r")).select("r.test_id", F.replace(F.lower("r.filename"), F.lit(chr(92)), F.lit("/")).alias("name"))
    old = F.col("test_id").isin(*NOISE_BEFORE) & F.expr(has("name", NAMES_BEFORE))
    new = F.col("test_id").isin(*readers.NOISE_RULES) & F.expr(has("name", readers.NOISE_NAMES))
    asserts = F.col("test_id") == "B101"
    told = {"findings": F.lit(True), "asserts": asserts, "asserts_aside": asserts & new, "asserts_kept": asserts & ~new, "other_noise": F.col("test_id").isin(*NOISE_BEFORE), "kept_before": ~old, "kept_after": ~new, "fewer": new & ~old}
    return r.agg(*[F.count_if(c).alias(n) for n, c in told.items()])


# ---- queries ----

_FLOW_WORDS = [("child_process.exec(", "command_injection"), ("+ req.query.id", "sql_injection"), ("res.redirect(req.query", "open_redirect"), ("exec.Command(", "command_injection"), ("+ req.query[", "sql_injection")]
_pairs = lambda table: ", ".join(f"({lit(k) if isinstance(k, str) else k}, '{v}')" for k, v in table)
_EVAL = f"""WITH {CODE_LINES}, {MATCHES}, {VALID}, {_TOLD}, {_BY_HAND},
of_rule(rule_id, category) AS (VALUES {_pairs(RULE_CATEGORY.items())}), of_tree(type, category) AS (VALUES {_pairs(TREE_CATEGORY.items())}), planted(id, want) AS (VALUES {_pairs(PLANTED.items())}), of_flow(mark, category) AS (VALUES {_pairs(_FLOW_WORDS)}),
want AS (SELECT ordinal AS file, want FROM code_lines LEFT JOIN planted ON ordinal % {len(SNIPPETS)} = id),
others AS (SELECT ordinal AS file, category FROM code_lines JOIN byhand ON contains(text, word) AND (CASE WHEN python THEN ends_with(file_path, '.py') ELSE ends_with(file_path, '.js') END) JOIN told USING (kind) JOIN of_tree USING (type) WHERE NOT {EXCLUDED_PATH}
  UNION SELECT ordinal, category FROM code_lines JOIN of_flow ON contains(text, mark) WHERE NOT {EXCLUDED_PATH}),
got1 AS (SELECT ordinal AS file, category FROM valid JOIN of_rule USING (rule_id) UNION FROM others), got0 AS (SELECT ordinal AS file, category FROM matches JOIN of_rule USING (rule_id) UNION FROM others),
""" + ", ".join(f"""v{k} AS (SELECT w.file, want AS category, CASE WHEN g.file IS NULL THEN 'FN' ELSE 'TP' END AS verdict FROM want w LEFT JOIN got{k} g ON g.file = w.file AND g.category = want WHERE want IS NOT NULL
  UNION ALL SELECT g.file, g.category, 'FP' FROM got{k} g JOIN want w ON w.file = g.file WHERE want IS NULL),
c{k} AS (SELECT coalesce(category, 'all') AS category, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'FN') AS fn FROM v{k} GROUP BY GROUPING SETS ((category), ())),
s{k} AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS f1 FROM c{k})""" for k in (0, 1))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    x = code_lines(spark, d).select("ordinal", "file_path", "text")
    return judged(labels(x), found(x))


def _change(spark: SparkSession, d: str) -> DataFrame:
    v = _verdicts(spark, d)
    return change(scores(of(v, "before")), scores(of(v, "after")))


register("j9_ground_truth", lambda s, d: of(_verdicts(s, d), "after"), f"{_EVAL} SELECT * FROM v1")
register("a14_precision_recall", lambda s, d: scores(of(_verdicts(s, d), "after")), f"{_EVAL} SELECT * FROM s1")
register("a15_before_after", _change, f"""{_EVAL} SELECT category, {', '.join(f'coalesce(a.{n}, 0) - coalesce(b.{n}, 0) AS {n}' for n in ('tp', 'fp', 'fn', 'precision', 'recall', 'f1'))} FROM s1 a FULL JOIN s0 b USING (category)""")
# of the names that reports hold, tests, data and what has test_ in it are aside; demos and scripts' names aren't
register("a16_noise_counts", lambda s, d: noise_counts(parsed(s.read.parquet(f"{d}/orders.parquet"), _BAN, readers.BANDIT)), f"""WITH r AS (SELECT ['B101', 'B311', 'B602'][(o_orderkey % 3)::INT + 1] AS rule, {_PATH} AS name FROM orders), f AS (SELECT rule, contains(name, '/tests/') OR contains(name, '/data/') AS aside FROM r)
SELECT count(*) AS findings, count(*) FILTER (rule = 'B101') AS asserts, count(*) FILTER (rule = 'B101' AND aside) AS asserts_aside, count(*) FILTER (rule = 'B101' AND NOT aside) AS asserts_kept, count(*) FILTER (rule = 'B311') AS other_noise,
  count(*) FILTER (NOT (rule = 'B311' AND aside)) AS kept_before, count(*) FILTER (NOT (rule IN ('B101', 'B311') AND aside)) AS kept_after, count(*) FILTER (rule = 'B101' AND aside) AS fewer FROM f""")

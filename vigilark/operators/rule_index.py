"""Rules as rows: texts meet patterns through the literals that a match must hold.

From each pattern a cover is read off: literals of which any match holds at least one. All covers make one automaton,
which a task builds once and runs over a text in one pass; only the rules whose literals it meets, and those without a
cover, are tried on the text. The plan is the same for ten rules as for ten thousand.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

LEAST = 3
#: Rules that one automaton holds; their rows go to every task, so more rules take more passes over the texts.
RULES_AT_ONCE = 50_000
#: Characters beyond ASCII that a pattern without regard to case takes for a Latin letter.
_ODD = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def folded(text: str) -> str:
    return text.translate(_ODD).lower()


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The cover whose shortest literal is longer; of equals the smaller."""
    rank = lambda c: (min(map(len, c)), -len(c)) if c else (0, 0)
    return a if rank(a) >= rank(b) else b


def _cover(parsed) -> list[str] | None:
    best, run = None, ""
    for kind, value in parsed:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # no width, so what stands around it is adjacent
        best, run, inner = _better(best, [run] if run else None), "", None
        if kind is op.SUBPATTERN:
            inner = _cover(value[3])
        elif kind is op.ATOMIC_GROUP:
            inner = _cover(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _cover(value[2])
        elif kind is op.BRANCH:
            parts = [_cover(b) for b in value[1]]
            inner = sorted({x for p in parts for x in p}) if all(parts) else None
        best = _better(best, inner)
    return _better(best, [run] if run else None)


def cover(pattern: str) -> list[str]:
    """Literals, folded and of LEAST characters at least, of which any match of the pattern holds one; none if there are none."""
    found = _cover(parser.parse(pattern, re.IGNORECASE))
    return found if found and min(map(len, found)) >= LEAST else []


def java_pattern(pattern: str) -> str:
    """A pattern as Java writes it, matching without regard to case, the Unicode way."""
    return "(?iudU)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (pattern and others) with what Java reads of each pattern, `java`; those that either side can't read are left out."""
    at = rules.columns.index("pattern")

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(at).to_pylist():
                try:
                    parser.parse(p, re.IGNORECASE)
                    out.append(java_pattern(p))
                except Exception:  # noqa: BLE001  any reason not to read it leaves the rule out
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "java"])

    read = rules.mapInArrow(run, T.StructType([*rules.schema.fields, T.StructField("java", T.StringType())]))
    return read.where(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("java")).isNotNull())


def placed(text: Column, pattern: Column) -> Column:
    """The line, from 1, of each match of a pattern in a text, in order: one more than the line feeds before it."""
    feeds = lambda xs: F.transform(xs, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces, inside = feeds(F.split(text, pattern)), feeds(found)
    return F.transform(found, lambda _, k: 1 + total(F.slice(pieces, F.lit(1), k + 1)) + total(F.slice(inside, F.lit(1), k)))


def candidates(texts: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """texts (text and others) with rule_no, a row for each of the rules (rule_no, pattern) that may match it."""
    covers = [(no, cover(p)) for no, p in rules]
    always = [no for no, c in covers if not c]
    posted: dict[str, list[int]] = {}
    for no, c in covers:
        for x in c:
            posted.setdefault(x, []).append(no)
    held = texts.sparkSession.sparkContext.broadcast((posted, always))  # at most RULES_AT_ONCE rules
    at = texts.columns.index("text")

    def run(batches):
        posted, always = held.value
        automaton = ahocorasick.Automaton()
        for x, numbers in posted.items():
            automaton.add_word(x, (x, numbers))
        automaton.make_automaton()
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                met = {}
                if text and posted:
                    met = dict(v for _, v in automaton.iter(folded(text)))
                out.append(sorted({no for numbers in met.values() for no in numbers}) + always if text is not None else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "_rules"])

    schema = T.StructType([*texts.schema.fields, T.StructField("_rules", T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(run, schema).select(*texts.columns, F.explode("_rules").alias("rule_no"))


def rule_matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts (text and others) to a row for each rule of rules (rule_no, rule_id, severity, pattern) that matches: with `at`, the lines of its matches.

    A rule whose pattern isn't one is left out. Rules are brought to the driver, which reads their covers.
    """
    spark = texts.sparkSession
    rows = compiled(rules.select("rule_no", "rule_id", "severity", "pattern")).orderBy("rule_no").collect()
    kind = "rule_no int, rule_id string, severity string, _pattern string"
    out = None
    for k in range(0, max(1, len(rows)), RULES_AT_ONCE):
        part = rows[k : k + RULES_AT_ONCE]
        table = spark.createDataFrame([(int(r["rule_no"]), r["rule_id"], r["severity"], r["java"]) for r in part], kind)
        found = candidates(texts, [(int(r["rule_no"]), r["pattern"]) for r in part]).join(F.broadcast(table), "rule_no")  # as many rows as an automaton holds
        found = found.withColumn("at", placed(F.col("text"), F.col("_pattern"))).where(F.size("at") > 0).drop("_pattern")
        out = found if out is None else out.unionByName(found)
    return out.select(*texts.columns, "rule_no", "rule_id", "severity", "at")


def rule_counts(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, lines, n): of each rule that matches any of lines (text and others) how many it matches, and its matches in them.

    Rules meet each distinct text once, however many lines read alike.
    """
    spread = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = stored(lines.groupBy("text").agg(F.count(F.lit(1)).alias("_c")).repartition(spread), "texts")  # read by each pass
    found = rule_matches(texts, rules)
    return found.groupBy("rule_id").agg(F.sum("_c").alias("lines"), F.sum(F.col("_c") * F.size("at")).alias("n"))


def file_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (file_path, text, ...) to one row a match: rule_no, rule_id, severity, nth, line_no, text (the line)."""
    x = rule_matches(files, rules).withColumn("_lines", F.split("text", LINE_END))
    x = x.select("*", F.posexplode("at").alias("_n", "line_no"))
    return x.select(*[c for c in files.columns if c != "text"], "rule_no", "rule_id", "severity", (F.col("_n") + 1).alias("nth"), "line_no", F.trim(F.coalesce(F.get("_lines", F.col("line_no") - 1), F.lit(""))).alias("text"))

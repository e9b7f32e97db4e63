"""Proposed fixes and answers as texts: what is before and after, how much changes, why one is turned down, the JSON inside."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..registry import register
from ..sources.fixtures import read

# fixed values: words of one language that don't belong in a file of another, levels of confidence, the largest change
NOT_PYTHON = ("const ", "let ", "=>", "function(")
NOT_SCRIPT = ("def ", "import os", "raise runtimeerror", "except exception")
CERTAIN, UNSURE = ("high", "h", "0.9", "1", "1.0"), ("low", "l", "0.1", "0", "0.0")
MOST_CHANGED = 10


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def before_after(text: Column) -> tuple[Column, Column]:
    """The parts of a text after "before" and after "after"; empty where missing."""
    text = F.coalesce(text, F.lit(""))
    part = lambda p: _strip(F.regexp_extract(text, p, 1))
    return part(r"(?iuU)before\s*[:\-]\s*((?s:.*?))(?:after\s*[:\-]|\z)"), part(r"(?iuU)after\s*[:\-]\s*((?s:.*?))(?:notes\s*[:\-]|\z)")


@F.pandas_udf(IntegerType())
def changed_lines(before: pd.Series, after: pd.Series) -> pd.Series:
    """Lines that a unified diff adds or takes away, but for those that read like its own headers."""

    def count(a: str | None, b: str | None) -> int:
        diff = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")
        return sum(x[:1] in "+-" and x[:3] not in ("+++", "---") for x in diff)

    return pd.Series([count(a, b) for a, b in zip(before, after)], dtype="int32")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def confidence_level(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*CERTAIN), "High").when(low.isin(*UNSURE), "Low").otherwise("Medium")


def turned_down(confidence: Column, fix: Column, file: Column) -> Column:
    """Why a proposed fix isn't shown; null where it is."""
    before, after = before_after(fix)
    path, code = F.lower(F.coalesce(file, F.lit(""))), F.lower(after)
    foreign = (F.endswith(path, F.lit(".py")) & _any(code, NOT_PYTHON)) | (F.rlike(path, F.lit(r"\.[jt]sx?\z")) & _any(code, NOT_SCRIPT))
    return (
        F.when(confidence_level(confidence) == "Low", "low-confidence")
        .when((before == "") | (after == ""), "invalid-fix-format")
        .when(foreign, "language-mismatch")
        .when(changed_lines(before, after) > MOST_CHANGED, "rewrite-too-large")
    )


def json_object(text: Column) -> Column:
    """The JSON object that a text is, fences, or holds from its first brace to its last; null without one.

    A text that is JSON of another kind holds none. An object that names a key twice counts as no JSON.
    """
    text = _strip(F.coalesce(text, F.lit("")))
    # a parser stops after the first value; as the one element of a list a text must be that value
    whole = lambda x: F.when(F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1, F.to_json(F.try_parse_json(x)))
    fenced = F.regexp_extract(text, r"(?i)```(?:json)?\s*(\{(?s:.*?)\})\s*```", 1)
    braced = F.regexp_extract(text, r"(\{(?s:.*)\})", 1)
    found = F.coalesce(whole(text), whole(fenced), whole(braced))
    return F.when(F.startswith(found, F.lit("{")), found)


_LONG = "\n".join(f"x{k}" for k in range(6))
# confidence, file, fix, and what is told of it
_CASES = [
    ("high", "a.py", "Before: a\nAfter: b\nNotes: c", "a", "b", 2, None),
    (" LOW ", "a.py", "before: a after: b", "a", "b", 2, "low-confidence"),
    ("0.1", "a.py", "", "", "", 0, "low-confidence"),
    ("", "a.py", "after - x", "", "x", 1, "invalid-fix-format"),
    ("h", "a.py", "Before: a\nAfter: const b = 1", "a", "const b = 1", 2, "language-mismatch"),
    ("1", "a.TSX", "Before: a\nAfter:\n  DEF f(): pass  \n", "a", "DEF f(): pass", 2, "language-mismatch"),
    ("?", "a.go", "Before: a\nAfter: const b", "a", "const b", 2, None),
    ("?", "a.js", f"Before: {_LONG}\nAfter: {_LONG.replace('x', 'y')}", _LONG, _LONG.replace("x", "y"), 12, "rewrite-too-large"),
    ("?", "a.js", f"Before: {_LONG}\nAfter: {_LONG}\nmore", _LONG, _LONG + "\nmore", 1, None),
    ("?", "a.js", "Before: --a\nAfter: ++a", "--a", "++a", 0, None),
    ("?", "a.js", "before - a\nBEFORE: b\nafter : c", "a\nBEFORE: b", "c", 3, None),
]
_ANSWERS = [
    ('{"k": 1}', '{"k":1}'), ('  [{"k": 1}]', None), ('Here:\n```json\n{"k": {"n": "}"}}\n```\nand {x}', '{"k":{"n":"}"}}'), ('so {"k": "v"} it is', '{"k":"v"}'), ('{"k": 1} {"k": 2}', None),
    ("{k: 1}", None), ("", None), ('"text with {\\"k\\": 1}"', None), ('a } b { c', None), ('```\n{"k": 2}\n``` {', '{"k":2}'), ('null', None),
]


def _numbered(s: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every order with one of the rows, by its number."""
    cases = s.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, " + schema)
    return read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % len(rows)).alias("k")).join(F.broadcast(cases), "k")  # a fixed table


_sql = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "replace('" + v.replace("'", "''").replace("\n", "¶") + "', '¶', chr(10))"
_told = lambda rows: ", ".join("(" + ", ".join(map(_sql, (k, *r))) + ")" for k, r in enumerate(rows))


def _proposed(s: SparkSession, d: str) -> DataFrame:
    x = _numbered(s, d, [c[:3] for c in _CASES], "confidence string, file string, fix string")
    before, after = before_after(F.col("fix"))
    return x.select("o_orderkey", before.alias("before"), after.alias("after"), changed_lines(before, after).alias("changed"), turned_down(F.col("confidence"), F.col("fix"), F.col("file")).alias("reason"))


register("c22_before_after", _proposed, f"WITH t(k, before, after, changed, reason) AS (VALUES {_told([c[3:] for c in _CASES])}) SELECT o_orderkey, before, after, changed, reason FROM orders JOIN t ON k = o_orderkey % {len(_CASES)}")
register("c24_json_from_text", lambda s, d: _numbered(s, d, [a[:1] for a in _ANSWERS], "answer string").select("o_orderkey", json_object(F.col("answer")).alias("found")), f"WITH t(k, found) AS (VALUES {_told([a[1:] for a in _ANSWERS])}) SELECT o_orderkey, found FROM orders JOIN t ON k = o_orderkey % {len(_ANSWERS)}")
register(
    "c24_json_from_events",
    lambda s, d: read(s, d, "events").select("event_id", F.get_json_object(json_object(F.concat(F.lit("note: "), "props", F.lit(" end"))), "$.k").alias("k")),
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)

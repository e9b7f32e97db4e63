"""Column expressions as SQL text that Spark and the oracle engine read alike, and pattern helpers.

Absent values count as empty strings throughout: every expression coalesces before it compares.
"""

from __future__ import annotations

from collections.abc import Iterable


def lit(value: str) -> str:
    """A string literal without escapes; quotes are spliced in by code."""
    return "(" + " || chr(39) || ".join(f"'{x}'" for x in value.split("'")) + ")" if "'" in value else f"'{value}'"


def has(col: str, tokens: Iterable[str]) -> str:
    """Some token is a substring of col."""
    return "(" + " OR ".join(f"contains({col}, {lit(t)})" for t in tokens) + ")"


def among(col: str, values: Iterable[str]) -> str:
    return f"{col} IN (" + ", ".join(lit(v) for v in values) + ")"


def cases(branches: Iterable[tuple[str, str]], default: str) -> str:
    """First condition that holds gives the value; values are SQL text."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


def begins(col: str, prefix: str) -> str:
    return f"left({col}, {len(prefix)}) = {lit(prefix)}"


def ends(col: str, suffixes: Iterable[str]) -> str:
    return "(" + " OR ".join(f"right({col}, {len(s)}) = {lit(s)}" for s in suffixes) + ")"


def blob(*cols: str) -> str:
    """The lower-cased join of the parts that aren't empty."""
    return "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in cols) + "))"


def py_pattern(pattern: str) -> str:
    """A pattern that Java matches as a case-insensitive, Unicode-aware one: white space, dot and case alike."""
    return "(?iudU)" + pattern


def segment_in(path: str, names: Iterable[str]) -> str:
    """Some segment of a path is one of the names: separators on both sides make it a substring test."""
    return has(f"('/' || lower({path}) || '/')", [f"/{n}/" for n in names])

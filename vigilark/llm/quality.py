"""Quality rules as a short-circuit cascade.

Each rule says whether a text is rejected. On a bounded sample the cascade measures what a rule costs and how
many texts it rejects, and then applies the rules in the order of rejections per cost; a text leaves at the
first rule that rejects it, so the expensive rules see what the cheap ones let pass. The order changes the
work only: a text is kept exactly if no rule rejects it.

Words are runs of anything but the six ASCII white-space characters, which is what bytes.split() cuts at.

Defined cases: a null text counts as empty, has no words and is rejected; very long texts are read whole;
repeated rows are judged alike; an empty table gives an empty result; columns of the input pass unchanged.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Rows that the cost and selectivity of the rules are estimated on, at most about this many.
SAMPLE_ROWS = 2000
#: Of a table in more files than these, the sample is drawn from about so many, picked by a hash; the others aren't read.
SAMPLE_FILES = 64
SLICE_ROWS = 256

_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(rb"[A-Z]")
_LETTER = re.compile(rb"[A-Za-z]")


class Text:
    """A text and what the rules ask of it, each computed once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.split(None, 1)]

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Positions that lie in some WINDOW-word window which the text holds twice or more."""
        n = self.n_words
        if n <= WINDOW:
            return 0
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        v = len(ids)
        if v ** WINDOW < 2**63:
            key = at[: n - WINDOW + 1].copy()
            for k in range(1, WINDOW):
                key = key * v + at[k : n - WINDOW + 1 + k]
        else:  # ranks of pairs, of fours, then of fives
            rank = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)
            two = rank(at[:-1], at[1:])
            four = rank(two[:-2], two[2:])
            key = rank(four[:-1], at[4:])
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        starts = np.flatnonzero(twice)
        if not len(starts):
            return 0
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge[:n]) > 0).sum())

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def _shouting(t: Text) -> bool:
    letters = len(_LETTER.findall(t.data))
    return letters >= 20 and 10 * len(_UPPER.findall(t.data)) > 4 * letters


#: Rules by name; each says whether the text is rejected.
RULES: dict[str, Callable[[Text], bool]] = {
    "too_few_words": lambda t: t.n_words < MIN_WORDS,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "duplicate_lines": lambda t: len(t.lines) >= 5 and 2 * t.n_dup_lines > len(t.lines),
    "stutter": lambda t: 10 * sum(map(eq, t.words, t.words[1:])) > 3 * t.n_words,
    "word_length": lambda t: t.n_words > 0 and not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "shouting": _shouting,
}


def _texts(column) -> Iterator[str | None]:
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The texts of about rows random rows."""
    files = len(docs.inputFiles())
    if files > SAMPLE_FILES:
        try:
            docs = docs.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(files // SAMPLE_FILES + 1)) == 0)
        except AnalysisException:
            pass  # rows that don't come straight from files are drawn from all
    fraction = min(1.0, rows / max(1, docs.count()))
    return docs.select("text") if fraction == 1 else docs.select("text").sample(False, fraction, 7)


def plan_cascade(docs: DataFrame, rules=None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, most rejections per second first, as measured on a sample of about sample_rows rows."""
    rules = rules or RULES
    names = list(rules)

    def measure(batches):
        for b in batches:
            spent, rejected, n = dict.fromkeys(names, 0), dict.fromkeys(names, 0), 0
            for text in _texts(b.column(0)):
                n += 1
                for name in names:
                    t = Text(text)
                    began = time.process_time_ns()
                    rejected[name] += bool(rules[name](t))
                    spent[name] += time.process_time_ns() - began
            yield pa.RecordBatch.from_pydict({"rule": names, "spent": [spent[x] for x in names], "rejected": [rejected[x] for x in names], "n": [n] * len(names)})

    seen = sample_texts(docs, sample_rows).mapInArrow(measure, "rule string, spent long, rejected long, n long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"))
    rate = {r["rule"]: r["rejected"] / max(1, r["spent"]) for r in seen.collect()}  # one row a rule
    return sorted(names, key=lambda x: (-rate.get(x, 0.0), names.index(x)))


def _first_rejection(t: Text, order: list[str], rules) -> str | None:
    return next((name for name in order if rules[name](t)), None)


def keep_good(docs: DataFrame, rules=None, order: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns as they are."""
    rules = rules or RULES
    order = order or plan_cascade(docs, rules)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            good = pa.array([_first_rejection(Text(x), order, rules) is None for x in _texts(b.column(at))], pa.bool_())
            yield b.filter(good)

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, rules=None, order: list[str] | None = None) -> DataFrame:
    """doc_id with the base counts, base_failed and kept, for each row of docs."""
    rules = rules or RULES
    order = order or plan_cascade(docs, rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in (*counts, "base_failed", "kept")}
            for text in _texts(b.column(1)):
                t = Text(text)
                for k in counts:
                    out[k].append(getattr(t, k))
                out["base_failed"].append(t.base_failed)
                out["kept"].append(not t.base_failed and _first_rejection(t, order, rules) is None)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[k], pa.int64()) for k in counts], pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_())], ["doc_id", *counts, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT rid, p, ws[p:p + 4] AS g FROM p),
c AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM c) GROUP BY 1),
b AS (SELECT w.rid, doc_id, text, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters
      FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines) OR 10 * n_stutter > 3 * n_words
       OR (n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)) OR (n_letters >= 20 AND 10 * n_upper > 4 * n_letters)) AS kept
FROM f
"""

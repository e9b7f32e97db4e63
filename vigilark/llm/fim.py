"""Fill-in-middle transformation over a sparse checkpoint index.

A text is cut at two borders of its units (lines, words or code points) into prefix, middle and suffix, which are put
out in another order behind sentinels, so that a model learns to fill a gap. One walk counts the units and records,
every EVERY of them, the byte and the code-point offset: the checkpoints. A cut is found by binary search among
them and a rescan of fewer than EVERY units, so no list of all units is ever made and a text of any length costs one
walk and its checkpoints.

The cuts and the form follow from a hash of the seed and the id, so reruns agree. A text that is empty or holds a
sentinel stays plain; the others are read back exactly (restored).

Defined cases: a null text counts as empty and is put out as an empty text; a null doc_id hashes as an empty one;
rows that share an id share the hash and are cut each by its own units; very long texts are cut whole; an empty
table gives an empty result; other columns are kept, but those that bear a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units as patterns over UTF-8; one after another they cover any text.
UNITS = {
    "line": rb"(?:[^\n]*+\n|[^\n]++)",
    "word": rb"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)",
    "char": rb"(?:[\x00-\x7F\xC0-\xFF][\x80-\xBF]*+)",
}
EVERY = 64
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100
SPM_SHARE = 50
SLICE_ROWS = 64
_INSIDE = bytes(range(0x80, 0xC0))
RESULT = ("fim_text", "fim_form", "n_units", "prefix_chars", "middle_chars")


@lru_cache(maxsize=1024)
def _run(unit: str, n: int) -> re.Pattern:
    return re.compile(UNITS[unit] + b"{%d}+" % n)


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.translate(None, _INSIDE))


class Checkpoints:
    """The units of a text counted in one walk, with the offsets of every `every`-th."""

    def __init__(self, data: bytes, unit: str = "line", every: int = EVERY):
        self.data, self.unit = data, unit
        self.units, self.bytes, self.chars = [0], [0], [0]
        hop = _run(unit, every)
        at = chars = 0
        while found := hop.match(data, at):
            chars += code_points(data[at : found.end()])
            at = found.end()
            self.units.append(self.units[-1] + every)
            self.bytes.append(at)
            self.chars.append(chars)
        self.n = self.units[-1] + sum(1 for _ in _run(unit, 1).finditer(data, at))

    def offset(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the border before a unit: the nearest checkpoint and a rescan from there."""
        k = bisect_right(self.units, unit) - 1
        at, chars = self.bytes[k], self.chars[k]
        if left := unit - self.units[k]:
            end = _run(self.unit, left).match(self.data, at).end()
            at, chars = end, chars + code_points(self.data[at:end])
        return at, chars


def _draws(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _check(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The sentinels as bytes, if a text free of them can't make up another together with its neighbours."""
    if len(set(sentinels)) < 3 or any(x in y for x in sentinels for y in sentinels if x != y) or "" in sentinels:
        raise ValueError("sentinels must differ, be non-empty and not hold each other")
    if any(x.endswith(y[:k]) for x in sentinels for y in sentinels for k in range(1, min(len(x), len(y)) + (x != y))):
        raise ValueError("no sentinel may end the way that one begins")
    return [x.encode() for x in sentinels]


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS, every: int = EVERY) -> DataFrame:
    """docs (doc_id, text and others) with fim_text, fim_form (plain, psm or spm), n_units, prefix_chars and middle_chars.

    rate is the percentage of texts that are transformed, spm_share that of suffix-first ones among them.
    """
    p, s, m = _check(sentinels)
    kept = [c for c in docs.columns if c not in RESULT]
    # tasks know columns by place, as names may hold anything
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    id_at, text_at = kept.index("doc_id"), kept.index("text")

    def transformed(doc_id, data: bytes) -> tuple:
        marks = Checkpoints(data, unit, every)
        h = _draws(seed, doc_id)
        if not data or any(x in data for x in (p, s, m)) or h[2] % 100 >= rate:
            return data, "plain", marks.n, None, None
        (a, a_chars), (b, b_chars) = map(marks.offset, sorted((h[0] % (marks.n + 1), h[1] % (marks.n + 1))))
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        spm = h[3] % 100 < spm_share
        out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
        return out, "spm" if spm else "psm", marks.n, a_chars, b_chars - a_chars

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                texts = b.column(text_at).cast(pa.binary()).to_pylist()
                out = list(zip(*(transformed(i, t or b"") for i, t in zip(b.column(id_at).to_pylist(), texts))))
                made = [pa.array(out[0], pa.binary()).cast(pa.string(), safe=False), pa.array(out[1], pa.string()), *[pa.array(x, pa.int64()) for x in out[2:]]]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *RESULT])

    kinds = (T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.LongType())
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in zip(RESULT, kinds))])).toDF(*kept, *RESULT)


def restored(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a transformed one was made of."""
    p, s, m = sentinels

    def parts(first: str, then: str) -> tuple[Column, Column, Column]:
        body = F.substring(text, F.lit(len(first) + 1), F.length(text))
        one = F.substring_index(body, then, 1)
        rest = F.substring(body, F.length(one) + len(then) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    late_suffix, late_prefix, late_middle = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(text)


def op12(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", F.col("n_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"), digest(restored(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls,
        [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS r FROM d),
c AS (SELECT *, len(ls)::BIGINT AS n, least(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS a, greatest(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""

"""Exact-substring deduplication and its suffix sorting against brute force and odd inputs."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vigilark.llm import substrings


def brute(rows, length=50):
    """(doc_id, bytes, removed ranges) by a table of all strings."""
    first = {}
    big = 1 << 70
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, x in data:
        for k in range(len(x) - length + 1):
            s = x[k : k + length]
            first[s] = min(first.get(s, big), i)
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if first[x[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans, k = [], 0
        while k < len(x):
            z = k
            while z < len(x) and gone[z]:
                z += 1
            if z > k:
                spans.append((k, z))
            k = max(z, k) + 1
        out.append((None if i == big else i, len(x), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"word{k}" for k in range(40)] + ["Über", "漢字", "😀", "=", "a"]
    passages = [" ".join(rnd.choice(vocab) for _ in range(k)) for k in (8, 9, 12, 40, 200)] + ["=" * 400, "ab" * 150, "x" * 49, "y" * 50, "é" * 80]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(max(1, len(p) // 2))
            parts.append(p[a:] if rnd.random() < 0.5 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30))))
        rows.append((k * 7 % 101 if k % 10 else k, rnd.choice(["", " ", "\n"]).join(parts)))
    copy = rows[5][1] + passages[4]
    return rows + [(500 + k, copy) for k in range(20)] + [(900, None), (901, ""), (None, copy), (None, passages[4]), (902, copy), (902, copy), (903, "lone " * 3)]


@pytest.mark.parametrize(("hot", "parts", "chunk", "batch"), [(20_000, 3, 4_000_000, 4_000_000), (1, 7, 3_000, 300), (2, 1, 500, 1)])
def test_equals_brute_force(spark, hot, parts, chunk, batch):
    rows = corpus(chunk)
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, chunk string, kept binary").repartition(parts)
    got = told(substrings.without_repeats(docs, hot=hot, chunk_bytes=chunk, batch_bytes=batch))
    assert got == brute(rows)


@pytest.mark.parametrize("length", [8, 20, 63])
def test_other_lengths(spark, length):
    rows = corpus(length, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert told(substrings.without_repeats(docs, length=length, hot=3)) == brute(rows, length)


def test_query_and_empty_tables(spark):
    rows = corpus(9, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i, n, sum(z - a for a, z in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)), key=str)
    assert sorted(map(tuple, substrings.op13(docs).collect()), key=str) == want
    assert substrings.op13(docs.limit(0)).count() == 0
    assert [r.n_removed for r in substrings.op13(docs.where("doc_id in (900, 901)")).collect()] == [0, 0]


def test_sql_agrees(spark):
    rows = [r for r in corpus(12, 50) if r[0] is not None]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    df = substrings.op13(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({substrings.OP13_SQL})").fetchall())


def test_long_texts(spark):
    base = "".join(random.Random(3).choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, base), (2, "new " + base[1000:500_000] + "z" * 300_000), (3, "z" * 1_000_000)]
    got = {r.doc_id: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].spans and [tuple(s) for s in got[3].spans] == [(0, 1_000_000)]
    assert [tuple(s) for s in got[2].spans] == [(4, 499_004)]


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order_and_prefixes(seed):
    rnd = np.random.default_rng(seed)
    pieces = [bytes(rnd.integers(1, [3, 3, 5, 200, 2, 250][seed], rnd.integers(0, 90)).astype(np.uint8)) for _ in range(40)]
    text = b"\0".join([*pieces, b"\1" * 300, b"\2\1" * 40, *pieces[:20]]) + b"\0"
    symbols = np.frombuffer(text, np.uint8)
    for depth in (1, 8, 13, 50):
        keys = substrings.eight(symbols, depth)
        room = np.array([text.index(b"\0", k) - k for k in range(len(text))])
        wanted = (room >= depth) & (np.arange(len(text)) % 3 != 1)
        order = substrings.two_stage(symbols, wanted, depth)
        prefix = [text[k : k + depth] for k in order]
        assert sorted(order) == list(np.flatnonzero(wanted)) and prefix == sorted(prefix)
        shared = substrings.common_prefixes(order, keys, depth)
        assert all(n == next((j for j in range(depth) if a[j] != b[j]), depth) for n, a, b in zip(shared[1:], prefix, prefix[1:]))


def test_earlier_marks_windows_of_smaller_owners():
    texts = [b"abcdefgh", b"xbcdefgh", b"abcdefgh", b"abc"]
    got = substrings.earlier(texts, np.array([3, 5, 9, 1]), 4)
    assert [f"{int(x):05b}" for x in got] == ["00000", "11110", "11111", "00000"]

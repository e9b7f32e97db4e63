"""Importance resampling and fill-in-middle against brute force, SQL and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilark.llm import fim, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \t\n", "Ünïcode, WÖRD x\x85y 漢字", "a-b_c'd 1e5", "x" * 30_000, "alpha beta " * 20_000]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text, max_n):
    ws = WORD.findall(lower(text))
    return [" ".join(ws[k : k + n]) for n in range(1, max_n + 1) for k in range(len(ws) - n + 1)], len(ws)


def brute_resample(docs, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, max_n)[0])
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for doc_id, text in docs:
        fs, n = features(text, max_n)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    place = {}
    for k, r in enumerate(order[: len(order) * percent // 100]):
        place.setdefault(r, []).append(k + 1)
    return sorted(((*r, place[r].pop() if place.get(r) else None) for r in rows), key=str)


def texts(n, seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Über", "ÉTÉ", "x9"]
    return [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("max_n", [1, 3])
def test_resample_equals_brute_force(spark, max_n):
    docs = [*texts(400, 1), *[(400 + k, x) for k, x in enumerate(ODD)], (None, "alpha beta " * 30), (3, "again"), (3, "again")]
    target = [x for _, x in texts(30, 2)] + [None, ""]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, weight string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.ranked(resample.weigh(d, t, max_n), percent=25)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target, max_n, percent=25)


def test_resample_keeps_rows_and_takes_odd_tables(spark):
    docs = texts(200, 3)
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, score string, _above int")
    t = spark.createDataFrame([(x,) for _, x in texts(5, 4)], "text string")
    want = {r[0] for r in brute_resample(docs, [x for _, x in texts(5, 4)]) if r[-1]}
    got = resample.resample(d, t).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) and got[0].asDict().keys() == {"doc_id", "text", "score", "_above"}
    assert resample.op11(d.limit(0), t).count() == 0
    none = resample.op11(d, t.limit(0)).collect()
    assert len(none) == 200 and sum(r["rank"] is not None for r in none) == sum(len(WORD.findall(x)) >= 20 for _, x in docs) // 10


def test_suffix_array_enumerates_repeated_runs():
    rnd = np.random.default_rng(5)
    ids = rnd.integers(0, 4, 300).astype(np.int32)
    cuts = [40, 41, 200, 299]
    ids[cuts] = 4 + np.arange(4)
    order, shared = resample.suffix_array(ids, 3, 4)
    key = lambda p: tuple(ids[p : p + 3])
    assert [key(p) for p in order] == sorted(key(p) for p in range(300))
    for k in range(1, 300):
        same = 0
        for a, b in zip(key(order[k - 1]), key(order[k])):
            if a != b or a >= 4:
                break
            same += 1
        assert shared[k] == same


UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "char": r"(?s:.)"}


def brute_fim(doc_id, text, unit="line", seed=7):
    us = re.findall(UNIT[unit], text or "")
    assert "".join(us) == (text or "")
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return text or "", "plain", len(us), None, None
    a, b = sorted((h1 % (len(us) + 1), h2 % (len(us) + 1)))
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    spm = h4 % 100 < 50
    return f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", "spm" if spm else "psm", len(us), len(p), len(m)


def fim_rows():
    rnd = random.Random(6)
    rows = [(k, "".join(rnd.choice(["\n", "\n", "a b ", "Ünï", "漢字😀", "\r", "\x85", "<", "P>"]) for _ in range(rnd.randint(0, 900)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "no newline"), (204, "a\n<M>\n"), (None, "x\ny\nz"), (205, "long\n" * 50_000 + "end"), (206, "y" * 300_000), (207, "same\n"), (207, "same\n")]
    return rows


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_fill_in_middle_equals_brute_force(spark, unit):
    rows = fim_rows()
    docs = spark.createDataFrame([(i, t, 1, "e", 2) for i, t in rows], "doc_id long, text string, n_units int, extra string, `a.b` int")
    got = fim.fill_in_middle(docs, unit).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form"))).collect()
    assert sorted(((r.doc_id, r.text, *(r[c] for c in fim.RESULT)) for r in got), key=str) == sorted(((i, t, *brute_fim(i, t, unit)) for i, t in rows), key=str)
    assert all(r.back == (r.text or "") and r.extra == "e" and r["a.b"] == 2 for r in got)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_checkpoints_at_every_distance():
    data = ("é\n" * 30 + "z").encode()
    for every in (1, 2, 7, 31, 100):
        c = fim.Checkpoints(data, "line", every)
        assert c.n == 31 and [c.offset(k) for k in range(32)] == [(3 * k, 2 * k) for k in range(31)] + [(91, 61)]


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("<P>", "x<P>y", "<M>"), ("ab", "bc", "d"), ("", "b", "c"), ("aXa", "b", "c")])
def test_sentinels_that_could_be_misread(spark, bad):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([(1, "x")], "doc_id long, text string"), sentinels=bad)


def test_rates_and_empty_share(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\n") for k in range(400)], "doc_id long, text string")
    forms = Counter(r.fim_form for r in fim.fill_in_middle(docs, rate=50, spm_share=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260


@pytest.mark.parametrize("op", ["op11", "op12"])
def test_sql_agrees_on_odd_rows(spark, op):
    rows = [*fim_rows(), *[(400 + k, x) for k, x in enumerate(ODD)]]
    rows = [r for r in rows if r[0] is not None or op == "op12"]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    c.register("benchmark", pa.table({"item_id": [1], "text": ["alpha a b long"]}))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("alpha a b long",)], "text string")
    df, sql = (resample.op11(docs, bench), resample.OP11_SQL) if op == "op11" else (fim.op12(docs), fim.OP12_SQL)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=str)

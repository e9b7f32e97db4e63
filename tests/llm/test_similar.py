"""The near-duplicate stage against brute force over five-word similarity."""

import collections
import itertools
import random


def similarity(x, y):
    a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (x.lower().split(), y.lower().split()))
    return sum((a & b).values()) / sum((a | b).values())


def least(rows, linked):
    up = {k: k for k, _ in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for (i, x), (j, y) in itertools.combinations(rows, 2):
        if find(i) != find(j) and linked(x, y):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return {find(k) for k in up}


def test_near_dedup_links_what_is_similar(spark):
    import corpus_pipeline

    rnd = random.Random(21)
    vocab = [f"w{k}" for k in range(500)]
    rows = []
    for n in (4, 30, 60, 120, 240, 240):
        base = [rnd.choice(vocab) for _ in range(n)]
        for _ in range(12):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(n)] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), " ".join(["over"] * 60)), (len(rows) + 1, " ".join(["over"] * 90))]
    want = least(rows, lambda x, y: similarity(x, y) >= 0.8)
    assert len(want) < len(rows) - 20
    docs = spark.createDataFrame([(k, x, "s") for k, x in rows], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_similar_deals_out_large_components_and_takes_odd_rows(spark):
    from vigilark.llm import similar, simhash

    rnd = random.Random(22)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        text = list(base)
        text[rnd.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame([*rows, (60, None), (61, " \t"), (None, "a b"), (None, "a b"), (63, "A B"), (64, "a c")], "doc_id long, text string")
    for bounds in ({"block": 8}, {"block_members": 500}, {"block_members": 1}):
        kept = simhash.keep_one(docs, lambda d, keys: similar.similar(d, keys, **bounds))  # noqa: B023
        assert {r.doc_id for r in kept.collect()} == least(rows, lambda x, y: similarity(x, y) >= 0.8) | {60, 63, 64}
    assert simhash.keep_one(docs.limit(0), similar.similar).count() == 0


def test_the_fingerprint_index_proposes_what_no_band_does(spark):
    import numpy as np

    from vigilark.llm import similar

    of = spark.createDataFrame([(1, [11], 5, 0), (2, [12], 5, 0b1111), (3, [13], 5, 0b1111), (4, [14], 5, (1 << 40) - 1), (5, [11], 5, -1)], "sid long, bands array<long>, size long, fp long")
    assert {frozenset(r) for r in similar.candidates(of).collect()} == {frozenset(x) for x in ((1, 2), (2, 3), (1, 5))}
    text = [" ".join(f"w{k}" for k in range(n)) for n in (60, 61, 90)]
    fps = np.array([similar.fingerprint(x) for x in text], np.uint64)
    assert similar.forest([similar.members(x) for x in text], fps) == [(1, 0)]

"""Mixing, near-duplicates, decontamination, LM scores and the pipeline against brute force and odd inputs."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilark.llm import components, decontam, langid, mixing, ngram, quality, similar, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra="size string"):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + extra)


def fill(weights, sizes, ratio, most):
    """Targets by handing the budget out again and again."""
    left, out, free = ratio * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        level = left / sum(weights[k] for k in free)
        full = {k for k in free if most * sizes[k] <= level * weights[k] + 1e-9}
        if not full:
            for k in free:
                out[k] = level * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free -= full
    return out


def test_mix_targets_and_budgets(spark):
    rnd = random.Random(2)
    rows = [(k, "w " * rnd.randint(0, 60), rnd.choice(["a", "b", "c", "d", None]) if k % 3 else "hot", "x") for k in range(900)] + [(None, None, "e", "x"), (5, "again", "a", "x"), (5, "again", "a", "x")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s))
    sizes = [sum(r.size for r in by[s]) for s in order]
    want = fill([(3, 1, 2)[k % 3] for k in range(len(order))], sizes, 1.5, 2)
    for s, size, target in zip(order, sizes, want):
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 * (1 + target) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in by[s])
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, "", "z", "x"), (2, None, None, "x")])).collect()] == [0, 0]


@pytest.mark.parametrize("width", [3, 4])
def test_position_sets_cover_every_four(width):
    sets = [set(x) for x in simhash.position_sets(width)]
    assert all(any(s <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def plain_fingerprint(text):
    """Bit by bit, as the definition has it."""
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 40, 120]))]
        for _ in range(rnd.randint(1, 25)):
            text = [rnd.choice(vocab) if rnd.random() < 0.02 else w for w in base]
            rows.append((k, " ".join(text).upper() if k % 2 else "\n".join(text), "s", "x"))
            k += 1
    rows += [(k, None, "s", "x"), (k + 1, "", "s", "x"), (k + 2, " \t", "s", "x"), (k + 3, "long " * 50_000, "s", "x"), (k + 3, "long " * 50_000, "s", "x")]
    got = simhash.op3(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    ids = sorted(fps)
    want = brute_components(ids, [fps[i] for i in ids])
    assert {r.doc_id: r.component_id for r in got} == want
    for i, text, *_ in rows:
        assert fps[i] == plain_fingerprint(text)
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and kept[0].asDict().keys() == {"doc_id", "text", "source", "size"}
    nulls = simhash.op3(frame(spark, [(None, "a b c d", "s", "x"), (3, "a b c d", "s", "x"), (None, "other words here now then", "s", "x")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in nulls) == [("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.op3(frame(spark, [])).count() == 0


@pytest.mark.parametrize("width", [3, 4])
def test_hot_posting_lists_lose_no_link(spark, width):
    rnd = random.Random(8)
    centre = rnd.getrandbits(63)
    near = {centre}
    while len(near) < 300:  # a chain of near fingerprints, far beyond one block
        x = rnd.choice(sorted(near))
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(63)
        near.add(x)
    all_ = sorted(near | {rnd.getrandbits(63) for _ in range(200)})
    df = spark.createDataFrame([(x,) for x in all_], "fp long")
    comp = {r.node: r.root for r in components.components(simhash.links(df, width, block=16)).collect()}
    got = collections.defaultdict(set)
    for x in all_:
        got[comp.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, r in brute_components(all_, all_).items():
        want[r].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[1000 + k] for k in range(300)} == {1000} and 5000 not in got


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(6)
    w = lambda n: [f"é{rnd.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(w([3, 6, 20, 40, 60, 1][k % 6]))) for k in range(24)] + [(None, " ".join(w(20))), (90, None), (91, ""), (92, "v1 v1 v1 v1 v1 v1 v1 v1"), (93, "v1 v1 v1 v1 v1 v1 v1 v1")]
    rows = []
    for k in range(120):
        body = w(80)
        if k % 2:
            item = (items[k % 25][1]).split()
            if k % 4 == 1 and len(item) > 30:
                item[rnd.randrange(len(item))] = "CHANGED"
            if k % 8 == 3:
                item = item[: len(item) // 2]
            at = rnd.randrange(len(body))
            body[at:at] = item
        rows.append((k, "\n ".join(body).upper(), "s", "x"))
    rows += [(500, None, "s", "x"), (501, "", "s", "x"), (502, "v1 " * 30_000, "s", "x"), (503, items[2][1], "s", "x"), (503, items[2][1], "s", "x"), (None, items[3][1] + " tail", "s", "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.op4(frame(spark, rows), bench).collect()}

    def shingles(ws):
        return collections.Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else collections.Counter()

    want = {}
    for doc_id, text, *_ in rows:
        ws = WORD.findall((text or "").lower())
        ws = ws[:200]
        for item_id, item in items:
            iw = WORD.findall((item or "").lower())
            if not iw or not ws:
                continue
            b, best = shingles(iw), 0.0
            for at in range(len(ws)):
                a = shingles(ws[at : at + len(iw)])
                low = sum((a & b).values())
                best = max(best, low / (sum(a.values()) + sum(b.values()) - low))
            if best >= 0.8:
                want[doc_id, item_id] = round(best, 9)
    assert got == want and len(want) > 30
    left = decontam.drop_leaks(frame(spark, rows), bench)
    assert left.columns == ["doc_id", "text", "source", "size"]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, *_ in rows if not any(k[0] == d for k in want))
    assert decontam.op4(frame(spark, []), bench).count() == 0 and decontam.op4(frame(spark, rows), bench.limit(0)).count() == 0


def lm_words(t):
    return WORD.findall((t or "").lower()) + [None]


def lm_fold(d):
    return None if d is None else zlib.crc32(str(d).encode()) % 10


def lm_counts(texts):
    """Counts of words, pairs and triples, and the number of texts."""
    uni, bi, tri, n = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for t in texts:
        ws = ["<s>", *lm_words(t)]
        uni.update(ws[1:])
        bi.update(zip(ws, ws[1:]))
        tri.update(zip(ws, ws[1:], ws[2:]))
        n += 1
    return uni, bi, tri, n


def lm_estimates(text, counts):
    """Bucket and the three estimates of each token."""
    uni, bi, tri, docs = counts
    total, ws = sum(uni.values()), ["<s>", *lm_words(text)]
    for k in range(1, len(ws)):
        one = docs if k == 1 else uni[ws[k - 1]]
        two, pair = (one, bi[ws[0], ws[1]]) if k == 1 else (bi[ws[k - 2], ws[k - 1]], bi[ws[k - 1], ws[k]])
        triple = pair if k == 1 else tri[ws[k - 2], ws[k - 1], ws[k]]
        bucket = ngram.STEPS + 1 + int(math.log2(two)) if two else 1 + int(math.log2(one)) if one else 0
        yield bucket, triple / max(two, 1), pair / max(one, 1), uni[ws[k]] / max(total, 1)


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(k, " ".join(f"w{int(rnd.paretovariate(0.8)) % 300}" for _ in range(rnd.randint(0, 60))).title(), "s", "x") for k in range(400)]
    rows += [(777, None, "s", "x"), (778, "", "s", "x"), (779, "w1 " * 50_000, "s", "x"), (779, "w1 " * 50_000, "s", "x"), (None, "w1 w2", "s", "x")]
    seen = {}
    fit = ngram.fit_weights
    monkeypatch.setattr(ngram, "fit_weights", lambda *a: seen.setdefault("w", fit(*a)))
    monkeypatch.setattr(ngram, "CHUNK_TOKENS", 3000)
    got = ngram.op7(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    counts = lm_counts([t for d, t, *_ in rows if lm_fold(d)])
    uni = counts[0]
    n, v = sum(uni.values()), len(uni)
    lam = seen["w"]
    assert lam.shape == (64, 4) and np.allclose(lam.sum(1), 1) and (lam >= 0).all()
    want = collections.defaultdict(set)
    for d, t, *_ in rows:
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in lm_words(t))
        score = sum(math.log10(lam[b] @ [*ps, 1 / (v + 1)]) for b, *ps in lm_estimates(t, counts))
        want[d].add((len(lm_words(t)), sum(uni[x] > 0 for x in lm_words(t)), round(base, 3), round(score, 3)))
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 3)) in want[r.doc_id] and r.train_tokens == n
        assert r.held_out == (lm_fold(r.doc_id) == 0)
    assert ngram.op7(frame(spark, [])).count() == 0

    # the weights are those of expectation-maximisation over the held-out tokens themselves, one by one
    main = lm_counts([t for d, t, *_ in rows if lm_fold(d) not in (None, 0, 1)])
    types = len(main[0])
    tokens = [x for d, t, *_ in rows if lm_fold(d) == 1 for x in lm_estimates(t, main)]
    direct = np.array(fit(np.array([], np.int64), np.array([]), types))
    may = direct > 0
    ks, ps = np.array([b for b, *_ in tokens]), np.array([[*p, 1 / (types + 1)] for _, *p in tokens])
    for _ in range(ngram.ROUNDS):
        share = direct[ks] * ps
        share /= share.sum(1, keepdims=True)
        sums = np.zeros((64, 4))
        np.add.at(sums, ks, share)
        sums = np.where(may, sums + 0.5 * np.maximum(sums.sum(0) / sums.sum(), 1e-3), 0)
        direct = sums / sums.sum(1, keepdims=True)
    likelihood = lambda w: np.log((w[ks] * ps).sum(1)).mean()
    assert len(ks) > 500 and abs(likelihood(lam) - likelihood(direct)) < 0.01
    assert np.abs((lam[ks] * ps).sum(1) / (direct[ks] * ps).sum(1) - 1).mean() < 0.05


def test_lm_tells_repeated_texts_from_others(spark):
    """Texts that training holds twice are likelier, word for word, than those it holds once."""
    rnd = random.Random(31)
    text = lambda: " ".join(f"w{int(rnd.paretovariate(0.4)) % 400}" for _ in range(80))
    train = [k for k in range(3000) if lm_fold(k) > 1]
    held = [k for k in range(3000) if lm_fold(k) == 1]
    rows = [(k, text(), "s", "x") for k in train[:700] + held[:80]]
    twice = [text() for _ in range(60)]
    rows += [(k, twice[n % 60], "s", "x") for n, k in enumerate(train[700:820])] + [(k, twice[n], "s", "x") for n, k in enumerate(held[80:90])]
    got = {r.doc_id: r.score / r.n_tokens for r in ngram.op7(frame(spark, rows)).collect()}
    once, again = sorted(got[k] for k in train[20:700]), [got[k] for k in train[700:820]]
    assert sum(x > once[int(0.9 * len(once))] for x in again) >= 0.9 * len(again)


def test_lm_keys_pack_and_ranges_cover_all():
    assert ngram.key_bits(10) == 40 and ngram.key_bits(10**9) == 44 and ngram.key_bits(1 << 60) == 64
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 44, 5000, np.uint64))
    of = ngram.range_of(keys, 44, 77)
    assert (np.diff(of.astype(np.int64)) >= 0).all() and of.max() == 76 and (np.bincount(of.astype(int)) > 20).all()
    assert (ngram.unpack(ngram.pack(keys), np.uint64) == keys).all() and len(ngram.unpack(ngram.pack(keys[:0]), np.uint64)) == 0


def odd_columns(docs):
    """The same rows with columns that operators might use themselves, and with a map."""
    names = ["id", "h", "_id", "_h", "text_hash", "row", "again", "nth", "component", "w", "_t", "item_id", "start", "sid", "bands", "node", "root", "parts", "fp", "size"]
    return docs.select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names], F.create_map(F.lit("a"), F.col("doc_id")).alias("m"))


def test_stages_take_any_other_columns(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = odd_columns(frame(spark, [(1, a, "s", "x"), (2, a, "s", "x"), (2, a, "s", "x"), (3, b, "s", "x"), (3, b, "s", "x"), (None, None, None, None)]))
    for groups in ((), (similar.similar,)):
        kept = simhash.keep_one(docs, *groups)
        assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    bench = spark.createDataFrame([(7, b)], "item_id long, text string")
    left = decontam.drop_leaks(docs, bench)
    assert left.schema == docs.schema and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "2", "None"]
    for stage in (quality.keep_good, lambda d: langid.keep(d, langid.train([]))):
        assert stage(docs).schema == docs.schema


def test_decontamination_index_is_selective_and_finds_what_is_near(spark):
    """Of 2000 items of one length and random windows few pairs meet; of windows at the threshold nearly all do."""
    rnd = random.Random(14)
    text = lambda: [f"v{rnd.randrange(5000)}" for _ in range(60)]
    items = [(k, text()) for k in range(2000)]
    near = []
    for k in range(400):
        ws = list(items[k][1])
        ws[rnd.randrange(56)] = "changed"  # five of 56 shingles change: similarity 51 / 61
        near.append((k, ws))
    far = [(1000 + k, text()) for k in range(400)]

    def hashed(rows, *names):
        d = spark.createDataFrame([(k, ws) for k, ws in rows], "k long, w array<string>")
        return d.select(F.col("k").alias(names[0]), F.size("w").alias("len"), F.lit(0).alias("start"), F.lit(0).alias("_t"), decontam.shingle_hashes(F.col("w")).alias("ih"))

    its = hashed(items, "item_id").select("item_id", "len", "ih")
    win = hashed(near + far, "_k0").withColumn("fp", decontam.simhash(F.col("ih"))).drop("ih")
    met = decontam.candidates(win, its, decontam.RADIUS, ["_k0"]).select("_k0", "item_id").distinct()
    assert met.where("_k0 >= 1000").count() < 0.05 * 400 * 2000
    found = {(r._k0, r.item_id) for r in decontam.within(win, its, decontam.RADIUS, ["_k0"]).collect()}
    assert sum((k, k) in found for k in range(400)) >= 0.98 * 400 and sum(a != b for a, b in found) < 100

    # the guarantee: all pairs within the radius, against all pairs
    fps = {r.item_id: r.x for r in its.select("item_id", decontam.simhash(F.col("ih")).alias("x")).collect()}
    wps = {r._k0: r.fp for r in win.collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a, x in wps.items() for b, y in fps.items() if ((x ^ y) & mask).bit_count() <= decontam.RADIUS}


def test_lm_without_training_documents(spark):
    d = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = ngram.op7(frame(spark, [(d, "a b", "s", "x")])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score) and math.isfinite(r.base_score)


def test_pipeline_stages_keep_columns_and_whole_rows(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    vocab = {"en": [f"the{k}" for k in range(200)], "de": [f"und{k}" for k in range(200)]}
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join(rnd.choice(vocab[lang]) for _ in range(60)), lang, "s" + str(k % 3), 5))
    rows += [(200, rows[0][1], "en", "s0", 5), (201, "$$$ " * 50, "en", "s1", 5), (202, None, None, None, None), (203, rows[5][1] + " leaked " + "item " + " ".join(f"q{k}" for k in range(30)), "de", "s2", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontaminate", "mix"]
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        ids = {r.doc_id for r in out.collect()}
        assert ids >= set(range(120)) - {0}, name
        assert {"quality_rules": {201, 202}, "near_dedup": {200}, "decontaminate": {203}}.get(name, set()).isdisjoint(ids)
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole and whole.isdisjoint({200, 201, 202, 203})


def test_mix_takes_a_rest_that_rounds_up_to_a_whole_epoch(spark):
    rows = [(k, "w " * 10, "a", "x") for k in range(10)]
    for ratio, want in ((0.997, 100), (1.997, 200)):
        got = mixing.mix_sources(frame(spark, rows), budget_ratio=ratio).collect()
        assert sum(r.taken for r in got) == want


def test_mix_leaves_columns_of_any_name(spark):
    names = ["_key", "_bucket", "_src", "_part", "_cut", "_base", "_rest", "_tsrc", "_q", "_row", "_id", "_n", "_full", "row", "epochs", "a.b"]
    rows = [(k, "w " * (k % 40), "a" if k % 3 else None, *[f"{n}{k}" for n in names]) for k in range(120)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mixing.mix_sources(docs).collect()
    plain = {r.doc_id: r.taken for r in mixing.mix_sources(docs.select("doc_id", "text", "source")).collect()}
    assert len(got) == 120 and all(r.taken == plain[r.doc_id] and all(r[n] == f"{n}{r.doc_id}" for n in names if n != "epochs") for r in got)
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, "").collect()} == {k for k, n in plain.items() if n}


def test_numbers_of_blocks_do_not_overflow_or_meet(spark):
    sizes = [0, 1, 2047, 2048, 4096, 32_768, 65_536, 1 << 20, (1 << 31) - 1]
    pairs = spark.createDataFrame([(a, b) for a in sizes for b in sizes], "a int, b int")
    got = {(r.a, r.b): r.p for r in pairs.select("a", "b", components.block_pair(F.col("a"), F.col("b")).alias("p")).collect()}
    assert all(got[a, b] == got[b, a] for a, b in got) and len(set(got.values())) == len(sizes) * (len(sizes) + 1) // 2


def test_bins_of_the_language_model_are_bounded(spark):
    rnd = np.random.default_rng(3)
    level = lambda: rnd.integers(0, ngram.LEVELS, 30_000)
    code = ((rnd.integers(0, 8, 30_000) * ngram.LEVELS + level()) * ngram.LEVELS + level()) * ngram.LEVELS + level()
    n = rnd.integers(1, 9, 30_000)
    seen = spark.createDataFrame(list(zip(code.tolist(), n.tolist())), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    whole, one = ngram.bounded_bins(seen, 10**6)
    assert one == 1 and whole.count() == len(set(code.tolist()))
    few, width = ngram.bounded_bins(seen, 2000)
    rows = few.collect()
    assert len(rows) <= 2000 and width > 1 and sum(r.n for r in rows) == n.sum()
    # a bin's steps are those of its members, taken together
    want = collections.Counter()
    for c, k in zip(code.tolist(), n.tolist()):
        parts = [c // ngram.LEVELS**j % ngram.LEVELS for j in (2, 1, 0)]
        want[c // ngram.LEVELS**3, *[0 if x == 0 else (x - 1) // width + 1 for x in parts]] += k
    assert {(r.code // ngram.LEVELS**3, *[r.code // ngram.LEVELS**j % ngram.LEVELS for j in (2, 1, 0)]): r.n for r in rows} == want


def test_coarser_bins_fit_much_the_same_weights():
    rnd = np.random.default_rng(4)
    p = np.exp(-rnd.gamma(3, 1, (20_000, 3)))
    k = rnd.integers(0, ngram.BUCKETS, 20_000)
    codes = lambda w: k * ngram.LEVELS**3 + sum(np.where(x > 0, (x - 1) // w + 1, 0) * ngram.LEVELS**j for x, j in zip(ngram._level(p).T, (2, 1, 0)))
    n = np.ones(20_000)
    fine, coarse = ngram.fit_weights(codes(1), n, 1000), ngram.fit_weights(codes(2), n, 1000, 2)
    assert np.abs(fine - coarse).max() < 0.12


def test_lm_keys_that_share_a_number_give_no_probability_above_one():
    # "b a" is unknown, and its number is that of a pair that training holds five times
    t = ngram._Tokens({"size": [3], "role": [ngram.HELD], "doc_id": [1], "ids": ngram.pack(np.array([1, 2, 0], np.int32)), "vocab": ngram.pack(np.array([9, 5, 7], np.uint64))}, 41)
    for words in (np.zeros(3), np.ones(3)):
        k, *ps = ngram._estimates(t, [words, np.full(3, 5.0), np.full(2, 50.0)], 10)
        assert all((0 <= p).all() and (p <= 1).all() for p in ps)
        code = k.copy()
        for p in ps:
            code = code * ngram.LEVELS + ngram._level(p)
        assert (code >= 0).all()
        ngram.fit_weights(code, np.ones(len(code)), 10)


def test_a_stored_table_has_no_marker(spark):
    """A marker is a file that the driver makes, by processes of their own on a local folder."""
    import os

    from vigilark.llm.common import stored

    got = stored(spark.range(7), "marked")
    folder = os.path.dirname(got.inputFiles()[0]).removeprefix("file:")
    assert got.count() == 7 and not any("_SUCCESS" in x for x in os.listdir(folder.replace("//", "/")))


def test_decontamination_asks_its_index_by_one_number(spark):
    """The index is broadcast, so it holds no more than an item, its fingerprint and where it is posted."""
    one = frame(spark, [(0, "x", None, None)])
    its = one.select(F.col("doc_id").alias("item_id"), F.lit(300).alias("len"), F.array(F.lit(-5).cast("long")).alias("ih"))
    win = one.select(F.col("doc_id").alias("_k0"), F.lit(0).alias("_t"), F.lit(0).alias("start"), F.explode(F.array(F.lit(300), F.lit(299))).alias("len"), decontam.simhash(F.array(F.lit(-5).cast("long"))).alias("fp"))
    met = decontam.candidates(win, its, decontam.RADIUS, ["_k0"])
    assert met.columns[-3:] == ["item_id", "ifp", "at"] and [(r["len"], r["fp"]) for r in met.distinct().collect()] == [(300, r.fp) for r in win.limit(1).collect() for _ in range(4)]

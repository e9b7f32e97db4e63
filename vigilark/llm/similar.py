"""Near-duplicates by five-word similarity: SimHash fingerprints and MinHash bands find candidates, shared shingles decide.

Two documents are linked if the weighted similarity of their five-word shingles is THRESHOLD or more: the sum of
lesser counts over the sum of greater. The n-th occurrence of a shingle is a member of its own, so that this is the
share of common members of two sets.

Candidates. Texts whose fingerprints differ by RADIUS bits or fewer are found by simhash's byte-position inverted index
with count filtering. Most pairs at similarity 0.8 lie further apart, so a set also has BANDS band keys of ROWS minima
each. Sets of similarity 0.8 share no key in one of 80,000 cases, and those above it in fewer. In each key's list all
sets point to the least, and components of these stars and of the links of fingerprints hold every pair that either
finds, so each text travels once, not once a key. A component above BLOCK sets is dealt out as pairs of blocks, as
posting lists are in simhash.

Decision. Within a component near fingerprints, and the sets of a key, are compared until they hang together: the minima drop pairs that
agree in under LEAST of them (six deviations below the threshold), and the members of the others are counted.
A task returns a spanning forest of what it linked.

Defined cases: words are those of simhash; texts of one to four words are one shingle; those without words are
equal to each other; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, stored
from .components import block_pair, components
from .simhash import _FOLD, RADIUS, SEED, fingerprint, links

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 7
BANDS = 48
LEAST = 0.6
BLOCK = 1024
#: Shingles that the sets of one block hold on average; a longer text is alone.
BLOCK_MEMBERS = 2_000_000
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def members(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's shingles, the later occurrences of one told apart."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + SHINGLE]), SEED) for k in range(n)), np.uint64, n)
    h.sort()
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    nth = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    return np.unique(h + nth.astype(np.uint64) * _MIX)


def set_id(m: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(m.tobytes(), SEED)


def minima(m: np.ndarray) -> np.ndarray:
    low = np.full(ROWS * BANDS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(m), 256):
        np.minimum(low, ((m[at : at + 256, None] ^ _XOR) * _ODD).min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))), np.uint64, BANDS)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def forest(sets: list[np.ndarray], fps: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places in sets, of fingerprints fps, that connect what similarity links."""
    low = np.stack([minima(m) for m in sets])
    keys = np.stack([band_keys(x) for x in low])
    size = np.array([len(m) for m in sets])
    label, edges = np.arange(len(sets)), []

    def meet(one: int, other: np.ndarray) -> None:
        other = other[label[other] != label[one]]
        fits = np.minimum(size[other], size[one]) >= THRESHOLD * np.maximum(size[other], size[one])
        other = other[fits]
        for x in other[(low[other] == low[one]).mean(1) >= LEAST]:
            if label[x] != label[one] and similarity(sets[x], sets[one]) >= THRESHOLD:
                label[label == label[x]] = label[one]
                edges.append((x, one))

    for one in range(len(sets) - 1):
        meet(one, one + 1 + np.flatnonzero(np.bitwise_count(fps[one + 1 :] ^ fps[one]) <= RADIUS))
    for k in range(BANDS):
        order = np.argsort(keys[:, k], kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(keys[order, k])) + 1):
            while len(group) > 1 and (label[group] != label[group[0]]).any():
                one, group = group[0], group[1:]
                meet(one, group)
                # what isn't linked to this one may be to the next
    return edges


def _verify(batches):
    """Texts arrive ordered by (root, part); the last part of a batch waits for its continuation."""
    at, held = None, {}

    def emit():
        ids = list(held)
        edges = forest([held[x][0] for x in ids], np.array([held[x][1] for x in ids], np.uint64)) if len(ids) > 1 else []
        if edges:
            u, v = ([ids[e[k]] for e in edges] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        roots, parts, sids = (b.column(k).to_pylist() for k in range(3))
        for k, (key, sid) in enumerate(zip(zip(roots, parts), sids)):
            if key != at:
                yield from emit()
                at, held = key, {}
            text = b.column(3)[k].as_py()
            held[sid] = members(text), fingerprint(text)
    yield from emit()


def sketches(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, sid (the set of shingles), bands and size of the set of each row, and the text's fingerprint."""
    picked = docs.select(*keys, "text")

    def run(batches):
        for b in batches:
            sids, bands, sizes, fps = [], [], [], []
            for x in b.column(len(keys)):
                text = x.as_py()
                m = members(text)
                fps.append(fingerprint(text))
                sids.append(set_id(m))
                sizes.append(len(m))
                bands.append(band_keys(minima(m)).view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * BANDS, flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(sids, np.uint64).view(np.int64)), lists, pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], [*keys, "sid", "bands", "size", "fp"])

    return picked.mapInArrow(run, T.StructType([*(picked.schema[k] for k in keys), T.StructField("sid", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType())]))


def candidates(of: DataFrame) -> DataFrame:
    """Edges (u, v) of sets: those that the index of fingerprints links, and in each key's list all point to the least."""
    sets = of.groupBy("sid").agg(F.first("bands").alias("bands"))
    posts = stored(sets.select("sid", F.explode("bands").alias("key")), "bands")
    low = cut(posts.groupBy("key").agg(F.min("sid").alias("v"), F.max("sid").alias("high")).where("v <> high").select(F.col("key").alias("_key"), "v"))
    banded = posts.join(broadcast_if_small(low), F.col("key") == F.col("_key")).where("sid <> v").select(F.col("sid").alias("u"), "v")
    return linked(of).unionByName(banded)


def linked(of: DataFrame) -> DataFrame:
    """Edges (u, v) of sets whose texts' fingerprints are equal, or linked by the byte-position index of simhash."""
    held = of.select("sid", "fp").distinct()
    reps = cut(held.groupBy("fp").agg(F.min("sid").alias("rep")))
    equal = held.join(reps, "fp").where("sid <> rep").select(F.col("sid").alias("u"), F.col("rep").alias("v"))
    rep = lambda c: reps.select(F.col("fp").alias(f"_{c}"), F.col("rep").alias(c))
    near = links(reps.select("fp")).toDF("_u", "_v").join(rep("u"), "_u").join(rep("v"), "_v").where("u <> v")
    return equal.unionByName(near.select("u", "v"))


def similar(docs: DataFrame, keys: tuple[str, ...], block: int = BLOCK, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """keys and component for each row of docs; keys must tell different texts apart."""
    of = stored(sketches(docs, keys), "sketches")
    near = components(candidates(of))
    # as many blocks as keep each within so many sets, and so many shingles in all, on average
    held = of.groupBy("sid").agg(F.first("size").alias("size"))
    sizes = near.join(held, F.col("node") == F.col("sid")).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("members"))
    sizes = sizes.select(F.col("root").alias("_root"), F.greatest(F.ceil(F.col("n") / block), F.least(F.col("n"), F.ceil(F.col("members") / block_members))).cast("int").alias("parts"))
    near = cut(near.join(sizes, F.col("root") == F.col("_root")).select("node", "root", "parts"))

    # one row that has the set's text
    pick = of.groupBy("sid").agg(F.min(F.struct(*keys)).alias("x"))
    pick = near.join(pick, F.col("node") == F.col("sid")).select("sid", "root", "parts", *[F.col(f"x.{k}").alias(f"_k{n}") for n, k in enumerate(keys)])
    pick = cut(pick)
    on = F.lit(True)
    for n, k in enumerate(keys):
        on = on & docs[k].eqNullSafe(F.col(f"_k{n}"))
    texts = docs.join(broadcast_if_small(pick), on).groupBy("sid", "root", "parts").agg(F.min("text").alias("text"))
    # a block of a large component meets each block of it, itself included, in a part of its own
    mine = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    pair = lambda x: block_pair(F.col("_b"), x)
    dealt = texts.withColumn("_b", mine).select("root", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)).alias("part"), "sid", "text")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(spread, "root", "part").sortWithinPartitions("root", "part", "sid").mapInArrow(_verify, "u long, v long")
    comp = components(links)
    return of.join(broadcast_if_small(comp), F.col("sid") == F.col("node"), "left").select(*keys, F.coalesce("root", "sid").alias("component"))

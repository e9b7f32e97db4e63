"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in RADIUS = 4 bits or fewer differ in 4 of their 8 bytes at most, so they
share at least MIN_SHARED = 4 positional bytes. The index posts each distinct fingerprint under combinations of
positional bytes that are chosen so that every set of 4 positions contains one of them: 20 triples, or, for
tables so large that a triple is no longer selective, all 70 quadruples. Within a posting list the shared
positional bytes of each pair are tallied, pairs under MIN_SHARED are dropped, and the others are verified by
their differing bits. No pair within the radius is missed.

Documents with equal fingerprints meet as one row before the index. A posting list above BLOCK rows is dealt
out as pairs of blocks, so no task holds a whole list, and a task returns a spanning forest of what it linked,
not all pairs. Components of the links give each document the least doc_id that it reaches.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any
other; very long texts are read whole; repeated rows have one component; a null doc_id never is the least id,
and the component of documents that have only null ids is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, stored
from .components import block_pair, components

RADIUS = 4
MIN_SHARED = 4
SHINGLE = 4
SEED = 42
BLOCK = 4096
#: Above so many distinct fingerprints a triple of bytes (24 bits) is too dense, and quadruples are posted.
TRIPLE_LIMIT = 1 << 27
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every 4 of the 8 positions contain at least one."""
    if width == 4:
        return list(combinations(range(8), 4))
    inside = [g for g in _GROUPS if len(g) == 3]
    across = [(*two, x) for k, g in enumerate(_GROUPS) for two in combinations(g, 2) for x in _GROUPS[(k + 1) % 3]]
    return [tuple(sorted(x)) for x in inside + across]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), SEED) for k in range(n)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and fp of each row: fp holds the 64 bits as a signed long."""
    picked = docs.select(*keys, "text")

    def run(batches):
        for b in batches:
            texts = b.column(len(keys))
            fps = np.fromiter((fingerprint(x) for at in range(0, len(texts), 256) for x in texts.slice(at, 256).to_pylist()), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*keys, "fp"])

    return picked.mapInArrow(run, T.StructType([*(picked.schema[k] for k in keys), T.StructField("fp", T.LongType())]))


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of pairs that share MIN_SHARED positional bytes and differ in RADIUS bits at most."""
    diff = x[:, None] ^ y[None, :]
    shared = (diff.view(np.uint8).reshape(len(x), len(y), 8) == 0).sum(2, dtype=np.uint8)
    i, j = np.nonzero(shared >= MIN_SHARED)
    near = np.bitwise_count(diff[i, j]) <= RADIUS
    return i[near], j[near]


def _hook(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u and v in label, an array of least members."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked among distinct fingerprints, at most one for each."""
    n = len(fps)
    label = np.arange(n)
    step = max(1, min(512, (1 << 21) // n))
    for at in range(0, n, step):
        i, j = _near(fps[at : at + step], fps[at:])
        up = j > i
        if up.any():
            _hook(label, i[up] + at, j[up] + at)
    child = np.flatnonzero(label != np.arange(n))
    return fps[child], fps[label[child]]


def _links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of all posting lists in arrays that are ordered by key."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[start, len(keys)])
    small = np.repeat((length > 1) & (length <= 16), length)
    for d in range(1, 16):
        at = np.flatnonzero(small[:-d] & (keys[d:] == keys[:-d])) if len(keys) > d else small[:0].nonzero()[0]
        if not len(at):
            break
        diff = fps[at] ^ fps[at + d]
        at = at[(diff.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= MIN_SHARED]
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= RADIUS]
        yield fps[at], fps[at + d]
    for s, n in zip(start[length > 16], length[length > 16]):
        yield _forest(np.unique(fps[s : s + n]))


def _match(batches):
    """Posting lists arrive ordered by (key, part); the last list of a batch waits for its continuation."""
    rest_k, rest_f = np.empty((0, 2), np.int64), np.empty(0, np.uint64)

    def emit(k, f):
        new = np.r_[True, (k[1:] != k[:-1]).any(1)] if len(k) else np.empty(0, bool)
        for u, v in _links(np.cumsum(new), f):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        k = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], 1)
        f = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        k, f = np.concatenate([rest_k, k]), np.concatenate([rest_f, f])
        if not len(k):
            continue
        last = np.flatnonzero((k != k[-1]).any(1))
        cut_at = last[-1] + 1 if len(last) else 0
        yield from emit(k[:cut_at], f[:cut_at])
        rest_k, rest_f = k[cut_at:], f[cut_at:]
    if len(rest_k):
        yield from emit(rest_k, rest_f)


def links(fps: DataFrame, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect exactly what links within RADIUS connect.

    width, 3 or 4, is the number of byte positions that a posting key combines. Both find the same links; by default
    it follows the number of fingerprints, as fewer positions make fewer rows and longer posting lists.
    """
    width = width or (3 if fps.count() <= TRIPLE_LIMIT else 4)
    sets = position_sets(width)
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    def key(k, ps):
        bits = F.lit(k).cast("long")
        for p in ps:
            bits = F.shiftleft(bits, 8).bitwiseOR(byte(p))
        return bits

    posts = fps.select("fp", F.explode(F.array(*[key(k, ps) for k, ps in enumerate(sets)])).alias("key"))
    hot = cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = posts.join(broadcast_if_small(hot), "key", "left").withColumn("_b", F.pmod(F.hash("fp", "key"), F.coalesce(parts, F.lit(1))))
    # a block of a hot list meets each block of the list, itself included, in a part of its own
    pair = lambda x: block_pair(F.col("_b"), x)
    each = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), pair))
    dealt = dealt.select("key", F.explode(each).alias("part"), "fp")
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(spread, "key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_match, "u long, v long")


def near_duplicates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, fp and component_id (the least doc_id that is reached) for each row of docs; keys must hold doc_id."""
    of = stored(fingerprints(docs, keys), "fingerprints")
    reps = cut(of.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(links(reps.select("fp")))
    least = comp.join(reps, comp.node == reps.fp).groupBy("root").agg(F.min("rep").alias("component_id"))
    label = comp.join(least, "root").select(F.col("node").alias("_node"), F.col("root").alias("_root"), "component_id")
    named = reps.join(label, F.col("fp") == F.col("_node"), "left")
    alone = F.col("_node").isNull()
    named = cut(named.select(F.col("fp").alias("_fp"), F.when(alone, F.col("fp")).otherwise(F.col("_root")).alias("component"), F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id")))
    return of.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def op3(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select(F.col("doc_id").cast("long"), "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame, tuple[str, ...]], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each component: of the least doc_id (null after all others), then of the least text hash.

    Of rows alike in both, the one whose other columns have the least hash. Columns may have any name and type. Groups
    are found and the row is chosen on ids and hashes; texts travel once, with the row, to meet the decision.
    """
    row = docs.select(F.struct("*").alias("row"))
    key = [F.col("row.doc_id").alias("doc_id"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("row.text").alias("h")]
    found = groups(row.select(*key, F.col("row.text").alias("text")), ("doc_id", "id", "h"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), "id", "h"))
    best = found.groupBy("component").agg(first.alias("x"))
    alike = found.groupBy("id", "h").agg((F.count(F.lit(1)) > 1).alias("again"))
    stay = best.select("x.id", "x.h").join(alike, ["id", "h"]).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "again")
    stay = cut(stay)
    mine = row.select("row", *key[1:])
    kept = mine.join(stay, (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    # only rows alike in id and text need an order among them
    rest = F.xxhash64(F.to_json(F.struct(*[F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_"))))
    again = kept.where("again").withColumn("nth", F.row_number().over(W.partitionBy("id", "h").orderBy(rest))).where("nth = 1")
    return kept.where("NOT again").select("row.*").unionAll(again.select("row.*"))

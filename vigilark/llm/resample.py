"""Target-distribution importance resampling by hashed n-gram features.

Documents are drawn in proportion to how much likelier their features (runs of 1 to max_n words, hashed to buckets)
are among the target's texts than among all documents: a bucket's gain is the scaled log ratio of its smoothed
shares, a document's weight the mean of its gains, and the draw without replacement takes the highest weights after
Gumbel noise, which a hash of the seed and the id gives.

How it runs. Each task numbers the words of its documents and sorts their places by the words that follow: a suffix
array over word ids, as deep as the longest feature. Places that share their first n words lie side by side in it, so
the common prefixes of neighbours enumerate each n-gram once, as a run; it is hashed once a run, and the bucket is
scattered back to all its places. The buckets are stored with the counts of each chunk; the counts add up to one
small table, whose gains (one number a bucket, at any input size) go to the tasks that score the stored buckets, so
texts are read once. Ranks need no global sort: scores are whole numbers in a range that logarithms bound, so their
counts tell how many documents lie above each, and only documents of equal score are ordered among themselves.

Defined cases: a null text has no words, so no features and weight 0; a null doc_id draws its noise as an empty one
and loses ties; repeated rows are drawn each; texts of any length are read whole (a chunk ends after the document
that fills it); an empty table or an empty target gives a defined result (no row; gains of an empty count); other
columns are not read by weigh() and are kept by resample().
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored
from .ngram import pack, unpack

BUCKETS = 10_000
MAX_N = 1
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
SCALE = 1000
CHUNK_WORDS = 500_000
SLICE_ROWS = 64
#: Distinct scores are bounded by the logarithms of the counts: some tens of thousands.
SCORE_ROWS = 400_000
#: Words are runs of digits, lower-cased Latin letters and all beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_array(ids: np.ndarray, depth: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their next depth ids, and how many of these each shares with the place before it.

    Ids from `words` on are borders: they end each document, differ from each other and are shared by no two places.
    """
    rank, reach = ids.astype(np.int64), 1
    while reach < depth:
        after = np.zeros(len(ids), np.int64)
        after[:-reach] = rank[reach:] + 1
        rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1]
        reach *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(ids), np.int32)
    alive = np.ones(max(0, len(ids) - 1), bool)
    for k in range(depth):
        at = ids[np.minimum(order + k, len(ids) - 1)]
        alive &= (at[1:] == at[:-1]) & (at[1:] < words)
        shared[1:] += alive
    return order, shared


def feature_buckets(ids: np.ndarray, vocab: list[bytes], max_n: int, buckets: int) -> list[np.ndarray]:
    """For n = 1 to max_n the buckets of all n-grams that cross no border, in the order of the text; ids as above."""
    order, shared = suffix_array(ids, max_n, len(vocab))
    borders = np.flatnonzero(ids >= len(vocab))
    room = borders[np.searchsorted(borders, np.arange(len(ids)))] - np.arange(len(ids))
    out = []
    for n in range(1, max_n + 1):
        inner = room[order] >= n
        places, heads = order[inner], (shared < n)[inner]
        run = np.cumsum(heads) - 1
        firsts = places[heads]
        grams = ids[firsts[:, None] + np.arange(n)].tolist()
        hashed = np.fromiter((zlib.crc32(b" ".join([vocab[w] for w in g])) % buckets for g in grams), np.int64, len(grams))
        found = np.full(len(ids), -1, np.int64)
        found[places] = hashed[run]
        out.append(found[found >= 0])
    return out


class _Chunk:
    """Documents as word ids, with a border after each."""

    def __init__(self):
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.n = 0

    def add(self, doc_id, text: bytes | None) -> None:
        words = (text or b"").translate(_FOLD).split()
        self.ids.append(np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc_id)
        self.n += len(words)

    def batch(self, max_n: int, buckets: int) -> pa.RecordBatch:
        sizes, v = [len(x) for x in self.ids], len(self.vocab)
        ids = np.concatenate([x for k, one in enumerate(self.ids) for x in (one, np.array([v + k], np.int32))])
        found = feature_buckets(ids, list(self.vocab), max_n, buckets)
        counts = sum(np.bincount(x, minlength=buckets) for x in found)
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        return pa.RecordBatch.from_arrays(
            [pa.array([self.docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([[pack(x.astype(kind)) for x in found]], pa.list_(pa.binary())), pa.array([pack(counts.astype(np.int64))], pa.binary())],
            ["doc_id", "size", "buckets", "counts"],
        )


_CHUNK_SCHEMA = "doc_id array<long>, size array<long>, buckets array<binary>, counts binary"


def hashed(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Chunks of documents (doc_id, text) as packed buckets, with the counts of each chunk."""

    def run(batches):
        c = _Chunk()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    c.add(doc_id, text)
                    if c.n >= CHUNK_WORDS:
                        yield c.batch(max_n, buckets)
                        c = _Chunk()
        if c.docs:
            yield c.batch(max_n, buckets)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _CHUNK_SCHEMA)


def bucket_counts(chunks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. What reaches the driver is one number a bucket, whatever the input."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for one in b.column(0).to_pylist():
                total += unpack(one, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in chunks.select("counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln of the target's smoothed share over all documents')."""
    b = len(s)
    ratio = (t + 1.0) * (float(s.sum()) + b) / ((s + 1.0) * (float(t.sum()) + b))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of docs (doc_id, text), against the texts of target."""
    chunks = stored(hashed(docs, max_n, buckets), "features")
    gains = bucket_gains(bucket_counts(chunks, buckets), bucket_counts(hashed(target.select(F.lit(None).alias("doc_id"), "text"), max_n, buckets), buckets))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                size = np.array(row["size"], np.int64)
                total, features = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                for n, packed in enumerate(row["buckets"]):
                    each = np.maximum(size - n, 0)
                    sums = np.r_[0, np.cumsum(gains[unpack(packed, kind)])]
                    ends = np.cumsum(each)
                    total += sums[ends] - sums[ends - each]
                    features += each
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(size), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return chunks.select("doc_id", "size", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score and rank: 1, 2, ... for the drawn ones, null for all others."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))).cast("long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scores")
    eligible = F.col("n_words") >= min_words
    tally = scored.where(eligible).groupBy("score").agg(F.count("*").alias("_n"))
    above = W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    # one row a distinct score, so this window is over a small table
    level = tally.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.floor(F.sum("_n").over(W.partitionBy()) * percent / 100).alias("_draw"))
    near = scored.join(broadcast_if_small(stored(level, "levels"), SCORE_ROWS), "score", "left")
    near = near.withColumn("_in", F.coalesce(eligible & (F.col("_above") < F.col("_draw")), F.lit(False)))
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    place = F.col("_above") + F.row_number().over(order)
    top = near.where("_in").withColumn("rank", F.when(place <= F.col("_draw"), place))
    rest = near.where(~F.col("_in")).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).select(*weighed.columns, "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """The drawn rows of docs, their columns untouched. Rows that share a doc_id share its draw: if one is drawn, all are."""
    drawn = ranked(weigh(docs, target, max_n, buckets), percent, min_words, seed).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn_id"))
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn_id"]), "left_semi")


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(weigh(docs, benchmark)).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS (SELECT rid, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h)::BIGINT, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
        lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM v, tab),
f AS (SELECT rid, own, bucket FROM w JOIN b USING (w)),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT rid, count(*)::BIGINT AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE own GROUP BY 1),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u
      FROM d LEFT JOIN m USING (rid) WHERE d.own),
z AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM k
"""

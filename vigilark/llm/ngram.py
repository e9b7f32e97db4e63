"""Language-model scoring by deleted interpolation.

The probability of a word mixes maximum-likelihood estimates: of the word after its two predecessors, after one, of
the word alone, and a uniform one over the training words and one unknown word. The weights of the mix depend on how
often the context occurs in training, by powers of two: the two predecessors where training has them, else the one.
They are learned by expectation-maximisation on the counts of a tenth of the training documents, which are left out
of the other counts meanwhile. Scores use all training counts.

How it runs. Documents are turned into chunks of token numbers once and stored. A chunk then names each word, pair
and triple that it holds as a hash, sorted, with its counts, in one packed row for each range of hashes that it has
any of. A range gathers the rows of all chunks, adds up the counts, and answers each chunk in the order it asked in.
So counts combine before they are shuffled, a frequent word or pair is one number a chunk, and no vocabulary is ever
in one place: the number of ranges grows with the tokens. Rows between chunks and ranges are at most one for each
key of a chunk, so they grow with the input; up to about a terabyte a row packs 64 keys or more.
The driver sees totals, and the held-out counts as a histogram of (context frequency, probabilities rounded to
RESOLUTION steps), of MAX_BINS bins at most: beyond these, steps are taken together.

Words are told apart by 64-bit hashes; two words share one with a probability of about V*V / 4e19. Pairs and triples
travel by the leading bits of theirs, SPARE more than the tokens' number has, so that one in 10,000 shares its
number with another; this touches their estimates only.

Defined cases: a null text counts as empty and has the end token alone; very long texts are scored whole; repeated
rows are scored each and counted each; a null doc_id neither trains nor is held out; without any training document
all words are unknown; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK_TOKENS = 700_000
#: Tokens whose words, pairs and triples one range gathers on average: as few as the first, and, where ranges would
#: outnumber MANY_RANGES, as many as the second.
RANGE_TOKENS = (1_000_000, 4_000_000)
MANY_RANGES = 40_000
SPARE = 14
#: Context frequencies by powers of two: of one predecessor, then of two.
STEPS = 32
BUCKETS = 2 * STEPS
RESOLUTION = 4  # steps of the histogram for each e-fold of a probability
LEVELS = 256
ROUNDS = 60
#: Bins of the histogram that reach the driver at most; beyond, steps are taken together, two by two.
MAX_BINS = 2_000_000
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_END, _BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F)
TEST, MAIN, HELD = 0, 1, 2


def pack(a: np.ndarray) -> bytes:
    """An array of integers as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes each; wraps around on purpose."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B185EBCA87)
        y = b * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= (y << np.uint64(31)) | (y >> np.uint64(33))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(32)
        return x


class _Chunk:
    """Documents of one kind as token numbers of their own vocabulary."""

    def __init__(self, held: bool):
        self.held, self.n = held, 0
        self.vocab: dict[bytes, int] = {b"": 0}  # the empty word stands for the end
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []

    def add(self, doc_id, role: int, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        v = self.vocab
        for w in words:
            if w not in v:
                v[w] = len(v)
        ids = np.fromiter(map(v.__getitem__, words), np.int32, len(words))
        self.ids.append(np.r_[ids, np.int32(0)])
        self.docs.append((doc_id, role, len(ids) + 1))
        self.n += len(ids) + 1

    def batch(self) -> pa.RecordBatch:
        names = list(self.vocab)[1:]
        hashes = np.r_[_END, np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))]
        doc, role, size = (list(x) for x in zip(*self.docs))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([self.held]), pa.array([doc], pa.list_(pa.int64())), pa.array([role], pa.list_(pa.int32())), pa.array([size], pa.list_(pa.int32())), pa.array([pack(np.concatenate(self.ids))], pa.binary()), pa.array([pack(hashes)], pa.binary()), pa.array([self.n], pa.int64())],
            ["chunk", "held", "doc_id", "role", "size", "ids", "vocab", "n"],
        )


_CHUNK_SCHEMA = "chunk string, held boolean, doc_id array<long>, role array<int>, size array<int>, ids binary, vocab binary, n long"


def _chunks(batches):
    open_: dict[bool, _Chunk] = {}
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            for doc_id, role, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                c = open_.setdefault(role == HELD, _Chunk(role == HELD))
                c.add(doc_id, role, text)
                if c.n >= CHUNK_TOKENS:
                    yield open_.pop(role == HELD).batch()
    for c in open_.values():
        yield c.batch()


class _Tokens:
    """A stored chunk, opened: for each token the places of its word, pair and triple in sorted hashes, and of its contexts."""

    def __init__(self, row: dict, bits: int):
        self.size, self.role, self.doc_id = np.array(row["size"], np.int64), np.array(row["role"], np.int64), row["doc_id"]
        ids, vocab = unpack(row["ids"], np.int32), unpack(row["vocab"], np.uint64)
        self.starts = np.r_[0, np.cumsum(self.size)[:-1]]
        self.first = np.zeros(len(ids), bool)
        self.first[self.starts] = True
        self.words, inverse = np.unique(vocab, return_inverse=True)
        self.word = inverse[ids]
        self.end = int(inverse[0])
        before = np.r_[0, ids[:-1]]
        self.before = inverse[before]
        context = vocab[before]
        context[self.first] = _BEGIN
        word, cut = vocab[ids], np.uint64(64 - bits)
        pair = pair_keys(context, word)
        self.pairs, self.pair = np.unique(pair >> cut, return_inverse=True)
        # a text's first word has no triple of its own
        inner = np.flatnonzero(~self.first)
        self.triple = np.zeros(len(ids), np.int64)
        self.triples, self.triple[inner] = np.unique(pair_keys(pair[inner - 1], word[inner]) >> cut, return_inverse=True)

    def trained(self) -> np.ndarray:
        return np.repeat(self.role != TEST, self.size)

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and training counts, of words, pairs and triples."""
        mine = self.trained()
        each = ((self.words, self.word[mine]), (self.pairs, self.pair[mine]), (self.triples, self.triple[mine & ~self.first]))
        return [(keys, np.bincount(at, minlength=len(keys)).astype(np.uint32)) for keys, at in each]


KINDS = ("w", "b", "t")


def key_bits(tokens: int) -> int:
    """Bits of a pair's or triple's hash that travel."""
    return min(64, max(40, int(tokens).bit_length() + SPARE))


def range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _ask(ranges: int, bits: int):
    """For each range of hashes that a chunk has keys in, a row of them with the chunk's training counts."""

    def run(batches):
        for b in batches:
            for row in _rows(b):
                found = [(keys, n, range_of(keys, 64 if k == 0 else bits, ranges)) for k, (keys, n) in enumerate(_Tokens(row, bits).asked())]
                parts = np.unique(np.concatenate([of for *_, of in found]))
                cells: list[list[bytes]] = [[] for _ in range(2 * len(KINDS))]
                for k, (keys, n, of) in enumerate(found):
                    for a, z in zip(np.searchsorted(of, parts), np.searchsorted(of, parts, "right")):
                        cells[2 * k].append(pack(np.diff(keys[a:z], prepend=np.uint64(0))))
                        cells[2 * k + 1].append(pack(n[a:z]))
                m = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([row["chunk"]] * m, pa.string()), pa.array([row["held"]] * m, pa.bool_()), *[pa.array(c, pa.binary()) for c in cells]], ["part", "chunk", "held", *[k + x for k in KINDS for x in ("", "n")]])

    return run


_ASK_SCHEMA = "part int, chunk string, held boolean, w binary, wn binary, b binary, bn binary, t binary, tn binary"
_ANSWER_SCHEMA = "part int, chunk string, w binary, wm binary, b binary, bm binary, t binary, tm binary, n long, n_main long, types long, types_main long"


def _answer(table: pa.Table) -> pa.Table:
    """The totals of a range: to each chunk in its own order, of all training and, to held ones, without the held documents."""
    rows = table.to_pylist()
    part = rows[0]["part"]
    held = np.array([r["held"] for r in rows])
    answers: dict[str, list[bytes]] = {k + x: [] for k in KINDS for x in ("", "m")}
    sums = (0, 0, 0, 0)
    for k in KINDS:
        keys = [np.cumsum(unpack(r[k], np.uint64), dtype=np.uint64) for r in rows]
        counts = np.concatenate([unpack(r[k + "n"], np.uint32) for r in rows]).astype(np.float64)
        size = [len(x) for x in keys]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts, len(found)).astype(np.uint64)
        main = np.bincount(at, np.where(np.repeat(held, size), 0, counts), len(found)).astype(np.uint64)
        ends = np.cumsum(size)
        for r, n, end in zip(rows, size, ends):
            mine = at[end - n : end]
            answers[k].append(pack(total[mine]))
            answers[k + "m"].append(pack(main[mine]) if r["held"] else pack(main[:0]))
        if k == "w":
            sums = (int(total.sum()), int(main.sum()), int((total > 0).sum()), int((main > 0).sum()))
    n = len(rows)
    first = [np.array([s] + [0] * (n - 1), np.int64) for s in sums]
    return pa.table([pa.array([part] * n, pa.int32()), pa.array([r["chunk"] for r in rows]), *[pa.array(x, pa.binary()) for x in answers.values()], *map(pa.array, first)], names=["part", "chunk", *answers, "n", "n_main", "types", "types_main"])


def _rows(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _told(row: dict, kind: str) -> np.ndarray:
    """The answers to a chunk, put together in the order of ranges."""
    cells = [unpack(x[kind], np.uint64) for x in sorted(row["answers"], key=lambda x: x["part"])]
    return np.concatenate(cells).astype(np.float64)


def _step(n: np.ndarray) -> np.ndarray:
    """0 for a context that is unknown, else one more than the power of two under its count."""
    return np.where(n > 0, np.minimum(1 + np.log2(np.maximum(n, 1)).astype(np.int64), STEPS - 1), 0)


def bucket(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """By the frequency of the two predecessors where training has them, else of the one."""
    return np.where(two > 0, STEPS + _step(two), _step(one))


def _estimates(t: _Tokens, counts: list[np.ndarray], total: int):
    """Bucket of each token, and the estimates after two words, after one, and of the word alone."""
    words, pairs, triples = counts
    one = np.where(t.first, words[t.end], words[t.before])  # a text's beginning occurs as often as an end
    pair = pairs[t.pair]
    two = np.where(t.first, one, np.r_[0.0, pair[:-1]])
    triple = np.where(t.first, pair, triples[t.triple] if len(triples) else 0.0)
    # no pair occurs more often than its context; one that shares its number with another could seem to
    triple, pair = np.minimum(triple, two), np.minimum(pair, one)
    return bucket(one, two), triple / np.maximum(two, 1), pair / np.maximum(one, 1), words[t.word] / max(1, total)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for zero, else one more than the steps below 1."""
    return np.where(p > 0, 1 + np.minimum(np.round(-np.log(np.maximum(p, 1e-300)) * RESOLUTION), LEVELS - 2).astype(np.int64), 0)


def _histogram(total: int, bits: int):
    def run(batches):
        for b in batches:
            for row in _rows(b):
                k, *ps = _estimates(_Tokens(row, bits), [_told(row, x + "m") for x in KINDS], total)
                for p in ps:
                    k = k * LEVELS + _level(p)
                code, n = np.unique(k, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return run


def coarser(code: Column) -> Column:
    """The bin that takes in a bin and its neighbours, with steps of twice the size; zero stays a step of its own."""
    half = lambda x: F.when(x > 0, F.floor((x - 1) / 2) + 1).otherwise(0)
    level = lambda k: F.floor(code / LEVELS**k) % LEVELS
    return (F.floor(code / LEVELS**3) * LEVELS**3 + half(level(2)) * LEVELS**2 + half(level(1)) * LEVELS + half(level(0))).cast("long")


def bounded_bins(seen: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Bins (code, n), stored, at most so many of them, and how many of the finest steps one of theirs takes in.

    Each round at least halves the steps of each estimate, so a few rounds suffice for any input: with 8 rounds a bucket
    has eight bins.
    """
    bins, width = stored(seen, "bins"), 1
    while bins.count() > max(most, 8 * BUCKETS):
        bins, width = stored(bins.groupBy(coarser(F.col("code")).alias("code")).agg(F.sum("n").alias("n")), "bins"), 2 * width
    return bins, width


def fit_weights(code: np.ndarray, n: np.ndarray, types: int, width: int = 1) -> np.ndarray:
    """BUCKETS x 4 weights: of the word after two words, after one, alone, and of the uniform estimate. width: finest steps in one."""
    weights = np.tile([0.3, 0.3, 0.3, 0.1], (BUCKETS, 1))
    has = np.ones((BUCKETS, 4), bool)  # estimates that a bucket's contexts can have
    has[:STEPS, 0] = False
    has[0, 1] = False
    weights = np.where(has, weights, 0)
    weights /= weights.sum(1, keepdims=True)
    if not len(code):
        return weights
    value = lambda x: np.where(x > 0, np.exp(-((x - 1) * width + (width - 1) / 2) / RESOLUTION), 0.0)
    k = code // LEVELS**3
    p = np.stack([value(code // LEVELS**2 % LEVELS), value(code // LEVELS % LEVELS), value(code % LEVELS), np.full(len(code), 1 / (types + 1))], 1)
    for _ in range(ROUNDS):
        share = weights[k] * p
        share *= (n / share.sum(1))[:, None]
        got = np.stack([np.bincount(k, share[:, c], BUCKETS) for c in range(4)], 1)
        everything = got.sum(0) / got.sum()
        # half a held-out token of the average mix for each bucket, so that no weight is zero but those of unknown contexts
        got = np.where(has, got + 0.5 * np.maximum(everything, 1e-3), 0)
        weights = got / got.sum(1, keepdims=True)
    return weights


def _score(weights: np.ndarray, total: int, types: int, bits: int):
    def run(batches):
        for b in batches:
            for row in _rows(b):
                t = _Tokens(row, bits)
                counts = [_told(row, x) for x in KINDS]
                seen = counts[0][t.word]
                k, *ps = _estimates(t, counts, total)
                mix = weights[k]
                p = mix[:, 3] / (types + 1)
                for c, x in enumerate(ps):
                    p += mix[:, c] * x
                base = np.log10((seen + 0.1) / (total + 0.1 * (types + 1)))
                add = lambda x: np.add.reduceat(x, t.starts)
                yield pa.RecordBatch.from_arrays([pa.array(t.doc_id, pa.int64()), pa.array(t.size), pa.array(add((seen > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text, role)."""
    spark = docs.sparkSession
    chunks = stored(docs.select(F.col("doc_id").cast("long"), "role", "text").mapInArrow(_chunks, _CHUNK_SCHEMA), "tokens")
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    least, most = RANGE_TOKENS
    ranges = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // min(most, max(least, tokens // MANY_RANGES))))
    bits = key_bits(tokens)
    asked = chunks.mapInArrow(_ask(ranges, bits), _ASK_SCHEMA)
    answers = stored(asked.groupBy("part").applyInArrow(_answer, _ANSWER_SCHEMA), "answers")
    n, n_main, types, types_main = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n", "n_main", "types", "types_main")]).first())
    told = answers.select("chunk", F.struct("part", *[k + x for k in KINDS for x in ("", "m")]).alias("a")).groupBy("chunk").agg(F.collect_list("a").alias("answers"))
    ready = chunks.join(told, "chunk")

    seen = ready.where("held").mapInArrow(_histogram(n_main, bits), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    bins, width = bounded_bins(seen, MAX_BINS)
    bins = bins.toPandas()  # MAX_BINS at most
    weights = fit_weights(bins["code"].to_numpy(np.int64), bins["n"].to_numpy(np.float64), types_main, width)
    scored = ready.mapInArrow(_score(weights, n, types, bits), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op7(docs: DataFrame) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    role = F.when(rest == 1, HELD).when(rest > 1, MAIN).otherwise(TEST)
    found = score_texts(docs.select("doc_id", "text", role.alias("role")))
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


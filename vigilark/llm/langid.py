"""Language ID by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams (NGRAMS) of the lower-cased text, hashed into BUCKETS rows of an embedding table. A
text is the mean of its subwords' embeddings; a linear layer and softmax give the languages. Table and layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows: whole texts, and random
cuts of a few words so that short texts are known too. The sample holds about TRAIN_ROWS rows and TRAIN_BYTES bytes,
or one row of each language where that is more; no language is left out. As the mean and the layer are linear,
prediction over the whole text uses their product, one row of language scores a bucket, where the languages are no
more than the dimensions.

Calibration. A part of the sample that isn't trained on fixes a temperature (least log loss) and the rejection
thresholds: the confidence, and the share of subwords that training met, under which REJECT of the calibration
texts lie, each at most MAX_THRESHOLD. A text under either, or without a letter, is rejected; its likeliest
language is reported all the same.

Defined cases: a null text or one without a letter is "und" with score 0 and is rejected; very long texts are read
whole, in pieces; repeated rows get one answer; rows with a null label don't train, an empty one is a label like any other; with no labelled row
at all every text is "und"; an empty table gives an empty result; other columns pass unchanged through keep().
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small

NGRAMS = (2, 3, 4)
BUCKETS = 1 << 18
DIM = 16
#: The classifier is fitted on about so many labelled rows and bytes of text at most.
TRAIN_ROWS = 2400
TRAIN_BYTES = 24 << 20
EPOCHS, RATE, SEED = 4, 0.5, 11
REJECT, MAX_THRESHOLD = 0.001, 0.5
PIECE = 1 << 20


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x (language scores or embedding, then 1 where training met the bucket)
    layer: np.ndarray | None  # from an embedding to language scores
    bias: np.ndarray
    temperature: float
    threshold: float
    coverage: float

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.layer is None else mean @ self.layer) + self.bias


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all byte n-grams of the lower-cased text, spaces included."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    found = []
    for n in NGRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        found.append(h * np.uint32(0x2C1B3C6D) >> np.uint32(14))
    return np.concatenate(found)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language)."""
    rng = np.random.default_rng(SEED)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(0, np.float32), 1.0, 0.0, 0.0)
    rows, place = sorted(rows), {lang: k for k, lang in enumerate(langs)}
    held = rng.random(len(rows)) < 0.2 if len(rows) >= 20 else np.zeros(len(rows), bool)

    def counted(text: str, y: int):
        """Distinct subwords, their shares of the text, and the language."""
        ids = subwords(text)
        hit, n = np.unique(ids, return_counts=True)
        return hit, (n / len(ids)).astype(np.float32), y

    def cuts(pick) -> list[tuple[np.ndarray, np.ndarray, int]]:
        out = []
        for k in pick:
            words, y = rows[k][0].split(), place[rows[k][1]]
            out.append(counted(rows[k][0], y))
            for size in (1, 3, 8):
                if len(words) > size:
                    at = int(rng.integers(len(words) - size))
                    out.append(counted(" ".join(words[at : at + size]), y))
        return out

    fit, check = cuts(np.flatnonzero(~held)), cuts(np.flatnonzero(held) if held.any() else range(len(rows)))
    emb = np.zeros((BUCKETS, DIM), np.float32)  # what training never met says nothing, and leaves a text uncertain
    w, b = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    total, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            hit, part, y = fit[k]
            rate = np.float32(RATE * (1 - done / total))
            done += 1
            mean = part @ emb[hit]
            g = _softmax(mean @ w + b)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            b -= rate * g
            # a text's gradient is shared out among its subwords, so each moves by its part, many times over
            emb[hit] -= rate * np.float32(4 * min(len(hit), 64)) * part[:, None] * back
    met = np.zeros((BUCKETS, 1), np.float32)
    for hit, *_ in fit:
        met[hit] = 1
    layer = None if len(langs) <= DIM else w
    table = np.hstack([emb @ w if layer is None else emb, met]).astype(np.float32)
    means = np.stack([part @ table[hit] for hit, part, _ in check])
    z = means[:, :-1] @ (np.eye(len(langs)) if layer is None else layer) + b
    y = np.array([y for *_, y in check])
    grid = np.geomspace(0.02, 8, 61)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z / t)
    right = p.max(1)[p.argmax(1) == y]
    limit = float(min(np.quantile(right, REJECT), MAX_THRESHOLD)) if len(right) else 0.0
    return Model(langs, table, layer, b, t, limit, float(min(np.quantile(means[:, -1], REJECT), MAX_THRESHOLD)))


def labelled(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame | None:
    """Labelled rows (text, lang), whole texts, the languages in like shares as far as they go; None where there are none.

    All languages that occur are drawn from: about rows rows and size bytes in all, or one row of each language where
    that is more. A row's place in the draw is a hash of its id and text, so that it doesn't depend on partitions.
    """
    known = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.count()
    if not langs:
        return None
    each = max(1, rows // langs)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), "text"), F.lit(1 << 40)) / float(1 << 40)
    # a few more than needed come through, so that each language has its rows; then the first of them are taken
    picked = known.withColumn("draw", draw).join(broadcast_if_small(counts.select(F.col("lang").alias("_lang"), "n")), F.col("lang") == F.col("_lang")).where(F.col("draw") * F.col("n") <= 2 * each + 20)
    of_lang = W.partitionBy("lang").orderBy(F.octet_length("text") > size // langs, "draw", F.col("doc_id").cast("string"))
    picked = picked.withColumn("nth", F.row_number().over(of_lang)).where(F.col("nth") <= each)
    picked = picked.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(of_lang.rowsBetween(W.unboundedPreceding, 0)))
    return picked.where((F.col("nth") == 1) | (F.col("bytes") <= size // langs)).select("text", "lang")


def sample_labelled(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> list[tuple[str, str]]:
    found = labelled(docs, learn, rows, size)
    return [] if found is None else [(r["text"], r["lang"]) for r in found.collect()]


def predict(text: str | None, m: Model) -> tuple[str, float, bool]:
    """Language, calibrated probability, and whether the text is rejected."""
    if not text or not m.langs or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    mean, n = np.zeros(m.table.shape[1]), 0
    for at in range(0, len(text), PIECE):
        ids = subwords(text[at : at + PIECE])
        mean += m.table[ids].sum(0, dtype=np.float64)
        n += len(ids)
    mean /= n
    p = _softmax(m.logits(mean[:-1]) / m.temperature)
    k = int(p.argmax())
    return m.langs[k], float(min(1.0, max(0.0, p[k]))), bool(p[k] < m.threshold or mean[-1] < m.coverage)


def _answers(column, m: Model):
    for at in range(0, len(column), 256):
        for text in column.slice(at, 256).to_pylist():
            yield predict(text, m)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the size of the input

    def run(batches):
        for b in batches:
            lang, score, bad = zip(*_answers(b.column(1), shared.value)) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not bad for _, _, bad in _answers(b.column(at), shared.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(docs: DataFrame) -> Column:
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3


def learnt(docs: DataFrame) -> Model:
    """Trained on the documents whose remainder isn't 1; a null doc_id doesn't train.

    A task trains on the sample, so that the driver holds neither its texts nor their subwords, only the model.
    """
    found = labelled(docs, F.coalesce(fold(docs) != 1, F.lit(False)))
    if found is None:
        return train([])

    def fit(batches):
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(train(rows)), 1)], pa.binary())], ["model"])

    return pickle.loads(zlib.decompress(found.repartition(1).mapInArrow(fit, "model binary").first()["model"]))


def op6(docs: DataFrame) -> DataFrame:
    found = identify(docs, learnt(docs))
    return found.select("doc_id", F.coalesce(fold(found) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")

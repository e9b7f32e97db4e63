"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document is contaminated by a benchmark item if some window of it, as long in words as the item, has a
weighted shingle similarity of THRESHOLD or more to it: shingles are five words (lower case, accented letters
too, joined by a space), their weights are their counts, and the similarity is the sum of lesser weights over the
sum of greater.

Windows. Similarity above zero needs a shingle in common. The windows of a document are those that are aligned
with an item by such a shingle: they start where it puts the item's first word, and are as long as the item (cut
at the ends of the text). Documents' shingle hashes meet the items' hashes in one join, over whole texts. A shingle
that an item repeats aligns by its first place. Items of under five words are one shingle of that many words; where
there are such, documents' shingles of as many words meet them too, each by its first place in the document.

Fingerprints. Each window and item gets a 64-bit SimHash of its shingles. Fingerprints that differ in RADIUS = 15
bits or fewer differ in three bits or fewer in one of four blocks of 16 bits. The index posts each item under all
697 values that its blocks can take with three changed bits or fewer; a window asks with its own four blocks. So all
items within the radius are found, and of random fingerprints one pair in 24 meets. Pairs further apart are dropped,
the others are verified exactly by their shingles. At similarity 0.8 two fingerprints differ in about 10 bits, with
a deviation of 3, and in fewer above it.

All of this is built-in column functions.

Defined cases: null and empty texts have no words and match nothing; very long texts are read whole; repeated
documents are each judged and give one row for each distinct (doc_id, text); repeated items have an item_id each, a
null item_id is one like any other; an empty table on either side gives an empty result; other columns of the input
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, stored

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 4
#: Item shingles are broadcast up to so many rows of 24 bytes; beyond, their join with the documents shuffles.
GRAM_ROWS = 1_000_000
WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; splitting leaves an empty string where it begins or ends in white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda x: x != "")


def shingles(w: Column) -> Column:
    """Five-word shingles of an array of words, as strings; fewer words are one shingle; none is none."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return F.when(F.size(w) > 0, some).otherwise(F.array().cast("array<string>"))


def shingle_hashes(w: Column) -> Column:
    """Hashes of the five-word shingles; the words are hashed one after the other, without joining them."""
    at = lambda i, k: F.get(w, i + k)
    full = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    short = F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """A bit is 1 if it is set in over half of the hashes; a shingle counts as often as it occurs."""
    bit = lambda b: F.size(F.filter(hashes, lambda h: F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)) == 1)) * 2 > F.size(hashes)
    bits = [F.when(bit(b), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column, n: int = BLOCKS) -> Column:
    """n blocks of the 64 bits as (number, bits)."""
    width = 64 // n
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for k in range(n)])


def reachable(bits: Column, radius: int = RADIUS, n: int = BLOCKS) -> Column:
    """All values of a block that differ from bits in at most radius // n places."""
    masks = [m for m in range(1 << (64 // n)) if m.bit_count() <= radius // n]
    return F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda m: bits.bitwiseXOR(m))


def similarity(a: Column, b: Column) -> Column:
    """Sum of lesser over sum of greater counts of two arrays of shingles."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    low = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    return low / (F.size(a) + F.size(b) - low)


def short_grams(w: Column, n: int) -> Column:
    """Hashes of all runs of n words, n under SHINGLE."""
    some = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<bigint>"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, item_id, start (word of the best window, from 0), similarity, for each contaminated document and item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = cut(items.select("item_id", F.size("iw").alias("len"), shingle_hashes(F.col("iw")).alias("ih"), shingles(F.col("iw")).alias("ish")))
    grams = items.select("item_id", "len", F.posexplode("ih").alias("q", "h")).groupBy("item_id", "len", "h").agg(F.min("q").alias("q"))
    grams = cut(grams.select("len", "q", "h").distinct())
    short = [r["len"] for r in grams.where(F.col("len") < SHINGLE).select("len").distinct().collect()]  # four at most

    mine = docs.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.xxhash64("text").alias("_t"), words(F.col("text")).alias("w"))
    ks = [f"_k{n}" for n in range(len(keys))]
    long = F.when(F.size("w") >= SHINGLE, shingle_hashes(F.col("w"))).otherwise(F.array().cast("array<bigint>"))
    at = mine.select(*ks, "_t", F.posexplode(long).alias("p", "dh"))
    wanted = broadcast_if_small(grams.where(F.col("len") >= SHINGLE), bound=GRAM_ROWS)
    hits = at.join(wanted, F.col("dh") == F.col("h")).select(*ks, "_t", "len", F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("start")).distinct()
    for n in short:
        # a short item is met by its own words only, so the first place will do
        at = mine.select(*ks, "_t", F.posexplode(short_grams(F.col("w"), n)).alias("p", "dh"))
        found = at.join(broadcast_if_small(grams.where(F.col("len") == n), bound=GRAM_ROWS), F.col("dh") == F.col("h"))
        hits = hits.unionAll(found.groupBy(*ks, "_t", "len", "dh").agg(F.min("p").alias("start")).select(*ks, "_t", "len", "start"))
    hits = stored(hits, "windows")

    # the words of the few documents that have a shingle in common with some item
    same = F.col("_t") == F.col("_ht")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"_h{k}"))
    win = mine.join(hits.select(*[F.col(k).alias(f"_h{k}") for k in ks], F.col("_t").alias("_ht"), "len", "start"), same)
    win = win.select(*ks, "_t", "len", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("w")).distinct()
    win = win.select(*ks, "_t", "len", "start", shingles(F.col("w")).alias("sh"), shingle_hashes(F.col("w")).alias("wh"))
    win = cut(win.select(*ks, "_t", "len", "start", "sh", simhash(F.col("wh")).alias("fp")))

    near = within(win, items, radius, ks)
    both = _with_shingles(near, win, ks)
    both = both.join(broadcast_if_small(items.select(F.col("item_id").alias("_item"), "ish")), F.col("item_id").eqNullSafe(F.col("_item")))
    scored = both.withColumn("similarity", similarity(F.col("sh"), F.col("ish"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy(*ks, "_t", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("x"))
    return best.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], F.col("_t").alias("text_hash"), "item_id", (-F.col("x.before")).alias("start"), "x.similarity")


def candidates(win: DataFrame, items: DataFrame, radius: int, ks: list[str]) -> DataFrame:
    """Windows and items of a length whose fingerprints share a posted block value; a pair may come once a block."""
    # length, block and bits are one number: what is broadcast is half as large as with three columns
    posted = lambda size, block, bits: (size.cast("long") * BLOCKS + block) * F.lit(1 << (64 // BLOCKS)) + bits
    index = items.select("item_id", "len", simhash(F.col("ih")).alias("ifp"))
    index = cut(index).select("item_id", "len", "ifp", F.explode(blocks(F.col("ifp"))).alias("ib"))
    index = index.select("item_id", "len", "ifp", F.col("ib.block").alias("block"), F.explode(reachable(F.col("ib.bits"), radius)).alias("bits"))
    index = index.select("item_id", "ifp", posted(F.col("len"), F.col("block"), F.col("bits")).alias("at"))
    probe = win.select(*ks, "_t", "len", "start", "fp", F.explode(blocks(F.col("fp"))).alias("b"))
    probe = probe.select(*ks, "_t", "len", "start", "fp", posted(F.col("len"), F.col("b.block"), F.col("b.bits")).alias("asks"))
    return probe.join(broadcast_if_small(cut(index)), F.col("asks") == F.col("at"))


def within(win: DataFrame, items: DataFrame, radius: int, ks: list[str]) -> DataFrame:
    """(ks, _t, len, start, item_id) of windows and items of a length within radius bits."""
    near = candidates(win, items, radius, ks)
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select(*ks, "_t", "len", "start", "item_id").distinct()


def _with_shingles(near: DataFrame, win: DataFrame, ks: list[str]) -> DataFrame:
    """near with the shingles of its windows."""
    right = win.select(*[F.col(k).alias(f"_w{k}") for k in ks], F.col("_t").alias("_wt"), F.col("len").alias("_wl"), F.col("start").alias("_ws"), "sh")
    on = (F.col("_t") == F.col("_wt")) & (F.col("len") == F.col("_wl")) & (F.col("start") == F.col("_ws"))
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"_w{k}"))
    return near.join(right, on).select(*ks, "_t", "len", "start", "item_id", "sh")


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs.select(F.col("doc_id").cast("long"), "text"), benchmark).select("doc_id", "item_id", "start", "similarity").distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; their columns may have any name and type."""
    row = docs.select(F.struct("*").alias("row"))
    found = leaks(row.select("row.doc_id", "row.text"), benchmark).select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    found = cut(found)
    return row.join(broadcast_if_small(found), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("text_hash")), "left_anti").select("row.*")

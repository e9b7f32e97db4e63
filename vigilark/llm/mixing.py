"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / quality, u being a hash of its id, so better documents tend
to come first. Targets are shared among sources by weight, each capped at a number of epochs, and the excess is
shared again until no source is above its cap. A source takes its whole epochs first; the fraction that is left
goes to its documents in the order of their keys, by a prefix sum of sizes; the last document is taken in part,
so that the budget is met to the word.

The prefix sum isn't run over whole sources. Keys fall into BUCKETS monotone buckets; sums by (source, bucket)
combine on the map side and tell the one bucket where a source's budget ends. Only that bucket is sorted.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; documents of
size 0 take 0; a source of size 0 has target 0; repeated rows are separate documents; ties in the key are
ordered by id and size; an empty table gives an empty result. Columns of the input are kept untouched unless
they bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut

WEIGHTS = (3, 1, 2)
BUDGET_RATIO = 1.5
MAX_EPOCHS = 2
BUCKETS = 4096
SYMBOLS = "#*$%&|<>!"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for text free of SYMBOLS, falling with the number of them a word."""
    n = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * F.coalesce(n, F.lit(0)) / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column) -> Column:
    """52 bits of a hash of the id, as a number inside (0, 1)."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(totals: DataFrame, weights=WEIGHTS, budget_ratio=BUDGET_RATIO, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(_src, source_size) to (_src, source_size, target). One row a source; this table is as small as the list of weights."""
    every = W.partitionBy(F.lit(0))
    ranked = totals.withColumn("_rank", F.row_number().over(every.orderBy(F.col("_src").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size").cast("double") * max_epochs).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = every.orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, -1)
    budget = F.least(F.sum("source_size").over(every) * F.lit(float(budget_ratio)), F.sum("_cap").over(every))
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    level = caps.withColumn("_level", level)
    # sources ordered by cap / weight: the first that stays under its cap fixes the level for all after it
    free = F.when(F.col("_level") < F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))
    out = level.withColumn("_free", F.min(free).over(every))
    target = F.when(F.struct("_ratio", "_rank") < F.struct("_free._ratio", "_free._rank"), F.col("_cap")).otherwise(F.coalesce(F.col("_free._level") * F.col("_w"), F.col("_cap")))
    return out.select("_src", "source_size", F.least(target, F.col("_cap")).alias("target"))


def mix_sources(docs: DataFrame, quality: Column | None = None, weights=WEIGHTS, budget_ratio=BUDGET_RATIO, max_epochs=MAX_EPOCHS) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes, repeats counted) and epochs (whole passes).

    docs needs doc_id, source and text, or size in place of text together with quality.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "epochs")]
    size = F.col("size") if "text" not in docs.columns else n_words(F.col("text"))
    # the row travels as one struct, so that no name of its columns meets one of the names used here
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    sized = docs.select(row, size.alias("size"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"), *([quality.alias("_q")] if quality is not None else []))
    q = F.col("_q") if quality is not None else quality_weight(F.col("_row.text"), F.col("size"))
    keyed = sized.withColumn("_key", -F.log(uniform(F.col("_id"))) / q).withColumn("_bucket", F.floor(F.col("_key") / (F.col("_key") + 1) * BUCKETS))
    keyed = keyed.drop("_q")

    sums = cut(keyed.groupBy("_src", "_bucket").agg(F.sum("size").alias("_n")))
    targets = source_targets(sums.groupBy("_src").agg(F.sum("_n").alias("source_size")), weights, budget_ratio, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("_rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # a rest that rounds up to the whole size is one more epoch, as it ends in no bucket
    full = (F.col("source_size") > 0) & (F.col("_rest") >= F.col("source_size"))
    targets = targets.withColumn("_full", full).withColumn("epochs", F.col("epochs") + F.col("_full").cast("long")).withColumn("_rest", F.when(F.col("_full"), F.lit(0).cast("long")).otherwise(F.col("_rest"))).drop("_full")
    before = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    spot = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    t = targets.withColumnRenamed("_src", "_tsrc")
    spot = t.join(spot, (F.col("_src").eqNullSafe(F.col("_tsrc"))) & (F.col("_base") <= F.col("_rest")) & (F.col("_rest") < F.col("_base") + F.col("_n")), "left")
    info = cut(spot.select("_tsrc", "source_size", "target", "epochs", "_rest", F.col("_bucket").alias("_cut"), "_base"))

    joined = keyed.join(broadcast_if_small(info), F.col("_src").eqNullSafe(F.col("_tsrc")))
    whole = joined.where(~F.col("_bucket").eqNullSafe(F.col("_cut"))).withColumn("_part", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0).cast("long"))
    order = W.partitionBy("_src").orderBy("_key", F.col("_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    edge = joined.where(F.col("_bucket").eqNullSafe(F.col("_cut")))
    left = F.col("_rest") - F.col("_base") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = edge.withColumn("_part", F.least(F.greatest(left, F.lit(0)), F.col("size")).cast("long"))
    both = whole.unionByName(edge)
    return both.withColumn("taken", F.col("epochs") * F.col("size") + F.col("_part")).select(*[F.col("_row").getField(c).alias(c) for c in kept], "size", "source_size", "target", "taken", "epochs")


def op1(docs: DataFrame) -> DataFrame:
    """The digest of the mix of all documents."""
    size = n_words(F.col("text"))
    narrow = cut(docs.select("doc_id", "source", size.alias("size"), quality_weight(F.col("text"), size).alias("quality")))
    return mix_sources(narrow, F.col("quality")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) AS n_sym,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * n_sym / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, cap / wt AS ratio,
       (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lev
      FROM w WINDOW b AS (ORDER BY cap / wt, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, struct_pack(a := ratio, b := rnk)) AS lev FROM l WHERE lev < ratio),
t AS (SELECT l.source, source_size, coalesce(least(cap, f.lev * wt), cap) AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
       round(e.target - e.epochs * e.source_size)::BIGINT
         - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(room, 0), size))::BIGINT AS taken FROM p
"""

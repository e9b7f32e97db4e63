"""Points in intervals: an equality join over dyadic blocks of ranks, with no row but those of the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stabbed(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(g, at, span): the intervals [low, high) of spans (g, low, high, span) that hold a point of points (g, at).

    low and high are null where an interval has no start or end. Keys can be of any type that orders.

    The distinct keys of a group, points and ends alike, are numbered in their order. An interval of numbers is cut
    into blocks of a power of two that start at a multiple of their size, two of a size at most; a point names the one
    block of each size that holds it. An interval and a point in it share just one block, so the join by (group, size,
    block) yields each answer once and nothing else; neither a group nor an interval is a hot row. What is ordered in
    one task are the distinct keys of one group, not its intervals or points.
    """
    there, blocks = dealt(points, spans)
    return there.join(blocks, ["g", "level", "block"]).select("g", "at", "span")


def dealt(points: DataFrame, spans: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The blocks (g, level, block) of each point, with its key and number (at, nth), and those of each interval, with span.

    once: the intervals of a group that have the same span are united first, so that a point in several of them meets
    it once.
    """
    points, spans = points.select("g", "at").distinct(), spans.select("g", "low", "high", "span")
    ends = points.unionByName(spans.select("g", F.explode(F.array("low", "high")).alias("at")).where("at IS NOT NULL")).distinct()
    # the numbers of a group's keys come from its sorted keys, so ties can't be
    listed = ends.groupBy("g").agg(F.sort_array(F.collect_list("at")).alias("keys"))
    size = listed.select("g", F.size("keys").cast("long").alias("n"), F.expr("CAST(ceil(log2(size(keys) + 1)) AS INT)").alias("bits"))
    number = listed.select("g", F.posexplode("keys").alias("nth", "at")).withColumn("nth", F.col("nth").cast("long"))
    there = points.join(number, ["g", "at"]).join(size, "g")
    there = there.select("g", "at", "nth", F.explode(F.expr("sequence(0, bits)")).alias("level")).select("g", "at", "nth", "level", F.expr("shiftright(nth, level)").alias("block"))
    x = spans.join(number.withColumnsRenamed({"at": "low", "nth": "a"}), ["g", "low"], "left").join(number.withColumnsRenamed({"at": "high", "nth": "b"}), ["g", "high"], "left").join(size, "g")
    x = x.select("g", "span", "bits", F.coalesce("a", F.lit(0).cast("long")).alias("a"), F.when(F.col("high").isNull(), F.col("n")).otherwise(F.col("b")).alias("b"))
    if once:
        # sorted by their starts; one that begins inside the last one, or at its end, extends it
        merged = "aggregate(array_sort(collect_list(struct(a, b))), CAST(array() AS array<struct<a: bigint, b: bigint>>), (l, y) -> CASE WHEN size(l) > 0 AND y.a <= element_at(l, -1).b THEN concat(slice(l, 1, size(l) - 1), array(struct(element_at(l, -1).a AS a, greatest(element_at(l, -1).b, y.b) AS b))) ELSE concat(l, array(y)) END)"
        x = x.where("a < b").groupBy("g", "span", "bits").agg(F.expr(merged).alias("l")).select("g", "span", "bits", F.explode("l").alias("y")).select("g", "span", "bits", "y.a", "y.b")
    first, last = "shiftright(a + shiftleft(1L, k) - 1, k)", "shiftright(b, k)"
    cut = lambda odd, block: f"transform(filter(sequence(0, bits), k -> {first} < {last} AND {odd} % 2 = 1), k -> named_struct('level', k, 'block', {block}))"
    blocks = x.select("g", "span", F.explode(F.expr(f"concat({cut(first, first)}, {cut(last, last + ' - 1')})")).alias("x")).select("g", "span", "x.level", "x.block")
    return there, blocks

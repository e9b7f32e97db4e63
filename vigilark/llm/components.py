"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is two joins on aggregated minima. A node with very many neighbours never becomes one row or one
group: its minimum combines on the map side, and the join back is one that adaptive execution can split. Rounds
end when the edges are stars; they are cut by reliable checkpoints, so a lost executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least node of that neighbourhood."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    out = both.join(low, F.col("u") == F.col("n")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from the greater to the lesser node; the lesser ones of a node are linked to the least of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    near = e.join(low, F.col("u") == F.col("n"))
    out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) to (node, root): each node that has an edge with the least node that it reaches."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    digest = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def block_pair(a: Column, b: Column) -> Column:
    """A number for two blocks, the same in either order, up to 2^31 blocks."""
    return F.least(a, b).cast("long") * F.lit(1 << 32) + F.greatest(a, b).cast("long")

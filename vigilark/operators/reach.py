"""What directed edges reach from seeds, group by group, in rounds that double the distance they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored, stored_with_count

HELD, OPEN, TIED, MANY = "held", "open", "tied", "many"


def _doubled(nodes: DataFrame) -> DataFrame:
    """Each open pointer takes over what its target knows: reached, at a node of many edges, or a pointer twice as far; one to nowhere goes."""
    there = nodes.select("g", F.col("v").alias("to"), F.col("to").alias("next"), F.col("state").alias("seen"))
    state = F.when(F.col("seen") == HELD, HELD).when(F.col("seen").isin(MANY, TIED), TIED).otherwise(OPEN)
    moved = nodes.where(F.col("state") == OPEN).join(there, ["g", "to"]).select("g", "v", F.when(F.col("seen").isin(TIED, OPEN), F.col("next")).when(F.col("seen") == MANY, F.col("to")).alias("to"), state.alias("state"))
    return nodes.where(F.col("state") != OPEN).unionByName(moved)


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, v): the nodes of a group that its edges (g, src, dst) reach from its seeds (g, v), the seeds included.

    A node with one edge into it is reached just when its source is, so such nodes carry a pointer, and pointers are
    joined with themselves until they end at a seed, at a node with several edges, or nowhere: a chain of d steps takes
    log2(d) rounds, each linear in the nodes. Then edges are shortened to run between nodes with several edges; those
    with an edge from what is reached are reached, and the rest, fewer each time, goes through the same again. Nodes
    are settled when the last level is. What goes round in a circle without a seed is never reached.

    A node with several edges into it that lies behind d others of its kind takes d levels.
    """
    held = stored(seeds.select("g", "v").distinct(), "held")
    left = edges.select("g", "src", "dst").where("src <> dst").distinct()
    left = stored(left.join(held.withColumnRenamed("v", "dst"), ["g", "dst"], "left_anti"), "edges")
    levels = []
    while True:
        into = left.groupBy("g", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to"))
        one = F.col("n") == 1
        nodes = into.select("g", "v", F.when(one, F.col("to")).alias("to"), F.when(one, OPEN).otherwise(MANY).alias("state")).unionByName(held.select("g", "v", F.lit(None).cast(dict(left.dtypes)["src"]).alias("to"), F.lit(HELD).alias("state")))
        nodes, n = stored_with_count(nodes, "nodes", F.col("state") == OPEN)
        before = None
        while n and n != before:  # a round that ends no pointer has only circles left
            nodes, (n, before) = (x := stored_with_count(_doubled(nodes), "nodes", F.col("state") == OPEN))[0], (x[1], n)
        levels.append(nodes.where(F.col("state") == TIED).select("g", "v", "to"))
        held = nodes.where(F.col("state") == HELD).select("g", "v")
        ends = nodes.where(F.col("state") == MANY).select("g", F.col("v").alias("dst"))
        known = nodes.where(F.col("state") != OPEN).select("g", F.col("v").alias("src"), F.when(F.col("state") != HELD, F.coalesce("to", "v")).alias("from"))
        short, hits = stored_with_count(left.join(ends, ["g", "dst"]).join(known, ["g", "src"]).select("g", "from", "dst").distinct(), "edges", F.col("from").isNull())
        if not hits:
            break
        new = short.where("from IS NULL").select("g", F.col("dst").alias("v"))
        held = stored(held.unionByName(new), "held")
        left = short.where("from IS NOT NULL AND from <> dst").select("g", F.col("from").alias("src"), "dst").join(new.withColumnRenamed("v", "dst"), ["g", "dst"], "left_anti")
    for tied in reversed(levels):
        held = held.unionByName(tied.join(held.withColumnRenamed("v", "to"), ["g", "to"]).select("g", "v"))
    return held

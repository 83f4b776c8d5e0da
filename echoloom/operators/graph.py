"""Connected components over an edge table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.runtime import drop_path, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``; ``component`` is the smallest node it holds.

    Alternates the large-star and small-star rewirings, so the number of rounds is logarithmic in
    the longest path. A node's least neighbour is a grouped minimum, reduced before the shuffle and joined
    back, so no task has to hold a hub's neighbourhood; the join's skewed keys are split by adaptive
    execution. Each round is written to the shared folder. Null ends and self links are ignored (a node that
    only links to itself is its own component). An empty edge table gives an empty result. Raises
    ``RuntimeError`` when ``max_rounds`` don't suffice, rather than give half a result.
    """
    spark = edges.sparkSession
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct()
    nodes_only = raw.where("u = v").select(F.col("u").alias("node"))
    cur, path = materialize(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        # every node goes to its least neighbour, and so do its other neighbours
        nxt = mins.select("u", F.col("m").alias("v")).union(large.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        nxt, new_path = materialize(nxt)
        mark = nxt.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).alias("h")).first()
        drop_path(spark, path)
        cur, path = nxt, new_path
        if before == (mark["n"], mark["h"]):
            break
        before = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    # every edge is now (node, root); roots themselves appear only on the right
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = nodes_only.select("node", F.col("node").alias("component"))
    return found.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmix.llm.common import discard, save


#: Hubs of a round, at most.
HUBS = 4096


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v long), root being the component's smallest node; saved.

    Each round moves every neighbour of a node to the smallest one it sees; only two sums reach the driver. The
    stars are partial aggregates and joins on the node. A hub, a node with more than a ``HUBS``-th of the edges' ends,
    meets its edges by broadcast, so its rows stay where they are read. What a round read is deleted after it.
    """
    edges = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, count = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        hubs = F.broadcast(least.where(F.col("n") * HUBS > 2 * count).drop("n"))  # fewer than HUBS
        far = both.where("v > u")
        met = far.join(hubs, "u").unionByName(far.join(hubs, "u", "left_anti").join(least.drop("n"), "u"))
        large = save(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, save(small)
        discard(old, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    # Edges are stars now: from each node to the root.
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._saved_at = edges._saved_at
    return out

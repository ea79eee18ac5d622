"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round replaces edges by edges to smaller numbers: first each node's larger neighbours are tied to the smallest
node it knows, then its smaller ones. Only minima per node are gathered, so a node with very many edges is a skewed
join key, never a group in memory. Rounds are written to the checkpoint folder; their number grows with the logarithm
of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grainmill.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b), both bigint; root is the component's smallest node.

    Loops, repeated and reversed edges do no harm. An empty table gives no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())

"""Connected components of a large graph, by iterated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.sizing import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that links lead to, for all nodes of ``edges``.

    ``edges`` has two columns ``a`` and ``b`` of one sortable type. Each round links, for
    every node, its larger neighbours to its smallest (large star), then its smaller ones
    (small star), until neither moves a link; the number of rounds grows with the logarithm of
    the number of nodes. A node with very many links is grouped by a minimum, which is taken
    before the shuffle, and its links are joined, not collected. A round has five shuffles.
    """
    known = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    pairs = known.filter(F.col("a") != F.col("b"))
    while True:
        # large star: of the neighbours of a node, the larger ones go to its smallest
        around = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("link"))
        least = around.groupBy(F.col("link.a").alias("node")).agg(F.min("link.b").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = pairs.join(least, F.col("b") == F.col("node")).select(
            "a", F.col("least").alias("b"), (F.col("least") != F.col("b")).alias("moved"))
        # small star: the smaller neighbours of a node, and itself, go to its smallest
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        other = F.col("b") != F.col("least")
        small = large.join(low, F.col("a") == F.col("node")).select(
            F.when(other, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("least").alias("b"),
            (F.col("moved") | other).alias("moved"))
        following = stored(small.groupBy("a", "b").agg(F.max("moved").alias("moved")))
        pairs = following.select("a", "b")
        # where nothing moved, every link led to the smallest already
        if following.filter("moved").isEmpty():
            break
    # a node whose only link is to itself is in no pair
    places = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "b"), F.struct(F.col("b").alias("node"), "b"))).alias("at"))
    alone = known.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"), "b")
    return places.select("at.*").unionByName(alone).groupBy("node").agg(F.min("b").alias("component"))

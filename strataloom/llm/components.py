"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_unique


def _least(edges: DataFrame) -> DataFrame:
    """u and m: the least of u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node and label (the least node it is linked with, itself included) for every node of edges (columns a and b).

    Alternates large stars (each node sends its larger neighbours to its least one) and small stars (each node sends
    its smaller neighbours and itself to the least) until no edge changes: logarithmically many rounds. Each is a
    pre-aggregated minimum and a join that broadcasts the minima of nodes with many edges, so that no task gets all of
    these; each round's edges go to the shared folder. Only a count and a checksum come to the driver.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_unique(both, _least(both), "u", 2 * n).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        small = join_unique(large, _least(large), "u", n)
        now = checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark, n = tuple(seen), seen[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

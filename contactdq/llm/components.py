"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a pair of grouped minima (partly aggregated before the shuffle, so a hub costs one row for each task) and
a join on the node (whose skewed partitions Spark splits). The edges of every round are written to the shared folder, and deleted once those of
the next one are there; the last ones stay, as the result reads them.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import Scratch


def components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Loops, repeated edges and rows with a null end count for nothing. No edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    scratch = Scratch(edges.sparkSession)
    now = scratch.keep(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, scratch.keep(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(old)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: equal before and after a round once every tree is a star."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (row["n"], row["h"])

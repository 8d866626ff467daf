"""Connected components of an edge table, by alternating star contractions.

Each round joins every node's neighbours to the smallest one (first the larger
neighbours, then the smaller ones); the number of rounds grows with the
logarithm of the longest chain. Every step writes its table to the shared
folder; both sides of each join are read from files, so Spark can split the
rows of a node that has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)`` that isn't its component's smallest.

    The label is the component's smallest node. Loops and repeated edges do no harm.
    """
    edge = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not edge.isEmpty():
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # larger neighbours go to the smallest neighbour
        large = stored(edge.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # smaller neighbours do too
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edge = stored(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        # done when only stars are left: no node has two centres or is both a leaf and a centre
        leaves = edge.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if leaves.filter("n > 1").isEmpty() and edge.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return edge.select(F.col("u").alias("node"), F.col("v").alias("label"))

"""Digests of a table by key range, with inner nodes: a version's name, and what two versions differ in.

Leaves are ranges of ``width`` keys; a leaf's digest is that of its rows in any order
(``table_digest``'s sums). ``FAN`` neighbouring nodes make one of the level above, up to a
single node (two where keys have both signs), whose digest names the version. The levels are stored as parts of one table, so a
comparison reads the top first and of each lower level only what lies under nodes that differ:
what two versions have in common is never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deeptime.sources.model_io import row_sums
from deeptime.sources.scratch import small, written

FAN = 16
NODE = "node long, n long, digest string, level int"


def write(df: DataFrame, key: Column, width: int, path: str) -> None:
    """Write the tree over ``df`` by whole-number ``key``; an existing one is never overwritten. Null keys form no range and are refused."""
    if not df.filter(key.isNull()).isEmpty():
        raise ValueError("rows without a key")
    leaves = row_sums(df.withColumn("_node", F.floor(key / width)), "_node").withColumnRenamed("_node", "node")
    nodes, level = written(leaves.select("node", "n", "digest"), "digest-leaves"), 0
    while True:
        nodes.repartitionByRange("node").sortWithinPartitions("node").write.mode("errorifexists").parquet(f"{path}/level={level}")
        if nodes.filter("node NOT IN (0, -1)").isEmpty():
            return
        child = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FAN at most
        up = nodes.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.to_json(child).cast("binary"), 256).alias("digest"))
        nodes, level = written(up.select(F.col("up").alias("node"), "n", "digest"), "digest-nodes"), level + 1
        if level > 16:
            raise ValueError("more than 16 levels")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def height(spark: SparkSession, path: str) -> int:
    return read(spark, path).agg(F.max("level")).first()[0]


def version(spark: SparkSession, path: str) -> str:
    """The version's name: the digest of the top nodes (there are two where keys have both signs)."""
    top = read(spark, path).filter(F.col("level") == height(spark, path)).orderBy("node").collect()
    return "v-" + spark.range(1).select(F.sha2(F.lit(",".join(r.digest for r in top)).cast("binary"), 256)).first()[0][:16]


def changed_ranges(spark: SparkSession, before: str, after: str, width: int) -> DataFrame:
    """``lo, hi, change``: the leaf ranges (``hi`` exclusive) in which two trees of one width differ: changed, added or removed."""
    levels = max(height(spark, before), height(spark, after))
    tops = {p: height(spark, p) for p in (before, after)}

    def level(path, k):
        # a lower tree's top stands for itself at the levels above it
        return read(spark, path).filter(F.col("level") == min(k, tops[path])).select("node", "digest")

    under = None
    for k in range(levels, -1, -1):
        a, b = level(before, k).withColumnRenamed("digest", "a"), level(after, k).withColumnRenamed("digest", "b")
        if under is not None and k < min(tops.values()):
            a, b = (x.join(small(under), F.floor(x["node"] / FAN) == F.col("up"), "left_semi") for x in (a, b))
        met = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        found = written(met, "differing-nodes")
        under = found.select(F.col("node").alias("up"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return found.select((F.col("node") * width).alias("lo"), ((F.col("node") + 1) * width).alias("hi"), change.alias("change"))

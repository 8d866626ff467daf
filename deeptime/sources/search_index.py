"""Stored inverted index over the tokens of slugs, and prefix search on it.

An entity is entered under the first two and the first three letters of each of its
tokens, with its rank among the entries of those letters. The index is partitioned by
shard (the first letter) and band of ranks, and sorted by letters and rank, so a
search reads the shards of its queries (dynamic partition pruning), of these the first
band, and of its files the row groups whose letters can match. Queries that this
leaves short of hits read the next band: a beginning that every name has costs a
query ``BANDS[0]`` rows, unless few of them match its other words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deeptime.functions import text as X
from deeptime.operators.model import ranked_within
from deeptime.sources.scratch import small, written

#: Last ranks of the bands but the last one.
BANDS = (64, 4096)
START = 3
#: Distinct beginnings up to which a search names them in its filter.
NAMED = 200
ENTRY = "start string, pos int, slug string, importance double, have array<string>, shard string, band int"


def write(entities: DataFrame, path: str) -> None:
    """Write the index of ``entities(slug, importance)``; an existing one is never overwritten."""
    e = entities.select("slug", "importance", F.split("slug", "-").alias("have"))
    begins = F.array_distinct(F.flatten(F.transform("have", lambda h: F.transform(F.sequence(F.lit(2), F.lit(START)), lambda n: F.substr(h, F.lit(1), n)))))
    rows = e.withColumn("start", F.explode(F.filter(begins, lambda b: F.length(b) >= 2)))
    ranked = ranked_within(rows, "start", [F.desc("importance"), F.asc("slug")])
    band = F.lit(len(BANDS))
    for k, last in reversed(list(enumerate(BANDS))):
        band = F.when(F.col("pos") <= last, k).otherwise(band)
    entries = ranked.select("start", "pos", "slug", "importance", "have", F.substring("start", 1, 1).alias("shard"), band.alias("band"))
    order = ["shard", "band", "start", "pos"]
    # ``ranked`` is read from tables that are cut by ranges of ``start`` and rank, so a task has few shards
    entries.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("shard", "band").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(path)


def asked(queries: DataFrame) -> DataFrame:
    """``query_id, wanted, start, shard`` of queries ``(query_id, query)`` with a token of two letters or more; ``start`` is that of the longest."""
    tokens = F.filter(F.split(X.slugify(F.col("query")), "-"), lambda x: F.length(x) >= 2)
    longest = F.array_max(F.transform("wanted", lambda x: F.struct(F.length(x).alias("size"), x.alias("token"))))["token"]
    q = queries.select("query_id", tokens.alias("wanted")).filter(F.size("wanted") > 0)
    return q.withColumn("start", F.substring(longest, 1, START)).withColumn("shard", F.substring("start", 1, 1))


def entries_for(index: DataFrame, queries: DataFrame, band: int) -> DataFrame:
    """Entries of one band under the beginnings of ``asked`` queries, joined with these."""
    starts = [r.start for r in queries.select("start").distinct().limit(NAMED + 1).collect()]
    part = index.filter(F.col("band") == band)
    part = part.filter(F.col("start").isin(starts)) if len(starts) <= NAMED else part
    return part.join(small(queries.filter("length(start) >= 2")), ["shard", "start"])


def search(spark: SparkSession, path: str, queries: DataFrame, top: int = 8) -> DataFrame:
    """``query_id, pos, slug``: the most important entities whose tokens begin with every token of a query."""
    hit = F.forall("wanted", lambda w: F.exists("have", lambda h: h.startswith(w)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("importance"), "slug"))
    index, left, found = read(spark, path), written(asked(queries), "asked"), None
    for band in range(len(BANDS) + 1):
        hits = entries_for(index, left, band).filter(hit).select("query_id", "slug", "importance")
        hits = written(hits.withColumn("pos", place).filter(F.col("pos") <= top).drop("pos"), "hits")
        found = hits if found is None else found.unionByName(hits)
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= top)
        left = written(left.join(full, "query_id", "left_anti"), "asked")
        if left.isEmpty():
            break
    return found.withColumn("pos", place).filter(F.col("pos") <= top).select("query_id", "pos", "slug")

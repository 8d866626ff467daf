"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced
to one row per digest, sort-merge anti-joined with the index, and what is new is
appended, so later batches are compared with digests alone, never with texts.

Each batch has a name, under which its digests are appended. A batch that runs again
under its name, after a failure or by mistake, gives the verdicts that it gave before:
it isn't held against itself, and digests that were appended twice are read once.

Defined cases: a null text equals the empty text; texts are equal when they are
identical after lower-casing A-Z; of equal texts the row with the largest
``doc_id`` stays (a null id only where no other is there); rows that repeat an
id and a text are one row given twice and share their verdict, but ``keep_first``
judges by row and leaves one of them; an empty batch
gives an empty result; a very long text is hashed whole in one task; columns beyond
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deeptime.llm.common import ROW, ascii_lower, broadcast_if_small, fresh_path, keyed, stored

#: Row keys up to this number (16 MB) are broadcast, so that no text is shuffled.
BROADCAST_ROWS = 1_000_000


class DigestIndex:
    """Persistent set of digests with the id that represents each of them."""

    SCHEMA = "text_sha256 string, keep_id long, batch string"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or fresh_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self, besides: str | None = None) -> DataFrame:
        """``text_sha256, keep_id`` of every digest; without those of the batch ``besides``."""
        rows = self.spark.table(self.table)
        rows = rows if besides is None else rows.filter(F.col("batch") != besides)
        # the table's buckets are the groups' partitions: nothing is shuffled
        return rows.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"))

    def missing(self, groups: DataFrame, batch: str) -> DataFrame:
        """Rows of ``groups`` whose digest no other batch of the index has (sort-merge anti-join)."""
        return groups.join(self.read(batch).hint("merge"), "text_sha256", "left_anti")

    def append(self, fresh: DataFrame, batch: str) -> None:
        (
            fresh.select("text_sha256", "keep_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "text_sha256")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(self.table, path=self.path)
        )
        self.spark.catalog.refreshTable(self.table)


def digests(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.sha2(ascii_lower(F.col("text")).cast("binary"), 256).alias("text_sha256"))


def _resolve(rows: DataFrame, index: DigestIndex, batch: str | None) -> DataFrame:
    """``text_sha256, keep_id, group_size, is_new`` of each digest of ``rows``; new ones are added to ``index`` (stored)."""
    groups = stored(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    batch = batch or uuid.uuid4().hex
    fresh = stored(index.missing(groups, batch), "fresh-digests")
    index.append(fresh, batch)
    older = groups.join(fresh.select("text_sha256"), "text_sha256", "left_anti").drop("keep_id").join(index.read(batch), "text_sha256")
    return stored(fresh.withColumn("is_new", F.lit(True)).unionByName(older.withColumn("is_new", F.lit(False)).select("text_sha256", "keep_id", "group_size", "is_new")), "digest-keepers")


def ingest(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Deduplicate ``docs`` within themselves and against ``index``; add what is new under the name ``batch``.

    Returns one row per document: ``doc_id, keep_id, group_size, kept,
    text_sha256``. ``group_size`` counts the batch's rows. A digest that the
    index had before keeps its id, so none of the batch's rows stays.
    """
    rows = stored(digests(docs), "digests")
    resolved = _resolve(rows, index, batch)
    # both sides are read from files, so the join shuffles both and a hot digest can be split
    return rows.join(resolved, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """``docs`` without the rows that repeat an earlier or larger-id text; columns unchanged."""
    given = keyed(docs)
    rows = stored(digests(given, ROW), "digests")
    new = _resolve(rows, index or DigestIndex(docs.sparkSession), batch).filter("is_new").select("text_sha256")
    first = rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", ROW)).alias("first"))
    kept = stored(first.join(new, "text_sha256", "left_semi").select(F.col(f"first.{ROW}").alias("__deeptime_kept")), "kept-rows")
    dropped = stored(rows.join(kept, F.col(ROW) == F.col("__deeptime_kept"), "left_anti").select(F.col(ROW).alias("__deeptime_out")), "dropped-rows")
    return given.join(broadcast_if_small(dropped, BROADCAST_ROWS), F.col(ROW) == F.col("__deeptime_out"), "left_anti").drop(ROW)


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

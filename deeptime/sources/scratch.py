"""Intermediate tables in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is broadcast at most.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


def fresh(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under a temporary folder where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="deeptime-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage; packed well, as these tables lie on disk until the end."""
    path = fresh(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a bounded look at it shows few rows and few bytes; else Spark chooses."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    seen = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if seen.n <= SMALL_ROWS and seen.size <= SMALL_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to as many tasks as the session has room for; for rows of few bytes and much work.

    Spark cuts files into tasks by bytes, so a small file of a million keys would be one task's
    work, whatever is made of them. The number is given, so adaptive execution joins none of them.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Within it, tasks get ``n`` rows in an Arrow batch; for rows that hold long lists."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)

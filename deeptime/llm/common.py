"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine (as in tests)
    a local folder is made and remembered for the application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="deeptime-")
        found = _OWN[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so nothing before this point runs again, and lets joins
    on the result shuffle both sides, which is what adaptive skew splitting needs.
    Packed well, as these tables lie on disk until the end, but for those that are ``discarded``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more: all that was made of it is stored itself."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Within it, tasks get ``n`` rows in an Arrow batch; for rows that hold large values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Name of the row key that stages add, where ids may be null or repeat.
ROW = "__deeptime_row"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for each row (16 bytes).

    Rows of a plain file scan are known by their file and their place in it, so
    nothing is copied; any other frame is written once, so that its rows and
    keys stay the same however often they are read.
    """
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs.inputFiles():
        place = F.col("_metadata.row_index")
        return docs.withColumn(ROW, F.unhex(F.concat(part(F.xxhash64(F.col("_metadata.file_path"))), part(place))))
    return stored(docs.withColumn(ROW, F.unhex(part(F.monotonically_increasing_id()))), "keyed-rows")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5 is 0; a null id counts as an empty text."""
    return (F.crc32(id_text(col).cast("binary")) % 5) == 0


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_share(col: str, share: float) -> Column:
    """True for about ``share`` of the ids, always the same ones."""
    return (F.pmod(F.xxhash64(id_text(col)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))


#: Fixed character class: ASCII other than digits and lower-case letters; texts are lower-cased before.
BREAK = r"[\x00-/:-`{-\x7f]+"


def words(text: Column) -> Column:
    """Lower-case maximal runs of characters other than ASCII punctuation and white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (which is stored), to be broadcast if it has ``limit`` rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

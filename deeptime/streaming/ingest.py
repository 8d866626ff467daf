"""Incremental ingest of arriving parts: the model, repeated ids, running counters and a merged census.

Each stream reads a folder of arriving files, works batch by batch and can be
drained with ``trigger(availableNow=True)``. A batch writes under its own number,
so a batch that runs again after a failure replaces what it wrote.

Ids are stored by hash buckets. A batch reads the buckets of its own ids, of these the
row groups that can hold them, and writes to no others. Counters are kept as partial
rows by level: ``FAN`` parts of a level become one of the next, so reading takes fewer
than ``FAN`` parts of each level however many batches there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deeptime.operators import model as M
from deeptime.sources import records as R
from deeptime.sources.scratch import written

#: Buckets of the id store.
BUCKETS = 32
#: Parts of a level that become one of the next.
FAN = 8
#: Bytes of arriving record files that make a batch.
BATCH_BYTES = 256 << 20


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def known_ids(spark: SparkSession, path: str, batch: int, ids: DataFrame, key: str) -> DataFrame:
    """The ``key`` values that earlier batches stored, from the buckets of ``ids(key, bucket)`` alone."""
    if not _exists(spark, path):
        return ids.select(key).limit(0)
    buckets = [r.bucket for r in ids.select("bucket").distinct().collect()]  # BUCKETS at most
    stored = spark.read.parquet(path)
    return stored.filter(F.col("bucket").isin(buckets) & (F.col("batch") < batch)).select(key)


def _with_bucket(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def store_ids(ids: DataFrame, path: str, batch: int, key: str) -> None:
    """Add a batch's ``ids(key, bucket)``; a batch that runs again replaces its own."""
    rows = ids.select(key, "bucket", F.lit(batch).alias("batch")).repartition("bucket").sortWithinPartitions("bucket", key)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "id"):
    """Append arriving rows to ``target/rows``; ids met before go to ``target/repeats`` instead."""

    def batch(df: DataFrame, n: int):
        df = written(_with_bucket(df, key), "arrived")
        s = df.sparkSession
        first = df.dropDuplicates([key])
        fresh = written(first.join(known_ids(s, f"{target}/ids", n, df, key), key, "left_anti").select(*df.columns), "fresh")
        met = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(fresh.select(key, F.lit(1).alias("one")), key, "left")
        repeats = met.select(key, (F.col("n") - F.coalesce("one", F.lit(0))).alias("n")).filter("n > 0")
        for rows, name in ((fresh.drop("bucket"), "rows"), (repeats, "repeats")):
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={n}")
        store_ids(fresh, f"{target}/ids", n, key)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RepeatedIds(ValueError):
    """Ids that arrived before."""


def ingest_records(spark: SparkSession, source: str, target: str, checkpoint: str, fatal: bool = True, files: int | None = None, name=None):
    """Parts of newline-delimited records into the model's tables under ``target``.

    Lines are numbered, parsed, normalized and validated as in a batch import; what fails
    goes to ``target/rejects`` with its file, line and reason. An id that any part gave
    before ends the stream with ``RepeatedIds`` before the batch writes anything, or
    is one more reject where ``fatal`` is off. ``name`` makes a file's name from its path (``_path``).
    A batch takes ``BATCH_BYTES`` of files, however many that are, or ``files`` of them where that is given.
    """
    file = F.element_at(F.split("_path", "/"), -1) if name is None else name

    def batch(df: DataFrame, n: int):
        s = df.sparkSession
        lines = R.number_lines(df.select(file.alias("file"), "_path", "_block", F.monotonically_increasing_id().alias("_at"), "value"))
        rows = R.normalized(R.parsed_lines(lines, comments=True))
        reason = F.coalesce("fault", M.reject_reason(F.col("categories"), F.col("rel"), F.col("props")))
        rows = written(_with_bucket(rows.withColumn("reason", reason).drop("fault"), "seed_id"), "arrived")
        sound = rows.filter("reason IS NULL")
        nth = F.row_number().over(Window.partitionBy("seed_id").orderBy("file", "line"))
        known = known_ids(s, f"{target}/ids", n, sound, "seed_id").withColumn("_known", F.lit(True))
        judged = written(sound.withColumn("_nth", nth).join(known, "seed_id", "left"), "judged")
        again = (F.col("_nth") > 1) | F.col("_known").isNotNull()
        repeats = judged.filter(again)
        if fatal:
            found = [f"{r.seed_id} ({r.file} line {r.line})" for r in repeats.limit(5).collect()]
            if found:
                raise RepeatedIds("ids that arrived before: " + ", ".join(found))
        fresh = judged.filter(~again).drop("_nth", "_known", "reason")
        rejects = rows.filter("reason IS NOT NULL").select("file", "line", "reason").unionByName(repeats.select("file", "line", F.lit("repeated id").alias("reason")))
        part = lambda array, what: fresh.select("seed_id", F.posexplode(array).alias("ord", "x")).select("seed_id", "ord", *what)
        tables = {
            "entity": fresh.drop("bucket", "categories", "rel", "props"),
            "entity_category": part("categories", [F.col("x").alias("category")]),
            "relationship": part("rel", ["x.type", "x.target"]),
            "claim": part("props", ["x.*"]),
            "rejects": rejects,
        }
        for table, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{target}/{table}/batch={n}")
        store_ids(fresh, f"{target}/ids", n, "seed_id")

    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]
    bound = ("maxBytesPerTrigger", str(BATCH_BYTES)) if files is None else ("maxFilesPerTrigger", files)
    # with its schema given, the folder is not listed an extra time
    stream = spark.readStream.format("text").schema("value string").option(*bound).option("recursiveFileLookup", True).load(source).select("value", *place)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_model(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The model's tables from all batches, entities numbered by file and line."""
    read = lambda name: spark.read.parquet(f"{target}/{name}").drop("batch")
    entity = M.ranked_within(read("entity").withColumn("_all", F.lit(0)), "_all", [F.asc("file"), F.asc("line")])
    entity = entity.withColumn("input_order", F.col("pos") - 1).drop("_all", "pos")
    return {"entity": entity, **{name: read(name) for name in ("entity_category", "relationship", "claim")}}


def count_by(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]):
    """Running counters by ``keys``, read by ``counters``."""
    return keep_sums(spark, source, schema, target, checkpoint, lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def counters(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return sums(spark, target, keys)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))


def live_parts(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """``(level, part)`` of the parts that hold the first ``batches`` batches: the digits of their number, each batch once."""
    out, level, step = [], 0, 1
    while step <= batches:
        upper = batches // (step * fan) * fan
        out += [(level, k) for k in range(upper, batches // step)]
        level, step = level + 1, step * fan
    return out


def keep_sums(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, partial, keys: list[str]):
    """Keep sums of ``partial(batch)`` by ``keys``, a census for instance; every other column of it is added up."""

    def path(level: int, part: int) -> str:
        return f"{target}/level={level}/part={part}"

    def batch(df: DataFrame, n: int):
        s = df.sparkSession
        partial(df).write.mode("overwrite").parquet(path(0, n))
        level, done = 0, n + 1
        while done % FAN == 0:  # the last FAN parts of a level become one of the next
            done //= FAN
            parts = s.read.parquet(*(path(level, k) for k in range((done - 1) * FAN, done * FAN)))
            _summed(parts, keys).write.mode("overwrite").parquet(path(level + 1, done - 1))
            level += 1
        # what readers go by is written last
        s.createDataFrame([(n + 1,)], "batches long").coalesce(1).write.mode("append").parquet(f"{target}/head")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sums(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The sums that ``keep_sums`` keeps, from the live parts."""
    batches = spark.read.parquet(f"{target}/head").agg(F.max("batches")).first()[0]
    return _summed(spark.read.parquet(*(f"{target}/level={level}/part={k}" for level, k in live_parts(batches))), keys)

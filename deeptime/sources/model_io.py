"""Normalized model as four ordered Parquet tables, rejects, published documents and releases."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deeptime.functions import time as T
from deeptime.operators.model import child_counts, missing_targets, order_gaps
from deeptime.sources.scratch import small, written

KEYS = {"entity": ["input_order"], "entity_category": ["seed_id", "ord"], "relationship": ["seed_id", "ord"], "claim": ["seed_id", "ord"]}


def write_model(path: str, **tables: DataFrame) -> None:
    """Write the tables, each globally ordered; an existing table is never overwritten, and rows that are bucketized already are refused."""
    if bucketed := {"bucket_min", "bucket_max"}.intersection(tables["entity"].columns):
        raise ValueError(f"entity rows are bucketized already: {', '.join(sorted(bucketed))}")
    for name, key in KEYS.items():
        tables[name].repartitionByRange(*key).sortWithinPartitions(*key).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in KEYS}


def model_faults(entity: DataFrame, entity_category: DataFrame, relationship: DataFrame, claim: DataFrame) -> DataFrame:
    """Everything against a model's integrity as ``(fault, id)`` rows; none in a sound model."""
    ids = entity.select("seed_id")
    row = lambda df, fault, col: df.select(F.lit(fault).alias("fault"), F.col(col).cast("string").alias("id"))
    twice = lambda c: entity.groupBy(c).count().filter("count > 1")
    half = entity.filter(F.col("lon").isNull() != F.col("lat").isNull())
    shape = claim.filter(F.col("value").isNull() & (F.col("min").isNull() | F.col("max").isNull()))
    parts = [row(twice("seed_id"), "repeated id", "seed_id"), row(twice("input_order"), "repeated order", "input_order"), row(half, "half a point", "seed_id"), row(shape, "claim shape", "seed_id"), row(missing_targets(relationship, entity), "missing target", "seed_id")]
    span = entity.agg(F.count(F.lit(1)).alias("n"), F.min("input_order").alias("least"), F.max("input_order").alias("most"))
    missing = (F.col("most") - F.col("least") + 1 - F.col("n")).alias("missing")
    parts.append(row(span.select(missing).filter("missing > 0"), "order has gaps", "missing"))
    if "slug" in entity.columns:
        parts.append(row(twice("slug").filter("slug IS NOT NULL"), "repeated slug", "slug"))
    if "child_count" in entity.columns:
        actual = child_counts(relationship).withColumnRenamed("child_count", "actual")
        differ = F.coalesce("child_count", F.lit(0)) != F.coalesce("actual", F.lit(0))
        parts.append(row(entity.join(actual, "seed_id", "left").filter(differ), "child count", "seed_id"))
    for name, df in (("entity_category", entity_category), ("relationship", relationship), ("claim", claim)):
        parts.append(row(df.join(ids, "seed_id", "left_anti"), f"orphan {name}", "seed_id"))
        parts.append(row(order_gaps(df, ["seed_id"], "ord"), f"order of {name}", "seed_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Rejects ordered by source, file, line and reason; duplicates stay, an empty table is written too."""
    order = [c for c in ("source", "file", "line", "reason") if c in rejects.columns]
    rejects.orderBy(*order).write.mode("errorifexists").parquet(path)


def write_report(report: DataFrame, path: str, order: list[str]) -> None:
    """Write a report in the order of ``order`` and then of its other columns, so that equal reports are equal files."""
    rest = [c for c in report.columns if c not in order]
    report.orderBy(*order, *rest).write.mode("errorifexists").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report with ``pos``, the place of each row in the order in which it was written, from 1."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # a row for each file
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(small(sizes.select("_file", before.alias("_before"))), "_file").withColumn("pos", F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


def publish_plan(documents: DataFrame, published: DataFrame) -> DataFrame:
    """``key, status`` of documents ``(key, body)`` against the published index ``(key, md5)``."""
    now = documents.select("key", F.md5(F.col("body").cast("binary")).alias("new"))
    j = now.join(published, "key", "full_outer")
    status = F.when(F.col("new").isNull(), "removed").when(F.col("md5") == F.col("new"), "unchanged").otherwise("written")
    return j.select("key", status.alias("status"), "new")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


POINTER = "seq long, version string, release string"
INDEX = "key string, md5 string, version string"
#: Versions whose documents a release may still refer to; beyond, all documents are written anew.
MOST_VERSIONS = 8


def pointer(spark: SparkSession, root: str):
    """The current ``(seq, version, release)`` of what is published under ``root``; None before the first."""
    return _table(spark, f"{root}/pointer", POINTER).orderBy(F.desc("seq"), "version").first()


def _point(spark: SparkSession, root: str, seq: int, version: str, release: str) -> None:
    """Put a version in force. Of two writers that took the same number the one with the smaller version wins."""
    spark.createDataFrame([(seq, version, release)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    rival = _table(spark, f"{root}/pointer", POINTER).filter((F.col("seq") == seq) & (F.col("version") < version)).first()
    if rival is not None:
        raise RuntimeError(f"release {rival.release} was put in force meanwhile")


def index(spark: SparkSession, root: str, version: str | None) -> DataFrame:
    """Index ``(key, md5, version)`` of a published version; ``version`` of a row is the one that wrote its body."""
    return spark.read.schema(INDEX).parquet(f"{root}/index/{version}") if version is not None else spark.createDataFrame([], INDEX)


def publish(documents: DataFrame, root: str) -> DataFrame:
    """Publish ``documents(key, body)`` under ``root``; returns the stored plan ``(key, status)``.

    What changed is written, then the whole index, and last the pointer to it.
    Each attempt has folders of its own, so one that fails before the pointer
    leaves the former release in force and is in nobody's way. The release's name is
    a digest of keys and contents: equal documents give the same release. Repeated
    or null keys are refused.
    """
    spark = documents.sparkSession
    now, version = pointer(spark, root), uuid.uuid4().hex
    before = index(spark, root, now.version if now else None)
    plan = written(publish_plan(documents, before.select("key", "md5")), "publish-plan")
    bad = [r.key for r in plan.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR key IS NULL").limit(5).collect()]
    if bad:
        raise ValueError(f"repeated or null keys, such as {bad}")
    kept = before.join(plan.filter("status = 'unchanged'").select("key"), "key", "left_semi").select("key", "md5", "version")
    crowded = kept.select("version").distinct().limit(MOST_VERSIONS).count() == MOST_VERSIONS
    mine = plan.filter("status <> 'removed'") if crowded else plan.filter("status = 'written'")
    documents.join(mine.select("key"), "key", "left_semi").select("key", "body").write.mode("errorifexists").parquet(f"{root}/documents/{version}")
    fresh = mine.select("key", F.col("new").alias("md5"), F.lit(version).alias("version"))
    (fresh if crowded else kept.unionByName(fresh)).write.mode("errorifexists").parquet(f"{root}/index/{version}")
    release = table_digest(index(spark, root, version).select("key", "md5")).first().digest
    _point(spark, root, now.seq + 1 if now else 0, version, release)
    return plan.select("key", "status")


def published(spark: SparkSession, root: str) -> DataFrame:
    """``key, body`` of the release in force."""
    rows = index(spark, root, pointer(spark, root).version)
    bodies = None
    # MOST_VERSIONS at most
    for v in sorted(r.version for r in rows.select("version").distinct().collect()):
        part = spark.read.schema("key string, body string").parquet(f"{root}/documents/{v}").withColumn("version", F.lit(v))
        bodies = part if bodies is None else bodies.unionByName(part)
    return bodies.join(rows.select("key", "version"), ["key", "version"], "left_semi").select("key", "body") if bodies is not None else spark.createDataFrame([], "key string, body string")


def roll_back(spark: SparkSession, root: str, release: str) -> None:
    """Put an earlier release in force again; nothing but the pointer is written."""
    found = _table(spark, f"{root}/pointer", POINTER).filter(F.col("release") == release).orderBy(F.desc("seq")).first()
    if found is None:
        raise ValueError(f"no release {release}")
    _point(spark, root, pointer(spark, root).seq + 1, found.version, release)


def row_sums(df: DataFrame, *group: str) -> DataFrame:
    """``n, digest`` of the rows of each group, the same for any order or partitioning of the rows.

    Row digests are summed in exact decimals by quarters, so nothing is collected.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in group)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    quarter = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"q{k}")
    g = df.select(*group, h.alias("h")).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *map(quarter, range(4)))
    return g.select(*group, "n", F.sha2(F.concat_ws(",", "n", *(F.col(f"q{k}").cast("string") for k in range(4))).cast("binary"), 256).alias("digest"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row ``(n, digest)`` of a whole table."""
    return row_sums(df)


def release_faults(advertised: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Keys that only one of manifest and artifact index has."""
    missing = advertised.join(artifacts, "key", "left_anti").select("key", F.lit("missing").alias("fault"))
    return missing.unionByName(artifacts.join(advertised, "key", "left_anti").select("key", F.lit("not advertised").alias("fault")))


def golden_faults(views: DataFrame, chunks: DataFrame) -> DataFrame:
    """Failures of expected views ``(name, bucket, win, category, include, exclude, min_items, max_items)``.

    ``chunks(bucket, win, category, slug)``: a chunk that is missing, a slug that
    should or should not be there, a count out of bounds.
    """
    keys = ["bucket", "win", "category"]
    got = chunks.join(small(views.select(*keys).distinct()), keys, "left_semi")
    have = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    v = views.join(have, keys, "left")
    fails = v.select("name", F.when(F.col("n").isNull(), "no chunk").when(F.col("n") < F.col("min_items"), "too few").when(F.col("n") > F.col("max_items"), "too many").alias("fault")).filter("fault IS NOT NULL")
    wanted = v.filter("n IS NOT NULL").select("name", *keys, F.explode("include").alias("slug")).join(got, [*keys, "slug"], "left_anti").select("name", F.concat(F.lit("lacks "), "slug").alias("fault"))
    barred = views.select("name", *keys, F.explode("exclude").alias("slug")).join(got, [*keys, "slug"], "left_semi").select("name", F.concat(F.lit("has "), "slug").alias("fault"))
    return fails.unionByName(wanted).unionByName(barred)


def out_of_order(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``file, at``: rows of a written table that lie behind their key's place, within a file or against the files before it.

    Rows are compared within the blocks that the reader splits files into, the first of a
    block with the last of the block before, so no file has to fit a task.
    """
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.row_index").alias("at"), F.struct(*keys).alias("key"))
    rows = written(rows, "placed")
    before = F.lag("key").over(Window.partitionBy("file", "_block").orderBy("at"))
    # a row for each block that has rows, and one for each file
    blocks = written(rows.groupBy("file", "_block").agg(F.min("at").alias("_first"), F.max_by("key", "at").alias("_end"), F.max("key").alias("last")), "blocks")
    ends = F.lag("_end").over(Window.partitionBy("file").orderBy("_first"))
    files = blocks.groupBy("file").agg(F.max("last").alias("last"))
    earlier = files.select("file", F.max("last").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    edges = small(written(blocks.withColumn("end", ends).join(earlier, "file").select("file", "_block", "end", "earlier"), "block-edges"))
    met = rows.withColumn("before", before).join(edges, ["file", "_block"])
    behind = (F.coalesce("before", "end") > F.col("key")) | (F.col("earlier") > F.col("key"))
    return met.filter(behind).select("file", "at")


def resolved_views(views: DataFrame) -> DataFrame:
    """Expected views ``(name, bucket_id, year, ...)`` with their ``bucket`` and ``win``: the window that holds the year, 0 without one; no bucket where the name is none."""
    bucket = F.when(F.col("bucket_id").rlike("^T([0-9]|1[0-3])$"), F.substring("bucket_id", 2, 2).cast("int"))
    win = F.when(F.col("year").isNull(), F.lit(0).cast("bigint")).otherwise(T.window_index(T.year_to_seconds(F.col("year")), T.window_s(F.col("bucket"))))
    return views.withColumn("bucket", bucket).withColumn("win", win)


def release_gate(views: DataFrame, pinned: str, version: str, chunks: DataFrame) -> DataFrame:
    """``name, fault`` of everything that bars a release: views pinned to another seed, unknown buckets, failures of views."""
    if pinned != version:
        return views.sparkSession.createDataFrame([("goldens", f"pinned to {pinned} but the seed is {version}")], "name string, fault string")
    known = resolved_views(views)
    unknown = known.filter("bucket IS NULL").select("name", F.concat(F.lit("unknown bucket "), "bucket_id").alias("fault"))
    return unknown.unionByName(golden_faults(known.filter("bucket IS NOT NULL").drop("bucket_id", "year"), chunks))


def latest_release(releases: DataFrame) -> DataFrame:
    """Newest release of each dataset; earlier ones stay for rollback."""
    w = Window.partitionBy("dataset").orderBy(F.desc("generated_at"), F.desc("version"))
    return releases.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")

"""Semantic zoom: bucketize, explode into cells, rank, compact runs of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deeptime.functions import time as T
from deeptime.functions import vocab as V
from deeptime.sources.scratch import written

CELL = ["bucket", "win", "category"]


def bucketize(entities: DataFrame) -> DataFrame:
    """Adds ``bucket_min`` and ``bucket_max``; null precision labels give nulls."""
    low, high = T.bucket_span(F.col("t0"), F.col("t1"), F.col("precision"), F.col("importance"))
    return entities.withColumn("bucket_min", low.cast("int")).withColumn("bucket_max", high.cast("int"))


def fan_out(bucketed: DataFrame) -> DataFrame:
    """Rows that ``cells`` will make for each bucket, before categories; costs one aggregation, no explode."""
    b = bucketed.select("t0", "t1", F.explode(F.sequence("bucket_min", "bucket_max")).alias("bucket"))
    w = T.window_s(F.col("bucket"))
    n = T.window_index(F.col("t1"), w) - T.window_index(F.col("t0"), w) + 1
    return b.groupBy("bucket").agg(F.sum(n).alias("n_windows"))


def windows(bucketed: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each bucket and window that an entity shows in."""
    b = bucketed.select(*keep, "t0", "t1", F.explode(F.sequence("bucket_min", "bucket_max")).alias("bucket"))
    w = T.window_s(F.col("bucket"))
    b = b.withColumn("win", F.explode(F.sequence(T.window_index(F.col("t0"), w), T.window_index(F.col("t1"), w))))
    return b.drop(*(c for c in ("t0", "t1") if c not in keep))


def topical_cells(bucketed: DataFrame, categories: Column, keep: list[str]) -> DataFrame:
    """One row for each bucket, window and category of its own that an entity shows in."""
    own = bucketed.withColumn("_cats", F.filter(F.array_distinct(categories), lambda c: c != "all"))
    return windows(own, [*keep, "_cats"]).withColumn("category", F.explode("_cats")).drop("_cats")


def all_cells(bucketed: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each bucket and window that an entity shows in, under the category ``all``."""
    return windows(bucketed, keep).withColumn("category", F.lit("all"))


def cells(bucketed: DataFrame, categories: Column, keep: list[str]) -> DataFrame:
    """One row for each bucket, window and category (and ``all``) that an entity shows in."""
    every = bucketed.withColumn("_cats", F.array_distinct(F.concat(categories, F.array(F.lit("all")))))
    return windows(every, [*keep, "_cats"]).withColumn("category", F.explode("_cats")).drop("_cats")


def rank_cells(cell_rows: DataFrame, cap: int = V.CHUNK_CAP) -> DataFrame:
    """First ``cap`` rows of each cell by importance, then slug, numbered from 1.

    Spark limits each group before the shuffle, so a hot cell moves ``cap`` rows for each task.
    """
    return cell_rows.withColumn("rank", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("importance"), "slug"))).filter(F.col("rank") <= cap)


def _walk(rows: DataFrame, cap: int, per_category: int) -> DataFrame:
    """The greedy walk over the rows of each cell, which must be few."""
    item = F.struct((-F.col("importance")).alias("order"), "slug", F.transform("_c", lambda c: F.array_position(F.lit(V.CATEGORIES), c).cast("int")).alias("cats"))
    grouped = rows.groupBy(*CELL).agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = F.struct(F.array_repeat(F.lit(0), len(V.CATEGORIES)).alias("used"), F.array().cast("array<struct<order:double,slug:string>>").alias("taken"))

    def step(s, x):
        full = F.forall(x["cats"], lambda c: F.element_at(s["used"], c) >= per_category)
        used = F.transform(s["used"], lambda u, i: u + F.size(F.filter(x["cats"], lambda c: c == i + 1)))
        taken = F.concat(s["taken"], F.array(F.struct(x["order"].alias("order"), x["slug"].alias("slug"))))
        return F.when((F.size(s["taken"]) >= cap) | full, s).otherwise(F.struct(used.alias("used"), taken.alias("taken")))

    return grouped.select(*CELL, F.size("items").alias("seen"), F.aggregate("items", state, step, lambda s: s["taken"]).alias("taken"))


def diverse_top(cell_rows: DataFrame, categories: Column, cap: int = V.CHUNK_CAP, per_category: int = V.CATEGORY_CAP, prefix: int = 3) -> DataFrame:
    """Greedy top ``cap`` of each cell in which an item is passed over once all its categories are full.

    The walk is tried on the first ``prefix * cap`` rows of each cell; where it
    fills the chunk, the rest can't matter. Only cells that it leaves short are
    walked over the rest, and of items with the same categories no more than
    ``per_category`` can ever be taken, so what is gathered for a cell is bounded
    by the number of category sets, not by the cell's rows.
    """
    rows = cell_rows.withColumn("_c", categories)
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("importance"), "slug"))
    tried = written(_walk(rows.withColumn("_n", rank).filter(F.col("_n") <= prefix * cap), cap, per_category), "diverse")
    short = (F.size("taken") < cap) & (F.col("seen") >= prefix * cap)
    done = tried.filter(~short)
    if not tried.filter(short).isEmpty():
        w = Window.partitionBy(*CELL, F.array_join(F.array_sort("_c"), ",")).orderBy(F.desc("importance"), "slug")
        left = rows.join(tried.filter(short).select(*CELL), CELL, "left_semi")
        done = done.unionByName(_walk(left.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_category), cap, per_category))
    picked = done.select(*CELL, F.posexplode("taken").alias("pos", "x"))
    return picked.select(*CELL, F.col("x.slug").alias("slug"), (-F.col("x.order")).alias("importance"), (F.col("pos") + 1).alias("rank"))


def chunk_bodies(ranked: DataFrame) -> DataFrame:
    """One row per cell: number of items and a digest of its ordered slugs."""
    items = F.array_sort(F.collect_list(F.struct("rank", "slug")))
    return ranked.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(items["slug"], "\n").cast("binary"), 256).alias("body"))


#: Windows that are searched for runs in one group; what touches a group's edge is joined across afterwards.
BLOCK = 4096


def join_runs(rows: DataFrame, group: list[str]) -> DataFrame:
    """Runs of adjoining ``(run_start, run_end)`` with equal bodies within each group; other columns are those of one of the joined rows."""
    w = Window.partitionBy(*group).orderBy("run_start")
    starts = (F.lag("run_end").over(w) + 1 != F.col("run_start")) | (F.lag("body").over(w) != F.col("body"))
    run = rows.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*group, "_run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), *(F.first(c).alias(c) for c in rows.columns if c not in (*group, "run_start", "run_end"))).drop("_run")


def window_runs(bodies: DataFrame) -> DataFrame:
    """Runs of consecutive windows with equal bodies (gaps and islands).

    Windows are searched in blocks, so that the few buckets and categories are
    no bound on the tasks; only runs at the edge of a block, two of each at
    most, are then joined over the whole line.
    """
    block = F.floor(F.col("run_start") / BLOCK)
    lines = bodies.select("bucket", "category", F.col("win").alias("run_start"), F.col("win").alias("run_end"), "n_items", "body")
    parts = written(join_runs(lines.withColumn("_block", block), ["bucket", "category", "_block"]), "run-parts")
    edge = (F.col("run_start") == F.col("_block") * BLOCK) | (F.col("run_end") == (F.col("_block") + 1) * BLOCK - 1)
    return parts.filter(~edge).drop("_block").unionByName(join_runs(parts.filter(edge).drop("_block"), ["bucket", "category"]).select("bucket", "category", "run_start", "run_end", "n_items", "body"))


def run_violations(runs: DataFrame) -> DataFrame:
    """Runs that end before they start, leave the safe integers or overlap the one before.

    The run before is sought in the block of the run's start, then as the last one of an earlier block.
    """
    placed = written(runs.withColumn("_block", F.floor(F.col("run_start") / BLOCK)), "runs")
    last = placed.groupBy("bucket", "category", "_block").agg(F.max_by("run_end", "run_start").alias("_end"))
    earlier = last.select("bucket", "category", "_block", F.lag("_end").over(Window.partitionBy("bucket", "category").orderBy("_block")).alias("_earlier"))
    here = F.lag("run_end").over(Window.partitionBy("bucket", "category", "_block").orderBy("run_start"))
    why = (
        F.when(F.col("run_end") < F.col("run_start"), "reversed")
        .when((F.abs("run_start") > 9007199254740991) | (F.abs("run_end") > 9007199254740991), "unsafe")
        .when(F.coalesce("_here", "_earlier") >= F.col("run_start"), "overlap")
    )
    met = placed.withColumn("_here", here).join(earlier, ["bucket", "category", "_block"])
    return met.withColumn("violation", why).filter(F.col("violation").isNotNull()).drop("_block", "_here", "_earlier")

"""Viewport queries over many views at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deeptime.functions import time as T
from deeptime.sources.scratch import small

PERIPHERY, NEAR, POINT_LIKE = 0.15, 0.10, 0.01
LANE_CAP, GUTTER_CAP = 100, 12
#: Views that are judged at once; their table is broadcast.
MAX_VIEWS = 1000


def with_windows(views: DataFrame, pad: bool = True) -> DataFrame:
    """Adds the views' bucket and the window range that they show, padded by one window each side."""
    v = views.withColumn("bucket", T.bucket_for_span(F.col("t1") - F.col("t0")))
    w = T.window_s(F.col("bucket"))
    edge = w if pad else F.lit(0.0)
    return v.withColumn("w0", T.window_index(F.col("t0") - edge, w)).withColumn("w1", T.window_index(F.col("t1") + edge, w))


def runs_in_view(windowed: DataFrame, runs: DataFrame) -> DataFrame:
    """Run starts that a view must read: a join on the bucket, so views and runs of one bucket meet only."""
    v = small(windowed.select("view_id", F.col("bucket").alias("vb"), "w0", "w1"))
    hit = (F.col("vb") == F.col("bucket")) & (F.col("run_end") >= F.col("w0")) & (F.col("run_start") <= F.col("w1"))
    return runs.join(v, hit).select("view_id", "bucket", "category", "run_start")


def items_in_view(windowed: DataFrame, runs: DataFrame, ranked: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """``view_id, rank, slug, importance``: distinct items of the chunks that each view reads, at or over its importance floor, most important first.

    ``ranked(bucket, win, category, slug, importance)`` are the items at run starts.
    ``categories`` names the chunks that are read; none named are those of ``all``, and None are those of every topic.
    """
    if categories is not None:
        runs = runs.filter(F.col("category").isin(categories or ["all"]))
    need = runs_in_view(windowed, runs).withColumnRenamed("run_start", "win")
    got = ranked.join(need, ["bucket", "win", "category"]).join(small(windowed.select("view_id", "min_importance")), "view_id")
    items = got.filter(F.col("importance") >= F.col("min_importance")).select("view_id", "slug", "importance").distinct()
    return items.withColumn("rank", F.row_number().over(Window.partitionBy("view_id").orderBy(F.desc("importance"), "slug")))


def run_items(runs: DataFrame, entities: DataFrame) -> DataFrame:
    """``bucket, win, category, slug, importance`` of runs that hold their ``items``, by their first windows."""
    each = runs.select("bucket", F.col("run_start").alias("win"), "category", F.explode("items").alias("slug"))
    return each.join(entities.select("slug", "importance"), "slug")


def touches(v0: Column, v1: Column, t0: Column, t1: Column) -> Column:
    return t0.between(v0, v1) | t1.between(v0, v1)


def periphery(v0: Column, v1: Column, t0: Column, t1: Column) -> Column:
    band = (v1 - v0) * PERIPHERY
    return (F.least(t1, v1) <= v0 + band) | (F.greatest(t0, v0) >= v1 - band)


def visibility(items: DataFrame, views: DataFrame, selected: Column | None = None) -> DataFrame:
    """Items against every view with the flags ``lane``, ``map`` and ``later``.

    ``items(slug, t0, t1, importance)``. The result has as many rows as there are
    items for each view, so more views than ``MAX_VIEWS`` are refused.
    """
    if views.limit(MAX_VIEWS + 1).count() > MAX_VIEWS:
        raise ValueError(f"more than {MAX_VIEWS} views at once")
    v = F.broadcast(views.select("view_id", F.col("t0").alias("v0"), F.col("t1").alias("v1"), "cursor", "min_importance"))
    j = items.join(v, F.col("importance") >= F.col("min_importance"))
    v0, v1, t0, t1, c = (F.col(x) for x in ("v0", "v1", "t0", "t1", "cursor"))
    mine = F.lit(False) if selected is None else selected
    near = (t1 >= c - (v1 - v0) * NEAR) & (t0 <= c + (v1 - v0) * NEAR)
    point = (t1 - t0) < (v1 - v0) * POINT_LIKE
    lane = mine | (touches(v0, v1, t0, t1) & F.when(point, near).otherwise(~periphery(v0, v1, t0, t1)))
    on_map = mine | ((t0 <= c) & (t1 >= c)) | (touches(v0, v1, t0, t1) & F.when(point, near).otherwise(F.lit(True)))
    later = (t0 > v1) & (mine | ~point | near)
    return j.select("view_id", "slug", "input_order", "importance", mine.alias("selected"), lane.alias("lane"), on_map.alias("on_map"), later.alias("later"))


def lanes(flags: DataFrame, cap: int = LANE_CAP) -> DataFrame:
    w = Window.partitionBy("view_id").orderBy(F.desc("selected"), F.desc("importance"), "slug")
    return flags.filter("lane").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("view_id", "rank", "slug")


def gutter(flags: DataFrame, cap: int = GUTTER_CAP) -> DataFrame:
    w = Window.partitionBy("view_id").orderBy(F.desc("selected"), "input_order")
    return flags.filter("later").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("view_id", "rank", "slug")


def chunk_keys(cells: DataFrame) -> Column:
    """Artifact key of a chunk."""
    return F.concat_ws("/", F.lit("chunks"), F.concat(F.lit("T"), F.col("bucket").cast("string")), F.col("run_start").cast("string"), F.lit("world"), F.concat("category", F.lit(".json")))

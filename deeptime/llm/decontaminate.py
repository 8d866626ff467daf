"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct five-word shingles
(powers of two). A document that holds ``threshold`` of an item's shingles
misses ``n - ceil(threshold * n)`` of them at most. So each item is sketched by
its smallest shingle hashes: twice as many as an item of its partition may miss,
and ``SPARE`` more, or all if it has fewer; a document is a candidate for it if
it holds as many of the sketch as it must when every miss falls into the sketch.
That number follows from the item's size and its partition's sketch, and no document over
the threshold is passed over.
All shingle hashes of the (long) documents are looked up among the sketches; what
is found is verified by exact containment of the shingles' texts. Everything runs
on DataFrame functions.

Words are maximal runs of characters other than ASCII punctuation and white
space, in lower case.

Defined cases: a null or blank text and an item under five words have no
shingles and never match; repeated items are reported each, also under a null
id; rows that repeat an id are judged each by their own text; an item found
several times in a document is one row; a very long text is split whole in one task; empty tables give an empty result;
columns beyond ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import ROW, broadcast_if_small, keyed, stored, words

WIDTH = 5
THRESHOLD = 0.8
SPARE = 4
#: Kept hashes and found ids up to these numbers (each at most 16 MB of longs) are broadcast; beyond, both sides are shuffled.
BROADCAST_HASHES, BROADCAST_IDS = 1_000_000, 1_000_000

def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles at every position; empty if there are too few words."""
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1)))
    return F.transform(starts, lambda i: F.xxhash64(*(F.element_at(w, (i + k).cast("int")) for k in range(width))))


def shingle_texts(w: Column, width: int = WIDTH) -> Column:
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i.cast("int"), F.lit(width)), " "))


def item_sketches(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``item_id, part, n_shingles, shingles, kept, needed``: items with their partition, sketch and the least number of its hashes."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") >= width)
    sets = w.select("item_id", F.array_distinct(shingle_texts(F.col("w"), width)).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), width))).alias("hashes"))
    part = F.floor(F.log2(F.size("shingles").cast("double"))).cast("int")
    missed = lambda n: n - F.ceil(n * F.lit(threshold) - F.lit(1e-9))
    keep = (2 * missed(F.pow(F.lit(2.0), part + 1) - 1) + SPARE).cast("int")  # by the partition's largest size
    rows = sets.select("item_id", part.alias("part"), F.size("shingles").cast("long").alias("n_shingles"), "shingles", F.slice("hashes", F.lit(1), keep).alias("kept"))
    return rows.withColumn("needed", F.greatest(F.lit(1), F.size("kept") - missed(F.col("n_shingles"))).cast("int"))


def _leaks(given: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame:
    """``ROW, doc_id, item_id, n_shingles, n_found, containment`` of keyed documents."""
    sketches = stored(item_sketches(items, threshold, width).withColumn("item", F.monotonically_increasing_id()), "item-sketches")
    kept = sketches.select("item", "needed", F.explode("kept").alias("h"))
    # the words are a column of their own: inside the functions over positions an expression would run anew for each
    texts = given.select(ROW, words(F.col("text")).alias("w"))
    probe = texts.select(ROW, F.explode(shingle_hashes(F.col("w"), width)).alias("h"))
    # the documents that hold any sketched hash, with no regard to the item yet
    hashes = stored(kept.select("h").distinct(), "item-hashes")
    met = stored(probe.join(broadcast_if_small(hashes, BROADCAST_HASHES), "h", "left_semi").select(ROW, "h").distinct(), "met")
    pairs = met.join(kept, "h").groupBy(ROW, "item").agg(F.count(F.lit(1)).alias("held"), F.first("needed").alias("needed")).filter("held >= needed")
    pairs = stored(pairs.select(F.col(ROW).alias("__deeptime_met"), "item"), "candidates")
    found = given.select(ROW, "doc_id", words(F.col("text")).alias("w")).join(broadcast_if_small(pairs, BROADCAST_IDS), F.col(ROW) == F.col("__deeptime_met"))
    found = found.select(ROW, "doc_id", "item", F.array_distinct(shingle_texts(F.col("w"), width)).alias("own"))
    checked = found.join(sketches.select("item", "item_id", "n_shingles", "shingles"), "item").select(
        ROW, "doc_id", "item_id", "n_shingles", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_found")
    )
    return checked.withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("containment") >= threshold)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` where a document holds ``threshold`` of an item's shingles."""
    return _leaks(keyed(docs), items, threshold, width).drop(ROW)


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns unchanged."""
    given = keyed(docs)
    leaks = stored(_leaks(given.select(ROW, "doc_id", "text"), items, threshold, width).select(F.col(ROW).alias("__deeptime_out")).distinct(), "leaking-rows")
    return given.join(broadcast_if_small(leaks, BROADCAST_IDS), F.col(ROW) == F.col("__deeptime_out"), "left_anti").drop(ROW)


_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-/:-`{-\\x7f]+'), lambda x: x <> '')"
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT item_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i) a),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
t AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d) b),
c AS (SELECT doc_id, item_id, count(*) AS n_found FROM t JOIN s USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM c JOIN n USING (item_id) WHERE n_found / n_shingles >= 0.8
"""

"""Queries that the data model is meant for but that are described only (tier B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deeptime.catalog import register
from deeptime.fixtures import bind, twin
from deeptime.functions import time as T
from deeptime.functions import vocab as V
from deeptime.operators import insight as I
from deeptime.operators import layers as L
from deeptime.operators import model as M
from deeptime.operators import zoom as Z
from deeptime.plans import layers as PL
from deeptime.plans import model as PM
from deeptime.plans import store as PS
from deeptime.plans import zoom as PZ
from deeptime.sources.scratch import small

_SYNTH = """synth AS (SELECT seed_id, property, min(CASE WHEN min IS NOT NULL AND max IS NOT NULL THEN min ELSE value END) AS low, max(CASE WHEN min IS NOT NULL AND max IS NOT NULL THEN max ELSE value END) AS high FROM claim GROUP BY seed_id, property),
pairs AS (SELECT seed_id AS a, target AS b FROM relationship WHERE type = 'built_upon')"""


def _pairs(spark, sf):
    return bind(spark, sf, "relationship").filter("type = 'built_upon'").select(F.col("seed_id").alias("a"), F.col("target").alias("b"))


@register("b1_claims_known_by", twin("SELECT seed_id, property, count(*) AS claim_count FROM claim WHERE published_at <= '1997' GROUP BY seed_id, property", "claim"))
def b1(spark, sf):
    return M.synthesize(bind(spark, sf, "claim").filter("published_at <= '1997'")).select("seed_id", "property", "claim_count")


@register("b2_compare", twin("""SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.property, y.property) AS property, x.low AS low_a, x.high AS high_a, y.low AS low_b, y.high AS high_b
FROM (SELECT a, b, property, low, high FROM pairs JOIN synth ON seed_id = a) x FULL OUTER JOIN (SELECT a, b, property, low, high FROM pairs JOIN synth ON seed_id = b) y ON x.a = y.a AND x.b = y.b AND x.property = y.property""", "claim", "relationship", more=_SYNTH))
def b2(spark, sf):
    return I.compare(_pairs(spark, sf), M.synthesize(bind(spark, sf, "claim"))).select("a", "b", "property", "low_a", "high_a", "low_b", "high_b")


@register("b2_gaps", twin("SELECT a, b, greatest(least(x.t1, y.t1) - greatest(x.t0, y.t0), 0e0) AS overlap, greatest(greatest(x.t0, y.t0) - least(x.t1, y.t1), 0e0) AS gap FROM pairs JOIN entity x ON x.seed_id = a JOIN entity y ON y.seed_id = b", "entity", "claim", "relationship", more=_SYNTH))
def b2_gaps(spark, sf):
    return I.gap_between(_pairs(spark, sf), bind(spark, sf, "entity"))


@register("b3_alive_at", twin("SELECT v.view_id, count(*) AS n, min(seed_id) AS least FROM entity JOIN viewport v ON entity.t0 <= cursor AND entity.t1 >= cursor WHERE type = 'person' GROUP BY v.view_id", "entity", "viewport"))
def b3(spark, sf):
    people = bind(spark, sf, "entity").filter("type = 'person'").select("seed_id", "t0", "t1")
    views = small(bind(spark, sf, "viewport").select("view_id", "cursor"))
    return people.join(views, (F.col("t0") <= F.col("cursor")) & (F.col("t1") >= F.col("cursor"))).groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.min("seed_id").alias("least"))


@register("b3_events_at_age", twin("""SELECT p.seed_id AS id, count(*) AS n, min(e.seed_id) AS least FROM (SELECT seed_id, t0 + 2e0 * 31556952e0 AS a, t0 + 3e0 * 31556952e0 AS b FROM entity WHERE type = 'person') p
JOIN (SELECT * FROM entity WHERE type = 'event') e ON e.t0 <= b AND e.t1 >= a GROUP BY p.seed_id""", "entity"))
def b3_age(spark, sf):
    """Events while each person was two years old."""
    e = bind(spark, sf, "entity")
    year = lambda n: F.col("t0") + n * F.lit(V.YEAR_S)
    people = e.filter("type = 'person'").select(F.col("seed_id").alias("id"), year(2.0).alias("a"), year(3.0).alias("b"))
    return I.during_counts(people, e.filter("type = 'event'").select("seed_id", "t0", "t1"))


@register("b3_greatest_in_year", twin("SELECT year, property, max(coalesce(value, max)) AS value FROM (SELECT *, published_at AS year FROM claim) c GROUP BY year, property", "claim"))
def b3_greatest(spark, sf):
    return bind(spark, sf, "claim").groupBy(F.col("published_at").alias("year"), "property").agg(F.max(F.coalesce("value", "max")).alias("value"))


@register("b3_inventions_from_place", twin(f"SELECT ring.name AS place, seed_id FROM entity JOIN ring ON lon >= x0 AND lon < x0 + 10 AND lat >= y0 AND lat < y0 + 10 WHERE type = 'invention' AND floor(t0 / {V.YEAR_S!r}e0 + 1970e0) BETWEEN 1993 AND 1996", "entity", "ring"))
def b3_inventions(spark, sf):
    year = F.floor(T.seconds_to_year(F.col("t0")))
    found = bind(spark, sf, "entity").filter((F.col("type") == "invention") & year.between(1993, 1996) & F.col("lon").isNotNull()).select("seed_id", "lon", "lat")
    return L.locate(found, PL._rings(spark, sf)).select(F.col("name").alias("place"), "seed_id")


_DATES = ["1993", "1995", "1998"]


@register("b4_record_values", twin("""SELECT date, property, seed_id, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY date, property ORDER BY v DESC, seed_id DESC) AS n FROM (
SELECT date, property, seed_id, coalesce(value, max) AS v FROM claim JOIN (VALUES ('1993'), ('1995'), ('1998')) d(date) ON published_at <= date) x) y WHERE n = 1""", "claim"))
def b4(spark, sf):
    return I.records_at(bind(spark, sf, "claim").select("property", "seed_id", F.coalesce("value", "max").alias("value"), "published_at"), _DATES)


@register("b5_built_upon_closure", twin("SELECT source, target, min(hops) AS hops FROM reach GROUP BY source, target", "relationship", more="RECURSIVE reach(source, target, hops) AS (SELECT seed_id, target, 1 FROM relationship WHERE type IN ('built_upon', 'preceded') UNION ALL SELECT r.source, e.target, hops + 1 FROM reach r JOIN relationship e ON e.seed_id = r.target WHERE e.type IN ('built_upon', 'preceded'))"))
def b5(spark, sf):
    r = bind(spark, sf, "relationship").filter(F.col("type").isin("built_upon", "preceded"))
    return I.closure(r.select(F.col("seed_id").alias("source"), "target"))


@register("b6_scaled_importance", twin("SELECT input_order, CASE WHEN hi > lo THEN floor((ln(1 + n) - lo) / (hi - lo) * 1e6 + 0.5e0) / 1e6 ELSE 0 END AS scaled FROM (SELECT *, min(ln(1 + n)) OVER (PARTITION BY type) AS lo, max(ln(1 + n)) OVER (PARTITION BY type) AS hi FROM (SELECT input_order, type, CAST(input_order % 500 AS DOUBLE) AS n FROM entity) x) y", "entity"))
def b6(spark, sf):
    rows = bind(spark, sf, "entity").select("input_order", "type", (F.col("input_order") % 500).cast("double").alias("n"))
    return I.scaled(rows, "type", "n").select("input_order", (F.floor(F.col("scaled") * 1e6 + 0.5) / 1e6).alias("scaled"))


_LOG = "CASE WHEN hi > lo THEN (ln(1 + n) - lo) / (hi - lo) ELSE 0 END"


@register("b6_weighted_importance", twin(f"""SELECT input_order, floor((0.6e0 * scaled + 0.2e0 * count(*) OVER (PARTITION BY type) / count(*) OVER () + 0.2e0 * blend) * 1e5 + 0.5e0) / 1e5 AS weighted FROM (SELECT input_order, type, region, {_LOG} AS scaled FROM (
 SELECT *, min(ln(1 + n)) OVER (PARTITION BY type) AS lo, max(ln(1 + n)) OVER (PARTITION BY type) AS hi FROM sig) a) b JOIN (SELECT region, {_LOG} AS blend FROM (SELECT *, min(ln(1 + n)) OVER () AS lo, max(ln(1 + n)) OVER () AS hi FROM (
 SELECT region, CAST(count(*) AS DOUBLE) AS n FROM sig GROUP BY region) c) d) r USING (region)""", "entity", more="sig AS (SELECT input_order, type, CAST(input_order % 500 AS DOUBLE) AS n, coalesce(CAST(floor(lon / 30) AS BIGINT), -99) AS region FROM entity)"))
def b6_weighted(spark, sf):
    rows = bind(spark, sf, "entity").select("input_order", "type", "lon", (F.col("input_order") % 500).cast("double").alias("n"))
    out = I.weighted(rows, "type", F.coalesce(F.floor(F.col("lon") / 30), F.lit(-99)), "n")
    return out.select("input_order", (F.floor(F.col("weighted") * 1e5 + 0.5) / 1e5).alias("weighted"))


@register("b7_birth_before_death", twin("SELECT seed_id FROM entity WHERE type = 'person' AND input_order % 7 = 0 AND t1 - 86400e0 < t0", "entity"))
def b7_birth(spark, sf):
    """Persons who die before their birth; some deaths are put a day early."""
    people = bind(spark, sf, "entity").filter("type = 'person'")
    died = F.when(F.col("input_order") % 7 == 0, F.col("t1") - 86400).otherwise(F.col("t1"))
    return people.filter(died < F.col("t0")).select("seed_id")


@register("b7_near_duplicates", twin("""SELECT a.seed_id AS a, b.seed_id AS b FROM entity a JOIN entity b ON a.type = b.type AND a.seed_id < b.seed_id AND abs(a.t0 - b.t0) <= 864000e0 AND coalesce(abs(a.lon - b.lon) <= 90e0, true) AND coalesce(abs(a.lat - b.lat) <= 90e0, true)
WHERE levenshtein(lower(a.name), lower(b.name)) <= 2""", "entity"))
def b7_near(spark, sf):
    """Names with up to two letters changed, added or left out, near in time and place."""
    return I.near_duplicates(bind(spark, sf, "entity"), 864000.0, degrees=90.0)


_RATE = "floor(count(*) FILTER (WHERE input_order % 2 = {0}) / CAST((SELECT count(*) FROM spoiled WHERE input_order % 2 = {0}) AS DOUBLE) * 1e6 + 0.5e0) / 1e6"


@register("b7_rate_jumps", twin(f"SELECT * FROM (SELECT reason, {_RATE.format(0)} AS rate_before, {_RATE.format(1)} AS rate_now FROM reasoned WHERE reason IS NOT NULL GROUP BY reason) r WHERE rate_now > rate_before", "entity", more=f"{PM.SPOILED},\n{PM.REASON}"))
def b7_rates(spark, sf):
    rows = PM._reasoned(spark, sf)
    odd = F.col("input_order") % 2 == 1
    return I.rate_jumps(rows.filter(odd), rows.filter(~odd), 0.0)


@register("b7_outside_parent", twin("SELECT r.seed_id, target FROM relationship r JOIN entity c ON c.seed_id = r.seed_id JOIN entity p ON p.seed_id = target WHERE r.type = 'part_of' AND (c.t0 < p.t0 OR c.t1 > p.t1)", "relationship", "entity"))
def b7(spark, sf):
    return I.outside_parent(bind(spark, sf, "relationship"), bind(spark, sf, "entity"))


@register("b7_outliers", "SELECT l_orderkey, l_linenumber, l_partkey, v FROM (SELECT *, avg(v) OVER (PARTITION BY l_returnflag) AS m, stddev_samp(v) OVER (PARTITION BY l_returnflag) AS s FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_orderkey % 500 = 7 THEN l_quantity * 1000 ELSE l_quantity END AS v FROM lineitem) x) y WHERE abs(v - m) > 5 * s")
def b7_outliers(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    v = F.when(F.col("l_orderkey") % 500 == 7, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity"))
    return I.outliers(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", v.alias("v")), ["l_returnflag"], "v").select("l_orderkey", "l_linenumber", "l_partkey", "v")


@register("b8_artifact_budgets", twin(f"""SELECT bucket, count(*) AS n, max(bytes) AS largest, quantile_disc(bytes, 0.95) AS p95 FROM (SELECT bucket, bytes FROM runs JOIN (SELECT bucket, win, category, CAST(strlen({PS._BODY}) AS BIGINT) AS bytes FROM ranked GROUP BY bucket, win, category) t USING (bucket, category) WHERE win = run_start) x GROUP BY bucket""", "entity", more=f"{PZ.BUCKETED},\n{PZ.SHOWN},\n{PZ.RANKED},\n{PZ.BODY},\n{PZ.RUNS}"))
def b8(spark, sf):
    """Bytes of the chunk documents of every topic."""
    docs = PS._chunk_documents(spark, sf).filter("category <> 'all'")
    bucket = F.regexp_extract("key", r"^chunks/T(\d+)/", 1).cast("int")
    return I.size_budgets(docs.select(bucket.alias("bucket"), F.octet_length("body").cast("bigint").alias("bytes")))


@register("b9_subclass_closure", """WITH RECURSIVE sub AS (SELECT DISTINCT p_size AS source, p_size // 2 AS target FROM part WHERE p_size > 1),
reach(source, target, hops) AS (SELECT source, target, 1 FROM sub UNION ALL SELECT r.source, s.target, hops + 1 FROM reach r JOIN sub s ON s.source = r.target)
SELECT source, target, min(hops) AS hops FROM reach GROUP BY source, target""")
def b9(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").filter("p_size > 1")
    return I.closure(p.select(F.col("p_size").alias("source"), F.floor(F.col("p_size") / 2).cast("int").alias("target")))

"""Queries on slices, fronts, rings and licences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from deeptime.catalog import register
from deeptime.fixtures import bind, twin
from deeptime.functions import time as T
from deeptime.operators import layers as L
from deeptime.operators import polygons as G
from deeptime.sources.scratch import small, spread


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("w5_tiling_faults", twin("SELECT year, CASE WHEN t_from <= before THEN 'overlap' ELSE 'gap' END AS fault FROM (SELECT year, t_from, lag(t_to + year % 3 - 1) OVER (ORDER BY t_from) AS before FROM slice) x WHERE t_from <> before + 1", "slice"))
def w5(spark, sf):
    return L.tiling_faults(bind(spark, sf, "slice").withColumn("t_to", F.col("t_to") + F.col("year") % 3 - 1)).select("year", "fault")


@register("w6_tiles", twin("SELECT year, t_from, t_to FROM slice", "slice"))
def w6(spark, sf):
    return L.tile(bind(spark, sf, "slice").drop("t_to"), 2035)


_YEAR = "CAST(floor(t0 / 31556952e0 + 1970e0) AS BIGINT)"


@register("j9_covering_slice", twin(f"SELECT input_order, s.year AS slice_year FROM entity e LEFT JOIN slice s ON {_YEAR} + (input_order % 9 - 4) BETWEEN t_from AND t_to", "entity", "slice"))
def j9(spark, sf):
    year = F.floor(T.seconds_to_year(F.col("t0"))) + (F.col("input_order") % 9 - 4)
    return L.covering(bind(spark, sf, "entity"), year, bind(spark, sf, "slice")).select("input_order", "slice_year")


@register("q3_coverage_scrub", twin("SELECT s.year AS probe_year, k AS probe, c.year AS slice_year FROM (SELECT year, 0 AS k, t_from AS y FROM slice UNION ALL SELECT year, 1, (t_from + t_to) // 2 FROM slice UNION ALL SELECT year, 2, t_to FROM slice) s LEFT JOIN slice c ON y BETWEEN t_from AND t_to", "slice"))
def q3(spark, sf):
    s = bind(spark, sf, "slice")
    probes = s.select(F.col("year").alias("probe_year"), F.posexplode(F.array("t_from", F.floor((F.col("t_from") + F.col("t_to")) / 2).cast("int"), "t_to")).alias("probe", "y"))
    return L.covering(probes, F.col("y"), s).select("probe_year", "probe", "slice_year")


_DETAIL = "detail AS (SELECT DISTINCT year(o_orderdate) AS year, year(o_orderdate) AS t_from, year(o_orderdate) + 1 AS t_to FROM orders WHERE year(o_orderdate) % 3 = 0)"


@register("j10_composite", twin("""SELECT year, t_from, t_to, (SELECT min(year) FROM detail d WHERE p.t_from BETWEEN d.t_from AND d.t_to) AS detail_year FROM (
SELECT CASE WHEN start = t_from THEN year ELSE start END AS year, start AS t_from, coalesce(lead(start) OVER (PARTITION BY year ORDER BY start) - 1, t_to) AS t_to FROM (
SELECT year, t_from, t_to, t_from AS start FROM slice UNION SELECT s.year, s.t_from, s.t_to, d.t_from FROM slice s JOIN detail d ON d.t_from > s.t_from AND d.t_from <= s.t_to) c) p""", "slice", more=_DETAIL))
def j10(spark, sf):
    y = F.year("o_orderdate")
    detail = _read(spark, sf, "orders").filter(y % 3 == 0).select(y.alias("year"), y.alias("t_from"), (y + 1).alias("t_to")).distinct()
    return L.composite(bind(spark, sf, "slice"), detail).drop("base_year")


_PARTS = """parts AS (SELECT year, t_from, t_to, (SELECT min(year) FROM detail d WHERE p.t_from BETWEEN d.t_from AND d.t_to) AS detail_year, base_year FROM (
SELECT CASE WHEN start = t_from THEN year ELSE start END AS year, year AS base_year, start AS t_from, coalesce(lead(start) OVER (PARTITION BY year ORDER BY start) - 1, t_to) AS t_to FROM (
SELECT year, t_from, t_to, t_from AS start FROM slice UNION SELECT s.year, s.t_from, s.t_to, d.t_from FROM slice s JOIN detail d ON d.t_from > s.t_from AND d.t_from <= s.t_to) c) p)"""


@register("u3_feature_union", twin("""SELECT p.year, name, 'base' AS source, CASE WHEN detail_year IS NULL THEN base_year || '' ELSE base_year || ' with ' || detail_year END AS label FROM parts p CROSS JOIN ring
UNION ALL SELECT p.year, name, 'detail', base_year || ' with ' || detail_year FROM parts p JOIN ring ON detail_year IS NOT NULL AND ring_id % 3 = 0""", "slice", "ring", more=f"{_DETAIL},\n{_PARTS}"))
def u3(spark, sf):
    """The features of each composite window: all of its base slice and those of the detail slice, under a label that names both."""
    y = F.year("o_orderdate")
    detail = _read(spark, sf, "orders").filter(y % 3 == 0).select(y.alias("year"), y.alias("t_from"), (y + 1).alias("t_to")).distinct()
    base, ring = bind(spark, sf, "slice"), bind(spark, sf, "ring")
    features = lambda slices, some: slices.select("year").join(small(some.select("name")))
    return L.composite_features(L.composite(base, detail), features(base, ring), features(detail, ring.filter("ring_id % 3 = 0")))


@register("j11_active_in_year", "WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) + o_orderkey % 3 END AS b FROM orders) SELECT y.year, count(*) AS n, min(o_orderkey) AS least FROM f JOIN (VALUES (1994), (1996), (1999), (2003)) y(year) ON (a IS NULL OR a <= y.year) AND (b IS NULL OR b >= y.year) GROUP BY y.year")
def j11(spark, sf):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    f = _read(spark, sf, "orders").select("o_orderkey", F.when(k % 5 != 0, y).alias("start_year"), F.when(k % 7 != 0, y + k % 3).alias("end_year"))
    years = spark.createDataFrame([(y,) for y in (1994, 1996, 1999, 2003)], "year int")
    return L.active(f, years).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


_POS = """pos AS (SELECT o_custkey AS entity, epoch(o_orderdate) AS valid_from, CAST(min(o_orderkey) % 100 AS DOUBLE) AS x, CAST(max(o_orderkey) % 80 AS DOUBLE) AS y FROM orders GROUP BY o_custkey, epoch(o_orderdate)),
seg AS (SELECT *, lead(valid_from) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS k FROM pos WINDOW w AS (PARTITION BY entity ORDER BY valid_from))"""


def positions(spark, sf):
    """Dated positions of the customers as fronts of two vertices."""
    o = _read(spark, sf, "orders").withColumn("valid_from", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double"))
    g = o.groupBy(F.col("o_custkey").alias("entity"), "valid_from").agg((F.min("o_orderkey") % 100).cast("double").alias("x"), (F.max("o_orderkey") % 80).cast("double").alias("y"))
    point = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    return g.select("entity", "valid_from", F.array(point(F.col("x"), F.col("y")), point(F.col("y"), F.col("x"))).alias("coords"))


@register("j12_front_at", twin("""SELECT entity, t, CASE WHEN nf IS NOT NULL AND t >= valid_from THEN x + (nx - x) * ((t - valid_from) / (nf - valid_from)) ELSE x END AS lon0, NOT (nf IS NOT NULL AND t >= valid_from) AND t <> valid_from AS held,
CASE WHEN nf IS NOT NULL AND t >= valid_from AND (t - valid_from) / (nf - valid_from) >= 0.5e0 THEN nf ELSE valid_from END AS label_from
FROM seg JOIN (VALUES (7.0e8), (8.5e8), (9.0e8), (9.9e8)) q(t) ON (k = 1 OR t >= valid_from) AND (nf IS NULL OR t < nf)""", more=_POS))
def j12(spark, sf):
    times = spark.createDataFrame([(7.0e8,), (8.5e8,), (9.0e8,), (9.9e8,)], "t double")
    return L.front_at(positions(spark, sf), times).select("entity", "t", F.col("coords")[0]["lon"].alias("lon0"), "held", "label_from")


@register("w8_front_faults", twin("""SELECT entity, CASE WHEN n < 2 THEN 'single' WHEN entity % 7 = 1 THEN 'repeated date' WHEN entity % 7 = 2 THEN 'vertices' WHEN entity % 7 = 3 THEN 'two files' WHEN entity % 7 = 4 THEN 'outside owner' WHEN entity % 7 = 5 THEN 'no owner' END AS fault
FROM (SELECT entity, count(*) AS n FROM pos GROUP BY entity) g WHERE n < 2 OR entity % 7 BETWEEN 1 AND 5""", more=_POS))
def w8(spark, sf):
    """Fronts spoiled in every way, against owners with spans of their own."""
    k, t = F.col("entity") % 7, F.col("valid_from")
    p = positions(spark, sf).withColumn("file", F.concat(F.lit("f"), F.col("entity").cast("string")))
    first = p.groupBy("entity").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(F.lit(1)).alias("n"))
    j = p.join(first, "entity")
    again = j.filter((k == 1) & (F.col("n") > 1) & (t == F.col("t0")))
    odd = j.withColumns({"coords": F.when((k == 2) & (t == F.col("t0")), F.slice("coords", 1, 1)).otherwise(F.col("coords")), "file": F.when((k == 3) & (t == F.col("t1")), "other").otherwise(F.col("file"))})
    owners = first.filter(k != 5).select("entity", F.when(k == 4, F.col("t0") + 1).otherwise(F.col("t0")).alias("t0"), "t1")
    return L.front_faults(odd.unionByName(again).select("entity", "valid_from", "coords", "file"), owners)


@register("a14_bounding_boxes", twin("SELECT entity, least(min(x), min(y)) AS west, greatest(max(x), max(y)) AS east FROM pos GROUP BY entity", more=_POS))
def a14(spark, sf):
    p = positions(spark, sf).select("entity", F.explode("coords").alias("c"))
    return p.groupBy("entity").agg(F.min("c.lon").alias("west"), F.max("c.lon").alias("east"))


def _rings(spark, sf):
    x, y = F.col("x0"), F.col("y0")
    at = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    return bind(spark, sf, "ring").select("ring_id", "name", F.array(at(x, y), at(x + 10, y), at(x + 10, y + 10), at(x, y + 10), at(x, y)).alias("ring"))


def _shape(corners):
    """A closed ring of ``(x, y)`` columns."""
    points = [F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners]
    return F.array(*points, points[0])


def _box(west, south, size, hole=False):
    corners = [(west, south), (west + size, south), (west + size, south + size), (west, south + size)]
    return _shape(corners[::-1] if hole else corners)


def _diamond(x, y, r, hole=False):
    corners = [(x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    return _shape(corners[::-1] if hole else corners)


def _features(spark, sf):
    """A feature for each nation: a diamond, every third with a hole, every second with another part."""
    k, x, y = F.col("ring_id"), F.col("x0"), F.col("y0")
    outline, hole = _diamond(x + 5.5, y + 5.25, F.lit(6.1)), _box(x + 3.5, y + 3.5, 3.0, hole=True)
    first = F.when(k % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline))
    more = F.array(_box(x + 12.5, y + 0.5, 4.0))
    return bind(spark, sf, "ring").select("ring_id", "name", "x0", "y0", F.when(k % 2 == 0, F.array(first, more)).otherwise(F.array(first)).alias("polygons"))


_IN_FEATURE = """(abs(lon - (x0 + 5.5e0)) + abs(lat - (y0 + 5.25e0)) < 6.1e0 AND NOT (ring_id % 3 = 0 AND lon > x0 + 3.5e0 AND lon < x0 + 6.5e0 AND lat > y0 + 3.5e0 AND lat < y0 + 6.5e0)
 OR ring_id % 2 = 0 AND lon > x0 + 12.5e0 AND lon < x0 + 16.5e0 AND lat > y0 + 0.5e0 AND lat < y0 + 4.5e0)"""


@register("j13_point_in_polygon", twin(f"SELECT input_order, ring_id FROM entity JOIN ring ON {_IN_FEATURE}", "entity", "ring"))
def j13(spark, sf):
    """Points in features with holes and parts, by cell covers."""
    points = bind(spark, sf, "entity").filter("lon IS NOT NULL").select("input_order", "lon", "lat")
    return G.locate(points, _features(spark, sf), "ring_id").select("input_order", "ring_id")


@register("a15_ring_areas", twin("SELECT ring_id, CAST(round((74.42e0 - CASE WHEN ring_id % 3 = 0 THEN 9e0 ELSE 0e0 END + CASE WHEN ring_id % 2 = 0 THEN 16e0 ELSE 0e0 END) * 1e6) AS BIGINT) AS micro_area, x0 + 5.5e0 - 6.1e0 AS west, CASE WHEN ring_id % 2 = 0 THEN x0 + 12.5e0 + 4e0 ELSE x0 + 5.5e0 + 6.1e0 END AS east FROM ring", "ring"))
def a15(spark, sf):
    """Areas of whole features, holes taken off, and their bounds."""
    lons = F.flatten(F.flatten("polygons"))["lon"]
    return _features(spark, sf).select("ring_id", F.round(G.area(F.col("polygons")) * 1e6).cast("long").alias("micro_area"), F.array_min(lons).alias("west"), F.array_max(lons).alias("east"))


@register("g1_ring_faults", twin("SELECT ring_id, CASE WHEN ring_id % 5 = 1 THEN 'winding' WHEN ring_id % 5 = 2 THEN 'open' WHEN ring_id % 5 = 3 THEN 'range' WHEN ring_id % 5 = 4 THEN 'positions' END AS fault FROM ring", "ring"))
def g1(spark, sf):
    k, r = F.col("ring_id") % 5, F.col("ring")
    far = F.transform(r, lambda p: F.struct((p["lon"] + 1000).alias("lon"), p["lat"].alias("lat")))
    bad = F.when(k == 1, F.reverse(r)).when(k == 2, F.slice(r, 1, 4)).when(k == 3, far).when(k == 4, F.slice(r, 1, 3)).otherwise(r)
    return _rings(spark, sf).withColumn("ring", bad).select("ring_id", L.ring_fault(F.col("ring"), F.lit(True)).alias("fault"))


@register("g1_crossings", twin("SELECT ring_id, 1 AS n_crossings FROM ring WHERE ring_id % 2 = 0", "ring"))
def g1_crossings(spark, sf):
    r = F.col("ring")
    bow = F.array(r[0], r[2], r[1], r[3], r[0])  # two corners exchanged: the sides cross once
    return L.crossings(_rings(spark, sf).withColumn("ring", F.when(F.col("ring_id") % 2 == 0, bow).otherwise(r)))


def _stars(spark, sf, points=48):
    """A closed ring for each order's customer group: a many-pointed outline of its own size, on whole four-decimal places."""
    k = F.col("ring_id")
    angle = lambda i: i * (2 * math.pi / points)
    radius = lambda i: 1.0 + (k % 5) + F.when(i % 2 == 0, 0.0).otherwise(0.004 * (1 + k % 7))
    at = lambda i: F.struct(F.round(radius(i) * F.cos(angle(i)), 4).alias("lon"), F.round(radius(i) * F.sin(angle(i)), 4).alias("lat"))
    corners = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)
    ids = spread(_read(spark, sf, "customer").select(F.col("c_custkey").alias("ring_id")), "ring_id")
    return ids.select("ring_id", F.concat(corners, F.slice(corners, 1, 1)).alias("ring"))


def _ragged(spark, sf):
    """A feature for each customer: a diamond with needless points, every second with a hole, every third with a speck whose hole is large; every fourth is the speck alone."""
    k = F.col("c_custkey")
    r = 1.0 + (k % 5)
    mid = lambda a, b: F.struct(((a["lon"] + b["lon"]) / 2).alias("lon"), ((a["lat"] + b["lat"]) / 2).alias("lat"))
    ring = _diamond(F.lit(10.0), F.lit(20.0), r)
    dense = F.concat(F.flatten(F.zip_with(F.slice(ring, 1, 4), F.slice(ring, 2, 4), lambda a, b: F.array(a, mid(a, b)))), F.slice(ring, 1, 1))
    part = F.when(k % 2 == 0, F.array(dense, _box(F.lit(9.8), F.lit(19.8), 0.3, hole=True))).otherwise(F.array(dense))
    speck = F.array(_diamond(F.lit(30.0), F.lit(0.0), F.lit(0.01)), _diamond(F.lit(30.0), F.lit(0.0), F.lit(0.5), hole=True))
    polygons = F.when(k % 4 == 0, F.array(speck)).when(k % 3 == 0, F.array(part, speck)).otherwise(F.array(part))
    return spread(_read(spark, sf, "customer").select("c_custkey"), "c_custkey").select(k.alias("feature_id"), polygons.alias("polygons"))


@register("g2_simplify", """SELECT c_custkey AS feature_id, c_custkey % 4 = 0 AS dropped, CASE WHEN c_custkey % 4 <> 0 THEN 1 END AS n_parts, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 10 ELSE 5 END AS n_points,
CASE WHEN c_custkey % 4 <> 0 THEN CAST(round((2 * (1 + c_custkey % 5) * (1 + c_custkey % 5) - CASE WHEN c_custkey % 2 = 0 THEN 0.09e0 ELSE 0e0 END) * 1e4) AS BIGINT) END AS area FROM customer""")
def g2(spark, sf):
    """Features with needless points, holes and specks: an outline that goes takes its hole along, whatever the hole's size."""
    out = G.simplify_polygons(_ragged(spark, sf), 0.02, "feature_id")
    n = F.aggregate(F.flatten("polygons"), F.lit(0), lambda s, r: s + F.size(r))
    there = F.col("polygons").isNotNull()
    return out.select("feature_id", (~there).alias("dropped"), F.when(there, F.size("polygons")).alias("n_parts"), F.when(there, n).alias("n_points"), F.when(there, F.round(G.area(F.col("polygons")) * 1e4).cast("long")).alias("area"))


def _spoiled(spark, sf):
    """A feature for each customer, of two parts with a hole each, spoiled in one of eight ways."""
    k = F.col("c_custkey") % 8
    c = lambda x: F.lit(float(x))
    good, hole, more = _box(c(0), c(0), 4.0), _box(c(1), c(1), 1.0, hole=True), _box(c(10), c(0), 4.0)
    bow = _shape([(c(10), c(0)), (c(14), c(4)), (c(14), c(0)), (c(10), c(4))])
    parts = (
        F.when(k == 0, F.array(F.array(good, hole), F.array(more, _box(c(11), c(1), 1.0))))  # a hole that winds like an outline
        .when(k == 1, F.array(F.array(good, hole), F.array(bow)))
        .when(k == 2, F.array(F.array(good, F.slice(hole, 1, 3)), F.array(more)))
        .when(k == 3, F.array(F.array(good), F.array(F.slice(more, 1, 4))))
        .when(k == 4, F.array(F.array(_box(c(178), c(0), 4.0), hole), F.array(more)))
        .when(k == 5, F.array(F.array(good, hole), F.array().cast(f"array<array<{G.POINT}>>")))
        .when(k == 6, F.lit(None))
        .otherwise(F.array(F.array(good, hole), F.array(more)))
    )
    return spread(_read(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("feature_id"), parts.alias("polygons"))


@register("g1_polygon_faults", """SELECT c_custkey AS feature_id, CASE c_custkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS part, CASE c_custkey % 8 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS ring_no,
CASE c_custkey % 8 WHEN 0 THEN 'winding' WHEN 1 THEN 'winding' WHEN 2 THEN 'positions' WHEN 3 THEN 'open' WHEN 4 THEN 'range' WHEN 5 THEN 'no rings' ELSE 'geometry type' END AS fault FROM customer WHERE c_custkey % 8 <> 7""")
def g1_polygons(spark, sf):
    return G.polygon_faults(_spoiled(spark, sf), "feature_id")


@register("g2_dropped_features", "SELECT CAST(c_custkey AS BIGINT) AS ring_id, c_custkey % 4 = 0 AS dropped FROM customer")
def g2_dropped(spark, sf):
    """Every ring with whether it is left out, being under the tolerance's square."""
    k = F.col("ring_id")
    shrunk = F.when(k % 4 == 0, F.transform("ring", lambda p: F.struct((p["lon"] / 100).alias("lon"), (p["lat"] / 100).alias("lat")))).otherwise(F.col("ring"))
    return L.simplify(_stars(spark, sf).select("ring_id", shrunk.alias("ring")), 0.2).select("ring_id", "dropped")


_LADDER = [0.0005, 0.002, 0.01, 0.05, 0.2]


@register("g3_budget_ladder")
def g3(spark, sf):
    """The first tolerance of the ladder at which a slice's simplified rings fit its bytes."""
    rings = _stars(spark, sf).withColumn("slice", F.col("ring_id") % 20)
    return L.budget_ladder(L.ladder_sizes(rings, _LADDER), 4000)


@register("g4_feature_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name FROM customer WHERE c_custkey % 6 <> 0")
def g4(spark, sf):
    c = _read(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = c.select(k, F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 6 == 0, "").otherwise(F.col("c_mktsegment")).alias("subject"))
    return raw.select(k, F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("subject"), F.lit(""))).alias("name")).filter("name IS NOT NULL")


_HUES = "hues AS (SELECT name, CAST(h % 360 AS BIGINT) AS hue FROM walk WHERE i = length(name))"
_WALK = "RECURSIVE walk(name, i, h) AS (SELECT name, 0, CAST(2166136261 AS BIGINT) FROM ring UNION ALL SELECT name, i + 1, (xor(h, CAST(ascii(substr(name, i + 1, 1)) AS BIGINT)) * 16777619) % 4294967296 FROM walk WHERE i < length(name))"


@register("g5_layer_features", twin("SELECT s.year, step, ring_id, r.name, 'estimated' AS representation, 'n' || r.name AS source, hue, row_number() OVER (PARTITION BY s.year ORDER BY r.name) AS rank FROM ring r JOIN hues ON hues.name = r.name CROSS JOIN (SELECT year, row_number() OVER (ORDER BY t_from) - 1 AS step FROM slice) s", "ring", "slice", more=f"{_WALK},\n{_HUES}"))
def g5(spark, sf):
    features = _rings(spark, sf).select("ring_id", "name", F.lit("estimated").alias("representation"), F.concat(F.lit("n"), "name").alias("source"))
    return L.layer_features(bind(spark, sf, "slice"), features)


@register("j14_feature_owners", twin("SELECT ring_id, seed_id FROM ring LEFT JOIN entity ON seed_id = concat('ord-', cast(ring_id * 900 AS VARCHAR))", "ring", "entity"))
def j14(spark, sf):
    owned = bind(spark, sf, "ring").select("ring_id", F.concat(F.lit("ord-"), (F.col("ring_id") * 900).cast("string")).alias("owner"))
    return owned.join(bind(spark, sf, "entity").select("seed_id"), F.col("owner") == F.col("seed_id"), "left").select("ring_id", "seed_id")


@register("j14_feature_faults", twin("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 1 THEN 'representation' WHEN c_custkey % 4 <> 0 AND e.seed_id IS NULL THEN 'owner' WHEN c_custkey % 9 = 2 THEN 'name' WHEN c_custkey % 8 = 6 THEN 'geometry type' END AS fault
FROM customer LEFT JOIN entity e ON e.seed_id = concat('ord-', cast(c_custkey AS VARCHAR)) AND c_custkey % 4 <> 0""", "entity"))
def j14_faults(spark, sf):
    """Features against the known owners; one without an owner of its own is sound, one whose owner isn't known is not."""
    k = F.col("feature_id")
    entity = F.when(k % 4 != 0, F.concat(F.lit("ord-"), k.cast("string"))).when(k % 8 == 0, "")
    f = _spoiled(spark, sf).withColumns({"name": F.when(k % 9 == 2, "").otherwise("land"), "representation": F.when(k % 9 == 1, "guess").otherwise("estimated"), "entity": entity})
    return G.feature_faults(f, bind(spark, sf, "entity").select(F.col("seed_id").alias("entity"))).select(k.alias("c_custkey"), "fault")


@register("j17_pins", """WITH d AS (SELECT c_custkey AS id, c_custkey % 7 AS version FROM customer WHERE c_custkey % 10 <> 0),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN c_custkey % 7 + 1 ELSE c_custkey % 7 END AS version FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, c_custkey % 7 FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 11 <> 0),
h AS (SELECT id, count(*) AS n, max(version) AS have FROM p GROUP BY id)
SELECT * FROM (SELECT coalesce(d.id, h.id) AS id, CASE WHEN version IS NULL THEN 'undeclared' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN have <> version THEN 'version drift' END AS violation FROM d FULL OUTER JOIN h ON d.id = h.id) x WHERE violation IS NOT NULL""")
def j17(spark, sf):
    c, k = _read(spark, sf, "customer"), F.col("c_custkey")
    declared = c.filter(k % 10 != 0).select(k.alias("id"), (k % 7).alias("version"))
    payload = c.filter(k % 11 != 0).select(k.alias("id"), F.when(k % 13 == 0, k % 7 + 1).otherwise(k % 7).alias("version"))
    again = c.filter((k % 17 == 0) & (k % 11 != 0)).select(k.alias("id"), (k % 7).alias("version"))
    return L.reconcile(declared, payload.unionByName(again))


@register("p14_boundary_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN year(o_orderdate) END AS year, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN dayofyear(make_date(year(o_orderdate), month(o_orderdate), 1)) WHEN 2 THEN dayofyear(o_orderdate) END AS earliest_day,
CASE o_orderkey % 5 WHEN 0 THEN dayofyear(make_date(year(o_orderdate), 12, 31)) WHEN 1 THEN dayofyear(last_day(o_orderdate)) WHEN 2 THEN dayofyear(o_orderdate) END AS latest_day, CASE o_orderkey % 5 WHEN 3 THEN 'month' WHEN 4 THEN 'form' END AS fault FROM orders""")
def p14(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.concat(F.date_format(d, "yyyy"), F.lit("-13"))).otherwise(F.date_format(d, "yyyy/MM"))
    rows = _read(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", *(c.alias(n) for n, c in L.boundary_date(F.col("text")).items()))


_LIC = "CASE o_orderkey % 7 WHEN 0 THEN 'conflict' WHEN 1 THEN 'accepted by default' WHEN 2 THEN 'accepted' WHEN 3 THEN 'excluded' WHEN 4 THEN 'unknown' WHEN 5 THEN 'empty' ELSE 'accepted' END"


def _licensed(spark, sf):
    k = F.col("o_orderkey") % 7
    a = F.when(k == 0, "CC0").when(k == 2, " cc0-1.0 ").when(k == 3, "ODbL-1.0").when(k == 4, "WTFPL").when(k == 5, " ").otherwise(F.lit(None).cast("string"))
    b = F.when(k == 0, "CC-BY-4.0").when(k == 6, "public domain").otherwise(F.lit(None).cast("string"))
    return _read(spark, sf, "orders").select("o_orderkey", a.alias("a"), b.alias("b")).select("o_orderkey", L.license_of(F.col("a"), F.col("b")).alias("outcome"))


@register("p15_licences", f"SELECT o_orderkey, {_LIC} AS outcome FROM orders")
def p15(spark, sf):
    return _licensed(spark, sf)


@register("a13_licence_counts", f"SELECT outcome, count(*) AS n FROM (SELECT {_LIC} AS outcome FROM orders) x GROUP BY outcome")
def a13(spark, sf):
    return _licensed(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("a16_layer_coverage", twin("SELECT count(*) AS n_slices, min(t_from) AS least, max(t_to) AS most FROM slice", "slice"))
def a16(spark, sf):
    return bind(spark, sf, "slice").agg(F.count(F.lit(1)).alias("n_slices"), F.min("t_from").alias("least"), F.max("t_to").alias("most"))


@register("f15_map_modes", twin(f"SELECT input_order, CASE WHEN y < 1996 THEN 'paleo' WHEN s.year IS NOT NULL THEN 'political' WHEN y > 2035 THEN 'modern' ELSE 'void' END AS mode FROM (SELECT input_order, {_YEAR} + (input_order % 60) AS y FROM entity) e LEFT JOIN slice s ON y BETWEEN t_from AND t_to", "entity", "slice"))
def f15(spark, sf):
    y = F.floor(T.seconds_to_year(F.col("t0"))) + F.col("input_order") % 60
    j = L.covering(bind(spark, sf, "entity").select("input_order", y.alias("y")), F.col("y"), bind(spark, sf, "slice"))
    return j.select("input_order", L.map_mode(F.col("y") < 1996, F.col("slice_year").isNotNull(), F.col("y"), F.lit(2035)).alias("mode"))


@register("f15_void_reasons", "SELECT event_id, CASE WHEN y < -4.54e9 THEN 'no map: Earth does not exist yet (it forms \u2248 4.54 Ga)' WHEN y < -1e9 - (event_id % 7) * 1e8 THEN 'no map: no reconstruction earlier than ' || (1000 + event_id % 7 * 100) || ' Ma' END AS reason FROM (SELECT event_id, -1e6 * CAST(event_id % 6000 AS DOUBLE) AS y FROM events) e")
def f15_reasons(spark, sf):
    e = _read(spark, sf, "events").select("event_id", (F.lit(-1e6) * (F.col("event_id") % 6000).cast("double")).alias("y"))
    return e.select("event_id", L.void_reason(F.col("y"), F.lit(-1e9) - (F.col("event_id") % 7) * 1e8).alias("reason"))

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from deeptime.operators import layers as L
from deeptime.operators import polygons as G
from deeptime.plans import layers as PL
from deeptime.sources import records as R


def star(rng, x, y, r, n=40, hole=False):
    """A ring around a point; some of its radii are short."""
    ring = [(x + s * math.cos(2 * math.pi * k / n), y + s * math.sin(2 * math.pi * k / n)) for k in range(n) for s in [r * rng.uniform(0.4, 1)]]
    return (ring[::-1] if hole else ring) + [(ring[::-1] if hole else ring)[0]]


def features(rng, n):
    for k in range(n):
        x, y = rng.uniform(-150, 150), rng.uniform(-70, 70)
        part = [star(rng, x, y, 9)] + ([star(rng, x, y, 2, hole=True)] if k % 2 else [])
        yield k, [part] + ([[star(rng, x + 20, y, 0.5)]] if k % 3 else [])


def even_odd(part, x, y):
    odd = False
    for ring in part:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_points_by_covers_equal_the_ray_cast(spark):
    rng = random.Random(5)
    shapes = list(features(rng, 12))
    near = [(ring[0][0] + rng.uniform(-12, 12), ring[0][1] + rng.uniform(-12, 12)) for _, parts in shapes for ring in parts[0] for _ in range(120)]
    points = [(k, x, y) for k, (x, y) in enumerate([*near, *((rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200))])]
    frame = spark.createDataFrame(shapes, f"id int, polygons {G.POLYGONS}")
    at = spark.createDataFrame(points, "k int, lon double, lat double")
    got = sorted((r.k, r.id) for r in G.locate(at, frame, "id").collect())
    assert got == sorted((k, i) for k, x, y in points for i, parts in shapes if any(even_odd(p, x, y) for p in parts))
    sure, cast = G.located(at, frame, "id")
    assert sure.count() > 4 * cast.count()  # few rays
    assert G.locate(at, frame.limit(0), "id").count() == 0


def test_cells_inside_are_inside():
    rng = random.Random(2)
    for _, parts in features(rng, 6):
        cells = G.cover(parts)
        assert len({c[:3] for c in cells}) == len(cells) and len(cells) < 8 * G.EDGE_CELLS
        for level, cx, cy, inside in rng.sample(cells, 60):
            x, y = ((cx + rng.random()) * 360 / 2**level - 180, (cy + rng.random()) * 180 / 2**level - 90)
            assert not inside or any(even_odd(p, x, y) for p in parts)


def test_a_dropped_outline_takes_its_holes_along(spark):
    rng = random.Random(1)
    big, hole, speck = star(rng, 0, 0, 5), star(rng, 0, 0, 1, hole=True), star(rng, 50, 0, 0.01)
    rows = [(1, [[big, hole]]), (2, [[speck, hole], [big]]), (3, [[speck, hole]]), (4, [[big, star(rng, 0, 0, 0.01, hole=True)]]), (5, None), (6, [])]
    got = {r.id: r.polygons and [len(p) for p in r.polygons] for r in G.simplify_polygons(spark.createDataFrame(rows, f"id int, polygons {G.POLYGONS}"), 0.1, "id").collect()}
    assert got == {1: [2], 2: [1], 3: None, 4: [1], 5: None, 6: None}


def brute_crossings(c):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) > 0
    n = len(c) - 1
    return [(i, j) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1) and side(c[j], c[j + 1], c[i]) != side(c[j], c[j + 1], c[i + 1]) and side(c[i], c[i + 1], c[j]) != side(c[i], c[i + 1], c[j + 1])]


def test_crossings_of_sides_of_any_length_equal_all_pairs(spark):
    rng, rows = random.Random(3), []
    for k in range(12):
        ring = [(rng.uniform(-1, 1) * 10 ** rng.uniform(-4, 2), rng.uniform(-1, 1) * 10 ** rng.uniform(-4, 1.9)) for _ in range(30)]
        rows.append((k, [*ring, ring[0]]))
    got = {r.ring_id: r.n_crossings for r in L.crossings(spark.createDataFrame(rows, f"ring_id int, ring array<{G.POINT}>")).collect()}
    assert got == {k: n for k, ring in rows if (n := len(brute_crossings(ring)))}
    for _, ring in rows:
        found = L._crossing(np.array(ring))
        assert (found and found[:2]) == min(brute_crossings(ring), default=None)


def test_a_ring_of_a_hundred_thousand_vertices_takes_seconds(spark):
    n = 100_000
    t = np.linspace(0, 2 * math.pi, n, endpoint=False)
    r = 20 + np.sin(300 * t)
    ring = np.stack([r * np.cos(t), r * np.sin(t)], 1)
    ring[[n // 2, n // 2 + 40]] = ring[[n // 2 + 40, n // 2]]  # two points changed over: sides cross
    closed = np.vstack((ring, ring[:1]))
    began = time.time()
    assert L._crossing(closed) is not None
    out = L.simplified(closed, 0.0002)
    assert out is not None and L._crossing(out) is None and time.time() - began < 20
    began = time.time()
    frame = spark.createDataFrame([(1, closed.tolist())], "ring_id int, c array<array<double>>")
    ring_of = F.transform("c", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    assert L.crossings(frame.select("ring_id", ring_of.alias("ring"))).first().n_crossings > 0 and time.time() - began < 60


def test_both_kinds_of_geometry_are_read_and_written(spark, tmp_path):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    kinds = [("Polygon", [square]), ("MultiPolygon", [[square], [square, square]]), ("LineString", square), ("Polygon", "x")]
    doc = {"type": "FeatureCollection", "properties": {"year": 5, "t_from": 1, "t_to": 9, "label": "l", "source": "s"}, "features": [{"properties": {"name": "n", "representation": "exact"}, "geometry": {"type": t, "coordinates": c}} for t, c in kinds]}
    (tmp_path / "5.geojson").write_text(json.dumps(doc))
    slices, found = R.geojson_slices(spark, f"file://{tmp_path}")
    assert slices.first().fault is None
    got = [r.polygons and [len(p) for p in r.polygons] for r in found.orderBy("pos").collect()]
    assert got[:3] == [[1], [1, 2], None] and not got[3]
    text = [json.loads(r.t) if r.t else None for r in found.orderBy("pos").select(G.written_form(F.col("polygons")).alias("t")).collect()]
    assert text[:3] == [{"type": "Polygon", "coordinates": [square]}, {"type": "MultiPolygon", "coordinates": [[square], [square, square]]}, None]


def test_a_missing_owner_is_fatal(spark):
    f = spark.createDataFrame([("a", "known", "exact", [[[(0.0, 0.0)]]]), ("b", "unknown", "exact", [[[(0.0, 0.0)]]])], f"name string, entity string, representation string, polygons {G.POLYGONS}")
    faults = G.feature_faults(f, spark.createDataFrame([("known",)], "entity string"))
    with pytest.raises(ValueError, match="owner"):
        G.require_sound(faults)
    G.require_sound(faults.filter("name = 'a'"))


def test_crossings_of_alike_rings_are_not_broadcast(spark):
    """Very many alike rings make small files, by whose size Spark would send all their rows to the driver."""
    ring = [(float(k % 7), float(k * k % 11)) for k in range(40)]
    short = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    rows = [(k, r + r[:1]) for k, r in enumerate([ring] * 20)] + [(100, short), (101, short[:3] + short[:1]), (102, [])]
    out = L.crossings(spark.createDataFrame(rows, f"ring_id int, ring array<{G.POINT}>"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {r.ring_id: r.n_crossings for r in out.collect()} == {k: n for k, r in rows if r and (n := len(brute_crossings(r)))}
    assert out.filter("ring_id = 100").first().n_crossings == 1


def test_keys_of_a_small_file_are_spread_over_tasks(spark, tmp_path):
    spark.range(50).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    for made in (PL._stars, PL._ragged, PL._spoiled):
        assert made(spark, f"file://{tmp_path}").rdd.getNumPartitions() >= 16

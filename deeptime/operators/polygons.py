"""Polygons with holes and parts: parsing, faults, simplification, and points in them by cell covers.

A feature's ``polygons`` is an array of parts; a part is an array of closed rings, its
outline first and then its holes; a ring is an array of ``(lon, lat)``. A ``Polygon``
has one part, a ``MultiPolygon`` any number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deeptime.functions import vocab as V
from deeptime.operators.layers import crossings, in_ring, ring_area, ring_fault, simplified_all
from deeptime.sources.scratch import small, written

POINT = "struct<lon:double,lat:double>"
POLYGONS = f"array<array<array<{POINT}>>>"
#: Levels of the cell covers: a cell of level k is 360 / 2**k by 180 / 2**k degrees.
COARSE, FINE = 3, 11
#: Edge cells from which a feature's cells are split no further.
EDGE_CELLS = 512


def parsed(kind: Column, coordinates: Column) -> Column:
    """``polygons`` of a geometry's type and its coordinates as JSON text; null for other types and for what can't be read."""
    ring = "array<array<double>>"
    one, many = F.from_json(coordinates, f"array<{ring}>"), F.from_json(coordinates, f"array<array<{ring}>>")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    parts = F.when((kind == "Polygon") & one.isNotNull(), F.array(one)).when(kind == "MultiPolygon", many)
    return F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, point)))


def written_form(polygons: Column) -> Column:
    """``{"type", "coordinates"}`` as JSON text: one part is a ``Polygon``, more are a ``MultiPolygon``."""
    bare = F.transform(polygons, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), bare[0].alias("coordinates")))
    return F.when(F.size(polygons) == 1, one).when(F.size(polygons) > 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), bare.alias("coordinates"))))


def rings(features: DataFrame, key: str) -> DataFrame:
    """``key, part, ring_no, exterior, ring``: a row for each ring."""
    parts = features.select(key, F.posexplode("polygons").alias("part", "_p"))
    return parts.select(key, "part", F.posexplode("_p").alias("ring_no", "ring")).withColumn("exterior", F.col("ring_no") == 0)


def polygon_faults(features: DataFrame, key: str) -> DataFrame:
    """``key, part, ring_no, fault``: the first fault of each feature that has one.

    No parts, a part without rings, and for each ring the rules of ``ring_fault`` and then
    proper crossings of its sides.
    """
    none = F.when(F.col("polygons").isNull(), "geometry type").when(F.size("polygons") == 0, "empty")
    bare = features.withColumn("fault", none).filter("fault IS NOT NULL").select(key, F.lit(0).alias("part"), F.lit(0).alias("ring_no"), "fault")
    hollow = features.select(key, F.posexplode("polygons").alias("part", "_p")).filter(F.size("_p") == 0).select(key, "part", F.lit(0).alias("ring_no"), F.lit("no rings").alias("fault"))
    each = written(rings(features, key).withColumn("fault", ring_fault(F.col("ring"), F.col("exterior"))), "rings")
    plain = each.filter("fault IS NOT NULL").select(key, "part", "ring_no", "fault")
    sound = each.filter("fault IS NULL").select(F.struct(key, "part", "ring_no").alias("ring_id"), "ring")
    crossed = crossings(sound).select(f"ring_id.{key}", "ring_id.part", "ring_id.ring_no", F.lit("crossing").alias("fault"))
    every = bare.unionByName(hollow).unionByName(plain).unionByName(crossed)
    return every.groupBy(key).agg(F.min(F.struct("part", "ring_no", "fault")).alias("f")).select(key, "f.*")


def slice_faults(slices: DataFrame) -> DataFrame:
    """``slices(file, type, year, t_from, t_to, label, source, n_features)`` with the first rule that each breaks as ``fault``."""
    c = F.col
    fault = (
        F.when(F.coalesce(c("type"), F.lit("")) != "FeatureCollection", "type")
        .when(c("year").isNull() | c("t_from").isNull() | c("t_to").isNull(), "properties")
        .when(c("file") != F.concat(c("year").cast("string"), F.lit(".geojson")), "file name")
        .when(~c("year").between(c("t_from"), c("t_to")), "window")
        .when((F.coalesce(c("label"), F.lit("")) == "") | (F.coalesce(c("source"), F.lit("")) == ""), "label or source")
        .when(F.coalesce(c("n_features"), F.lit(0)) <= 0, "no features")
    )
    return slices.withColumn("fault", fault)


def feature_faults(features: DataFrame, owners: DataFrame) -> DataFrame:
    """Features ``(name, entity, representation, polygons)`` with the first rule that each breaks; ``owners(entity)`` are the known ones.

    A named owner that isn't known is a fault like any other: a layer with faults must not be built.
    """
    known = owners.select(F.col("entity").alias("_known")).distinct()
    j = features.join(known, F.col("entity") == F.col("_known"), "left")
    named = F.coalesce(F.col("entity"), F.lit("")) != ""
    fault = (
        F.when(~F.coalesce(F.col("representation").isin(V.REPRESENTATIONS), F.lit(False)), "representation")
        .when(named & F.col("_known").isNull(), "owner")
        .when(F.coalesce("name", F.lit("")) == "", "name")
        .when(F.col("polygons").isNull(), "geometry type")
    )
    return j.withColumn("fault", fault).drop("_known")


def require_sound(faults: DataFrame) -> None:
    """Raise if there is any fault; names the first few."""
    found = faults.filter("fault IS NOT NULL").limit(5).collect()
    if found:
        raise ValueError("; ".join(str(r.asDict()) for r in found))


def area(polygons: Column) -> Column:
    """Area in square degrees: outlines count counter-clockwise, holes clockwise, so they subtract."""
    part = lambda p: F.aggregate(F.transform(p, ring_area), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(polygons, part), F.lit(0.0), lambda s, x: s + x)


def _columns(column: pa.Array):
    """Features of an Arrow column as lists of parts, which are lists of ``(n, 2)`` arrays; cut by offsets, not point by point."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = column.values
    ringed = parts.values
    points = ringed.values
    xy = np.stack([points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)], 1) if len(points) else np.zeros((0, 2))
    at = [np.asarray(a.offsets) for a in (column, parts, ringed)]
    for k in range(len(column)):
        if not column[k].is_valid:
            yield None
            continue
        yield [[xy[at[2][r] : at[2][r + 1]] for r in range(at[1][p], at[1][p + 1])] for p in range(at[0][k], at[0][k + 1])]


def _arrow(features: list) -> pa.Array:
    """The inverse of ``_columns``."""
    rings_ = [r for f in features if f for p in f for r in p]
    xy = np.concatenate([np.zeros((0, 2)), *rings_])
    ends = lambda sizes: np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["lon", "lat"])
    ringed = pa.ListArray.from_arrays(ends([len(r) for r in rings_]), points)
    parts = pa.ListArray.from_arrays(ends([len(p) for f in features if f for p in f]), ringed)
    return pa.ListArray.from_arrays(ends([len(f or ()) for f in features]), parts, mask=pa.array([f is None for f in features]))


def reduced(features: list, tolerance: float) -> list:
    """Features' parts simplified, all rings together; an outline that goes takes its holes along. None where nothing is left."""
    rings_ = [(r, k == 0) for f in features for p in f or () for k, r in enumerate(p)]
    xy = np.concatenate([np.zeros((0, 2)), *(r for r, _ in rings_)])
    ends = np.concatenate(([0], np.cumsum([len(r) for r, _ in rings_]))).astype(np.int64)
    done = iter(simplified_all(xy, ends, tolerance, [outer for _, outer in rings_]))
    out = []
    for f in features:
        parts = [[next(done) for _ in p] for p in f or ()]
        out.append([[p[0], *(h for h in p[1:] if h is not None)] for p in parts if p and p[0] is not None] or None)
    return out


def simplify_polygons(features: DataFrame, tolerance: float, key: str) -> DataFrame:
    """``key, polygons`` simplified by Douglas-Peucker ring by ring, each feature in a task; null where nothing is left."""

    def run(batches):
        for batch in batches:
            out = reduced(list(_columns(batch.column(1))), tolerance)
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrow(out)], [key, "polygons"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, F.col("polygons").cast(POLYGONS).alias("polygons")).mapInArrow(run, f"{key} {kind}, polygons {POLYGONS}")


def cover(polygons: list):
    """Cells ``(level, cx, cy, inside)`` that cover a feature: inside it, or on an edge (which may be outside in part).

    Edge cells are split until there are many; an empty cell is judged by its centre.
    """
    ring_list = [r for part in polygons for r in part if len(r) > 1]
    if not ring_list:
        return []
    a, b = np.concatenate([r[:-1] for r in ring_list]), np.concatenate([r[1:] for r in ring_list])
    low, high = np.minimum(a, b), np.maximum(a, b)
    size = np.array([360.0, 180.0]) / (1 << COARSE)
    first, last = np.floor((low.min(0) + (180, 90)) / size).astype(int), np.floor((high.max(0) + (180, 90)) / size).astype(int)
    todo = [((cx, cy), np.arange(len(a))) for cx in range(first[0], last[0] + 1) for cy in range(first[1], last[1] + 1)]
    out = []
    for level in range(COARSE, FINE + 1):
        size = np.array([360.0, 180.0]) / (1 << level)
        edges, empty = [], []
        for cell, sides in todo:
            corner = np.array(cell) * size - (180, 90)
            touch = sides[((low[sides] <= corner + size) & (high[sides] >= corner)).all(1)]
            # both diagonals' sides: a side misses the box if all corners lie strictly on one side of it
            way = b[touch] - a[touch]
            spread = [way[:, 0] * (corner[1] + dy * size[1] - a[touch, 1]) - way[:, 1] * (corner[0] + dx * size[0] - a[touch, 0]) for dx in (0, 1) for dy in (0, 1)]
            touch = touch[~((np.min(spread, 0) > 0) | (np.max(spread, 0) < 0))] if len(touch) else touch
            (edges if len(touch) else empty).append((cell, touch))
        if empty:
            centre = (np.array([c for c, _ in empty]) + 0.5) * size - (180, 90)
            out += [(level, *c, True) for (c, _), inside in zip(empty, _even_odd(centre, a, b)) if inside]
        if level == FINE or len(edges) > EDGE_CELLS:
            return out + [(level, *c, False) for c, _ in edges]
        todo = [((2 * cx + dx, 2 * cy + dy), sides) for (cx, cy), sides in edges for dx in (0, 1) for dy in (0, 1)]
    return out


def _even_odd(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The even-odd rule for many points; those of one latitude share the crossings."""
    out = np.zeros(len(points), bool)
    for lat in np.unique(points[:, 1]):
        over = (a[:, 1] > lat) != (b[:, 1] > lat)
        x = np.sort((b[over, 0] - a[over, 0]) * (lat - a[over, 1]) / (b[over, 1] - a[over, 1]) + a[over, 0])
        mine = points[:, 1] == lat
        out[mine] = (len(x) - np.searchsorted(x, points[mine, 0], "right")) % 2 == 1
    return out


def covers(features: DataFrame, key: str) -> DataFrame:
    """``key, level, cx, cy, inside`` of each feature's cell cover, each feature in a task."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for k, f in enumerate(_columns(batch.column(1))):
                cells = cover(f) if f else []
                if cells:
                    level, cx, cy, inside = zip(*cells)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([k] * len(cells))), pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(inside)], [key, "level", "cx", "cy", "inside"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, F.col("polygons").cast(POLYGONS).alias("polygons")).mapInArrow(run, f"{key} {kind}, level int, cx long, cy long, inside boolean")


def in_polygons(polygons: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies in one of the parts, by the even-odd rule over a part's rings."""
    odd = lambda part: F.aggregate(F.transform(part, lambda r: in_ring(r, lon, lat)), F.lit(False), lambda s, x: s != x)
    return F.exists(polygons, odd)


def located(points: DataFrame, features: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(sure, cast)``: points with the features that hold them by an inside cell, and those for which a ray was cast.

    Points meet covers by an equi-join on cells, at each level that covers use.
    """
    cells = written(covers(features, key), "cell-covers")
    levels = F.broadcast(written(cells.select("level").distinct(), "cover-levels"))  # FINE at most
    n = F.expr("shiftleft(1L, level)")
    place = {"cx": F.floor((F.col("lon") + 180) * n / 360).cast("long"), "cy": F.floor((F.col("lat") + 90) * n / 180).cast("long")}
    met = points.join(levels).withColumns(place).join(small(cells), ["level", "cx", "cy"]).drop("level", "cx", "cy")
    met = written(met, "points-in-cells")
    sure = met.filter("inside").drop("inside")
    shapes = features.select(key, "polygons")
    cast = met.filter("NOT inside").drop("inside").join(small(shapes), key).filter(in_polygons(F.col("polygons"), F.col("lon"), F.col("lat"))).drop("polygons")
    # parts of a feature may share a cell
    return sure.dropDuplicates(), cast.dropDuplicates()


def locate(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Points ``(lon, lat, ...)`` with the ``key`` of every feature that holds them; ``points`` must have an identity of their own."""
    sure, cast = located(points, features, key)
    return sure.unionByName(cast).dropDuplicates()

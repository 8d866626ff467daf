"""Time-sliced layers: coverage windows, as-of joins, fronts, rings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deeptime.functions import text as X
from deeptime.sources.scratch import small, written

#: Side of a grid cell in degrees.
CELL = 10.0
#: Power of two of the least cell for sides: about a hundredth of a metre.
LEAST_SIDE = -23
#: Pairs of sides that are tested at once.
PAIRS = 1 << 20


def tile(starts: DataFrame, last: int) -> DataFrame:
    """``t_to`` of slices from the start of the next; the last runs to ``last``."""
    return starts.withColumn("t_to", F.coalesce(F.lead("t_from").over(Window.orderBy("t_from")) - 1, F.lit(last)))


def tiling_faults(slices: DataFrame) -> DataFrame:
    """Slices that leave a gap to the one before or overlap it."""
    before = F.lag("t_to").over(Window.orderBy("t_from"))
    fault = F.when(F.col("t_from") <= before, "overlap").when(F.col("t_from") > before + 1, "gap")
    return slices.withColumn("fault", fault).filter("fault IS NOT NULL")


def covering(rows: DataFrame, year: Column, slices: DataFrame) -> DataFrame:
    """Rows with the slice that holds their year; null where none does."""
    s = small(slices.select(F.col("year").alias("slice_year"), "t_from", "t_to"))
    return rows.withColumn("_y", year).join(s, F.col("_y").between(F.col("t_from"), F.col("t_to")), "left").drop("_y", "t_from", "t_to")


def composite(base: DataFrame, detail: DataFrame) -> DataFrame:
    """Base windows split where a detail starts, each with the first detail that is active at its start.

    ``base`` and ``detail`` have ``year, t_from, t_to``; ``base_year`` is the window that a part was cut from.
    """
    cuts = base.alias("b").join(small(detail.select(F.col("t_from").alias("cut"))), (F.col("cut") > F.col("b.t_from")) & (F.col("cut") <= F.col("b.t_to")), "left")
    starts = cuts.groupBy("year", "t_from", "t_to").agg(F.array_sort(F.array_distinct(F.concat(F.array("t_from"), F.collect_set("cut")))).alias("s"))
    parts = starts.select(F.col("year").alias("base_year"), "t_from", "t_to", "s", F.posexplode("s").alias("i", "start"))
    year = F.when(F.col("start") == F.col("t_from"), F.col("base_year")).otherwise(F.col("start"))
    parts = parts.select("base_year", year.alias("year"), F.col("start").alias("t_from"), F.coalesce(F.get("s", F.col("i") + 1) - 1, F.col("t_to")).alias("t_to"))
    d = small(detail.select(F.col("year").alias("detail_year"), F.col("t_from").alias("d0"), F.col("t_to").alias("d1")))
    hit = parts.join(d, F.col("t_from").between(F.col("d0"), F.col("d1")), "left")
    return hit.groupBy("base_year", "year", "t_from", "t_to").agg(F.min_by("detail_year", "d0").alias("detail_year"))


def composite_features(parts: DataFrame, base: DataFrame, detail: DataFrame) -> DataFrame:
    """``year, source, label`` and the features' columns: each composite window with all features of its two slices.

    ``base`` and ``detail`` are features with the ``year`` of their slice; the label names the slices that a window is made of.
    """
    label = F.concat_ws(" with ", F.col("base_year").cast("string"), F.col("detail_year").cast("string"))
    windows = parts.select("year", "base_year", "detail_year", label.alias("label"))

    def of(features, by, source):
        return windows.join(features.withColumnRenamed("year", by), by).drop("base_year", "detail_year").withColumn("source", F.lit(source))

    return of(base, "base_year", "base").unionByName(of(detail, "detail_year", "detail"))


def active(features: DataFrame, years: DataFrame) -> DataFrame:
    """Features active in each target year; a null start or end is open."""
    hit = (F.col("start_year").isNull() | (F.col("start_year") <= F.col("year"))) & (F.col("end_year").isNull() | (F.col("end_year") >= F.col("year")))
    return features.join(small(years), hit)


def front_at(positions: DataFrame, times: DataFrame) -> DataFrame:
    """Front of each entity at each time, interpolated vertex by vertex; held outside the dated range.

    ``positions(entity, valid_from, coords)`` with ``coords`` an array of ``(lon, lat)``.
    """
    w = Window.partitionBy("entity").orderBy("valid_from")
    p = positions.withColumn("next_from", F.lead("valid_from").over(w)).withColumn("next_coords", F.lead("coords").over(w)).withColumn("first", F.row_number().over(w) == 1)
    t = F.col("t")
    j = p.join(small(times), F.when(F.col("first"), F.lit(True)).otherwise(t >= F.col("valid_from")) & (F.col("next_from").isNull() | (t < F.col("next_from"))))
    j = j.withColumn("f", (t - F.col("valid_from")) / (F.col("next_from") - F.col("valid_from")))
    inside = F.col("next_from").isNotNull() & (t >= F.col("valid_from"))
    lerp = F.zip_with("coords", "next_coords", lambda a, b: F.struct((a["lon"] + (b["lon"] - a["lon"]) * F.col("f")).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * F.col("f")).alias("lat")))
    held = ~inside & (t != F.col("valid_from"))
    label = F.when(inside & (F.col("f") >= 0.5), F.col("next_from")).otherwise(F.col("valid_from"))
    return j.select("entity", "t", F.when(inside, lerp).otherwise(F.col("coords")).alias("coords"), held.alias("held"), label.alias("label_from"))


def front_faults(positions: DataFrame, owners: DataFrame) -> DataFrame:
    """First rule that each entity's dated positions break.

    ``positions(entity, valid_from, coords, file)``, ``owners(entity, t0, t1)``: two
    positions at least, on different dates, with one number of vertices, in one
    file, of a known owner and within its span.
    """
    g = positions.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("valid_from").alias("dates"), F.min(F.size("coords")).alias("least"), F.max(F.size("coords")).alias("most"),
        F.min("file").alias("a"), F.max("file").alias("b"), F.min("valid_from").alias("since"), F.max("valid_from").alias("until"),
    )
    fault = (
        F.when(F.col("n") < 2, "single")
        .when(F.col("dates") < F.col("n"), "repeated date")
        .when(F.col("least") != F.col("most"), "vertices")
        .when(F.col("a") != F.col("b"), "two files")
        .when(F.col("t0").isNull(), "no owner")
        .when((F.col("since") < F.col("t0")) | (F.col("until") > F.col("t1")), "outside owner")
    )
    return g.join(owners.select("entity", "t0", "t1"), "entity", "left").withColumn("fault", fault).filter("fault IS NOT NULL").select("entity", "fault")


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule for a closed ring of ``(lon, lat)``."""

    def crosses(e):
        a, b = e["0"], e["1"]
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(straddles, lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]).otherwise(False)

    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(e))


def locate(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points with the rings that hold them: equi-join on grid cells of the rings' boxes, then the ray cast."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    r = rings.withColumns({"lo0": F.array_min(F.col("ring.lon")), "lo1": F.array_max(F.col("ring.lon")), "la0": F.array_min(F.col("ring.lat")), "la1": F.array_max(F.col("ring.lat"))})
    r = r.withColumn("cx", F.explode(F.sequence(cell("lo0"), cell("lo1")))).withColumn("cy", F.explode(F.sequence(cell("la0"), cell("la1")))).drop("lo0", "lo1", "la0", "la1")
    p = points.withColumn("cx", cell("lon")).withColumn("cy", cell("lat"))
    return p.join(small(r), ["cx", "cy"]).filter(in_ring(F.col("ring"), F.col("lon"), F.col("lat"))).drop("cx", "cy", "ring")


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace rule, positive for counter-clockwise rings."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2


def ring_fault(ring: Column, exterior: Column) -> Column:
    """First rule that a ring breaks; null if it is sound. Crossings are checked apart."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    bad = F.exists(ring, lambda p: ~F.coalesce(X.valid_lon_lat(p["lon"], p["lat"]), F.lit(False)))
    return F.when(F.size(ring) < 4, "positions").when(bad, "range").when((first["lon"] != last["lon"]) | (first["lat"] != last["lat"]), "open").when((ring_area(ring) > 0) != exterior, "winding")


#: Sides up to which a ring's crossings are counted in its own row.
SHORT_RING = 12


def _side(p: Column, q: Column, r: Column) -> Column:
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]) > 0


def _own_crossings(ring: Column) -> Column:
    """Number of proper crossings between sides of one short ring, pair by pair."""
    points = F.transform(ring, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    sides = F.zip_with(F.slice(points, F.lit(1), F.size(ring) - 1), F.slice(points, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    last = F.size(ring) - 2

    def met(s, i):
        a, b = s["a"], s["b"]
        cross = lambda o: (_side(o["a"], o["b"], a) != _side(o["a"], o["b"], b)) & (_side(a, b, o["a"]) != _side(a, b, o["b"]))
        return F.size(F.filter(sides, lambda o, j: (j >= i + 2) & ~((i == 0) & (j == last)) & cross(o)))

    # three sides can't cross
    return F.when(F.size(ring) > 4, F.aggregate(F.transform(sides, met), F.lit(0).cast("long"), lambda n, m: n + m)).otherwise(F.lit(0).cast("long"))


def crossings(rings: DataFrame) -> DataFrame:
    """Number of proper crossings between sides of each ring, which ``ring_id`` names.

    Rings of ``SHORT_RING`` sides at most are judged in their own rows. Of longer ones a
    side lies in four cells at most of the least power of two that is as large as its box.
    It is entered there, and in the cells of each larger size that sides of its ring have, so
    two sides that cross share a cell of the larger one's size: long sides and dense stretches
    of short ones meet only what is near, whatever the ring's scale. These joins are shuffled:
    alike rings make small files, by whose size Spark would broadcast very many rows.
    """
    short = F.size("ring") <= SHORT_RING + 1
    own = rings.filter(short).select("ring_id", _own_crossings(F.col("ring")).alias("n_crossings")).filter("n_crossings > 0")
    seg = rings.filter(~short).select("ring_id", F.size("ring").alias("n"), F.posexplode(F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "s"))
    seg = seg.select("ring_id", (F.col("n") - 1).alias("n"), "i", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"))
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")), F.lit(2.0**LEAST_SIDE))
    seg = written(seg.withColumn("level", F.ceil(F.log2(extent)).cast("int")), "sides")
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    span = lambda a, b: F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b)))
    celled = lambda df: df.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    # as many sizes as powers of two
    sizes = seg.groupBy("ring_id").agg(F.collect_set("level").alias("levels"))
    o = seg.join(sizes.hint("merge"), "ring_id").withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels", "n")
    o = celled(o).select("ring_id", "level", "cx", "cy", F.col("i").alias("j"), *(F.col(c).alias("o" + c) for c in ("ax", "ay", "bx", "by")))
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)) > 0
    cross = (side("oax", "oay", "obx", "oby", "ax", "ay") != side("oax", "oay", "obx", "oby", "bx", "by")) & (side("ax", "ay", "bx", "by", "oax", "oay") != side("ax", "ay", "bx", "by", "obx", "oby"))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    apart = (high >= low + 2) & ~((low == 0) & (high == F.col("n") - 1))
    pairs = celled(seg).join(o.hint("merge"), ["ring_id", "level", "cx", "cy"]).filter(apart & cross).select("ring_id", low.alias("i"), high.alias("j")).distinct()
    return own.unionByName(pairs.groupBy("ring_id").agg(F.count(F.lit(1)).alias("n_crossings")))


def reconcile(declared: DataFrame, payload: DataFrame) -> DataFrame:
    """Full outer reconciliation of ``(id, version)`` pins with the rows of a payload."""
    have = payload.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("have"))
    j = declared.join(have, "id", "full_outer")
    why = F.when(F.col("version").isNull(), "undeclared").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("have") != F.col("version"), "version drift")
    return j.select("id", why.alias("violation")).filter("violation IS NOT NULL")


def boundary_date(text: Column) -> dict[str, Column]:
    """``YYYY[-MM[-DD]]`` as year, earliest and latest day of the year; ``fault`` where it is none."""
    pattern = r"^(-?\d{1,6})(?:-(\d\d)(?:-(\d\d))?)?$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    y, m, d = part(1), part(2), part(3)
    first = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(F.coalesce(m, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(d, F.lit(1)).cast("string"), 2, "0")), "yyyy-MM-dd")
    last = F.when(m.isNull(), F.add_months(F.trunc(first, "year"), 12) - F.expr("interval 1 day")).when(d.isNull(), F.last_day(first)).otherwise(first)
    fault = F.when(~text.rlike(pattern), "form").when(m.isNotNull() & ~m.between(1, 12), "month").when(first.isNull(), "day")
    return {"year": F.when(fault.isNull(), y), "earliest_day": F.dayofyear(first), "latest_day": F.dayofyear(last.cast("date")), "fault": fault}


# Licence tags that are accepted and excluded.
ACCEPTED_LICENSES = ["CC0", "CC0-1.0", "PUBLIC DOMAIN", "PUBLIC-DOMAIN"]
EXCLUDED_LICENSES = ["ODBL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0"]


def license_of(a: Column, b: Column) -> Column:
    """Outcome for the two spellings of a licence tag."""
    value = F.upper(F.trim(F.coalesce(a, b)))
    return (
        F.when(a.isNotNull() & b.isNotNull() & (F.trim(a) != F.trim(b)), "conflict")
        .when(value.isNull(), "accepted by default")
        .when(value == "", "empty")
        .when(value.isin(ACCEPTED_LICENSES), "accepted")
        .when(value.isin(EXCLUDED_LICENSES), "excluded")
        .otherwise("unknown")
    )


def map_mode(paleo: Column, political: Column, year: Column, political_to: Column) -> Column:
    return F.when(paleo, "paleo").when(political, "political").when(year > political_to, "modern").otherwise("void")


# Fixed value: the year in which Earth forms.
EARTH_FORMED_YEAR = -4.54e9


def void_reason(year: Column, paleo_from: Column) -> Column:
    """Why a year has no map; null where the reason is none of these."""
    early = F.concat(F.lit("no map: no reconstruction earlier than "), F.floor(-paleo_from / 1e6 + 0.5).cast("string"), F.lit(" Ma"))
    return F.when(year < EARTH_FORMED_YEAR, "no map: Earth does not exist yet (it forms \u2248 4.54 Ga)").when(year < paleo_from, early)


def budget_ladder(sizes: DataFrame, budget: int) -> DataFrame:
    """For each slice the first tolerance whose size fits the budget, else the last. ``sizes(slice, step, bytes)``."""
    fits = F.min(F.when(F.col("bytes") <= budget, F.col("step")))
    g = sizes.groupBy("slice", "step").agg(F.sum("bytes").alias("bytes")).groupBy("slice").agg(F.coalesce(fits, F.max("step")).alias("step"))
    return g


def ladder_sizes(rings: DataFrame, tolerances: list[float]) -> DataFrame:
    """``slice, step, bytes`` of ``rings(slice, ring_id, ring)`` simplified at every tolerance of the ladder."""
    each = simplify_steps(rings, tolerances, "slice")
    return each.select("slice", "step", F.coalesce(F.octet_length(F.to_json("ring")), F.lit(0)).cast("bigint").alias("bytes"))


def layer_features(slices: DataFrame, features: DataFrame) -> DataFrame:
    """Every feature in every slice ``(year, t_from)``, with the slice's step, the name's hue and its rank by name."""
    step = F.row_number().over(Window.orderBy("t_from")) - 1  # slices are few
    rows = features.withColumn("hue", X.hue(F.col("name"))).join(small(slices.select("year", step.alias("step"))))
    return rows.select("year", "step", "ring_id", "name", "representation", "source", "hue", F.row_number().over(Window.partitionBy("year").orderBy("name")).alias("rank"))


def _area(c: np.ndarray) -> float:
    return float((c[:-1, 0] * c[1:, 1] - c[1:, 0] * c[:-1, 1]).sum() / 2)


def _kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on both halves of a ring of different points, cut at the first and the point farthest from it; closed."""
    closed = np.vstack((points, points[:1]))
    far = int(((points - points[0]) ** 2).sum(1).argmax())
    marked, work = {0, far, len(points)}, [(0, far), (far, len(points))]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        way, off = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        length = float(np.hypot(*way))
        d = np.abs(way[0] * off[:, 1] - way[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        at = int(d.argmax())
        if d[at] > tolerance:
            marked.add(a + 1 + at)
            work += [(a, a + 1 + at), (a + 1 + at, b)]
    return closed[sorted(marked)]


def _pinch(c: np.ndarray):
    """Two places of a closed ring with the same point, other than its ends, the first such place first; None if there are none."""
    order = np.lexsort((c[:-1, 1], c[:-1, 0]))
    p = c[order]
    same = np.flatnonzero((p[1:] == p[:-1]).all(1))
    if not len(same):
        return None
    # equal points stay in their order on the ring
    k = same[order[same + 1].argmin()]
    return int(order[k]), int(order[k + 1])


def _crossing(c: np.ndarray):
    """Numbers of two sides of a closed ring that cross properly, and where; None if none do.

    A sweep from west to east: sides in order of their western ends meet those that begin
    before they end and whose latitudes overlap theirs, a bounded number of pairs at a time.
    """
    a, b, n = c[:-1], c[1:], len(c) - 1
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    west = low[order, 0]
    stop = np.searchsorted(west, high[order, 0], "right")
    many = np.maximum(stop - np.arange(n) - 1, 0)
    upto, at, best = np.cumsum(many), 0, None
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        k = np.repeat(np.arange(at, to), many[at:to])
        other = np.arange(len(k)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to]) + k + 1
        i, j = np.minimum(order[k], order[other]), np.maximum(order[k], order[other])
        near = (low[i, 1] <= high[j, 1]) & (high[i, 1] >= low[j, 1]) & (j >= i + 2) & ~((i == 0) & (j == n - 1))
        i, j = i[near], j[near]
        one, two, off = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        cross = one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (off[:, 0] * two[:, 1] - off[:, 1] * two[:, 0]) / cross, (off[:, 0] * one[:, 1] - off[:, 1] * one[:, 0]) / cross
        hit = np.flatnonzero((t > 0) & (t < 1) & (u > 0) & (u < 1))
        if len(hit):
            h = hit[np.lexsort((j[hit], i[hit]))[0]]
            if best is None or (i[h], j[h]) < best[:2]:
                best = int(i[h]), int(j[h]), a[i[h]] + t[h] * one[h]
        at = to
    return best


def _repaired(c: np.ndarray) -> np.ndarray:
    """A closed ring without pinches and crossings: of the two loops at each the larger one stays."""
    while len(c) > 4:
        if (pinch := _pinch(c)) is not None:
            i, j = pinch
            loops = c[i : j + 1], np.vstack((c[: i + 1], c[j + 1 :]))
        elif (met := _crossing(c)) is not None:
            i, j, x = met
            x = np.round(x, 4)[None]
            loops = np.vstack((x, c[i + 1 : j + 1], x)), np.vstack((c[: i + 1], x, c[j + 1 :]))
        else:
            break
        c = max(loops, key=lambda loop: abs(_area(loop)))
    return c


def simplified(ring: np.ndarray, tolerance: float, exterior: bool = True):
    """One closed ring ``(n, 2)`` simplified, repaired and wound; None if it is under the tolerance's square."""
    p = np.round(np.clip(ring, (-180, -90), (180, 90)), 4) + 0.0
    p = p[np.concatenate(([True], (p[1:] != p[:-1]).any(1)))] if len(p) else p
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    if len(p) < 3 or abs(_area(np.vstack((p, p[:1])))) < tolerance * tolerance:
        return None
    for t in (tolerance, tolerance / 4, tolerance / 16, 0.0):
        c = _repaired(_kept(p, t))
        if len(c) >= 4 and _area(c):
            return c if (_area(c) > 0) == exterior else c[::-1]
    return None


#: Points of a ring up to which it is simplified along with the others of its batch.
TOGETHER = 512


def _ends(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _first_max(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Greatest value of each run of ``d`` and the place of the first that has it; no run is empty."""
    most = np.maximum.reduceat(d, starts)
    there = np.flatnonzero(d == np.repeat(most, sizes))
    return most, there[np.searchsorted(there, starts)]


def _kept_together(xy: np.ndarray, ends: np.ndarray, tolerance: float):
    """``_kept`` of many rings, whose points lie one ring after the other; all segments of a level are cut at once."""
    sizes = np.diff(ends)
    _, far = _first_max(((xy - np.repeat(xy[ends[:-1]], sizes, 0)) ** 2).sum(1), ends[:-1], sizes)
    # closed: each ring has its first point again at its end
    ring = np.arange(len(sizes))
    begin, last = ends[:-1] + ring, ends[1:] + ring
    closed = np.insert(xy, ends[1:], xy[ends[:-1]], axis=0)
    marked = np.zeros(len(closed), bool)
    marked[begin] = marked[far + ring] = marked[last] = True
    a, b = np.concatenate((begin, far + ring)), np.concatenate((far + ring, last))
    while len(a := a[(more := b - a >= 2)]):
        b = b[more]
        many = b - a - 1
        starts = _ends(many)[:-1]
        at = np.arange(many.sum()) - np.repeat(starts - a - 1, many)
        way = closed[b] - closed[a]
        length = np.hypot(way[:, 0], way[:, 1])
        off = closed[at] - np.repeat(closed[a], many, 0)
        wx, wy, long = (np.repeat(v, many) for v in (way[:, 0], way[:, 1], length))
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(long > 0, np.abs(wx * off[:, 1] - wy * off[:, 0]) / long, np.hypot(off[:, 0], off[:, 1]))
        most, where = _first_max(d, starts, many)
        cut = most > tolerance
        mid = at[where[cut]]
        marked[mid] = True
        a, b = np.concatenate((a[cut], mid)), np.concatenate((mid, b[cut]))
    return closed[marked], _ends(np.add.reduceat(marked.astype(np.int64), begin))


def _faulty(xy: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether closed rings, one after the other, may have a pinch or a crossing; a ring that has one is never left out."""
    n = np.diff(ends)
    bad, ring = np.zeros(len(n), bool), np.repeat(np.arange(len(n)), n)
    inner = np.ones(len(xy), bool)
    inner[ends[1:] - 1] = False
    a, b, of = xy[inner], xy[np.flatnonzero(inner) + 1], ring[inner]
    order = np.lexsort((a[:, 1], a[:, 0], of))
    same = (a[order][1:] == a[order][:-1]).all(1) & (of[order][1:] == of[order][:-1])
    bad[of[order][1:][same]] = True
    low, high = np.minimum(a, b), np.maximum(a, b)
    # rings lie apart by more than the longitudes' range; what the sum loses is made up for
    order = np.lexsort((low[:, 0], of))
    west = of[order] * 1024.0 + low[order, 0]
    stop = np.searchsorted(west, of[order] * 1024.0 + high[order, 0] + 1e-5, "right")
    many = np.maximum(stop - np.arange(len(west)) - 1, 0)
    upto, at = np.cumsum(many), 0
    place = np.arange(len(a)) - (ends[:-1] - np.arange(len(n)))[of]
    while at < len(west):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        k = np.repeat(np.arange(at, to), many[at:to])
        other = np.arange(len(k)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to]) + k + 1
        i, j = np.minimum(order[k], order[other]), np.maximum(order[k], order[other])
        near = (low[i, 1] <= high[j, 1]) & (high[i, 1] >= low[j, 1]) & (j >= i + 2) & ~((place[i] == 0) & (place[j] == n[of[j]] - 2))
        i, j = i[near], j[near]
        one, two, off = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        cross = one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (off[:, 0] * two[:, 1] - off[:, 1] * two[:, 0]) / cross, (off[:, 0] * one[:, 1] - off[:, 1] * one[:, 0]) / cross
        bad[of[i[(t > 0) & (t < 1) & (u > 0) & (u < 1)]]] = True
        at = to
    return bad


def _areas(xy: np.ndarray, ends: np.ndarray, at_least: float):
    """Areas of closed rings of one point or more, those that are as near to 0 or ``at_least`` as rounding exactly as ``_area`` gives them."""
    x, y = xy[:-1], xy[1:]
    terms = np.append(x[:, 0] * y[:, 1] - y[:, 0] * x[:, 1], 0.0)
    terms[ends[1:] - 1] = 0.0
    area, scale = np.add.reduceat(terms, ends[:-1]) / 2, 1e-9 * np.add.reduceat(np.abs(terms), ends[:-1])
    for k in np.flatnonzero((np.abs(area) <= scale) | (np.abs(np.abs(area) - at_least) <= scale)):
        area[k] = _area(xy[ends[k] : ends[k + 1]])
    return area


def simplified_all(xy: np.ndarray, ends: np.ndarray, tolerance: float, exterior) -> list:
    """``simplified`` of many rings, whose points lie one ring after the other in ``xy``: ring ``k`` from ``ends[k]`` to ``ends[k + 1]``."""
    out, sizes = [None] * (len(ends) - 1), np.diff(ends)
    finite = np.append(np.cumsum(np.append(0, ~np.isfinite(xy).all(1))), 0)
    plain = (sizes <= TOGETHER) & (sizes > 0) & (finite[ends[1:]] == finite[ends[:-1]])
    for k in np.flatnonzero(~plain):
        out[k] = simplified(xy[ends[k] : ends[k + 1]], tolerance, bool(exterior[k]))
    left = np.flatnonzero(plain)
    if not len(left):
        return out
    p = np.round(np.clip(xy[np.repeat(plain, sizes)], (-180, -90), (180, 90)), 4) + 0.0
    ends = _ends(sizes[left])
    fresh = np.append(True, (p[1:] != p[:-1]).any(1))
    fresh[ends[:-1]] = True
    p, ends = p[fresh], _ends(np.add.reduceat(fresh.astype(np.int64), ends[:-1]))
    twice = (np.diff(ends) > 1) & (p[ends[:-1]] == p[ends[1:] - 1]).all(1)
    keep = np.ones(len(p), bool)
    keep[(ends[1:] - 1)[twice]] = False
    p, ends = p[keep], _ends(np.diff(ends) - twice)

    def only(xy, ends, which):
        return xy[np.repeat(which, np.diff(ends))], _ends(np.diff(ends)[which])

    which = np.diff(ends) >= 3
    (p, ends), left = only(p, ends, which), left[which]
    if len(left):
        closed = np.insert(p, ends[1:], p[ends[:-1]], axis=0)
        which = np.abs(_areas(closed, ends + np.arange(len(ends)), tolerance * tolerance)) >= tolerance * tolerance
        (p, ends), left = only(p, ends, which), left[which]
    for t in (tolerance, tolerance / 4, tolerance / 16, 0.0):
        if not len(left):
            break
        c, at = _kept_together(p, ends, t)
        bad, area, again = _faulty(c, at), _areas(c, at, 0.0), np.zeros(len(left), bool)
        for k, ring in enumerate(left):
            one, size = c[at[k] : at[k + 1]], area[k]
            if bad[k]:
                one = _repaired(one)
                size = _area(one)
            if len(one) >= 4 and size:
                out[ring] = one if (size > 0) == bool(exterior[ring]) else one[::-1]
            else:
                again[k] = True
        (p, ends), left = only(p, ends, again), left[again]
    return out


def ring_points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points ``(n, 2)`` of an Arrow column of rings and the places where rings begin and end."""
    at, points = np.asarray(rings.offsets).astype(np.int64), rings.values
    of = lambda name: points.field(name).to_numpy(zero_copy_only=False).astype(float)
    return np.stack([of("lon"), of("lat")], 1)[at[0] : at[-1]], at - at[0]


def ring_column(rings: list) -> pa.Array:
    """An Arrow column of rings; None is null."""
    xy = np.concatenate([np.zeros((0, 2)), *(r for r in rings if r is not None)])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["lon", "lat"])
    ends = _ends([0 if r is None else len(r) for r in rings]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), points, mask=pa.array([r is None for r in rings], pa.bool_()))


def simplify(rings: DataFrame, tolerance: float, *more: str) -> DataFrame:
    """``ring_id, ring, dropped`` and the columns ``more`` of ``rings``: closed rings simplified by Douglas-Peucker, each in a task.

    Coordinates are clamped and rounded to four decimals; a ring that keeps
    fewer than four positions is tried at a quarter, a sixteenth and none of the
    tolerance; pinches and crossings are cut off; outlines are wound
    counter-clockwise, holes (where ``exterior`` is given and false) clockwise.
    Rings under the tolerance's square are ``dropped`` and have no ring. The rings of a batch are
    worked on together.
    """
    return simplify_steps(rings, [tolerance], *more).drop("step")


def simplify_steps(rings: DataFrame, tolerances: list[float], *more: str) -> DataFrame:
    """The rows of ``simplify`` for each of ``tolerances``, whose place in the list is ``step``; rings are read once for all of them."""
    has = "exterior" in rings.columns

    def run(batches):
        for batch in batches:
            outer = np.array([bool(x) for x in batch.column(len(more) + 2).to_pylist()]) if has else np.ones(batch.num_rows, bool)
            xy, ends = ring_points(batch.column(len(more) + 1))
            for step, tolerance in enumerate(tolerances):
                out = simplified_all(xy, ends, tolerance, outer)
                columns = [*batch.columns[: len(more)], pa.array(np.full(len(out), step, np.int32)), batch.column(len(more)).cast(pa.int64()), ring_column(out), pa.array([c is None for c in out], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*more, "step", "ring_id", "ring", "dropped"])

    kinds = "".join(f"{m} {rings.schema[m].dataType.simpleString()}, " for m in more)
    return rings.select(*more, "ring_id", "ring", *(["exterior"] if has else [])).mapInArrow(run, f"{kinds}step int, ring_id long, ring array<struct<lon:double,lat:double>>, dropped boolean")

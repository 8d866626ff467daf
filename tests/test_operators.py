import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deeptime.functions import text as X
from deeptime.functions import time as T
from deeptime.functions import vocab as V
from deeptime.operators import dating as D
from deeptime.operators import insight as I
from deeptime.operators import layers as L
from deeptime.operators import model as M
from deeptime.operators import zoom as Z
from deeptime import catalog
from deeptime.plans import layers as PL
from deeptime.plans import zoom as PZ
from deeptime.sources import dump as S
from deeptime.sources import model_io as IO
from deeptime.sources import records as R


def test_diverse_top_equals_the_sequential_walk(spark):
    rng = random.Random(3)
    rows = []
    for cell in range(6):
        for i in range(400):
            cats = [V.CATEGORIES[rng.randrange(3 if cell % 2 else 13)] for _ in range(rng.randint(1, 3))]
            rows.append((cell % 3, cell, "all", f"s{i:03}", rng.randint(1, 40) / 100, cats))
    df = spark.createDataFrame(rows, "bucket int, win int, category string, slug string, importance double, cats array<string>")
    got = {}
    whole = Z.diverse_top(df, F.col("cats"), cap=50, per_category=12, prefix=9)
    for r in whole.collect():
        got.setdefault((r.bucket, r.win), []).append((r["rank"], r.slug))
    assert sorted(whole.collect()) == sorted(Z.diverse_top(df, F.col("cats"), cap=50, per_category=12, prefix=1).collect())
    for cell in range(6):
        used, want = {}, []
        for b, w, _, slug, imp, cats in sorted((r for r in rows if r[1] == cell), key=lambda r: (-r[4], r[3])):
            if len(want) == 50:
                break
            if all(used.get(c, 0) >= 12 for c in cats):
                continue
            for c in cats:
                used[c] = used.get(c, 0) + 1
            want.append(slug)
        assert [s for _, s in sorted(got[(cell % 3, cell)])] == want


def test_runs_serve_every_window_unchanged(spark):
    rng = random.Random(5)
    rows = [(1, w, "war", f"s{rng.randrange(3)}", 0.5) for w in rng.sample(range(-40, 40), 50)] + [(1, w, "war", "s9", 0.4) for w in range(-10, 12)]
    bodies = Z.chunk_bodies(Z.rank_cells(spark.createDataFrame(rows, "bucket int, win int, category string, slug string, importance double")))
    runs = Z.window_runs(bodies).collect()
    by_window = {w: r.body for r in runs for w in range(r.run_start, r.run_end + 1)}
    assert by_window == {r.win: r.body for r in bodies.collect()}
    assert len(runs) < len(by_window) and Z.run_violations(Z.window_runs(bodies)).count() == 0


def test_contemporaries_equal_the_nested_loop(spark):
    rng = random.Random(7)
    rows = [(f"e{i}", t := rng.uniform(-3e7, 3e7), t + rng.choice([0.0, 3e4, 1e6, 4e7]), rng.randint(1, 20) / 20) for i in range(300)]
    df = spark.createDataFrame(rows, "seed_id string, t0 double, t1 double, importance double")
    got = {}
    for r in M.contemporaries(df, top=7).collect():
        got.setdefault(r.sid, []).append((r.pos, r.oid))
    for i, a0, a1, _ in rows:
        hit = [(-m, j, b0) for j, b0, b1, m in rows if j != i and b1 >= a0 and b0 <= a1 and b1 - b0 <= 50 * max(a1 - a0, 86400.0)]
        want = [j for _, j, _ in sorted(sorted(hit)[:7], key=lambda x: (x[2], x[1]))]
        assert [j for _, j in sorted(got.get(i, []))] == want


def test_slugs_and_their_marks(spark):
    names = ["Battle of Łódź", "Straße — Ærø", "ÉCOLE d'été", "  ", "x" * 90, "été", "東京 1945", "--a--b--"]
    got = [r.s for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(X.slugify(F.col("n")).alias("s")).collect()]
    assert got == ["battle-of-lodz", "strasse-aero", "ecole-d-ete", "", "x" * 80, "ete", "1945", "a-b"]


def test_slug_collisions(spark):
    rows = [("a", "War", "event", 0.0, 0.9, ""), ("b", "War", "event", 0.0, 0.8, ""), ("c", "War", "event", 0.0, 0.7, ""), ("d", "War", "event", 0.0, 0.6, "Q7"), ("e", "War", "event", 0.0, 0.5, ""), ("f", "War", "event", -1.4e11, 0.4, "")]
    df = spark.createDataFrame(rows, "seed_id string, name string, type string, t0 double, importance double, wikidata string")
    got = {r.seed_id: r.slug for r in M.assign_slugs(df).collect()}
    assert got == {"a": "war", "b": "war-1970", "c": "war-event", "d": "war-q7", "e": None, "f": "war--2466"}
    assert M.slug_conflicts(M.assign_slugs(df)).count() == 1


KNOWN = [
    # calendar, astronomical year, month, day, precision, start second, label
    ("julian", -43, 3, 15, 11, "-0043-03-13", "day"),
    ("gregorian", 1582, 10, 15, 11, "1582-10-15", "day"),
    ("julian", 1582, 10, 5, 11, "1582-10-15", "day"),
    ("julian", 1900, 2, 29, 11, "1900-03-13", "day"),
    ("gregorian", 2000, 7, 9, 9, "2000-01-01", "year"),
    ("gregorian", 1999, 12, 31, 10, "1999-12-01", "month"),
]


def days(text):
    sign, text = (-1, text[1:]) if text[0] == "-" else (1, text)
    y, m, d = map(int, text.split("-"))
    y *= sign
    a = (14 - m) // 12
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - yy // 100 + yy // 400 - 32045 - 2440588


def facts(spark, rows):
    return spark.createDataFrame([(i, i, "P585", *r) for i, r in enumerate(rows)], "event_id int, item int, property string, calendar string, y bigint, m int, d int, precision int, before int, after int")


def test_known_dates(spark):
    got = D.converted(facts(spark, [(c, y, m, d, p, 0, 0) for c, y, m, d, p, _, _ in KNOWN])).orderBy("item").collect()
    assert [(r.t0, r.label) for r in got] == [(days(t) * 86400.0, label) for *_, t, label in KNOWN]


def test_refused_and_widened_dates(spark):
    rows = [("gregorian", 1900, 2, 29, 11, 0, 0), ("gregorian", 1900, 0, 0, 10, 0, 0), ("lunar", 1900, 1, 1, 9, 0, 0), ("gregorian", 1900, 1, 1, 15, 0, 0), ("gregorian", -5000, 1, 1, 9, 0, 0), ("gregorian", 1900, 1, 1, 9, -1, 0), ("gregorian", 2001, 5, 5, 11, 30, 30), ("gregorian", -4_500_000_000, 0, 0, 3, 0, 0)]
    got = D.converted(facts(spark, rows)).orderBy("item").collect()
    assert [r.failure for r in got] == ["date", "date", "calendar", "precision", "range", "uncertainty", None, None]
    assert got[6].label == "year" and got[6].t1 - got[6].t0 == 61 * 86400.0
    assert got[7].label == "million_year" and got[7].year == -4.5e9


def test_census_years(spark):
    rows = [("day", "1999-12-31", 1999.0), ("year", "1999-12-20", 1999.0), ("year", "1900-01-01", 1900.0), ("day", "-0044-12-31", -44.0)]
    df = spark.createDataFrame([(p, days(t) * 86400.0, y) for p, t, y in rows], "precision string, t double, y double")
    assert all(r.got == r.y for r in df.select("y", T.census_year(F.col("t"), F.col("precision")).alias("got")).collect())


def test_bucket_ranges(spark):
    rows = [(0.0, 0.0, "day", 1.0), (0.0, 0.0, "day", 0.01), (0.0, 1e9, "second", 0.5), (-4e17, -4e17, "billion_year", 0.93), (2e18, 2e18, "day", 0.5)]
    got = Z.bucketize(spark.createDataFrame(rows, "t0 double, t1 double, precision string, importance double")).collect()
    assert [(r.bucket_min, r.bucket_max) for r in got] == [(0, 12), (12, 12), (9, 11), (0, 2), (2, 2)]


def test_reject_reasons_in_order(spark):
    base = dict(seed_id="a", name="n", type="event", status="observed", importance=0.5, precision="day", t0=0.0, t1=1.0, lon=1.0, lat=2.0, cats=["war"], rel=[("part_of", "b")], props=[("p", "s", "1999", "measured", 1.0, None, None)])
    cases = [({}, None), ({"seed_id": ""}, "missing id"), ({"type": None}, 'unknown entity type ""'), ({"importance": None}, "importance outside (0,1]"), ({"cats": []}, "no categories"), ({"cats": ["war", "x"]}, 'unknown category "x"'),
             ({"rel": [("loves", "b")]}, 'unknown relationship type "loves"'), ({"rel": [("part_of", "")]}, 'relationship "part_of" with empty target'), ({"props": [("p", "", "1999", "measured", 1.0, None, None)]}, 'property "p" missing source'),
             ({"props": [("p", "s", "1999", "measured", None, 1.0, None)]}, 'property "p" needs value or min+max'), ({"lat": None}, "point not a valid [lon,lat]"), ({"t1": -1.0}, "invalid time range"), ({"t1": 2e18}, "far time requires billion_year precision")]
    schema = "seed_id string, name string, type string, status string, importance double, precision string, t0 double, t1 double, lon double, lat double, cats array<string>, rel array<struct<type:string,target:string>>, props array<struct<property:string,source:string,published_at:string,value_type:string,value:double,min:double,max:double>>"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)
    got = [r.w for r in df.select(M.reject_reason(F.col("cats"), F.col("rel"), F.col("props")).alias("w")).collect()]
    assert got == [w for _, w in cases]


def test_dump_lines(spark, tmp_path):
    item = '{"type":"item","id":"Q1","labels":{"en":{"value":"x"}},"claims":{"P31":[{"rank":"normal","mainsnak":{"snaktype":"value","property":"P31","datatype":"wikibase-item","datavalue":{"type":"wikibase-entityid","value":{"id":"Q178561"}}}}],"P585":[{"rank":"normal","mainsnak":{"snaktype":"value","property":"P585","datatype":"time","datavalue":{"type":"time","value":{"time":"-0044-03-15T00:00:00Z","precision":"11","timezone":0,"before":0,"after":0,"calendarmodel":"http://www.wikidata.org/entity/Q1985786"}}}},{"rank":"deprecated","mainsnak":{}}]},"sitelinks":{"enwiki":{"title":"X"}}}'
    (tmp_path / "part.json").write_text("[\n" + item + ",\n" + '{"type":"property","id":"P31"},\n{"type":"item","id":"X2"},\n{"type":"lexeme","id":"L1"}\n]\n')
    parsed = S.parse(S.lines(spark, str(tmp_path)))
    assert {(r.id, r.violation) for r in S.violations(parsed).collect()} == {("X2", "invalid item id"), ("L1", "unknown entity kind")}
    facts = sorted(S.time_facts(parsed).collect(), key=lambda r: r.pos)
    assert [(f.skip, f.y, f.m, f.d, f.precision, f.calendar) for f in facts] == [(None, -43, 3, 15, 11, "julian"), ("statement_rank_not_used", None, None, None, None, None)]
    assert [(r.outcome, r.type) for r in S.classify(S.class_ids(parsed)).collect()] == [("typed", "event")]


def test_curated_files(spark, tmp_path):
    (tmp_path / "b.ndjson").write_text('# note\n\n{"id":"x","t0":"1999-01-01"}\n{broken\n')
    good, bad = R.parse_lines(R.numbered_lines(spark, str(tmp_path)), comments=True)
    assert [(r.file, r.line, r.id) for r in good.collect()] == [("b.ndjson", 3, "x")] and [(r.line, r.reason) for r in bad.collect()] == [(4, "invalid JSON")]
    manifest = spark.createDataFrame([("b.ndjson", "0", 1), ("c.ndjson", "0", 1)], "file string, sha256 string, count int")
    assert {(r.file, r.fault) for r in R.manifest_faults(spark, str(tmp_path), manifest).collect()} == {("b.ndjson", "sha256"), ("c.ndjson", "missing")}


def test_slices_from_geojson(spark, tmp_path):
    body = '{"type":"FeatureCollection","properties":{"year":1990,"t_from":1990,"t_to":1999,"label":"l","source":"s"},"features":[{"properties":{"name":"A","representation":"exact"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}'
    (tmp_path / "1990.geojson").write_text(body)
    (tmp_path / "1991.geojson").write_text(body)
    slices, features = R.geojson_slices(spark, str(tmp_path))
    assert {(r.file, r.fault) for r in slices.collect()} == {("1990.geojson", None), ("1991.geojson", "file name")}
    assert {r.name for r in features.collect()} == {"A"}


@pytest.mark.parametrize("t,lon,held", [(-5.0, 0.0, True), (0.0, 0.0, False), (50.0, 5.0, False), (100.0, 10.0, False), (500.0, 10.0, True)])
def test_fronts_between_dates(spark, t, lon, held):
    p = spark.createDataFrame([("w", 0.0, [(0.0, 0.0)]), ("w", 100.0, [(10.0, 0.0)])], "entity string, valid_from double, coords array<struct<lon:double,lat:double>>")
    r = L.front_at(p, spark.createDataFrame([(t,)], "t double")).first()
    assert (r.coords[0].lon, r.held) == (lon, held)


def test_chunks_equal_the_plain_walk(spark):
    """The whole chunk job at the smallest scale, from buckets to runs."""
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {(r.bucket, r.category, r.run_start): (r.run_end, r.n_items, r.body, r.key) for r in catalog.queries()["e3_chunks"](spark, sf).collect()}
    cells = {}
    for e in PZ._bucketed(spark, sf).collect():
        cats = sorted({c for c in (e.cat0, e.cat1) if c})
        for b in range(e.bucket_min, e.bucket_max + 1):
            size = V.WINDOW_S[b]
            for w in range(math.floor(e.t0 / size), math.floor(e.t1 / size) + 1) if size else [0]:
                for c in [*cats, "all"]:
                    cells.setdefault((b, c), {}).setdefault(w, []).append((-e.importance, e.slug, cats))
    want = {}
    for (b, c), windows in cells.items():
        bodies = {}
        for w, items in windows.items():
            used, taken = {}, []
            for _, slug, cats in sorted(items):
                if len(taken) < V.CHUNK_CAP and (c != "all" or any(used.get(k, 0) < V.CATEGORY_CAP for k in cats)):
                    taken.append(slug)
                    for k in cats:
                        used[k] = used.get(k, 0) + 1
            bodies[w] = len(taken), hashlib.sha256("\n".join(taken).encode()).hexdigest()
        start = None
        for w in sorted(bodies):
            if start is None or w - 1 not in bodies or bodies[w - 1] != bodies[w]:
                start = w
            want[b, c, start] = (w, *bodies[w], f"chunks/T{b}/{start}/world/{c}.json")
    assert got == want


def test_runs_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK", 8)
    rows = [(1, w, "war", 1, "a" if -20 < w < 25 else "b") for w in range(-50, 60) if w not in (3, 40)] + [(1, w, "life", 1, str(w // 3)) for w in range(-9, 30)]
    runs = Z.window_runs(spark.createDataFrame(rows, "bucket int, win long, category string, n_items long, body string")).collect()
    assert sorted((r.category, r.run_start, r.run_end) for r in runs if r.category == "war") == [("war", -50, -20), ("war", -19, 2), ("war", 4, 24), ("war", 25, 39), ("war", 41, 59)]
    assert sorted((r.run_start, r.run_end) for r in runs if r.category == "life") == [(3 * k, 3 * k + 2) for k in range(-3, 10)]
    assert Z.run_violations(spark.createDataFrame(runs)).count() == 0
    odd = spark.createDataFrame([(1, "war", 7, 9), (1, "war", 9, 9), (1, "war", 30, 29), (1, "war", 33, 2**60), (1, "war", 200, 201)], "bucket int, category string, run_start long, run_end long")
    assert sorted((r.run_start, r.violation) for r in Z.run_violations(odd).collect()) == [(9, "overlap"), (30, "reversed"), (33, "unsafe"), (200, "overlap")]


def test_contemporaries_in_deep_time(spark):
    rows = [("sun", -1.4e17, 1.6e17, 0.9), ("end", 2e18, 3e18, 0.8), ("late", 2.5e18, 2.6e18, 0.7), ("far", 1e30, 2e30, 0.6), ("moment", 1.5e30, 1.5e30, 0.5), ("now", 0.0, 10.0, 0.4), ("day", -5.0, 5.0, 0.3)]
    got = {}
    for r in M.contemporaries(spark.createDataFrame(rows, "seed_id string, t0 double, t1 double, importance double")).collect():
        got.setdefault(r.sid, set()).add(r.oid)
    for i, a0, a1, _ in rows:
        span = max(a1 - a0, 86400.0)
        assert got.get(i, set()) == {j for j, b0, b1, _ in rows if j != i and b1 >= a0 and b0 <= a1 and b1 - b0 <= 50 * span}, i


def test_table_digest_equals_a_plain_sum(spark):
    import hashlib
    import json

    rows = [(1, "a", None), (2, 'q"é', 1.5), (2, 'q"é', 1.5)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    parts = [0, 0, 0, 0]
    for k, s, x in rows:
        h = hashlib.sha256(json.dumps({"k": k, "s": s, "x": x}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        for i in range(4):
            parts[i] += int(h[15 * i : 15 * i + 15], 16)
    want = hashlib.sha256(",".join(map(str, [len(rows), *parts])).encode()).hexdigest()
    assert {tuple(IO.table_digest(d).first()) for d in (df, df.repartition(3), df.orderBy("s"))} == {(3, want)}


def test_ring_repair(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    bow = [(0, 0), (4, 0), (4, 4), (1, -1), (0, 0)]  # the last sides cross the first
    eight = [(0, 0), (2, 2), (8, 2), (8, 8), (2, 8), (2, 2), (0, 1), (0, 0)]  # a small loop hangs on a corner
    rows = [(1, square, True), (2, square[::-1], True), (3, square, False), (4, bow, True), (5, eight, True), (6, [(0, 0), (0.01, 0), (0, 0.01), (0, 0)], True), (7, [(0, 0), (1, 1)], True), (8, [(0, 0), (2, 0.0001), (4, 0), (4, 4), (0, 4), (0, 0)], True)]
    frame = spark.createDataFrame([(k, [{"lon": float(x), "lat": float(y)} for x, y in r], e) for k, r, e in rows], "ring_id long, ring array<struct<lon:double,lat:double>>, exterior boolean")
    out = L.simplify(frame, 0.1)
    got = {r.ring_id: None if r.dropped else [(p.lon, p.lat) for p in r.ring] for r in out.collect()}
    area = lambda c: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:])) / 2
    assert got[6] is None and got[7] is None
    assert area(got[1]) == area(got[2]) == 16 and area(got[3]) == -16 and len(got[8]) == 5
    assert area(got[5]) == 36 and L._pinch(np.array(got[5])) is None
    assert L._crossing(np.array(got[4])) is None and area(got[4]) > 0
    assert L.crossings(out.filter("NOT dropped")).count() == 0


def test_budget_ladder_over_real_simplification(spark):
    got = {r.slice: r.step for r in catalog.queries()["g3_budget_ladder"](spark, "/root/testdata/sf0.001").collect()}
    sizes = {}
    for r in PL._stars(spark, "/root/testdata/sf0.001").collect():
        ring = np.array([(p.lon, p.lat) for p in r.ring])
        for step, tolerance in enumerate(PL._LADDER):
            c = L.simplified(ring, tolerance)
            n = len(json_text(c)) if c is not None else 0
            sizes[r.ring_id % 20, step] = sizes.get((r.ring_id % 20, step), 0) + n
    last = len(PL._LADDER) - 1
    assert got == {s: min([k for k in range(last + 1) if sizes[s, k] <= 4000], default=last) for s, _ in sizes}
    assert len(set(got.values())) > 1


def json_text(ring):
    number = lambda x: repr(float(x)) if abs(x) >= 1e-3 or x == 0 else f"{x:.1E}".replace("E-0", "E-")
    return "[" + ",".join(f'{{"lon":{number(x)},"lat":{number(y)}}}' for x, y in ring) + "]"


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b.txt").write_text("only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = R.numbered_lines(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.line, r.value) for r in rows if r.file == "a.txt") == [(i + 1, f"line {i}") for i in range(500)]
    assert [(r.line, r.value) for r in rows if r.file == "b.txt"] == [(1, "only")]


def test_hue_counts_utf16_units(spark):
    def plain(name):
        h, data = 2166136261, name.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619) % 2**32
        return h % 360

    names = ["", "France", "Åland", "漢", "a😀b"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", X.hue(F.col("name")).alias("hue")).collect()
    assert {r.name: r.hue for r in rows} == {n: plain(n) for n in names}


def test_during_equals_the_nested_loop_at_any_length_and_distance(spark):
    rng = random.Random(8)
    at = lambda: rng.choice((rng.uniform(-1e9, 1e9), rng.uniform(-4.3e17, 4.3e17), 0.0))
    span = lambda k, t: (k, t, t + rng.choice((0.0, 1e5, 3e8, 1e13, 5e17)))
    spans, events = [span(k, at()) for k in range(60)], [span(f"e{k}", at()) for k in range(60)]
    got = I.during(spark.createDataFrame(spans, "id int, a double, b double"), spark.createDataFrame(events, "seed_id string, t0 double, t1 double"), 31_556_952.0)
    want = sorted((i, s) for i, a, b in spans for s, t0, t1 in events if t0 <= b and t1 >= a)
    assert sorted((r.id, r.seed_id) for r in got.collect()) == want


def test_counts_during_equal_the_nested_loop_without_pairs(spark):
    rng = random.Random(23)
    at = lambda: rng.choice([rng.uniform(-50, 50), float(rng.randrange(-9, 9)), rng.uniform(-1e9, 1e9), rng.choice([-1, 1]) * 1e17])
    span = lambda k, t: (k, t, t + rng.choice([0.0, 0.25, 1.0, 7.5, 1e3, 3e9, 2e17]))
    spans, events = [span(k, at()) for k in range(150)], [span(f"e{k}", at()) for k in range(150)]
    got = I.during_counts(spark.createDataFrame(spans, "id int, a double, b double"), spark.createDataFrame(events, "seed_id string, t0 double, t1 double"))
    want = {i: [s for s, t0, t1 in events if t0 <= b and t1 >= a] for i, a, b in spans}
    assert {r.id: (r.n, r.least) for r in got.collect()} == {i: (len(m), min(m)) for i, m in want.items() if m}


def test_many_spans_and_events_at_one_time_make_no_pairs(spark):
    """A million overlaps from a thousand spans and a thousand events: nothing between is larger than both tables."""
    spans = spark.range(1000).selectExpr("id", "0D AS a", "100D AS b")
    events = spark.range(1000).selectExpr("lpad(cast(id AS string), 4, '0') AS seed_id", "50D AS t0", "60D AS t1")
    out = I.during_counts(spans, events)
    assert out.agg(F.min("n"), F.max("n"), F.max("least"), F.count("*")).first() == (1000, 1000, "0000", 1000)

def test_threshold_search_reads_on_until_its_last_place_beats_the_bound(spark):
    rng, day = random.Random(9), 86400.0
    rows = [(f"x{k:03}", t, t + rng.choice((0, 3, 90, 4000)) * day, rng.randrange(4) / 4) for k in range(150) for t in [rng.uniform(-3000, 3000) * day]]
    frame = spark.createDataFrame(rows, "seed_id string, t0 double, t1 double, importance double")
    want = {}
    for s, a, b, _ in rows:
        near = [(-i, o) for o, c, d, i in rows if o != s and d >= a and c <= b and d - c <= 50 * max(b - a, day)]
        want[s] = {o for _, o in sorted(near)[:7]}
    for read in ((1, 3), (2, 9, 30), (1000,)):
        got = {}
        for r in M.contemporaries(frame, top=7, read=read).collect():
            got.setdefault(r.sid, set()).add(r.oid)
        assert got == {s: o for s, o in want.items() if o}


def test_contemporaries_make_no_row_for_a_pair_that_is_not_taken(spark, monkeypatch):
    """Three hundred subjects at one time against as many: what is written between has no more rows than candidates and results."""
    sizes, written = [], M.written

    def count(df, label):
        out = written(df, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(M, "written", count)
    frame = spark.range(300).selectExpr("concat('s', lpad(cast(id AS string), 3, '0')) AS seed_id", "0D AS t0", "10D AS t1", "(id % 3 + 1) / 4D AS importance")
    got = M.contemporaries(frame, top=5, read=(8,)).collect()
    best = [f"s{k:03}" for k in range(2, 300, 3)]
    want = {f"s{k:03}": [b for b in best if b != f"s{k:03}"][:5] for k in range(300)}
    assert {s: [r.oid for r in sorted((r for r in got if r.sid == s), key=lambda r: r.pos)] for s in want} == want
    # one group, so its bins' candidates are listed once, not once a subject
    assert dict(sizes)["subject-groups"] == 1 and max(n for _, n in sizes) <= 1500

def test_documents_take_contemporaries_as_whole_lists_with_their_names(spark):
    """A row for each subject, names with it, by the lists that are read first and by those after the last round."""
    frame = spark.range(40).selectExpr("concat('s', lpad(cast(id AS string), 2, '0')) AS seed_id", "concat('name ', id) AS name", "cast(id AS double) AS t0", "10D + id * 86400 AS t1", "(id % 3 + 1) / 4D AS importance")
    pairs = sorted((r.sid, r.pos, r.oid) for r in M.contemporaries(frame, top=5).collect())
    for read in ((1,), (64,)):
        rows = M.met_by(frame, top=5, read=read, label="name").collect()
        assert len(rows) == len({r.sid for r in rows}) == 40
        assert sorted((r.sid, m.pos, m.oid) for r in rows for m in r.met) == pairs
        assert all([m.pos for m in r.met] == [1, 2, 3, 4, 5] and all(m.other == f"name {int(m.oid[1:])}" for m in r.met) for r in rows)

def test_contemporaries_of_short_spans_meet_in_few_groups(spark, monkeypatch):
    """Spans of a day over two years, and one that is longer: hundreds of bins of a day, which are put together."""
    sizes, written = {}, M.written

    def count(df, label):
        out = written(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(M, "written", count)
    day = 86400.0
    rows = [(f"d{k:03}", k * day, (k + k % 3) * day, (k * 7 % 10) / 10) for k in range(300)] + [("long", 0.0, 500 * day, 0.05)]
    got = {}
    for r in M.contemporaries(spark.createDataFrame(rows, "seed_id string, t0 double, t1 double, importance double"), top=3).collect():
        got.setdefault(r.sid, {})[r.pos] = r.oid
    for s, a, b, _ in rows:
        near = sorted((-i, c, o) for o, c, d, i in rows if o != s and d >= a and c <= b and d - c <= 50 * max(b - a, day))
        best = sorted(sorted((i, o, c) for i, c, o in near)[:3], key=lambda x: (x[2], x[1]))
        assert list(dict(sorted(got.get(s, {}).items())).values()) == [o for _, o, _ in best], s
    assert sizes["subject-groups"] <= 10


def test_wider_bins_that_hold_more_than_they_give_do_not_end_the_search(spark, monkeypatch):
    """Few short spans among many longer ones, whose bins give a part of their candidates in the first rounds."""
    monkeypatch.setattr(M, "CROWD", 0)
    rng, day = random.Random(12), 86400.0
    rows = [(f"s{k}", 40 * day * k, (40 * k + 1) * day, 0.5) for k in range(6)]
    rows += [(f"m{k:03}", t, t + rng.choice((5, 12, 30, 45)) * day, rng.randrange(4) / 4) for k in range(120) for t in [rng.uniform(-40, 240) * day]]
    frame = spark.createDataFrame(rows, "seed_id string, t0 double, t1 double, importance double")
    want = {}
    for s, a, b, _ in rows:
        near = sorted((-i, o, c) for o, c, d, i in rows if o != s and d >= a and c <= b and d - c <= 50 * max(b - a, day))[:10]
        want[s] = [o for _, o, _ in sorted(near, key=lambda x: (x[2], x[1]))]
    for read in ((1, 2), (4,), (500,)):
        got = {r.sid: [m.oid for m in r.met] for r in M.met_by(frame, top=10, read=read).collect()}
        assert got == {s: o for s, o in want.items() if o}


def test_rows_travel_to_their_contemporaries_and_none_is_lost(spark, monkeypatch):
    """Frames with columns of their own, in groups of more than one deal, with entities that nothing overlaps."""
    monkeypatch.setattr(M, "GROUP", 8)
    frame = spark.range(60).selectExpr("concat('s', lpad(cast(id AS string), 2, '0')) AS seed_id", "concat('name ', id) AS name", "IF(id < 50, 0D, id * 1e9D) AS t0", "IF(id < 50, id * 86400D, id * 1e9D) AS t1", "(id % 3 + 1) / 4D AS importance")
    docs = frame.selectExpr("seed_id", "t0", "t1", "IF(t0 = 0, array(named_struct('a', t1)), NULL) AS part")
    want = {r.sid: r.met for r in M.met_by(frame, top=5, label="name").collect()}
    for read in ((1,), (64,)):
        rows = M.met_by(frame, top=5, read=read, label="name", onto=docs).collect()
        assert sorted(r.seed_id for r in rows) == [f"s{k:02}" for k in range(60)]
        assert all((r.part is None) == (r.t0 > 0) and r.met == want.get(r.seed_id) for r in rows)
    assert len(want) == 50


def test_names_with_letters_changed_are_found(spark):
    rng = random.Random(10)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    names = ["ab", "", "Siege of Orleans", "siege of orlean", "Battle of Ulm", "Batle of Ulm", "aaaaaaaaaaaa", "abcdefghijk", "abcdefghijklm", "cdefghijk"]
    for _ in range(120):
        s = list(rng.choice(names))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randrange(2)] = rng.choice(["", "z", "q"])
        names.append("".join(s))
    rows = [(f"n{k:03}", n, "event", 10.0 * rng.randrange(4), None if k % 5 == 0 else 1.0 * (k % 3), 0.0) for k, n in enumerate(names)]
    got = {(r.a, r.b) for r in I.near_duplicates(spark.createDataFrame(rows, "seed_id string, name string, type string, t0 double, lon double, lat double"), 10.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[3] - b[3]) <= 10 and (a[4] is None or b[4] is None or abs(a[4] - b[4]) <= 1) and distance(a[1].lower(), b[1].lower()) <= 2}
    assert (sorted(got - want)[:3], sorted(want - got)[:3]) == ([], []) and len(want) > 100

"""Queries on sources, the stored model, publication, expectations and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deeptime.catalog import register
from deeptime.fixtures import bind, twin
from deeptime.functions import time as T
from deeptime.operators import dating as D
from deeptime.operators import model as M
from deeptime.operators import polygons as G
from deeptime.operators import sweep as SW
from deeptime.operators import viewport as VP
from deeptime.operators import zoom as Z
from deeptime.plans import history as PH
from deeptime.plans import layers as PL
from deeptime.plans import model as PM
from deeptime.plans import zoom as PZ
from deeptime.sources import digest_tree as DT
from deeptime.sources import model_io as IO
from deeptime.sources import records as R
from deeptime.sources.scratch import fresh as _fresh
from deeptime.sources.scratch import small, spread, written
from deeptime.streaming import ingest as ST


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _record_lines(spark, sf):
    e, o = bind(spark, sf, "entity"), F.col("input_order")
    body = F.to_json(F.struct(F.col("seed_id").alias("id"), "type", "name", F.concat(F.lit('{"y": '), (1900 + o % 200).cast("string"), F.lit("}")).alias("t0"), "precision", "status", F.array("cat0").alias("categories"), "importance"))
    return e.select(F.when(o % 31 == 0, F.concat(F.lit("# "), "name")).when(o % 37 == 0, F.lit("{broken")).when(o % 41 == 0, F.lit("  ")).otherwise(body).alias("value"), F.floor(o / 2000).alias("file"), o.alias("ord"))


def _file_key():
    """The number in the folder that a written part lies in."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"file=(\d+)", 1).cast("bigint")


def _as_files(lines, path, value=None, **options):
    """Write ``file, ord, value`` as one text file for each ``file``, its lines by ``ord``; ``value`` is made of a line after that, so that long ones are not sorted."""
    placed = spread(lines, "file").sortWithinPartitions("file", "ord")
    placed.select("file", F.col("value") if value is None else value.alias("value")).write.partitionBy("file").options(**options).text(path)


_KIND = "CASE WHEN input_order % 31 = 0 THEN {0} WHEN input_order % 37 = 0 THEN 'invalid JSON' WHEN input_order % 41 = 0 THEN 'skipped' {1} ELSE 'record' END"
_LINES = "SELECT CAST(input_order // 2000 AS BIGINT) AS file, row_number() OVER (PARTITION BY input_order // 2000 ORDER BY input_order) AS line, {0} AS kind FROM entity"


def _read_lines(good, bad):
    return good.select("file", "line", F.lit("record").alias("kind")).unionByName(bad.select("file", "line", F.col("reason").alias("kind")))


@register("s1_curated_source", twin(f"SELECT file, line, kind FROM ({_LINES.format(_KIND.format(repr('skipped'), ''))}) x WHERE kind <> 'skipped'", "entity"))
def s1(spark, sf):
    path = _fresh(spark, "curated")
    _as_files(_record_lines(spark, sf), path)
    return _read_lines(*R.parse_lines(R.numbered_lines(spark, path, _file_key()), comments=True))


@register("s2_bulk_source", twin(f"SELECT file, line, kind FROM ({_LINES.format(_KIND.format(repr('invalid JSON'), 'WHEN input_order % 1009 = 0 THEN ' + repr('line too long')))}) x WHERE kind <> 'skipped'", "entity"))
def s2(spark, sf):
    """Compressed bulk files with a line over the limit now and then."""
    path = _fresh(spark, "bulk")
    long = F.concat(F.lit('{"id": "'), F.repeat(F.lit("x"), R.MAX_LINE_BYTES), F.lit('"}'))
    o = F.col("ord")
    whole = (o % 31 != 0) & (o % 37 != 0) & (o % 41 != 0)
    _as_files(_record_lines(spark, sf), path, F.when(whole & (o % 1009 == 0), long).otherwise(F.col("value")), compression="gzip")
    return _read_lines(*R.bulk_lines(spark, path, _file_key()))


def _slices(spark, sf):
    """Slices written as one GeoJSON file for each supplier, spoiled in several ways, and read back.

    Features are a polygon with a hole, several polygons, or a line, which is no area.
    """
    k = F.col("s_suppkey")
    c = lambda x: F.lit(float(x))
    two = F.array(F.array(PL._box(c(0), c(0), 4.0), PL._box(c(1), c(1), 1.0, hole=True)), F.array(PL._box(c(10), c(0), 4.0)))
    area = lambda polygons: F.from_json(G.written_form(polygons), "type string, coordinates string")
    line = F.struct(F.lit("LineString").alias("type"), F.lit("[[0,0],[1,1]]").alias("coordinates"))
    kinds = F.array(area(F.slice(two, 1, 1)), area(two), line)
    # coordinates are text here and become plain JSON in the file
    feature = lambda g, i: F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.concat(F.lit("land "), i.cast("string")).alias("name"), F.lit("estimated").alias("representation"))), F.lit(',"geometry":{"type":"'), g["type"], F.lit('","coordinates":'), g["coordinates"], F.lit("}}"))
    features = F.when(k % 9 == 5, F.lit("")).otherwise(F.array_join(F.transform(kinds, feature), ","))
    year = 1000 + k
    props = F.to_json(F.struct(F.when(k % 9 != 1, year).alias("year"), (year - 2 + F.when(k % 9 == 3, 7).otherwise(0)).alias("t_from"), (year + 7).alias("t_to"), F.when(k % 9 == 4, "").otherwise("map").alias("label"), F.lit("atlas").alias("source")))
    doc = F.concat(F.lit('{"type":"'), F.when(k % 9 == 6, "Feature").otherwise("FeatureCollection"), F.lit('","properties":'), props, F.lit(',"features":['), features, F.lit("]}"))
    path = _fresh(spark, "slices")
    name = F.concat((year + F.when(k % 9 == 2, 1).otherwise(0)).cast("string"), F.lit(".geojson"))
    R.write_files(spread(_read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select((k % R.FOLDERS).alias("folder"), name.alias("name"), doc.alias("value")), path)
    return R.geojson_slices(spark, path, F.regexp_extract("_metadata.file_path", r"([0-9]+\.geojson)", 1))


_SLICE_FAULT = "CASE s_suppkey % 9 WHEN 1 THEN 'properties' WHEN 2 THEN 'file name' WHEN 3 THEN 'window' WHEN 4 THEN 'label or source' WHEN 5 THEN 'no features' WHEN 6 THEN 'type' END"


@register("s7_geojson_slices", f"SELECT CASE WHEN s_suppkey % 9 <> 1 THEN 1000 + s_suppkey END AS year, 998 + s_suppkey + CASE WHEN s_suppkey % 9 = 3 THEN 7 ELSE 0 END AS t_from, 1007 + s_suppkey AS t_to, {_SLICE_FAULT} AS fault FROM supplier")
def s7(spark, sf):
    """Every slice with the first rule that it breaks."""
    return _slices(spark, sf)[0].select("year", "t_from", "t_to", "fault")


@register("s7_feature_polygons", """SELECT CASE WHEN s_suppkey % 9 <> 1 THEN 1000 + s_suppkey END AS year, pos, 'land ' || pos AS name, CASE WHEN pos < 2 THEN pos + 1 END AS n_parts, CASE WHEN pos < 2 THEN pos + 2 END AS n_rings, CASE WHEN pos < 2 THEN 15e0 + 16e0 * pos END AS area
FROM supplier CROSS JOIN (VALUES (0), (1), (2)) p(pos) WHERE s_suppkey % 9 <> 5""")
def s7_features(spark, sf):
    """Every feature by parts and rings; a line has none."""
    p = F.col("polygons")
    there = p.isNotNull()
    return _slices(spark, sf)[1].select("year", "pos", "name", F.when(there, F.size(p)).alias("n_parts"), F.when(there, F.size(F.flatten(p))).alias("n_rings"), F.when(there, G.area(p)).alias("area"))


@register("s8_page_records", twin("""SELECT qid, min(label) AS label, min(t0) AS t0, count(*) AS n FROM (SELECT concat('Q', cast(o_custkey AS VARCHAR)) AS qid, concat('Order ', cast(o_orderkey AS VARCHAR)) AS label, epoch(o_orderdate) AS t0,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 0) x WHERE k = 1 GROUP BY qid"""))
def s8(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("ord"), F.concat(F.lit("http://example.org/entity/Q"), F.col("o_custkey").cast("string")).alias("item"), F.when(k % 6 == 0, F.concat(F.lit("Q"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("Order "), k.cast("string"))).alias("label"),
        F.when(k % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")).alias("date"), F.lit("Point(1.5 2.5)").alias("coord"), (k % 300).alias("links"),
    )
    return R.page_records(rows).select("qid", "label", "t0", F.lit(1).cast("bigint").alias("n"))


def _model(spark, sf):
    e, r, c = (bind(spark, sf, t) for t in ("entity", "relationship", "claim"))
    cats = e.select("seed_id", F.posexplode(F.filter(F.array("cat0", "cat1"), lambda x: x.isNotNull())).alias("ord", "category"))
    return {"entity": e, "entity_category": cats, "relationship": r, "claim": c}


_ROWS = {"entity": ("input_order", ["seed_id", "type", "precision"]), "entity_category": ("ord", ["seed_id", "category"]), "relationship": ("ord", ["seed_id", "type", "target"]), "claim": ("ord", ["seed_id", "property", "unit", "source"])}
_ROUND = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({o} AS BIGINT) AS ord, concat_ws('|', {', '.join(c)}) AS content FROM {n}" for n, (o, c) in _ROWS.items())


@register("s4_model_round_trip", twin(_ROUND, "entity", "relationship", "claim", more="entity_category AS (SELECT seed_id, 0 AS ord, cat0 AS category FROM entity UNION ALL SELECT seed_id, 1, cat1 FROM entity WHERE cat1 IS NOT NULL)"))
def s4(spark, sf):
    """The four tables are written, read back and compared by content."""
    path = _fresh(spark, "model")
    IO.write_model(path, **_model(spark, sf))
    out = None
    for name, df in IO.read_model(spark, path).items():
        order, columns = _ROWS[name]
        one = df.select(F.lit(name).alias("name"), F.col(order).cast("bigint").alias("ord"), F.concat_ws("|", *columns).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


@register("s4_table_order", twin("SELECT 'claim' AS name, count(*) AS n, 0 AS out_of_order, CAST(count(*) FILTER (WHERE seed_id < (SELECT max(seed_id) FROM claim WHERE seed_id LIKE '%7')) AS BIGINT) AS behind FROM claim WHERE seed_id NOT LIKE '%7'", "claim"))
def s4_order(spark, sf):
    """Rows that lie behind their key's place: none in the written table; in one that is written in two parts, the first with the ids that end in seven, all that sort before these."""
    claim, path = bind(spark, sf, "claim"), _fresh(spark, "model")
    IO.write_model(path, **_model(spark, sf))
    sound = IO.out_of_order(spark, f"{path}/claim", IO.KEYS["claim"]).count()
    spoiled, first = _fresh(spark, "spoiled"), F.col("seed_id").endswith("7")
    for k, part in enumerate((claim.filter(first), claim.filter(~first))):
        part.repartitionByRange("seed_id", "ord").sortWithinPartitions("seed_id", "ord").write.parquet(f"{spoiled}/file={k}")
    bad = IO.out_of_order(spark, spoiled, ["seed_id", "ord"])
    return claim.filter(~first).agg(F.lit("claim").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(sound).cast("int").alias("out_of_order"), F.lit(bad.count()).alias("behind"))


@register("t5_report_order", twin(f"""SELECT report, row_number() OVER (PARTITION BY report ORDER BY a, b) AS pos, content FROM (
SELECT 'histogram' AS report, type AS a, precision AS b, type || '|' || precision || '|' || count(*) AS content FROM entity GROUP BY type, precision
UNION ALL SELECT 'time claims', property, lpad(CAST(precision AS VARCHAR), 2, '0'), property || '|' || precision || '|' || count(*) FROM time_fact GROUP BY property, precision
UNION ALL SELECT 'import', CASE WHEN input_order % 2 = 0 THEN 'curated' ELSE 'bulk' END, coalesce(reason, 'accepted'), CASE WHEN input_order % 2 = 0 THEN 'curated' ELSE 'bulk' END || '|' || coalesce(reason, 'accepted') || '|' || count(*) FROM reasoned GROUP BY CASE WHEN input_order % 2 = 0 THEN 'curated' ELSE 'bulk' END, coalesce(reason, 'accepted')) r""", "entity", "time_fact", more=f"{PM.SPOILED},\n{PM.REASON}"))
def t5(spark, sf):
    """Three reports, written and read back: every row with its place."""
    out = None
    for name, report, order in (("histogram", PH.a1_histogram(spark, sf), ["type", "precision"]), ("time claims", PH.a6(spark, sf), ["property", "precision"]), ("import", PM.a8(spark, sf), ["source", "reason"])):
        path = _fresh(spark, "report")
        IO.write_report(report, path, order)
        one = IO.read_report(spark, path).select(F.lit(name).alias("report"), "pos", F.concat_ws("|", *order, "n").alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


@register("s5_model_faults", twin("""SELECT 'half a point' AS fault, seed_id AS id FROM entity WHERE lon IS NOT NULL AND input_order % 50 = 1 AND input_order % 40 <> 3 UNION ALL
SELECT 'order has gaps', CAST(max(input_order) - min(input_order) + 1 - count(*) AS VARCHAR) FROM entity WHERE input_order % 40 <> 3 HAVING max(input_order) - min(input_order) + 1 > count(*) UNION ALL
SELECT 'repeated slug', 'slug-' || (input_order // 2) FROM entity WHERE input_order % 40 <> 3 AND input_order % 60 IN (10, 11) GROUP BY input_order // 2 HAVING count(*) > 1 UNION ALL
SELECT 'child count', e.seed_id FROM entity e LEFT JOIN (SELECT target, count(*) AS n FROM relationship WHERE type = 'part_of' GROUP BY target) k ON k.target = e.seed_id WHERE input_order % 40 <> 3 AND input_order % 70 = 5 UNION ALL
SELECT 'missing target', r.seed_id FROM relationship r JOIN entity t ON t.seed_id = r.target WHERE t.input_order % 40 = 3 UNION ALL
SELECT 'orphan relationship', r.seed_id FROM relationship r JOIN entity t ON t.seed_id = r.seed_id WHERE t.input_order % 40 = 3 UNION ALL
SELECT 'orphan claim', c.seed_id FROM claim c JOIN entity t ON t.seed_id = c.seed_id WHERE t.input_order % 40 = 3""", "entity", "relationship", "claim"))
def s5(spark, sf):
    m = _model(spark, sf)
    kept = m["entity"].filter(F.col("input_order") % 40 != 3)
    m["entity_category"] = m["entity_category"].join(kept.select("seed_id"), "seed_id", "left_semi")
    o = F.col("input_order")
    slug = F.when((o % 60).isin(10, 11), F.concat(F.lit("slug-"), F.floor(o / 2).cast("string"))).otherwise(F.col("seed_id"))
    counted = kept.join(M.child_counts(m["relationship"]), "seed_id", "left")
    counted = counted.withColumn("child_count", F.coalesce("child_count", F.lit(0)) + F.when(o % 70 == 5, 1).otherwise(0))
    m["entity"] = counted.withColumn("lat", F.when(o % 50 != 1, F.col("lat"))).withColumn("slug", slug)
    return IO.model_faults(**m)


_CELLS = f"{PZ.BUCKETED},\n{PZ.SHOWN},\n{PZ.RANKED}"
_BODY = """'{"items":[' || string_agg('{"rank":' || rank || ',"slug":"' || slug || '"}', ',' ORDER BY rank) || ']}'"""


def _chunk_documents(spark, sf):
    """``key, body, category`` of the chunk documents: one for each run of windows with equal items."""
    runs = SW.chunk_runs(PZ._with_categories(spark, sf), F.col("cats"), items=True)
    item = lambda slug, k: F.struct((k + 1).alias("rank"), slug.alias("slug"))
    body = F.to_json(F.struct(F.transform("items", item).alias("items")))
    return runs.select(VP.chunk_keys(runs).alias("key"), body.alias("body"), "category", "run_start", "run_end")


def _published_chunks(spark, sf, kind):
    """All chunk documents are published and read back; the digests of those of one kind."""
    root, documents = _fresh(spark, "chunks"), written(_chunk_documents(spark, sf), "chunk-documents")
    IO.publish(documents.select("key", "body"), root)
    return IO.published(spark, root).join(documents.filter(kind).select("key"), "key", "left_semi").select("key", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))


@register("s9_chunk_documents", twin(f"""SELECT 'chunks/T' || bucket || '/' || run_start || '/world/' || category || '.json' AS key, sha256(text) AS sha256
FROM runs JOIN (SELECT bucket, win, category, {_BODY} AS text FROM ranked GROUP BY bucket, win, category) t USING (bucket, category) WHERE win = run_start""", "entity", more=f"{_CELLS},\n{PZ.BODY},\n{PZ.RUNS}"))
def s9(spark, sf):
    """The documents at run starts, of all categories but ``all``."""
    return _published_chunks(spark, sf, F.col("category") != "all")


@register("s9_all_documents")
def s9_all(spark, sf):
    """The documents of ``all``, whose walk has no portable SQL."""
    return _published_chunks(spark, sf, F.col("category") == "all")


_OLD = "SELECT 'c/' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_name END AS body FROM customer WHERE c_custkey % 5 <> 0"
_NEW = "SELECT 'c/' || c_custkey AS key, c_name AS body FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 <> 0"


def _versions(spark, sf):
    c, k = _read(spark, sf, "customer"), F.col("c_custkey")
    key = F.concat(F.lit("c/"), k.cast("string")).alias("key")
    return c.filter(k % 5 != 0).select(key, F.when(k % 3 == 0, "old").otherwise(F.col("c_name")).alias("body")), c.filter((k % 5 == 0) | (k % 7 != 0)).select(key, F.col("c_name").alias("body"))


@register("s10_publish_plan", f"""WITH o AS ({_OLD}), n AS ({_NEW}),
p AS (SELECT 1 AS run, key, 'written' AS status FROM o UNION ALL SELECT 2, coalesce(o.key, n.key), CASE WHEN n.key IS NULL THEN 'removed' WHEN o.body = n.body THEN 'unchanged' ELSE 'written' END FROM o FULL OUTER JOIN n ON o.key = n.key
 UNION ALL SELECT 3, key, 'unchanged' FROM n) SELECT run, key, status FROM p""")
def s10(spark, sf):
    """Three publications: the first, a changed one, and the same again."""
    old, new = _versions(spark, sf)
    root, out = _fresh(spark, "published"), None
    for run, documents in enumerate((old, new, new), 1):
        plan = IO.publish(documents, root).select(F.lit(run).alias("run"), "key", "status")
        out = plan if out is None else out.unionByName(plan)
    return out


@register("s10_published_bodies", f"WITH n AS ({_NEW}) SELECT key, body FROM n")
def s10_bodies(spark, sf):
    """What readers see after an update: bodies of two versions, nothing that was removed."""
    root = _fresh(spark, "published")
    for documents in _versions(spark, sf):
        IO.publish(documents, root)
    return IO.published(spark, root)


@register("s11_latest_release", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT step, n_documents, as_first FROM (SELECT 1 AS step, count(*) AS n_documents, true AS as_first FROM o UNION ALL SELECT 2, count(*), false FROM n UNION ALL SELECT 3, count(*), true FROM o UNION ALL SELECT 4, count(*), false FROM n) x")
def s11(spark, sf):
    """Releases are named by content: publishing the first documents again gives the first name; then one is rolled back to."""
    old, new = _versions(spark, sf)
    root, names, out = _fresh(spark, "released"), [], None
    for step in (1, 2, 3, 4):
        if step < 4:
            IO.publish(new if step == 2 else old, root)
        else:
            IO.roll_back(spark, root, names[1])
        names.append(IO.pointer(spark, root).release)
        seen = IO.published(spark, root).agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_documents"), F.lit(names[-1] == names[0]).alias("as_first"))
        out = seen if out is None else out.unionByName(seen)
    return out


@register("s11_newest_version", "SELECT dataset, version FROM (SELECT o_custkey AS dataset, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x WHERE n = 1")
def s11_newest(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("generated_at"))
    return IO.latest_release(o).select("dataset", "version")


_FILE = "SELECT CAST(input_order // 2000 AS BIGINT) AS file, count(*) AS n, string_agg(seed_id || ',' || name, chr(10) ORDER BY input_order) || chr(10) AS content FROM entity GROUP BY input_order // 2000"


def _plain_files(spark, sf):
    path = _fresh(spark, "plain")
    _as_files(bind(spark, sf, "entity").select(F.floor(F.col("input_order") / 2000).alias("file"), F.col("input_order").alias("ord"), F.concat_ws(",", "seed_id", "name").alias("value")), path)
    return path


@register("a17_file_counts", twin(f"SELECT file, n, CAST(strlen(content) AS BIGINT) AS n_bytes, sha256(content) AS sha256 FROM ({_FILE}) f", "entity"))
def a17(spark, sf):
    """The manifest of written files: lines, bytes and digest of each."""
    path = _plain_files(spark, sf)
    lines = R.numbered_lines(spark, path, _file_key()).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return R.file_digests(spark, path, _file_key()).join(lines, "file")


@register("a17_derived_version", twin(f"SELECT 'seed-' || substr(sha256(string_agg(sha256(content), '' ORDER BY file)), 1, 8) AS version FROM ({_FILE}) f", "entity"))
def a17_version(spark, sf):
    """The set's version, which any change of any file changes."""
    return R.derived_version(R.file_digests(spark, _plain_files(spark, sf), _file_key()))


@register("s1_manifest_faults", twin(f"SELECT coalesce(file, -1) AS file, CASE WHEN file IS NULL THEN 'missing' WHEN file % 3 = 1 THEN 'sha256' ELSE 'count' END AS fault FROM (SELECT file FROM ({_FILE}) f WHERE file % 3 <> 0 UNION ALL SELECT NULL) x", "entity"))
def s1_manifest(spark, sf):
    """A manifest with a wrong digest, a wrong count or a file too many, against the files."""
    path = _fresh(spark, "curated")
    e, o = bind(spark, sf, "entity"), F.col("input_order")
    _as_files(e.select(F.floor(o / 2000).alias("file"), o.alias("ord"), F.to_json(F.struct(F.col("seed_id").alias("id"), "name")).alias("value")), path)
    counts = e.groupBy(F.floor(o / 2000).alias("file")).agg(F.count(F.lit(1)).alias("count"))
    declared = R.file_digests(spark, path, _file_key()).join(counts, "file")
    declared = declared.select("file", F.when(F.col("file") % 3 == 1, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), (F.col("count") + F.when(F.col("file") % 3 == 2, 1).otherwise(0)).alias("count"))
    extra = spark.createDataFrame([(-1, "0", 1)], "file long, sha256 string, count long")
    return R.manifest_faults(spark, path, declared.unionByName(extra), _file_key())


@register("a18_table_digest")
def a18(spark, sf):
    parts = {n: IO.table_digest(_read(spark, sf, n)).withColumn("name", F.lit(n)) for n in ("orders", "customer", "nation")}
    return parts["orders"].unionByName(parts["customer"]).unionByName(parts["nation"])


_WIDTH = 500


@register("a18_changed_ranges", f"""SELECT CAST(k AS BIGINT) * {_WIDTH} AS lo, CAST(k AS BIGINT) * {_WIDTH} + {_WIDTH} AS hi, CASE WHEN k % 10 = 7 THEN 'removed' WHEN k % 10 = 8 THEN 'added' ELSE 'changed' END AS change FROM (
SELECT o_orderkey // {_WIDTH} AS k, bool_or(o_orderkey % 1009 = 3) AS touched FROM orders GROUP BY o_orderkey // {_WIDTH}) x WHERE touched OR k % 10 IN (7, 8)""")
def a18_ranges(spark, sf):
    """Two versions of the orders: some prices differ, some ranges of keys only one of them has."""
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey")
    part = F.floor(k / _WIDTH) % 10
    price = F.when(k % 1009 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    old, new = _fresh(spark, "tree"), _fresh(spark, "tree")
    DT.write(o.filter(part != 8), k, _WIDTH, old)
    DT.write(o.filter(part != 7).withColumn("o_totalprice", price), k, _WIDTH, new)
    return DT.changed_ranges(spark, old, new, _WIDTH)


@register("j16_golden_views", twin("""SELECT 'v' || bucket || '/' || win || category AS name, 'has ' || slug AS fault FROM ranked WHERE category IN ('war', 'life') AND rank = 3
UNION ALL SELECT DISTINCT 'v' || bucket || '/' || win || category, 'lacks none-such' FROM ranked WHERE category = 'war' AND win % 5 = 0 UNION ALL SELECT DISTINCT 'x' || bucket || '/' || win || category, 'no chunk' FROM ranked WHERE category = 'life' AND win % 7 = 0""", "entity", more=_CELLS))
def j16(spark, sf):
    """Views that want the first item and bar the third, some that want what isn't there, and some of chunks that don't exist."""
    chunks = written(PZ._topical(spark, sf), "chunks")
    chosen = chunks.filter(F.col("category").isin("war", "life"))
    views = chosen.groupBy(*Z.CELL).agg(F.max(F.when(F.col("rank") == 1, F.col("slug"))).alias("a"), F.max(F.when(F.col("rank") == 3, F.col("slug"))).alias("b"))
    place = F.concat(F.col("bucket").cast("string"), F.lit("/"), F.col("win").cast("string"), F.col("category"))
    odd = (F.col("category") == "war") & (F.pmod("win", F.lit(5)) == 0)
    wanted = F.when(odd, F.array("a", F.lit("none-such"))).otherwise(F.array("a"))
    bounds = [F.lit(1).alias("min_items"), F.lit(200).alias("max_items")]
    there = views.select(F.concat(F.lit("v"), place).alias("name"), *Z.CELL, wanted.alias("include"), F.array_compact(F.array("b")).alias("exclude"), *bounds)
    none = F.array().cast("array<string>")
    gone = views.filter((F.col("category") == "life") & (F.pmod("win", F.lit(7)) == 0)).select(F.concat(F.lit("x"), place).alias("name"), "bucket", "win", F.lit("nowhere").alias("category"), none.alias("include"), none.alias("exclude"), *bounds)
    return IO.golden_faults(there.unionByName(gone), chunks.select(*Z.CELL, "slug"))


@register("q1_golden_counts", twin("SELECT 'v' || bucket || '/' || win || category AS name, 'too few' AS fault FROM (SELECT bucket, win, category, count(*) AS n FROM ranked GROUP BY bucket, win, category) x WHERE n < 3", "entity", more=_CELLS))
def q1(spark, sf):
    chunks = written(PZ._topical(spark, sf), "chunks")
    name = F.concat(F.lit("v"), F.col("bucket").cast("string"), F.lit("/"), F.col("win").cast("string"), F.col("category"))
    none = F.array().cast("array<string>")
    views = chunks.select(*Z.CELL).distinct().select(name.alias("name"), *Z.CELL, none.alias("include"), none.alias("exclude"), F.lit(3).alias("min_items"), F.lit(200).alias("max_items"))
    return IO.golden_faults(views, chunks.select(*Z.CELL, "slug"))


@register("q1_golden_years", twin("""SELECT 'y' || win || category AS name, 'has ' || slug AS fault FROM ranked WHERE bucket = 10 AND rank = 3
UNION ALL SELECT DISTINCT 'u' || win || category, 'unknown bucket T14' FROM ranked WHERE bucket = 10 AND category = 'war' UNION ALL SELECT DISTINCT 'z' || win || category, 'no chunk' FROM ranked WHERE bucket = 10 AND category = 'life' AND win <> 0""", "entity", more=_CELLS))
def q1_years(spark, sf):
    """Views by year instead of window: they want the first item and bar the third; some name no bucket that there is, some no year."""
    chunks = written(PZ._topical(spark, sf), "chunks")
    cells = chunks.filter("bucket = 10").groupBy(*Z.CELL).agg(F.max(F.when(F.col("rank") == 1, F.col("slug"))).alias("a"), F.max(F.when(F.col("rank") == 3, F.col("slug"))).alias("b"))
    tail = F.concat(F.col("win").cast("string"), F.col("category"))
    none = F.array().cast("array<string>")

    def views(df, mark, bucket, year, include, exclude):
        return df.select(F.concat(F.lit(mark), tail).alias("name"), F.lit(bucket).alias("bucket_id"), year.alias("year"), "category", include.alias("include"), exclude.alias("exclude"), F.lit(1).alias("min_items"), F.lit(200).alias("max_items"))

    year = F.col("win") + F.lit(1970.5)
    every = views(cells, "y", "T10", year, F.array("a"), F.array_compact(F.array("b")))
    every = every.unionByName(views(cells.filter("category = 'war'"), "u", "T14", year, none, none)).unionByName(views(cells.filter("category = 'life' AND win <> 0"), "z", "T10", F.lit(None).cast("double"), none, none))
    return IO.release_gate(every, "seed-1", "seed-1", chunks.select(*Z.CELL, "slug"))


@register("q5_release_completeness", "SELECT 'c/' || c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN 'missing' ELSE 'not advertised' END AS fault FROM customer WHERE (c_custkey % 9 = 0) <> (c_custkey % 8 = 0)")
def q5(spark, sf):
    c, k = _read(spark, sf, "customer"), F.col("c_custkey")
    key = F.concat(F.lit("c/"), k.cast("string")).alias("key")
    return IO.release_faults(c.filter(k % 8 != 0).select(key), c.filter(k % 9 != 0).select(key))


_EVENTS = "event_id long, user_id long, event_type string"


def _arrivals(spark, sf, twice: bool):
    """The events as arriving files; with ``twice`` a part of them arrives again."""
    path = _fresh(spark, "arrivals")
    e = _read(spark, sf, "events").select("event_id", "user_id", "event_type")
    e.repartition(4).write.parquet(path)
    if twice:
        e.filter(F.col("event_id") % 10 == 0).repartition(1).write.mode("append").parquet(path)
    return path


@register("st1_arriving_rows", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def st1_rows(spark, sf):
    target = _fresh(spark, "ingested")
    ST.ingest(spark, _arrivals(spark, sf, False), _EVENTS, target, _fresh(spark, "stream"), "event_id").awaitTermination()
    return spark.read.parquet(f"{target}/rows").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@register("st2_repeated_ids", "SELECT event_id, 1 AS n FROM events WHERE event_id % 10 = 0")
def st2(spark, sf):
    target = _fresh(spark, "ingested")
    ST.ingest(spark, _arrivals(spark, sf, True), _EVENTS, target, _fresh(spark, "stream"), "event_id").awaitTermination()
    return spark.read.parquet(f"{target}/repeats").groupBy("event_id").agg(F.sum("n").alias("n"))


def _streamed(spark, sf, repeated):
    """Record parts drained twice: the even files first, then the odd ones, with some records of the even ones again."""
    source, target, state = (_fresh(spark, x) for x in ("parts", "model", "stream"))
    lines = written(_record_lines(spark, sf), "record-lines")
    name = F.regexp_extract("_path", r"file=(\d+)", 1).cast("bigint")
    later = lines.filter("file % 2 = 1")
    if repeated:
        o = F.col("ord")
        again = lines.filter((F.col("file") % 2 == 0) & (o % 31 != 0) & (o % 37 != 0) & (o % 41 != 0) & (o % 50 == 1))
        later = later.unionByName(again.withColumn("file", F.lit(1000001).cast("bigint")))
    for k, part in enumerate((lines.filter("file % 2 = 0"), later)):
        _as_files(part, f"{source}/drain-{k}")
        ST.ingest_records(spark, source, target, state, fatal=False, name=name).awaitTermination()
    return target


@register("st1_incremental_ingest", twin(f"SELECT file, line, CASE WHEN kind = 'record' THEN 'accepted' ELSE kind END AS outcome FROM ({_LINES.format(_KIND.format(repr('skipped'), ''))}) x WHERE kind <> 'skipped'", "entity"))
def st1(spark, sf):
    """Newline-delimited parts through numbering, parsing and validation into the model, in two drains."""
    target = _streamed(spark, sf, repeated=False)
    accepted = ST.streamed_model(spark, target)["entity"].select("file", "line", F.lit("accepted").alias("outcome"))
    return accepted.unionByName(spark.read.parquet(f"{target}/rejects").select("file", "line", F.col("reason").alias("outcome")))


@register("st1_streamed_model", twin("SELECT count(*) AS n, CAST(sum(input_order) AS BIGINT) AS orders, count(DISTINCT seed_id) AS ids, count(DISTINCT category) AS categories, min(y) AS least, max(y) AS most FROM (SELECT row_number() OVER (ORDER BY input_order // 2000, input_order) - 1 AS input_order, seed_id, cat0 AS category, 1900 + input_order % 200 AS y FROM entity WHERE input_order % 31 <> 0 AND input_order % 37 <> 0 AND input_order % 41 <> 0) x", "entity"))
def st1_model(spark, sf):
    """The streamed model as one: its order has no gaps, its tables belong together."""
    m = ST.streamed_model(spark, _streamed(spark, sf, repeated=False))
    year = F.round(T.seconds_to_year(F.col("t0"))).cast("long")
    rows = m["entity"].join(m["entity_category"], "seed_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("input_order").alias("orders"), F.countDistinct("seed_id").alias("ids"), F.countDistinct("category").alias("categories"), F.min(year).alias("least"), F.max(year).alias("most"))


@register("st2_repeated_records", twin("SELECT row_number() OVER (ORDER BY input_order) AS line, 'repeated id' AS reason FROM entity WHERE (input_order // 2000) % 2 = 0 AND input_order % 31 <> 0 AND input_order % 37 <> 0 AND input_order % 41 <> 0 AND input_order % 50 = 1", "entity"))
def st2_records(spark, sf):
    """Records whose ids an earlier drain had: rejects, where they are not fatal."""
    return spark.read.parquet(f"{_streamed(spark, sf, repeated=True)}/rejects").filter("file = 1000001").select("line", "reason")


@register("st3_census", PH.A1_SQL)
def st3_census(spark, sf):
    """The census kept up batch by batch: what the one-pass census gives."""
    source, target = _fresh(spark, "arrivals"), _fresh(spark, "census")
    e = bind(spark, sf, "entity").select("type", "t0", "precision", "lon", "wikipedia")
    e.repartition(24).write.parquet(source)
    schema = "type string, t0 double, precision string, lon double, wikipedia string"
    keys = ["type", "slice", "span"]
    ST.keep_sums(spark, source, schema, target, _fresh(spark, "stream"), D.census, keys).awaitTermination()
    return ST.sums(spark, target, keys)


@register("st3_running_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st3(spark, sf):
    target = _fresh(spark, "counters")
    ST.count_by(spark, _arrivals(spark, sf, False), _EVENTS, target, _fresh(spark, "stream"), ["event_type"]).awaitTermination()
    return ST.counters(spark, target, ["event_type"])

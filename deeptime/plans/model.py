"""Queries on the normalized model: ingest, integrity, documents, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from deeptime.catalog import register
from deeptime.fixtures import bind, twin
from deeptime.functions import text as X
from deeptime.functions import vocab as V
from deeptime.operators import model as M
from deeptime.plans import layers as PL
from deeptime.sources import model_io as IO
from deeptime.sources import search_index as SI
from deeptime.sources.scratch import fresh


def _inlist(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# Every tenth record or so is spoiled in one way or another, alike in both engines.
SPOILED = """spoiled AS (SELECT input_order, CASE WHEN input_order % 101 = 0 THEN '' ELSE seed_id END AS seed_id, CASE WHEN input_order % 103 = 0 THEN '' ELSE name END AS name,
 CASE WHEN input_order % 53 = 0 THEN 'gizmo' ELSE type END AS type, CASE WHEN input_order % 59 = 0 THEN 'sure' ELSE status END AS status, CASE WHEN input_order % 61 = 0 THEN 1.5e0 ELSE importance END AS importance,
 CASE WHEN input_order % 67 = 0 THEN 'eon' ELSE precision END AS precision, CASE WHEN input_order % 71 = 0 THEN 'sport' ELSE cat0 END AS cat0, cat1,
 CASE WHEN input_order % 73 = 0 THEN 200e0 ELSE lon END AS lon, lat, CASE WHEN input_order % 79 = 0 THEN 2e18 ELSE t0 END AS t0, CASE WHEN input_order % 79 = 0 THEN 3e18 WHEN input_order % 83 = 0 THEN t0 - 1e0 ELSE t1 END AS t1, wikidata
 FROM entity)"""


def _spoiled(spark, sf):
    body = SPOILED[len("spoiled AS (") : -1]
    return spark.sql(body.replace("FROM entity", "FROM {entity}"), entity=bind(spark, sf, "entity"))


REASON = f"""reasoned AS (SELECT *, CASE WHEN seed_id = '' THEN 'missing id' WHEN name = '' THEN 'missing name'
 WHEN type NOT IN {_inlist(V.ENTITY_TYPES)} THEN 'unknown entity type "' || type || '"' WHEN status NOT IN {_inlist(V.STATUSES)} THEN 'unknown temporal status "' || status || '"'
 WHEN NOT (importance > 0 AND importance <= 1) THEN 'importance outside (0,1]' WHEN precision NOT IN {_inlist(V.FINEST)} THEN 'unknown time precision "' || precision || '"'
 WHEN cat0 NOT IN {_inlist(V.CATEGORIES)} THEN 'unknown category "' || cat0 || '"' WHEN (lon IS NOT NULL OR lat IS NOT NULL) AND NOT coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) THEN 'point not a valid [lon,lat]'
 WHEN t1 < t0 THEN 'invalid time range' WHEN {V.FINEST_SQL} > 2 AND (abs(t0) > 1e18 OR abs(t1) > 1e18) THEN 'far time requires billion_year precision' END AS reason FROM spoiled)"""


def _cats():
    return F.filter(F.array("cat0", "cat1"), lambda c: c.isNotNull())


def _reasoned(spark, sf):
    return _spoiled(spark, sf).withColumn("reason", M.reject_reason(_cats()))


@register("p1_validate", twin("SELECT input_order, reason FROM reasoned", "entity", more=f"{SPOILED},\n{REASON}"))
def p1(spark, sf):
    return _reasoned(spark, sf).select("input_order", "reason")


@register("p3_vocabulary", twin(f"SELECT count(*) AS n, count(*) FILTER (WHERE type IN {_inlist(V.ENTITY_TYPES)}) AS types, count(*) FILTER (WHERE status IN {_inlist(V.STATUSES)}) AS statuses, count(*) FILTER (WHERE cat0 IN {_inlist(V.CATEGORIES)}) AS categories FROM spoiled", "entity", more=SPOILED))
def p3(spark, sf):
    return _spoiled(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type").isin(V.ENTITY_TYPES)).alias("types"), F.count_if(F.col("status").isin(V.STATUSES)).alias("statuses"), F.count_if(F.col("cat0").isin(V.CATEGORIES)).alias("categories"))


@register("s6_rejects", twin("SELECT 'orders' AS source, input_order AS line, reason FROM reasoned WHERE reason IS NOT NULL", "entity", more=f"{SPOILED},\n{REASON}"))
def s6(spark, sf):
    """The rejects as they are written and read back."""
    path = fresh(spark, "rejects")
    IO.write_rejects(_reasoned(spark, sf).filter("reason IS NOT NULL").select(F.lit("orders").alias("source"), F.col("input_order").alias("line"), "reason"), path)
    return spark.read.parquet(path)


@register("a8_import_report", twin("""SELECT CASE WHEN input_order % 2 = 0 THEN 'curated' ELSE 'bulk' END AS source, coalesce(reason, 'accepted') AS reason, count(*) AS n
FROM reasoned GROUP BY CASE WHEN input_order % 2 = 0 THEN 'curated' ELSE 'bulk' END, coalesce(reason, 'accepted')""", "entity", more=f"{SPOILED},\n{REASON}"))
def a8(spark, sf):
    rows = _reasoned(spark, sf).withColumn("source", F.when(F.col("input_order") % 2 == 0, "curated").otherwise("bulk"))
    return rows.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Curated and bulk halves; a bulk row's external id repeats a curated one now and then.
HALVES = """curated AS (SELECT * FROM entity WHERE input_order % 2 = 0), bulk AS (SELECT input_order, seed_id, name, type, t0, importance,
 CASE WHEN input_order % 5 = 0 THEN concat('Q', cast(input_order - input_order % 6 + 1 AS VARCHAR)) WHEN input_order % 5 = 1 THEN concat('B', cast(input_order - input_order % 4 AS VARCHAR)) ELSE '' END AS wikidata,
 concat('Q', cast((input_order * 7) % 15000 + 1 AS VARCHAR)) AS parent FROM entity WHERE input_order % 2 = 1)"""


def _halves(spark, sf):
    e = bind(spark, sf, "entity")
    o = F.col("input_order")
    ext = F.when(o % 5 == 0, F.concat(F.lit("Q"), (o - o % 6 + 1).cast("string"))).when(o % 5 == 1, F.concat(F.lit("B"), (o - o % 4).cast("string"))).otherwise("")
    bulk = e.filter(o % 2 == 1).select("input_order", "seed_id", "name", "type", "t0", "importance", ext.alias("wikidata"), F.concat(F.lit("Q"), ((o * 7) % 15000 + 1).cast("string")).alias("parent"))
    return e.filter(o % 2 == 0), bulk


_NEW = "bulk b WHERE NOT (wikidata <> '' AND wikidata IN (SELECT wikidata FROM curated))"


@register("j1_known_external_ids", twin("SELECT input_order, wikidata <> '' AND wikidata IN (SELECT wikidata FROM curated) AS known FROM bulk", "entity", more=HALVES))
def j1(spark, sf):
    curated, bulk = _halves(spark, sf)
    fresh, known = M.new_by_external_id(bulk, curated)
    return fresh.select("input_order", F.lit(False).alias("known")).unionByName(known.select("input_order", F.lit(True).alias("known")))


@register("w7_first_valid", twin(f"SELECT input_order FROM (SELECT *, row_number() OVER (PARTITION BY wikidata ORDER BY input_order) AS n FROM {_NEW} AND input_order % 17 <> 0) x WHERE wikidata = '' OR n = 1", "entity", more=HALVES))
def w7(spark, sf):
    curated, bulk = _halves(spark, sf)
    fresh, _ = M.new_by_external_id(bulk, curated)
    return M.first_valid(fresh, "wikidata", "input_order", F.col("input_order") % 17 != 0).select("input_order")


@register("j2_parent_edges", twin("SELECT b.seed_id, e.seed_id AS target FROM bulk b JOIN entity e ON b.parent = e.wikidata WHERE b.seed_id <> e.seed_id", "entity", more=HALVES))
def j2(spark, sf):
    _, bulk = _halves(spark, sf)
    every = bind(spark, sf, "entity").filter(F.col("wikidata") != "").select(F.col("wikidata").alias("parent"), F.col("seed_id").alias("target"))
    return bulk.join(every, "parent", "left").filter(F.col("target") != F.col("seed_id")).select("seed_id", "target")


@register("u1_merge_sets", twin(f"SELECT 'curated' AS source, count(*) AS n, min(input_order) AS least FROM curated UNION ALL SELECT 'bulk', count(*), min(input_order) FROM {_NEW}", "entity", more=HALVES))
def u1(spark, sf):
    curated, bulk = _halves(spark, sf)
    fresh, _ = M.new_by_external_id(bulk, curated)
    both = curated.select(F.lit("curated").alias("source"), "input_order").unionByName(fresh.select(F.lit("bulk").alias("source"), "input_order"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("input_order").alias("least"))


@register("p12_promote", twin("""SELECT 'entity' AS what, count(*) AS n FROM entity WHERE importance >= 0.5e0 UNION ALL
SELECT 'relation', count(*) FROM relationship r JOIN entity a ON a.seed_id = r.seed_id JOIN entity b ON b.seed_id = r.target WHERE a.importance >= 0.5e0 AND b.importance >= 0.5e0 UNION ALL
SELECT 'dropped', count(*) FROM relationship r JOIN entity a ON a.seed_id = r.seed_id JOIN entity b ON b.seed_id = r.target WHERE a.importance >= 0.5e0 AND b.importance < 0.5e0""", "entity", "relationship"))
def p12(spark, sf):
    e, r = bind(spark, sf, "entity"), bind(spark, sf, "relationship")
    kept, edges = M.promote(e, r, 0.5)
    own = r.join(kept.select("seed_id"), "seed_id", "left_semi")
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    dropped = own.join(kept.select(F.col("seed_id").alias("target")), "target", "left_anti")
    return count(kept, "entity").unionByName(count(edges, "relation")).unionByName(count(dropped, "dropped"))


@register("j3_missing_targets", twin("SELECT r.seed_id, ord, target FROM relationship r WHERE target NOT IN (SELECT seed_id FROM entity WHERE input_order % 9 <> 0)", "entity", "relationship"))
def j3(spark, sf):
    return M.missing_targets(bind(spark, sf, "relationship"), bind(spark, sf, "entity").filter(F.col("input_order") % 9 != 0)).select("seed_id", "ord", "target")


_BASE = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"
SLUGS = f"""based AS (SELECT seed_id, {_BASE} AS base, importance, type, wikidata, CAST(trunc(t0 / 31556952e0 + 1970e0) AS BIGINT) AS y FROM entity),
s1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY importance DESC, seed_id) = 1 THEN base END AS g1 FROM based),
s2 AS (SELECT *, CASE WHEN g1 IS NULL AND row_number() OVER (PARTITION BY g1 IS NULL, base, y ORDER BY importance DESC, seed_id) = 1 THEN base || '-' || y END AS g2 FROM s1),
s3 AS (SELECT *, CASE WHEN g1 IS NULL AND g2 IS NULL AND row_number() OVER (PARTITION BY g1 IS NULL AND g2 IS NULL, base, type ORDER BY importance DESC, seed_id) = 1 THEN base || '-' || type END AS g3 FROM s2),
s4 AS (SELECT *, CASE WHEN g1 IS NULL AND g2 IS NULL AND g3 IS NULL AND wikidata <> '' AND row_number() OVER (PARTITION BY g1 IS NULL AND g2 IS NULL AND g3 IS NULL AND wikidata <> '', base, wikidata ORDER BY importance DESC, seed_id) = 1 THEN base || '-' || lower(wikidata) END AS g4 FROM s3),
slugged AS (SELECT seed_id, importance, coalesce(g1, g2, g3, g4) AS slug FROM s4)"""


@register("w1_assign_slugs", twin("SELECT seed_id, slug FROM slugged", "entity", more=SLUGS))
def w1(spark, sf):
    return M.assign_slugs(bind(spark, sf, "entity")).select("seed_id", "slug")


@register("w1_slug_conflicts", twin("SELECT slug, count(*) AS n FROM slugged GROUP BY slug HAVING slug IS NULL OR slug = '' OR count(*) > 1", "entity", more=SLUGS))
def w1_conflicts(spark, sf):
    return M.slug_conflicts(M.assign_slugs(bind(spark, sf, "entity")))


@register("j4_outgoing", twin("SELECT r.seed_id, ord, target, e.name AS target_name, e.type AS target_type, e.t0 AS target_t0 FROM relationship r JOIN entity e ON e.seed_id = target", "entity", "relationship"))
def j4(spark, sf):
    return M.outgoing(bind(spark, sf, "relationship"), bind(spark, sf, "entity")).select("seed_id", "ord", "target", "target_name", "target_type", "target_t0")


@register("j5_inverse_edges", twin("SELECT target AS seed_id, CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.INVERSE.items()) + f" END AS type, seed_id AS target FROM relationship WHERE type IN {_inlist(V.INVERSE)}", "relationship"))
def j5(spark, sf):
    return M.inverse(bind(spark, sf, "relationship"))


@register("j6_children", twin("SELECT target AS parent, r.seed_id AS child, row_number() OVER (PARTITION BY target ORDER BY t0, r.seed_id) AS pos FROM relationship r JOIN entity e ON e.seed_id = r.seed_id WHERE r.type = 'part_of'", "entity", "relationship"))
def j6(spark, sf):
    return M.children(bind(spark, sf, "relationship"), bind(spark, sf, "entity")).select("parent", "child", "pos")


@register("a10_child_counts", twin("SELECT target AS seed_id, count(*) AS child_count FROM relationship WHERE type = 'part_of' GROUP BY target", "relationship"))
def a10(spark, sf):
    return M.child_counts(bind(spark, sf, "relationship"))


@register("a11_claim_synthesis", twin("""SELECT seed_id, property, low, high, claim_count, unit, row_number() OVER (PARTITION BY seed_id ORDER BY first) AS pos FROM (
SELECT seed_id, property, min(CASE WHEN min IS NOT NULL AND max IS NOT NULL THEN min ELSE value END) AS low, max(CASE WHEN min IS NOT NULL AND max IS NOT NULL THEN max ELSE value END) AS high,
 count(*) AS claim_count, arg_min(unit, ord) AS unit, min(ord) AS first FROM claim GROUP BY seed_id, property) g""", "claim"))
def a11(spark, sf):
    return M.synthesize(bind(spark, sf, "claim")).select("seed_id", "property", "low", "high", "claim_count", "unit", "pos")


@register("a12_categories", twin("SELECT category, count(*) AS n FROM (SELECT cat0 AS category FROM entity UNION ALL SELECT cat1 FROM entity WHERE cat1 IS NOT NULL) c GROUP BY category", "entity"))
def a12(spark, sf):
    return bind(spark, sf, "entity").select(F.explode(_cats()).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("w9_order_gaps", twin("SELECT seed_id, ord, expected FROM (SELECT seed_id, ord, row_number() OVER (PARTITION BY seed_id ORDER BY ord) - 1 AS expected FROM claim WHERE ord <> 2) x WHERE ord <> expected", "claim"))
def w9(spark, sf):
    return M.order_gaps(bind(spark, sf, "claim").filter("ord <> 2"), ["seed_id"], "ord").select("seed_id", "ord", "expected")


CONTEMPORARIES = """SELECT sid, oid, row_number() OVER (PARTITION BY sid ORDER BY o0, oid) AS pos FROM (
SELECT sid, oid, o0, row_number() OVER (PARTITION BY sid ORDER BY importance DESC, oid) AS rank FROM (
SELECT DISTINCT e.seed_id AS sid, o.seed_id AS oid, o.t0 AS o0, o.importance FROM days e JOIN days o ON e.day = o.day
WHERE e.seed_id <> o.seed_id AND o.t1 >= e.t0 AND o.t0 <= e.t1 AND o.t1 - o.t0 <= 50 * greatest(e.t1 - e.t0, 86400e0)) p) r WHERE rank <= 50"""
DAYS = "days AS (SELECT *, unnest(range(CAST(floor(t0 / 1e7) AS BIGINT), CAST(floor(t1 / 1e7) AS BIGINT) + 1)) AS day FROM entity)"


@register("j7_contemporaries", twin(CONTEMPORARIES, "entity", more=DAYS))
def j7(spark, sf):
    return M.contemporaries(bind(spark, sf, "entity"))


@register("e4_document_counts", twin(f"""SELECT e.seed_id, coalesce(o.n, 0) AS n_rel, coalesce(i.n, 0) AS n_inverse, coalesce(c.n, 0) AS n_children, coalesce(p.n, 0) AS n_properties FROM entity e
LEFT JOIN (SELECT seed_id, count(*) AS n FROM relationship GROUP BY seed_id) o ON o.seed_id = e.seed_id
LEFT JOIN (SELECT target, count(*) AS n FROM relationship WHERE type IN {_inlist(V.INVERSE)} GROUP BY target) i ON i.target = e.seed_id
LEFT JOIN (SELECT target, count(*) AS n FROM relationship WHERE type = 'part_of' GROUP BY target) c ON c.target = e.seed_id
LEFT JOIN (SELECT seed_id, count(DISTINCT property) AS n FROM claim GROUP BY seed_id) p ON p.seed_id = e.seed_id""", "entity", "relationship", "claim"))
def e4(spark, sf):
    docs = documents(spark, sf, whole=False)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return docs.select("seed_id", size("rel").alias("n_rel"), size("inverse").alias("n_inverse"), size("children").alias("n_children"), size("properties").alias("n_properties"))


def documents(spark, sf, whole=True):
    """One document per entity: relations, inverse edges, children, properties and dated positions.

    Every part is grouped by ``seed_id``, so the joins share one partitioning.
    """
    e, r, c = (bind(spark, sf, t) for t in ("entity", "relationship", "claim"))
    bag = lambda df, name, *cols: df.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    parts = [
        bag(M.outgoing(r, e), "rel", "ord", "type", "target", "target_name"),
        bag(M.inverse(r), "inverse", "type", "target"),
        bag(M.children(r, e).withColumnRenamed("parent", "seed_id"), "children", "pos", "child"),
        bag(M.synthesize(c), "properties", "pos", "property", "low", "high", "claim_count", "unit"),
    ]
    if whole:
        front = PL.positions(spark, sf).select(F.concat(F.lit("ord-"), F.col("entity").cast("string")).alias("seed_id"), "valid_from", "coords")
        parts.append(bag(front, "geometry", "valid_from", "coords"))
    for part in parts:
        e = e.join(part, "seed_id", "left")
    return e


@register("e4_documents")
def e4_documents(spark, sf):
    """The documents as JSON, self-contained with their contemporaries.

    Documents travel to their contemporaries as text, in two pieces between which these belong: it is shorter than rows
    of nested lists, and than the lists of contemporaries.
    """
    d = documents(spark, sf)
    text = d.select("seed_id", "t0", "t1", F.to_json(F.struct(*(c for c in d.columns if c != "geometry"))).alias("head"), F.to_json(F.struct("geometry")).alias("tail"))
    met = M.met_by(bind(spark, sf, "entity"), label="name", onto=text)
    within = F.coalesce(F.concat(F.lit(',"contemporaries":'), F.to_json("met")), F.lit(""))
    after = F.when(F.col("tail") == "{}", "}").otherwise(F.concat(F.lit(","), F.substr("tail", F.lit(2))))
    body = F.concat(F.substr("head", F.lit(1), F.length("head") - 1), within, after)
    return met.select(F.concat(F.lit("entities/"), "seed_id", F.lit(".json")).alias("key"), body.alias("body"))


_PARTS = f"""SELECT e.seed_id, 'rel' AS part, r.ord AS pos, r.type || '>' || r.target AS ref FROM relationship r JOIN entity e ON e.seed_id = r.seed_id
UNION ALL SELECT target, 'inverse', row_number() OVER (PARTITION BY target ORDER BY label, seed_id) - 1, label || '>' || seed_id FROM (SELECT target, seed_id, CASE type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.INVERSE.items())} END AS label FROM relationship WHERE type IN {_inlist(V.INVERSE)}) i
UNION ALL SELECT target, 'children', row_number() OVER (PARTITION BY target ORDER BY t0, r.seed_id) - 1, r.seed_id FROM relationship r JOIN entity e ON e.seed_id = r.seed_id WHERE r.type = 'part_of'
UNION ALL SELECT seed_id, 'properties', row_number() OVER (PARTITION BY seed_id ORDER BY first) - 1, property FROM (SELECT seed_id, property, min(ord) AS first FROM claim GROUP BY seed_id, property) p
UNION ALL SELECT sid, 'contemporaries', pos - 1, oid FROM ({CONTEMPORARIES}) c
UNION ALL SELECT 'ord-' || entity, 'geometry', k - 1, CAST(CAST(valid_from AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(x AS BIGINT) AS VARCHAR) FROM seg JOIN entity ON seed_id = 'ord-' || entity"""


@register("e4_document_parts", twin(_PARTS, "entity", "relationship", "claim", more=f"{DAYS},\n{PL._POS}"))
def e4_parts(spark, sf):
    """The documents as JSON, read back and taken apart."""
    read = F.from_json("body", "seed_id string, rel array<struct<type:string,target:string>>, inverse array<struct<type:string,target:string>>, children array<struct<child:string>>, properties array<struct<property:string>>, contemporaries array<struct<oid:string>>, geometry array<struct<valid_from:double,coords:array<struct<lon:double>>>>")
    d = e4_documents(spark, sf).select(read.alias("d")).select("d.*")
    link = lambda x: F.concat_ws(">", x["type"], x["target"])
    at = lambda x: F.concat_ws(":", x["valid_from"].cast("bigint").cast("string"), x["coords"][0]["lon"].cast("bigint").cast("string"))
    refs = {"rel": link, "inverse": link, "children": lambda x: x["child"], "properties": lambda x: x["property"], "contemporaries": lambda x: x["oid"], "geometry": at}

    def named(part, ref):
        return F.transform(F.coalesce(part, F.array()), lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("pos"), ref(x).alias("ref")))

    each = F.flatten(F.array(*(named(part, ref) for part, ref in refs.items())))
    return d.select("seed_id", F.explode(each).alias("x")).select("seed_id", "x.part", "x.pos", "x.ref")


_TOK = "tok AS (SELECT slug, importance, unnest(string_split(slug, '-')) AS token FROM slugged WHERE slug IS NOT NULL)"


@register("e5_search_index", twin("SELECT shard, slug, importance, row_number() OVER (PARTITION BY shard ORDER BY importance DESC, slug) AS pos FROM (SELECT DISTINCT substr(token, 1, 1) AS shard, slug, importance FROM tok WHERE length(token) >= 3) x", "entity", more=f"{SLUGS},\n{_TOK}"))
def e5(spark, sf):
    return M.search_index(M.assign_slugs(bind(spark, sf, "entity")).filter("slug IS NOT NULL"))


_ASK = [(1, "order cust"), (2, "Lot 12"), (3, "customer 77 of"), (4, "zzz"), (5, "13")]


@register("t3_prefix_search", twin("""SELECT query_id, pos, slug FROM (SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, slug) AS pos FROM (
SELECT query_id, slug, importance, n FROM (SELECT query_id, w, count(*) OVER (PARTITION BY query_id) AS n FROM ask) a JOIN (SELECT DISTINCT slug, importance, token FROM tok) t ON starts_with(token, w)
GROUP BY query_id, slug, importance, n HAVING count(DISTINCT w) = n) y) z WHERE pos <= 8""", "entity", more=SLUGS + ",\n" + _TOK + ",\nask(query_id, w) AS (VALUES (1, 'order'), (1, 'cust'), (2, 'lot'), (2, '12'), (3, 'customer'), (3, '77'), (3, 'of'), (4, 'zzz'), (5, '13'))"))
def t3(spark, sf):
    """The index is written, then searched."""
    path = fresh(spark, "search-index")
    SI.write(M.assign_slugs(bind(spark, sf, "entity")).filter("slug IS NOT NULL"), path)
    return SI.search(spark, path, spark.createDataFrame(_ASK, "query_id int, query string"))


_PLAIN = reduce(lambda s, k: f"replace({s}, '{k[0]}', '{k[1]}')", X.LIGATURES.items(), "word")


@register("f1_slugify", f"""SELECT word, trim(substr(s, 1, 80), '-') AS slug FROM (SELECT word, trim(regexp_replace(lower(strip_accents({_PLAIN})), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (
SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) w) x""")
def f1(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", X.slugify(F.col("word")).alias("slug"))


@register("f2_search_tokens", twin("SELECT slug, count(*) AS n, min(substr(token, 1, 1)) AS least_shard FROM tok WHERE length(token) >= 3 GROUP BY slug", "entity", more=f"{SLUGS},\n{_TOK}"))
def f2(spark, sf):
    t = M.assign_slugs(bind(spark, sf, "entity")).filter("slug IS NOT NULL").select("slug", X.search_tokens(F.col("slug")).alias("t"))
    return t.filter(F.size("t") > 0).select("slug", F.size("t").cast("bigint").alias("n"), F.array_min(F.transform("t", lambda x: F.substring(x, 1, 1))).alias("least_shard"))


@register("p7_entity_ids", "SELECT o_orderkey, regexp_matches(id, '^Q[1-9][0-9]*$') AS valid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Q0' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 'P' || o_orderkey ELSE 'Q' || o_orderkey END AS id FROM orders) x")
def p7(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", X.entity_id(F.concat(F.when(k % 4 == 0, "Q0").when(k % 4 == 1, "P").otherwise("Q"), k.cast("string"))).alias("valid"))


@register("p8_importance", "SELECT o_orderkey, CAST(floor(least(0.9e0, greatest(0.22e0, 0.22e0 + 0.09e0 * ln(1e0 + o_orderkey % 400))) * 100 + 0.5e0) AS BIGINT) AS hundredths FROM orders")
def p8(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", F.floor(X.importance((F.col("o_orderkey") % 400).cast("double")) * 100 + 0.5).alias("hundredths"))


@register("p10_point_wkt", twin("SELECT input_order, CASE WHEN input_order % 13 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN input_order % 13 = 0 THEN NULL ELSE lat END AS lat FROM entity WHERE lon IS NOT NULL", "entity"))
def p10(spark, sf):
    e = bind(spark, sf, "entity").filter("lon IS NOT NULL")
    shift = F.when(F.col("input_order") % 13 == 0, 400.0).otherwise(0.0)
    wkt = F.concat(F.lit("Point("), (F.col("lon") + shift).cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    lon, lat = X.point_wkt(F.col("wkt"))
    return e.withColumn("wkt", wkt).select("input_order", lon.alias("lon"), lat.alias("lat"))


@register("p11_lon_lat", twin("SELECT input_order, coalesce(lon * 1.5e0 BETWEEN -180 AND 180 AND lat * 1.5e0 BETWEEN -90 AND 90, false) AS valid FROM entity", "entity"))
def p11(spark, sf):
    return bind(spark, sf, "entity").select("input_order", F.coalesce(X.valid_lon_lat(F.col("lon") * 1.5, F.col("lat") * 1.5), F.lit(False)).alias("valid"))


@register("f13_name_hue", "WITH RECURSIVE walk(n_name, i, h) AS (SELECT n_name, 0, CAST(2166136261 AS BIGINT) FROM nation UNION ALL SELECT n_name, i + 1, (xor(h, CAST(ascii(substr(n_name, i + 1, 1)) AS BIGINT)) * 16777619) % 4294967296 FROM walk WHERE i < length(n_name))\nSELECT n_name, CAST(h % 360 AS BIGINT) AS hue FROM walk WHERE i = length(n_name)")
def f13(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_name", X.hue(F.col("n_name")).alias("hue"))

"""Queries on dated statements, censuses and the knowledge-graph dump."""

from __future__ import annotations

from pyspark.sql import functions as F

from deeptime.catalog import register
from deeptime.fixtures import bind, twin
from deeptime.functions import taxonomy
from deeptime.functions import time as T
from deeptime.functions import vocab as V
from deeptime.operators import dating as D
from deeptime.operators import model as M
from deeptime.sources import dump as S
from deeptime.sources.scratch import fresh, spread, written

# The other engine's calendar arithmetic, as text.


def _jdn(y, m, d):
    a = f"((14 - {m}) // 12)"
    base = f"({d} + (153 * ({m} + 12 * {a} - 3) + 2) // 5 + 365 * ({y} + 4800 - {a}) + ({y} + 4800 - {a}) // 4)"
    return f"(CASE WHEN calendar = 'julian' THEN {base} - 32083 ELSE {base} - ({y} + 4800 - {a}) // 100 + ({y} + 4800 - {a}) // 400 - 32045 END)"


def _sec(y, m, d):
    return f"CAST(({_jdn(y, m, d)} - 2440588) * 86400 AS DOUBLE)"


_RANKS = {p: i for i, p in enumerate(V.FINEST)}
_LABELS = "CASE precision " + " ".join(f"WHEN {k} THEN {_RANKS[v]}" for k, v in T.SOURCE_LABEL.items()) + " END"
_SPANS = "CASE " + " ".join(f"WHEN u1 - u0 <= {s if 'e' in repr(s) else f'{s!r}e0'} THEN {i}" for i, s in sorted(enumerate(T.LABEL_SECONDS.values()), key=lambda x: x[1])) + " ELSE 0 END"
CLEAN = "clean AS (SELECT event_id, item, property, y, CASE WHEN precision < 10 THEN 1 ELSE m END AS m, CASE WHEN precision < 11 THEN 1 ELSE d END AS d, precision, calendar, before, after, CASE precision WHEN 6 THEN 1000 WHEN 7 THEN 100 WHEN 8 THEN 10 END AS unit FROM time_fact)"
WINDOWS = f"""raw AS (SELECT *, CASE WHEN unit IS NOT NULL THEN (floor(y / CAST(unit AS DOUBLE)) * unit - 1970) * 31556952e0 WHEN precision = 9 THEN {_sec('y', '1', '1')} WHEN precision = 10 THEN {_sec('y', 'm', '1')} ELSE {_sec('y', 'm', 'd')} END AS r0,
 CASE WHEN unit IS NOT NULL THEN (floor(y / CAST(unit AS DOUBLE)) * unit + unit - 1970) * 31556952e0 WHEN precision = 9 THEN {_sec('(y + 1)', '1', '1')} WHEN precision = 10 AND m = 12 THEN {_sec('(y + 1)', '1', '1')}
  WHEN precision = 10 THEN {_sec('y', '(m + 1)', '1')} WHEN precision = 11 THEN {_sec('y', 'm', 'd')} + 86400 WHEN precision = 12 THEN {_sec('y', 'm', 'd')} + 3600 WHEN precision = 13 THEN {_sec('y', 'm', 'd')} + 60 ELSE {_sec('y', 'm', 'd')} + 1 END AS r1 FROM clean),
wide AS (SELECT *, r0 - before * (r1 - r0) AS u0, r1 + after * (r1 - r0) AS u1 FROM raw),
windows AS (SELECT event_id, item, property, precision, calendar, u0 AS t0, u1 AS t1, CASE WHEN before > 0 OR after > 0 THEN least({_LABELS}, {_SPANS}) ELSE {_LABELS} END AS rank,
 CASE WHEN unit IS NOT NULL THEN floor(y / CAST(unit AS DOUBLE)) * unit ELSE CAST(y AS DOUBLE) END AS year FROM wide)"""


def _order(props):
    return "CASE property " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(props)) + " END"


SPANS = f"""starts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {_order(V.START_PROPERTIES)}, t0, event_id) AS n FROM windows WHERE {_order(V.START_PROPERTIES)} IS NOT NULL) s WHERE n = 1),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {_order(V.END_PROPERTIES)}, t1 DESC, event_id) AS n FROM windows WHERE {_order(V.END_PROPERTIES)} IS NOT NULL) e WHERE n = 1),
spans AS (SELECT s.item, s.t0, CASE WHEN e.t1 >= s.t0 THEN e.t1 ELSE s.t1 END AS t1, CASE WHEN e.t1 >= s.t0 THEN least(s.rank, e.rank) ELSE s.rank END AS rank, s.year, s.calendar FROM starts s LEFT JOIN ends e ON s.item = e.item)"""
_DATED = f"{CLEAN},\n{WINDOWS},\n{SPANS}"


def _windows(spark, sf):
    return D.converted(bind(spark, sf, "time_fact"))


@register("f9_julian_days", twin(f"SELECT event_id, CAST({_jdn('y', 'm', 'd')} AS BIGINT) AS jdn FROM time_fact", "time_fact"))
def f9(spark, sf):
    return bind(spark, sf, "time_fact").select("event_id", T.julian_day(F.col("calendar"), F.col("y"), F.col("m"), F.col("d")).alias("jdn"))


@register("f10_statement_windows", twin("SELECT event_id, t0, t1, rank, year FROM windows", "time_fact", more=_DATED))
def f10(spark, sf):
    return _windows(spark, sf).select("event_id", "t0", "t1", T.precision_rank(F.col("label")).alias("rank"), "year")


@register("f11_item_spans", twin("SELECT item, t0, t1, rank, year, calendar FROM spans", "time_fact", more=_DATED))
def f11(spark, sf):
    return D.item_spans(_windows(spark, sf)).select("item", "t0", "t1", T.precision_rank(F.col("label")).alias("rank"), "year", "calendar")


_SLICE_OF = "CASE WHEN abs({0}) < 1e4 THEN 100 WHEN abs({0}) < 1e6 THEN 10000 WHEN abs({0}) < 1e9 THEN 1000000 ELSE 1000000000 END"


@register("f7_census_slices", twin(f"SELECT event_id, floor(year / s) * s AS start, CAST(s AS DOUBLE) AS span FROM (SELECT event_id, year, {_SLICE_OF.format('year')} AS s FROM (SELECT event_id, year * (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 77 WHEN 2 THEN 5000 ELSE 2000000 END) AS year FROM windows) x) y", "time_fact", more=_DATED))
def f7(spark, sf):
    k = F.col("event_id") % 4
    scaled = _windows(spark, sf).withColumn("year", F.col("year") * F.when(k == 0, 1).when(k == 1, 77).when(k == 2, 5000).otherwise(2000000))
    start, span = T.census_slice(F.col("year"))
    return scaled.select("event_id", start.alias("start"), span.alias("span"))


_CY = "CASE WHEN precision IN ('day', 'hour', 'minute', 'second') THEN CAST(year(make_timestamp(CAST(t0 * 1000000 AS BIGINT))) AS DOUBLE) ELSE floor(t0 / 31556952e0 + 1970e0 + 172800e0 / 31556952e0) END"


@register("f8_census_years", twin(f"SELECT input_order, {_CY} AS year FROM entity", "entity"))
def f8(spark, sf):
    return bind(spark, sf, "entity").select("input_order", T.census_year(F.col("t0"), F.col("precision")).alias("year"))


@register("f12_ratios", "SELECT l_suppkey, CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) * 1e6 + 0.5e0) / 1e6 END AS ratio FROM lineitem GROUP BY l_suppkey")
def f12(spark, sf):
    g = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("l_suppkey", D.ratio(F.col("a"), F.col("n")).alias("ratio"))


A1_SQL = twin(f"""SELECT type, slice, span, count(*) AS n, count(*) FILTER (WHERE lon IS NOT NULL) AS has_coordinates, count(*) FILTER (WHERE wikipedia <> '') AS has_article, count(*) FILTER (WHERE lon IS NOT NULL AND wikipedia <> '') AS has_all
FROM (SELECT *, floor(cy / 100) * 100 AS slice, 100e0 AS span FROM (SELECT *, {_CY} AS cy FROM entity) a) b GROUP BY GROUPING SETS ((type, slice, span), (slice, span), (type), ())""", "entity")


@register("a1_census", A1_SQL)
def a1(spark, sf):
    return D.census(bind(spark, sf, "entity"))


@register("a1_precision_histogram", twin("SELECT type, precision, count(*) AS n FROM entity GROUP BY type, precision", "entity"))
def a1_histogram(spark, sf):
    return bind(spark, sf, "entity").groupBy("type", "precision").agg(F.count(F.lit(1)).alias("n"))


@register("a3_resolved_precision", twin("SELECT rank, count(*) AS n FROM (SELECT i.item, s.rank FROM (SELECT DISTINCT item FROM time_fact) i LEFT JOIN spans s ON s.item = i.item) x GROUP BY rank", "time_fact", more=_DATED))
def a3(spark, sf):
    w = _windows(spark, sf)
    return w.select("item").distinct().join(D.item_spans(w), "item", "left").groupBy(T.precision_rank(F.col("label")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@register("a4_calendar_eras", twin("SELECT calendar, CASE WHEN year < 1 THEN 'BCE' ELSE 'CE' END AS era, count(*) AS n FROM spans GROUP BY calendar, CASE WHEN year < 1 THEN 'BCE' ELSE 'CE' END", "time_fact", more=_DATED))
def a4(spark, sf):
    return D.item_spans(_windows(spark, sf)).groupBy("calendar", F.when(F.col("year") < 1, "BCE").otherwise("CE").alias("era")).agg(F.count(F.lit(1)).alias("n"))


@register("a6_time_claims", twin("SELECT property, precision, count(*) AS n FROM time_fact GROUP BY property, precision", "time_fact"))
def a6(spark, sf):
    return bind(spark, sf, "time_fact").groupBy("property", "precision").agg(F.count(F.lit(1)).alias("n"))


# The dump ------------------------------------------------------------------------------------------
_DRAW = "CASE ({0}) % " + str(len(S.DRAWN)) + " " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(S.DRAWN)) + " END"
_TABLE = "taxon(class, rank, class_type) AS (VALUES " + ", ".join(f"('{c}', {r}, '{k}')" for c, r, k, _ in taxonomy.rows()) + ")"


def _items(first, second, sub):
    """The dump's items and their classification; the conditions say which class statements can be used."""
    return f"""{_TABLE},
picked AS (SELECT input_order AS o, 'P31' AS property, {_DRAW.format('input_order')} AS class FROM entity WHERE {first} UNION SELECT input_order, 'P31', {_DRAW.format('input_order * 7 + 3')} FROM entity WHERE {second}
 UNION SELECT input_order, 'P279', {_DRAW.format('input_order * 3 + 1')} FROM entity WHERE {sub}),
met AS (SELECT o, p.class, rank, class_type, CASE WHEN rank < 0 THEN 0 WHEN property = 'P31' THEN 1 ELSE 2 END AS k FROM picked p JOIN taxon t ON p.class = t.class),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k, rank) AS n FROM met) m WHERE n = 1),
classified AS (SELECT input_order AS o, CASE WHEN k IS NULL THEN 'unclassified' WHEN k = 0 THEN 'excluded' ELSE 'typed' END AS outcome, CASE WHEN k > 0 THEN class END AS class, CASE WHEN k IS NULL THEN 'unclassified' WHEN k = 0 THEN 'excluded' ELSE class_type END AS type FROM entity LEFT JOIN best ON o = input_order)"""


ITEMS = _items("input_order % 19 <> 0", "true", "true")


def parsed(spark, sf, spoiled=False):
    """The parsed dump, written once and by all tasks, so that all tasks read it: its readers take a few columns each and parse the claims."""
    return written(S.parse(spread(S.synthetic_lines(spark, sf, spoiled))), "dump")


@register("s3_dump_source", twin("SELECT count(*) AS items, count(*) FILTER (WHERE input_order % 29 <> 0) AS labelled, count(*) FILTER (WHERE wikipedia <> '') AS articles FROM entity", "entity"))
def s3(spark, sf):
    """The dump is read from files: an array over plain, gzip and bzip2 parts."""
    records, root = written(spread(S.synthetic_lines(spark, sf)), "records"), fresh(spark, "dump-files")
    for k, codec in enumerate(("none", "gzip", "bzip2")):
        part = records.filter(F.pmod(F.xxhash64("value"), F.lit(3)) == k).select(F.concat("value", F.lit(",")).alias("value"))
        part.write.option("compression", codec).text(f"{root}/{codec}")
    spark.createDataFrame([("[",), ("]",)], "value string").write.text(f"{root}/brackets")
    f = S.parse(S.lines(spark, [f"{root}/{d}" for d in ("none", "gzip", "bzip2", "brackets")]), S.HEAD).filter("type = 'item'")
    return f.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("labels")["en"]["value"].isNotNull()).alias("labelled"), F.count_if(F.col("sitelinks")["enwiki"]["title"].isNotNull()).alias("articles"))


@register("s3a_dump_integrity", twin("SELECT concat('X', cast(input_order AS VARCHAR)) AS id, 'item' AS type, 'invalid item id' AS violation FROM entity WHERE input_order % 97 = 0 UNION ALL SELECT concat('Q', cast(input_order AS VARCHAR)), 'item', 'repeated id' FROM entity WHERE input_order % 97 = 1 UNION ALL SELECT concat('Q', cast(input_order AS VARCHAR)), 'thing', 'unknown entity kind' FROM entity WHERE input_order % 97 = 2", "entity"))
def s3a(spark, sf):
    p = parsed(spark, sf)
    n = F.substring("id", 2, 20).cast("bigint")
    odd = p.withColumns({"id": F.when(n % 97 == 0, F.concat(F.lit("X"), n.cast("string"))).otherwise(F.col("id")), "type": F.when(n % 97 == 2, "thing").otherwise(F.col("type"))})
    return S.violations(odd.unionByName(p.filter(n % 97 == 1)))


@register("s3b_record_size", twin("SELECT concat('Q', cast(input_order AS VARCHAR)) AS id, 'item' AS type, 'record too large' AS violation FROM entity WHERE input_order % 211 = 0", "entity"))
def s3b(spark, sf):
    """A limit of 16 KiB, with some records padded beyond it."""
    p = parsed(spark, sf)
    long = F.substring("id", 2, 20).cast("bigint") % 211 == 0
    return S.violations(p.withColumn("value", F.when(long, F.rpad("value", 20_000, " ")).otherwise(F.col("value"))), 16 << 10)


@register("p4_statement_gate", twin("""SELECT skip, count(*) AS n FROM (SELECT CASE WHEN input_order % 34 = 0 THEN 'statement_not_an_object' WHEN input_order % 19 = 0 THEN 'statement_rank_not_used' END AS skip FROM entity
UNION ALL SELECT CASE WHEN input_order % 31 = 0 THEN 'snak_shape_unusable' END FROM entity) x GROUP BY skip""", "entity"))
def p4(spark, sf):
    s = S.claim_parts(parsed(spark, sf, True), ["P31"])
    return s.groupBy(F.coalesce("broken", S.skip_reason(F.col("statement"), F.col("property"), "wikibase-item", "wikibase-entityid")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


@register("p5_item_facts", twin("SELECT concat('Q', cast(input_order AS VARCHAR)) AS id, CASE WHEN input_order % 29 = 0 THEN '' ELSE name END AS label, CASE WHEN wikipedia <> '' THEN 2 ELSE 1 END AS links, wikipedia AS article, CASE WHEN input_order % 23 <> 0 THEN lon END AS lon, CASE WHEN input_order % 23 <> 0 THEN lat END AS lat, c.n AS n_classes FROM entity JOIN (SELECT o, count(*) FILTER (WHERE property = 'P31') AS n FROM picked GROUP BY o) c ON c.o = input_order", "entity", more=ITEMS))
def p5(spark, sf):
    return S.facts(parsed(spark, sf)).select("id", "label", "links", "article", "lon", "lat", F.size("instance_of").cast("bigint").alias("n_classes"))


@register("p5_time_facts", twin("SELECT concat('Q', cast(event_id AS VARCHAR)) AS id, property, y, m, d, time_fact.precision, calendar FROM time_fact JOIN entity ON input_order = event_id", "entity", "time_fact"))
def p5_time(spark, sf):
    return S.time_facts(parsed(spark, sf)).filter("skip IS NULL").select("id", "property", "y", "m", "d", "precision", "calendar")


@register("p6_flexible_numbers", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderkey END AS n FROM orders")
def p6(spark, sf):
    k = F.col("o_orderkey")
    t = k.cast("string")
    text = F.when(k % 4 == 0, t).when(k % 4 == 1, F.concat(F.lit('"'), t, F.lit('"'))).when(k % 4 == 2, F.concat(t, F.lit(".0"))).otherwise(F.concat(t, F.lit(".5")))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", S.flexible_int(text).alias("n"))


@register("j8_classify", twin("SELECT concat('Q', cast(o AS VARCHAR)) AS id, outcome, class, type FROM classified", "entity", more=ITEMS))
def j8(spark, sf):
    return S.classify(S.class_ids(parsed(spark, sf))).select("id", "outcome", "class", "type")


@register("a5_unclassified", twin("SELECT p.class, count(*) AS n, count(*) OVER () AS n_classes FROM picked p JOIN classified c ON c.o = p.o WHERE outcome = 'unclassified' AND property = 'P31' GROUP BY p.class ORDER BY n DESC, p.class LIMIT 100", "entity", more=ITEMS))
def a5(spark, sf):
    ids = S.class_ids(parsed(spark, sf))
    open_ids = S.classify(ids).filter("outcome = 'unclassified'").select("id")
    counts = written(ids.filter("property = 'P31'").join(open_ids, "id").groupBy("class").agg(F.count(F.lit(1)).alias("n")), "unclassified")
    return counts.orderBy(F.desc("n"), "class").limit(100).join(counts.agg(F.count(F.lit(1)).alias("n_classes")))


def _census_items(spark, sf):
    p = parsed(spark, sf)
    w = D.converted(S.time_facts(p).filter("skip IS NULL").withColumnRenamed("id", "item").withColumn("second", F.col("second")))
    spans = D.item_spans(w, "pos").withColumnRenamed("item", "id")
    slice_, _ = T.census_slice(F.col("year"))
    joined = S.facts(p, classes=False).withColumnRenamed("label", "name").join(S.classify(S.class_ids(p)), "id").join(spans, "id", "left")
    return joined.select("type", "class", (F.col("name") != "").alias("label"), F.col("t0").isNotNull().alias("dated"), slice_.alias("slice"), F.col("lon").isNotNull().alias("point"), (F.col("article") != "").alias("article"), F.col("links").cast("bigint").alias("links"))


# Level 0 is the total, 1 by type, 2 by class, 3 by slice, 4 by slice and type, 5 by slice and class.
_LEVEL = ["CASE WHEN level IN (1, 4) THEN gtype END", "CASE WHEN level IN (2, 5) THEN gclass END", "CASE WHEN level >= 3 THEN gslice END"]
_OWN = f"""own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t0) AS n FROM windows WHERE {_order(V.START_PROPERTIES)} IS NOT NULL) s WHERE n = 1),
g AS (SELECT c.type AS gtype, c.class AS gclass, input_order % 29 <> 0 AS label, w.t0 IS NOT NULL AS dated, floor(w.year / 100) * 100 AS gslice, input_order % 4 <> 0 AND input_order % 23 <> 0 AS point, wikipedia <> '' AS article
  FROM classified c JOIN entity e ON e.input_order = c.o LEFT JOIN own w ON w.event_id = c.o)"""


def _share(condition):
    return f"floor(count(*) FILTER (WHERE {condition}) / CAST(count(*) AS DOUBLE) * 1e6 + 0.5e0) / 1e6"


@register("a2_dump_census", twin(f"""SELECT {_LEVEL[0]} AS type, {_LEVEL[1]} AS class, {_LEVEL[2]} AS year_slice, count(*) AS n, count(*) FILTER (WHERE label) AS has_label, count(*) FILTER (WHERE dated) AS has_date, count(*) FILTER (WHERE point) AS has_coordinates,
 {_share('label')} AS label_ratio, {_share('dated')} AS date_ratio, {_share('point')} AS coordinate_ratio, {_share('article')} AS article_ratio, {_share('dated AND point AND article')} AS all_ratio FROM g JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(level) ON true
WHERE (level NOT IN (2, 5) OR gclass IS NOT NULL) AND (level < 3 OR gslice IS NOT NULL) GROUP BY level, {', '.join(_LEVEL)}""", "entity", "time_fact", more=f"{ITEMS},\n{CLEAN},\n{WINDOWS},\n{_OWN}"))
def a2(spark, sf):
    ratios = [f"{r}_ratio" for r in ("label", "date", "coordinate", "article", "all")]
    return D.dump_census(_census_items(spark, sf)).select("type", "class", "year_slice", "n", "has_label", "has_date", "has_coordinates", *ratios)


# The spoiled dump in the other engine: which class statements are still usable, and why a dated one isn't.
SPOILED_ITEMS = _items("input_order % 19 <> 0 AND input_order % 34 <> 0", "input_order % 31 <> 0", "input_order % 33 <> 0 AND input_order % 35 <> 0")
_ODD_TIME = "CASE WHEN event_id % 37 = 0 THEN 'time_value_invalid' WHEN event_id % 41 = 0 THEN 'precision' WHEN event_id % 43 = 0 THEN 'uncertainty' WHEN event_id % 47 = 0 THEN 'calendar' WHEN event_id % 53 = 0 AND precision >= 11 THEN 'date' WHEN event_id % 59 = 0 AND precision >= 9 THEN 'range' END"
_RANKS_OF = f"{_order(V.START_PROPERTIES)} AS s, {_order(V.END_PROPERTIES)} AS e"
VISITED = f"""judged AS (SELECT {{0}} AS item, {_RANKS_OF}, {_ODD_TIME} AS why FROM time_fact {{1}}),
reach AS (SELECT item, min(CASE WHEN why IS NULL THEN s END) AS s_to, min(CASE WHEN why IS NULL THEN e END) AS e_to FROM judged WHERE why IS NULL OR why <> 'time_value_invalid' GROUP BY item),
looked AS (SELECT why FROM judged JOIN reach ON judged.item = reach.item WHERE why IS NOT NULL AND why <> 'time_value_invalid' AND (coalesce(s <= coalesce(s_to, 99), false) OR (s_to IS NOT NULL AND coalesce(e <= coalesce(e_to, 99), false))))"""


def _spoiled_items(spark, sf):
    """The spoiled dump's items with their outcome so far, and the reasons for which claims and items were passed over."""
    p = parsed(spark, sf, True)
    times = written(D.converted(S.time_facts(p).withColumnRenamed("id", "item")), "spoiled-times")
    usable = times.filter("skip IS NULL")
    spans = D.item_spans(usable, "pos").withColumnRenamed("item", "id")
    classes = written(S.class_claims(p), "spoiled-classes")
    typed = S.classify(classes.filter("skip IS NULL").select("id", "property", "class").distinct())
    places = written(S.point_claims(p), "spoiled-points")
    items = written(S.facts(p, False, places).withColumnRenamed("label", "name").join(typed, "id", "left").join(spans, "id", "left"), "spoiled-items")
    why = F.when(F.col("outcome") == "excluded", "excluded").when(F.coalesce("outcome", F.lit("unclassified")) == "unclassified", "unclassified").when(F.col("name") == "", "item_without_english_label").when(F.col("t0").isNull(), "item_without_usable_time")
    items = items.withColumn("filtered", why)
    reasons = [classes.select("skip"), times.select("skip"), places.select("skip"), items.filter(F.col("filtered").startswith("item_")).select(F.col("filtered").alias("skip"))]
    unconvertible = D.visited(usable).agg(F.lit("time_value_unconvertible").alias("reason"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).filter("n > 0")
    every = reasons[0]
    for r in reasons[1:]:
        every = every.unionByName(r)
    return items, every.filter("skip IS NOT NULL").groupBy(F.col("skip").alias("reason")).agg(F.count(F.lit(1)).alias("n")).unionByName(unconvertible)


_TIMED = "timed AS (SELECT DISTINCT item FROM judged WHERE why IS NULL AND s IS NOT NULL)"
_FILTERED = "filtered AS (SELECT o, type, CASE WHEN outcome <> 'typed' THEN outcome WHEN o % 29 = 0 THEN 'item_without_english_label' WHEN item IS NULL THEN 'item_without_usable_time' END AS why FROM classified LEFT JOIN timed ON item = o)"
_SPOILED_ALL = f"{SPOILED_ITEMS},\n{VISITED.format('event_id', 'WHERE event_id IN (SELECT input_order FROM entity)')},\n{_TIMED},\n{_FILTERED}"


@register("a7_skip_reasons", twin("""SELECT reason, count(*) AS n FROM (
SELECT CASE WHEN input_order % 34 = 0 THEN 'statement_not_an_object' WHEN input_order % 19 = 0 THEN 'statement_rank_not_used' END AS reason FROM entity
UNION ALL SELECT CASE WHEN input_order % 31 = 0 THEN 'snak_shape_unusable' END FROM entity
UNION ALL SELECT CASE WHEN input_order % 33 = 0 THEN 'claim_group_not_an_array' WHEN input_order % 35 = 0 THEN 'entity_id_value_invalid' END FROM entity
UNION ALL SELECT CASE WHEN input_order % 23 = 0 THEN 'coordinate_not_on_earth' WHEN input_order % 26 = 0 THEN 'coordinate_value_invalid' WHEN input_order % 27 = 0 THEN 'coordinate_out_of_range' END FROM entity WHERE lon IS NOT NULL
UNION ALL SELECT why FROM judged WHERE why = 'time_value_invalid' UNION ALL SELECT 'time_value_unconvertible' FROM looked
UNION ALL SELECT why FROM filtered WHERE why LIKE 'item_%') x WHERE reason IS NOT NULL GROUP BY reason""", "entity", "time_fact", more=_SPOILED_ALL))
def a7(spark, sf):
    return _spoiled_items(spark, sf)[1]


@register("a7_unconvertible_visited", twin("SELECT why AS failure, count(*) AS n FROM looked GROUP BY why", "time_fact", more=VISITED.format("item", "WHERE event_id % 37 <> 0")))
def a7_visited(spark, sf):
    k = F.col("event_id")
    odd = bind(spark, sf, "time_fact").filter(k % 37 != 0)
    odd = odd.withColumns({
        "precision": F.when(k % 41 == 0, 15).otherwise(F.col("precision")), "before": F.when(k % 43 == 0, -1).otherwise(F.col("before")), "calendar": F.when(k % 47 != 0, F.col("calendar")),
        "m": F.when(k % 53 == 0, 2).otherwise(F.col("m")), "d": F.when(k % 53 == 0, 30).otherwise(F.col("d")), "y": F.when(k % 59 == 0, 2_000_000).otherwise(F.col("y")),
    })
    return D.visited(D.converted(odd))


def _outcomes(spark, sf):
    """Each item of the spoiled dump as accepted, filtered or rejected; one in nine is given a precision that the model lacks."""
    items, _ = _spoiled_items(spark, sf)
    n = F.substring("id", 2, 20).cast("bigint")
    row = items.select("id", "type", "filtered", F.col("id").alias("seed_id"), "name", F.lit("documented").alias("status"), F.lit(0.5).alias("importance"), F.when(n % 9 == 0, "eon").otherwise(F.col("label")).alias("precision"), "lon", "lat", "t0", "t1", F.split("categories", ",").alias("cats"))
    reason = M.reject_reason(F.col("cats"))
    outcome = F.when(F.col("filtered").isNotNull(), "filtered").when(reason.isNotNull(), "rejected").otherwise("accepted")
    return written(row.select("id", "type", outcome.alias("outcome"), F.coalesce("filtered", reason).alias("reason")), "outcomes")


_OUTCOMES = "outcomes AS (SELECT o, type, CASE WHEN why IS NOT NULL THEN 'filtered' WHEN o % 9 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN why IS NOT NULL THEN why WHEN o % 9 = 0 THEN 'unknown time precision \"eon\"' END AS reason FROM filtered)"
_REPORT = f"{_SPOILED_ALL},\n{_OUTCOMES}"


@register("a9_import_report", twin("""SELECT outcome, reason, n, floor(n / CAST(CASE WHEN outcome = 'filtered' THEN items ELSE considered END AS DOUBLE) * 1e6 + 0.5e0) / 1e6 AS rate
FROM (SELECT outcome, coalesce(reason, type) AS reason, count(*) AS n FROM outcomes GROUP BY outcome, coalesce(reason, type)) g,
 (SELECT count(*) AS items, count(*) FILTER (WHERE outcome <> 'filtered') AS considered FROM outcomes) t""", "entity", "time_fact", more=_REPORT))
def a9(spark, sf):
    return D.import_report(_outcomes(spark, sf))


@register("q4_reject_gate", twin("""SELECT gate, items, filtered, accepted, rejected, rejected / CAST(items - filtered AS DOUBLE) <= gate AS passes FROM (SELECT count(*) AS items, count(*) FILTER (WHERE outcome = 'filtered') AS filtered, count(*) FILTER (WHERE outcome = 'accepted') AS accepted,
 count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM outcomes) t, (VALUES (0.0e0), (0.05e0), (0.2e0)) v(gate)""", "entity", "time_fact", more=_REPORT))
def q4(spark, sf):
    gates = spark.createDataFrame([(0.0,), (0.05,), (0.2,)], "gate double")
    return D.reject_gate(_outcomes(spark, sf), gates)

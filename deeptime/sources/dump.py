"""Knowledge-graph dump: one JSON entity per line, in an array.

Lines are read as text, so compressed parts are split where their codec allows
it; each line is projected to the few fields that are needed and claims are kept
as JSON until their property is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deeptime.functions import taxonomy
from deeptime.functions import text as X

MAX_RECORD_BYTES = 32 << 20
# Dated properties and calendar models.
TIME_PROPERTIES = ["P580", "P585", "P571", "P569", "P575", "P577", "P574", "P582", "P576", "P570"]
CALENDARS = {"http://www.wikidata.org/entity/Q1985727": "gregorian", "http://www.wikidata.org/entity/Q1985786": "julian"}
_SNAK = "snaktype string, property string, datatype string, datavalue struct<type:string, value:string>"
_STATEMENT = f"struct<rank:string, mainsnak:struct<{_SNAK.replace(' string', ':string').replace('datavalue struct', 'datavalue:struct').replace('type:string, value:string', 'type:string,value:string')}>>"
#: Claims stay JSON text until their property is asked for.
SCHEMA = "id string, type string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, claims map<string,string>, sitelinks map<string,struct<title:string>>"

#: The fields that tell a record's kind, label and article.
HEAD = "type string, labels map<string,struct<value:string>>, sitelinks map<string,struct<title:string>>"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of a dump (plain, gzip or bzip2, by the files' names) without the array's brackets and commas."""
    raw = spark.read.text(path).select(F.trim("value").alias("value"))
    return raw.select(F.regexp_replace("value", ",$", "").alias("value")).filter(~F.col("value").isin("", "[", "]"))


def parse(records: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """``value`` and the fields of ``schema``; a reader of a few names these alone, and what is left out is skipped unread."""
    return records.select("value", F.from_json("value", schema).alias("e")).select("value", "e.*")


def violations(parsed: DataFrame, limit: int = MAX_RECORD_BYTES) -> DataFrame:
    """Records that fail a whole run: unknown kinds, bad or repeated ids, oversize."""
    kind, ident = F.col("type"), F.coalesce("id", F.lit(""))
    why = (
        F.when(F.octet_length("value") > limit, "record too large")
        .when(~F.coalesce(kind, F.lit("")).isin("item", "property"), "unknown entity kind")
        .when((kind == "item") & ~X.entity_id(ident), "invalid item id")
        .when((kind == "property") & ~ident.rlike("^P[1-9][0-9]*$"), "invalid property id")
    )
    bad = parsed.select("id", "type", why.alias("violation")).filter(F.col("violation").isNotNull())
    twice = parsed.filter(why.isNull()).groupBy("id", "type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bad.unionByName(twice.select("id", "type", F.lit("repeated id").alias("violation")))


def flexible_int(text: Column) -> Column:
    """A whole number written as 11, "11" or 11.0; null for anything else."""
    x = F.trim(text, F.lit('"')).try_cast("double")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint"))


def skip_reason(statement: Column, prop: Column, datatype: str, value_type: str) -> Column:
    """Why a statement is not used; null if it is."""
    snak = statement["mainsnak"]
    shape = (snak["snaktype"] == "value") & (snak["property"] == prop) & (snak["datatype"] == datatype) & (snak["datavalue"]["type"] == value_type) & snak["datavalue"]["value"].isNotNull()
    return F.when(~F.coalesce(statement["rank"].isin("normal", "preferred"), F.lit(False)), "statement_rank_not_used").when(~F.coalesce(shape, F.lit(False)), "snak_shape_unusable")


def claim_parts(parsed: DataFrame, properties: list[str]) -> DataFrame:
    """``id, property, pos, statement, broken`` of the items' claims for the properties.

    ``broken`` says why there is no statement: a group that is no array, or a part that is no object.
    A group is parsed at once; only one of which that leaves a part without a statement is taken apart.
    """
    items = parsed.filter("type = 'item'").select("id", F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col("claims")[p].alias("raw")) for p in properties))).alias("x"))
    items = items.select("id", "x.property", "x.raw").filter("raw IS NOT NULL").withColumn("whole", F.from_json("raw", f"array<{_STATEMENT}>"))
    group = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    odd = ~F.col("raw").startswith("[")

    def part(text):
        broken = F.when(odd, "claim_group_not_an_array").when(~F.coalesce(text.startswith("{"), F.lit(False)), "statement_not_an_object")
        return F.struct(F.when(broken.isNull(), F.from_json(text, _STATEMENT)).alias("statement"), broken.alias("broken"))

    sound = ~odd & F.col("whole").isNotNull() & F.forall("whole", lambda s: s.isNotNull() & s["mainsnak"].isNotNull())
    plain = F.transform("whole", lambda s: F.struct(s.alias("statement"), F.lit(None).cast("string").alias("broken")))
    each = items.select("id", "property", F.posexplode(F.when(F.coalesce(sound, F.lit(False)), plain).otherwise(F.transform(group, part))).alias("pos", "part"))
    return each.select("id", "property", "pos", "part.statement", "part.broken")


def statements(parsed: DataFrame, properties: list[str]) -> DataFrame:
    """``id, property, pos, statement`` of the items' claims for the properties."""
    return claim_parts(parsed, properties).filter("broken IS NULL").drop("broken")


def class_claims(parsed: DataFrame) -> DataFrame:
    """``id, property, class, skip`` of every class statement (P31, P279)."""
    value = F.get_json_object(F.col("statement")["mainsnak"]["datavalue"]["value"], "$.id")
    skip = F.coalesce("broken", skip_reason(F.col("statement"), F.col("property"), "wikibase-item", "wikibase-entityid"))
    rows = claim_parts(parsed, ["P31", "P279"]).select("id", "property", value.alias("class"), skip.alias("skip"))
    return rows.withColumn("skip", F.coalesce("skip", F.when(~X.entity_id(F.coalesce("class", F.lit(""))), "entity_id_value_invalid")))


def class_ids(parsed: DataFrame) -> DataFrame:
    """``id, property, class`` for the distinct usable classes of each item (P31, P279)."""
    return class_claims(parsed).filter("skip IS NULL").drop("skip").distinct()


def time_facts(parsed: DataFrame) -> DataFrame:
    """Usable dated statements with their fields, and the reason where one is not usable."""
    s = claim_parts(parsed, TIME_PROPERTIES)
    v = F.from_json(F.col("statement")["mainsnak"]["datavalue"]["value"], "time string, precision string, timezone string, before string, after string, calendarmodel string")
    pattern = r"^([+-])(\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)Z$"
    s = s.select("id", "property", "pos", F.coalesce("broken", skip_reason(F.col("statement"), F.col("property"), "time", "time")).alias("skip"), v.alias("v"))
    # fields behind the sign: year, month, day, hour, minute, second
    fields = F.when(F.col("v.time").rlike(pattern), F.split(F.substring("v.time", 2, 40), "[-T:Z]"))
    rows = s.select("id", "property", "pos", "skip", F.col("v.time").alias("time"), fields.alias("f"), F.col("v.precision").alias("_p"), *(F.coalesce(F.col(f"v.{x}"), F.lit("0")).alias(f"_{x}") for x in ("timezone", "before", "after")), F.col("v.calendarmodel").alias("model"))
    rows = rows.withColumns({"precision": flexible_int(F.col("_p")), "timezone": flexible_int(F.col("_timezone")), "before": flexible_int(F.col("_before")), "after": flexible_int(F.col("_after")), "stated": F.col("f")[0].try_cast("bigint")})
    part = lambda k: F.col("f")[k].try_cast("int")
    calendar = F.lit(None).cast("string")
    for uri, name in CALENDARS.items():
        calendar = F.when(F.col("model") == uri, name).otherwise(calendar)
    y = F.when(F.col("time").startswith("-"), 1 - F.col("stated")).otherwise(F.col("stated"))
    bad = F.col("skip").isNull() & (F.col("precision").isNull() | F.col("f").isNull() | F.col("stated").isNull() | (F.col("stated") == 0) | F.col("timezone").isNull() | (F.col("timezone") != 0))
    return rows.select(
        "id", "property", "pos", F.when(bad, "time_value_invalid").otherwise(F.col("skip")).alias("skip"), y.alias("y"), part(1).alias("m"), part(2).alias("d"),
        (part(3) * 3600 + part(4) * 60 + part(5)).alias("second"), F.col("precision").cast("int").alias("precision"), calendar.alias("calendar"), "before", "after",
    )


def point_claims(parsed: DataFrame) -> DataFrame:
    """``id, pos, lon, lat, skip`` of every coordinate statement (P625)."""
    v = F.col("statement")["mainsnak"]["datavalue"]["value"]
    field = lambda name: F.get_json_object("value", f"$.{name}")
    skip = F.coalesce("broken", skip_reason(F.col("statement"), F.col("property"), "globe-coordinate", "globecoordinate"))
    s = claim_parts(parsed, ["P625"]).select("id", "pos", skip.alias("skip"), v.alias("value"))
    rows = s.select("id", "pos", "skip", field("longitude").try_cast("double").alias("lon"), field("latitude").try_cast("double").alias("lat"), field("globe").alias("globe"))
    why = (
        F.when(F.col("globe").isNull(), "coordinate_value_invalid")
        .when(~F.col("globe").endswith("/Q2"), "coordinate_not_on_earth")
        .when(F.col("lon").isNull() | F.col("lat").isNull(), "coordinate_value_invalid")
        .when(~X.valid_lon_lat(F.col("lon"), F.col("lat")), "coordinate_out_of_range")
    )
    return rows.select("id", "pos", "lon", "lat", F.coalesce("skip", why).alias("skip"))


def points(claims: DataFrame) -> DataFrame:
    """First usable coordinate on Earth of each item, from its ``point_claims``."""
    good = claims.filter("skip IS NULL")
    return good.groupBy("id").agg(F.min_by(F.struct("lon", "lat"), "pos").alias("p")).select("id", "p.lon", "p.lat")


def facts(parsed: DataFrame, classes: bool = True, places: DataFrame | None = None) -> DataFrame:
    """One row per item with labels, classes, point and links; without ``classes`` their claims are not read, nor those of points where ``places`` has ``point_claims`` already."""
    base = parsed.filter("type = 'item'").select("id", F.coalesce(F.col("labels")["en"]["value"], F.lit("")).alias("label"), F.coalesce(F.size("sitelinks"), F.lit(0)).alias("links"), F.coalesce(F.col("sitelinks")["enwiki"]["title"], F.lit("")).alias("article"))
    base = base.join(points(point_claims(parsed) if places is None else places), "id", "left")
    if not classes:
        return base
    both = class_ids(parsed).groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("property") == "P31", F.col("class")))).alias("instance_of"), F.array_sort(F.collect_set(F.when(F.col("property") == "P279", F.col("class")))).alias("subclass_of")
    )
    return base.join(both, "id", "left")


def classify(classes: DataFrame) -> DataFrame:
    """``id, outcome, class, type, categories`` from ``(id, property, class)``.

    An excluded class wins; then the accepted class of least rank among P31, then among P279.
    """
    spark = classes.sparkSession
    table = F.broadcast(spark.createDataFrame(taxonomy.rows(), "class string, rank int, class_type string, categories string"))
    hit = classes.join(table, "class", "left")
    order = F.when(F.col("rank") < 0, 0).when(F.col("property") == "P31", 1).otherwise(2)
    best = hit.filter("rank IS NOT NULL").groupBy("id").agg(F.min(F.struct(order.alias("o"), "rank", "class", "class_type", "categories")).alias("b"))
    every = classes.select("id").distinct().join(best, "id", "left")
    outcome = F.when(F.col("b").isNull(), "unclassified").when(F.col("b.o") == 0, "excluded").otherwise("typed")
    typed = outcome == "typed"
    return every.select("id", outcome.alias("outcome"), F.when(typed, F.col("b.class")).alias("class"), F.when(typed, F.col("b.class_type")).otherwise(outcome).alias("type"), F.when(typed, F.col("b.categories")).alias("categories"))


#: Classes that the synthetic dump draws from: typed, excluded and unknown ones.
DRAWN = ["Q178561", "Q198", "Q5", "Q555555", "Q999999", "Q4167410", "Q777777", "Q7944", "Q888888", "Q634", "Q666666"]


def synthetic_lines(spark: SparkSession, sf_dir: str, spoiled: bool = False) -> DataFrame:
    """Dump lines made from the star schema: an item for each order, dated by its time facts.

    With ``spoiled`` some claims are unusable, each in one of the ways that are counted.
    """
    from deeptime.fixtures import bind

    o, k = F.col("input_order"), F.col("event_id")
    bad = lambda of, n, worse, fine: F.when(of % n == 0, worse).otherwise(fine) if spoiled else fine
    text = lambda c: c.cast("string")
    pick = lambda k: F.element_at(F.array(*map(F.lit, DRAWN)), (k % len(DRAWN) + 1).cast("int"))
    entity_value = lambda c: F.struct(F.lit("wikibase-entityid").alias("type"), F.to_json(F.struct(c.alias("id"))).alias("value"))

    def stm(prop, datatype, value, rank, snak=None):
        return F.struct(rank.alias("rank"), F.struct((F.lit("value") if snak is None else snak).alias("snaktype"), prop.alias("property"), F.lit(datatype).alias("datatype"), value.alias("datavalue")).alias("mainsnak"))

    def claim(prop, *stms):
        return F.concat(F.lit(f'"{prop}":'), F.to_json(F.array(*stms)))

    first = stm(F.lit("P31"), "wikibase-item", entity_value(pick(o)), F.when(o % 19 == 0, "deprecated").otherwise("normal"))
    second = stm(F.lit("P31"), "wikibase-item", entity_value(pick(o * 7 + 3)), F.lit("normal"), bad(o, 31, F.lit("novalue"), F.lit("value")))
    p31 = bad(o, 34, F.concat(F.lit('"P31":["odd",'), F.to_json(second), F.lit("]")), claim("P31", first, second))
    sub = claim("P279", stm(F.lit("P279"), "wikibase-item", entity_value(bad(o, 35, F.lit("X1"), pick(o * 3 + 1))), F.lit("preferred")))
    p279 = bad(o, 33, F.lit('"P279":{}'), sub)
    globe = F.concat(F.lit("http://www.wikidata.org/entity/"), F.when(o % 23 == 0, "Q111").otherwise("Q2"))
    place = F.struct(bad(o, 27, F.lit("95.5"), text(F.col("lat"))).alias("latitude"), bad(o, 26, F.lit("east"), text(F.col("lon"))).alias("longitude"), globe.alias("globe"))
    p625 = F.when(F.col("lon").isNotNull(), claim("P625", stm(F.lit("P625"), "globe-coordinate", F.struct(F.lit("globecoordinate").alias("type"), F.to_json(place).alias("value")), F.lit("normal"))))
    uri = {v: k for k, v in CALENDARS.items()}
    f = bind(spark, sf_dir, "time_fact")
    year = F.when(F.col("y") >= 1, F.col("y")).otherwise(1 - F.col("y"))
    year = bad(k, 59, F.lit(2_000_000).cast("bigint"), year)
    digits = F.lpad(text(year), F.greatest(F.lit(4), F.length(text(year))), F.lit("0"))
    month, day = bad(k, 53, F.lit(2), F.col("m")), bad(k, 53, F.lit(30), F.col("d"))
    time = F.concat(F.when(F.col("y") >= 1, "+").otherwise("-"), digits, F.lit("-"), F.lpad(text(month), 2, "0"), F.lit("-"), F.lpad(text(day), 2, "0"), F.lit("T00:00:00Z"))
    model = bad(k, 47, F.lit("http://www.wikidata.org/entity/Q1"), F.when(F.col("calendar") == "julian", uri["julian"]).otherwise(uri["gregorian"]))
    value = F.to_json(F.struct(time.alias("time"), bad(k, 41, F.lit(15), F.col("precision")).alias("precision"), model.alias("calendarmodel"), bad(k, 37, F.lit(60), F.lit(0)).alias("timezone"), bad(k, 43, F.lit(-1), F.col("before")).alias("before"), "after"))
    one = stm(F.col("property"), "time", F.struct(F.lit("time").alias("type"), value.alias("value")), F.lit("normal"))
    dated = f.select(k.alias("item"), F.concat(F.lit('"'), "property", F.lit('":'), F.to_json(F.array(one))).alias("dated"))
    links = F.when(F.col("wikipedia") != "", F.map_from_arrays(F.array(F.lit("enwiki"), F.lit("dewiki")), F.array(F.struct(F.col("wikipedia").alias("title")), F.struct(F.lit("x").alias("title"))))).otherwise(F.map_from_arrays(F.array(F.lit("frwiki")), F.array(F.struct(F.lit("y").alias("title")))))
    label = F.map_from_arrays(F.array(F.when(o % 29 == 0, "de").otherwise("en")), F.array(F.struct(F.col("name").alias("value"))))
    j = bind(spark, sf_dir, "entity").join(dated, o == F.col("item"), "left")
    claims = F.concat_ws(",", p31, p279, p625, "dated")
    return j.select(F.concat(F.lit('{"id":"Q'), text(o), F.lit('","type":"item","labels":'), F.to_json(label), F.lit(',"claims":{'), claims, F.lit('},"sitelinks":'), F.to_json(links), F.lit("}")).alias("value"))

"""Dated statements: windows, item spans, censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deeptime.functions import time as T
from deeptime.functions import vocab as V


def converted(facts: DataFrame) -> DataFrame:
    """Facts ``(item, property, y, m, d, precision, calendar, before, after)`` with their half-open windows.

    ``y`` is astronomical, ``second`` (if given) counts from midnight. What is
    finer than the precision is ignored. Adds ``t0, t1, label, year, failure``;
    ``failure`` names why there is no window. The steps are columns of their
    own, as each is used several times by the next.
    """
    c, one = F.col, F.lit(1)
    rows = facts if "second" in facts.columns else facts.withColumn("second", F.lit(0))
    p, cal, y = c("precision"), c("calendar"), c("y")
    rows = rows.withColumns({"_m": F.when(p < 10, 1).otherwise(c("m")), "_d": F.when(p < 11, 1).otherwise(c("d")), "_unit": T.lookup(p, T.UNIT_YEARS), "_clock": F.when(p == 12, 3600).when(p == 13, 60).when(p == 14, 1)})
    m, d, unit, clock = c("_m"), c("_d"), c("_unit"), c("_clock")
    failure = (
        F.when(p.isNull() | ~p.between(0, 14), "precision")
        .when((c("before") < 0) | (c("after") < 0), "uncertainty")
        .when(cal.isNull() | ~cal.isin("julian", "gregorian"), "calendar")
        .when(y.isNull() | ~m.between(1, 12) | (d < 1) | (d > T.days_in_month(cal, y, m)), "date")
        .when(unit.isNull() & ~y.between(-4799, 999999), "range")
    )
    # the first day of the unit and the first day after it
    start_m, start_d = F.when(p == 9, one).otherwise(m), F.when(p <= 10, one).otherwise(d)
    next_y = F.when((p == 9) | ((p == 10) & (m == 12)), y + 1).otherwise(y)
    next_m = F.when((p == 9) | ((p == 10) & (m == 12)), one).when(p == 10, m + 1).otherwise(m)
    rows = rows.withColumns({"failure": failure, "_start_year": F.floor(y / unit) * unit, "_sm": start_m, "_sd": start_d, "_ny": next_y, "_nm": next_m})
    rows = rows.withColumns({"_first": T.day_seconds(T.julian_day(cal, y, c("_sm"), c("_sd"))), "_next": T.day_seconds(T.julian_day(cal, c("_ny"), c("_nm"), c("_sd")))})
    start = F.when(unit.isNotNull(), T.year_to_seconds(c("_start_year"))).when(clock.isNotNull(), c("_first") + F.floor(c("second") / clock) * clock).otherwise(c("_first"))
    rows = rows.withColumn("_start", start)
    end = F.when(unit.isNotNull(), T.year_to_seconds(c("_start_year") + unit)).when(clock.isNotNull(), c("_start") + clock).when(p == 11, c("_first") + 86400).otherwise(c("_next"))
    rows = rows.withColumn("_length", end - c("_start"))
    ok = c("failure").isNull()
    rows = rows.withColumns({"t0": F.when(ok, c("_start") - c("before") * c("_length")), "t1": F.when(ok, c("_start") + c("_length") * (1 + c("after"))), "_label": F.when(ok, T.lookup(p, T.SOURCE_LABEL))})
    rows = rows.withColumn("_span", T.span_rank(c("t1") - c("t0"))).withColumn("_rank", F.least(T.precision_rank(c("_label")), c("_span")))
    label = F.when((c("before") > 0) | (c("after") > 0), T.rank_label(c("_rank"))).otherwise(c("_label"))
    year = F.when(ok, F.when(unit.isNotNull(), c("_start_year")).otherwise(y.cast("double")) + F.lit(0.0))
    return rows.withColumns({"label": F.when(ok, label), "year": year}).select(*facts.columns, "t0", "t1", "label", "year", "failure")


def item_spans(windows: DataFrame, position: str = "event_id") -> DataFrame:
    """Start and end of each item.

    The start is the earliest window of the first start property that has one;
    the end is the latest of the first end property with one, if it is not
    before the start, else the start's own end. The coarser label counts.
    """
    ok = windows.filter("failure IS NULL")
    start_rank, end_rank = (T.lookup(F.col("property"), {p: i for i, p in enumerate(ps)}) for ps in (V.START_PROPERTIES, V.END_PROPERTIES))
    start = F.min(F.when(start_rank.isNotNull(), F.struct(start_rank.alias("k"), F.col("t0").alias("at"), F.col(position).alias("pos"), "t1", "label", "year", "calendar")))
    end = F.min(F.when(end_rank.isNotNull(), F.struct(end_rank.alias("k"), (-F.col("t1")).alias("at"), F.col(position).alias("pos"), "label")))
    g = ok.groupBy("item").agg(start.alias("s"), end.alias("e")).filter("s IS NOT NULL")
    takes = F.col("e").isNotNull() & (-F.col("e.at") >= F.col("s.at"))
    rank = lambda c: T.precision_rank(F.col(c))
    label = F.when(takes, T.rank_label(F.least(rank("s.label"), rank("e.label")))).otherwise(F.col("s.label"))
    return g.select("item", F.col("s.at").alias("t0"), F.when(takes, -F.col("e.at")).otherwise(F.col("s.t1")).alias("t1"), label.alias("label"), F.col("s.year").alias("year"), F.col("s.calendar").alias("calendar"))


def visited(windows: DataFrame) -> DataFrame:
    """Failures of the claims that the search for an item's span looks at.

    Start properties count up to the first that yields a window; end properties
    only where a start was found, up to the first that yields one.
    """
    s, e = (T.lookup(F.col("property"), {p: i for i, p in enumerate(ps)}) for ps in (V.START_PROPERTIES, V.END_PROPERTIES))
    rows = windows.withColumn("s", s).withColumn("e", e)
    ok = F.col("failure").isNull()
    reach = rows.groupBy("item").agg(F.min(F.when(ok, F.col("s"))).alias("s_to"), F.min(F.when(ok, F.col("e"))).alias("e_to"))
    looked = (F.col("s") <= F.coalesce("s_to", F.lit(99))) | (F.col("s_to").isNotNull() & (F.col("e") <= F.coalesce("e_to", F.lit(99))))
    return rows.filter("failure IS NOT NULL").join(reach, "item").filter(looked).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


def ratio(part: Column, total: Column) -> Column:
    """Share to six places; 0 where there is nothing."""
    return F.when(total == 0, 0.0).otherwise(F.floor(part / F.when(total != 0, total) * 1e6 + 0.5) / 1e6)


def import_report(outcomes: DataFrame) -> DataFrame:
    """``outcome, reason, n, rate``: filtered and rejected by reason, accepted by type.

    ``outcomes(type, outcome, reason)`` has one row per item. Filtered items are
    set against all, the others against those that were not filtered.
    """
    total = outcomes.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("outcome") != "filtered").alias("considered"))
    g = outcomes.groupBy("outcome", F.coalesce("reason", "type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    j = g.join(F.broadcast(total))  # one row
    return j.select("outcome", "reason", "n", ratio(F.col("n"), F.when(F.col("outcome") == "filtered", F.col("items")).otherwise(F.col("considered"))).alias("rate"))


def reject_gate(outcomes: DataFrame, gates: DataFrame) -> DataFrame:
    """Whether the share of rejected items among those not filtered is within each gate."""
    count = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    total = outcomes.agg(F.count(F.lit(1)).alias("items"), *map(count, ("filtered", "accepted", "rejected")))
    share = F.col("rejected") / F.nullif(F.col("items") - F.col("filtered"), F.lit(0))
    return gates.join(F.broadcast(total)).withColumn("passes", F.coalesce(share, F.lit(0.0)) <= F.col("gate"))


def census(entities: DataFrame) -> DataFrame:
    """Counts in total, by type, by time slice, and by slice and type, in one pass of grouping sets."""
    year = T.census_year(F.col("t0"), F.col("precision"))
    start, span = T.census_slice(F.col("cy"))
    rows = entities.withColumn("cy", year).withColumn("slice", start).withColumn("span", span)
    point, article = F.col("lon").isNotNull(), F.col("wikipedia") != ""
    return rows.groupingSets([["type", "slice", "span"], ["slice", "span"], ["type"], []], "type", "slice", "span").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(point).alias("has_coordinates"), F.count_if(article).alias("has_article"), F.count_if(point & article).alias("has_all")
    )


def dump_census(items: DataFrame) -> DataFrame:
    """Coverage of dump items by type, class and slice; ratios to six places.

    ``items(type, class, label, dated, slice, point, article, links)``; class
    rows only for typed items, slice rows only for dated ones.
    """
    i = items.withColumn("year_slice", F.when(F.col("dated"), F.col("slice")))
    sets = [[], ["type"], ["class"], ["year_slice"], ["year_slice", "type"], ["year_slice", "class"]]
    g = i.groupingSets(sets, "type", "class", "year_slice").agg(
        F.grouping_id("type", "class", "year_slice").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("label").alias("has_label"), F.count_if("dated").alias("has_date"),
        F.count_if("point").alias("has_coordinates"), F.count_if("article").alias("has_article"), F.count_if(F.col("links") > 0).alias("has_link"),
        F.count_if(F.col("dated") & F.col("point") & F.col("article")).alias("has_all"), F.sum("links").alias("links"),
    )
    by_class, by_slice = F.col("level").bitwiseAND(2) == 0, F.col("level").bitwiseAND(1) == 0
    g = g.filter(~by_class | F.col("class").isNotNull()).filter(~by_slice | F.col("year_slice").isNotNull())
    shares = {"label": "has_label", "date": "has_date", "coordinate": "has_coordinates", "article": "has_article", "all": "has_all"}
    return g.withColumns({f"{name}_ratio": ratio(F.col(c), F.col("n")) for name, c in shares.items()})

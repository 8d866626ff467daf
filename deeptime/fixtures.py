"""Bindings of the star-schema tables to this domain, in SQL that both engines run.

``bind`` gives the domain tables as DataFrames; ``twin`` prefixes a query with
the same tables for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENTITY = """
SELECT o_orderkey AS input_order,
 concat('ord-', cast(o_orderkey AS STRING)) AS seed_id,
 concat('Order of customer ', cast(o_custkey AS STRING), ' lot ', cast(o_orderkey % 97 AS STRING)) AS name,
 split_part('event,person,species,object,place,organization,state,invention,product,technology,book,natural_event', ',', cast(o_orderkey % 12 + 1 AS INT)) AS type,
 cast(EPOCH(o_orderdate) AS DOUBLE) AS t0,
 cast(EPOCH(o_orderdate) AS DOUBLE) + cast((o_orderkey % 40) * (o_orderkey % 7) AS DOUBLE) * 86400e0 AS t1,
 split_part('year,month,day,decade,century,hour,year,month', ',', cast(o_orderkey % 8 + 1 AS INT)) AS precision,
 split_part('observed,documented,estimated,projected,legendary,disputed', ',', cast(o_custkey % 6 + 1 AS INT)) AS status,
 cast(cast(floor(o_totalprice) AS BIGINT) % 100 + 1 AS DOUBLE) / 100e0 AS importance,
 split_part('universe,earth,life,war,politics,science,technology,culture,exploration,economy,religion,disaster,future', ',', cast(o_orderkey % 13 + 1 AS INT)) AS cat0,
 CASE WHEN o_custkey % 13 <> o_orderkey % 13 THEN split_part('universe,earth,life,war,politics,science,technology,culture,exploration,economy,religion,disaster,future', ',', cast(o_custkey % 13 + 1 AS INT)) END AS cat1,
 CASE WHEN o_orderkey % 4 <> 0 THEN cast((o_custkey * 37) % 360 - 180 AS DOUBLE) END AS lon,
 CASE WHEN o_orderkey % 4 <> 0 THEN cast((o_custkey * 17) % 180 - 90 AS DOUBLE) END AS lat,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('Q', cast(o_orderkey + 1 AS STRING)) ELSE '' END AS wikidata,
 CASE WHEN o_orderkey % 5 < 2 THEN concat('Article ', cast(o_orderkey AS STRING)) ELSE '' END AS wikipedia
FROM orders"""

_RELATIONSHIP = """
SELECT concat('ord-', cast(o_orderkey AS STRING)) AS seed_id, 0 AS ord, 'part_of' AS type, concat('ord-', cast(first_key AS STRING)) AS target
FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key FROM orders) a
WHERE o_orderkey <> first_key
UNION ALL
SELECT concat('ord-', cast(o_orderkey AS STRING)), CASE WHEN o_orderkey <> first_key THEN 1 ELSE 0 END,
       CASE WHEN o_orderkey % 3 = 0 THEN 'preceded' WHEN o_orderkey % 3 = 1 THEN 'built_upon' ELSE 'participant' END,
       concat('ord-', cast(next_key AS STRING))
FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key,
             lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders) b
WHERE next_key IS NOT NULL"""

_CLAIM = """
SELECT concat('ord-', cast(l_orderkey AS STRING)) AS seed_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord,
       concat('prop_', l_returnflag) AS property,
       CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS value,
       CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS min,
       CASE WHEN l_linenumber % 2 = 1 THEN l_quantity + l_linenumber END AS max,
       CASE WHEN l_linestatus = 'O' THEN 'kg' ELSE 'm' END AS unit,
       CASE WHEN l_linestatus = 'O' THEN 'measured' ELSE 'estimated' END AS value_type,
       concat('supplier ', cast(l_suppkey AS STRING)) AS source,
       cast(year(l_shipdate) AS STRING) AS published_at
FROM lineitem"""

_SLICE = """
SELECT year, t_from, coalesce(lead(t_from) OVER (ORDER BY t_from) - 1, 2035) AS t_to
FROM (SELECT DISTINCT year(o_orderdate) AS year, year(o_orderdate) AS t_from FROM orders WHERE year(o_orderdate) % 2 = 0) s"""

_TIME_FACT = """
SELECT event_id, user_id % 200 AS item,
 split_part('P580,P585,P571,P569,P582,P576,P570', ',', cast(event_id % 7 + 1 AS INT)) AS property,
 year(ts) - cast(event_id % 3000 AS INT) AS y, month(ts) AS m, cast(1 + event_id % 28 AS INT) AS d,
 cast(6 + event_id % 9 AS INT) AS precision,
 CASE WHEN event_id % 5 = 0 THEN 'julian' ELSE 'gregorian' END AS calendar,
 CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS before, 0 AS after
FROM events"""

_VIEW = """
SELECT cast(view_id AS BIGINT) AS view_id, v.t0, v.t1, (v.t0 + v.t1) / 2e0 AS cursor, min_importance
FROM (SELECT 1 AS view_id, 7.9e8 AS t0, 9.9e8 AS t1, 0.0e0 AS min_importance
 UNION ALL SELECT 2, 8.2e8, 8.5152e8, 0.2e0
 UNION ALL SELECT 3, 8.7e8, 8.726e8, 0.0e0
 UNION ALL SELECT 4, 9.0e8, 9.004e8, 0.5e0
 UNION ALL SELECT 5, 9.2e8, 9.2002e8, 0.0e0
 UNION ALL SELECT 6, -1e10, 1e10, 0.3e0) v"""

_RING = """
SELECT n_nationkey AS ring_id, n_name AS name, cast(n_nationkey * 14 - 175 AS DOUBLE) AS x0, cast(n_nationkey * 6 - 80 AS DOUBLE) AS y0 FROM nation"""

TABLES = {"entity": _ENTITY, "relationship": _RELATIONSHIP, "claim": _CLAIM, "slice": _SLICE, "time_fact": _TIME_FACT, "viewport": _VIEW, "ring": _RING}
_BASE = {"entity": "orders", "relationship": "orders", "claim": "lineitem", "slice": "orders", "time_fact": "events", "ring": "nation"}


def _epoch(sql: str, spell: str) -> str:
    return sql.replace("EPOCH(o_orderdate)", spell)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table ``name`` over the tables of ``sf_dir``."""
    sql = _epoch(TABLES[name], "unix_seconds(cast(o_orderdate AS TIMESTAMP))")
    if base := _BASE.get(name):
        return spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    return spark.sql(sql)


def twin(query: str, *names: str, more: str = "") -> str:
    """``query`` for the other engine, over the named domain tables and the common table expressions in ``more``."""
    parts = []
    for n in names:
        sql = _epoch(TABLES[n], "epoch(o_orderdate)").replace("AS STRING)", "AS VARCHAR)")
        parts.append(f"{n} AS ({sql})")
    if not (parts or more):
        return query
    return "WITH " + ("RECURSIVE " if "RECURSIVE" in more else "") + ",\n".join([*parts, *([more.replace("RECURSIVE ", "")] if more else [])]) + "\n" + query

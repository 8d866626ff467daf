"""URL verdicts from host and path rules.

Each URL is expanded into host-suffix and path-prefix expressions, which are
equi-joined with the rules on a short prefix of their digests; what meets is
confirmed by full digest and by the rule's whole path, and the longest rule wins.

Defined cases: a null url or one without ``://`` has an empty host and path and
fits no rule; of rules of equal length a block beats an allow, then the larger
rule text wins; repeated rows are judged each; where no rule fits the verdict
is ``default``; a url of very many labels or parts is expanded no further than the
rule with most labels and the one with most slashes, as nothing beyond can fit;
an empty table gives an empty result; columns beyond ``page_id``
and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import ascii_lower, stored

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hexadecimal digits of a digest that the join compares.
SHORT = 8
#: Rules up to this number (well under 20 MB) are broadcast; beyond it both sides are shuffled.
BROADCAST_RULES = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _upto(n: Column, most: int) -> Column:
    """1 to the lesser of ``n`` and ``most``; empty if that is 0."""
    last = F.least(n, F.lit(most))
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def host_suffixes(host: Column, most: int) -> Column:
    """``a.b.c`` gives ``c``, ``b.c`` and ``a.b.c``, up to ``most`` labels."""
    return F.transform(_upto(F.size(F.split(host, r"\.", -1)), most), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def path_prefixes(path: Column, most: int) -> Column:
    """The empty prefix and those that end with a slash, up to ``most`` slashes: ``/a/b`` gives ````, ``/`` and ``/a/``."""
    ended = F.transform(_upto(F.length(F.regexp_replace(path, "[^/]+", "")), most), lambda i: F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/")))
    return F.concat(F.array(F.lit("")), ended)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, action)`` keyed by the digest of host and of the path up to its last slash."""
    key_path = F.regexp_extract(F.col("path"), r"^(.*/|)", 1)
    digest = F.sha2(F.concat(ascii_lower(F.col("host")), F.lit("\n"), key_path), 256)
    return rules.select(
        digest.alias("rule_digest"),
        F.substring(digest, 1, SHORT).alias("short"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.length(F.regexp_replace(key_path, "[^/]+", "")).alias("slashes"),
        F.col("path").alias("rule_path"),
        F.concat("host", "path").alias("rule"),
        F.col("action"),
    ).dropDuplicates(["rule", "rule_path", "action"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``."""
    host, path = split_url(F.col("url"))
    # stored once, so that a row keeps its number in both branches below
    urls = stored(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    keyed = rule_table(rules)
    shape = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes")).first()
    keyed = F.broadcast(keyed) if shape.n <= BROADCAST_RULES else keyed
    expanded = (
        urls.filter(F.col("host") != "")
        .select("row", "path", F.explode(host_suffixes(F.col("host"), shape.labels)).alias("suffix"))
        .select("row", "path", "suffix", F.explode(path_prefixes(F.col("path"), shape.slashes)).alias("prefix"))
    )
    digest = F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)
    hits = (
        expanded.select("row", "path", digest.alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
        .join(keyed, "short")
        .filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    )
    rank = F.struct(F.length("rule").alias("size"), (F.col("action") == "block").alias("blocks"), "rule", "action")
    won = hits.groupBy("row").agg(F.max(rank).alias("won")).select("row", "won.rule", "won.action")
    return urls.join(won, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


SQL = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT s.page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY s.page_id ORDER BY length(rhost || rpath) DESC) AS n
      FROM s JOIN r ON (s.host = rhost OR s.host LIKE '%.' || rhost) AND starts_with(s.path, rpath))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM s LEFT JOIN f ON s.page_id = f.page_id AND f.n = 1
"""

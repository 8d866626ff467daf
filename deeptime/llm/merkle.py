"""Merkle dataset manifest: a hash tree over the rows of ``documents``, and proofs by a recursive climb.

Each row is a leaf: the hash of its fields, each as ``-`` if null, else its UTF-8
byte count, ``:`` and its value. Within a language leaves ascend by ``doc_id``
(nulls first; of rows that repeat an id, the smaller leaf first), and every
``FAN`` consecutive nodes become the hash of their hex digests, level by level,
until one remains: the language's subroot. Subroots, by language (null first,
bytewise), form one more tree, whose top is the root.

The built levels are stored as parent-linked rows: a node, its parent and the
digests of its siblings before and after it. ``climb`` asks Spark's recursive
query for every leaf: each step meets a node's row, appends its siblings to the
proof, folds the claimed digests into the parent's and goes on there. The leaves
of a run have the same way up, so one row climbs for the run and folds a digest
for each of its leaves.

Places come from range partitions plus offsets, and runs hold ``FAN`` nodes at
most, so no task sees a language whole. Digests travel as 32 bytes.

Defined cases: null fields as above; a row without an id is never tampered with;
empty and very long texts are hashed whole (one text in a task at a time); equal
rows are leaves of their own; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import broadcast_if_small, stored

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to which the table of languages is broadcast.
BROADCAST_ROWS = 100_000
#: The tree over the subroots.
TOP = -1
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def tampered_text() -> Column:
    """A-Z lowered where three divides the id's CRC-32; else the text itself."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def claimed_leaves(docs: DataFrame, text: Column) -> DataFrame:
    """``doc_id, lang, leaf, claim, seq``: each row's leaf, and its leaf if its text were ``text`` (32 bytes each)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in FIELDS[1:]))
    leaf, claim = leaf_hash(F.col("text")), leaf_hash(text)
    claim = F.when(text.eqNullSafe(F.col("text")), leaf).otherwise(claim)
    return given.select("doc_id", "lang", F.unhex(leaf).alias("leaf"), F.unhex(claim).alias("claim"), F.monotonically_increasing_id().alias("seq"))


def placed(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """``df`` with ``place``, its gapless number from 0 in the order of ``by`` (which must tell all rows apart)."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = stored(ranges.withColumn("place", F.monotonically_increasing_id()), label)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # a row for each partition
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, before = [], 0
    for r in sizes:
        offsets.append((r.part, before))
        before += r.n
    known = spark.createDataFrame(offsets, "part long, before long")
    return ordered.withColumn("part", part).join(F.broadcast(known), "part").withColumn("place", within + F.col("before")).drop("part", "before")


def _digest(nodes: Column) -> Column:
    """H of binary digests, taken as hex text."""
    return F.unhex(F.sha2(F.array_join(F.transform(nodes, lambda h: F.lower(F.hex(h))), ""), 256))


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """``tree, level, idx, n, kids, hash`` of the parents of ``nodes(tree, idx, n, hash)``; ``n`` is their number in the tree."""
    kid = F.struct(F.col("idx").alias("at"), "hash")
    runs = nodes.filter("n > 1").groupBy("tree", F.col("n").alias("of"), F.shiftright("idx", 3).alias("idx")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    runs = runs.withColumn("kids", F.col("kids.hash"))
    return runs.select("tree", F.lit(level).alias("level"), "idx", F.expr(f"(of + {FAN - 1}) div {FAN}").alias("n"), "kids", _digest(F.col("kids")).alias("hash"))


def _levels(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """The stored levels above ``nodes``, of whose trees the largest has ``most``."""
    out = []
    while most > 1:
        out.append(stored(_runs(nodes, len(out) + 1), f"{label}-{len(out) + 1}"))
        nodes, most = out[-1], -(-most // FAN)
    return out


@dataclass
class Manifest:
    """Stored levels. ``runs``: the leaves, ``FAN`` to a row; ``links``: every other node; ``root`` in hex."""

    runs: DataFrame
    links: DataFrame
    trees: DataFrame
    root: str


def _up() -> list[Column]:
    """A parent's key: a tree's only node left is a leaf of the tree over the subroots."""
    top = (F.col("n") == 1) & (F.col("tree") != TOP)
    return [F.when(top, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"), F.when(top, 0).otherwise(F.col("level")).alias("up_level"), F.when(top, F.col("tree")).otherwise(F.col("idx")).alias("up_idx")]


def _links(runs: DataFrame) -> DataFrame:
    """A row for each child of ``runs``: its key, its parent's, and its siblings' digests before and after it."""
    joined = lambda a: F.unhex(F.array_join(F.transform(a, F.hex), ""))
    kids = runs.select("tree", "level", "idx", "kids", *_up(), F.posexplode("kids").alias("at", "kid"))
    before, after = joined(F.slice("kids", F.lit(1), F.col("at"))), joined(F.slice("kids", F.col("at") + 2, F.lit(FAN)))
    return kids.select("tree", (F.col("level") - 1).alias("level"), (F.col("idx") * FAN + F.col("at")).alias("idx"), "up_tree", "up_level", "up_idx", before.alias("before"), after.alias("after"))


def build(leaves: DataFrame) -> Manifest | None:
    """The tree over ``leaves(doc_id, lang, leaf, claim, seq)``; None if there are none."""
    order = ["lang", "doc_id", "leaf", "seq"]
    leaf = placed(leaves, order, "merkle-leaves")
    langs = stored(leaf.groupBy("lang").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-languages")
    trees = stored(placed(langs, ["lang"], "merkle-trees").withColumnRenamed("place", "tree"), "merkle-trees")
    total = trees.agg(F.count(F.lit(1)), F.max("size")).first()
    if not total[0]:
        return None
    named = broadcast_if_small(trees.withColumnRenamed("lang", "__lang"), BROADCAST_ROWS)
    leaf = leaf.join(named, F.col("lang").eqNullSafe(F.col("__lang"))).withColumn("idx", F.col("place") - F.col("first"))
    # the leaves' runs, a lone leaf as a run of its own
    member = F.struct("idx", "doc_id", "leaf", "claim")
    runs = leaf.groupBy("tree", F.col("size").alias("n"), F.shiftright("idx", 3).alias("idx")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    runs = runs.withColumn("kids", F.col("members.leaf")).withColumn("lone", F.col("n") == 1)
    runs = runs.withColumn("n", F.expr(f"(n + {FAN - 1}) div {FAN}")).withColumn("hash", F.when(F.col("lone"), F.col("kids")[0]).otherwise(_digest(F.col("kids"))))
    first = stored(runs.withColumn("level", F.lit(1)), "merkle-runs")
    own = [first, *_levels(first, -(-total[1] // FAN), "merkle-level")]
    subroot = None
    for level in own:
        done = level.filter("n = 1").select("tree", F.col("hash").alias("subroot"))
        subroot = done if subroot is None else subroot.unionByName(done)
    subroot = stored(subroot, "merkle-subroots")
    trees = stored(trees.join(subroot, "tree"), "merkle-trees")
    nodes = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(total[0]).cast("long").alias("n"), F.col("subroot").alias("hash"))
    top = _levels(nodes, total[0], "merkle-top")
    root = (top[-1] if top else nodes).select(F.hex("hash").alias("root")).first().root.lower()
    links = None
    # levels of a tree above the leaves' runs, counted from those
    for level in [*(x.withColumn("level", F.col("level") + 1) for x in own[1:]), *top]:
        links = _links(level) if links is None else links.unionByName(_links(level))
    links = _links(first.filter("false").select("tree", "level", "idx", "n", "kids")) if links is None else links
    return Manifest(first, stored(links, "merkle-links"), trees, root)


#: A node's row is met, its siblings are appended, each claimed digest is folded.
CLIMB = """
WITH RECURSIVE climb(tree, run, at_tree, at_level, at_idx, proof, folded) AS (
  SELECT tree, run, at_tree, at_level, at_idx, proof, folded FROM {start}
  UNION ALL
  SELECT c.tree, c.run, n.up_tree, n.up_level, n.up_idx, concat(c.proof, n.before, n.after),
         transform(c.folded, f -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(f)), lower(hex(n.after))), 256)))
  FROM climb c JOIN {links} n ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_idx = n.idx)
SELECT tree, run, proof, folded FROM climb WHERE at_tree = {tree} AND at_level = {level} AND at_idx = 0
"""


def climb(manifest: Manifest) -> DataFrame:
    """A row for each leaf: ``SCHEMA``; ``folded_root`` is what its claim leads to."""
    spark = manifest.runs.sparkSession
    kids = F.col("kids")
    others = lambda j: (F.slice(kids, F.lit(1), j), F.slice(kids, j + 2, F.lit(FAN)))
    fold = lambda m, j: _digest(F.concat(others(j)[0], F.array(m["claim"]), others(j)[1]))
    first = F.when(F.col("lone"), F.col("members.claim")).otherwise(F.transform("members", fold))
    start = manifest.runs.select("tree", F.col("idx").alias("run"), *(c.alias(a) for c, a in zip(_up(), ("at_tree", "at_level", "at_idx"), strict=True)), F.unhex(F.lit("")).alias("proof"), first.alias("folded"))
    n_trees = manifest.trees.count()
    top, size = 0, n_trees
    while size > 1:
        top, size = top + 1, -(-size // FAN)
    names = {"start": _view(start, "start"), "links": _view(manifest.links, "links")}
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as many rows as there are leaves
    try:
        found = stored(spark.sql(CLIMB.format(**names, tree=TOP, level=top)), "merkle-climb")
    finally:
        spark.conf.set(limit, before)
        for name in names.values():
            spark.catalog.dropTempView(name)
    runs = manifest.runs.select("tree", F.col("idx").alias("run"), "members", "kids")
    named = broadcast_if_small(manifest.trees.select("tree", "subroot"), BROADCAST_ROWS)
    rows = found.join(runs, ["tree", "run"]).join(named, "tree").select("subroot", "proof", "folded", "kids", F.posexplode("members").alias("at", "m"))
    text = lambda c: F.lower(F.hex(c))
    joined = lambda a: F.array_join(F.transform(a, text), "")
    own = others(F.col("at"))
    out = rows.select(
        F.col("m.doc_id").alias("doc_id"), text(F.col("m.leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), F.lit(manifest.root).alias("root"),
        F.sha2(F.concat(joined(own[0]), joined(own[1]), text(F.col("proof"))), 256).alias("proof_sha256"), text(F.element_at("folded", F.col("at") + 1)).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _view(df: DataFrame, name: str) -> str:
    view = f"merkle_{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    return view


def verify(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The proof of every row of ``docs``, and where it leads if its text were ``text`` (the tampered text by default)."""
    leaves = stored(claimed_leaves(docs, tampered_text() if text is None else text), "merkle-rows")
    manifest = build(leaves)
    return docs.sparkSession.createDataFrame([], SCHEMA) if manifest is None else climb(manifest)


#: The same in portable SQL; CRC-32 is computed bit by bit (fixed polynomial).
SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, text, row_number() OVER () AS rid,
    CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 3 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
hashed AS (
  SELECT doc_id, lang, rid, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claim FROM raw),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed),
lower_nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1 GROUP BY tree, pos // 8),
subroots AS (SELECT tree, level, hash FROM lower_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, hash FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY pos // 8),
nodes AS (
  SELECT l.tree, l.level, l.pos, l.hash FROM lower_nodes l
  UNION ALL SELECT -1, level, pos, hash FROM upper_nodes),
kids AS (SELECT tree, level, pos // 8 AS run, list(hash ORDER BY pos) AS hashes FROM nodes GROUP BY tree, level, pos // 8),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
climb AS (
  SELECT rid, tree AS own, tree, 0 AS level, pos, claim AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.rid, c.own, CASE WHEN c.level = h.height THEN -1 ELSE c.tree END, CASE WHEN c.level = h.height THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.level = h.height THEN c.tree ELSE c.pos // 8 END,
    CASE WHEN c.level = h.height THEN c.folded ELSE sha256(array_to_string(hashes[1:c.pos % 8], '') || c.folded || array_to_string(hashes[c.pos % 8 + 2:8], '')) END,
    CASE WHEN c.level = h.height THEN c.proof ELSE c.proof || array_to_string(hashes[1:c.pos % 8], '') || array_to_string(hashes[c.pos % 8 + 2:8], '') END
  FROM climb c JOIN heights h ON c.tree = h.tree JOIN kids k ON k.tree = c.tree AND k.level = c.level AND k.run = c.pos // 8
  WHERE NOT (c.tree = -1 AND c.level = h.height))
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.hash AS verified
FROM climb c JOIN heights h ON c.tree = -1 AND h.tree = -1 AND c.level = h.height
JOIN leaves l ON l.rid = c.rid JOIN subroots s ON s.tree = c.own JOIN upper_nodes r ON r.n = 1
"""

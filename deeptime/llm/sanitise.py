"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, payment-card numbers and
telephone numbers, found by pattern and checked. Their values are the protected
entities. From the whole corpus it is estimated how much a term tells about an
entity: with document counts, ``PMI(t; e) = ln(n(t,e) N / (n(t) n(e)))`` over
whole documents is set against the entity's information ``IC(e) = ln(N / n(e))``.
A term whose share ``PMI / IC`` reaches ``GENERALISE`` is generalised and from
``REMOVE`` on removed, wherever it stands in a document with that entity. Only
pairs seen in ``SUPPORT`` different contexts count (a context is the words
nearest to the entity), so copies of one passage flag nothing.

Terms are runs of other characters than white space, in lower case, without
ASCII punctuation at either end; those that hold an ``@``, and those without
letters that are parts of the document's own entities, are none.

Entities that stand in the same documents, with contexts that are equal in the same
ones, give the same counts with every term. They are one class, and a document counts
each of its terms once for each of its classes: a directory of thousands of
addresses that appears in several documents is one class, not thousands. Entities in
fewer documents than ``SUPPORT`` can't have the contexts and are left out first, and so are terms too
frequent for any entity of the document.

All of it runs on DataFrame functions. Offsets are code points, ends exclusive.

Defined cases: a null text counts as empty; texts without spans have zero
counts and empty span lists; runs of any number of digits, labels or spaces are
matched in time that grows with their length; rows that repeat an id are judged each; base spans
of different kinds may overlap and are all kept; an empty table gives an empty
result; columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deeptime.llm.common import ROW, broadcast_if_small, keyed, stored

#: Fixed patterns of the contract, in the order in which kinds are listed. Repeats that can't give anything back are
#: possessive, so that they run without recursion; a run is entered at its start, or where the last match ended, only,
#: so that no run is read again from each of its characters. The matches are the same as without either.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = {k: i for i, k in enumerate([*PATTERNS, "term"])}
#: Words on either side of an entity that make up its context.
CONTEXT = 10
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
BROADCAST_TERMS = 200_000


def _gate(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _holds(kind: str, hit: Column) -> Column:
    """Whether a match of the pattern is a span."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    at = lambda i: F.substr(F.reverse(digits), i.cast("int"), F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, at(i)).when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)
    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0
    return F.when(F.length(digits).between(14, 19), luhn).otherwise(False)


def _bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _tokens(gap: Column) -> Column:
    """Pieces that add up to ``gap``: each word with the white space behind it."""
    return F.regexp_extract_all(gap, F.lit(r"\s+|\S+\s*"), F.lit(0))


def _context(gap: Column, before: bool) -> Column:
    """The nearest words of a gap."""

    def near(t):
        return F.slice(t, F.greatest(F.size(t) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)) if before else F.slice(t, F.lit(1), F.lit(CONTEXT))

    return F.transform(_bind(_tokens(gap), near), lambda x: F.regexp_replace(x, r"\s+$", ""))


def _term(word: Column) -> Column:
    """A word in lower case without punctuation at its ends; empty if it is no term."""
    bare = F.regexp_replace(F.lower(word), r"^[\x00-/:-@\[-`{-\x7f]++|[\x00-/:-@\[-`{-\x7f]++$", "")
    return F.when(word.contains("@"), "").otherwise(bare)


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, hits`` of keyed documents: every one once, with its matches, gaps and contexts (stored)."""
    text = docs.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = F.col("text")
    found = text.select("row", "doc_id", "text", *(F.when(_gate(k, t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"{k}_hits") for k, p in PATTERNS.items()))
    cut = found.select("row", "doc_id", *(f"{k}_hits" for k in PATTERNS), *(F.when(F.size(f"{k}_hits") > 0, F.split(t, p, -1)).alias(f"{k}_gaps") for k, p in PATTERNS.items()))

    def hits(kind):
        gap, hit = F.col(f"{kind}_gaps"), F.col(f"{kind}_hits")
        each = F.transform(
            F.sequence(F.lit(1), F.size(hit)),
            lambda i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.length(F.element_at(gap, i)).alias("gap"),
                F.element_at(hit, i).alias("hit"),
                F.xxhash64(_context(F.element_at(gap, i), True), _context(F.element_at(gap, i + 1), False)).alias("sign"),
            ),
        )
        empty = F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string,sign:bigint>>")
        return F.when(F.size(hit) > 0, each).otherwise(empty)

    return stored(cut.select("row", "doc_id", F.concat(*map(hits, PATTERNS)).alias("hits")), "pii-scan")


def base_spans(scanned: DataFrame) -> DataFrame:
    """``row, kind, start, end, hit, sign`` of the matches that hold."""
    each = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(w)
    placed = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("hit"))
    holds = F.lit(False)
    for kind in PATTERNS:
        holds = F.when(F.col("kind") == kind, _holds(kind, F.col("hit"))).otherwise(holds)
    return placed.filter(holds).select("row", "kind", "start", "end", "hit", "sign")


def _least_share(n_te: Column, n_t: Column, n_e: Column, n: Column) -> Column:
    """``PMI / IC``; 0 where the entity is in every document."""
    pmi, ic = F.log(n_te * n / (n_t * n_e)), F.log(n / n_e)
    return F.when(ic > 0, pmi / ic).otherwise(0.0)


def classes(mention: DataFrame) -> DataFrame:
    """``row, class, sign, n_e`` (stored): the entities that can have the contexts, by classes of equal documents and contexts.

    ``sign`` numbers the documents of a class by equal contexts (the least row of each). A class
    is known by a sum over its rows of 2 x 64 bits, so no entity's documents are gathered.
    """
    seen = stored(mention.groupBy("entity", "row").agg(F.min("sign").alias("sign")), "entity-documents")
    alike = stored(seen.groupBy("entity", "sign").agg(F.min("row").alias("least")), "entity-contexts")
    able = stored(alike.groupBy("entity").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= SUPPORT).select("entity"), "entities")
    each = stored(seen.join(broadcast_if_small(able, BROADCAST_TERMS), "entity").join(alike, ["entity", "sign"]).select("entity", "row", F.xxhash64("least").alias("sign")), "entity-rows")
    sums = [F.sum(F.xxhash64(F.lit(k), "row", "sign").cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    known = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.min("row").alias("at"), *sums)
    known = stored(known.select("entity", "n_e", F.sha2(F.concat_ws(",", F.hex("at"), "n_e", "h1", "h2").cast("binary"), 256).alias("class")), "entity-classes")
    first = stored(known.groupBy("class").agg(F.min("entity").alias("entity"), F.first("n_e").alias("n_e")), "first-entities")
    return stored(each.join(broadcast_if_small(first, BROADCAST_TERMS), "entity").select("row", "class", "sign", "n_e"), "known-classes")


def disclosing_terms(docs: DataFrame, spans: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """``(class, term, share)`` at or over ``GENERALISE`` (stored), and ``(row, class)`` of the classes of entities with enough contexts."""
    n = F.lit(float(max(n_docs, 2)))
    mention = stored(spans.select("row", F.concat_ws(":", "kind", F.lower("hit")).alias("entity"), "sign", "hit"), "mentions")
    known = classes(mention)
    # at the threshold a term is in this many documents at most
    most = F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - GENERALISE))
    bound = stored(known.groupBy("row").agg(F.max(most).alias("most")), "entity-bounds")
    texts = docs.select(ROW, "text").join(broadcast_if_small(bound.select(F.col("row").alias("__deeptime_at")), BROADCAST_TERMS), F.col(ROW) == F.col("__deeptime_at"))
    each = texts.select(F.col("__deeptime_at").alias("row"), F.explode(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+", -1), _term))).alias("term")).filter("term <> ''")
    parts = mention.select("row", F.explode(F.split("hit", r"\s+", -1)).alias("part")).select("row", _term(F.col("part")).alias("term")).filter(~F.col("term").rlike("[a-z]|[^\\x00-\\x7f]")).distinct()
    each = stored(each.join(parts, ["row", "term"], "left_anti"), "entity-terms")
    # a term is in as many documents at least as it is with entities; most terms fail by that alone
    least = stored(each.groupBy("term").agg(F.count(F.lit(1)).alias("least")).filter(F.col("least") >= SUPPORT), "least-documents")
    able = each.join(least, "term").join(bound, "row").filter(F.col("least") <= F.col("most") + 1e-6)
    by_context = able.join(known, "row").groupBy("class", "term", "sign").agg(F.count(F.lit(1)).alias("n"), F.first("n_e").alias("n_e"), F.first("least").alias("least"))
    together = by_context.groupBy("class", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n_te"), F.first("n_e").alias("n_e"), F.first("least").alias("least"))
    c = F.col
    possible = stored(together.filter((c("contexts") >= SUPPORT) & (_least_share(c("n_te"), c("least"), c("n_e"), n) >= GENERALISE)), "possible")
    wanted = stored(possible.select("term").distinct(), "candidate-terms")
    words_of = docs.select(F.explode(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+", -1), _term))).alias("term")) if not wanted.isEmpty() else wanted
    n_t = stored(words_of.join(broadcast_if_small(wanted, BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "term-documents")
    share = _least_share(c("n_te"), c("n_t"), c("n_e"), n)
    return stored(possible.join(n_t, "term").select("class", "term", share.alias("share")).filter(c("share") >= GENERALISE), "disclosing"), known


def term_places(docs: DataFrame, flagged: DataFrame, known: DataFrame) -> DataFrame:
    """``row, start, end, share`` of every flagged term in the documents that hold its entity."""
    sites = stored(known.select("row", "class").join(flagged, "class").groupBy("row", "term").agg(F.max("share").alias("share")), "term-sites")
    rows = stored(sites.select(F.col("row").alias("__deeptime_at")).distinct(), "term-rows")
    texts = docs.select(ROW, "text").join(broadcast_if_small(rows, BROADCAST_TERMS), F.col(ROW) == F.col("__deeptime_at"))
    pieces = texts.select(F.col("__deeptime_at").alias("row"), F.posexplode(_tokens(F.coalesce("text", F.lit("")))).alias("pos", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece")
    word = F.regexp_replace("piece", r"\s+$", "")
    placed = pieces.select("row", before.alias("start"), (before + F.length(word)).alias("end"), _term(word).alias("term")).filter("term <> ''")
    return placed.join(sites, ["row", "term"]).select("row", "start", "end", "share")


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents ``(row, doc_id, hits)`` and all spans ``(row, kind, start, end, action)``."""
    return _find(keyed(docs))


def _find(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    scanned = scan(given)
    base = stored(base_spans(scanned), "base-spans")
    terms = term_places(given, *disclosing_terms(given, base, scanned.count()))
    action = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    every = base.select("row", "kind", "start", "end", F.lit("generalise").alias("action")).unionByName(terms.select("row", F.lit("term").alias("kind"), "start", "end", action.alias("action")))
    return scanned, every


def span_lists(scanned: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, counts, digest of the base spans, all spans joined."""
    rank = F.create_map(*(F.lit(x) for k, i in ORDER.items() for x in (k, i)))
    grouped = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("s"))
    joined = scanned.select("row", "doc_id").join(grouped, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return joined.select("doc_id", *map(count, PATTERNS), F.sha2(text(F.filter("s", lambda x: x["kind"] != "term")).cast("binary"), 256).alias("base_sha256"), text(F.col("s")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id, clean_text``: spans are replaced by ``<kind>`` or, for terms over ``REMOVE``, by nothing.

    Overlapping spans are covered once, under the kind of the first.
    """
    given = keyed(docs)
    _, spans = _find(given)
    rank = F.create_map(*(F.lit(x) for k, i in ORDER.items() for x in (k, i)))
    grouped = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind", "action"))).alias("s"))
    lists = stored(grouped.select(F.col("row").alias("__deeptime_id"), "s"), "span-lists")
    text = F.coalesce("text", F.lit(""))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        mark = F.when(x["action"] == "remove", "").otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
        before = F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        return F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(before, mark)).alias("out"))
        )

    done = F.aggregate("s", state, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"), F.length(text))))
    return given.join(lists, F.col(ROW) == F.col("__deeptime_id"), "left").select("doc_id", F.when(F.col("s").isNull(), text).otherwise(done).alias("clean_text"))

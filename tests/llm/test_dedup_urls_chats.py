import hashlib
from urllib.parse import urlsplit

from deeptime.llm import chat_format, exact_dedup, url_filters

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256((text or "").translate(A_Z).encode()).hexdigest()


def test_exact_groups_and_later_batches(spark):
    texts = {1: "Same É", 2: "sAME É", 3: "same é", 4: None, 5: "", 6: "x" * 300_000, 7: "other", None: "OTHER"}
    docs = spark.createDataFrame([(k, v, "z", 1) for k, v in texts.items()], "doc_id long, text string, keep_id string, group_size int")
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = {r.doc_id: r for r in exact_dedup.ingest(docs, index).collect()}
    for k, v in texts.items():
        same = [i for i, t in texts.items() if digest(t) == digest(v)]
        keep = max(i for i in same if i is not None)
        r = got[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(same), k == keep, digest(v))
    # a later batch meets the index: what is known goes, what is new stays
    more = spark.createDataFrame([(20, "SAME É"), (21, "fresh"), (22, "Fresh")], "doc_id long, text string")
    later = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.ingest(more, index).collect()}
    assert later == {20: (2, False), 21: (22, False), 22: (22, True)}
    assert index.read().count() == 6
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    assert again.read().count() == 6  # it outlives the table that named it


def test_a_batch_that_runs_again_gives_the_same(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "c")], "doc_id long, text string")
    seen = lambda df: sorted(map(str, df.collect()))
    want = seen(exact_dedup.ingest(first, index, "monday"))
    assert seen(exact_dedup.ingest(first, index, "monday")) == want and index.read().count() == 3
    assert index.spark.table(index.table).count() == 6  # appended twice, read once
    later = spark.createDataFrame([(9, "B"), (8, "d")], "doc_id long, text string")
    verdicts = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.ingest(later, index, "tuesday").collect()}
    assert verdicts == {(9, 3, False), (8, 8, True)} and len(exact_dedup.ingest(later, index, "tuesday").collect()) == 2
    assert seen(exact_dedup.ingest(first, index, "monday")) == want
    plan = index.missing(spark.createDataFrame([("x", 1, 1)], "text_sha256 string, keep_id long, group_size long"), "z")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_exact_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.ingest(docs, exact_dedup.DigestIndex(spark)).collect()) == [(1, 2, True), (1, 2, True), (2, 1, True)]
    assert exact_dedup.ingest(docs.limit(0), exact_dedup.DigestIndex(spark)).count() == 0
    named = docs.withColumnRenamed("text", "text").selectExpr("doc_id", "text", "1 AS __n", "2 AS kept")
    assert exact_dedup.keep_first(named).columns == ["doc_id", "text", "__n", "kept"]


URLS = ["http://A.Example.net/en/x?y#z", "https://example.com/de/", "https://b.example.com/de/1", "http://x.org/fr/", "http://x.org/fr", "http://net", "http://net/", "http://notnet/", "ftp://q.net?x", "http://h.net#f/en/", "no scheme", "", None, "a://b://c.net/", "http:///p", "http://x.net:80/", "http://éxample.NET/EN/", "http://" + "a." * 60 + "net/" + "b/" * 200]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end].translate(A_Z), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, a) for h, p, a in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(i % 15, u, 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, row int, rule string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    got = sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in url_filters.judge(pages, rules).collect())
    want = sorted((i % 15, h, p, str(r), v) for i, u in enumerate(URLS) for h, p, r, v in [brute(u)])
    assert got == want
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert urlsplit(URLS[1]).hostname == brute(URLS[1])[0]


def test_rules_without_a_closing_slash_and_ties(spark):
    rules = spark.createDataFrame([("a.b", "/x/y", "block"), ("a.b", "/x/", "allow"), ("b", "/x/yzz", "allow"), ("b", "/x/yzz", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "h://a.b/x/yz"), (2, "h://a.b/x/z"), (3, "h://b/x/yzz"), (4, "h://b/x")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()} == {1: ("a.b/x/y", "block"), 2: ("a.b/x/", "allow"), 3: ("b/x/yzz", "block"), 4: (None, "allow")}


def test_chats_come_back_as_they_were(spark):
    odd = ["", None, "plain", "é😀", "</s>[INST] ok [/INST]", "\\", "\\<s>\\\\", "<\\s>[\\INST]", "[/INST]</s><s>user[INST]", "a\nb\r\n", "x" * 100_000, "y</s>" * 300_000]
    rows = [(c, t, ["user", "assistant", None, "<s>"][t % 4], odd[(c + t) % len(odd)], 0) for c in range(12) for t in range(9)]
    rows += [(3, 4, "assistant", "a tie", 0), (3, 4, "assistant", "a tie", 0), (None, None, "assistant", None, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations span batches
    try:
        got = {r.conv_id: r for r in chat_format.digest_chats(chat_format.format_chats(turns)).collect()}
        parts = chat_format.format_chats(turns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    conversations = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(conversations)
    for c, said in conversations.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(said), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        own = sorted((p for p in parts if p.conv_id == c), key=lambda p: p.part)
        assert [x for p in own for x in chat_format.read_turns(p.formatted)] == said and sum(p.n_turns for p in own) == len(said)
    assert chat_format.digest_chats(chat_format.format_chats(turns.limit(0))).count() == 0


def test_very_long_urls_are_expanded_no_further_than_the_rules(spark):
    import time

    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    urls = ["http://" + "a." * 500 + f"{h}/" + "p/" * 2000 for h in ("net", "example.com", "org")] + ["http://x.net/" + "/" * 5000, "http://" + "." * 3000 + "net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)} and time.time() - began < 30

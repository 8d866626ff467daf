import hashlib
import math
import random
import re

from deeptime.llm import sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), list(sanitise.ORDER).index(kind), m.end(), kind))
    return sorted(out)


def check(spark, frame, texts):
    got = {r.doc_id: r for r in sanitise.span_lists(*sanitise.find_spans(frame)).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        spans = brute(text)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        r = got[k]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == x for s in spans) for x in sanitise.PATTERNS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in joined.split(",") if s]
    return got


def test_base_spans_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check(spark, docs, {r.doc_id: r.text for r in docs.collect()})


def test_edges(spark):
    texts = dict(enumerate([
        None, "", "a@b.c", "é😀 x.y@z-1.co.uk, x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 0001.2.3.004", "99999999999999999999.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1112 +1 (724) 555-7058", "+12345678901234567890", "card 4337166598464399x 4041894974608795", "+1+1 (724) 555-7058 a@b.c@d.e",
        "4111 1111  1111 1111", "0 0 0 0 0 0 0 0 0 0 0 0 0 0", "١.2.3.4 \n\t+49 (0) 30.123-4567\n", "z " * 5000 + "a@b.cc",
    ]))
    check(spark, spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, kind string"), texts)
    assert sanitise.span_lists(*sanitise.find_spans(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_long_runs_equal_brute_force(spark):
    n = 6000
    parts = ["1" * n, "a@b" + ".c" * n, "1 " * n, "a" * n + "@", "1." * n, "+1" + " " * n + "x", "+1" + " 2" * n, "@" + "a" * n + "@b.c", "+1" * n, "a@" * n, "a@b." * n, "1-" * n + "x", "a@b.c%x@d.e f"]
    texts = dict(enumerate([*parts, " ".join(parts), "".join(parts)]))
    check(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


def test_very_long_runs(spark):
    n = 100_000
    texts = ["7" * n, "a@b" + ".c" * (n // 2), "1 " * n, "a" * n, "9." * n, "w@" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sanitise.span_lists(*sanitise.find_spans(docs)).collect()}
    spans = [f"ip:{8 * k}:{8 * k + 7}" for k in range(n // 4)]
    assert got == {0: "", 1: f"email:0:{n + 3}", 2: "", 3: "", 4: ",".join(spans), 5: ""}


def test_disclosing_terms(spark):
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(i, f"{filler[i % 7]} {filler[i % 5]} Zorblax, the writes {filler[i % 3]} from zorb@mail.example.com {filler[(i + 1) % 7]} the") for i in range(6)]
    rows += [(100 + i, f"{filler[i % 7]} the {filler[i % 5]} {filler[i % 3]}") for i in range(200)]
    rows += [(900 + i, "copies say Quux at quux@mail.example.com here") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sanitise.span_lists(*sanitise.find_spans(docs)).collect()}
    for i, text in rows[:6]:
        at = text.index("Zorblax,")
        assert f"term:{at}:{at + 8}" in got[i].split(",")
        assert got[i].count("term:") <= 3  # the entity's own rare words, not the common ones
    assert not any(got[100 + i] for i in range(200))
    assert all("term" not in got[900 + i] for i in range(9))
    clean = {r.doc_id: r.clean_text for r in sanitise.sanitise(docs).collect()}
    assert "Zorblax" not in clean[0] and "<email>" in clean[0] and "zorb@" not in clean[0]
    assert clean[100] == rows[6][1]


PUNCTUATION = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def term_of(word):
    return "" if "@" in word else word.lower().strip(PUNCTUATION)


def brute_terms(docs):
    """Term spans of each document, from the definition."""
    found = {i: brute(t) for i, t in docs.items()}
    mentions = []  # document, entity, context
    for i, t in docs.items():
        for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
            hits = list(pattern.finditer(t))
            for k, m in enumerate(hits):
                if (m.start(), list(sanitise.ORDER).index(kind), m.end(), kind) in found[i]:
                    before = t[hits[k - 1].end() if k else 0 : m.start()].split()[-sanitise.CONTEXT :]
                    after = t[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(t)].split()[: sanitise.CONTEXT]
                    mentions.append((i, f"{kind}:{m[0].lower()}", (tuple(before), tuple(after))))
    where = {}
    for i, e, c in mentions:
        where.setdefault(e, {}).setdefault(i, set()).add(c)
    terms = {i: {term_of(w) for w in t.split()} - {""} for i, t in docs.items()}
    n, out = len(docs), {i: set() for i in docs}
    for e, rows in where.items():
        if len(set().union(*rows.values())) < sanitise.SUPPORT or len(rows) == n:
            continue
        for t in set().union(*(terms[i] for i in rows)):
            both = [i for i in rows if t in terms[i] and not (t in {term_of(p) for s in found[i] for p in docs[i][s[0] : s[2]].split()} and not re.search("[a-z]|[^\\x00-\\x7f]", t))]
            n_t = sum(t in x for x in terms.values())
            if len(both) >= sanitise.SUPPORT and math.log(len(both) * n / (n_t * len(rows))) / math.log(n / len(rows)) >= sanitise.GENERALISE:
                for i in both:
                    out[i] |= {(m.start(), m.end()) for m in re.finditer(r"\S+", docs[i]) if term_of(m[0]) == t}
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(11)
    filler = [f"w{k}" for k in range(40)]
    people = [("jo-ann", "acct-77", "joann@mail.example.com"), ("quill", "id.9", "4111 1111 1111 1111"), ("vex", "77-1", "+1 (724) 555-7058"), ("Ähm", "zed", "10.1.2.3")]
    docs = {}
    for i in range(160):
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 60))]
        for who, mark, value in people:
            if rng.random() < 0.08:
                words.insert(rng.randrange(len(words)), f"({value}),")
                if rng.random() < 0.9:
                    words.insert(rng.randrange(len(words)), f"{who.title()}!")
                if rng.random() < 0.6:
                    words.insert(rng.randrange(len(words)), mark)
            elif rng.random() < 0.004:
                words.append(who)
        docs[i] = " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")} for r in sanitise.span_lists(*sanitise.find_spans(frame)).collect()}
    want = brute_terms(docs)
    assert got == want and sum(map(len, want.values())) > 20


def test_directories_of_many_entities_take_seconds(spark):
    """Entities of the same documents are counted as one; each word that only the directories hold gives them away."""
    rng, people = random.Random(3), [f"user{k}@mail.example.com" for k in range(1600)]
    docs = {}
    for i in range(3):
        rng.shuffle(people)
        docs[i] = " ".join(f"entry {word} {p}" for word, p in zip((f"only{k}" for k in range(1600)), people))
    docs |= {10 + i: f"entry {i} plain words" for i in range(200)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    given = sanitise.keyed(frame)
    scanned = sanitise.scan(given)
    base = sanitise.stored(sanitise.base_spans(scanned), "t")
    flagged, known = sanitise.disclosing_terms(given, base, scanned.count())
    assert known.count() == 3 and known.select("class").distinct().count() == 1
    assert flagged.count() == 1600  # "entry" is everywhere
    got = {r.doc_id: r.spans.count("term:") for r in sanitise.span_lists(*sanitise.find_spans(frame)).collect()}
    assert all(got[i] == (1600 if i < 3 else 0) for i in docs)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.c here", "x", 1)], "doc_id long, text string, row string, s int").selectExpr("*", "1 AS spans", "2 AS class", "3 AS term", "4 AS n_email")
    assert sanitise.span_lists(*sanitise.find_spans(docs)).select("doc_id", "n_email", "spans").collect() == [(1, 1, "email:0:5")]

import corpus_pipeline
from deeptime.llm import decontaminate, language_id, packing
from tests.llm.test_near_copies import brute

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    import re

    words = [w for w in re.split(r"[\x00-/:-`{-\x7f]+", (text or "").lower()) if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language_id.train(docs)
    known = {r.doc_id for r in language_id.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in known}
    last = {}
    for i in sorted(texts):
        last[texts[i].encode().lower()] = i
    left = sorted(last.values())
    left = brute([(i, texts[i]) for i in left])
    sets = [s for s in map(shingles, items) if s]
    left = [i for i in left if not any(len(s & shingles(texts[i])) >= 0.8 * len(s) for s in sets)]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert rows[0].asDict().keys() == {c.split()[0] for c in packing.SEQUENCES_SCHEMA.split(", ")}


def test_stages_keep_columns_and_bear_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for given in (docs.limit(0), docs.limit(20)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, given, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_items_found_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one two three"), (-1, "a b c d e f"), (None, "b c d e f y"), (-1, " ".join(f"q{i}" for i in range(200)))], "item_id long, text string")
    more = spark.createDataFrame([(-5, None), (-6, "A, b; c. D e f!"), (-6, "nothing of it here at all"), (None, "x a b c d e f y"), (-7, " ".join(f"q{i}" for i in range(163))), (-8, " ".join(f"q{i}" for i in range(150))), (-5, "a b c d e f y")], "doc_id long, text string")
    docs, items = docs.select("doc_id", "text").unionByName(more), items.select("item_id", "text").unionByName(odd)
    docs = docs.selectExpr("doc_id", "text", "1 AS item", "2 AS w", "3 AS h", "4 AS needed")
    want = []
    for d in docs.collect():
        own = shingles(d.text)
        for i in items.collect():
            s = shingles(i.text)
            if s and len(s & own) >= 0.8 * len(s):
                want.append((str(d.doc_id), str(i.item_id), len(s), len(s & own)))
    got = [(str(r.doc_id), str(r.item_id), r.n_shingles, r.n_found) for r in decontaminate.find_leaks(docs, items).collect()]
    assert sorted(got) == sorted(want) and len(want) > 2
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0

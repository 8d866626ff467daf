import random
import tempfile

from deeptime.sources import search_index as SI

WORDS = ["order", "orbit", "lot", "customer", "cut", "war", "of", "x", "77", "771"]


def brute(entities, query, top):
    wanted = [w for w in query.lower().split() if len(w) >= 2]
    hits = [(-i, s) for s, i in entities if wanted and all(any(h.startswith(w) for h in s.split("-")) for w in wanted)]
    return [s for _, s in sorted(hits)[:top]]


def test_search_equals_brute_force_over_all_bands(spark, monkeypatch):
    rng = random.Random(6)
    entities = list({"-".join([*rng.choices(WORDS, k=rng.randrange(1, 4)), str(k)]): rng.randrange(9) / 8 for k in range(400)}.items())
    queries = ["or", "order", "cus war", "77", "of lot", "x", "", "zzz", "cut 7", "ord 39"]
    frame = spark.createDataFrame(entities, "slug string, importance double")
    ask = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for bands, named in (((64, 4096), 200), ((3, 20), 2)):
        monkeypatch.setattr(SI, "BANDS", bands)
        monkeypatch.setattr(SI, "NAMED", named)
        path = tempfile.mkdtemp(prefix="spark-") + "/index"
        SI.write(frame, path)
        got = {}
        for r in SI.search(spark, path, ask, top=5).orderBy("query_id", "pos").collect():
            got.setdefault(r.query_id, []).append(r.slug)
        assert got == {k: w for k, q in enumerate(queries) if (w := brute(entities, q, 5))}


def test_a_search_reads_the_shards_and_row_groups_of_its_queries_only(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    SI.write(spark.createDataFrame([(f"{w}-{k}", k / 50) for k in range(50) for w in WORDS], "slug string, importance double"), path)
    ask = SI.asked(spark.createDataFrame([(1, "order"), (2, "lot 4")], "query_id int, query string"))
    joined = SI.entries_for(SI.read(spark, path), ask, 0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "(band" in plan.split("PartitionFilters")[1] and "In(start" in plan
    assert {r.shard for r in joined.select("shard").distinct().collect()} == {"o", "l"}

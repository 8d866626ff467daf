import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from deeptime.sources import model_io as IO
from deeptime.streaming import ingest as ST


def record(i, **more):
    return json.dumps({"id": i, "type": "event", "name": f"Name {i}", "t0": {"y": 1900}, "precision": "year", "status": "observed", "categories": ["war", "life"], "importance": 0.5} | more)


def drain(spark, base, **more):
    ST.ingest_records(spark, f"file://{base}/in", f"file://{base}/model", f"file://{base}/state", **more).awaitTermination()


def test_records_reach_the_model_and_a_repeated_id_ends_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    claim = {"property": "mass", "value": 1.0, "unit": "kg", "value_type": "measured", "source": "s", "published_at": "2000"}
    (tmp_path / "in/a.ndjson").write_text("\n".join(["# head", record("a", rel=[{"type": "part_of", "target": "b"}], props=[claim]), "", "{broken", record("b"), record("c", importance=2)]))
    drain(spark, tmp_path)
    (tmp_path / "in/b.ndjson").write_text(record("d", t1="1999-01-01", point=[1.5, 2.5]))
    drain(spark, tmp_path)
    m = ST.streamed_model(spark, f"file://{tmp_path}/model")
    assert [(r.input_order, r.seed_id, r.file, r.line) for r in m["entity"].orderBy("input_order").collect()] == [(0, "a", "a.ndjson", 2), (1, "b", "a.ndjson", 5), (2, "d", "b.ndjson", 1)]
    assert m["entity_category"].count() == 6 and m["relationship"].collect() == [("a", 0, "part_of", "b")] and m["claim"].first().property == "mass"
    assert IO.model_faults(**m).count() == 0
    rejects = spark.read.parquet(f"file://{tmp_path}/model/rejects")
    assert sorted((r.line, r.reason) for r in rejects.collect()) == [(4, "invalid JSON"), (6, "importance outside (0,1]")]
    (tmp_path / "in/c.ndjson").write_text("\n".join([record("e"), record("b")]))
    for _ in range(2):  # and again when it is started again
        with pytest.raises(StreamingQueryException, match="arrived before: b"):
            drain(spark, tmp_path)
    assert ST.streamed_model(spark, f"file://{tmp_path}/model")["entity"].count() == 3
    drain(spark, tmp_path, fatal=False)
    assert ST.streamed_model(spark, f"file://{tmp_path}/model")["entity"].count() == 4


def test_small_files_are_one_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(9):
        (tmp_path / f"in/{k}.ndjson").write_text(record(f"r{k}"))
    drain(spark, tmp_path)
    assert [p.name for p in (tmp_path / "model/entity").glob("batch=*")] == ["batch=0"]
    assert [(r.input_order, r.seed_id) for r in ST.streamed_model(spark, f"file://{tmp_path}/model")["entity"].orderBy("input_order").collect()] == [(k, f"r{k}") for k in range(9)]

def test_a_batch_reads_the_buckets_of_its_ids_only(spark, tmp_path):
    ids = ST._with_bucket(spark.range(500).selectExpr("CAST(id AS STRING) AS id"), "id")
    for n in (0, 1, 1):  # the second runs twice
        ST.store_ids(ids.filter(F.col("id") % 2 == n), f"file://{tmp_path}/ids", n, "id")
    assert spark.read.parquet(f"file://{tmp_path}/ids").count() == 500
    mine = ids.filter("id = '7'")
    known = ST.known_ids(spark, f"file://{tmp_path}/ids", 2, mine, "id")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert mine.join(known, "id").count() == 1 and mine.join(ST.known_ids(spark, f"file://{tmp_path}/ids", 1, mine, "id"), "id").count() == 0


def test_live_parts_hold_each_batch_once():
    for fan in (2, 3, 8):
        for n in range(1, 200):
            parts = ST.live_parts(n, fan)
            held = sorted(b for level, k in parts for b in range(k * fan**level, (k + 1) * fan**level))
            assert held == list(range(n)) and len(parts) <= (fan - 1) * (1 + len(bin(n)))


def test_sums_after_any_number_of_drains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "FAN", 2)
    total = {}
    for n in range(5):
        rows = [(f"k{i % 3}", i + n) for i in range(4)]
        for k, v in rows:
            total[k] = (total.get(k, (0, 0))[0] + 1, total.get(k, (0, 0))[1] + v)
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        count = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
        ST.keep_sums(spark, f"file://{tmp_path}/in", "k string, v long", f"file://{tmp_path}/sums", f"file://{tmp_path}/state", count, ["k"]).awaitTermination()
        assert {r.k: (r.n, r.v) for r in ST.sums(spark, f"file://{tmp_path}/sums", ["k"]).collect()} == total

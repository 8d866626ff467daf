import re
import tempfile

import pytest

from deeptime.sources import model_io as IO


def documents(spark, **bodies):
    return spark.createDataFrame([(k, v) for k, v in bodies.items()], "key string, body string")


def seen(spark, root):
    return {r.key: r.body for r in IO.published(spark, root).collect()}


def test_a_job_that_dies_before_the_pointer_is_in_nobodys_way(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-") + "/out"
    IO.publish(documents(spark, a="1", b="2"), root)
    with monkeypatch.context() as m:
        m.setattr(IO, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            IO.publish(documents(spark, a="3"), root)
    assert seen(spark, root) == {"a": "1", "b": "2"}
    plan = {r.key: r.status for r in IO.publish(documents(spark, a="4", b="2"), root).collect()}
    assert plan == {"a": "written", "b": "unchanged"} and seen(spark, root) == {"a": "4", "b": "2"}


def test_repeated_and_null_keys_are_refused(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/out"
    IO.publish(documents(spark, a="1"), root)
    for rows in ([("k", "1"), ("k", "2")], [(None, "1")]):
        with pytest.raises(ValueError, match="repeated or null"):
            IO.publish(spark.createDataFrame(rows, "key string, body string"), root)
    assert seen(spark, root) == {"a": "1"}


def test_many_versions_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(IO, "MOST_VERSIONS", 2)
    root = tempfile.mkdtemp(prefix="spark-") + "/out"
    for n in range(4):
        IO.publish(documents(spark, **{"a": "same"}, **{f"k{i}": str(i) for i in range(n)}), root)
        now = IO.pointer(spark, root)
        assert IO.index(spark, root, now.version).select("version").distinct().count() <= 2
        assert seen(spark, root) == {"a": "same"} | {f"k{i}": str(i) for i in range(n)}


def test_of_two_writers_one_is_told(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/out"
    IO.publish(documents(spark, a="1"), root)
    IO._point(spark, root, 7, "b", "theirs")
    IO._point(spark, root, 7, "a", "mine")
    assert IO.pointer(spark, root).version == "a"
    with pytest.raises(RuntimeError, match="meanwhile"):
        IO._point(spark, root, 7, "c", "late")


def test_views_pinned_to_another_seed_bar_the_release(spark):
    views = spark.createDataFrame([("v", "T3", 5.0, "war", ["a"], ["b"], 1, 2)], "name string, bucket_id string, year double, category string, include array<string>, exclude array<string>, min_items int, max_items int")
    chunks = spark.createDataFrame([(3, -1, "war", "a")], "bucket int, win long, category string, slug string")
    assert IO.release_gate(views, "seed-1", "seed-2", chunks).collect() == [("goldens", "pinned to seed-1 but the seed is seed-2")]
    assert IO.release_gate(views, "s", "s", chunks).collect() == []
    assert {r.fault for r in IO.release_gate(views.withColumn("year", views.year * 0 + 1e8), "s", "s", chunks).collect()} == {"no chunk"}


def test_bucketized_rows_are_not_written_as_a_model(spark):
    rows = spark.createDataFrame([(1, 2)], "input_order int, bucket_min int")
    with pytest.raises(ValueError, match="bucketized"):
        IO.write_model("/nowhere", entity=rows)


def test_rows_out_of_order_are_found_across_blocks_of_a_file(spark, tmp_path):
    path, limit = f"file://{tmp_path}/table", "spark.sql.files.maxPartitionBytes"
    rows = spark.range(30000).selectExpr("CAST(CASE WHEN id % 7000 = 6999 THEN id - 10 ELSE id END AS LONG) AS k", "sha2(CAST(id AS STRING), 256) AS x").coalesce(1)
    rows.write.option("parquet.block.size", 1 << 18).option("parquet.block.size.row.check.min", "100").option("parquet.page.size.row.check.min", "100").parquet(path)
    before = spark.conf.get(limit)
    spark.conf.set(limit, "256k")
    try:
        assert spark.read.parquet(path).select("_metadata.file_block_start").distinct().count() > 1
        found = IO.out_of_order(spark, path, ["k"])
        assert sorted(r.at for r in found.collect()) == [6999, 13999, 20999, 27999]
        # no window takes a whole file's rows
        plan = found._jdf.queryExecution().analyzed().toString()
        assert re.search(r"lag\(key[^\n]*\[file#\d+, _block#\d+L?\]", plan)
    finally:
        spark.conf.set(limit, before)

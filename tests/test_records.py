import os

from pyspark.sql import functions as F

from deeptime.sources import records as R


def test_lines_are_numbered_across_blocks_without_a_shuffle(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name} {k} {'x' * (k % 50)}" for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = R.numbered_lines(spark, f"file://{tmp_path}")
        rows = lines.select("file", "line", F.split("value", " ")[1].cast("int").alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 404 and all(r.line == r.k for r in rows)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_lines_are_parsed_once_with_their_fault(spark):
    lines = spark.createDataFrame([("f", 1, '{"id": "a"}'), ("f", 2, "{bro"), ("f", 3, "# note"), ("f", 4, ""), ("f", 5, "[1]")], "file string, line long, value string")
    rows = R.normalized(R.parsed_lines(lines, comments=True))
    assert [(r.line, r.fault, r.seed_id) for r in rows.orderBy("line").collect()] == [(1, None, "a"), (2, "invalid JSON", None), (5, "invalid JSON", None)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_many_small_files_need_few_folders_and_no_commit_each(spark, tmp_path, monkeypatch):
    """Each row is a file of its own name; a file system that Arrow does not know gets a folder for each name from Spark's writer."""
    rows = spark.range(300).selectExpr("id % 4 AS folder", "concat(1000 + id, '.geojson') AS name", "concat('{\"type\":\"x', id, '\"}') AS value")
    want = {(f"{1000 + k}.geojson", f'{{"type":"x{k}"}}') for k in range(300)}
    name = F.regexp_extract("_metadata.file_path", r"([0-9]+\.geojson)", 1)
    path = f"file://{tmp_path}/files"
    R.write_files(rows, path)
    R.write_files(rows, path)  # as a task that runs again
    assert sorted(os.listdir(tmp_path / "files")) == [f"folder={k}" for k in range(4)]
    assert {(r.name, r.value) for r in spark.read.text(path).select(name.alias("name"), "value").collect()} == want
    monkeypatch.setattr(R, "arrow_knows", lambda path: False)
    other = f"file://{tmp_path}/other"
    R.write_files(rows, other)
    assert {(r.name, r.value) for r in spark.read.text(other).select(name.alias("name"), "value").collect()} == want

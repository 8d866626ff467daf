"""Work that must lie with all tasks, and rows that must be shuffled once only."""

import random

from pyspark.sql import functions as F

from deeptime.operators import model as M
from deeptime.plans import history as PH
from deeptime.sources import dump as S

SF = "/root/testdata/sf0.001"


def test_the_dump_is_written_in_pieces_for_all_tasks(spark):
    """A small source is one task's read; its dump, whose claims are parsed again and again, is not."""
    dump = PH.parsed(spark, SF, True)
    sizes = [r.n for r in dump.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4


def test_facts_without_classes_are_the_same_facts(spark):
    dump = PH.parsed(spark, SF, True)
    plain = ["id", "label", "links", "article", "lon", "lat"]
    whole, bare = S.facts(dump), S.facts(dump, False, S.point_claims(dump))
    assert bare.columns == plain
    assert sorted(map(str, whole.select(plain).collect())) == sorted(map(str, bare.collect()))


def test_rows_are_ranked_with_one_shuffle(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(50), k) for k in range(2000)]
    ranked = M.ranked_within(spark.createDataFrame(rows, "g string, x int, k int"), "g", [F.desc("x"), F.asc("k")])
    assert "hashpartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = {g: [k for _, _, k in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))] for g in "ab"}
    got = {g: [r.k for r in sorted((r for r in ranked.collect() if r.g == g), key=lambda r: r.pos)] for g in "ab"}
    assert got == want and ranked.filter("pos = 1").count() == 2

import tempfile

import pytest
from pyspark.sql import functions as F

from deeptime.sources import digest_tree as DT


def tree(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-") + "/tree"
    DT.write(spark.createDataFrame(rows, "k long, v string").repartition(3), F.col("k"), 10, path)
    return path


def test_versions_and_their_differences(spark):
    rows = [(k, f"v{k}") for k in range(-60, 5000, 3)]
    one, same = tree(spark, rows), tree(spark, rows[::-1])
    assert DT.version(spark, one) == DT.version(spark, same) and DT.changed_ranges(spark, one, same, 10).count() == 0
    other = [(k, "new" if k == 300 else v) for k, v in rows if not 1000 <= k < 1010 and k != -60] + [(90000, "far"), (-600, "low"), (301, "more")]
    two = tree(spark, other)
    assert DT.version(spark, one) != DT.version(spark, two)
    got = {(r.lo, r.hi): r.change for r in DT.changed_ranges(spark, one, two, 10).collect()}
    assert got == {(300, 310): "changed", (1000, 1010): "removed", (90000, 90010): "added", (-600, -590): "added", (-60, -50): "changed"}
    with pytest.raises(ValueError, match="without a key"):
        tree(spark, [(None, "x")])

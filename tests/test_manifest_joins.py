"""Joins with exploded sets are not broadcast; results as before."""

from pyspark.sql import functions as F

from fieldloom.operators import manifest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sets(spark):
    expected = spark.createDataFrame([(0,), (1,)], "lp long").withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(5))))
    existing = spark.createDataFrame([(0, k) for k in range(6)] + [(1, 2), (1, 2), (1, 9), (None, 1)], "lp long, plane int")
    return expected, existing


def test_completeness_sorts(spark):
    df = manifest.completeness(*_sets(spark), ["lp", "plane"], ["lp"], 2)
    assert "Broadcast" not in _plan(df)
    assert sorted(tuple(r) for r in df.collect()) == [(0, 6, 6, "OK", True), (1, 6, 1, "1/6", False)]


def test_index_ranges_sort(spark):
    expected, existing = _sets(spark)
    df = manifest.index_ranges(manifest.missing(expected, existing.hint("merge"), ("lp", "plane")), ["lp"], "plane")
    assert "Broadcast" not in _plan(df)
    assert [tuple(r) for r in df.collect()] == [(1, "0-1,3-5")]

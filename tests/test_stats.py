"""Order statistics, resampling and stacks against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import manifest, ordering, stats, windows


def frame(spark, values, groups=None):
    rows = [(k, float(v), int(groups[k]) if groups is not None else 0) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k long, v double, g int")


@pytest.mark.parametrize("kind", ["spread", "duplicates", "constant", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(1)
    v = {
        "spread": rng.lognormal(size=3000),
        "duplicates": np.concatenate([np.full(1500, 2.0), rng.integers(0, 5, 1500)]),
        "constant": np.full(700, 3.5),
        "tiny": np.array([4.0, 1.0]),
    }[kind]
    g = (np.arange(len(v)) % 3 == 0).astype(int)  # a third of the rows under one key
    probs = [0.0, 0.16, 0.5, 0.84, 1.0]
    got = ordering.exact_quantiles(frame(spark, v, g), ["g"], "v", probs, [f"q{k}" for k in range(5)], slice_rows=4)
    for r in got.collect():
        want = np.percentile(v[g == r.g], [100 * p for p in probs])
        assert [r[f"q{k}"] for k in range(5)] == pytest.approx(list(want))


def test_row_ranks_with_a_dominant_value(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(2000, 7.0), rng.integers(0, 15, 1000)])
    got = {r.k: r["rank"] for r in ordering.row_ranks(frame(spark, v), "v", "k", slice_rows=4).collect()}
    order = np.lexsort((np.arange(len(v)), v))
    assert [got[k] for k in order] == list(range(len(v)))


@pytest.mark.parametrize("stat", ["mean", "median"])
def test_rolling_windows_cross_chunks(spark, stat):
    rng = np.random.default_rng(4)
    v = rng.permutation(500).astype(float)
    df = frame(spark, v).withColumn("y", F.sin("v"))
    got = [r.y_out for r in ordering.rolling(df, "v", "y", "k", 7, stat, chunk=32).orderBy("rank").collect()]
    y = np.sin(np.arange(500.0))
    fn = np.mean if stat == "mean" else np.median
    assert got == pytest.approx([fn(y[i : i + 7]) for i in range(494)])


def test_stack_mean_and_median_small_cases(spark):
    rows = [(b, float(x)) for prof in [(1, 2, 3), (2, 3, 4), (3, 4, 5)] for b, x in enumerate(prof)]
    df = spark.createDataFrame(rows, "bin int, v double")
    assert [r.stacked for r in stats.stack_mean(df, ["bin"], "v").orderBy("bin").collect()] == [2.0, 3.0, 4.0]
    out = df.unionByName(spark.createDataFrame([(0, 100.0), (0, 2.0), (1, float("nan"))], "bin int, v double"))
    med = stats.stack_median(out, ["bin"], "v").orderBy("bin").collect()
    assert [r.stacked for r in med] == [2.0, 3.0, 4.0]


@pytest.mark.parametrize("statistic", ["mean", "std", "sum", "ratio"])
def test_bootstrap_of_a_statistic_follows_its_sampling_spread(spark, statistic):
    rng = np.random.default_rng(6)
    v, x = rng.normal(5, 1, 400), rng.uniform(1, 2, 400)
    df = spark.createDataFrame([(k, float(a), float(c)) for k, (a, c) in enumerate(zip(v, x))], "k long, v double, x double").repartition(5)
    of = {"mean": lambda a, c: a.mean(), "std": lambda a, c: a.std(), "sum": lambda a, c: a.sum(), "ratio": lambda a, c: a.sum() / c.sum()}[statistic]
    got = np.array([r[statistic] for r in stats.bootstrap(df, "v", "k", statistic, "x" if statistic == "ratio" else None, n_resamples=400, seed=1).collect()])
    picks = rng.integers(0, 400, (2000, 400))
    want = np.array([of(v[p], x[p]) for p in picks])  # multinomial resamples
    assert len(got) == 400
    assert abs(got.mean() - want.mean()) < 4 * want.std() / 20
    assert 0.85 < got.std() / want.std() < 1.15


def test_resamples_join_nothing_and_keep_rows_of_a_key_together(spark):
    df = spark.createDataFrame([(k // 4, k % 4, float(k)) for k in range(80)], "row long, bin int, v double")
    plan = stats.bootstrap_rows(df, "row", ["bin"], "v", 30)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    weights = stats.resampled(df, "row", {"s": F.col("v")}, ["bin"], 30).select("bin", "b", "weight").collect()
    by_b = {}
    for r in weights:
        by_b.setdefault(r.b, set()).add(r.weight)
    assert all(len(w) == 1 for w in by_b.values())  # every bin of a row has its weight


def test_poisson_steps_have_mean_and_variance_one(spark):
    d = spark.range(40_000).select(stats.poisson_number(stats.mixed_value(F.col("id") % 20, F.col("id") * 987_654_321, 3)).alias("w"))
    r = d.agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(r[0] - 1) < 0.02 and abs(r[1] - 1) < 0.04 and 6 <= r[2] <= 11


@pytest.mark.parametrize("statistic", ["mean", "std", "ratio"])
def test_jackknife_of_a_statistic_equals_leaving_blocks_out(spark, statistic):
    rng = np.random.default_rng(21)
    v, x, k = rng.normal(3, 1, 60), rng.uniform(1, 2, 60), np.arange(60)
    df = spark.createDataFrame([(int(i), float(a), float(c)) for i, a, c in zip(k, v, x)], "k long, v double, x double")
    of = {"mean": lambda m: v[m].mean(), "std": lambda m: v[m].std(), "ratio": lambda m: v[m].sum() / x[m].sum()}[statistic]
    for blocks in (60, 12):
        r = stats.jackknife(df, "v", F.col("k") % blocks, statistic, "x" if statistic == "ratio" else None).first()
        reps = np.array([of(k % blocks != g) for g in range(blocks)])
        assert r[statistic] == pytest.approx(of(k >= 0)) and r.n_blocks == blocks
        assert r.error == pytest.approx(np.sqrt((blocks - 1) / blocks * ((reps - reps.mean()) ** 2).sum()))


def test_jackknife_equals_leave_one_out(spark):
    v = np.random.default_rng(7).normal(size=40)
    r = stats.jackknife_mean(frame(spark, v), ["g"], "v").first()
    reps = np.array([np.delete(v, k).mean() for k in range(40)])
    assert r.error == pytest.approx(np.sqrt(39 / 40 * ((reps - reps.mean()) ** 2).sum()))


def test_correlation_p_value(spark):
    # Student t with 8 degrees of freedom: P(|T| > 2.306) = 0.05
    df = spark.createDataFrame([(2.306004135, 10), (0.0, 10), (5.0, 30)], "t double, n long")
    p = [r.p for r in df.select(stats.correlation_p_value("t", "n").alias("p")).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-6) and p[1] == pytest.approx(1.0)
    assert 0 < p[2] < 1e-4
    # one degree of freedom in closed form, and very many against the normal distribution; none gives NaN
    df = spark.createDataFrame([(2.0, 3), (-2.0, 3), (1.96, 10**9 + 2), (40.0, 10**6), (1.0, 2), (None, 9)], "t double, n long")
    p = [r.p for r in df.select(stats.correlation_p_value("t", "n").alias("p")).collect()]
    assert p[0] == p[1] == pytest.approx(1 - 2 / math.pi * math.atan(2), rel=1e-12)
    assert p[2] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-6) and p[3] < 1e-300
    assert all(math.isnan(v) for v in p[4:])


def test_binned_statistic_line(spark):
    x = np.linspace(0, 10, 101)
    df = spark.createDataFrame([(float(a), float(2 * a)) for a in x], "x double, y double")
    rows = stats.binned_statistic(df, "x", "y", [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]).orderBy("bin").collect()
    assert sum(r.n for r in rows) == 101 and rows[-1].n == 21
    assert all(abs(r.y_stat - 2 * r.x_center) < 0.2 for r in rows)


def test_index_ranges(spark):
    df = spark.createDataFrame([(0, k) for k in [0, 1, 2, 3, 4, 6, 8, 9, 10, 11, 12, 12]], "g int, k int")
    assert manifest.index_ranges(df, ["g"], "k").first().ranges == "0-4,6,8-12"


def test_blocks_with_remainder(spark):
    df = spark.range(10).select(manifest.block_of(F.col("id"), F.lit(10), 4).alias("w"))
    counts = [r["count"] for r in df.groupBy("w").count().orderBy("w").collect()]
    assert counts == [3, 3, 2, 2]


def test_interpolation_clamps(spark):
    df = spark.createDataFrame([(0, 1.0, 10.0), (0, 2.0, 20.0), (0, 4.0, 0.0)], "g int, x double, y double")
    got = [r.y_at for r in windows.interpolate(df, ["g"], "x", "y", [0.0, 1.5, 2.0, 3.0, 9.0]).orderBy("x_at").collect()]
    assert got == list(np.interp([0.0, 1.5, 2.0, 3.0, 9.0], [1, 2, 4], [10, 20, 0]))


def test_bins_from_the_data_hold_every_row(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (3, 4, 9, 28, 28)], "x double, y double")
    assert [r["n"] for r in stats.binned_statistic(df, "x", "y", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 2]
    assert sum(r["n"] for r in stats.binned_statistic(df.where("x = 9"), "x", "y", 3).collect()) == 1


def test_model_names_carry(spark):
    from fieldloom.operators import response

    df = spark.createDataFrame([(9.996e12, 1e13, 3.0), (9.994e12, 9.999e13, 0.5)], "lo double, hi double, a double")
    names = [r[0] for r in df.select(response.format_model(F.col("lo"), F.col("hi"), F.col("a"))).collect()]
    assert names == ["replace_Ml_1.00e13_Mu_1.00e13_R_3.0", "replace_Ml_9.99e12_Mu_1.00e14_R_0.5"]


def test_slices_of_one_group_stay_bounded(spark):
    df = spark.range(40000).selectExpr("cast(id as double) as v", "id as k", "1 as g")
    for slice_rows in (3, 50):  # with three, there are coarse slices too
        sizes = ordering.sliced(df, ["g"], F.col("v"), slice_rows).groupBy("_hi", "_lo").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = sizes.orderBy("_hi", "_lo").collect()
        assert len(rows) >= 0.8 * 40000 / slice_rows and max(r.n for r in rows) <= 14 * slice_rows
        assert all(a.hi < b.lo for a, b in zip(rows, rows[1:])) and (rows[-1]["_hi"] > 0) == (slice_rows == 3)
    ranks = ordering.ranked_values(df, ["g"], "v", 3).where("before <> v or total <> 40000 or n <> 1")
    assert ranks.isEmpty() and ordering.row_ranks(df, "v", "k", 3).where("rank <> k").isEmpty()

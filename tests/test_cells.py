"""Displacement by a table, nearest partners and covered cells, which meet by cells, against the pair forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bcm, spatial

R, M, TABLE = [0.0, 0.5, 1.0, 2.0, 5.0], [12.0, 13.0, 15.0], [[0.0, 0.05, 0.2, 0.1, 0.0], [0.0, 0.04, 0.15, 0.05, 0.0], [0.0, 0.01, 0.05, -0.02, 0.0]]


def _tables(spark):
    rng = np.random.default_rng(8)
    p = [(k, float(k), *map(float, rng.uniform(0, 205, 3))) for k in range(1500)]
    p += [p[3], p[3], p[7], (2001, 1.0, None, 5.0, 5.0), (None, 2.0, 1.0, None, 3.0)]  # copies, lost places
    h = [(k, *map(float, rng.uniform(0, 205, 3)), float(rng.integers(20, 50)) / 10, float(rng.integers(115, 155)) / 10) for k in range(40)]
    h += [h[4], (41, 0.2, 204.9, 100.0, 4.9, 14.0), (42, 10.0, 10.0, 10.0, 3.0, None)]
    return (
        spark.createDataFrame(p, "pid long, mass double, x double, y double, z double"),
        spark.createDataFrame(h, "halo_id long, hx double, hy double, hz double, r200 double, log_mass double"),
    )


def _rows(df):
    return {r[0]: tuple(None if v is None else round(v, 9) for v in r[1:]) for r in df.collect()}


def test_displacement_by_table_without_pairs(spark):
    p, h = _tables(spark)
    reach, row = F.col("r200") * 5.0, bcm.mass_row(F.col("log_mass"), M, TABLE)
    one = bcm.displace_additive(p, h, reach, bcm.tabulated(F.col("d") / F.col("r200"), F.col("log_mass"), R, M, TABLE), max_radius=24.5)
    two = bcm.push_additive(p, h, reach, "r200", R, row, max_radius=24.5)
    assert _rows(one) == _rows(two) and two.count() == 1502 and two.schema == p.schema
    assert sum(a != b for a, b in zip(sorted(_rows(two).items(), key=repr), sorted(_rows(p).items(), key=repr))) > 100
    step = lambda d, s: bcm.tabulated(d / s["r200"], s["log_mass"], R, M, TABLE)
    one = bcm.displace_sequential(p, h, reach, "halo_id", step, ["r200", "log_mass"], max_radius=24.5)
    two = bcm.push_sequential(p, h, reach, "halo_id", "r200", R, row, ["r200", "log_mass"], max_radius=24.5)
    assert _rows(one) == _rows(two) and two.count() == 1502
    for made in (bcm.push_additive(p, h, reach, "r200", R, row, max_radius=24.5), two):  # no row for each pair
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_displacement_keeps_runs_apart(spark):
    p, h = _tables(spark)
    p, h = p.where("pid is not null").dropDuplicates(["pid"]), h.dropDuplicates(["halo_id"])
    runs = lambda df: df.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    some = h.withColumn("run", (F.col("halo_id") % 2).cast("int"))
    for push in (bcm.push_additive, lambda p, h, reach, *a, **k: bcm.push_sequential(p, h, reach, "halo_id", *a, **k)):
        args = (F.col("r200") * 5.0, "r200", R, bcm.mass_row(F.col("log_mass"), M, TABLE))
        both = push(runs(p), some, *args, max_radius=24.5, ids=("run", "pid"), within=("run",))
        for k in (0, 1):
            assert _rows(both.where(F.col("run") == k).select(p.columns)) == _rows(push(p, some.where(F.col("run") == k).drop("run"), *args, max_radius=24.5))


def test_along_row_is_the_table(spark):
    at = spark.range(0, 800).select((F.col("id") % 80 / 14.0).alias("r"), F.when(F.col("id") % 9 > 0, 11.5 + F.col("id") / 200.0).alias("m"))
    both = at.select(bcm.tabulated(F.col("r"), F.col("m"), R, M, TABLE).alias("a"), bcm.along_row(F.col("r"), R, bcm.mass_row(F.col("m"), M, TABLE)).alias("b"))
    assert all(abs(x.a - x.b) < 1e-15 for x in both.collect())


@pytest.mark.parametrize("radius", [8.0, 20.0, 110.0])
def test_spatial_match_by_cells(spark, radius):
    rng = np.random.default_rng(5)
    second = [(k, *map(float, rng.integers(0, 205, 3)), float(1 + k % 13)) for k in range(900)]
    second += [(2000 + r[0], *r[1:]) for r in second[:50]] + [second[9], (3000, 1.0, None, 2.0, 3.0), (3001, 1.0, 1.0, 2.0, None)]
    first = [(k, *map(float, rng.integers(0, 205, 3)), radius, float(1 + k % 5)) for k in range(60)] + [(None, 5.0, 5.0, 5.0, radius, 2.0)]
    a = spark.createDataFrame(first, "id1 long, x double, y double, z double, r1 double, m1 double")
    b = spark.createDataFrame(second, "id2 long, hx double, hy double, hz double, m2 double")
    made = spatial.spatial_match(a, b)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, x, y, z, r, m1 in first:
        near = []
        for j, hx, hy, hz, m2 in second:
            if None in (hx, hy, hz, m2):
                continue
            d = np.array([hx - x, hy - y, hz - z])
            d -= 205.0 * np.rint(d / 205.0)
            d = float(np.sqrt((d * d).sum()))
            if d <= r and 0.2 < m2 / m1 < 5.0:
                near.append((round(d, 9), j, m2 / m1))
        if near:
            want[i] = min(near)
    assert {r.id1: (round(r.separation, 9), r.id2, r.ratio) for r in made.collect()} == want and len(want) > 3


def test_covered_cells_against_all_centres(spark):
    rng = np.random.default_rng(6)
    balls = [(float(x), float(y), float(z), float(r)) for (x, y, z), r in zip(rng.uniform(0, 205, (30, 3)), rng.uniform(0, 30, 30))] + [(1.0, 204.0, 100.0, 101.0), (None, 1.0, 1.0, 200.0)]
    for many in (balls[:30], balls):
        df = spark.createDataFrame(many, "hx double, hy double, hz double, r double")
        centre = np.stack(np.meshgrid(*[(np.arange(21) + 0.5) * 205.0 / 21] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
        hit = np.zeros(len(centre), dtype=bool)
        for x, y, z, r in many:
            if x is not None:
                d = centre - np.array([x, y, z])
                d -= 205.0 * np.rint(d / 205.0)
                hit |= np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2) <= r
        made = spatial.covered_cells(df, F.col("r"), 21)
        assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no row for each ball and cell
        assert sorted(r[0] for r in made.collect()) == np.flatnonzero(hit).tolist()

"""Sums by rings against plain pair arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import profiles, rings, spatial
from fieldloom.plans import registry


def _tables(spark, n=4000):
    rng = np.random.default_rng(3)
    p = [(int(i), *map(float, rng.integers(0, 205000, 3) / 1000), int(rng.choice([0, 1, 4])), None if i % 17 == 0 else float(rng.integers(1, 50)), "dmo" if i % 3 else "hydro") for i in range(n)]
    p += [p[5], (9001, None, 1.0, 1.0, 0, 1.0, "dmo"), (9002, 10.0, 10.0, 10.0, 4, 1.0, "dmo")]  # a copy, a lost place, a halo's own centre
    h = [(1, 10.0, 10.0, 10.0, 2.0), (2, 0.5, 204.0, 100.0, 4.9), (2, 0.5, 204.0, 100.0, 4.9), (3, 150.0, 20.0, 77.0, 3.3), (None, 60.0, 60.0, 60.0, 4.0)]
    points = spark.createDataFrame(p, "pid long, x double, y double, z double, ptype int, mass double, sim string")
    return points, spark.createDataFrame(h, "halo_id long, hx double, hy double, hz double, r200 double")


def _pairs(points, halos):
    return spatial.ball_join(points, halos, F.col("r200") * 5.0, max_radius=24.5).withColumn("r", F.col("d") / F.col("r200"))


def _rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("side", ["hist", "left", "right"])
def test_profile_without_pairs(spark, side):
    points, halos = _tables(spark)
    edges = [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0]
    one = profiles.radial_profile(_pairs(points, halos), edges, side, ("halo_id", "r200", "sim"))
    two = profiles.ball_profile(points, halos, 5.0, 24.5, edges, side, ("halo_id", "r200"), "sim")
    assert "d" not in two.columns and _rows(one.select(two.columns)) == _rows(two) and two.count() > 10


def test_masses_without_pairs(spark):
    points, halos = _tables(spark)
    for strict in (False, True):
        one = profiles.masses_within(_pairs(points, halos), strict=strict)
        assert _rows(profiles.ball_masses(points, halos, 5.0, 24.5, strict=strict).select(one.columns)) == _rows(one)


def test_interpolated_without_pairs(spark):
    points, halos = _tables(spark)
    one = profiles.enclosed_interpolated(_pairs(points, halos), [0.5, 1.0, 2.0, 4.0], ("halo_id", "sim"))
    two = profiles.ball_interpolated(points, halos, 5.0, 24.5, [0.5, 1.0, 2.0, 4.0], ("halo_id",), "sim")
    plain = [(h, s, x, None if m is None else round(m, 9)) for h, s, x, m in _rows(one.select("halo_id", "sim", "radius", "m_enclosed"))]
    assert plain == [(h, s, x, None if m is None else round(m, 9)) for h, s, x, m in _rows(two.select("halo_id", "sim", "radius", "m_enclosed"))]


def test_edges_as_the_quotient_has_them():
    rng = np.random.default_rng(0)
    unit, edges = rng.integers(20, 50, 200) / 10, [0.0, 0.3, 0.7, 1.1, 4.9]
    for side, beyond in (("left", False), ("right", True)):
        cut = rings.thresholds(unit, unit * 1e6, edges, side)
        for k, e in enumerate(edges):
            past = lambda q: np.sqrt(q) / unit > e if beyond else np.sqrt(q) / unit >= e
            assert past(cut[:, k]).all()
            lower = cut[:, k] > 0
            assert not past(np.nextafter(cut[:, k], -1.0))[lower].any()


def test_small_boxes_and_whole_balls():
    rng = np.random.default_rng(1)
    xyz, centre = rng.random((3000, 3)) * 20, rng.random((70, 3)) * 30 - 5
    w = np.column_stack([np.ones(3000), rng.integers(1, 50, 3000)])
    cut = rings.thresholds(rng.integers(20, 50, 70) / 10, np.full(70, 12.0), [0.0, 0.5, 1.0, 2.0, 4.0], "hist")
    q = rings.squared(centre, xyz)
    ring = (q[:, :, None] >= cut[:, None, :]).sum(axis=2)
    want = np.stack([(ring == k).astype(float) @ w for k in range(5)], axis=1)
    assert np.array_equal(rings.ring_sums(xyz, w, centre, cut)[:, :5], want)


def test_ends_come_with_the_sums(monkeypatch):
    rng = np.random.default_rng(2)
    xyz, centre, unit = rng.integers(0, 400, (6000, 3)) / 20, rng.integers(-100, 500, (90, 3)) / 20, rng.integers(20, 50, 90) / 10
    value, w = rng.integers(1, 50, 6000).astype(float), np.ones((6000, 1))
    cut = rings.thresholds(unit, unit * 5, [-1.0, 0.5, 1.0, 2.0, 4.0, np.inf], "right")
    measured, squared = [], rings.squared
    monkeypatch.setattr(rings, "squared", lambda c, p, *room: measured.append(len(c) * len(p)) or squared(c, p, *room))
    sums = rings.ring_sums(xyz, w, centre, cut)
    alone, found = sum(measured), rings.Ends(value, unit, cut.shape[1] + 1)
    assert np.array_equal(rings.ring_sums(xyz, w, centre, cut, found), sums)
    assert sum(measured) - alone < 1.5 * alone  # the boxes that an edge crosses are not measured once more for the ends
    q = squared(centre, xyz)
    ring, r = (q[:, :, None] >= cut[:, None, :]).sum(axis=2), np.sqrt(q) / unit[:, None]
    for ball, k in zip(*np.nonzero(sums[:, :, 0])):
        inside = r[ball, ring[ball] == k]
        assert found.low[ball, k] == inside.min() and found.high[ball, k] == inside.max()
        assert found.held[ball, k] == value[(ring[ball] == k) & (r[ball] == inside.min())].min()


def test_deficit_works_out_the_rings_once(spark, small):
    shape = "halo_id long, radius double, sim string, m_enclosed double"
    rows = [(1, 0.5, "dmo", 4.0), (1, 0.5, "hydro", 3.0), (2, 0.5, "hydro", 3.0), (3, 1.0, "dmo", 2.0), (4, 1.0, "dmo", 0.0), (4, 1.0, "hydro", 1.0)]
    rows += [(5, 1.0, "dmo", None), (5, 1.0, "hydro", 2.0), (None, 1.0, "dmo", 5.0), (None, 1.0, "hydro", 6.0), (6, None, "hydro", 6.0), (7, 1.0, None, 3.0)]
    e = spark.createDataFrame(rows, shape)
    assert _rows(profiles.deficit_by_run(e)) == _rows(profiles.mass_deficit(e.where("sim = 'dmo'"), e.where("sim = 'hydro'")))
    query = registry.load()[0]["g09_mass_deficit"](spark, small)
    assert query._jdf.queryExecution().executedPlan().toString().count("CoGroup") == 1

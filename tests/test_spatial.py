"""The cell join against brute force, and its plan."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import geometry as geo
from fieldloom.operators import bcm, replace, spatial

L = 100.0


def brute(points, balls, strict=False):
    out = set()
    for pid, p in enumerate(points):
        for h, (c, r) in enumerate(balls):
            d = np.array(p) - np.array(c)
            d -= L * np.rint(d / L)
            dist = np.sqrt((d * d).sum())
            if dist < r or (not strict and dist == r):
                out.add((pid, h))
    return out


def frames(spark, points, balls):
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(points)], "pid long, x double, y double, z double")
    b = spark.createDataFrame([(k, *map(float, c), float(r)) for k, (c, r) in enumerate(balls)], "halo_id long, hx double, hy double, hz double, rad double")
    return p, b


def joined(df):
    rows = [(r.pid, r.halo_id) for r in df.select("pid", "halo_id").collect()]
    assert len(rows) == len(set(rows)), "a pair came out twice"
    return set(rows)


@pytest.mark.parametrize("radius", [3.0, 20.0, 49.9, 60.0, 90.0])
@pytest.mark.parametrize("salt", [1, 3])
def test_ball_join_equals_brute_force(spark, radius, salt):
    rng = np.random.default_rng(int(radius))
    points = rng.uniform(0, L, (300, 3))
    balls = [(rng.uniform(0, L, 3), radius * f) for f in (0.2, 0.5, 1.0)] + [((0.0, 0.0, 0.0), radius), ((99.9, 0.1, 50.0), radius)]
    p, b = frames(spark, points, balls)
    got = joined(spatial.ball_join(p, b, F.col("rad"), box=L, salt=salt))
    assert got == brute(points, balls)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(*[st.sampled_from([0.0, 1.0, 24.0, 25.0, 50.0, 75.0, 99.0, 99.999999])] * 3), min_size=1, max_size=12),
    st.sampled_from([1.0, 25.0, 26.0, 40.0]),
)
def test_points_on_faces_and_corners(spark, points, radius):
    balls = [((0.0, 0.0, 0.0), radius), ((99.0, 99.0, 99.0), radius), ((50.0, 25.0, 75.0), radius)]
    p, b = frames(spark, points, balls)
    assert joined(spatial.ball_join(p, b, F.col("rad"), box=L)) == brute(points, balls)
    assert joined(spatial.ball_join(p, b, F.col("rad"), box=L, strict=True)) == brute(points, balls, True)


def test_semi_and_anti_split_the_points(spark):
    rng = np.random.default_rng(5)
    points, balls = rng.uniform(0, L, (400, 3)), [(rng.uniform(0, L, 3), 15.0) for _ in range(10)]
    p, b = frames(spark, points, balls)
    ids = lambda how: {r.pid for r in spatial.ball_join(p, b, F.col("rad"), box=L, how=how).collect()}
    near = {a for a, _ in brute(points, balls)}
    assert ids("left_semi") == near
    assert ids("left_anti") == set(range(400)) - near


def test_unwrapped_points(spark):
    points = [(110.0, -10.0, 50.0), (5.0, 95.0, 50.0)]
    p, b = frames(spark, points, [((10.0, 90.0, 50.0), 8.0)])
    got = spatial.ball_join(p, b, F.col("rad"), box=L, wrapped=False).select("pid", F.round("d", 6).alias("d")).collect()
    assert {(r.pid, r.d) for r in got} == {(0, 0.0), (1, round(50**0.5, 6))}


def test_radius_above_the_declared_limit_is_an_error(spark):
    p, b = frames(spark, [(1.0, 1.0, 1.0)], [((1.0, 1.0, 1.0), 30.0)])
    with pytest.raises(Exception, match="max_radius"):
        spatial.ball_join(p, b, F.col("rad"), box=L, max_radius=10.0).collect()


def test_crowded_cell_without_broadcast(spark):
    """A third of all points in one cell; sort-merge join, skew split and salting all agree."""
    rng = np.random.default_rng(9)
    points = np.vstack([rng.uniform(0, L, (4000, 3)), rng.uniform(40, 41, (2000, 3))])
    balls = [(rng.uniform(0, L, 3), 12.0) for _ in range(40)] + [((40.5, 40.5, 40.5), 12.0)]
    p, b = frames(spark, points, balls)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    try:
        plain = spatial.ball_join(p, b, F.col("rad"), box=L)
        assert "BroadcastHashJoin" not in plain._jdf.queryExecution().toString()
        want = brute(points, balls)
        assert joined(plain) == want
        assert joined(spatial.ball_join(p, b, F.col("rad"), box=L, salt=8)) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_wrap_and_distance(spark):
    row = spark.range(1).select(
        geo.wrap(F.lit(110.0), L).alias("a"),
        geo.wrap(F.lit(-10.0), L).alias("b"),
        F.abs(geo.min_image(F.lit(95.0) - F.lit(5.0), L)).alias("d"),
        geo.min_image(F.lit(50.0), L).alias("half"),
    ).first()
    assert (row.a, row.b, row.d) == (10.0, 90.0, 10.0)
    assert row.half == 50.0  # half-even: 0.5 rounds to 0


def test_replicate_counts(spark):
    p, _ = frames(spark, [(1.0, 2.0, 3.0)], [((0, 0, 0), 1)])
    got = {(r.x, r.y, r.z) for r in geo.replicate(p, L).collect()}
    assert got == {(1 + a, 2 + b, 3 + c) for a, b, c in itertools.product((-L, 0.0, L), repeat=3)}


def test_replace_with_no_halos_is_the_background(spark):
    rng = np.random.default_rng(2)
    p, b = frames(spark, rng.uniform(0, L, (50, 3)), [((1.0, 1.0, 1.0), 5.0)])
    p = p.withColumn("mass", F.lit(1.0))
    out = replace.replace_field(p, p, b.where(F.lit(False)), F.col("rad"), box=L, max_radius=5.0)
    assert out.count() == 50 and {r.source for r in out.collect()} == {"dmo_background"}


def test_sequential_displacement_follows_the_halo_order(spark):
    p, b = frames(spark, [(52.0, 50.0, 50.0), (10.0, 10.0, 10.0)], [((50.0, 50.0, 50.0), 5.0), ((55.0, 50.0, 50.0), 5.0)])
    out = bcm.displace_sequential(p, b, F.col("rad"), "halo_id", lambda d, h: d * 0.5, ["rad"], box=L, max_radius=5.0)
    got = {r.pid: (r.x, r.y, r.z) for r in out.collect()}
    assert got[0] == pytest.approx((52 + 1.0 - 1.0, 50.0, 50.0))  # +1 from the first, then -1 from the second
    assert got[1] == (10.0, 10.0, 10.0)
    both = bcm.displace_additive(p, b, F.col("rad"), F.col("d") * 0.5, box=L, max_radius=5.0)
    assert {r.pid: r.x for r in both.collect()}[0] == pytest.approx(52 + 1.0 - 1.5)


def test_radius_classes_test_few_pairs_and_miss_none(spark):
    """Radii over a factor of a thousand: the pairs that meet in a cell stay within a fixed factor of those found."""
    rng = np.random.default_rng(22)
    points = rng.uniform(0, L, (4000, 3))
    at = points[rng.integers(0, 4000, 300)]  # small balls sit on points, so that each finds one
    balls = [(at[k], 0.04 * 1000 ** (k / 299)) for k in range(300)]
    p, b = frames(spark, points, balls)
    out = spatial.ball_join(p, b, F.col("rad"), box=L)
    assert "first" not in out.columns and joined(out) == brute(points, balls)
    classes = spatial.radius_class(F.col("rad"), L)
    cells = spatial.expand_balls(b.withColumn("c", classes), F.col("rad"), F.pow(F.lit(2.0), F.col("c")).cast("long"), L)
    at_cell = p.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(spatial.LEVELS))))
    at_cell = at_cell.withColumn("_cell", spatial.point_cell(("x", "y", "z"), F.pow(F.lit(2.0), F.col("c")).cast("long"), L))
    tested = at_cell.join(cells.select("c", "_cell"), ["c", "_cell"]).count()
    assert tested < 8 * len(brute(points, balls)) and cells.groupBy("halo_id").count().agg(F.max("count")).first()[0] <= 7**3


def test_left_join_keeps_points_in_no_ball(spark):
    rng = np.random.default_rng(23)
    points, balls = rng.uniform(0, L, (200, 3)), [(rng.uniform(0, L, 3), 12.0) for _ in range(6)]
    p, b = frames(spark, points, balls)
    for limit in (None, 12.0):
        rows = spatial.ball_join(p, b, F.col("rad"), box=L, how="left", max_radius=limit).collect()
        assert {(r.pid, r.halo_id) for r in rows if r.halo_id is not None} == brute(points, balls)
        assert {r.pid for r in rows} == set(range(200)) and all((r.d is None) == (r.halo_id is None) for r in rows)


def test_equal_ids_of_two_snapshots_stay_apart(spark):
    """The same ids, at other places and with other members, in each snapshot."""
    from fieldloom.operators import matching

    rng = np.random.default_rng(24)
    shape = "snap int, pid long, mass double, x double, y double, z double"
    rows = [(s, k, 1.0, *map(float, rng.uniform(0, L, 3))) for s in (0, 1) for k in range(150)]
    halos = [(s, h, *map(float, rng.uniform(0, L, 3)), 20.0) for s in (0, 1) for h in range(4)]
    both, hs = spark.createDataFrame(rows, shape), spark.createDataFrame(halos, "snap int, halo_id long, hx double, hy double, hz double, rad double")
    shift = lambda d, h=None: d * 0.1
    for move in (
        lambda p, h, **k: bcm.displace_additive(p, h, F.col("rad"), shift(F.col("d")), box=L, **k),
        lambda p, h, **k: bcm.displace_sequential(p, h, F.col("rad"), "halo_id", shift, [], box=L, **k),
    ):
        got = sorted(tuple(r) for r in move(both, hs, ids=("snap", "pid"), within=("snap",)).collect())
        alone = [tuple(r) for s in (0, 1) for r in move(both.where(F.col("snap") == s), hs.where(F.col("snap") == s).drop("snap")).collect()]
        assert len(got) == 300 and np.allclose(np.array(got), np.array(sorted(alone)))
        assert sum(a[3:] != b[3:] for a, b in zip(got, sorted(rows))) > 20
    member = lambda shift_by: [(s, k, (k // 10 + s * shift_by) % 6, 1e13 if k < 40 else 1e11) for s in (0, 1) for k in range(60)]
    d, h = (spark.createDataFrame(member(n), "snap int, pid long, halo long, mass double") for n in (0, 1))
    found = {(r.snap, r.dmo, r.hydro) for r in matching.match_catalogues(d, h, keys=["snap"]).collect()}
    assert found == {(0, k, k) for k in range(6)} | {(1, k, (k + 1) % 6) for k in range(6)}
    heavy = matching.members_of(d, d.groupBy("snap", "halo").agg(F.max("mass").alias("mass")), ["snap"])
    assert {(r.snap, r.dmo) for r in matching.match_catalogues(heavy, h, min_particles=10, keys=["snap"]).collect()} == {(s, k) for s in (0, 1) for k in range(4)}
    assert matching.match_catalogues(heavy, h, min_particles=11, keys=["snap"]).count() == 0


def test_pairs_of_halos_are_dealt_out_once_and_uncounted(spark):
    """No sizes are joined to all pairs, and no task counts pairs before they are dealt out; halos without a name and small ones take no part."""
    from fieldloom.operators import matching

    rng = np.random.default_rng(38)
    rows = lambda: list({(int(p), None if h == 9 else int(h)) for p, h in zip(rng.integers(0, 60, 150), rng.integers(0, 10, 150))})
    d, h = rows(), rows()
    dmo, hydro = (spark.createDataFrame(x, "pid long, halo long") for x in (d, h))
    n_d, n_h = ({k: sum(y == k for _, y in x) for k in range(9)} for x in (d, h))
    shared = {}
    for p, a in d:
        for q, c in h:
            if p == q and a is not None and c is not None:
                shared[a, c] = shared.get((a, c), 0) + 1
    best = {a: min((c for x, c in shared if x == a), key=lambda c: (-shared[a, c], c)) for a in {a for a, _ in shared}}
    got = {r.dmo: (r.hydro, r.shared, r.n_dmo, r.n_hydro) for r in matching.best_overlap(dmo, hydro, 0.0).collect()}
    assert got == {a: (c, shared[a, c], n_d[a], n_h[c]) for a, c in best.items()}
    assert {(r.dmo, r.hydro): (r.shared, r.n_dmo, r.n_hydro) for r in matching.overlaps(dmo, hydro).collect()} == {k: (v, n_d[k[0]], n_h[k[1]]) for k, v in shared.items()}
    least = sorted(n_h.values())[4]
    large = {k: v for k, v in shared.items() if n_d[k[0]] >= least and n_h[k[1]] >= least}
    forth = {a: min((c for x, c in large if x == a), key=lambda c: (-large[a, c], c)) for a in {a for a, _ in large}}
    back = {c: min((a for a, x in large if x == c), key=lambda a: (-large[a, c], a)) for c in {c for _, c in large}}
    mutual = {(r.dmo, r.hydro) for r in matching.mutual_best(dmo, hydro, 0.0, min_particles=least).collect()}
    assert mutual == {(a, c) for a, c in forth.items() if back[c] == a}
    for df in (matching.best_overlap(dmo, hydro), matching.mutual_best(dmo, hydro)):
        plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        at = [k for k, line in enumerate(plan) if "RepartitionByExpression" in line or "Exchange hashpartitioning(dmo#" in line and "hydro#" in line]
        assert at and not any("HashAggregate" in plan[k + 1] for k in at)


def test_no_nested_loop_or_cartesian_product_over_particles(spark, small):
    from fieldloom.plans import registry

    q, _ = registry.load()
    for name in ("j01_halo_ball_join", "j04_near_any_halo", "j10_spatial_match", "r01_replace_field", "g05_masses_within", "b02_additive_displacement"):
        plan = q[name](spark, small)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name

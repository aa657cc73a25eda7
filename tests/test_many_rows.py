"""Joins whose result has a row for each pair: what they broadcast, and what a row costs."""

import math
import random

from pyspark.sql import functions as F

from fieldloom.operators import spatial
from fieldloom.plans import bindings as b


def test_cells_of_balls_are_not_broadcast(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 60.0, 2.0, 3.0)], "pid long, x double, y double, z double")
    h = spark.createDataFrame([(7, 2.0, 2.0, 3.0, 4.0)], "halo_id long, hx double, hy double, hz double, rad double")
    for how in ("inner", "left", "left_semi", "left_anti"):
        for limit in (4.0, None):
            out = spatial.ball_join(p, h, F.col("rad"), box=100.0, max_radius=limit, how=how)
            assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert {x.pid for x in out.collect()} == {"inner": {1}, "left": {1, 2}, "left_semi": {1}, "left_anti": {2}}[how]


def test_rounding_of_many_rows(spark):
    rng = random.Random(4)
    values = [rng.uniform(-300, 300) for _ in range(4000)] + [round(rng.uniform(-9, 9), 4) + s * 5e-5 for _ in range(500) for s in (-1, 1)]
    values += [rng.uniform(-9, 9) * 10.0 ** rng.randint(-12, 18) for _ in range(1000)] + [k / 8 for k in range(-40, 40)] + [(2 * k + 1) * 5e-7 for k in range(200)]
    values += [0.0, -0.0, -1e-9, 1.0000005, 2.5e-5, math.nan, math.inf, -math.inf, None, 1e308, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 6):
        quick = b.r_many(F.col("v"), digits)
        assert "CASE WHEN" in quick._jc.toString().upper()
        for x in df.select(quick.alias("a"), F.round("v", digits).alias("b")).collect():
            assert repr(x.a) == repr(x.b)

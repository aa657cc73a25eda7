"""Hard negatives against brute force: ties, copies, odd vectors, small shards, blocks and chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import hardnegatives

SHAPE = "vec_id long, embedding array<float>, label int, row long, shard string, v int, dim string"
LABEL = lambda: F.col("label")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vec = lambda n, s=1.0: [rng.gauss(0, 1) * s for _ in range(n)]
    centres = [vec(8) for _ in range(3)]
    out = []
    for i in range(500):
        c = centres[i % 3]
        out.append((i, [x + rng.gauss(0, 0.3) for x in c], rng.choice([0, 0, 0, 1, 2, -5])))
    out += [(1000 + i, out[7][1], rng.choice([0, 1])) for i in range(60)]  # copies of one vector
    out += [(2000 + i, vec(5, 40.0), i % 2) for i in range(40)]  # another length
    out += [(100, out[100][1], out[100][2]), out[100], out[3], out[3]]  # repeated ids and rows
    out += [(3000, [0.0] * 8, 0), (3100, [0.0] * 8, 1), (3200, [], 0), (3300, None, 0), (3400, [None] * 8, 1), (3500, [float("nan")] * 8, 1)]
    out += [(3600, [float("inf")] + [0.0] * 7, 0), (3700, vec(8), None), (None, vec(8), 0), (3800, vec(3), 9), (None, None, None)]
    rng.shuffle(out)
    return [(*r, 5, "mine", 6, "mine") for r in out]


def brute(spark, rows, is_anchor, positives, negatives):
    held = spark.createDataFrame(rows, SHAPE).select("vec_id", "embedding", "label").collect()  # as single precision
    good = []
    for i, e, label in held:
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e):
            good.append((i, label, [math.floor(256 * x) for x in e]))
    out = []
    for k, (i, label, q) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, lab) for n, (j, lab, v) in enumerate(good) if n != k and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            within = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(within)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(64, 8, 5, 3), (100_000, 16, 100, 100)])
def test_negatives_are_those_of_brute_force(spark, rows, sizes):
    data = hardnegatives.prepared(spark.createDataFrame(rows, SHAPE).repartition(4), LABEL())
    got = hardnegatives.mine(data, F.col("vec_id") % 20 == 0, 5, 10, *sizes)
    want = brute(spark, rows, lambda i: i % 20 == 0, 5, 10)
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want


def test_shards_and_leaves_hold_every_row_once(spark, rows):
    data = hardnegatives.prepared(spark.createDataFrame(rows, SHAPE), LABEL())
    leaves, boxes = hardnegatives.tree(data, 64, 8, 3)
    held = [(r["shard"], len(r["ids"]) // 8, len(r["m"]) // 8 // r["dim"]) for r in leaves.collect()]
    assert sum(n for _, n, _ in held) == data.count() and all(n == m <= 8 for _, n, m in held)
    by_shard = {}
    for s, n, _ in held:
        by_shard[s] = by_shard.get(s, 0) + n
    assert max(by_shard.values()) <= 2 * 64 and boxes.count() == len(by_shard)


def test_none_and_one(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    for some in (docs.where(F.lit(False)), docs.where("vec_id = 20"), docs.where("embedding is null")):
        assert hardnegatives.mine(hardnegatives.prepared(some, LABEL()), F.col("vec_id") % 20 == 0).count() == 0

"""Binary planes, FITS, settings, incremental products."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.constants import lens_planes
from fieldloom.sources import config, planes, products
from fieldloom.streaming import snapshots


def plane(spark, n):
    rows = [("p.dat", i, j, float(i * n + j)) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "file string, i int, j int, v double")


def test_plane_round_trip_and_layout(spark, tmp_path):
    log = planes.write_planes(plane(spark, 5), str(tmp_path), "file", 5).collect()
    raw = (tmp_path / "p.dat").read_bytes()
    assert log[0].pixels == 25 and len(raw) == 8 + 8 * 25
    assert np.frombuffer(raw[:4], "<i4")[0] == 5 and list(np.frombuffer(raw, "<f8", 25, 4)) == list(range(25))
    back = planes.to_pixels(planes.read_planes(spark, str(tmp_path / "*.dat")))
    assert {(r.i, r.j): r.v for r in back.collect()} == {(i, j): float(i * 5 + j) for i in range(5) for j in range(5)}
    assert [f for f in os.listdir(tmp_path) if f.endswith(".part")] == []


def test_broken_planes_are_reported(spark, tmp_path):
    good = np.array([2], "<i4").tobytes() + np.arange(4.0).tobytes() + np.array([2], "<i4").tobytes()
    (tmp_path / "good.dat").write_bytes(good)
    (tmp_path / "foot.dat").write_bytes(good[:-4] + np.array([3], "<i4").tobytes())
    (tmp_path / "short.dat").write_bytes(good[:20] + good[-4:])
    (tmp_path / "tiny.dat").write_bytes(b"abc")
    rows = planes.read_planes(spark, str(tmp_path / "*.dat")).collect()
    errors = {os.path.basename(r.path): r.error for r in rows if r.error}
    assert set(errors) == {"foot.dat", "short.dat", "tiny.dat"}
    assert sum(r.error is None for r in rows) == 2


def test_interleaved_potential_round_trip(spark, tmp_path):
    n = 3
    rows = [("q.dat", i, j, *[float(100 * i + 10 * j + f) for f in range(5)]) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "file string, i int, j int, " + ", ".join(f"{f} double" for f in planes.FIELDS))
    planes.write_planes(df, str(tmp_path), "file", n, planes.FIELDS).collect()
    flat = np.frombuffer((tmp_path / "q.dat").read_bytes(), "<f8", 5 * n * n, 4)
    for r in planes.interleave(df, ["file"], n).collect():
        assert flat[r.position] == r.value
    back = planes.to_potential_pixels(planes.read_planes(spark, str(tmp_path / "*.dat"), components=5))
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(t[1:] for t in rows)


def test_large_planes_are_written_and_read_by_blocks(spark, tmp_path):
    n, folder = 1100, str(tmp_path / "out")
    px = spark.range(n * n).select(F.lit("p.dat").alias("file"), F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"), F.col("id").cast("double").alias("v"))
    px = px.where(f"i < {planes.block_lines(n)} and i != 7")  # no pixel of the second block, nor of a line of the first
    assert planes.write_planes(px, folder, "file", n).first().pixels == (planes.block_lines(n) - 1) * n
    parts = os.listdir(tmp_path / "out-parts" / "p.dat")
    assert parts == ["4"] and os.path.getsize(tmp_path / "out-parts" / "p.dat" / "4") <= 8 * planes.BLOCK
    want = np.arange(float(n * n)).reshape(n, n)
    want[7] = want[planes.block_lines(n) :] = 0
    raw = (tmp_path / "out" / "p.dat").read_bytes()
    assert len(raw) == 8 + 8 * n * n and raw[:4] == raw[-4:] and np.array_equal(np.frombuffer(raw, "<f8", n * n, 4).reshape(n, n), want)
    lines = planes.read_planes(spark, folder + "/*.dat")
    assert "ReadSchema: struct<path:string,length:bigint>" in lines._jdf.queryExecution().executedPlan().toString()
    got = {r.i: (r.s, r.t) for r in lines.selectExpr("i", "aggregate(values, 0D, (a, x) -> a + x) as s", "size(values) as t").collect()}
    assert len(got) == n and all(got[i] == (want[i].sum(), n) for i in range(n))
    full = spark.range(n * n).selectExpr("'f.dat' as file", f"cast(floor(id / {n}) as int) as i", f"cast(id % {n} as int) as j", "cast(id as double) as v")
    assert planes.write_planes(full, folder, "file", n).first().pixels == n * n
    assert len(os.listdir(tmp_path / "out-parts" / "f.dat")) == 2
    assert np.array_equal(np.frombuffer((tmp_path / "out" / "f.dat").read_bytes(), "<f8", n * n, 4), np.arange(float(n * n)))


def test_fits_round_trip(spark, tmp_path):
    n = 9
    rows = [(m, i, j, float(m * 100 + i * n + j)) for m in (1, 2) for i in range(n) for j in range(n)]
    planes.write_fits(spark.createDataFrame(rows, "m int, i int, j int, v double"), str(tmp_path / "a"), "m", n).collect()
    assert {os.path.getsize(tmp_path / "a" / f) % 2880 for f in os.listdir(tmp_path / "a")} == {0}
    back = planes.read_fits(spark, str(tmp_path / "a" / "*.fits"))
    got = {(os.path.basename(r.path), r.i): r["values"] for r in back.collect()}
    assert got == {(f"{m}.fits", i): [float(m * 100 + i * n + j) for j in range(n)] for m in (1, 2) for i in range(n)}


def test_foreign_fits_images(spark, tmp_path):
    cards = ["SIMPLE  = T", "BITPIX  = 16 / short", "NAXIS   = 2", "NAXIS1  = 3", "NAXIS2  = 2", "BSCALE  = 0.5", "BZERO   = 10", *["COMMENT"] * 40, "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2 * 2880).encode()
    (tmp_path / "x.fits").write_bytes(head + np.arange(6, dtype=">i2").tobytes().ljust(2880, b"\0"))
    (tmp_path / "short.fits").write_bytes(head + b"\0\0")
    (tmp_path / "junk.fits").write_bytes(b"\xff" * 3000)
    rows = planes.read_fits(spark, str(tmp_path / "*.fits")).collect()
    assert {r.i: r["values"] for r in rows if not r.error} == {0: [10.0, 10.5, 11.0], 1: [11.5, 12.0, 12.5]}
    assert {os.path.basename(r.path) for r in rows if r.error} == {"short.fits", "junk.fits"}


def test_geometry_records(spark, tmp_path):
    table = [("g.dat", *p) for p in lens_planes()] * 2
    df = spark.createDataFrame(table, "file string, plane int, chi_lens double, z_lens double, chi_source double, z_source double")
    assert planes.write_geometry(df, str(tmp_path), "file", 205.0).first().planes == 40
    back = planes.geometry_planes(spark, str(tmp_path / "*.dat")).orderBy("k").collect()
    assert [(r.a, r.chi_lens, r.chi_source) for r in back] == [(1 / (1 + z), c, s) for _, c, z, s, _ in lens_planes()]
    whole = planes.read_geometry(planes.geometry_bytes(lens_planes(), [(2, 1.0, 2.0, 3.0, True), (0, 4.0, 5.0, 6.0, False)], 205.0))
    assert whole["direction"].tolist() == [2, 0] and whole["shift"].tolist() == [[1, 2, 3], [4, 5, 6]] and whole["flip"].tolist() == [[True] * 3, [False] * 3]
    with pytest.raises(ValueError):
        planes.read_geometry(planes.geometry_bytes(lens_planes(), [], 205.0) + b"x")


def test_transform_table_follows_its_seed(spark):
    rows = config.transform_rows()
    rng = np.random.RandomState(2020)
    direction, shift = rng.randint(0, 3, (10, 20)), rng.uniform(0, 205.0, (10, 20, 3))
    assert len(rows) == 200 and rows[21][:3] == (1, 1, direction[1, 1]) and rows[21][3] == shift[1, 1, 0]
    assert config.transform_table(spark).count() == 200


def test_geometry_record_length():
    g = planes.geometry_bytes(lens_planes(), [(0, 0.0, 0.0, 0.0, False)] * 20, 205.0)
    assert len(g) == 8 + 8 * (41 + 41 + 40 + 20 + 20) + 4 * 20 + 8 * 60 + 60


def test_config_expansion():
    c = config.expand({"base_dir": "/d", "a": {"p": "${base_dir}/x"}, "l": ["${base_dir}", 3], "u": "${nope}"})
    assert c["a"]["p"] == "/d/x" and c["l"] == ["/d", 3] and c["u"] == "${nope}"


def test_stream_counts_each_chunk_once(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "t int, m double"
    for k in range(3):
        spark.createDataFrame([(k % 2, 1.0)] * 5, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        s = snapshots.stream_chunks(spark, src, schema, max_files=1)
        q = snapshots.accumulate(s, lambda d: d.groupBy("t").agg(F.sum("m").alias("m")), str(tmp_path / "out"), str(tmp_path / "state"), ["t"])
        q.awaitTermination()
        return {r.t: r.m for r in snapshots.combine(spark, str(tmp_path / "out"), ["t"], ["m"]).collect()}

    assert run() == {0: 10.0, 1: 5.0}
    spark.createDataFrame([(1, 2.0)], schema).write.mode("append").parquet(src)
    assert run() == {0: 10.0, 1: 7.0}  # only the new file was read


def test_partition_overwrite_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "p")
    products.write_product(spark.createDataFrame([("a", 1), ("b", 2)], "m string, v int"), path, ["m"])
    products.write_product(spark.createDataFrame([("a", 9)], "m string, v int"), path, ["m"])
    assert {(r.m, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_partition_pruning_of_a_product(spark, tmp_path):
    path = str(tmp_path / "q")
    products.write_product(spark.createDataFrame([("dmo", 1, 1.0), ("hydro", 0, 2.0)], "sim string, ptype int, mass double"), path, ["sim", "ptype"])
    from fieldloom.sources.tables import scan_types

    plan = scan_types(spark.read.parquet(path), "dmo", [1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(sim" in plan


def test_a_run_goes_on_from_the_last_state_saved_whole(spark, tmp_path, monkeypatch):
    folder, seen = str(tmp_path / "state"), []
    start = spark.createDataFrame([(k, 0) for k in range(5)], "k long, v long")

    def advance(state, step):
        seen.append(step)
        return state.withColumn("v", F.col("v") * 10 + step)

    assert products.load_state(spark, folder) is None
    products.resumed(start, folder, 2, advance)
    with monkeypatch.context() as m:  # stops after the table, before the record
        m.setattr(products, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            products.resumed(start, folder, 4, advance)
    step, state = products.load_state(spark, folder)
    assert step == 1 and {r.v for r in state.collect()} == {1}
    out = products.resumed(start, folder, 4, advance)
    assert seen == [0, 1, 2, 2, 3] and sorted((r.k, r.v) for r in out.collect()) == [(k, 123) for k in range(5)]
    assert products.resumed(start, folder, 4, advance).count() == 5 and len(seen) == 5  # nothing left to do
    products.save_state(start, folder, 3)  # a step saved again
    assert products.load_state(spark, folder)[0] == 3


def test_each_group_of_the_member_cache_is_written_alone(spark, tmp_path, monkeypatch):
    """A write of one group needs no sort by group."""
    from fieldloom.plans import registry
    from fieldloom.sources import products

    spark.createDataFrame([(k,) for k in range(3)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    lines = [(o, n, (o + n) % 3) for o in range(8) for n in range(1, 8)] + [(0, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    written, write = [], products.write_product
    monkeypatch.setattr(products, "write_product", lambda df, *a: (written.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a)))
    got = {(r.grp, r.halo): (r.n, r.first_pid, r.last_pid) for r in registry.load()[0]["s09_member_cache"](spark, str(tmp_path)).collect()}
    member = {("dmo", s, o) for o, n, s in lines} | {("hydro_at_dmo", s if n <= 5 else (s + 1) % 3, o) for o, n, s in lines}
    of = {k: [o for g, s, o in member if (g, s) == k] for k in {m[:2] for m in member}}
    assert got == {k: (len(v), min(v), max(v)) for k, v in of.items()}
    assert len(written) == 2 and not any("Union" in plan for plan in written)

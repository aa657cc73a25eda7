"""Grids, transforms, morphology and the response algebra on small fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import blocks, cubes, gridding, images, lensing, regions, response, spectra


def field(spark, arrays):
    rows = [(m, i, j, float(a[i, j])) for m, a in enumerate(arrays) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "map_id int, i int, j int, v double")


def grid(df, n, col, m=0):
    out = np.zeros((n, n))
    for r in df.where(F.col("map_id") == m).collect():
        out[r.i, r.j] = r[col]
    return out


@pytest.mark.parametrize("rule", ["ngp", "cic", "cic_centred", "tsc", "tsc_centred"])
@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_grid_mass_equals_particle_mass(spark, rule, axes):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(c), float(m)) for a, b, c, m in zip(*rng.uniform(0, 50, (3, 200)), rng.uniform(1, 2, 200))]
    df = spark.createDataFrame(rows, "x double, y double, z double, mass double")
    total = gridding.assign(df, axes, 8, rule, box=50.0).agg(F.sum("mass")).first()[0]
    assert total == pytest.approx(sum(r[3] for r in rows))


def test_tsc_spreads_a_particle_on_its_node(spark):
    df = spark.createDataFrame([(10.0, 20.0, 1.0)], "x double, y double, mass double")
    got = {(r.i, r.j): r.mass for r in gridding.assign(df, ("x", "y"), 10, "tsc", box=50.0).collect()}
    assert got[(2, 4)] == pytest.approx(0.75**2) and got[(1, 4)] == pytest.approx(0.125 * 0.75)


@pytest.fixture(params=[1 << 18, 40])
def strip(request, monkeypatch):
    """Blocks of a whole map, and of a few lines or pixels."""
    monkeypatch.setattr(blocks, "STRIP", request.param)


@pytest.mark.parametrize("n", [12, 9])
def test_mode_powers_equal_fft2(spark, strip, n):
    a = np.random.default_rng(10).normal(size=(n, n))
    want = np.abs(np.fft.fft2(a)) ** 2
    rows = blocks.mode_powers(field(spark, [a]), ["map_id"], ("i", "j"), n, "v").collect()
    assert len(rows) == n * (n // 2 + 1) and sum(r.weight for r in rows) == n * n
    assert all(np.isclose(r.power, want[r.i, r.j]) for r in rows)
    assert sum(r.power * r.weight for r in rows) == pytest.approx(want.sum())


def test_mode_powers_of_a_cube(spark, strip):
    n = 6
    a = np.random.default_rng(16).normal(size=(n, n, n))
    cells = [(1, i, j, k, float(a[i, j, k])) for i in range(n) for j in range(n) for k in range(n) if (i + j + k) % 4]
    want = np.abs(np.fft.fftn(np.where(np.indices(a.shape).sum(axis=0) % 4 > 0, a, 0.0))) ** 2  # absent cells are zero
    rows = blocks.mode_powers(spark.createDataFrame(cells, "m int, i int, j int, k int, v double"), ["m"], ("i", "j", "k"), n, "v").collect()
    assert sum(r.weight for r in rows) == n**3 and all(np.isclose(r.power, want[r.i, r.j, r.k]) for r in rows)


@pytest.mark.parametrize("n", [12, 9])
def test_filtered_fields_are_real_parts_of_full_inverses(spark, strip, n):
    a = np.random.default_rng(17).normal(size=(n, n))
    k = blocks.signed(np.arange(n), n)
    want = np.fft.ifft2(1j * k[:, None] * np.fft.fft2(a)).real, np.fft.ifft2((k[:, None] * k[None, :]) * np.fft.fft2(a)).real
    factors = lambda i, j: [1j * blocks.signed(i, n)[:, None] * np.ones(len(j)), blocks.signed(i, n)[:, None] * blocks.signed(j, n)]
    got = blocks.filtered(field(spark, [a]), ["map_id"], n, ["v"], ["x", "xy"], factors)
    assert np.allclose(grid(got, n, "x"), want[0]) and np.allclose(grid(got, n, "xy"), want[1])


def test_aperture_mass_equals_the_sum_over_taps(spark, strip):
    n, theta = 16, 4.3
    a = np.random.default_rng(18).normal(size=(n, n))
    want = sum(w * np.roll(a, (di, dj), (0, 1)) for di, dj, w in lensing.aperture_kernel(theta))
    assert np.allclose(grid(lensing.aperture_mass(field(spark, [a]), ["map_id"], n, theta, 1.0), n, "m_ap"), want)


def test_no_pixels_between_passes(spark, small):
    from fieldloom.plans import bindings

    plan = lensing.potential_derivatives(bindings.kappa(spark, small), ["map_id"], 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3 and "collect_list" not in plan.split("FlatMapGroupsInPandas")[1]


@pytest.mark.parametrize("mode", ["reflect", "wrap"])
def test_smoothing_keeps_a_constant_and_the_sum(spark, strip, mode):
    a = np.random.default_rng(11).normal(size=(9, 9))
    sm = blocks.smooth(field(spark, [a, np.full((9, 9), 2.0)]), ["map_id"], 9, 1.3, mode)
    assert np.allclose(grid(sm, 9, "v", 1), 2.0)
    assert grid(sm, 9, "v").sum() == pytest.approx(a.sum())


def test_plane_spectrum_of_a_single_wave(spark):
    n, box = 16, 100.0
    x = np.arange(n)
    a = 1.0 + 0.1 * np.cos(2 * np.pi * 3 * x / n)[:, None] * np.ones(n)
    modes = spectra.mode_power(spectra.contrast(field(spark, [a]), ["map_id"]), ["map_id"], n)
    big = {(r.i, r.j) for r in modes.where(F.col("power") > 1e-6).collect()}
    assert big == {(3, 0), (n - 3, 0)}  # on the line of the half spectrum that holds both


def test_shear_round_trip_without_nyquist(spark):
    n = 15  # odd: no Nyquist line, so only the mean is lost
    a = np.random.default_rng(12).normal(size=(n, n))
    k = lensing.convergence_from_shear(lensing.shear_from_convergence(field(spark, [a]), ["map_id"], n), ["map_id"], n)
    assert np.allclose(grid(k, n, "kappa"), a - a.mean())


def test_potential_second_derivatives_add_up(spark):
    n = 15
    a = np.random.default_rng(13).normal(size=(n, n))
    p = lensing.potential_derivatives(field(spark, [a]), ["map_id"], n)
    trace = grid(p, n, "psi_xx") + grid(p, n, "psi_yy")
    ratio = trace / (a - a.mean())
    assert np.allclose(ratio, ratio[0, 0])


def flood_count(mask):
    seen, count = np.zeros_like(mask), 0
    for start in zip(*np.where(mask)):
        if seen[start]:
            continue
        count += 1
        stack = [start]
        while stack:
            i, j = stack.pop()
            if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not seen[i, j]:
                seen[i, j] = True
                stack += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return count


@pytest.mark.parametrize("lines", [1, 3, 256])
def test_regions_equal_flood_fill(spark, lines):
    rng = np.random.default_rng(14)
    maps = [rng.normal(size=(14, 14)) for _ in range(3)]
    snake = np.zeros((14, 14))  # one region that winds through all strips, and combs that meet in the last line only
    for i in range(14):
        snake[i, (0 if i % 4 == 3 else 13) if i % 2 else slice(None)] = 1.0
    comb = np.zeros((14, 14))
    comb[:, ::2] = comb[-1] = 1.0
    maps += [snake, comb, np.ones((14, 14))]
    th = [-0.8, 0.0, 0.8, 99.0]
    rows = images.region_counts(field(spark, maps), ["map_id"], th, lines).collect()
    assert len(rows) == 4 * len(maps)
    for r in rows:
        above = maps[r.map_id] > th[r.threshold_index]
        assert (r.n_above, r.n_below) == (flood_count(above), flood_count(~above))


def test_links_contract_to_least_members():
    rng = np.random.default_rng(19)
    for n, m in ((1, 0), (50, 30), (400, 390), (300, 299)):
        a, b = (rng.integers(0, n, m), rng.integers(0, n, m)) if n != 300 else (np.arange(299), np.arange(1, 300))
        least = regions.contracted(n, a, b)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert least.tolist() == want


def test_plateau_pixels_all_count_as_peaks(spark):
    a = np.zeros((6, 6))
    a[2, 2] = a[2, 3] = 5.0
    found = {(r.i, r.j) for r in images.extrema(field(spark, [a]), ["map_id"], 6, where=F.col("v") > 0).collect()}
    assert found == {(2, 2), (2, 3)}


def test_maps_with_nan_or_no_variance_are_left_out(spark):
    bad = np.ones((4, 4))
    nan = np.random.default_rng(15).normal(size=(4, 4))
    nan[1, 1] = np.nan
    good = np.arange(16.0).reshape(4, 4)
    kept = {r.map_id for r in images.valid_maps(field(spark, [bad, nan, good]), ["map_id"]).collect()}
    assert kept == {2}


def test_ensemble_counts_failures_by_reason(spark):
    good = np.arange(16.0).reshape(4, 4)
    nan = good.copy()
    nan[1, 1] = np.nan
    df = field(spark, [good, good + 1, nan, np.ones((4, 4)), good[:3], nan[:2]])
    faults = images.map_faults(df, ["map_id"], 4)
    assert {r.map_id: r.fault for r in faults.collect()} == {0: None, 1: None, 2: "not finite", 3: "constant", 4: "incomplete", 5: "incomplete"}
    model = F.when(F.col("map_id") == 5, "b").otherwise("a")
    values = spark.createDataFrame([("a", "peaks", 0, 1.0), ("a", "peaks", 0, 3.0), ("a", "pdf", 0, 2.0)], "model string, statistic string, bin int, value double")
    rows = {(r.model, r.statistic): r for r in images.ensemble(values, faults.withColumn("model", model)).collect()}
    a, none = rows["a", "peaks"], rows["b", None]
    assert (a["mean"], a["std"], a.n_success, a.n_failed, a.n_incomplete, a.n_not_finite, a.n_constant) == (2.0, 1.0, 2, 3, 1, 1, 1)
    assert none["mean"] is None and (none.n_success, none.n_failed, none.n_incomplete) == (0, 1, 1)


def stats_table(spark, values):
    rows = [(m, k, b, float(v)) for m, per in values.items() for k, vec in enumerate(per) for b, v in enumerate(vec)]
    return spark.createDataFrame(rows, "model string, realization int, bin int, value double")


def test_response_is_zero_for_dmo_and_one_for_hydro(spark):
    s = response.summarise(stats_table(spark, {"dmo": [[1, 2], [3, 4]], "hydro": [[5, 9], [7, 1]], "a": [[1, 2], [3, 4]], "b": [[5, 9], [7, 1]]}))
    f = {(r.model, r.bin): r.F for r in response.cumulative_response(s, response.baseline(s)).collect()}
    assert f[("a", 0)] == 0.0 and f[("a", 1)] == 0.0
    assert f[("b", 0)] == pytest.approx(1.0) and f[("b", 1)] == pytest.approx(1.0)


def test_responses_scan_the_statistics_once(spark, small):
    from fieldloom.plans import bindings

    s = response.summarise(bindings.stats(spark, small))
    one, joined = response.cumulative_response(s), response.cumulative_response(s, response.baseline(s))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(one) == 1 and scans(joined) == 3
    rows = lambda df: sorted(map(repr, df.select(*sorted(joined.columns)).collect()))
    assert rows(one) == rows(joined) and rows(one)


def test_vanishing_denominator_policies(spark):
    s = response.summarise(stats_table(spark, {"dmo": [[2.0]], "hydro": [[2.0]], "r": [[3.0]]}))
    base = response.baseline(s)
    value = lambda p: response.cumulative_response(s, base, policy=p).first().F
    assert value("null") is None and value("null_small") is None
    assert value("zero_relative") == 0.0 and value("zero_absolute") == 0.0


def test_multipoles_add_to_one(spark):
    df = spark.createDataFrame([(a, i, b, float(a + i + b + 1)) for a in range(3) for i in range(2) for b in range(4)], "mass_idx int, shell_idx int, bin int, dF double")
    for r in response.multipoles(df).groupBy("bin").agg(F.sum("mu").alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_model_names(spark):
    names = ["replace_Ml_1.00e12_Mu_inf_R_0.5", "replace_Ml_3.16e12_Mu_1.00e13_R_5.0", "dmo"]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    lo, hi, al = response.parse_model(F.col("model"))
    rows = {r.model: (r.lo, r.hi, r.al) for r in df.select("model", lo.alias("lo"), hi.alias("hi"), al.alias("al")).collect()}
    assert rows[names[0]] == (1e12, float("inf"), 0.5)
    assert rows[names[1]] == (3.16e12, 1e13, 5.0)
    assert rows["dmo"] == (None, None, None)


def test_noise_is_normal_and_repeatable(spark):
    flat = spark.range(3 * 64 * 64).selectExpr(
        "id div 4096 + 3000000000 * (id div 4096) as map_id", "cast(id div 64 % 64 as int) as i", "cast(id % 64 as int) as j", "1.0D as v"
    )
    noisy = [r.v for r in images.add_noise(flat, ["map_id"], 0.5, 7).orderBy("map_id", "i", "j").collect()]
    again = [r.v for r in images.add_noise(flat.repartition(5), ["map_id"], 0.5, 7).orderBy("map_id", "i", "j").collect()]
    z = (np.array(noisy) - 1) / 0.5
    assert noisy == again and len(set(noisy)) == len(noisy)
    assert abs(z.mean()) < 0.04 and abs(z.std() - 1) < 0.03 and abs((z**3).mean()) < 0.1 and abs((z**4).mean() - 3) < 0.25
    maps = z.reshape(3, 64, 64)
    for a, b in ((maps[:, :, 1:], maps[:, :, :-1]), (maps[:, 1:], maps[:, :-1]), (maps[1:], maps[:-1])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.05


def turned_by_hand(a, pull):
    """Every target cell on its own, from the eight cells around its place."""
    n, out = a.shape[0], np.zeros_like(a)
    mid = (n - 1) / 2
    for p in np.ndindex(a.shape):
        q = np.array(pull) @ (np.array(p) - mid) + mid
        if (q < -1e-12).any() or (q > n - 1 + 1e-12).any():
            continue
        low = np.clip(np.floor(q).astype(int), 0, n - 1)
        for t in np.ndindex(2, 2, 2):
            w = np.prod([f if x else 1 - f for f, x in zip(q - low, t)])
            if (low + t < n).all():
                out[p] += w * a[tuple(low + t)]
    return out


@pytest.mark.parametrize("width", [3, 32])
@pytest.mark.parametrize("pull", [cubes.about_axis(0, 25.0), cubes.about_axis(1, 40.0), cubes.about_axis(2, 200.0), cubes.about_vector((1, 2, 2), 30.0), cubes.about_vector((-1, 0.5, 3), 100.0)])
def test_rotated_cube_equals_cell_by_cell(spark, width, pull):
    n = 8
    a = np.random.default_rng(31).uniform(1, 2, size=(2, n, n, n))
    rows = [(m, i, j, k, float(a[m, i, j, k])) for m, i, j, k in np.ndindex(a.shape)]
    got = np.zeros_like(a)
    seen = cubes.rotate(spark.createDataFrame(rows, "m int, i int, j int, k int, mass double"), n, pull, ["m"], width=width).collect()
    for r in seen:
        got[r.m, r.i, r.j, r.k] = r.mass
    assert len({(r.m, r.i, r.j, r.k) for r in seen}) == len(seen)  # one block fills a cell
    for m in range(2):
        assert np.allclose(got[m], turned_by_hand(a[m], pull))


def test_cube_turned_back_and_shifted(spark):
    n = 6
    rows = [(1, 2, 3, 5.0), (1, 2, 3, 1.0), (0, 0, 0, None), (5, 0, 2, 2.0)]
    cells = spark.createDataFrame(rows, "i int, j int, k int, mass double")
    quarter = cubes.rotate(cells, n, [[0, 1, 0], [-1, 0, 0], [0, 0, 1]], width=4)
    assert sorted(tuple(r) for r in quarter.collect()) == [(3, 1, 3, 6.0), (5, 5, 2, 2.0)]
    back = cubes.rotate(quarter, n, [[0, -1, 0], [1, 0, 0], [0, 0, 1]], width=4)
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2, 3, 6.0), (5, 0, 2, 2.0)]
    assert {tuple(r) for r in cubes.roll(back, n, (1, -3, 4)).select("i", "j", "k", "mass").collect()} == {(2, 5, 1, 6.0), (0, 3, 0, 2.0)}
    assert cubes.rotate(cells.limit(0), n, cubes.about_axis(0, 10.0)).count() == 0

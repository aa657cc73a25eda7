"""Queries over map statistics, spectra and lensing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..constants import OMEGA_M, SPEED_OF_LIGHT, linspace, logspace
from ..functions import cosmology as cos
from ..operators import blocks, gridding, images, lensing, spectra, stats, windows
from . import bindings as b
from .bindings import R, bin_sql, cte, num, num_list, query, r
from .columns import CHI
from .grids import _tsc_sql, _cic_sql

N = b.MAP_SIDE
K = ["map_id"]
SIGMA = 1.0
RMS = 0.035
SNR = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0]
NEG = [-4.0, -3.0, -2.5, -2.0, -1.5, -1.0, -0.5, 0.0]
VALS = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15]
NVALS = [-0.15, -0.1, -0.08, -0.06, -0.04, -0.02, 0.0]
PDF = linspace(-0.1, 0.1, 21)
TH = [-0.06, -0.03, 0.0, 0.03, 0.06]


def smooth_sql(src: str = "kappa", mode: str = "reflect", sigma: float = SIGMA, n: int = N) -> str:
    w = blocks.gaussian_kernel(sigma)
    rad = len(w) // 2
    rows = ", ".join(f"({k - rad}, {num(v)})" for k, v in enumerate(w))
    refl = lambda e: f"(case when {e} < 0 then -1 - ({e}) when {e} >= {n} then {2 * n - 1} - ({e}) else {e} end)"
    pos = refl if mode == "reflect" else (lambda e: f"((({e}) + {n}) % {n})")
    return f"""ker(o, w) as (values {rows}),
 s1 as (select t.map_id, t.i, t.j, sum(q.v * w) as v from {src} t, ker, {src} q where q.map_id = t.map_id and q.j = t.j and q.i = {pos('t.i + o')} group by all),
 sm as (select t.map_id, t.i, t.j, sum(q.v * w) as v from s1 t, ker, s1 q where q.map_id = t.map_id and q.i = t.i and q.j = {pos('t.j + o')} group by all)"""


def ext_sql(fn: str, src: str = "sm", v: str = "v") -> str:
    return f"""e1 as (select *, {fn}({v}) over (partition by map_id, j order by i range between 1 preceding and 1 following) as m1 from {src}),
 ex as (select *, {fn}(m1) over (partition by map_id, i order by j range between 1 preceding and 1 following) as m from e1)"""


def border_sql(k: int, n: int = N) -> str:
    return f"i >= {k} and i < {n - k} and j >= {k} and j < {n - k}"


def hist_sql(src: str, value: str, edges, ids: str = "kappa") -> str:
    return f"""sp as (select map_id, cast(k as int) as bin from (select distinct map_id from {ids}), (select unnest(range({len(edges) - 1})) as k)),
 hb as (select map_id, {bin_sql(value, edges)} as bin, count(*) as n from {src} group by all), hh as (select sp.map_id, sp.bin, coalesce(n, 0) as n from sp left join hb using (map_id, bin))"""


_K = cte("kappa").rstrip()


@query("x08_smooth_reflect", _K + f", {smooth_sql()} select map_id, i, j, {R('v', 8)} as v from sm")
def _(spark, sf):
    return blocks.smooth(b.kappa(spark, sf), K, N, SIGMA).select("map_id", "i", "j", r("v", 8).alias("v"))


@query("x08_smooth_wrap", _K + f", {smooth_sql(mode='wrap')} select map_id, i, j, {R('v', 8)} as v from sm")
def _(spark, sf):
    return blocks.smooth(b.kappa(spark, sf), K, N, SIGMA, "wrap").select("map_id", "i", "j", r("v", 8).alias("v"))


_PK = f", {smooth_sql()}, {ext_sql('max')}, pk as (select * from ex where v = m and v > 0 and {border_sql(2)})"
_MN = f", {smooth_sql()}, {ext_sql('min')}, pk as (select * from ex where v = m and v < 0 and {border_sql(2)})"


@query("x09_peaks_snr", _K + _PK + f", {hist_sql('pk', f'(v / {num(RMS)})', SNR)} select * from hh")
def _(spark, sf):
    return images.peak_counts_snr(b.kappa(spark, sf), K, N, SNR, SIGMA, RMS)


@query("x09_peaks_value", _K + f", {smooth_sql()}, {ext_sql('max')}, pk as (select * from ex where v = m and v > 0.0 and {border_sql(2)}), {hist_sql('pk', 'v', VALS)} select * from hh")
def _(spark, sf):
    return images.peak_counts_value(b.kappa(spark, sf), K, N, VALS, SIGMA)


@query(
    "x09_peak_catalogue",
    _K + f", {smooth_sql()}, z as (select *, (v - avg(v) over (partition by map_id)) / stddev_pop(v) over (partition by map_id) as snr from sm), {ext_sql('max', 'z', 'snr')} select map_id, i, j, {R('v')} as v, {R('snr')} as snr from ex where snr = m and snr >= 0.5 and {border_sql(10)}",
)
def _(spark, sf):
    p = images.library_peaks(b.kappa(spark, sf), K, N, 0.5, SIGMA)
    return p.select("map_id", "i", "j", r("v").alias("v"), r("snr").alias("snr"))


@query("x09_peaks_plain", _K + f", {ext_sql('max', 'kappa')} select map_id, i, j, {R('v')} as v from ex where v = m and v > 0")
def _(spark, sf):
    return images.extrema(b.kappa(spark, sf), K, N, where=F.col("v") > 0).select("map_id", "i", "j", r("v").alias("v"))


@query("x10_minima_snr", _K + _MN + f", {hist_sql('pk', f'(v / {num(RMS)})', NEG)} select * from hh")
def _(spark, sf):
    return images.peak_counts_snr(b.kappa(spark, sf), K, N, NEG, SIGMA, RMS, "min")


@query("x10_minima_value", _K + f", {smooth_sql()}, {ext_sql('min')}, pk as (select * from ex where v = m and v >= {num(NVALS[0])} and v <= 0 and {border_sql(2)}), {hist_sql('pk', 'v', NVALS)} select * from hh")
def _(spark, sf):
    return images.peak_counts_value(b.kappa(spark, sf), K, N, NVALS, SIGMA, "min")


_W = f"({num_list(SNR)}[bin+2] - {num_list(SNR)}[bin+1])"


@query("x11_peak_errors", _K + _PK + f", {hist_sql('pk', f'(v / {num(RMS)})', SNR)} select map_id, bin, n, {R(f'n / 25.0::double / {_W}')} as counts, {R(f'sqrt(n) / 25.0::double / {_W}')} as errors from hh")
def _(spark, sf):
    c = images.count_errors(images.peak_counts_snr(b.kappa(spark, sf), K, N, SNR, SIGMA, RMS), SNR, 25.0)
    return c.select("map_id", "bin", "n", r("counts").alias("counts"), r("errors").alias("errors"))


_CLS = "case when map_id % 2 = 0 then 'a' else 'b' end"


@query(
    "x12_peak_ratio",
    _K + _PK + f", {hist_sql('pk', f'(v / {num(RMS)})', SNR)}, s as (select {_CLS} as cls, bin, sum(n) as n from hh group by all) select a.bin, cast(a.n as bigint) as n1, cast(c.n as bigint) as n2, {R('a.n / nullif(c.n, 0)::double')} as ratio, {R('a.n / nullif(c.n, 0)::double * sqrt(1 / nullif(a.n, 0)::double + 1 / nullif(c.n, 0)::double)')} as errors from s a join s c on a.bin = c.bin and a.cls = 'a' and c.cls = 'b'",
)
def _(spark, sf):
    c = images.peak_counts_snr(b.kappa(spark, sf), K, N, SNR, SIGMA, RMS)
    side = lambda k: c.where(F.col("map_id") % 2 == k).groupBy("bin").agg(F.sum("n").alias("n"))
    return images.count_ratio(side(0), side(1)).select("bin", "n1", "n2", r("ratio").alias("ratio"), r("errors").alias("errors"))


@query("x12_ensemble_counts", _K + _PK + f", {hist_sql('pk', f'(v / {num(RMS)})', SNR)} select bin, {R('avg(n)')} as mean, {R('stddev_pop(n) / sqrt(count(*))')} as error from hh group by all")
def _(spark, sf):
    c = images.peak_counts_snr(b.kappa(spark, sf), K, N, SNR, SIGMA, RMS)
    return stats.mean_and_error(c, ["bin"], "n").select("bin", r("mean").alias("mean"), r("error").alias("error"))


@query("x12_total_peaks", _K + _PK + f" select map_id, count(*) as n_peaks from pk where v / {num(RMS)} >= 1.0 group by all")
def _(spark, sf):
    sm = blocks.smooth(b.kappa(spark, sf), K, N, SIGMA)
    return images.extrema(sm, K, N, border=2, where=F.col("v") / RMS >= 1.0).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_peaks"))


@query("g29_peak_covariance", _K + _PK + f", {hist_sql('pk', f'(v / {num(RMS)})', SNR)} select a.bin as bin_a, c.bin as bin_b, {R('covar_samp(a.n, c.n)')} as cov from hh a join hh c using (map_id) group by all")
def _(spark, sf):
    c = stats.bin_covariance(images.peak_counts_snr(b.kappa(spark, sf), K, N, SNR, SIGMA, RMS), "map_id")
    return c.select("bin_a", "bin_b", r("cov").alias("cov"))


@query("w02_counts_above", _K + _PK + f", {hist_sql('pk', f'(v / {num(RMS)})', SNR)} select map_id, bin, cast(sum(n) over (partition by map_id order by bin desc) as bigint) as n_above from hh")
def _(spark, sf):
    c = images.peak_counts_snr(b.kappa(spark, sf), K, N, SNR, SIGMA, RMS)
    return windows.cumulative(c, K, "bin", "n", "n_above", reverse=True).select("map_id", "bin", "n_above")


@query(
    "g27_overdensity_moments",
    cte("particles").rstrip()
    + f""", {_tsc_sql('particles', 'x', 'y', 'sim', 16)}, m as (select *, avg(mass) over (partition by sim) as mu from grid), d as (select sim, mass / mu - 1 as d from m), c as (select *, d - avg(d) over (partition by sim) as e from d)
 select sim, {R('avg(e*e)')} as variance, {R('avg(e*e*e) / pow(avg(e*e), 1.5::double)')} as skewness, {R('avg(e*e*e*e) / pow(avg(e*e), 2) - 3')} as kurtosis from c group by all""",
)
def _(spark, sf):
    g = gridding.dense(gridding.assign(b.particles(spark, sf), ("x", "y"), 16, "tsc", ["sim"]), 16, ["sim"])
    d = spectra.contrast(g.withColumnRenamed("mass", "v"), ["sim"])
    return stats.moments(d, ["sim"], "v").select("sim", r("variance").alias("variance"), r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


_LOGD = linspace(-2.0, 2.0, 41)


@query(
    "g28_overdensity_pdf",
    cte("particles").rstrip()
    + f""", {_tsc_sql('particles', 'x', 'y', 'sim', N)}, m as (select *, sum(mass) over (partition by sim) / {N * N} as mu from grid), d as (select sim, log10(greatest(mass / mu, 1e-10::double)) as d from m),
 c as (select sim, {bin_sql('d', _LOGD)} as bin, count(*) as n from d group by all), t as (select sim, sum(n) as t from c where bin is not null group by all), sp as (select sim, cast(k as int) as bin from t, (select unnest(range(40)) as k))
 select sp.sim, sp.bin, {R(f'coalesce(n, 0) / (t * ({num_list(_LOGD)}[sp.bin+2] - {num_list(_LOGD)}[sp.bin+1]))')} as pdf from sp join t using (sim) left join c on c.sim = sp.sim and c.bin = sp.bin""",
)
def _(spark, sf):
    g = gridding.dense(gridding.assign(b.particles(spark, sf), ("x", "y"), N, "tsc", ["sim"]), N, ["sim"])
    d = spectra.contrast(g.withColumnRenamed("mass", "v"), ["sim"])
    d = d.withColumn("v", F.log10(F.greatest(F.col("v") + 1.0, F.lit(1e-10))))
    p = stats.density(stats.histogram(d, ["sim"], "v", _LOGD), ["sim"], _LOGD)
    return p.select("sim", "bin", r("pdf").alias("pdf"))


@query("g28_kappa_pdf", _K + f", {smooth_sql()}, inn as (select * from sm where {border_sql(5)}), {hist_sql('inn', 'v', PDF)} select map_id, bin, {R(f'n / (2916 * ({num_list(PDF)}[bin+2] - {num_list(PDF)}[bin+1]))')} as pdf from hh")
def _(spark, sf):
    return images.value_pdf(b.kappa(spark, sf), K, N, PDF, SIGMA).select("map_id", "bin", r("pdf").alias("pdf"))


_ZB = linspace(-3, 3, 25)


@query(
    "g28_normalised_pdf",
    _K + f""", z as (select *, (v - avg(v) over (partition by map_id)) / stddev_pop(v) over (partition by map_id) as snr from kappa), {hist_sql('z', 'snr', _ZB)}, t as (select map_id, sum(n) as t from hh group by all)
 select map_id, bin, {R(f'n / (t * ({num_list(_ZB)}[bin+2] - {num_list(_ZB)}[bin+1]))')} as pdf from hh join t using (map_id)""",
)
def _(spark, sf):
    z = images.standardise(b.kappa(spark, sf), K)
    return stats.density(stats.histogram(z, K, "snr", _ZB), K, _ZB).select("map_id", "bin", r("pdf").alias("pdf"))


_V01 = f"""inn as (select * from sm where {border_sql(5)}), th as (select unnest(range({len(TH)})) as ti, unnest({num_list(TH)}) as t),
 nb as (select *, lead(v) over (partition by map_id, i order by j) as rt, lead(v) over (partition by map_id, j order by i) as dn from inn),
 v01 as (select map_id, cast(ti as int) as threshold_index, t as threshold, sum(case when v > t then 1 else 0 end) / 2916.0::double as V0,
 sum(case when rt is not null and (v > t) <> (rt > t) then 1 else 0 end + case when dn is not null and (v > t) <> (dn > t) then 1 else 0 end) / 2916.0::double as V1 from nb, th group by all)"""


@query("x13_area_perimeter", _K + f", {smooth_sql()}, {_V01} select map_id, threshold_index, threshold, {R('V0')} as V0, {R('V1')} as V1 from v01")
def _(spark, sf):
    inner = blocks.smooth(b.kappa(spark, sf), K, N, SIGMA).where(images.interior(N, 5))
    v = images.area_and_perimeter(inner, K, TH)
    return v.select("map_id", "threshold_index", "threshold", r("V0").alias("V0"), r("V1").alias("V1"))


_RUNS = """px as (select map_id, ti, i, j, v > t as ab from inn, th), st as (select *, case when lag(ab) over w is distinct from ab then 1 else 0 end as nw from px window w as (partition by map_id, ti, i order by j)),
 rn as (select *, sum(nw) over (partition by map_id, ti, i order by j) as g from st), runs as (select map_id, ti, i, ab, g, min(j) as lo, max(j) as hi, i * 1000 + g as id from rn group by all),
 ed as (select a.map_id, a.ti, a.id as x, c.id as y from runs a join runs c on a.map_id = c.map_id and a.ti = c.ti and a.i + 1 = c.i and a.ab = c.ab and a.lo <= c.hi and c.lo <= a.hi),
 eb as (select map_id, ti, x, y from ed union all select map_id, ti, y, x from ed),
 lab as (select map_id, ti, id, id as l, 0 as it from runs union all
  select map_id, ti, id, min(l), it from (select q.map_id, q.ti, q.id, q.l, q.it + 1 as it from lab q union all select e.map_id, e.ti, e.y, q.l, q.it + 1 from lab q join eb e on e.map_id = q.map_id and e.ti = q.ti and e.x = q.id) where it <= 120 group by map_id, ti, id, it),
 fin as (select map_id, ti, id, min(l) as l from lab group by all), cnt as (select f.map_id, f.ti, count(distinct case when ab then l end) as na, count(distinct case when not ab then l end) as nb from fin f join runs using (map_id, ti, id) group by all)"""


@query(
    "x13_minkowski",
    _K.replace("with ", "with recursive ", 1) + f", {smooth_sql()}, {_V01}, {_RUNS} select v.map_id, v.threshold_index, v.threshold, {R('V0')} as V0, {R('V1')} as V1, {R('(case when nb > 0 then na - (nb - 1) else na end) / 2916.0::double', 8)} as V2 from v01 v join cnt c on c.map_id = v.map_id and c.ti = v.threshold_index",
)
def _(spark, sf):
    m = images.minkowski(b.kappa(spark, sf), K, N, TH, SIGMA)
    return m.select("map_id", "threshold_index", "threshold", r("V0").alias("V0"), r("V1").alias("V1"), r("V2", 8).alias("V2"))


@query("x17_map_summary", _K + f" select map_id, {R('avg(v)', 8)} as mean, {R('stddev_pop(v)', 8)} as std, {R('min(v)')} as lo, {R('max(v)')} as hi, count(v) as n from kappa group by all")
def _(spark, sf):
    s = images.summary(b.kappa(spark, sf), K)
    return s.select("map_id", r("mean", 8).alias("mean"), r("std", 8).alias("std"), r("lo").alias("lo"), r("hi").alias("hi"), "n")


@query(
    "x17_normalised_map",
    _K + f" select map_id, i, j, {R('(v - avg(v) over (partition by map_id)) / stddev_pop(v) over (partition by map_id)')} as snr from kappa",
)
def _(spark, sf):
    return images.standardise(b.kappa(spark, sf), K).select("map_id", "i", "j", r("snr").alias("snr"))


def _unit_sql(src: str, name: str, seed: int) -> str:
    """CTEs that add column ``name``, a number in (0, 1) from map, row and column, to ``src``; the last one is called ``name`` too."""
    p = 2147483647
    steps, last = [], f"(select *, {seed}::bigint as h from {src})"
    for k, c in enumerate(("map_id", "i", "j")):
        part = f"(({c}::bigint % {p} + ({c}::bigint // {p}) % {p} * 40692) % {p})"
        steps.append(f"{name}{k}a as (select * replace ((h * 48271 + {part} * 16807 + 12345) % {p} as h) from {last})")
        steps.append(f"{name}{k} as (select * replace ((h * ((h + 69621) % {p})) % {p} as h) from {name}{k}a)")
        last = f"{name}{k}"
    steps.append(f"{name} as (select * exclude (h), ((h * ((h + 40692) % {p})) % {p} + 0.5::double) / {p}::double as {name} from {last})")
    return ", ".join(steps)


@query(
    "x16_noise",
    _K
    + f", {_unit_sql('kappa', 'ua', 2020)}, {_unit_sql('ua', 'ub', 1002023)}, noisy as (select map_id, v + 0.3::double * (sqrt(-2::double * ln(ua)) * cos({num(2 * math.pi)} * ub)) as v from ub)"
    + f" select map_id, {R('avg(v)', 8)} as mean, {R('stddev_pop(v)', 8)} as std, count(v) as n from noisy group by all",
)
def _(spark, sf):
    noisy = images.add_noise(b.kappa(spark, sf), K, 0.3, 2020)
    return images.summary(noisy, K).select("map_id", r("mean", 8).alias("mean"), r("std", 8).alias("std"), "n")


# --- spectra ---------------------------------------------------------------------


def dft_sql(src: str, key: str, n: int, v: str = "v", inverse: bool = False, im: str | None = None, out: str = "ft") -> str:
    """Discrete Fourier transform as two joins with a table of roots of unity."""
    sg = "-" if not inverse else "+"
    op = "+" if not inverse else "-"
    imag = im or "0::double"
    scale = f" / {num(n)}" if inverse else ""
    return f"""{out}_tw as (select m, cos(2 * pi() * m / {n}) as c, sin(2 * pi() * m / {n}) as s from (select unnest(range({n})) as m)), {out}_k as (select unnest(range({n})) as k),
 {out}1 as (select {key}, q.i, k as kj, sum({v} * c {op} {imag} * s){scale} as re, sum({imag} * c {sg} {v} * s){scale} as im from {src} q, {out}_k, {out}_tw where m = (q.j * k) % {n} group by all),
 {out} as (select {key}, cast(k as int) as i, cast(kj as int) as j, sum(re * c {op} im * s){scale} as re, sum(im * c {sg} re * s){scale} as im from {out}1 q, {out}_k, {out}_tw where m = (q.i * k) % {n} group by all)"""


def mode_sql(c: str, n: int) -> str:
    return f"(case when {c} < {(n + 1) // 2} then {c} else {c} - {n} end)"


def radial_sql(key: str, n: int, unit: float, edges, norm: float, digits: int, src: str = "ft") -> str:
    m2 = f"({mode_sql('i', n)}*{mode_sql('i', n)} + {mode_sql('j', n)}*{mode_sql('j', n)})"
    return f"""select {key}, bin, {R(f'avg(p) * {num(norm)}', digits)} as power, count(*) as n_modes from (select {key}, {bin_sql('k', edges, 'left')} as bin, p from (select {key}, sqrt({m2}::double) * {num(unit)} as k, re*re + im*im as p from {src})) where bin is not null group by all"""


def _spec(df, keys, digits):
    return df.select(*keys, "bin", r("power", digits).alias("power"), "n_modes")


_SIDE = math.radians(5.0)


@query(
    "x01_angular_spectrum",
    _K + f", c as (select map_id, i, j, v - avg(v) over (partition by map_id) as v from kappa), {dft_sql('c', 'map_id', N)} {radial_sql('map_id', N, 2 * math.pi / _SIDE, spectra.ELL_EDGES, (_SIDE / N) ** 2, 10)}",
)
def _(spark, sf):
    return _spec(spectra.angular_spectrum(b.kappa(spark, sf), K, N), K, 10)


_KB = logspace(math.log10(2 * math.pi / 205.0), math.log10(math.pi * N / 205.0), 31)
_GRID = cte("particles").rstrip() + f", {_tsc_sql('particles', 'x', 'y', 'sim', N)}"


def _grid(spark, sf, n=N):
    g = gridding.dense(gridding.assign(b.particles(spark, sf), ("x", "y"), n, "tsc", ["sim"]), n, ["sim"])
    return g.withColumnRenamed("mass", "v")


@query(
    "x01_plane_spectrum",
    _GRID + f", c as (select sim, i, j, mass / (sum(mass) over (partition by sim) / {N * N}) as v from grid), {dft_sql('c', 'sim', N)} {radial_sql('sim', N, 2 * math.pi / 205.0, _KB, (205.0 / N) ** 2, 4)}",
)
def _(spark, sf):
    return _spec(spectra.plane_spectrum(_grid(spark, sf), ["sim"], N), ["sim"], 4)


_PIX = 300.0 / N
_U2 = 2 * math.pi * 180 * 60 / math.pi / (N * _PIX)


@query(
    "x02_spectrum_linear_ell",
    _K + f", {dft_sql('kappa', 'map_id', N)} {radial_sql('map_id', N, _U2, linspace(0, math.sqrt(2.0) * (N // 2) * _U2, 51), math.radians(_PIX / 60) ** 2 / (N * N), 10)}",
)
def _(spark, sf):
    return _spec(spectra.spectrum_linear_ell(b.kappa(spark, sf), K, N, _PIX), K, 10)


_N3 = 16


def _dft3_sql(src: str, n: int) -> str:
    step = lambda a, t, o, rest: f"{o} as (select sim, {rest}, cast(k as int) as {a}, sum(re * c + im * s) as re, sum(im * c - re * s) as im from {t} q, kk, tw where m = (q.{a} * k) % {n} group by all)"
    return f"""tw as (select m, cos(2 * pi() * m / {n}) as c, sin(2 * pi() * m / {n}) as s from (select unnest(range({n})) as m)), kk as (select unnest(range({n})) as k),
 {step('k', src, 't1', 'i, j').replace('cast(k as int) as k', 'cast(kk.k as int) as k').replace('q.k * k', 'q.k * kk.k')}, {step('j', 't1', 't2', 'i, q.k').replace('cast(k as int)', 'cast(kk.k as int)').replace('q.j * k', 'q.j * kk.k')}, {step('i', 't2', 'ft', 'j, q.k').replace('cast(k as int)', 'cast(kk.k as int)').replace('q.i * k', 'q.i * kk.k')}"""


_M3 = " + ".join(f"{mode_sql(c, _N3)}*{mode_sql(c, _N3)}" for c in ("i", "j", "k"))
_E3 = [float(m) for m in range(1, math.ceil(math.sqrt(3.0) * (_N3 // 2)))]


@query(
    "x03_spectrum_3d",
    cte("particles").rstrip()
    + f""", {_cic_sql('particles', ['x', 'y', 'z'], 'sim', _N3)}, src as (select sim, i, j, k, mass / (sum(mass) over (partition by sim) / {_N3**3}) as re, 0::double as im from grid), {_dft3_sql('src', _N3)}
 select sim, bin, {R(f'avg(p) * {num((205.0 / _N3) ** 3)}', 2)} as power, count(*) as n_modes from (select sim, {bin_sql('k2', _E3, 'left')} as bin, p from (select sim, sqrt(({_M3})::double) as k2, re*re + im*im as p from ft)) where bin is not null group by all""",
)
def _(spark, sf):
    return _spec(spectra.particle_spectrum_3d(b.particles(spark, sf), ["sim"], _N3), ["sim"], 2)


@query("x04_spectrum_linear_k", _GRID + f", {dft_sql('grid', 'sim', N, 'mass')} {radial_sql('sim', N, 1.0, linspace(0, (N - 1) // 2, 50), (205.0 / N) ** 2, 1)}")
def _(spark, sf):
    return _spec(spectra.spectrum_linear_k(_grid(spark, sf), ["sim"], N), ["sim"], 1)


_GAP = "g as (select map_id, i, j, case when (i * 7 + j) % 13 = 0 then null else v end as v from kappa)"


@query(
    "x04_spectrum_filled_gaps",
    _K + f", {_GAP}, c as (select map_id, i, j, coalesce(v, avg(v) over (partition by map_id)) - avg(v) over (partition by map_id) as v from g), {dft_sql('c', 'map_id', N)} {radial_sql('map_id', N, 2 * math.pi / _SIDE, spectra.ELL_EDGES, (_SIDE / N) ** 2, 10)}",
)
def _(spark, sf):
    gap = F.when((F.col("i") * 7 + F.col("j")) % 13 == 0, F.lit(float("nan"))).otherwise(F.col("v"))
    m = images.fill_missing_with_mean(b.kappa(spark, sf).withColumn("v", gap), K)
    return _spec(spectra.angular_spectrum(m, K, N), K, 10)


_JN = 32


def _jack_spec(src: str, key: str, name: str, v: str) -> str:
    """P(k) of an overdensity in SQL under the given name."""
    kb = logspace(math.log10(2 * math.pi / 205.0), math.log10(math.pi * _JN / 205.0), 31)
    m2 = f"({mode_sql('i', _JN)}*{mode_sql('i', _JN)} + {mode_sql('j', _JN)}*{mode_sql('j', _JN)})"
    return f"""{dft_sql(src, key, _JN, v, out=name + '_ft')}, {name} as (select {key}, bin, avg(p) * {num((205.0 / _JN) ** 2)} as power, count(*) as n_modes from (select {key}, {bin_sql('k', kb, 'left')} as bin, p from
 (select {key}, sqrt({m2}::double) * {num(2 * math.pi / 205.0)} as k, re*re + im*im as p from {name}_ft)) where bin is not null group by all)"""


@query(
    "g25_jackknife_spectrum",
    cte("particles").rstrip()
    + f""", {_tsc_sql('particles', 'x', 'y', 'sim', _JN)}, g2 as (select *, avg(mass) over (partition by sim) as mu from grid), f as (select sim, i, j, mass / mu - 1 as v from g2), {_jack_spec('f', 'sim', 'fs', 'v')},
 pm as (select sim, patch, i, j, case when (i // 8) * 4 + j // 8 = patch then mu else mass end as w from g2, (select unnest(range(16)) as patch)), pd as (select sim, patch, i, j, w / avg(w) over (partition by sim, patch) - 1 as v from pm), {_jack_spec('pd', 'sim, patch', 'ps', 'v')},
 er as (select sim, bin, sqrt(var_pop(power) * 15) as error from ps group by all) select sim, bin, {R('power', 4)} as power, {R('error', 4)} as error, n_modes from fs join er using (sim, bin)""",
)
def _(spark, sf):
    j = spectra.jackknife_spectrum(_grid(spark, sf, 32), ["sim"], 32, 4)
    return j.select("sim", "bin", r("power", 4).alias("power"), r("error", 4).alias("error"), "n_modes")


_ENSEMBLE = {"power": ("x01_angular_spectrum", "power"), "peaks": ("x09_peaks_snr", "n"), "minima": ("x10_minima_snr", "n"), "pdf": ("g28_kappa_pdf", "pdf")}
_MODEL = "case map_id % 3 when 0 then 'dmo' when 1 then 'hydro' else 'replace' end"


@query(
    "q10_ensemble_with_failures",
    f"""with vals as ({" union all ".join(f"select map_id, '{k}' as statistic, bin, cast({c} as double) as value from ({b.ORACLES[q]}) as s_{k}" for k, (q, c) in _ENSEMBLE.items())}),
 fl as (select vec_id // 64 as map_id, case when count(*) < 64 then 'incomplete' when max(case when (vec_id // 64) % 3 = 0 and vec_id % 64 = 0 then 1 else 0 end) = 1 then 'not finite' when any_value((vec_id // 64) % 5) = 1 then 'constant' end as fault from embeddings group by all),
 runs as (select {_MODEL} as model, count(*) filter (fault is null) as n_success, count(fault) as n_failed, count(*) filter (fault = 'incomplete') as n_incomplete, count(*) filter (fault = 'not finite') as n_not_finite, count(*) filter (fault = 'constant') as n_constant from fl group by all),
 sums as (select {_MODEL} as model, statistic, bin, avg(value) as mean, stddev_pop(value) as std from vals where map_id in (select map_id from fl where fault is null) group by all)
 select model, n_success, n_failed, n_incomplete, n_not_finite, n_constant, statistic, bin, {R('mean', 11)} as mean, {R('std', 11)} as std from runs left join sums using (model)""",
)
def _(spark, sf):
    """Maps as they were read: lines that are absent stay absent, one pixel of some is NaN, some are constant."""
    raw = b.kappa_lines(spark, sf).select("map_id", "i", F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    broken = F.when((F.col("map_id") % 3 == 0) & (F.col("i") == 0) & (F.col("j") == 0), F.lit(float("nan")))
    raw = raw.withColumn("v", broken.when(F.col("map_id") % 5 == 1, F.lit(0.5)).otherwise(F.col("v")))
    faults = images.map_faults(raw, K, N)
    good = b.kappa(spark, sf).join(faults.where(F.col("fault").isNull()), K, "left_semi")
    long = lambda df, k, c: df.select("map_id", F.lit(k).alias("statistic"), "bin", F.col(c).cast("double").alias("value"))
    parts = [
        long(_spec(spectra.angular_spectrum(good, K, N), K, 10), "power", "power"),
        long(images.peak_counts_snr(good, K, N, SNR, SIGMA, RMS), "peaks", "n"),
        long(images.peak_counts_snr(good, K, N, NEG, SIGMA, RMS, "min"), "minima", "n"),
        long(images.value_pdf(good, K, N, PDF, SIGMA).select("map_id", "bin", r("pdf").alias("pdf")), "pdf", "pdf"),
    ]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    e = images.ensemble(values.withColumn("model", F.expr(_MODEL)), faults.withColumn("model", F.expr(_MODEL)))
    return e.select("model", "n_success", "n_failed", "n_incomplete", "n_not_finite", "n_constant", "statistic", "bin", r("mean", 11).alias("mean"), r("std", 11).alias("std"))  # half units of rounded bins are no ties at eleven digits


# --- lensing ---------------------------------------------------------------------

_KU = 2 * math.pi / 205.0
_KX, _KY = f"({mode_sql('i', N)} * {num(_KU)})", f"({mode_sql('j', N)} * {num(_KU)})"
_PRE = f"(case when i = 0 and j = 0 then 0::double else {num(3 * OMEGA_M * (100.0 / SPEED_OF_LIGHT) ** 2)} / ({_KX}*{_KX} + {_KY}*{_KY}) end)"
_FIVE = f"""five as (select map_id, 'psi_x' as field, i, j, -{_KX} * {_PRE} * im as re, {_KX} * {_PRE} * re as im from ft union all select map_id, 'psi_y', i, j, -{_KY} * {_PRE} * im, {_KY} * {_PRE} * re from ft
 union all select map_id, 'psi_xx', i, j, {_KX}*{_KX} * {_PRE} * re, {_KX}*{_KX} * {_PRE} * im from ft union all select map_id, 'psi_xy', i, j, {_KX}*{_KY} * {_PRE} * re, {_KX}*{_KY} * {_PRE} * im from ft union all select map_id, 'psi_yy', i, j, {_KY}*{_KY} * {_PRE} * re, {_KY}*{_KY} * {_PRE} * im from ft)"""
_P5 = ["psi_x", "psi_y", "psi_xx", "psi_xy", "psi_yy"]


@query(
    "x05_potential_derivatives",
    _K + f", {dft_sql('kappa', 'map_id', N)}, {_FIVE}, {dft_sql('five', 'map_id, field', N, 're', True, 'im', 'bk')} select map_id, i, j, "
    + ", ".join(f"{R(chr(39).join(['max(case when field = ', f, ' then re end) * 1e6']), 6)} as {f}" for f in _P5)
    + " from bk group by all",
)
def _(spark, sf):
    p = lensing.potential_derivatives(b.kappa(spark, sf), K, N)
    return p.select("map_id", "i", "j", *[r(F.col(f) * 1e6).alias(f) for f in _P5])


_LX, _LY = mode_sql("j", N), mode_sql("i", N)
_L2 = f"nullif({_LX}*{_LX} + {_LY}*{_LY}, 0)::double"
_D1, _D2 = f"coalesce(({_LX}*{_LX} - {_LY}*{_LY}) / {_L2}, 0)", f"coalesce(2 * {_LX} * {_LY} / {_L2}, 0)"
_GAMMA = f"gm as (select map_id, 'gamma1' as field, i, j, {_D1} * re as re, {_D1} * im as im from ft union all select map_id, 'gamma2', i, j, {_D2} * re, {_D2} * im from ft)"


@query(
    "x06_shear",
    _K + f", {dft_sql('kappa', 'map_id', N)}, {_GAMMA}, {dft_sql('gm', 'map_id, field', N, 're', True, 'im', 'bk')} select map_id, i, j, {R(chr(39).join(['max(case when field = ', 'gamma1', ' then re end)']))} as gamma1, {R(chr(39).join(['max(case when field = ', 'gamma2', ' then re end)']))} as gamma2 from bk group by all",
)
def _(spark, sf):
    s = lensing.shear_from_convergence(b.kappa(spark, sf), K, N)
    return s.select("map_id", "i", "j", r("gamma1").alias("gamma1"), r("gamma2").alias("gamma2"))


@query(
    "x06_convergence_round_trip",
    _K
    + f""", {dft_sql('kappa', 'map_id', N)}, {_GAMMA}, {dft_sql('gm', 'map_id, field', N, 're', True, 'im', 'bk')}, {dft_sql('bk', 'map_id, field', N, 're', out='f2')},
 kk as (select map_id, i, j, sum((case field when 'gamma1' then {_D1} else {_D2} end) * re) as re, sum((case field when 'gamma1' then {_D1} else {_D2} end) * im) as im from f2 group by all), {dft_sql('kk', 'map_id', N, 're', True, 'im', 'b2')} select map_id, i, j, {R('re')} as kappa from b2""",
)
def _(spark, sf):
    s = lensing.shear_from_convergence(b.kappa(spark, sf), K, N)
    return lensing.convergence_from_shear(s, K, N).select("map_id", "i", "j", r("kappa").alias("kappa"))


_TAPS = ", ".join(f"({a}, {c}, {num(w)})" for a, c, w in lensing.aperture_kernel(6.0))


@query(
    "x07_aperture_mass",
    _K + f", tp(di, dj, w) as (values {_TAPS}) select map_id, cast((i + di + 64) % 64 as int) as i, cast((j + dj + 64) % 64 as int) as j, {R('sum(v * w)', 7)} as m_ap from kappa, tp group by all",
)
def _(spark, sf):
    return lensing.aperture_mass(b.kappa(spark, sf), K, N, 6.0, 1.0).select("map_id", "i", "j", r("m_ap", 7).alias("m_ap"))


_ZS = 1.0
_WEIGHT = lambda z: f"{num(1.5 * OMEGA_M * (100.0 / SPEED_OF_LIGHT) ** 2 * 102.5)} * (case when {CHI(z)} < {CHI('1.0::double')} then {CHI(z)} * ({CHI('1.0::double')} - {CHI(z)}) / {CHI('1.0::double')} else 0 end) * (1 + {z})"


@query("x15_lensing_weights", cte("redshifts") + f"select z, n_orders, {R('(' + _WEIGHT('z') + ') * 1000', 6)} as weight from redshifts where z < 1.0")
def _(spark, sf):
    z = b.redshifts(spark, sf).where(F.col("z") < _ZS)
    w = cos.lensing_weight(F.col("z"), F.lit(_ZS), 102.5)
    return z.select("z", "n_orders", r(w * 1000.0).alias("weight"))


# every map is one plane of the light cone; its redshift follows from its number
_PLZ = "pz as (select distinct map_id as plane, (map_id % 40 + 1) * 0.025::double as z from kappa)"


@query(
    "x14_born_convergence",
    _K + f", {_PLZ}, w as (select plane, {_WEIGHT('z')} as weight from pz where z < 1.0) select i, j, {R('sum(weight * v) * 1000', 6)} as kappa from kappa join w on w.plane = map_id group by all",
)
def _(spark, sf):
    k = b.kappa(spark, sf).withColumnRenamed("map_id", "plane")
    z = k.select("plane").distinct().withColumn("z", (F.col("plane") % 40 + 1) * 0.025).where(F.col("z") < _ZS)
    # plane redshifts are few and shared by many planes
    w = z.withColumn("weight", cos.lensing_weight(F.col("z"), F.lit(_ZS), 102.5)).select("plane", "weight")
    out = lensing.born_convergence(k, w, [], "v")
    return out.select("i", "j", r(F.col("kappa") * 1000.0).alias("kappa"))


@query(
    "s11_valid_maps",
    _K + f", t as (select map_id, case when map_id % 3 = 0 and i = 0 and j = 0 then null when map_id % 5 = 1 then 0.5::double else v end as v from kappa) select map_id, count(*) as n from t group by all having count(v) = count(*) and max(v) > min(v)",
)
def _(spark, sf):
    # two kinds of broken maps are made: one with a NaN pixel, one constant
    k = b.kappa(spark, sf)
    broken = F.when((F.col("map_id") % 3 == 0) & (F.col("i") == 0) & (F.col("j") == 0), F.lit(float("nan")))
    k = k.withColumn("v", broken.when(F.col("map_id") % 5 == 1, F.lit(0.5)).otherwise(F.col("v")))
    return images.valid_maps(k, K).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))

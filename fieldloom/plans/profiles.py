"""Queries over radial profiles, enclosed masses, stacks and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MASS_BIN_EDGES, RADIAL_EDGES, REPLACE_MASS_BINS, STATS_RADII, logspace
from ..functions.bins import bin_index, bin_table, with_bin, with_spine
from ..operators import profiles as prof
from ..operators import stats, windows
from ..operators.ordering import exact_quantiles
from ..sources.tables import read_table
from . import bindings as b
from .bindings import R, bin_sql, cte, num, num_list, query, r

N_RAD = len(RADIAL_EDGES) - 1
WIDE_EDGES = logspace(-2, 0.6989700043360189, 26)
LIB_EDGES = logspace(-2, 0.6989700043360189, 51)
DENS = 4.0 / 3.0 * 3.141592653589793


def _vol(edges: str, k: str, r200: str = "r200") -> str:
    lo, hi = f"{edges}[{k}+1]", f"{edges}[{k}+2]"
    return f"({num(DENS)} * {r200} * {r200} * {r200} * ({hi}*{hi}*{hi} - {lo}*{lo}*{lo}))"


_TYPES = """sum(mass) as mass, count(*) as n, sum(case when ptype = 0 then mass else 0::double end) as mass_gas,
 sum(case when ptype = 1 then mass else 0::double end) as mass_dm, sum(case when ptype = 4 then mass else 0::double end) as mass_stars"""


def _profile_sql(edges, side="hist", name="prof", where="true") -> str:
    return f"""{name} as (select * from (select halo_id, r200, log_mass, sim, {bin_sql('r', edges, side)} as bin, {_TYPES} from pairs where {where} group by all) where bin is not null)"""


def _profile(spark, sf, edges=RADIAL_EDGES, side="hist", keys=("halo_id", "r200", "log_mass"), by="sim"):
    return prof.ball_profile(b.particles(spark, sf), b.halos(spark, sf), b.REACH, b.MAX_R200 * b.REACH, edges, side, keys, by)


@query(
    "g01_radial_profile",
    cte("pairs").rstrip()
    + f""", {_profile_sql(RADIAL_EDGES)} select halo_id, sim, bin, mass, n, mass_gas, mass_dm, mass_stars, {R('mass / ' + _vol(num_list(RADIAL_EDGES), 'bin'))} as density from prof""",
)
def _(spark, sf):
    p = prof.add_density(_profile(spark, sf))
    return p.select("halo_id", "sim", "bin", "mass", "n", "mass_gas", "mass_dm", "mass_stars", r("density").alias("density"))


@query(
    "g02_library_profile",
    cte("pairs").rstrip()
    + f""", {_profile_sql(LIB_EDGES)} select halo_id, sim, bin, mass, {R(f"sqrt({num_list(LIB_EDGES)}[bin+1] * {num_list(LIB_EDGES)}[bin+2])", 8)} as r_mid,
 {R('mass / ' + _vol(num_list(LIB_EDGES), 'bin'))} as density, sum(mass) over (partition by halo_id, sim order by bin) as enclosed from prof""",
)
def _(spark, sf):
    p = _profile(spark, sf, LIB_EDGES)
    p = prof.add_density(windows.cumulative(p, ["halo_id", "sim"], "bin", "mass", "enclosed"), LIB_EDGES)
    return p.select("halo_id", "sim", "bin", "mass", r(F.sqrt(F.col("lo") * F.col("hi")), 8).alias("r_mid"), r("density").alias("density"), "enclosed")


@query(
    "g03_paired_profile",
    cte("pairs", "halos").rstrip()
    + f""", {_profile_sql(WIDE_EDGES, 'left')}, spine as (select halo_id, cast(k as int) as bin from halos, (select unnest(range(25)) as k))
 select s.halo_id, s.bin, coalesce(d.mass, 0) as m_dmo, coalesce(h.mass, 0) as m_hydro, coalesce(h.mass_gas, 0) as m_gas, coalesce(h.mass_stars, 0) as m_stars, coalesce(h.mass_dm, 0) as m_dm
 from spine s left join (select * from prof where sim = 'dmo') d on d.halo_id = s.halo_id and d.bin = s.bin
 left join (select * from prof where sim = 'hydro') h on h.halo_id = s.halo_id and h.bin = s.bin""",
)
def _(spark, sf):
    pick = lambda sim, m, nm: F.sum(F.when(F.col("sim") == sim, F.col(m)).otherwise(F.lit(0.0))).alias(nm)
    one_pass = _profile(spark, sf, WIDE_EDGES, "left", ("halo_id",)).groupBy("halo_id", "bin").agg(
        pick("dmo", "mass", "m_dmo"),
        pick("hydro", "mass", "m_hydro"),
        pick("hydro", "mass_gas", "m_gas"),
        pick("hydro", "mass_stars", "m_stars"),
        pick("hydro", "mass_dm", "m_dm"),
    )
    return prof.full_bins(one_pass, b.halos(spark, sf), 25, ["m_dmo", "m_hydro", "m_gas", "m_stars", "m_dm"])


@query(
    "g04_profile_variants",
    cte("pairs").rstrip()
    + f""", {_profile_sql(WIDE_EDGES, 'left', 'a')}, {_profile_sql(WIDE_EDGES, 'right', 'c')}
 select 'half_open' as variant, halo_id, sim, bin, mass as shell_mass, {R('mass / ' + _vol(num_list(WIDE_EDGES), 'bin'))} as density from a
 union all select 'right_closed_r200_units', halo_id, sim, bin, mass, {R('mass / ' + _vol(num_list(WIDE_EDGES), 'bin', '1::double'))} from c""",
)
def _(spark, sf):
    cols = ["halo_id", "sim", "bin", F.col("mass").alias("shell_mass"), r("density").alias("density")]
    a = prof.add_density(_profile(spark, sf, WIDE_EDGES, "left"), WIDE_EDGES).select(F.lit("half_open").alias("variant"), *cols)
    c = prof.add_density(_profile(spark, sf, WIDE_EDGES, "right"), WIDE_EDGES, physical=False)
    return a.unionByName(c.select(F.lit("right_closed_r200_units").alias("variant"), *cols))


_WITHIN = f"""w as (select halo_id, log_mass, sim, rad as radius, sum(mass) as m_total, sum(case when ptype = 0 then mass else 0::double end) as m_gas,
 sum(case when ptype = 4 then mass else 0::double end) as m_stellar, sum(case when ptype = 1 then mass else 0::double end) as m_dm, count(*) as n_part
 from pairs, (select unnest({num_list(STATS_RADII)}) as rad) where r <= rad group by all)"""


def _within(spark, sf, keys=("halo_id", "log_mass"), by="sim", **kw):
    return prof.ball_masses(b.particles(spark, sf), b.halos(spark, sf), b.REACH, b.MAX_R200 * b.REACH, keys=keys, by=by, **kw)


@query(
    "g05_masses_within",
    cte("pairs").rstrip()
    + f""", {_WITHIN} select halo_id, sim, radius, m_total, m_gas, m_stellar, m_dm, n_part, {R('(m_gas + m_stellar) / m_total')} as f_baryon, {R('m_gas / m_total')} as f_gas, {R('m_stellar / m_total')} as f_stellar from w""",
)
def _(spark, sf):
    return _within(spark, sf).select(
        "halo_id", "sim", "radius", "m_total", "m_gas", "m_stellar", "m_dm", "n_part",
        *[r(c).alias(c) for c in ("f_baryon", "f_gas", "f_stellar")],
    )


_BOTH = """(select * from w where sim = 'dmo') d full join (select * from w where sim = 'hydro') h on d.halo_id = h.halo_id and d.radius = h.radius"""


@query(
    "g06_mass_conservation",
    cte("pairs").rstrip()
    + f""", {_WITHIN} select coalesce(d.halo_id, h.halo_id) as halo_id, coalesce(d.radius, h.radius) as radius,
 {R('case when d.m_total > 0 then coalesce(h.m_total, 0::double) / d.m_total else 0::double end')} as ratio_total, {R('case when d.m_dm > 0 then coalesce(h.m_dm, 0::double) / d.m_dm else 0::double end')} as ratio_dm from {_BOTH}""",
)
def _(spark, sf):
    w = _within(spark, sf)
    c = prof.mass_conservation(w.where(F.col("sim") == "dmo"), w.where(F.col("sim") == "hydro"))
    return c.select("halo_id", "radius", r("ratio_total").alias("ratio_total"), r("ratio_dm").alias("ratio_dm"))


@query(
    "g07_enclosed_mass",
    cte("pairs").rstrip() + f""", {_WITHIN} select halo_id, radius, sum(m_total) as m_enclosed from w group by all""",
)
def _(spark, sf):
    w = _within(spark, sf, ("halo_id",), None)
    return w.select("halo_id", "radius", F.col("m_total").alias("m_enclosed"))


_INTERP = f"""c as (select halo_id, sim, r, mass, sum(mass) over (partition by halo_id, sim order by r, mass rows unbounded preceding) as cum from pairs),
rad as (select unnest({num_list(STATS_RADII)}) as radius),
lo as (select halo_id, sim, radius, max(r) as ra, max(cum) as ma from c, rad where r <= radius group by all),
hi as (select halo_id, sim, radius, min(r) as rb, arg_min(cum, cum) as mb from c, rad where r > radius group by all),
g as (select distinct halo_id, sim from pairs),
e as (select g.halo_id, g.sim, rad.radius, case when ma is null then 0::double when mb is null then ma else ma + (mb - ma) * (rad.radius - ra) / (rb - ra) end as m_enclosed
 from g cross join rad left join lo on lo.halo_id = g.halo_id and lo.sim = g.sim and lo.radius = rad.radius left join hi on hi.halo_id = g.halo_id and hi.sim = g.sim and hi.radius = rad.radius)"""


def _interp(spark, sf):
    return prof.ball_interpolated(b.particles(spark, sf), b.halos(spark, sf), b.REACH, b.MAX_R200 * b.REACH, STATS_RADII, ("halo_id", "log_mass"), "sim")


@query("g08_enclosed_interpolated", cte("pairs").rstrip() + f", {_INTERP} select halo_id, sim, radius, {R('m_enclosed', 5)} as m_enclosed from e")
def _(spark, sf):
    return _interp(spark, sf).select("halo_id", "sim", "radius", r("m_enclosed", 5).alias("m_enclosed"))


_DEF = """dd as (select * from e where sim = 'dmo'), hh as (select * from e where sim = 'hydro'),
deficit as (select coalesce(d.halo_id, h.halo_id) as halo_id, coalesce(d.radius, h.radius) as radius,
 (coalesce(h.m_enclosed, 0) - coalesce(d.m_enclosed, 0)) / nullif(coalesce(d.m_enclosed, 0), 0) as deficit
 from dd d full join hh h on d.halo_id = h.halo_id and d.radius = h.radius)"""


def _deficit(spark, sf):
    return prof.deficit_by_run(_interp(spark, sf))


@query("g09_mass_deficit", cte("pairs").rstrip() + f", {_INTERP}, {_DEF} select halo_id, radius, {R('deficit')} as deficit from deficit")
def _(spark, sf):
    return _deficit(spark, sf).select("halo_id", "radius", r("deficit").alias("deficit"))


@query(
    "g09_deficit_strict",
    cte("pairs").rstrip()
    + f""", w as (select halo_id, sim, rad as radius, sum(mass) as m_enclosed from pairs, (select unnest({num_list(STATS_RADII)}) as rad) where r < rad group by all), e as (select * from w), {_DEF}
 select halo_id, radius, {R('deficit')} as deficit from deficit""",
)
def _(spark, sf):
    w = _within(spark, sf, strict=True).withColumnRenamed("m_total", "m_enclosed")
    d = prof.mass_deficit(w.where(F.col("sim") == "dmo"), w.where(F.col("sim") == "hydro"))
    return d.select("halo_id", "radius", r("deficit").alias("deficit"))


_COMMON = [0.75, 1.5, 2.5, 4.5, 6.0]


@query(
    "g10_stacked_deficit",
    cte("pairs").rstrip()
    + f""", {_INTERP}, {_DEF}, ok as (select * from deficit where deficit is not null), pts as (select unnest({num_list(_COMMON)}) as x_at),
 br as (select halo_id, x_at, max(case when radius <= x_at then radius end) as xa, min(case when radius >= x_at then radius end) as xb from ok, pts group by all),
 v as (select b.halo_id, b.x_at, case when xa is null then fb.deficit when xb is null then fa.deficit when xa = xb then fa.deficit
  else fa.deficit + (fb.deficit - fa.deficit) * ((x_at - xa) / (xb - xa)) end as y from br b left join ok fa on fa.halo_id = b.halo_id and fa.radius = xa left join ok fb on fb.halo_id = b.halo_id and fb.radius = xb)
 select x_at as radius, {R('avg(y)')} as mean, {R('stddev_pop(y)')} as std, count(*) as n from v group by all""",
)
def _(spark, sf):
    d = _deficit(spark, sf).where(F.col("deficit").isNotNull())
    at = windows.interpolate(d, ["halo_id"], "radius", "deficit", _COMMON)
    return at.groupBy(F.col("x_at").alias("radius")).agg(
        r(F.avg("y_at")).alias("mean"), r(F.stddev_pop("y_at")).alias("std"), F.count(F.lit(1)).alias("n")
    )


_LOGM = [12.5, 13.0, 13.5, 14.0, 14.5, 15.0]


@query(
    "g11_deficit_by_mass",
    cte("pairs", "halos").rstrip()
    + f""", {_INTERP}, {_DEF} select {bin_sql('log_mass', _LOGM, 'below')} as mass_bin, {R('avg(deficit)')} as deficit, count(*) as n from deficit join halos using (halo_id) where radius = 3.0::double group by all""",
)
def _(spark, sf):
    d = _deficit(spark, sf).where(F.col("radius") == 3.0).join(b.halos(spark, sf), "halo_id")
    d = with_bin(d, "log_mass", _LOGM, "below", "mass_bin")
    return d.groupBy("mass_bin").agg(r(F.avg("deficit")).alias("deficit"), F.count(F.lit(1)).alias("n"))


_BINS = "bins(lo, hi, label) as (values " + ", ".join(f"({num(lo)}, {num(hi)}, '{lab}')" for lo, hi, lab in REPLACE_MASS_BINS) + ")"


@query("g12_mass_bins", cte("halos").rstrip() + f", {_BINS} select halo_id, label from halos, bins where log_mass >= lo and log_mass < hi")
def _(spark, sf):
    return stats.mass_bin_membership(b.halos(spark, sf), REPLACE_MASS_BINS, "log_mass").select("halo_id", "label")


@query(
    "g13_bin_summary",
    cte("halos").rstrip() + f", {_BINS} select label, count(halo_id) as n_halos from bins left join halos on log_mass >= lo and log_mass < hi group by all",
)
def _(spark, sf):
    return stats.bin_summary(b.halos(spark, sf), REPLACE_MASS_BINS, "log_mass")


_NB = len(MASS_BIN_EDGES) - 1


@query(
    "g14_stack_by_mass",
    cte("pairs").rstrip()
    + f""", {_WITHIN}, s as (select cast(a as int) as mass_bin, cast(c as int) as k from (select unnest(range({_NB})) as a), (select unnest(range({len(STATS_RADII)})) as c)),
 v as (select {bin_sql('log_mass', MASS_BIN_EDGES, 'left')} as mass_bin, radius, (m_gas + m_stellar) / m_total as f from w where sim = 'hydro')
 select s.mass_bin, {num_list(STATS_RADII)}[k+1] as radius, {R('coalesce(avg(f), 0)')} as mean, {R('coalesce(stddev_pop(f), 0)')} as std, count(f) as n_halos
 from s left join v on v.mass_bin = s.mass_bin and v.radius = {num_list(STATS_RADII)}[k+1] group by all""",
)
def _(spark, sf):
    w = _within(spark, sf).where(F.col("sim") == "hydro")
    w = w.withColumn("mass_bin", bin_index(F.col("log_mass"), MASS_BIN_EDGES, "left"))
    g = w.groupBy("mass_bin", "radius").agg(
        F.avg("f_baryon").alias("mean"), F.stddev_pop("f_baryon").alias("std"), F.count(F.lit(1)).alias("n_halos")
    )
    spine = with_spine(spark.range(_NB).select(F.col("id").cast("int").alias("mass_bin")), len(STATS_RADII), "k")
    table = F.array(*[F.lit(x) for x in STATS_RADII])
    spine = spine.select("mass_bin", F.element_at(table, F.col("k") + 1).alias("radius"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return spine.join(g, ["mass_bin", "radius"], "left").select(
        "mass_bin", "radius", r(z("mean")).alias("mean"), r(z("std")).alias("std"), F.coalesce("n_halos", F.lit(0)).alias("n_halos")
    )


_DPROF = f"""{_profile_sql(RADIAL_EDGES)}, dens as (select halo_id, sim, log_mass, bin, n, mass, mass / {_vol(num_list(RADIAL_EDGES), 'bin')} as density from prof)"""


def _density(spark, sf):
    return prof.add_density(_profile(spark, sf))


@query(
    "g15_stack_mean",
    cte("pairs").rstrip() + f", {_DPROF} select sim, bin, {R('avg(density)')} as stacked, {R('stddev_pop(density)')} as scatter from dens group by all",
)
def _(spark, sf):
    return stats.stack_mean(_density(spark, sf), ["sim", "bin"], "density").select("sim", "bin", r("stacked").alias("stacked"), r("scatter").alias("scatter"))


@query(
    "g15_stack_median",
    cte("pairs").rstrip()
    + f""", {_DPROF}, m as (select sim, bin, quantile_cont(density, 0.5) as stacked from dens group by all)
 select sim, bin, {R('any_value(stacked)')} as stacked, {R('1.4826 * quantile_cont(abs(density - stacked), 0.5)')} as scatter from dens join m using (sim, bin) group by all""",
)
def _(spark, sf):
    return stats.stack_median(_density(spark, sf), ["sim", "bin"], "density").select("sim", "bin", r("stacked").alias("stacked"), r("scatter").alias("scatter"))


@query(
    "g15_stack_weighted",
    cte("pairs").rstrip()
    + f""", {_DPROF}, m as (select sim, bin, sum(density * n) / sum(n) as stacked from dens group by all)
 select sim, bin, {R('any_value(stacked)')} as stacked, {R('sqrt(sum(n * (density - stacked) * (density - stacked)) / sum(n))', 5)} as scatter from dens join m using (sim, bin) group by all""",
)
def _(spark, sf):
    s = stats.stack_mean(_density(spark, sf).withColumn("w", F.col("n").cast("double")), ["sim", "bin"], "density", "w")
    return s.select("sim", "bin", r("stacked").alias("stacked"), r("scatter", 5).alias("scatter"))


@query(
    "g16_stacked_band",
    cte("pairs").rstrip()
    + f", {_DPROF} select sim, bin, {R('quantile_cont(density, 0.5)')} as median, {R('quantile_cont(density, 0.16)')} as p16, {R('quantile_cont(density, 0.84)')} as p84 from dens group by all",
)
def _(spark, sf):
    q = exact_quantiles(_density(spark, sf), ["sim", "bin"], "density", [0.5, 0.16, 0.84], ["median", "p16", "p84"])
    return q.select("sim", "bin", *[r(c).alias(c) for c in ("median", "p16", "p84")])


@query(
    "g17_stacked_sum",
    cte("pairs").rstrip()
    + f""", {_DPROF} select sim, {bin_sql('log_mass', MASS_BIN_EDGES, 'left')} as mass_bin, bin, {R('sum(density)')} as stacked, cast(sum(n) as bigint) as n_particles, count(distinct halo_id) as n_halos from dens group by all""",
)
def _(spark, sf):
    d = _density(spark, sf).withColumn("mass_bin", bin_index(F.col("log_mass"), MASS_BIN_EDGES, "left"))
    s = d.groupBy("sim", "mass_bin", "bin").agg(
        F.sum("density").alias("stacked"), F.sum("n").alias("n_particles"), F.count(F.lit(1)).alias("n_halos")
    )
    return s.withColumn("stacked", r("stacked"))


_XE = [0.0, 50.0, 100.0, 150.0, 200.0, 250.0, 1000000.0]
# amounts in whole cents, so that sums are exact
_EV = "ev as (select event_id, cast(user_id as double) as x, cast(round(value * 100) as double) as y, event_type from events)"
_NBINS = 5


def _events(spark, sf):
    return read_table(spark, sf, "events").selectExpr(
        "event_id", "cast(user_id as double) as x", "round(value * 100) as y", "event_type"
    )


_C = f"""span as (select min(x) as lo, max(x) as hi from ev),
 ed as (select case when k = {_NBINS} then hi else lo + (hi - lo) * k / {_NBINS}::double end as e, k from span, (select unnest(range({_NBINS + 1})) as k)),
 spine as (select cast(a.k as int) as bin, (a.e + b.e) / 2 as x_center from ed a join ed b on b.k = a.k + 1),
 bb as (select ev.*, cast(least((select count(*) from ed where e <= x) - 1, {_NBINS - 1}) as int) as bin from ev)"""


def _binned(name, stat, y_sql, err_sql):
    def fn(spark, sf):
        s = stats.binned_statistic(_events(spark, sf), "x", "y", _NBINS, stat)
        return s.select("bin", "x_center", r("y_stat", 4).alias("y_stat"), r("y_err", 4).alias("y_err"), "n")

    query(name, f"with {_EV}, {_C} select bin, x_center, {R(y_sql, 4)} as y_stat, {R(err_sql, 4)} as y_err, count(y) as n from spine left join bb using (bin) group by all")(fn)


_binned("g18_binned_mean", "mean", "avg(y)", "stddev_pop(y) / sqrt(count(y))")
_binned("g18_binned_sum", "sum", "coalesce(sum(y), 0)", "coalesce(sqrt(sum(y)), 0)")
_binned("g18_binned_median", "median", "quantile_cont(y, 0.5)", "1.4826 * mad(y) / sqrt(count(y))")
_binned("g18_binned_max", "max", "max(y)", "0::double")


@query(
    "g19_percentile_range",
    f"with {_EV} select event_type, {R('quantile_cont(y, 0.5)', 4)} as median, {R('quantile_cont(y, 0.16)', 4)} as lower, {R('quantile_cont(y, 0.84)', 4)} as upper from ev group by all",
)
def _(spark, sf):
    p = stats.percentile_band(_events(spark, sf), ["event_type"], "y")
    return p.select("event_type", *[r(c, 4).alias(c) for c in ("median", "lower", "upper")])


@query(
    "g20_weighted_mean",
    f"with {_EV} select event_type, {R('sum(y / ((x+1)*(x+1))) / sum(1 / ((x+1)*(x+1)))', 4)} as mean, {R('sqrt(1 / sum(1 / ((x+1)*(x+1))))')} as error from ev group by all",
)
def _(spark, sf):
    w = stats.weighted_mean(_events(spark, sf).withColumn("e", F.col("x") + 1.0), ["event_type"], "y", "e")
    return w.select("event_type", r("mean", 4).alias("mean"), r("error").alias("error"))


@query(
    "g21_chi2",
    f"with {_EV} select event_type, {R('sum(pow((y - 5000) / (x * 10 + 100), 2))', 3)} as chi2, {R('sum(pow((y - 5000) / (x * 10 + 100), 2)) / (count(*) - 2)')} as chi2_reduced from ev group by all",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("m", F.lit(5000.0)).withColumn("s", F.col("x") * 10.0 + 100.0)
    c = stats.chi2(e, ["event_type"], "y", "m", "s", 2)
    return c.select("event_type", r("chi2", 3).alias("chi2"), r("chi2_reduced").alias("chi2_reduced"))


@query("g22_correlation", f"with {_EV} select event_type, {R('corr(x, y)')} as r, count(*) as n from ev group by all")
def _(spark, sf):
    return stats.pearson(_events(spark, sf), ["event_type"], "x", "y").select("event_type", r("r").alias("r"), "n")


def _p_value_sql() -> str:
    """The two-sided Student p-value of t with nu degrees of freedom, by the same quadrature."""
    x = "(nu / 2)"
    y = f"({x} + 16)"
    total = " + ".join(f"{num(w)} * pow(cos(u0 + half * ({num(q)} + 1)), nu - 1)" for q, w in stats.QUADRATURE)
    shift = " * ".join(f"(({x} + {k}) / ({x} + {k}.5))" for k in range(16))
    log_ratio = f"ln({y}) / 2 - 1 / (8 * {y}) + 1 / (192 * pow({y}, 3)) - 1 / (640 * pow({y}, 5)) + 17 / (14336 * pow({y}, 7))"
    return f"least(1.0::double, 2 / sqrt(pi()) * exp({log_ratio}) * {shift} * half * ({total}))"


@query(
    "g22_correlation_p_value",
    f"""with {_EV}, c as (select event_type, corr(x, y) as r, (count(*) - 2)::double as nu from ev where isfinite(x) and isfinite(y) group by all),
 ct as (select *, case when nu > 0 and abs(r) < 1 then r * sqrt(nu / (1.0::double - r * r)) end as t from c),
 cu as (select *, atan(abs(t) / sqrt(nu)) as u0 from ct where t is not null),
 ch as (select *, (least(pi() / 2, sqrt(u0 * u0 + 90 / greatest(nu - 1, 1e-9::double))) - u0) / 2 as half from cu),
 pv as (select event_type, {_p_value_sql()} as p from ch)
 select event_type, {R('r')} as r, coalesce({R('p')}, 'nan'::double) as p from c left join pv using (event_type)""",
)
def _(spark, sf):
    p = stats.pearson(_events(spark, sf), ["event_type"], "x", "y")
    return p.select("event_type", r("r").alias("r"), r(stats.correlation_p_value("t", "n")).alias("p"))


_NBOOT = 200


def _number_sql(b: str, k: str, seed: int) -> str:
    """The mixed value of a resample and a row, in SQL."""
    p = 2147483647
    h = f"((({b} + 1) * 48271 + {seed} + ({k} // {p}) % {p} * 69621) % {p} * ({k} % {p} + 7) + 12345) % {p}"
    h = f"(({h}) * (({h} + 69621) % {p})) % {p}"
    h = f"(({h}) * 16807 + {k} % {p}) % {p}"
    return f"(({h}) * (({h} + 40692) % {p})) % {p}"


_WEIGHT = " + ".join(f"(u >= {t})::int" for t in stats.POISSON_STEPS)
_DRAW = f"""u as (select bt, x, y, {_number_sql('bt', 'event_id', 11)} as u from ev, (select unnest(range({_NBOOT})) as bt)),
 w as (select bt, x, y, {_WEIGHT} as w from u),
 bm as (select bt as b, sum(w * y) / sum(w) as mean, sqrt(greatest(sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2), 0)) as std, sum(w * y) / sum(w * x) as ratio from w group by all)"""


def _boot(spark, sf, statistic="mean", other=None):
    return stats.bootstrap(_events(spark, sf), "y", "event_id", statistic, other, n_resamples=_NBOOT, seed=11)


def _draw_sql(b: str, k: str, n: str, seed: int) -> str:
    """A row number in SQL, from two mixed values of 31 bits."""
    p = 2147483647

    def mixed(seed: int) -> str:
        h = f"((({b} + 1) * 48271 + {seed} + ({k} // {p}) % {p} * 69621) % {p} * ({k} % {p} + 7) + 12345) % {p}"
        h = f"(({h}) * (({h} + 69621) % {p})) % {p}"
        h = f"(({h}) * 16807 + {k} % {p}) % {p}"
        return f"(({h}) * (({h} + 40692) % {p})) % {p}"

    return f"(({mixed(seed)}) * 2147483648 + {mixed(seed + 1_000_003)}) % {n}"


_DRAWN = f"""u as (select bt, k, n from (select unnest(range({_NBOOT})) as bt), (select row_number() over (order by y, event_id) - 1 as k, count(*) over () as n from ev)),
 h4 as (select bt, {_draw_sql('bt', 'k', 'n', 11)} as drawn from u),
 rk as (select y, row_number() over (order by y, event_id) - 1 as rank from ev),
 bm as (select bt as b, sum(y) / count(*) as mean from h4 join rk on rk.rank = h4.drawn group by all)"""


# n draws with replacement from n rows, as the reference has it
def _drawn(spark, sf):
    return stats.draw_means(_events(spark, sf), "y", "event_id", _NBOOT, 11)


@query("g23_bootstrap_means", f"with {_EV}, {_DRAWN} select cast(b as int) as b, {R('mean')} as mean from bm")
def _(spark, sf):
    return _drawn(spark, sf).select("b", r("mean").alias("mean"))


@query("g23_bootstrap_std", f"with {_EV}, {_DRAW} select cast(b as int) as b, {R('std')} as std from bm")
def _(spark, sf):
    return _boot(spark, sf, "std").select("b", r("std").alias("std"))


@query("g23_bootstrap_ratio", f"with {_EV}, {_DRAW} select cast(b as int) as b, {R('ratio')} as ratio from bm")
def _(spark, sf):
    return _boot(spark, sf, "ratio", "x").select("b", r("ratio").alias("ratio"))


@query(
    "g23_bootstrap_interval",
    f"with {_EV}, {_DRAWN} select {R('quantile_cont(mean, 0.16)')} as ci_low, {R('quantile_cont(mean, 0.84)')} as ci_high from bm",
)
def _(spark, sf):
    return stats.confidence_interval(_drawn(spark, sf), "mean").select(r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"))


_DRAWN2 = f"""u as (select bt, k, n from (select unnest(range(50)) as bt), (select row_number() over (order by realization) - 1 as k, count(*) over () as n from (select distinct realization from stats))),
 h4 as (select bt, {_draw_sql('bt', 'k', 'n', 5)} as drawn from u),
 rk as (select realization, row_number() over (order by realization) - 1 as rank from (select distinct realization from stats))"""


@query(
    "g23_bootstrap_rows",
    cte("stats").rstrip() + f", {_DRAWN2} select cast(bt as int) as b, bin, {R('avg(value)')} as mean from h4 join rk on rk.rank = h4.drawn join stats using (realization) group by all",
)
def _(spark, sf):
    m = stats.draw_rows(b.stats(spark, sf), "realization", ["bin"], "value", 50, 5)
    return m.select("b", "bin", r("mean").alias("mean"))


_BLOCKS = 20


@query(
    "g24_jackknife_std",
    f"""with {_EV}, p as (select event_type, event_id % {_BLOCKS} as block, count(*)::double as s0, sum(y) as s1, sum(y * y) as s2 from ev group by all),
 a as (select event_type, sum(s0) as a0, sum(s1) as a1, sum(s2) as a2, count(*) as n_blocks from p group by all),
 l as (select event_type, n_blocks, sqrt(greatest((a2 - s2) / (a0 - s0) - pow((a1 - s1) / (a0 - s0), 2), 0)) as x from p join a using (event_type)),
 e as (select event_type, n_blocks, sqrt(var_pop(x) * (any_value(n_blocks) - 1)) as error from l group by all)
 select event_type, {R('sqrt(greatest(a2 / a0 - pow(a1 / a0, 2), 0))', 5)} as std, {R('error', 5)} as error, n_blocks from a join e using (event_type, n_blocks)""",
)
def _(spark, sf):
    j = stats.jackknife(_events(spark, sf), "y", F.col("event_id") % _BLOCKS, "std", keys=["event_type"])
    return j.select("event_type", r("std", 5).alias("std"), r("error", 5).alias("error"), "n_blocks")


@query(
    "g24_jackknife",
    f"""with {_EV}, t as (select event_type, sum(y) as s, count(*) as n from ev group by all), l as (select event_type, n, (s - y) / (n - 1) as rep from ev join t using (event_type)),
 m as (select event_type, avg(rep) as mr from l group by all)
 select event_type, {R('any_value(s / n)', 4)} as mean, {R('sqrt((any_value(n) - 1) / any_value(n)::double * sum((rep - mr) * (rep - mr)))', 4)} as error from l join m using (event_type) join (select event_type, s from t) using (event_type) group by all""",
)
def _(spark, sf):
    return stats.jackknife_mean(_events(spark, sf), ["event_type"], "y").select("event_type", r("mean", 4).alias("mean"), r("error", 4).alias("error"))


@query(
    "g26_match_statistics",
    cte("dmo_members", "hydro_members").rstrip()
    + f""", nd as (select halo as dmo, count(*) as n_dmo from dmo_members group by all), ov as (select d.halo as dmo, h.halo as hydro, count(*) as shared from dmo_members d join hydro_members h using (pid) group by all),
 f as (select shared / n_dmo::double as f from ov join nd using (dmo)) select {R('avg(f)')} as mean, {R('quantile_cont(f, 0.5)')} as median, {R('min(f)')} as lo, {R('max(f)')} as hi, {R('stddev_pop(f)')} as std, count(*) as n from f""",
)
def _(spark, sf):
    from ..operators.matching import shared_fractions

    o = shared_fractions(b.dmo_members(spark, sf), b.hydro_members(spark, sf))
    base = o.agg(
        r(F.avg("f")).alias("mean"), r(F.min("f")).alias("lo"), r(F.max("f")).alias("hi"), r(F.stddev_pop("f")).alias("std"), F.count(F.lit(1)).alias("n")
    )
    med = exact_quantiles(o, [], "f", [0.5], ["median"]).select(r("median").alias("median"))
    return base.crossJoin(F.broadcast(med))  # one row each


@query(
    "g31_filling_fraction",
    cte("halos").rstrip()
    + f""", a as (select unnest([0.5, 1.0, 3.0, 5.0]::double[]) as alpha) select {bin_sql('log_mass', MASS_BIN_EDGES, 'left')} as mass_bin, alpha, count(*) as n_halos,
 {R(f'sum({num(DENS)} * pow(alpha * r200, 3)) / pow(205.0::double, 3)', 8)} as filling from halos, a group by all""",
)
def _(spark, sf):
    h = b.halos(spark, sf).withColumn("mass_bin", bin_index(F.col("log_mass"), MASS_BIN_EDGES, "left"))
    h = h.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 3.0, 5.0)])))
    vol = F.lit(DENS) * F.pow(F.col("alpha") * F.col("r200"), F.lit(3.0)) / F.lit(205.0**3)
    return h.groupBy("mass_bin", "alpha").agg(F.count(F.lit(1)).alias("n_halos"), r(F.sum(vol), 8).alias("filling"))


@query(
    "g31_union_filling",
    cte("halos").rstrip()
    + """, c as (select i.v as i, j.v as j, k.v as k from (select unnest(range(41)) as v) i, (select unnest(range(41)) as v) j, (select unnest(range(41)) as v) k),
 p as (select (i + 0.5::double) * 5.0::double as x, (j + 0.5::double) * 5.0::double as y, (k + 0.5::double) * 5.0::double as z from c)
 select count(*) as cells_covered, round(count(*) / 68921.0::double, 8) as filling from p where exists (select 1 from halos h where """
    + b.dist_sql()
    + " <= h.r200 * 5.0::double)",
)
def _(spark, sf):
    from ..operators.spatial import covered_cells

    # cell centres inside any ball, found from the balls outwards
    n = 41
    hit = covered_cells(b.halos(spark, sf), F.col("r200") * 5.0, n, 205.0)
    return hit.agg(F.count(F.lit(1)).alias("cells_covered"), r(F.count(F.lit(1)) / F.lit(float(n**3)), 8).alias("filling"))


@query(
    "g32_match_completeness",
    cte("halos", "dmo_members", "hydro_members").rstrip()
    + f""", nd as (select halo as dmo, count(*) as n_dmo from dmo_members group by all), nh as (select halo as hydro, count(*) as n_hydro from hydro_members group by all),
 ov as (select d.halo as dmo, h.halo as hydro, count(*) as shared from dmo_members d join hydro_members h using (pid) group by all),
 m as (select distinct dmo from (select *, row_number() over (partition by dmo order by shared desc, hydro) as k from ov join nd using (dmo) join nh using (hydro)) where k = 1 and shared / n_dmo::double >= 0.5 and shared / n_hydro::double >= 0.7),
 t as (select unnest([12.0, 12.5, 13.0, 13.5, 14.0, 14.5, 15.0]::double[]) as threshold)
 select threshold, count(h.halo_id) as n_total, count(m.dmo) as n_matched, {R('case when count(h.halo_id) > 0 then count(m.dmo) / count(h.halo_id)::double else 0 end')} as completeness
 from t left join halos h on h.log_mass >= threshold left join m on m.dmo = h.halo_id group by all""",
)
def _(spark, sf):
    from ..operators.matching import best_overlap

    m = best_overlap(b.dmo_members(spark, sf), b.hydro_members(spark, sf)).where(F.col("reverse") >= 0.7)
    m = m.select(F.col("dmo").alias("halo_id"), F.lit(1).alias("hit"))
    thresholds = [12.0, 12.5, 13.0, 13.5, 14.0, 14.5, 15.0]
    arr = F.array(*[F.lit(t) for t in thresholds])
    h = b.halos(spark, sf).join(m, "halo_id", "left")
    h = h.withColumn("threshold", F.explode(F.filter(arr, lambda t: t <= F.col("log_mass"))))
    g = h.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_total"), F.count("hit").alias("n_matched"))
    spine = spark.range(1).select(F.explode(arr).alias("threshold"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = spine.join(g, "threshold", "left").select("threshold", z("n_total").alias("n_total"), z("n_matched").alias("n_matched"))
    frac = F.coalesce(F.try_divide(F.col("n_matched").cast("double"), F.col("n_total")), F.lit(0.0))
    return out.withColumn("completeness", r(frac))


@query(
    "g33_complete_stack",
    cte("pairs", "halos").rstrip()
    + f""", {_profile_sql(STATS_EDGES := [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 'hist', 'prof', "sim = 'hydro'")}, f as (select h.halo_id, k as bin, coalesce(p.mass, 0) as m from halos h cross join (select unnest(range(5)) as k) left join prof p on p.halo_id = h.halo_id and p.bin = k where h.log_mass >= 13.0::double),
 c as (select halo_id, min(m) > 0 as ok from f group by all), u as (select bin, m from f join c using (halo_id) where case when (select count(*) from c where ok) >= 3 then ok else m > 0 end)
 select cast(bin as int) as bin, {R('quantile_cont(m, 0.5)', 4)} as median, {R('quantile_cont(m, 0.16)', 4)} as p16, {R('quantile_cont(m, 0.84)', 4)} as p84, count(*) as n from u group by all""",
)
def _(spark, sf):
    heavy = b.halos(spark, sf).where(F.col("log_mass") >= 13.0)
    hydro = b.particles(spark, sf).where(F.col("sim") == "hydro")
    shells = prof.ball_profile(hydro, heavy, b.REACH, b.MAX_R200 * b.REACH, STATS_EDGES, "hist", ("halo_id",))
    full = prof.full_bins(shells, heavy, 5, ["mass"])
    s = stats.complete_or_positive_stack(full, "halo_id", "bin", "mass")
    return s.select("bin", *[r(c, 4).alias(c) for c in ("median", "p16", "p84")], "n")


# --- profile-space replacement ---------------------------------------------------

_MIDS = f"{num_list(RADIAL_EDGES)}"
_PSP = f"""{_DPROF}, st as (select {bin_sql('log_mass', MASS_BIN_EDGES, 'left')} as mass_bin, bin, sum(case when sim = 'dmo' then density end) as dmo, sum(case when sim = 'hydro' then density end) as hydro from dens group by all),
mid as (select mass_bin, bin, coalesce(dmo, 0) as dmo, coalesce(hydro, 0) as hydro, ({_MIDS}[bin+1] + {_MIDS}[bin+2]) / 2 as r_mid, ({num_list(MASS_BIN_EDGES)}[mass_bin+1] + {num_list(MASS_BIN_EDGES)}[mass_bin+2]) / 2 as mass_mid from st)"""


def _stacked_pair(spark, sf):
    d = _density(spark, sf).withColumn("mass_bin", bin_index(F.col("log_mass"), MASS_BIN_EDGES, "left"))
    pick = lambda s: F.sum(F.when(F.col("sim") == s, F.col("density")).otherwise(F.lit(0.0))).alias(s)
    g = d.groupBy("mass_bin", "bin").agg(pick("dmo"), pick("hydro"))
    rb = bin_table(spark, RADIAL_EDGES).select("bin", ((F.col("lo") + F.col("hi")) / 2).alias("r_mid"))
    mb = bin_table(spark, MASS_BIN_EDGES).select(F.col("bin").alias("mass_bin"), ((F.col("lo") + F.col("hi")) / 2).alias("mass_mid"))
    return g.join(F.broadcast(rb), "bin").join(F.broadcast(mb), "mass_bin")


@query(
    "r06_profile_replace",
    cte("pairs").rstrip()
    + f""", {_PSP} select mass_bin, bin, {R('case when r_mid < 3.0 then hydro else dmo end')} as replaced, {R('case when r_mid < 3.0 and mass_mid >= 13.0 then hydro else dmo end')} as replaced_heavy,
 {R('case when r_mid < 3.0 and mass_mid >= 12.5 and mass_mid < 13.5 then hydro else dmo end')} as replaced_range from mid""",
)
def _(spark, sf):
    j = _stacked_pair(spark, sf)
    a = prof.replace_profile(j, 3.0).withColumn("r1", F.col("replaced"))
    a = prof.replace_profile(a, 3.0, min_mass=13.0).withColumn("r2", F.col("replaced"))
    a = prof.replace_profile(a, 3.0, mass_range=(12.5, 13.5)).withColumn("r3", F.col("replaced"))
    return a.select("mass_bin", "bin", r("r1").alias("replaced"), r("r2").alias("replaced_heavy"), r("r3").alias("replaced_range"))


@query(
    "q16_observable_from_profiles",
    cte("pairs").rstrip() + f", {_PSP} select bin, {R('sum(dmo)')} as s_dmo, {R('sum(hydro)')} as s_hydro from mid where mass_mid >= 13.0 group by all",
)
def _(spark, sf):
    j = _stacked_pair(spark, sf).where(F.col("mass_mid") >= 13.0)
    return j.groupBy("bin").agg(r(F.sum("dmo")).alias("s_dmo"), r(F.sum("hydro")).alias("s_hydro"))


@query(
    "w01_enclosed_from_shells",
    cte("pairs").rstrip() + f", {_profile_sql(RADIAL_EDGES)} select halo_id, sim, bin, mass, sum(mass) over (partition by halo_id, sim order by bin) as enclosed from prof",
)
def _(spark, sf):
    return windows.cumulative(_profile(spark, sf), ["halo_id", "sim"], "bin", "mass", "enclosed").select("halo_id", "sim", "bin", "mass", "enclosed")


@query(
    "w03_running_mean",
    f"with {_EV} select {R('xo', 6)} as x_out, {R('yo', 4)} as y_out from (select avg(x) over w as xo, avg(y) over w as yo, count(*) over w as c from ev window w as (order by x, event_id rows between current row and 9 following)) where c = 10",
)
def _(spark, sf):
    from ..operators.ordering import rolling

    return rolling(_events(spark, sf), "x", "y", "event_id", 10).select(r("x_out").alias("x_out"), r("y_out", 4).alias("y_out"))


@query(
    "w03_running_median",
    f"with {_EV} select {R('xo', 6)} as x_out, {R('yo', 4)} as y_out from (select avg(x) over w as xo, quantile_cont(y, 0.5) over w as yo, count(*) over w as c from ev window w as (order by x, event_id rows between current row and 9 following)) where c = 10",
)
def _(spark, sf):
    from ..operators.ordering import rolling

    return rolling(_events(spark, sf), "x", "y", "event_id", 10, "median").select(r("x_out").alias("x_out"), r("y_out", 4).alias("y_out"))


@query(
    "w07_top_halos",
    cte("halos") + "select halo_id, log_mass, r200 from halos order by log_mass desc, halo_id limit 20",
)
def _(spark, sf):
    return windows.top_k(b.halos(spark, sf), "log_mass", "halo_id", 20).select("halo_id", "log_mass", "r200")

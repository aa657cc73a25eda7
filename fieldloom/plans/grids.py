"""Queries over mass assignment, lens planes and baryonification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import STATS_RADII
from ..operators import bcm, cubes, gridding, profiles, spatial
from ..sources.config import transform_table
from . import bindings as b
from .bindings import R, cte, dist_sql, min_image_sql, num, num_list, query, r, r_many
from .columns import MOVED_SQL, TRANSFORMS_SQL

N = 32
_KEYS = ["sim"]


def _tap(t: str, k: str) -> str:
    """Weight of the pixel ``k`` away from the home pixel, from the distance to its node."""
    d = f"abs({t} - floor({t}) - {k} - 0.5::double)"
    return f"(case when {d} < 0.5 then 0.75 - {d}*{d} else 0.5 * (1.5 - {d}) * (1.5 - {d}) end)"


def _tsc_sql(src: str, u: str, v: str, keys: str, n: int, shift: str = "0.5") -> str:
    """Particle-wise spreading over nine pixels, an independent form of the moment method."""
    c = num(205.0 / n)
    return f"""g0 as (select {keys}, mass, {u} / {c} + {shift} as tu, {v} / {c} + {shift} as tv from {src}),
 o as (select unnest([-1, 0, 1]) as k), g1 as (select {keys}, mass, tu, tv, a.k as ka, c.k as kc from g0, o a, o c),
 grid as (select {keys}, cast(((floor(tu) + ka) + {n}) % {n} as int) as i, cast(((floor(tv) + kc) + {n}) % {n} as int) as j, sum(mass * {_tap('tu', 'ka')} * {_tap('tv', 'kc')}) as mass from g1 group by all)"""


def _cic_sql(src: str, axes: list[str], keys: str, n: int, shift: str = "0.0") -> str:
    c = num(205.0 / n)
    names = ["i", "j", "k"]
    t = ", ".join(f"{a} / {c} + {shift}::double as t{m}" for a, m in zip(axes, names))
    offs = ", ".join(f"o o{m}" for m, _ in zip(names, axes))
    cells = ", ".join(f"cast((floor(t{m}) + o{m}.k + {n}) % {n} as int) as {m}" for m, _ in zip(names, axes))
    w = " * ".join(f"(case when o{m}.k = 1 then t{m} - floor(t{m}) else 1 - (t{m} - floor(t{m})) end)" for m, _ in zip(names, axes))
    return f"""g0 as (select {keys}, mass, {t} from {src}), o as (select unnest([0, 1]) as k), grid as (select {keys}, {cells}, sum(mass * {w}) as mass from g0, {offs} group by all)"""


_OUT2 = f"select sim, i, j, {R('mass', 5)} as mass from grid"


def _out(df, cols=("sim", "i", "j"), value="mass", digits=5):
    return df.select(*cols, r(value, digits).alias(value))


def _drop_zero(df, value="mass"):
    return df.where(F.abs(value) > 1e-9)


@query("m01_tsc_projection", cte("particles").rstrip() + f", {_tsc_sql('particles', 'x', 'y', 'sim', N)} {_OUT2}")
def _(spark, sf):
    return _out(gridding.assign(b.particles(spark, sf), ("x", "y"), N, "tsc", _KEYS))


# neighbours of weight exactly zero are listed by one form or the other, so both drop them
@query("m02_cic_projection", cte("particles").rstrip() + f", {_cic_sql('particles', ['x', 'y'], 'sim', N)} {_OUT2} where mass > 1e-9")
def _(spark, sf):
    return _out(_drop_zero(gridding.assign(b.particles(spark, sf), ("x", "y"), N, "cic", _KEYS)))


@query(
    "m03_tsc_weights",
    cte("particles").rstrip() + f", t as (select pid, x / {num(205.0 / 32)} - floor(x / {num(205.0 / 32)}) - 0.5 as d from particles) select pid, {R('0.5 * (0.5 - d) * (0.5 - d)')} as w_left, {R('0.75 - d * d')} as w_home, {R('0.5 * (0.5 + d) * (0.5 + d)')} as w_right from t",
)
def _(spark, sf):
    a, h, c = gridding.tsc_weights(F.col("x"), 205.0 / 32)
    return b.particles(spark, sf).select("pid", r(a).alias("w_left"), r(h).alias("w_home"), r(c).alias("w_right"))


_NGP = lambda u, v, ax: f"select {ax} as axis, sim, cast(floor({u} / {num(205.0 / N)}) % {N} as int) as i, cast(floor({v} / {num(205.0 / N)}) % {N} as int) as j, sum(mass) as mass from particles group by all"


@query("m04_ngp_three_axes", cte("particles") + " union all ".join([_NGP("y", "z", 0), _NGP("x", "z", 1), _NGP("x", "y", 2)]))
def _(spark, sf):
    p = b.particles(spark, sf)
    # one scan: each particle appears once per axis
    views = F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(u).alias("u"), F.col(v).alias("v")) for a, (u, v) in enumerate([("y", "z"), ("x", "z"), ("x", "y")])]
    )
    p = p.select("sim", "mass", F.explode(views).alias("p")).select("sim", "mass", "p.axis", "p.u", "p.v")
    return gridding.assign(p, ("u", "v"), N, "ngp", ["axis", "sim"])


@query(
    "m05_surface_density",
    cte("particles") + f"select sim, cast(least(floor(x / {num(205.0 / N)}), {N - 1}) as int) as i, cast(least(floor(y / {num(205.0 / N)}), {N - 1}) as int) as j, {R(f'sum(mass) / {num((205.0 / N) ** 2)}')} as sigma from particles group by all",
)
def _(spark, sf):
    return _out(gridding.histogram2d(b.particles(spark, sf), ("x", "y"), N, keys=_KEYS), value="sigma", digits=6)


@query("m06_cic_3d", cte("particles").rstrip() + f", {_cic_sql('particles', ['x', 'y', 'z'], 'sim', 16)} select sim, i, j, k, {R('mass', 5)} as mass from grid where mass > 1e-9")
def _(spark, sf):
    g = gridding.assign(b.particles(spark, sf), ("x", "y", "z"), 16, "cic", _KEYS)
    return _out(_drop_zero(g), ("sim", "i", "j", "k"))


@query(
    "m07_overdensity_grid",
    cte("particles").rstrip()
    + f""", {_tsc_sql('particles', 'x', 'y', 'sim', 16)}, full_grid as (select sim, cast(a as int) as i, cast(c as int) as j from (select distinct sim from particles), (select unnest(range(16)) as a), (select unnest(range(16)) as c))
 select f.sim, f.i, f.j, {R("coalesce(g.mass, 0) / (sum(coalesce(g.mass, 0)) over (partition by f.sim) / 256) - 1")} as delta from full_grid f left join grid g on g.sim = f.sim and g.i = f.i and g.j = f.j""",
)
def _(spark, sf):
    g = gridding.dense(gridding.assign(b.particles(spark, sf), ("x", "y"), 16, "tsc", _KEYS), 16, _KEYS)
    return _out(gridding.overdensity(g, 256, _KEYS), value="delta", digits=6)


_LP = 16


@query(
    "m08_lens_planes",
    cte("particles").rstrip()
    + f""", {TRANSFORMS_SQL}, {MOVED_SQL}, src as (select sim, lp, cast(snap_index * 2 + floor(depth / 102.5::double) as int) as plane, u, v, mass from pl where depth < 205.0), {_tsc_sql('src', 'u', 'v', 'sim, lp, plane', _LP)}
 select sim, lp, plane, i, j, {R('mass', 4)} as mass from grid""",
)
def _(spark, sf):
    p = b.particles(spark, sf).select("pid", "sim", "snap_index", "x", "y", "z", "mass")
    g = gridding.lens_planes(p, transform_table(spark), _LP, keys=_KEYS, on=("snap_index",))
    return _out(g, ("sim", "lp", "plane", "i", "j"), digits=4)


@query(
    "r10_replace_grid_3d",
    cte("particles", "halos").rstrip()
    + f""", f as (select x, y, z, mass, 'a' as grp from particles p where sim = 'dmo' and not exists (select 1 from halos h where {dist_sql()} <= h.r200 * 5.0::double and h.log_mass >= 13.0::double)
 union all select x, y, z, mass, 'a' from particles p where sim = 'hydro' and exists (select 1 from halos h where {dist_sql()} <= h.r200 * 5.0::double and h.log_mass >= 13.0::double)),
 {_cic_sql('f', ['x', 'y', 'z'], 'grp', 16)} select i, j, k, {R('mass', 5)} as mass from grid where mass > 1e-9""",
)
def _(spark, sf):
    from ..operators.replace import replace_field, select_halos

    p = b.particles(spark, sf).select("pid", "sim", "mass", "x", "y", "z")
    h = select_halos(b.halos(spark, sf), 13.0, float("inf"))
    side = lambda s: p.where(F.col("sim") == s)
    field = replace_field(side("dmo"), side("hydro"), h, F.col("r200") * 5.0, max_radius=b.MAX_R200 * 5)
    return _out(_drop_zero(gridding.assign(field, ("x", "y", "z"), 16, "cic")), ("i", "j", "k"))


@query("m09_roll", cte("kappa") + f"select map_id, cast((i + 10) % 64 as int) as i, cast((j + 57) % 64 as int) as j, {R('v')} as v from kappa")
def _(spark, sf):
    return gridding.roll(b.kappa(spark, sf), 64, 10, -7).select("map_id", "i", "j", r("v").alias("v"))


_C30, _S30 = 0.8660254037844387, 0.49999999999999994


@query(
    "m09_rotate",
    cte("kappa").rstrip()
    + f""", g as (select map_id, i, j, {num(_C30)} * (i - 31.5::double) + {num(_S30)} * (j - 31.5::double) + 31.5::double as a, {num(_C30)} * (j - 31.5::double) - {num(_S30)} * (i - 31.5::double) + 31.5::double as c from kappa),
 o as (select unnest([0, 1]) as k), t as (select g.*, cast((floor(a) + p.k + 64) % 64 as int) as si, cast((floor(c) + q.k + 64) % 64 as int) as sj,
 case when a < 0 or a > 63 or c < 0 or c > 63 then 0::double else (case when p.k = 1 then a - floor(a) else 1 - (a - floor(a)) end) * (case when q.k = 1 then c - floor(c) else 1 - (c - floor(c)) end) end as w from g, o p, o q)
 select t.map_id, t.i, t.j, {R('sum(w * v)')} as v from t join kappa s on s.map_id = t.map_id and s.i = t.si and s.j = t.sj group by all""",
)
def _(spark, sf):
    return gridding.rotate(b.kappa(spark, sf), 64, 30.0, ["map_id"]).select("map_id", "i", "j", r("v").alias("v"))


# a cube shifted by parts of the box, then turned: about any direction, and in the plane seen along a projection
CUBE = 16
_OFFSETS = [int(f * CUBE) for f in (0.2, 0.75, 0.5)]


def _turned_sql(pull: list[list[float]]) -> str:
    n, mid = CUBE, num((CUBE - 1) / 2)
    rolled = ", ".join(f"cast(({a} + {d}) % {n} as int) as {a}" for a, d in zip("ijk", _OFFSETS))
    places = ", ".join(
        f"{num(m[0])} * (i - {mid}) + {num(m[1])} * (j - {mid}) + {num(m[2])} * (k - {mid}) + {mid} as p{a}" for a, m in zip("ijk", pull)
    )
    taps = " and ".join(f"s.{a} = cast(floor(p{a}) as int) + o{a}.k" for a in "ijk")
    inside = " and ".join(f"p{a} between 0 and {n - 1}" for a in "ijk")
    w = " * ".join(f"(case when o{a}.k = 1 then p{a} - floor(p{a}) else 1 - (p{a} - floor(p{a})) end)" for a in "ijk")
    line = f"(select cast(range as int) as {{0}} from range({n}))"
    return f"""{_cic_sql('particles', ['x', 'y', 'z'], 'sim', n)}, rolled as (select sim, {rolled}, mass from grid),
 target as (select sim, i, j, k, {places} from (select distinct sim from rolled), {", ".join(line.format(a) for a in "ijk")}),
 turned as (select t.sim, t.i, t.j, t.k, sum(s.mass * {w}) as mass from (select * from target where {inside}) t, o oi, o oj, o ok, rolled s where s.sim = t.sim and {taps} group by all)"""


def _turned(spark, sf, pull):
    cube = gridding.assign(b.particles(spark, sf), ("x", "y", "z"), CUBE, "cic", _KEYS)
    return cubes.rotate(cubes.roll(cube, CUBE, _OFFSETS), CUBE, pull, _KEYS, width=8)


_ANY, _SEEN = cubes.about_vector((1.0, 2.0, 2.0), 30.0), cubes.about_axis(1, 40.0)


@query("m09_rotate_cube", cte("particles").rstrip() + f", {_turned_sql(_ANY)} select sim, i, j, k, {R('mass', 5)} as mass from turned where mass > 1e-6")
def _(spark, sf):
    return _out(_turned(spark, sf, _ANY).where("mass > 1e-6"), ("sim", "i", "j", "k"))


@query("m09_turned_projection", cte("particles").rstrip() + f", {_turned_sql(_SEEN)} select sim, i, k, {R('sum(mass)', 5)} as mass from turned group by sim, i, k having sum(mass) > 1e-6")
def _(spark, sf):
    seen = _turned(spark, sf, _SEEN).groupBy("sim", "i", "k").agg(F.sum("mass").alias("mass"))
    return _out(seen.where("mass > 1e-6"), ("sim", "i", "k"))


@query("m10_cic_centred", cte("particles").rstrip() + f", {_cic_sql('particles', ['x', 'y'], 'sim', N, '-0.5')} {_OUT2} where mass > 1e-9")
def _(spark, sf):
    return _out(_drop_zero(gridding.assign(b.particles(spark, sf), ("x", "y"), N, "cic_centred", _KEYS)))


# --- baryonification -------------------------------------------------------------

# a small displacement table d(r/R200, log mass): gas pushed out near R200, pulled in further out
R_KNOTS = [0.0, 0.5, 1.0, 2.0, 5.0]
M_KNOTS = [12.0, 13.0, 15.0]
D_TABLE = [[0.0, 0.05, 0.2, 0.1, 0.0], [0.0, 0.04, 0.15, 0.05, 0.0], [0.0, 0.01, 0.05, -0.02, 0.0]]


def _lookup_sql(x: str, m: str) -> str:
    rk, mk = num_list(R_KNOTS), num_list(M_KNOTS)
    tab = "[" + ", ".join(num_list(row) for row in D_TABLE) + "]"
    ci = f"greatest(1, least(len(list_filter({rk}, lambda q: q <= {x})), {len(R_KNOTS) - 1}))"
    cj = f"greatest(1, least(len(list_filter({mk}, lambda q: q <= {m})), {len(M_KNOTS) - 1}))"
    fr = f"greatest(0, least(1, ({x} - {rk}[{ci}]) / ({rk}[{ci}+1] - {rk}[{ci}])))"
    fm = f"greatest(0, least(1, ({m} - {mk}[{cj}]) / ({mk}[{cj}+1] - {mk}[{cj}])))"
    at = lambda a, c: f"{tab}[{a}][{c}]"
    low = f"({at(cj, ci)} * (1 - {fr}) + {at(cj, ci + ' + 1')} * {fr})"
    high = f"({at(cj + ' + 1', ci)} * (1 - {fr}) + {at(cj + ' + 1', ci + ' + 1')} * {fr})"
    return f"({low} * (1 - {fm}) + {high} * {fm})"


def _row():
    return bcm.mass_row(F.col("log_mass"), M_KNOTS, D_TABLE)


_PM = lambda e: f"((({e}) % 205.0::double) + 205.0::double) % 205.0::double"


def _additive_sql(reach: str) -> str:
    q = ", ".join(f"sum(s * {min_image_sql('q.' + c, 'q.h' + c)} / greatest(d, 1e-10)) as m{c}" for c in ("x", "y", "z"))
    return f"""q0 as (select * from (select p.pid, p.x, p.y, p.z, h.*, {dist_sql()} as d from particles p, halos h where p.sim = 'dmo') where d < r200 * {reach}),
 q as (select *, {_lookup_sql('(d / r200)', 'log_mass')} as s from q0), mv as (select pid, {q} from q group by all),
 moved as (select p.pid, p.ptype, p.mass, {', '.join(_PM(f'p.{c} + coalesce(m{c}, 0)') + f' as {c}' for c in ('x', 'y', 'z'))} from particles p left join mv on mv.pid = p.pid where p.sim = 'dmo')"""


def _displaced(spark, sf):
    p = b.particles(spark, sf).where(F.col("sim") == "dmo").select("pid", "ptype", "mass", "x", "y", "z")
    return bcm.push_additive(p, b.halos(spark, sf), F.col("r200") * 5.0, "r200", R_KNOTS, _row(), max_radius=b.MAX_R200 * 5)


@query(
    "b02_additive_displacement",
    cte("particles", "halos").rstrip() + f", {_additive_sql('5.0::double')} select pid, mass, {R('x')} as x, {R('y')} as y, {R('z')} as z from moved",
)
def _(spark, sf):
    return _displaced(spark, sf).select("pid", "mass", *[r(c).alias(c) for c in ("x", "y", "z")])


_BR = lambda d: f"(case when {d} > 102.5 then {d} - 205.0 when {d} < -102.5 then {d} + 205.0 else {d} end)"
_RD = "sqrt(ax*ax + ay*ay + az*az)"


@query(
    "b01_sequential_displacement",
    cte("particles", "halos").replace("with ", "with recursive ", 1).rstrip()
    + f""", q as (select *, row_number() over (partition by pid order by halo_id) as k from (select p.pid, h.*, {dist_sql()} as d from particles p, halos h where p.sim = 'dmo') where d <= r200 * 5.0::double),
 mv as (select pid, mass, x, y, z, 0 as k from particles where sim = 'dmo' union all
  select pid, mass, x + s * ax / greatest(rr, 1e-10), y + s * ay / greatest(rr, 1e-10), z + s * az / greatest(rr, 1e-10), k from (select *, {_lookup_sql('(rr / r200)', 'log_mass')} as s from (select *, {_RD} as rr from
   (select m.pid, m.mass, m.x, m.y, m.z, q.k, q.r200, q.log_mass, {_BR('(m.x - q.hx)')} as ax, {_BR('(m.y - q.hy)')} as ay, {_BR('(m.z - q.hz)')} as az from mv m join q on q.pid = m.pid and q.k = m.k + 1)))),
 fin as (select *, row_number() over (partition by pid order by k desc) as last from mv) select pid, mass, {', '.join(R(_PM(c)) + f' as {c}' for c in ('x', 'y', 'z'))} from fin where last = 1""",
)
def _(spark, sf):
    p = b.particles(spark, sf).where(F.col("sim") == "dmo").select("pid", "mass", "x", "y", "z")
    out = bcm.push_sequential(
        p, b.halos(spark, sf), F.col("r200") * 5.0, "halo_id", "r200", R_KNOTS, _row(), ["r200", "log_mass"], max_radius=b.MAX_R200 * 5
    )
    return out.select("pid", "mass", *[r(c).alias(c) for c in ("x", "y", "z")])


@query(
    "b03_parameter_sets",
    "with c as (select case c_nationkey % 3 when 0 then 'schneider19' when 1 then 'schneider25' else 'arico20' end as model, count(*) as n_halos from customer group by all), "
    + "p(model, name, value) as (values "
    + ", ".join(f"('{m}', '{n}', {num(v)})" for m, n, v in __import__("fieldloom.constants", fromlist=["x"]).bcm_parameter_rows())
    + f") select model, name, {R('log10(value + 20)')} as log_value, n_halos from p join c using (model)",
)
def _(spark, sf):
    from ..constants import bcm_parameter_rows
    from ..sources.tables import read_table

    use = read_table(spark, sf, "customer").selectExpr(
        "case c_nationkey % 3 when 0 then 'schneider19' when 1 then 'schneider25' else 'arico20' end as model"
    )
    use = use.groupBy("model").agg(F.count(F.lit(1)).alias("n_halos"))
    params = spark.createDataFrame(bcm_parameter_rows(), "model string, name string, value double")
    return params.join(use, "model").select("model", "name", r(F.log10(F.col("value") + 20.0)).alias("log_value"), "n_halos")


@query(
    "b04_displacement_lookup",
    cte("pairs") + f"select pid, halo_id, {R(_lookup_sql('(d / r200)', 'log_mass'))} as shift from pairs",
)
def _(spark, sf):
    # a halo's row of the table is made once, before it meets particles
    p = b.particles(spark, sf).select("pid", "x", "y", "z")
    h = b.halos(spark, sf).withColumn("row", _row())
    pairs = spatial.ball_join(p, h, F.col("r200") * b.REACH, max_radius=b.MAX_R200 * b.REACH)
    shifted = pairs.withColumn("shift", bcm.along_row(F.col("d") / F.col("r200"), R_KNOTS, F.col("row")))
    return shifted.select("pid", "halo_id", r_many(F.col("shift")).alias("shift"))


@query(
    "b05_displaced_masses",
    cte("particles", "halos").rstrip()
    + f""", {_additive_sql('5.0::double')}, pp as (select h.halo_id, m.mass, {dist_sql('m', 'h')} / h.r200 as r from moved m, halos h), rad as (select unnest({num_list(STATS_RADII)}) as radius)
 select halo_id, radius, sum(mass) as m_total, count(*) as n_part from pp, rad where r <= radius and r <= 5.0::double group by all""",
)
def _(spark, sf):
    w = profiles.ball_masses(_displaced(spark, sf), b.halos(spark, sf), 5.001, b.MAX_R200 * 5.1)
    return w.select("halo_id", "radius", "m_total", "n_part")


_EDGES = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


@query(
    "b06_enclosed_by_quadrature",
    cte("pairs", "halos").rstrip()
    + f""", pr as (select halo_id, sim, r200, least(cast(floor(r) as int), 4) as bin, sum(mass) as mass from pairs group by all),
 f as (select halo_id, sim, (bin + 0.5::double) * r200 as r_mid, mass / ({num(4.0 / 3.0 * 3.141592653589793)} * r200*r200*r200 * ((bin+1)*(bin+1)*(bin+1) - bin*bin*bin)) * pow((bin + 0.5::double) * r200, 2) as g from pr),
 a as (select *, coalesce((g + lag(g) over w) / 2 * (r_mid - lag(r_mid) over w), 0) as area from f window w as (partition by halo_id, sim order by r_mid))
 select halo_id, sim, {R('r_mid')} as r_mid, {R(f'{num(4 * 3.141592653589793)} * sum(area) over (partition by halo_id, sim order by r_mid)', 5)} as enclosed from a""",
)
def _(spark, sf):
    p = profiles.ball_profile(b.particles(spark, sf), b.halos(spark, sf), b.REACH, b.MAX_R200 * b.REACH, _EDGES, "hist", ("halo_id", "r200"), "sim")
    d = profiles.add_density(p, _EDGES).withColumn("r_mid", (F.col("bin") + F.lit(0.5)) * F.col("r200"))
    t = bcm.trapezoid_enclosed(d, ["halo_id", "sim"])
    return t.select("halo_id", "sim", r("r_mid").alias("r_mid"), r("enclosed", 5).alias("enclosed"))


@query(
    "b07_power_suppression",
    f"with k as (select distinct cast(1 + l_partkey % 500 as double) / 10 as k from lineitem) select k, {R('1 - 0.85::double * pow(k / 10, 0.6::double) / (1 + pow(k / 10, 0.6::double))')} as ratio from k",
)
def _(spark, sf):
    from ..sources.tables import read_table

    k = read_table(spark, sf, "lineitem").selectExpr("cast(1 + l_partkey % 500 as double) / 10D as k").distinct()
    return k.select("k", r(bcm.power_suppression(F.col("k"), 0.3, 0.6)).alias("ratio"))

"""Queries over scalar geometry, cosmology and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BOX_SIZE, OMEGA_M, SNAPSHOT_ORDER, SPEED_OF_LIGHT
from ..functions import cosmology as cos
from ..functions import geometry as geo
from ..functions.bins import bin_table
from ..operators import manifest
from ..operators.spatial import ball_join
from ..sources.config import transform_rows, transform_table
from ..sources.tables import read_table
from . import bindings as b
from .bindings import R, cte, dist_sql, min_image_sql, num, query, r

L = BOX_SIZE
_PM = lambda e: f"((({e}) % 205.0::double) + 205.0::double) % 205.0::double"
# particles shifted by a supplier-dependent amount that leaves the box on both sides
_SH = "s as (select pid, x + (l_suppkey - 50) * 7.25::double as u, x, y, z, l_suppkey from particles)"


def _shifted(spark, sf):
    return b.particles(spark, sf).withColumn("u", F.col("x") + (F.col("l_suppkey") - 50) * F.lit(7.25))


@query("p01_periodic_wrap", cte("particles").rstrip() + f", {_SH} select pid, {R(_PM('u'), 4)} as u from s")
def _(spark, sf):
    return _shifted(spark, sf).select("pid", r(geo.wrap(F.col("u"), L), 4).alias("u"))


_TO_HALO = """j as (select p.pid, p.x, p.y, p.z, p.mass, h.* from particles p join halos h on h.halo_id = p.l_suppkey)"""


def _to_halo(spark, sf):
    """Each particle next to the halo named by its supplier key."""
    p = b.particles(spark, sf)
    return p.join(b.halos(spark, sf), p.l_suppkey == F.col("halo_id"))


@query("p02_min_image", cte("particles", "halos").rstrip() + f", {_TO_HALO} select pid, halo_id, {R(min_image_sql('x', 'hx'), 4)} as dx from j")
def _(spark, sf):
    return _to_halo(spark, sf).select("pid", "halo_id", r(geo.min_image(F.col("x") - F.col("hx"), L), 4).alias("dx"))


@query(
    "p03_min_image_branch",
    cte("particles", "halos").rstrip() + f", {_TO_HALO} select pid, halo_id, {R('case when x - hx > 102.5 then x - hx - 205.0 when x - hx < -102.5 then x - hx + 205.0 else x - hx end', 4)} as dx from j",
)
def _(spark, sf):
    return _to_halo(spark, sf).select("pid", "halo_id", r(geo.min_image_branch(F.col("x") - F.col("hx"), L), 4).alias("dx"))


@query("p04_periodic_distance", cte("particles", "halos").rstrip() + f", {_TO_HALO} select pid, halo_id, {R(dist_sql('j', 'j'), 5)} as d from j")
def _(spark, sf):
    c = lambda names: tuple(F.col(n) for n in names)
    d = geo.periodic_distance(c(("x", "y", "z")), c(("hx", "hy", "hz")), L)
    return _to_halo(spark, sf).select("pid", "halo_id", r(d, 5).alias("d"))


@query(
    "p05_recentre",
    cte("particles", "halos").rstrip() + f", {_TO_HALO} select pid, halo_id, {R(min_image_sql('x', 'hx') + ' + 102.5', 4)} as centred, {R('hx + ' + min_image_sql('x', 'hx'), 4)} as unwrapped from j",
)
def _(spark, sf):
    x, h = F.col("x"), F.col("hx")
    return _to_halo(spark, sf).select("pid", "halo_id", r(geo.recentre(x, h, L), 4).alias("centred"), r(geo.unwrap_about(x, h, L), 4).alias("unwrapped"))


@query(
    "p06_replicate_images",
    cte("halos").rstrip()
    + """, s as (select unnest([-1, 0, 1]) as s) select halo_id, a.s as sx, b.s as sy, c.s as sz, round(hx + a.s * 205.0::double, 4) + 0 as x, round(hy + b.s * 205.0::double, 4) + 0 as y, round(hz + c.s * 205.0::double, 4) + 0 as z from halos, s a, s b, s c""",
)
def _(spark, sf):
    h = b.halos(spark, sf).select("halo_id", F.col("hx").alias("x"), F.col("hy").alias("y"), F.col("hz").alias("z"))
    out = geo.replicate(h, L)
    return out.select("halo_id", "sx", "sy", "sz", *[r(c, 4).alias(c) for c in ("x", "y", "z")])


def _transforms_sql() -> str:
    rows = ", ".join(
        f"({lp}, {s}, {d}, {num(x)}, {num(y)}, {num(z)}, {str(f).lower()})" for lp, s, d, x, y, z, f in transform_rows()
    )
    return f"tr(lp, snap_index, direction, dx, dy, dz, flip) as (values {rows})"


TRANSFORMS_SQL = _transforms_sql()
_MOVED = ", ".join(
    f"{_PM(f'case when flip then 205.0::double - ({c} + d{c}) else {c} + d{c} end')} as t{c}" for c in ("x", "y", "z")
)
MOVED_SQL = f"""mv as (select p.pid, p.mass, p.sim, tr.lp, tr.snap_index, tr.direction, {_MOVED} from particles p join tr using (snap_index)),
pl as (select *, case direction when 0 then ty else tx end as u, case direction when 2 then ty else tz end as v, case direction when 0 then tx when 1 then ty else tz end as depth from mv)"""


@query(
    "p07_transform",
    cte("particles").rstrip() + f", {TRANSFORMS_SQL}, {MOVED_SQL} select lp, snap_index, count(*) as n, {R('avg(tx)', 5)} as mx, {R('avg(ty)', 5)} as my, {R('avg(tz)', 5)} as mz from pl group by all",
)
def _(spark, sf):
    p = b.particles(spark, sf).join(F.broadcast(transform_table(spark)), "snap_index")
    t = lambda c: geo.transform_coordinate(F.col(c), F.col(f"d{c}"), F.col("flip"), L)
    return p.groupBy("lp", "snap_index").agg(
        F.count(F.lit(1)).alias("n"), *[r(F.avg(t(c)), 5).alias(f"m{c}") for c in ("x", "y", "z")]
    )


@query(
    "p07_transform_per_axis",
    cte("particles").rstrip()
    + f""", {TRANSFORMS_SQL} select lp, count(*) as n, {R('avg(' + _PM('case when flip then -(x + dx) else x + dx end') + ')', 5)} as mx from particles join tr using (snap_index) group by all""",
)
def _(spark, sf):
    p = b.particles(spark, sf).join(F.broadcast(transform_table(spark)), "snap_index")
    t = geo.transform_coordinate_per_axis(F.col("x"), F.col("dx"), F.col("flip"), L)
    return p.groupBy("lp").agg(F.count(F.lit(1)).alias("n"), r(F.avg(t), 5).alias("mx"))


@query(
    "p08_projection_axes",
    cte("particles").rstrip() + """, d as (select *, l_linenumber % 3 as dir from particles) select pid, case dir when 0 then y else x end as u, case dir when 2 then y else z end as v,
 case dir when 1 then z when 0 then y else x end as cu, case dir when 1 then x when 0 then z else y end as cv, case dir when 0 then x when 1 then y else z end as depth from d""",
)
def _(spark, sf):
    p = b.particles(spark, sf).withColumn("dir", F.col("l_linenumber") % 3)
    xyz = [F.col(c) for c in ("x", "y", "z")]
    u, v, depth = geo.projection_axes(F.col("dir"), *xyz)
    cu, cv, _d = geo.projection_axes(F.col("dir"), *xyz, cyclic=True)
    return p.select("pid", u.alias("u"), v.alias("v"), cu.alias("cu"), cv.alias("cv"), depth.alias("depth"))


@query(
    "p09_transform_table",
    cte("particles").rstrip() + f", {TRANSFORMS_SQL} select lp, snap_index, direction, {R('dx')} as dx, {R('dy')} as dy, {R('dz')} as dz, flip, n from tr join (select snap_index, count(*) as n from particles group by all) using (snap_index)",
)
def _(spark, sf):
    n = b.particles(spark, sf).groupBy("snap_index").agg(F.count(F.lit(1)).alias("n"))
    t = transform_table(spark).join(n, "snap_index")
    return t.select("lp", "snap_index", "direction", r("dx").alias("dx"), r("dy").alias("dy"), r("dz").alias("dz"), "flip", "n")


@query("p10_depth_slice", cte("particles") + "select pid, cast(floor(z / (205.0::double / 2)) as bigint) as slice from particles")
def _(spark, sf):
    return b.particles(spark, sf).select("pid", geo.depth_slice(F.col("z"), L, 2).alias("slice"))


_FIELDS = "['Coordinates','GroupPos','Masses','GroupMass','Velocities','GroupVel','Group_R_Crit200','SubhaloRadius','ParticleIDs','MassPos']"


@query(
    "p11_convert_units",
    cte("particles").rstrip()
    + f""", f as (select pid, mass, {_FIELDS}[cast(l_partkey_mod as int) + 1] as field from (select *, pid % 10 as l_partkey_mod from particles)),
 g as (select *, lower(field) as n from f) select pid, field, {R("case when n like '%coordinate%' or n like '%pos%' then mass * 0.8 / 0.6774 / 1000 when n like '%mass%' then mass * 1e10 / 0.6774 / 1e10 when n like '%vel%' then mass when n like '%radius%' or contains(n, 'r_') then mass * 0.8 / 0.6774 / 1000 else mass end", 7)} as value from g""",
)
def _(spark, sf):
    names = ["Coordinates", "GroupPos", "Masses", "GroupMass", "Velocities", "GroupVel", "Group_R_Crit200", "SubhaloRadius", "ParticleIDs", "MassPos"]
    p = b.particles(spark, sf).withColumn("field", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("pid") % 10 + 1).cast("int")))
    v = geo.convert_units(F.col("mass"), F.col("field"), 0.6774, 0.8)
    scaled = F.when(F.lower("field").contains("mass") & ~F.lower("field").contains("pos"), v / F.lit(1e10)).otherwise(v)
    return p.select("pid", "field", r(scaled, 7).alias("value"))


@query(
    "p12_derived_columns",
    cte("halos") + f"select halo_id, {R('log10(pow(10.0::double, log_mass))')} as log_mass, {R('1 / (1 + r200)')} as scale_factor, {R('pow(10.0::double, log_mass - 13)')} as mass_ratio from halos",
)
def _(spark, sf):
    m = F.pow(F.lit(10.0), F.col("log_mass"))
    ratio = F.try_divide(F.pow(F.lit(10.0), F.col("log_mass") - F.lit(13.0)), F.lit(1.0))
    return b.halos(spark, sf).select(
        "halo_id", r(F.log10(m)).alias("log_mass"), r(cos.scale_factor(F.col("r200"))).alias("scale_factor"), r(ratio).alias("mass_ratio")
    )


@query(
    "p13_plane_numbers",
    f"with e as (select distinct cast(o_custkey % 40 as int) as plane from orders) select plane, {SNAPSHOT_ORDER}[plane // 2 + 1] as snap, plane + 1 as plane_number, cast((plane // 2) * 2 + plane % 2 as int) as file_index from e",
)
def _(spark, sf):
    p = read_table(spark, sf, "orders").select((F.col("o_custkey") % 40).cast("int").alias("plane")).distinct()
    half = F.floor(F.col("plane") / 2).cast("int")
    return p.select("plane", manifest.plane_to_snapshot(F.col("plane")).alias("snap"), (F.col("plane") + 1).alias("plane_number"), (half * 2 + F.col("plane") % 2).alias("file_index"))


_E = lambda z: f"sqrt({num(OMEGA_M)} * (1 + {z})*(1 + {z})*(1 + {z}) + {num(1.0 - OMEGA_M)})"
CHI = lambda z: (
    f"({num(SPEED_OF_LIGHT / 100.0)} * ({z} / 999.0::double) * (list_sum(list_transform(range(1, 999), lambda k: 1 / {_E(f'({z} / 999.0::double * k)')})) + (1 / {_E('0::double')} + 1 / {_E(z)}) / 2))"
)


@query("p14_comoving_distance", cte("redshifts") + f"select z, n_orders, {R(_E('z'))} as e_z, {R(CHI('z'), 5)} as chi from redshifts")
def _(spark, sf):
    z = F.col("z")
    return b.redshifts(spark, sf).select("z", "n_orders", r(cos.efunc(z)).alias("e_z"), r(cos.comoving_distance(z), 5).alias("chi"))


_INV = lambda a: f"(1 / sqrt({num(OMEGA_M)} * {a} + {num(1.0 - OMEGA_M)} * {a}*{a}*{a}*{a}))"
_FWD = f"({num(SPEED_OF_LIGHT / 100.0)} * ((1 - a) / 999.0::double) * (list_sum(list_transform(range(1, 999), lambda k: {_INV('(a + (1 - a) / 999.0::double * k)')})) + ({_INV('a')} + {_INV('1.0::double')}) / 2))"


@query(
    "p14_scale_factor_at_distance",
    cte("redshifts").replace("with ", "with recursive ", 1).rstrip()
    + f""", nt as (select n_orders, z * 1500 as chi, 0.5::double as a, 0 as k from redshifts union all select n_orders, chi, greatest(0.01, least(0.9999, a + ({_FWD} - chi) / ({num(SPEED_OF_LIGHT / 100.0)} * {_INV('a')}))), k + 1 from nt where k < 12)
 select n_orders, {R('chi', 4)} as chi, {R('a', 8)} as a from nt where k = 12""",
)
def _(spark, sf):
    chi = b.redshifts(spark, sf).select("n_orders", (F.col("z") * 1500.0).alias("chi"))
    return chi.select("n_orders", r("chi", 4).alias("chi"), r(cos.scale_factor_at(F.col("chi")), 8).alias("a"))


_SC = SPEED_OF_LIGHT**2 / (4.0 * 3.141592653589793 * 4.30091727e-9)


@query(
    "p15_critical_surface_density",
    cte("redshifts").rstrip()
    + f", c as (select z, {CHI('z')} as cl, {CHI('2.568::double')} as cs from redshifts where z < 2.568) select z, {R(f'{num(_SC)} * cs / (cl * (cs - cl) / (1 + z)) / 1e15', 8)} as sigma_crit from c",
)
def _(spark, sf):
    z = b.redshifts(spark, sf).where(F.col("z") < 2.568)
    return z.select("z", r(cos.critical_surface_density(F.col("z"), F.lit(2.568)) / F.lit(1e15), 8).alias("sigma_crit"))


@query(
    "p16_shell_volume",
    cte("halos").rstrip()
    + f", s as (select k as bin, k * 0.5::double as lo, (k + 1) * 0.5::double as hi from (select unnest(range(10)) as k)) select halo_id, cast(bin as int) as bin, {R(f'{num(4.0 / 3.0 * 3.141592653589793)} * r200*r200*r200 * (hi*hi*hi - lo*lo*lo)')} as volume from halos, s",
)
def _(spark, sf):
    bins = bin_table(spark, [0.5 * k for k in range(11)])
    h = b.halos(spark, sf).crossJoin(F.broadcast(bins))  # ten fixed bins
    return h.select("halo_id", "bin", r(geo.shell_volume(F.col("r200"), F.col("lo"), F.col("hi"))).alias("volume"))


_BAR = 27.7536627 * OMEGA_M * 205.0 * 205.0 * 102.5 / (32 * 32)


@query("p17_density_contrast", cte("particles") + f"select pid, {R(f'(mass * 1e12::double / 1e10::double / {num(_BAR)} - 1) * 102.5', 6)} as delta from particles")
def _(spark, sf):
    d = geo.density_contrast(F.col("mass") * F.lit(1e12), 32, 205.0, 102.5)
    return b.particles(spark, sf).select("pid", r(d, 6).alias("delta"))


# --- filters ---------------------------------------------------------------------

_INF = float("inf")


@query("f01_mass_filter", cte("halos").rstrip() + ", m as (select *, pow(10.0::double, log_mass - 12) as m from halos) select halo_id, log_mass from m where m >= 9.5 and m < 'inf'::double")
def _(spark, sf):
    m = F.pow(F.lit(10.0), F.col("log_mass") - F.lit(12.0))
    return b.halos(spark, sf).where((m >= 9.5) & (m < F.lit(_INF))).select("halo_id", "log_mass")


@query("f02_log_mass_filter", cte("halos") + "select halo_id, log_mass from halos where log_mass >= 12.5 and log_mass < 13.5")
def _(spark, sf):
    from ..operators.replace import select_halos

    return select_halos(b.halos(spark, sf), 12.5, 13.5).select("halo_id", "log_mass")


@query("f03_index_filter", cte("halos") + "select halo_id, log_mass from halos where halo_id in (select c_custkey from customer where c_acctbal > 0)")
def _(spark, sf):
    ids = read_table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("halo_id"))
    return b.halos(spark, sf).join(ids, "halo_id", "left_semi").select("halo_id", "log_mass")


@query("f04_closed_mass_range", cte("halos") + "select halo_id, log_mass from halos where log_mass between 12.5 and 13.5")
def _(spark, sf):
    return b.halos(spark, sf).where(F.col("log_mass").between(12.5, 13.5)).select("halo_id", "log_mass")


@query("f05_radius_and_type", cte("pairs") + f"select pid, halo_id, mass, {R('r')} as r from pairs where r <= 2.0 and ptype = 0")
def _(spark, sf):
    # only the type asked for, and a ball as large as needed: a hair more than two radii, the quotient decides
    p = b.particles(spark, sf).where(F.col("ptype") == 0).select("pid", "mass", "x", "y", "z")
    reach = 2.0 * (1 + 1e-9)
    pairs = ball_join(p, b.halos(spark, sf), F.col("r200") * reach, max_radius=b.MAX_R200 * reach).withColumn("r", F.col("d") / F.col("r200"))
    return pairs.where(F.col("r") <= 2.0).select("pid", "halo_id", "mass", r("r").alias("r"))


@query(
    "f06_snr_range",
    cte("kappa").rstrip() + f", s as (select *, (v - avg(v) over (partition by map_id)) / stddev_pop(v) over (partition by map_id) as snr from kappa) select map_id, i, j, {R('snr')} as snr from s where snr between 1.5 and 2.5",
)
def _(spark, sf):
    from ..operators.images import standardise

    return standardise(b.kappa(spark, sf), ["map_id"]).where(F.col("snr").between(1.5, 2.5)).select("map_id", "i", "j", r("snr").alias("snr"))


_ORD = "select o_orderkey from orders where o_orderpriority = '1-URGENT'"


def _urgent(spark, sf):
    return read_table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))


@query("f07_include_ids", cte("particles") + f"select pid, mass from particles where l_orderkey in ({_ORD})")
def _(spark, sf):
    return b.particles(spark, sf).join(_urgent(spark, sf), "l_orderkey", "left_semi").select("pid", "mass")


@query("f07_exclude_ids", cte("particles") + f"select pid, mass from particles where l_orderkey not in ({_ORD})")
def _(spark, sf):
    return b.particles(spark, sf).join(_urgent(spark, sf), "l_orderkey", "left_anti").select("pid", "mass")


@query("f08_halo_lookup", cte("halos") + "select halo_id, hx, hy, hz, log_mass, r200 from halos where halo_id = 7")
def _(spark, sf):
    return b.halos(spark, sf).where(F.col("halo_id") == 7).select("halo_id", "hx", "hy", "hz", "log_mass", "r200")

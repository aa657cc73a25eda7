"""Queries over range joins, matching and replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..constants import RADIUS_FACTORS, REPLACE_MASS_BINS
from ..operators import matching, replace, rings, spatial, windows
from ..sources import tables
from ..sources.config import plane_table
from ..sources.products import snr_summary
from . import bindings as b
from .bindings import R, cte, dist_sql, num, query, r, r_many

MAXR = b.MAX_R200 * b.REACH

_enc_frac = lambda c: R(f"case when m_total > 0 then ({c}) / m_total else 0::double end")


@query(
    "j01_halo_ball_join",
    cte("pairs") + f"select pid, halo_id, sim, ptype, mass, {R('r')} as r from pairs",
)
def _(spark, sf):
    return b.pairs(spark, sf).select("pid", "halo_id", "sim", "ptype", "mass", r_many(F.col("r")).alias("r"))


@query(
    "j02_single_sphere",
    cte("particles") + f"select pid, mass, {R('d')} as d from (select *, {dist_sql('p', 'c')} as d from particles p, (select 3.0::double hx, 200.0::double hy, 100.0::double hz) c) where d <= 30.0",
)
def _(spark, sf):
    return spatial.in_sphere(b.particles(spark, sf), (3.0, 200.0, 100.0), 30.0).select("pid", "mass", r("d").alias("d"))


@query(
    "j04_near_any_halo",
    cte("particles", "halos")
    + f"select pid, mass, ptype from particles p where exists (select 1 from halos h where {dist_sql()} <= h.r200 * 3.0::double)",
)
def _(spark, sf):
    return spatial.ball_join(
        b.particles(spark, sf), b.halos(spark, sf), F.col("r200") * 3.0, max_radius=b.MAX_R200 * 3, how="left_semi"
    ).select("pid", "mass", "ptype")


@query(
    "j05_id_lookup",
    cte("dmo_members", "hydro_members")
    + "select d.pid, d.halo as dmo, coalesce(h.halo, -1) as halo from dmo_members d left join (select pid, min(halo) as halo from hydro_members group by pid) h on d.pid = h.pid",
)
def _(spark, sf):
    q = b.dmo_members(spark, sf).withColumnRenamed("halo", "dmo")
    return matching.lookup(q, b.hydro_members(spark, sf)).select("pid", "dmo", "halo")


_OVERLAPS = """, nd as (select halo as dmo, count(*) as n_dmo from dmo_members group by all),
nh as (select halo as hydro, count(*) as n_hydro from hydro_members group by all),
ov as (select d.halo as dmo, h.halo as hydro, count(*) as shared from dmo_members d join hydro_members h using (pid) group by all),
full_ov as (select * from ov join nd using (dmo) join nh using (hydro)),
best as (select *, shared / n_dmo::double as forward, shared / n_hydro::double as reverse from
 (select *, row_number() over (partition by dmo order by shared desc, hydro) as k from full_ov) where k = 1),
kept as (select *, sqrt(forward * reverse) as score from best where forward >= 0.5 and reverse >= 0.5),
one as (select * from (select *, row_number() over (partition by hydro order by score desc, dmo) as k2 from kept) where k2 = 1),
two as (select * from (select *, row_number() over (partition by dmo order by score desc, hydro) as k3 from one) where k3 = 1)
"""
_BASE = cte("dmo_members", "hydro_members").rstrip()


def _members(spark, sf):
    return b.dmo_members(spark, sf), b.hydro_members(spark, sf)


@query("j06_overlap_match", _BASE + _OVERLAPS + f"select dmo, hydro, shared, {R('forward')} as forward, {R('reverse')} as reverse, {R('score')} as score from kept")
def _(spark, sf):
    m = matching.best_overlap(*_members(spark, sf))
    return m.select("dmo", "hydro", "shared", r("forward").alias("forward"), r("reverse").alias("reverse"), r("score").alias("score"))


@query("j07_one_to_one", _BASE + _OVERLAPS + f"select dmo, hydro, {R('score')} as score from two")
def _(spark, sf):
    m = matching.one_to_one(matching.best_overlap(*_members(spark, sf)))
    return m.select("dmo", "hydro", r("score").alias("score"))


@query(
    "j08_mutual_best",
    _BASE
    + _OVERLAPS
    + f""", fw as (select * from (select *, row_number() over (partition by dmo order by shared desc, hydro) as a from full_ov) where a = 1),
bw as (select * from (select *, row_number() over (partition by hydro order by shared desc, dmo) as a from full_ov) where a = 1)
select fw.dmo, fw.hydro, {R('least(fw.shared / fw.n_dmo::double, fw.shared / fw.n_hydro::double)')} as score from fw join bw on fw.dmo = bw.dmo and fw.hydro = bw.hydro
where least(fw.shared / fw.n_dmo::double, fw.shared / fw.n_hydro::double) >= 0.5""",
)
def _(spark, sf):
    return matching.mutual_best(*_members(spark, sf)).select("dmo", "hydro", r("score").alias("score"))


@query(
    "j09_matched_catalogue",
    cte("dmo_members", "hydro_members", "halos").rstrip()
    + _OVERLAPS
    + f"""select t.dmo, t.hydro, {R('t.score')} as score, d.log_mass as log_mass_dmo, h.log_mass as log_mass_hydro,
 {R(dist_sql('d', 'h', ('hx', 'hy', 'hz')))} as separation from two t join halos d on d.halo_id = t.dmo join halos h on h.halo_id = t.hydro""",
)
def _(spark, sf):
    m = matching.match_catalogues(*_members(spark, sf))
    h = b.halos(spark, sf)
    side = lambda s: h.select(F.col("halo_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("hx", "hy", "hz", "log_mass")])
    j = m.join(side("dmo"), "dmo").join(side("hydro"), "hydro")
    sep = geo.periodic_distance(
        tuple(F.col(f"{c}_dmo") for c in ("hx", "hy", "hz")), tuple(F.col(f"{c}_hydro") for c in ("hx", "hy", "hz")), 205.0
    )
    return j.select("dmo", "hydro", r("score").alias("score"), "log_mass_dmo", "log_mass_hydro", r(sep).alias("separation"))


_SNAPPED = """with heavy as (select s_suppkey as halo from supplier where 120 + s_suppkey % 30 >= 125),
dm as (select distinct l_linenumber % 2 as snap, l_orderkey as pid, l_suppkey as halo from lineitem where l_suppkey in (select halo from heavy)),
hm as (select distinct l_linenumber % 2 as snap, l_orderkey as pid, case when l_linenumber <= 5 then l_suppkey else (l_suppkey + 1) % (select count(*) from supplier) end as halo from lineitem),
nd as (select snap, halo as dmo, count(*) as n_dmo from dm group by all), nh as (select snap, halo as hydro, count(*) as n_hydro from hm group by all),
ov as (select d.snap, d.halo as dmo, h.halo as hydro, count(*) as shared from dm d join hm h using (snap, pid) group by all),
fo as (select * from ov join nd using (snap, dmo) join nh using (snap, hydro) where n_dmo >= 3),
bs as (select *, sqrt((shared / n_dmo::double) * (shared / n_hydro::double)) as score from (select *, row_number() over (partition by snap, dmo order by shared desc, hydro) as k from fo)
 where k = 1 and shared / n_dmo::double >= 0.5 and shared / n_hydro::double >= 0.5),
o1 as (select * from (select *, row_number() over (partition by snap, hydro order by score desc, dmo) as k2 from bs) where k2 = 1)
"""


@query("j09_matched_by_snapshot", _SNAPPED + f"select snap, dmo, hydro, shared, {R('score')} as score from (select *, row_number() over (partition by snap, dmo order by score desc, hydro) as k3 from o1) where k3 = 1")
def _(spark, sf):
    """Two snapshots with the same ids, the halos above a mass, of at least three particles."""
    n = tables.read_table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    li = tables.read_table(spark, sf, "lineitem")
    halo = F.when(F.col("l_linenumber") <= 5, F.col("l_suppkey")).otherwise((F.col("l_suppkey") + 1) % n)
    member = lambda h: li.select((F.col("l_linenumber") % 2).alias("snap"), F.col("l_orderkey").alias("pid"), h.alias("halo")).distinct()
    heavy = b.halos(spark, sf).select(F.col("halo_id").alias("halo"), F.pow(F.lit(10.0), F.col("log_mass")).alias("mass"))
    dmo = matching.members_of(member(F.col("l_suppkey")), heavy, min_mass=10.0**12.4999)
    m = matching.match_catalogues(dmo, member(halo), min_particles=3, keys=["snap"])
    return m.select("snap", "dmo", "hydro", "shared", r("score").alias("score"))


# customers act as the second catalogue: positions and masses from their keys
_SECOND = """second as (select c_custkey as id2, cast((c_custkey*40087) % 205000 as double)/1000 as hx, cast((c_custkey*71993) % 205000 as double)/1000 as hy,
 cast((c_custkey*13007) % 205000 as double)/1000 as hz, cast(1 + c_custkey % 97 as double) as m2 from customer),
first as (select halo_id as id1, hx as x, hy as y, hz as z, r200, cast(1 + halo_id % 30 as double) as m1 from halos)"""


def _second(spark, sf):
    return tables.read_table(spark, sf, "customer").selectExpr(
        "c_custkey as id2",
        "cast((c_custkey*40087) % 205000 as double)/1000D as hx",
        "cast((c_custkey*71993) % 205000 as double)/1000D as hy",
        "cast((c_custkey*13007) % 205000 as double)/1000D as hz",
        "cast(1 + c_custkey % 97 as double) as m2",
    )


@query(
    "j10_spatial_match",
    cte("halos").rstrip()
    + f""", {_SECOND}, c as (select f.id1, s.id2, {dist_sql('s', 'f', ('hx', 'hy', 'hz'), ('x', 'y', 'z'))} as d, f.r200, s.m2 / f.m1 as ratio from first f, second s)
select id1, id2, {R('d')} as separation, {R('ratio')} as ratio from (select *, row_number() over (partition by id1 order by d, id2) as k from c
 where d <= r200 * 5.0::double and ratio > 0.2::double and ratio < 5.0::double) where k = 1""",
)
def _(spark, sf):
    first = b.halos(spark, sf).selectExpr(
        "halo_id as id1", "hx as x", "hy as y", "hz as z", "r200 as r1", "cast(1 + halo_id % 30 as double) as m1"
    )
    m = spatial.spatial_match(first, _second(spark, sf), reach=5.0)
    return m.select("id1", "id2", r("separation").alias("separation"), r("ratio").alias("ratio"))


def _planes_sql() -> str:
    from ..constants import SOURCE_PLANE_REDSHIFTS

    rows = ", ".join(f"({k + 1}, {num(z)})" for k, z in enumerate(SOURCE_PLANE_REDSHIFTS))
    return f"planes(plane, zs) as (values {rows})"


@query(
    "j11_nearest_source_plane",
    cte("redshifts").rstrip()
    + f""", {_planes_sql()} select z, n_orders, plane from (select r.z, r.n_orders, p.plane, row_number() over (partition by z order by abs(zs - z), plane) as k from redshifts r, planes p) where k = 1""",
)
def _(spark, sf):
    # the plane table has a fixed 40 rows
    z = b.redshifts(spark, sf)
    j = z.crossJoin(F.broadcast(plane_table(spark).select("plane", "z_source")))
    best = j.groupBy("z", "n_orders").agg(F.min(F.struct(F.abs(F.col("z_source") - F.col("z")).alias("d"), "plane")).alias("p"))
    return best.select("z", "n_orders", F.col("p.plane").alias("plane"))


@query(
    "j12_nearest_bin_value",
    cte("summary")
    + f"""select model, bin, {R('s', 4)} as s from (select *, row_number() over (partition by model order by abs(cast(bin as double) - 7.3::double), bin) as k from summary) where k = 1""",
)
def _(spark, sf):
    from ..operators.response import summarise

    s = summarise(b.stats(spark, sf)).withColumn("x", F.col("bin").cast("double"))
    return windows.nearest(s, ["model"], "x", 7.3, ["bin", "s"]).select("model", "bin", r("s", 4).alias("s"))


@query(
    "j13_fetch_by_id",
    cte("particles")
    + """select p.pid, p.ptype, p.mass, o.o_custkey as halo from particles p join orders o on p.l_orderkey = o.o_orderkey where o.o_orderstatus = 'F'""",
)
def _(spark, sf):
    wanted = tables.read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").selectExpr("o_orderkey as l_orderkey", "o_custkey as halo")
    return b.particles(spark, sf).join(wanted, "l_orderkey").select("pid", "ptype", "mass", "halo")


_CONFIGS = ", ".join(f"('{lab}', {num(lo)}, {num(hi)}, {num(f)})" for lo, hi, lab in REPLACE_MASS_BINS for f in RADIUS_FACTORS)


@query(
    "j14_configurations",
    cte("halos").rstrip()
    + f""", c(config, lo, hi, factor) as (values {_CONFIGS}) select config, factor, count(*) as n_halos, {R('sum(r200 * factor)')} as reach
 from halos h, c where log_mass >= lo and log_mass < hi group by all""",
)
def _(spark, sf):
    c = replace.configurations(b.halos(spark, sf), REPLACE_MASS_BINS, RADIUS_FACTORS)
    return c.groupBy("config", "factor").agg(
        F.count(F.lit(1)).alias("n_halos"), r(F.sum(F.col("r200") * F.col("factor"))).alias("reach")
    )


# --- replacement -----------------------------------------------------------------

_IN = lambda p, f, extra="": f"exists (select 1 from halos h where {dist_sql(p)} <= h.r200 * {num(f)} {extra})"
_SEL = "and h.log_mass >= 13.0::double and h.log_mass < 'inf'::double"
_COLS = "pid, ptype, mass"


def _sides(spark, sf):
    p = b.particles(spark, sf)
    return p.where(F.col("sim") == "dmo"), p.where(F.col("sim") == "hydro")


_R01 = f"""select pid, ptype, mass, 'dmo_background' as source from particles p where sim = 'dmo' and not {_IN('p', 3.0, _SEL)}
 union all select pid, ptype, mass, 'hydro_halo' from particles p where sim = 'hydro' and {_IN('p', 3.0, _SEL)}"""


@query("r01_replace_field", cte("particles", "halos") + _R01)
def _(spark, sf):
    dmo, hydro = _sides(spark, sf)
    h = replace.select_halos(b.halos(spark, sf), 13.0, float("inf"))
    return replace.replace_field(dmo, hydro, h, F.col("r200") * 3.0, max_radius=MAXR * 0.6).select("pid", "ptype", "mass", "source")


# hydro halos sit half a radius away from their partner and are a tenth larger
_HH = "hh as (select halo_id, hx + r200 / 2 as hx, hy, hz, log_mass, r200 * 1.1::double as r200 from halos)"


def _hydro_halos(h):
    return h.withColumn("hx", F.col("hx") + F.col("r200") / 2).withColumn("r200", F.col("r200") * 1.1)


@query(
    "r02_replace_hydro_centres",
    cte("particles", "halos").rstrip()
    + f""", {_HH} select pid, ptype, mass, 'dmo_background' as source from particles p where sim = 'dmo' and not {_IN('p', 3.0)}
 union all select pid, ptype, mass, 'hydro_halo' from particles p where sim = 'hydro' and exists (select 1 from hh h where {dist_sql()} <= h.r200 * 3.0::double)""",
)
def _(spark, sf):
    dmo, hydro = _sides(spark, sf)
    h = b.halos(spark, sf)
    return replace.replace_field(
        dmo, hydro, h, F.col("r200") * 3.0, hydro_halos=_hydro_halos(h), max_radius=MAXR * 0.66
    ).select("pid", "ptype", "mass", "source")


@query(
    "r03_replace_from_members",
    cte("particles", "halos", "dmo_members", "hydro_members").rstrip()
    + """, heavy as (select halo_id as halo from halos where log_mass >= 14.0::double)
 select p.pid, p.mass, 'dmo_background' as source from particles p where sim = 'dmo' and l_orderkey not in (select pid from dmo_members join heavy using (halo))
 union all select p.pid, p.mass, 'hydro_halo' from particles p join (select pid as k from hydro_members join heavy using (halo)) m on m.k = p.l_orderkey where sim = 'hydro'""",
)
def _(spark, sf):
    dmo, hydro = _sides(spark, sf)
    keep = lambda d: d.select(F.col("l_orderkey").alias("pid"), F.col("pid").alias("particle"), "mass")
    massive = b.halos(spark, sf).where(F.col("log_mass") >= 14.0).select(F.col("halo_id").alias("halo"))
    heavy = lambda m: m.join(massive, "halo", "left_semi")
    out = replace.replace_from_members(keep(dmo), keep(hydro), heavy(b.dmo_members(spark, sf)), heavy(b.hydro_members(spark, sf)))
    return out.select(F.col("particle").alias("pid"), "mass", "source")


@query(
    "r05_replace_recentred",
    cte("particles", "halos").rstrip()
    + f""", {_HH}, m as (select h.halo_id, h.hx, h.hy, h.hz, h.r200, g.hx as gx, g.hy as gy, g.hz as gz from halos h join hh g using (halo_id))
 select pid, {R('x', 4)} as x, {R('y', 4)} as y, {R('z', 4)} as z, mass, 'dmo_background' as source from particles p where sim = 'dmo' and not {_IN('p', 3.0)}
 union all select pid, {R('((mx % 205.0::double) + 205.0::double) % 205.0::double', 4)} as x, {R('y', 4)}, {R('z', 4)}, mass, 'hydro_halo' from
 (select p.*, p.x + {b.min_image_sql('m.hx', 'm.gx')} as mx from particles p, m where sim = 'hydro' and {dist_sql('p', 'm', hc=('gx', 'gy', 'gz'))} <= m.r200 * 3.0::double)""",
)
def _(spark, sf):
    dmo, hydro = _sides(spark, sf)
    h = b.halos(spark, sf)
    g = _hydro_halos(h).select("halo_id", F.col("hx").alias("gx"), F.col("hy").alias("gy"), F.col("hz").alias("gz"))
    out = replace.replace_recentred(dmo, hydro, h.join(g, "halo_id"), F.col("r200") * 3.0, max_radius=MAXR * 0.6)
    return out.select("pid", *[r_many(F.col(c), 4).alias(c) for c in ("x", "y", "z")], "mass", "source")


@query("r07_replace_measures", cte("particles", "halos") + f"select source, count(*) as n, sum(mass) as mass from ({_R01}) group by all")
def _(spark, sf):
    dmo, hydro = _sides(spark, sf)
    h = replace.select_halos(b.halos(spark, sf), 13.0, float("inf"))
    return replace.measures(replace.replace_field(dmo, hydro, h, F.col("r200") * 3.0, max_radius=MAXR * 0.6))


@query(
    "r08_replace_validation",
    cte("particles", "halos", "pairs").rstrip()
    + f""", f as ({_R01}), t as (select sum(mass) as mass, count(*) as n from f), d as (select sum(mass) as dm from particles where sim = 'dmo'),
 ph as (select h.halo_id, count(pid) as n from halos h left join (select * from pairs where sim = 'hydro' and d <= r200 * 3.0::double) q on q.halo_id = h.halo_id where h.log_mass >= 13.0::double group by all)
 select t.mass, t.n, {R('abs(t.mass - dm) / dm')} as mass_error, abs(t.mass - dm) / dm < 0.1 as mass_ok, true as coords_ok,
 (select count(*) from ph) as n_halos, (select count(*) from ph where n < 100) as n_sparse from t, d""",
)
def _(spark, sf):
    dmo, hydro = _sides(spark, sf)
    h = replace.select_halos(b.halos(spark, sf), 13.0, float("inf"))
    field = replace.replace_field(dmo, hydro, h, F.col("r200") * 3.0, max_radius=MAXR * 0.6)
    inside = spatial.ball_join(hydro.select("pid", "x", "y", "z"), h, F.col("r200") * 3.0, max_radius=MAXR * 0.6)
    counts = inside.groupBy("halo_id").agg(F.count(F.lit(1)).alias("n"))
    per = h.select("halo_id").join(counts, "halo_id", "left").select("halo_id", F.coalesce("n", F.lit(0)).alias("n"))
    total = dmo.agg(F.sum("mass").alias("dm"))
    checks = replace.validate(field, total, per)
    return checks.select("mass", "n", r("mass_error").alias("mass_error"), "mass_ok", "coords_ok", "n_halos", "n_sparse")


@query(
    "r09_extract_by_type",
    cte("pairs") + "select halo_id, sim, ptype, count(*) as n, sum(mass) as mass from pairs group by all",
)
def _(spark, sf):
    by = b.particles(spark, sf).withColumn("kind", F.concat_ws(" ", "sim", F.col("ptype").cast("string")))
    reach = F.col("r200") * F.lit(b.REACH)
    out = rings.in_rings(by, b.halos(spark, sf), reach, "r200", [0.0, float("inf")], "hist", "kind", ["halo_id"], {"mass": F.col("mass")}, b.MAX_R200 * b.REACH)
    sim, ptype = (F.split_part("kind", F.lit(" "), F.lit(k)) for k in (1, 2))
    return out.select("halo_id", sim.alias("sim"), ptype.cast("int").alias("ptype"), "n", "mass")

"""Queries over scans and sinks: each writes, reads back or reshapes derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BOX_SIZE, DM_PARTICLE_MASS, LENS_PLANE_REDSHIFTS, SNAPSHOT_ORDER, lens_planes
from ..operators import gridding, lensing
from ..operators.spatial import ball_join
from ..session import shared_folder
from ..sources import planes, products, tables
from ..sources.config import expand, plane_table
from ..streaming import snapshots
from . import bindings as b
from .bindings import R, cte, dist_sql, num, query, r
from .grids import _tsc_sql
from .maps import N as MAP, _FIVE, _K, _P5, dft_sql

_DM = DM_PARTICLE_MASS[625]


@query(
    "s01_particle_scan",
    cte("particles").rstrip()
    + f""" select pid, sim, ptype, {R('x * 1000 * 0.001::double', 5)} as x, {R(f"case when ptype = 1 then case sim when 'dmo' then {num(_DM['dmo'])} else {num(_DM['hydro'])} end else mass end")} as mass from particles""",
)
def _(spark, sf):
    raw = b.particles(spark, sf).select(
        "pid", "sim", "ptype", *[(F.col(c) * 1000.0).alias(c) for c in ("x", "y", "z")], F.when(F.col("ptype") != 1, F.col("mass")).alias("mass")
    )
    p = tables.scale_particles(raw, 625, F.col("sim"))
    return p.select("pid", "sim", "ptype", r("x", 5).alias("x"), r(F.col("mass") / 1e10).alias("mass"))


@query("s02_scan_types", cte("particles") + "select sim, ptype, count(*) as n, sum(mass) as mass from particles where (sim = 'dmo' and ptype = 1) or (sim = 'hydro' and ptype in (0, 1, 4)) group by all")
def _(spark, sf):
    p = b.particles(spark, sf)
    both = tables.scan_types(p, "dmo", [1]).unionByName(tables.scan_types(p, "hydro", [0, 1, 4]))
    return both.groupBy("sim", "ptype").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))


_LISTED = "select o_orderkey from orders where o_orderstatus = 'F'"


@query("s03_scan_with_flag", cte("particles") + f"select pid, mass, l_orderkey not in ({_LISTED}) as keep from particles")
def _(spark, sf):
    ids = tables.read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("pid"))
    p = b.particles(spark, sf).select(F.col("l_orderkey").alias("pid"), F.col("pid").alias("particle"), "mass")
    return tables.flag_members(p, ids).select(F.col("particle").alias("pid"), "mass", "keep")


@query("s04_chunk_accumulation", cte("particles") + "select ptype, cast(floor(z / 20.5::double) as bigint) as slab, sum(mass) as mass, count(*) as n from particles group by all")
def _(spark, sf):
    folder = shared_folder(spark, "chunks")
    schema = tables.read_table(spark, sf, "lineitem").schema
    chunks = snapshots.stream_chunks(spark, f"{sf}/lineitem.parque[t]", schema)  # one file or a folder of parts

    def partial(batch):
        z = "cast((l_suppkey*15013 + l_orderkey*389 + l_linenumber*7) % 205000 as double)/1000D"
        p = batch.selectExpr("case l_returnflag when 'A' then 0 when 'N' then 1 else 4 end as ptype", f"{z} as z", "l_quantity as mass")
        p = p.withColumn("slab", F.floor(F.col("z") / 20.5))
        return p.groupBy("ptype", "slab").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))

    snapshots.accumulate(chunks, partial, f"{folder}/sums", f"{folder}/state", ["ptype", "slab"]).awaitTermination()
    return snapshots.combine(spark, f"{folder}/sums", ["ptype", "slab"], ["mass", "n"])


@query("s05_scan_near_halos", cte("particles", "halos").rstrip() + f" select pid, halo_id, mass from particles p, halos h where {dist_sql()} < h.r200 * 2.0::double")
def _(spark, sf):
    p = b.particles(spark, sf).select("pid", "mass", "x", "y", "z")
    return ball_join(p, b.halos(spark, sf), F.col("r200") * 2.0, max_radius=b.MAX_R200 * 2, strict=True).select("pid", "halo_id", "mass")


@query(
    "s06_offset_table",
    "with c as (select l_suppkey as halo, count(*) as n from lineitem group by all) select halo, n, cast(sum(n) over (order by halo) as bigint) - n as start, cast(sum(n) over (order by halo) as bigint) as stop from c",
)
def _(spark, sf):
    c = tables.read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("halo")).agg(F.count(F.lit(1)).alias("n"))
    return tables.offsets(c, "halo", "n").select("halo", "n", "start", "stop")


@query(
    "s07_halo_catalogue",
    cte("halos", "particles").rstrip()
    + ", m as (select l_suppkey as halo_id, " + ", ".join(f"sum(case when ptype = {t} then mass else 0::double end) as m{t}, count(*) filter (ptype = {t}) as n{t}" for t in range(6)) + " from particles group by all) select halo_id, log_mass, r200, hx, hy, hz, "
    + ", ".join(f"m{t}, n{t}" for t in range(6)) + " from halos join m using (halo_id)",
)
def _(spark, sf):
    p = b.particles(spark, sf)
    per = p.groupBy(F.col("l_suppkey").alias("halo_id")).agg(
        F.array(*[F.sum(F.when(F.col("ptype") == t, F.col("mass")).otherwise(F.lit(0.0))) for t in range(6)]).alias("mass_by_type"),
        F.array(*[F.count_if(F.col("ptype") == t) for t in range(6)]).alias("n_by_type"),
    )
    flat = b.halos(spark, sf).join(per, "halo_id")
    cols = [F.col("mass_by_type")[t].alias(f"m{t}") for t in range(6)] + [F.col("n_by_type")[t].alias(f"n{t}") for t in range(6)]
    return flat.select("halo_id", "log_mass", "r200", "hx", "hy", "hz", *cols)


@query(
    "s08_match_scan",
    cte("halos") + "select h.halo_id, h.hx as dmo_x, coalesce(g.hx, h.hx) as hydro_x, h.r200 as hydro_r from halos h left join (select c_custkey as halo_id, cast((c_custkey*40087) % 205000 as double)/1000 as hx from customer where c_acctbal > 0) g using (halo_id)",
)
def _(spark, sf):
    g = tables.read_table(spark, sf, "customer").where(F.col("c_acctbal") > 0).selectExpr("c_custkey as halo_id", "cast((c_custkey*40087) % 205000 as double)/1000D as hydro_x")
    m = b.halos(spark, sf).select("halo_id", F.col("hx").alias("dmo_x"), F.col("r200").alias("dmo_r")).join(g, "halo_id", "left")
    m = tables.with_fallback(tables.with_fallback(m, "hydro_x", "dmo_x"), "hydro_r", "dmo_r")
    return m.select("halo_id", "dmo_x", "hydro_x", "hydro_r")


@query(
    "s09_member_cache",
    cte("dmo_members", "hydro_members") + "select grp, halo, count(*) as n, min(pid) as first_pid, max(pid) as last_pid from (select 'dmo' as grp, * from dmo_members union all select 'hydro_at_dmo', * from hydro_members) group by all",
)
def _(spark, sf):
    folder = shared_folder(spark, "cache")
    for grp, members in (("dmo", b.dmo_members(spark, sf)), ("hydro_at_dmo", b.hydro_members(spark, sf))):  # one group a write: nothing to sort
        products.write_product(members.withColumn("grp", F.lit(grp)), folder, ["grp"])
    back = spark.read.parquet(folder)  # partitioned by group, long form
    return back.groupBy("grp", "halo").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"))


_G16 = cte("particles").rstrip() + f", {_tsc_sql('particles', 'x', 'y', 'sim', 16)}"


def _planes16(spark, sf):
    g = gridding.dense(gridding.assign(b.particles(spark, sf), ("x", "y"), 16, "tsc", ["sim"]), 16, ["sim"])
    return g.withColumnRenamed("mass", "v")


def _written(spark, sf, folder):
    """Write the planes as binary files; the write is an action of its own."""
    named = _planes16(spark, sf).withColumn("file", F.concat(F.col("sim"), F.lit(".dat")))
    log = planes.write_planes(named, folder, "file", 16)
    log.write.mode("overwrite").parquet(f"{folder}-log")
    return spark.read.parquet(f"{folder}-log")


@query("s10_binary_plane_reader", _G16 + f" select sim, i, j, {R('mass', 5)} as v from grid")
def _(spark, sf):
    folder = shared_folder(spark, "planes")
    _written(spark, sf, folder)
    px = planes.to_pixels(planes.read_planes(spark, f"{folder}/*.dat", expected=16))
    return px.select(F.regexp_extract("path", r"([^/]+)\.dat$", 1).alias("sim"), "i", "j", r("v", 5).alias("v"))


@query("k01_binary_plane_writer", _G16 + " select sim, count(*) as pixels, 8 + 8 * count(*) as n_bytes from grid group by all")
def _(spark, sf):
    folder = shared_folder(spark, "planes")
    log = _written(spark, sf, folder).withColumn("sim", F.regexp_extract("file", r"([^/]+)\.dat$", 1))
    files = spark.read.format("binaryFile").load(f"{folder}/*.dat").select(F.regexp_extract("path", r"([^/]+)\.dat$", 1).alias("sim"), F.col("length").alias("n_bytes"))
    return log.join(files, "sim").select("sim", "pixels", "n_bytes")


@query("s12_fits_map_reader", _K + f" select map_id, i, j, {R('v', 8)} as v from kappa")
def _(spark, sf):
    folder = shared_folder(spark, "fits")
    log = planes.write_fits(b.kappa(spark, sf), folder, "map_id", MAP)
    log.write.mode("overwrite").parquet(f"{folder}-log")
    px = planes.read_fits(spark, f"{folder}/*.fits")
    px = px.withColumn("map_id", F.regexp_extract("path", r"(\d+)\.fits$", 1).cast("long"))
    return px.select("map_id", "i", F.posexplode("values").alias("j", "v")).withColumn("v", r("v", 8))


@query("k06_fits_map_writer", _K + " select map_id, count(*) as pixels, cast(2880 + ceil(count(*) * 8 / 2880.0) * 2880 as bigint) as n_bytes from kappa group by all")
def _(spark, sf):
    folder = shared_folder(spark, "fits")
    log = planes.write_fits(b.kappa(spark, sf), folder, "map_id", MAP)
    log.write.mode("overwrite").parquet(f"{folder}-log")
    key = lambda c: F.regexp_extract(c, r"(\d+)\.fits$", 1).cast("long").alias("map_id")
    files = spark.read.format("binaryFile").load(f"{folder}/*.fits").select(key("path"), F.col("length").alias("n_bytes"))
    return spark.read.parquet(f"{folder}-log").select(key("file"), "pixels").join(files, "map_id").select("map_id", "pixels", "n_bytes")


@query("s13_product_layouts", cte("summary") + f"select model, bin, {R('s', 4)} as value, case when model in ('dmo', 'hydro') then cast(n_real as double) end as extra from summary")
def _(spark, sf):
    from ..operators.response import summarise

    folder = shared_folder(spark, "layouts")
    s = summarise(b.stats(spark, sf))
    old = s.where(~F.col("model").isin("dmo", "hydro")).select("model", "bin", F.col("s").alias("mean_value"))
    new = s.where(F.col("model").isin("dmo", "hydro")).select("model", "bin", F.col("s").alias("value"), F.col("n_real").cast("double").alias("extra"))
    old.write.mode("overwrite").parquet(f"{folder}/layout=1")
    new.write.mode("overwrite").parquet(f"{folder}/layout=2")
    both = spark.read.option("mergeSchema", "true").parquet(folder)
    return tables.with_fallback(both, "value", "mean_value").select("model", "bin", r("value", 4).alias("value"), "extra")


@query("s14_available_snapshots", cte("particles").rstrip() + f", s as (select distinct snap_index from particles) select snap_index, {SNAPSHOT_ORDER}[snap_index + 1] as snap from s")
def _(spark, sf):
    table = F.array(*[F.lit(s) for s in SNAPSHOT_ORDER])
    s = tables.snapshots(b.particles(spark, sf), "snap_index")
    return s.select("snap_index", F.element_at(table, F.col("snap_index") + 1).alias("snap"))


@query("s15_config_paths", "select n_name as name, '/sims/box205/' || r_name || '/' || n_name as path, count(c_custkey) as n from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all")
def _(spark, sf):
    config = expand({"base_dir": "/sims/box205", "runs": {"path": "${base_dir}/"}})
    n = tables.read_table(spark, sf, "nation").join(tables.read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = tables.read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    path = F.concat(F.lit(config["runs"]["path"]), "r_name", F.lit("/"), "n_name")
    return j.select(F.col("n_name").alias("name"), path.alias("path"), F.coalesce("n", F.lit(0)).alias("n"))


@query("s16_attributes", "select event_id, case when starts_with(props, '{') then cast(json_extract(props, '$.k') as bigint) end as k, not starts_with(props, '{') as plain from events")
def _(spark, sf):
    a = tables.attributes(tables.read_table(spark, sf, "events"), "props", "k bigint")
    return a.select("event_id", F.col("parsed.k").alias("k"), (~F.col("props").startswith("{")).alias("plain"))


@query(
    "k02_interleaved_potential",
    _K
    + f""", {dft_sql('kappa', 'map_id', MAP)}, {_FIVE}, {dft_sql('five', 'map_id, field', MAP, 're', True, 'im', 'bk')}
 select map_id, list_position({_P5}, field) - 1 + 5 * (j + {MAP} * cast(i as bigint)) as position, {R('re * 1e6')} as value from bk""",
)
def _(spark, sf):
    folder = shared_folder(spark, "potentials")
    p = lensing.potential_derivatives(b.kappa(spark, sf), ["map_id"], MAP).withColumn("file", F.concat(F.col("map_id").cast("string"), F.lit(".dat")))
    planes.write_planes(p, folder, "file", MAP, planes.FIELDS).write.mode("overwrite").parquet(f"{folder}-log")
    back = planes.positions(planes.read_planes(spark, f"{folder}/*.dat", len(planes.FIELDS), MAP), components=len(planes.FIELDS))
    return back.select(F.regexp_extract("path", r"(\d+)\.dat$", 1).cast("long").alias("map_id"), "position", r(F.col("value") * 1e6).alias("value"))


_PL = ", ".join(f"({k + 1}, {num(102.5 * (k + 0.5))}, {num(z)}, {SNAPSHOT_ORDER[k // 2]})" for k, z in enumerate(LENS_PLANE_REDSHIFTS))


@query(
    "k03_geometry_table",
    cte("existing").rstrip() + f", g(plane, chi_lens, z_lens, snap) as (values {_PL}) select g.plane, chi_lens, {R('1 / (1 + z_lens)', 8)} as a, snap, count(e.lp) as n_files from g left join existing e on e.plane + 1 = g.plane group by all",
)
def _(spark, sf):
    e = b.existing(spark, sf).groupBy((F.col("plane") + 1).alias("plane")).agg(F.count(F.lit(1)).alias("n"))
    g = plane_table(spark).join(e, "plane", "left")
    return g.select("plane", "chi_lens", r(F.lit(1.0) / (F.col("z_lens") + 1.0), 8).alias("a"), "snap", F.coalesce("n", F.lit(0)).alias("n_files"))


_PS = ", ".join(f"({p}, {num(c)}, {num(z)}, {num(s)})" for p, c, z, s, _ in lens_planes())


@query(
    "k03_geometry_record",
    cte("existing").rstrip() + f""", g(plane, chi_lens, z_lens, chi_source) as (values {_PS}), e as (select distinct lp, plane + 1 as plane from existing)
 select lp, cast(row_number() over (partition by lp order by plane) - 1 as int) as k, {R('1 / (1 + z_lens)', 8)} as a, chi_lens, chi_source from e join g using (plane)""",
)
def _(spark, sf):
    folder = shared_folder(spark, "geometry")
    e = b.existing(spark, sf).select("lp", (F.col("plane") + 1).alias("plane")).distinct()
    held = e.join(plane_table(spark), "plane").withColumn("file", F.concat(F.col("lp").cast("string"), F.lit(".dat")))
    planes.write_geometry(held, folder, "file", BOX_SIZE).write.mode("overwrite").parquet(f"{folder}-log")
    back = planes.geometry_planes(spark, f"{folder}/*.dat").withColumn("lp", F.regexp_extract("path", r"(\d+)\.dat$", 1).cast("long"))
    return back.select("lp", "k", r("a", 8).alias("a"), "chi_lens", "chi_source")


@query("k04_partitioned_product", cte("summary") + f"select model, bin, {R('case when model = chr(100) || chr(109) || chr(111) then s * 2 else s end', 4)} as value from summary")
def _(spark, sf):
    from ..operators.response import summarise

    folder = shared_folder(spark, "product")
    s = summarise(b.stats(spark, sf)).select("model", "bin", F.col("s").alias("value"))
    products.write_product(s, folder, ["model"])
    # a second run replaces one model and leaves the others
    products.write_product(s.where(F.col("model") == "dmo").withColumn("value", F.col("value") * 2), folder, ["model"])
    return spark.read.parquet(folder).select("model", "bin", r("value", 4).alias("value"))


@query(
    "k05_text_summary",
    "with e as (select cast(event_id % 16 as int) as bin, event_type from events) select bin, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view from e group by all",
)
def _(spark, sf):
    folder = shared_folder(spark, "text")
    e = tables.read_table(spark, sf, "events").selectExpr("cast(event_id % 16 as int) as bin", "event_type as model")
    c = e.groupBy("bin", "model").agg(F.count(F.lit(1)).alias("n"))
    products.write_text(products.snr_summary(c, ["click", "view"]), folder)
    return spark.read.schema("bin int, click long, view long").option("header", True).csv(folder)


@query(
    "k07_latest_checkpoint",
    "select o_custkey as task, max(o_orderkey) as step, 'step_' || max(o_orderkey) as path from orders group by all",
)
def _(spark, sf):
    c = tables.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("step"), F.concat(F.lit("step_"), "o_orderkey").alias("path"))
    return products.latest_checkpoint(c, ["task"], "step", "path")


@query(
    "k07_resumed_state",
    "select o_custkey as task, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total, cast(max(o_orderkey % 3) as bigint) as last_step from orders group by all",
)
def _(spark, sf):
    """Orders summed in three steps: a first run ends after two, a second one goes on from what it saved."""
    orders = tables.read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("task"), F.lit(1).cast("long").alias("n"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"), (F.col("o_orderkey") % 3).alias("last_step")
    )
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_step").alias("last_step")]
    advance = lambda state, step: state.unionByName(orders.where(F.col("last_step") == step)).groupBy("task").agg(*sums)
    folder, start = shared_folder(spark, "state"), orders.where(F.lit(False))
    products.resumed(start, folder, 2, advance)
    return products.resumed(start, folder, 3, advance)


@query(
    "k08_tracer_settings",
    cte("particles").rstrip()
    + f""", s as (select distinct sim, snap_index from particles) select sim, 'box = 205.0' || chr(10) || 'planes = 2' || chr(10) || 'run = ' || sim || chr(10) || 'snapshot_list = ' || string_agg(cast({SNAPSHOT_ORDER}[snap_index + 1] as varchar), ', ' order by {SNAPSHOT_ORDER}[snap_index + 1]) as settings from s group by sim""",
)
def _(spark, sf):
    table = F.array(*[F.lit(s) for s in SNAPSHOT_ORDER])
    p = b.particles(spark, sf).select("sim", F.element_at(table, F.col("snap_index") + 1).alias("snap"))
    return products.tracer_settings(p, ["sim"], "snap", {"box": F.lit(BOX_SIZE), "planes": F.lit(2), "run": F.col("sim")})

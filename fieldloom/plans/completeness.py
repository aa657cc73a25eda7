"""Queries over artifact completeness and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SNAPSHOT_ORDER
from ..operators import manifest
from ..operators.ordering import row_ranks
from ..operators.spatial import ball_join
from ..sources.tables import read_table
from . import bindings as b
from .bindings import cte, dist_sql, query

_M = cte("expected", "existing").rstrip() + ", missing as (select * from expected anti join existing using (model, lp, plane))"
_SNAP = f"{SNAPSHOT_ORDER}[plane // 2 + 1]"


def _missing(spark, sf):
    return manifest.missing(b.expected(spark, sf), b.existing(spark, sf))


@query("c01_missing_planes", _M + " select * from missing")
def _(spark, sf):
    return _missing(spark, sf)


_TASKS = f"""tk as (select {_SNAP} as snap, model, string_agg(cast(lp as varchar), ',' order by lp) as realizations, cast(sum(n) as bigint) as n_missing from (select plane // 2 as half, model, lp, count(*) as n, any_value(plane) as plane from missing group by half, model, lp) group by snap, model)"""


@query("c02_recovery_tasks", _M + f", {_TASKS} select * from tk")
def _(spark, sf):
    return manifest.recovery_tasks(_missing(spark, sf))


@query(
    "c02_report_json",
    _M + f""", {_TASKS} select snap, '{{' || string_agg('"' || model || '":["' || replace(realizations, ',', '","') || '"]', ',' order by cast(model as varchar)) || '}}' as report from tk group by snap""",
)
def _(spark, sf):
    return manifest.report_json(manifest.recovery_tasks(_missing(spark, sf)))


@query(
    "c03_completeness",
    cte("expected", "existing")
    + "select model, lp, n_expected, n_found, case when n_found = n_expected then 'OK' else n_found || '/' || n_expected end as status, n_found >= 20 as goal_met from (select model, lp, count(*) as n_expected, count(x.plane) as n_found from expected e left join existing x using (model, lp, plane) group by all)",
)
def _(spark, sf):
    return manifest.completeness(b.expected(spark, sf), b.existing(spark, sf), ["model", "lp", "plane"], ["model", "lp"], 20)


@query(
    "c04_complete_runs",
    "with f as (select l_suppkey, l_orderkey % 100 as run, count(distinct l_partkey % 40) as n from lineitem group by all) select l_suppkey, count(*) filter (n >= 5) as n_complete, count(*) as n_runs from f group by all",
)
def _(spark, sf):
    f = read_table(spark, sf, "lineitem").selectExpr("l_suppkey", "l_orderkey % 100 as run", "l_partkey % 40 as file")
    return manifest.complete_runs(f, ["l_suppkey"], "run", 5)


@query(
    "c05_block_distribution",
    "select worker, count(*) as n_items, min(o_orderkey) as first_item, max(o_orderkey) as last_item from (select o_orderkey, ntile(7) over (order by o_orderkey) - 1 as worker from orders) group by all",
)
def _(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = o.agg(F.count(F.lit(1)).alias("total"))
    ranked = row_ranks(o, "o_orderkey", "o_custkey").crossJoin(F.broadcast(n))  # one row
    w = ranked.withColumn("worker", manifest.block_of(F.col("rank"), F.col("total"), 7))
    return w.groupBy("worker").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("o_orderkey").alias("first_item"), F.max("o_orderkey").alias("last_item")
    )


@query(
    "c05_round_robin",
    "select o_orderkey % 7 as worker, count(*) as n_items, cast(sum(o_custkey) as bigint) as load from orders group by all",
)
def _(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.groupBy((F.col("o_orderkey") % 7).alias("worker")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("o_custkey").alias("load"))


@query(
    "c06_pending_configurations",
    cte("expected", "existing") + "select model, lp from (select distinct model, lp from expected) anti join (select model, lp from existing group by all having count(*) >= 15) using (model, lp)",
)
def _(spark, sf):
    configs = b.expected(spark, sf).select("model", "lp").distinct()
    return manifest.pending(configs, b.existing(spark, sf), ["model", "lp"], 15)


@query(
    "c08_selection_difference",
    cte("particles", "halos").rstrip()
    + f""", a as (select distinct pid from particles p join halos h on h.halo_id = p.l_suppkey where {dist_sql()} <= 60.0), c as (select pid from particles p where exists (select 1 from halos h where {dist_sql()} <= h.r200 * 5.0::double))
 select 'both' as part, count(*) as n from (select pid from a intersect select pid from c) union all select 'only_a', count(*) from (select pid from a except select pid from c) union all select 'only_b', count(*) from (select pid from c except select pid from a)""",
)
def _(spark, sf):
    from ..functions.geometry import periodic_distance

    p, h = b.particles(spark, sf), b.halos(spark, sf)
    c = lambda names: tuple(F.col(n) for n in names)
    near = p.join(h, p.l_suppkey == h.halo_id).where(periodic_distance(c(("x", "y", "z")), c(("hx", "hy", "hz")), 205.0) <= 60.0)
    balls = ball_join(p, h, F.col("r200") * 5.0, max_radius=b.MAX_R200 * 5, how="left_semi")
    return manifest.selection_difference(near.select("pid").distinct(), balls.select("pid"))


@query(
    "c09_index_ranges",
    _M + """, ix as (select distinct plane, model * (select count(*) from supplier) + lp as k from missing), g as (select plane, k, k - row_number() over (partition by plane order by k) as grp from ix),
 rg as (select plane, min(k) as lo, max(k) as hi from g group by plane, grp) select plane, string_agg(case when lo = hi then lo::varchar else lo || '-' || hi end, ',' order by lo) as ranges from rg group by plane""",
)
def _(spark, sf):
    n = read_table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    m = _missing(spark, sf).crossJoin(F.broadcast(n)).withColumn("k", F.col("model") * F.col("n") + F.col("lp"))
    return manifest.index_ranges(m, ["plane"], "k")

"""Domain views over the driver tables, once as DataFrames and once as SQL.

Arithmetic on integers, divided at the end, gives the same bits in both engines; masses are
whole numbers, so their sums do not depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALPHA_EDGES, MASS_EDGES
from ..operators.spatial import ball_join
from ..sources.tables import read_table

REACH = 5.0
MAX_R200 = 4.9
MAP_SIDE = 64

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where the operator can be written as SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


def r_many(c, digits: int = 6):
    """``r`` for results of many rows: the same numbers without a decimal for each, but for those near a tie and very large ones."""
    scaled = c * F.lit(10.0**digits)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(1e8)) & (F.abs(scaled - whole) < F.lit(0.5 - 1e-6))
    return F.when(plain, whole / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(c, digits))


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0)"


def num(v: float) -> str:
    return "'inf'::double" if v == float("inf") else f"{float(v)!r}::double"


def num_list(values) -> str:
    return "[" + ", ".join(num(v) for v in values) + "]"


def bin_sql(x: str, edges, side: str = "hist") -> str:
    """Bin number in SQL by counting edges, independent of the comparison tree used in Spark."""
    e, n = num_list(edges), len(edges) - 1
    below = f"len(list_filter({e}, lambda e: e <= {x}))"
    strictly = f"len(list_filter({e}, lambda e: e < {x}))"
    cases = {
        "hist": f"when {x} < {num(edges[0])} or {x} > {num(edges[-1])} then null when {x} = {num(edges[-1])} then {n - 1} else {below} - 1",
        "left": f"when {x} < {num(edges[0])} or {x} >= {num(edges[-1])} then null else {below} - 1",
        "right": f"when {x} <= {num(edges[0])} or {x} > {num(edges[-1])} then null else {strictly} - 1",
        "below": f"when {x} > {num(edges[-1])} then null else greatest({strictly} - 1, 0)",
    }
    return f"cast(case {cases[side]} end as int)"


def cte(*names: str) -> str:
    """WITH clause holding the named views and what they need, in order."""
    done: list[str] = []

    def visit(n: str) -> None:
        for d in SQL_NEEDS.get(n, ()):
            visit(d)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in done) + "\n"


# --- SQL forms -------------------------------------------------------------------

_MI = "({a} - {b} - 205.0::double * round_even(({a} - {b}) / 205.0::double, 0))"


def min_image_sql(a: str, b: str) -> str:
    return _MI.format(a=a, b=b)


def dist_sql(p: str = "p", h: str = "h", pc=("x", "y", "z"), hc=("hx", "hy", "hz")) -> str:
    d = [min_image_sql(f"{p}.{a}", f"{h}.{b}") for a, b in zip(pc, hc)]
    return "sqrt(" + " + ".join(f"{x}*{x}" for x in d) + ")"


SQL: dict[str, str] = {
    "particles": """
 select (xi * 205000 + yi) * 205000 + zi as pid, cast(xi as double)/1000 as x, cast(yi as double)/1000 as y, cast(zi as double)/1000 as z,
        ptype, mass, sim, snap_index, l_orderkey, l_linenumber, l_suppkey from (
 select (l_partkey*7919 + l_linenumber*1301 + l_orderkey*31) % 205000 as xi,
        (l_orderkey*6151 + l_suppkey*97) % 205000 as yi,
        (l_suppkey*15013 + l_orderkey*389 + l_linenumber*7) % 205000 as zi,
        case l_returnflag when 'A' then 0 when 'N' then 1 else 4 end as ptype,
        l_quantity as mass,
        case l_linestatus when 'F' then 'dmo' else 'hydro' end as sim,
        cast(l_partkey % 20 as int) as snap_index, l_orderkey, l_linenumber, l_suppkey
   from lineitem)""",
    "halos": """
 select s_suppkey as halo_id,
        cast((s_suppkey*52379) % 205000 as double)/1000 as hx,
        cast((s_suppkey*84349) % 205000 as double)/1000 as hy,
        cast((s_suppkey*31337) % 205000 as double)/1000 as hz,
        cast(120 + s_suppkey % 30 as double)/10 as log_mass,
        cast(20 + s_suppkey % 30 as double)/10 as r200
   from supplier""",
    "pairs": f"""
 select * from (select p.pid, p.sim, p.ptype, p.mass, p.x, p.y, p.z, h.halo_id, h.r200, h.log_mass, h.hx, h.hy, h.hz, {dist_sql()} as d,
        {dist_sql()} / h.r200 as r
   from particles p, halos h) where d <= r200 * 5.0::double""",
    "dmo_members": "select distinct l_orderkey as pid, l_suppkey as halo from lineitem",
    "hydro_members": """
 select distinct l_orderkey as pid, case when l_linenumber <= 5 then l_suppkey else (l_suppkey + 1) % (select count(*) from supplier) end as halo
   from lineitem""",
    "kappa": """
 select map_id, i, j, coalesce(v, 0::double) as v
   from (select map_id, i, j from (select distinct vec_id // 64 as map_id from embeddings)
         cross join (select cast(unnest(range(64)) as int) as i) cross join (select cast(unnest(range(64)) as int) as j)) m
   left join (select vec_id // 64 as map_id, cast(vec_id % 64 as int) as i, cast(unnest(range(len(embedding))) as int) as j,
                     cast(unnest(embedding) as double) as v from embeddings) e using (map_id, i, j)""",
    "stats": """
 select case event_type when 'view' then 'dmo' when 'click' then 'hydro'
             when 'purchase' then 'replace'
             when 'signup' then 'replace_Ml_' || lo || '_Mu_inf_R_' || al
             else 'replace_Ml_' || lo || '_Mu_' || hi || '_R_' || al end as model,
        user_id as realization, cast(event_id % 16 as int) as bin, cents as value from (
  select *, ['1.00e12','3.16e12','1.00e13','3.16e13'][cast(user_id % 4 as int) + 1] as lo,
            ['3.16e12','1.00e13','3.16e13','1.00e15'][cast(user_id % 4 as int) + 1] as hi,
            ['0.5','1.0','3.0','5.0'][cast((user_id // 4) % 4 as int) + 1] as al,
            cast(round(value * 100) as double) as cents from events)""",
    "summary": """
 select model, bin, avg(value) as s, stddev_pop(value) as s_std, stddev_pop(value) / sqrt(count(value)) as s_err, count(value) as n_real
   from stats group by all""",
    "base": """
 select bin, d.s as S_D, h.s as S_H, d.s_err as S_D_err, h.s_err as S_H_err, d.s_std as S_D_std, h.s_std as S_H_std, d.n_real as n_D, h.n_real as n_H,
        h.s - d.s as Delta_S, sqrt(d.s_err*d.s_err + h.s_err*h.s_err) as Delta_S_err
   from (select * from summary where model = 'dmo') d join (select * from summary where model = 'hydro') h using (bin)""",
    "redshifts": "select cast(o_custkey % 250 + 1 as double)/100 as z, count(*) as n_orders from orders group by all",
    "existing": "select distinct cast(l_partkey % 34 as int) as model, l_suppkey as lp, cast(l_orderkey % 40 as int) as plane from lineitem",
    "expected": """
 select cast(m as int) as model, s_suppkey as lp, cast(p as int) as plane
   from supplier, (select unnest(range(34)) as m), (select unnest(range(40)) as p)""",
}
SQL_NEEDS: dict[str, tuple[str, ...]] = {
    "pairs": ("particles", "halos"),
    "summary": ("stats",),
    "base": ("summary",),
}


# --- DataFrame forms -------------------------------------------------------------


def particles(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    q = li.selectExpr(
        "(l_partkey*7919 + l_linenumber*1301 + l_orderkey*31) % 205000 as xi",
        "(l_orderkey*6151 + l_suppkey*97) % 205000 as yi",
        "(l_suppkey*15013 + l_orderkey*389 + l_linenumber*7) % 205000 as zi",
        "case l_returnflag when 'A' then 0 when 'N' then 1 else 4 end as ptype",
        "l_quantity as mass",
        "case l_linestatus when 'F' then 'dmo' else 'hydro' end as sim",
        "cast(l_partkey % 20 as int) as snap_index",
        "l_orderkey", "l_linenumber", "l_suppkey",
    )
    return q.selectExpr(
        "(xi * 205000 + yi) * 205000 + zi as pid",
        "cast(xi as double)/1000D as x", "cast(yi as double)/1000D as y", "cast(zi as double)/1000D as z",
        "ptype", "mass", "sim", "snap_index", "l_orderkey", "l_linenumber", "l_suppkey",
    )


def halos(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").selectExpr(
        "s_suppkey as halo_id",
        "cast((s_suppkey*52379) % 205000 as double)/1000D as hx",
        "cast((s_suppkey*84349) % 205000 as double)/1000D as hy",
        "cast((s_suppkey*31337) % 205000 as double)/1000D as hz",
        "cast(120 + s_suppkey % 30 as double)/10D as log_mass",
        "cast(20 + s_suppkey % 30 as double)/10D as r200",
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Particles within five R200 of each halo, with r in units of R200."""
    p = particles(spark, sf).select("pid", "sim", "ptype", "mass", "x", "y", "z")
    out = ball_join(p, halos(spark, sf), F.col("r200") * F.lit(REACH), max_radius=MAX_R200 * REACH)
    return out.withColumn("r", F.col("d") / F.col("r200"))


def dmo_members(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").selectExpr("l_orderkey as pid", "l_suppkey as halo").distinct()


def hydro_members(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    li = read_table(spark, sf, "lineitem").crossJoin(F.broadcast(n))
    return li.selectExpr(
        "l_orderkey as pid", "case when l_linenumber <= 5 then l_suppkey else (l_suppkey + 1) % n end as halo"
    ).distinct()


def kappa_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that each map has."""
    return read_table(spark, sf, "embeddings").selectExpr(
        "vec_id div 64 as map_id", "cast(vec_id % 64 as int) as i", "embedding"
    )


def kappa(spark: SparkSession, sf: str) -> DataFrame:
    """64 x 64 maps; lines that a map lacks are zero, the mean of a convergence field."""
    e = kappa_lines(spark, sf)
    maps = e.select("map_id").distinct().select("map_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    lines = maps.join(e, ["map_id", "i"], "left")
    filled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.coalesce(F.get("embedding", j).cast("double"), F.lit(0.0)))
    return lines.select("map_id", "i", F.posexplode(filled).alias("j", "v"))


def _pick(names: list[str], index: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in names)}), cast({index} as int) + 1)"


def stats(spark: SparkSession, sf: str) -> DataFrame:
    lo = _pick(["1.00e12", "3.16e12", "1.00e13", "3.16e13"], "user_id % 4")
    hi = _pick(["3.16e12", "1.00e13", "3.16e13", "1.00e15"], "user_id % 4")
    al = _pick(["0.5", "1.0", "3.0", "5.0"], "(user_id div 4) % 4")
    return read_table(spark, sf, "events").selectExpr(
        f"""case event_type when 'view' then 'dmo' when 'click' then 'hydro' when 'purchase' then 'replace'
            when 'signup' then concat('replace_Ml_', {lo}, '_Mu_inf_R_', {al})
            else concat('replace_Ml_', {lo}, '_Mu_', {hi}, '_R_', {al}) end as model""",
        "user_id as realization", "cast(event_id % 16 as int) as bin", "round(value * 100) as value",
    )


def redshifts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read_table(spark, sf, "orders")
        .selectExpr("cast(o_custkey % 250 + 1 as double)/100D as z")
        .groupBy("z")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )


def existing(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").selectExpr(
        "cast(l_partkey % 34 as int) as model", "l_suppkey as lp", "cast(l_orderkey % 40 as int) as plane"
    ).distinct()


def expected(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lp"))
    out = s.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(33))))
    return out.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("model", "lp", "plane")

"""Queries over the response algebra and its ordered differences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import response as resp
from ..operators import windows
from ..session import shared_folder
from . import bindings as b
from .bindings import ALPHA_EDGES, MASS_EDGES, R, cte, num, num_list, query, r

_B = cte("base").rstrip()
_REPL = "rs as (select * from summary where model not in ('dmo', 'hydro'))"
_CR = f"""{_REPL}, cr as (select m.model, m.bin, m.s as S_R, m.s_err as S_R_err, m.s_std as S_R_std, m.n_real as n_R, b.*, m.s - b.S_D as delta_S_R, sqrt(m.s_err*m.s_err + b.S_D_err*b.S_D_err) as delta_S_R_err,
 (m.s - b.S_D) / nullif(b.Delta_S, 0) as F from rs m join base b on m.bin = b.bin)"""
_PARSE = """pm as (select *, cast(nullif(regexp_extract(model, '_Ml_([0-9.e+]+)_Mu_', 1), '') as double) as m_lo, nullif(regexp_extract(model, '_Mu_(inf|[0-9.e+]+)_R_', 1), '') as hi_s, cast(nullif(regexp_extract(model, '_R_([0-9.]+)$', 1), '') as double) as alpha from cr),
cum as (select *, m_lo as m_min, alpha as alpha_max from pm where hi_s = 'inf'), til as (select *, m_lo as m from pm where hi_s <> 'inf' and hi_s is not null)"""
_IDX = f"""ti as (select *, list_position({num_list(MASS_EDGES)}, m_lo) - 1 as mass_idx, list_position({num_list(ALPHA_EDGES)}, alpha) - 2 as shell_idx from til)"""
_ALL = f"{_B}, {_CR}, {_PARSE}, {_IDX}"


def _summary(spark, sf):
    return resp.summarise(b.stats(spark, sf))


def _responses(spark, sf, **kw):
    return resp.cumulative_response(_summary(spark, sf), **kw)


def _parsed(spark, sf, **kw):
    lo, hi, alpha = resp.parse_model(F.col("model"))
    return _responses(spark, sf, **kw).withColumn("m_lo", lo).withColumn("m_hi", hi).withColumn("alpha", alpha)


def _stored(spark, sf):
    """The responses as a table: what uses them several times scans the statistics once."""
    out, path = _parsed(spark, sf), shared_folder(spark, "responses")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _cumulative(spark, sf, parsed=None, **kw):
    c = (_parsed(spark, sf, **kw) if parsed is None else parsed).where(F.col("m_hi") == math.inf)
    return c.withColumn("m_min", F.col("m_lo")).withColumn("alpha_max", F.col("alpha"))


def _indexed(spark, sf, parsed=None):
    t = (_parsed(spark, sf) if parsed is None else parsed).where(F.col("m_hi") < math.inf)
    return resp.tile_index(t, MASS_EDGES, ALPHA_EDGES).withColumn("dF", F.col("F"))


def _sel(df, keys, cols, digits=6):
    return df.select(*keys, *[r(c, digits).alias(c) for c in cols])


def _rs(cols, digits=6):
    return ", ".join(f"{R(c, digits)} as {c}" for c in cols)


@query("q01_baseline", _B + f" select bin, {_rs(['S_D', 'S_H', 'Delta_S', 'S_D_err', 'S_H_err', 'Delta_S_err'], 4)} from base")
def _(spark, sf):
    return _sel(resp.baseline(_summary(spark, sf)), ["bin"], ["S_D", "S_H", "Delta_S", "S_D_err", "S_H_err", "Delta_S_err"], 4)


@query("q02_cumulative_response", f"{_B}, {_CR} select model, bin, {_rs(['F'])}, {R('delta_S_R_err / abs(Delta_S)')} as F_err from cr")
def _(spark, sf):
    return _sel(_responses(spark, sf), ["model", "bin"], ["F", "F_err"])


@query(
    "q02_response_masked",
    f"{_B}, {_CR} select model, bin, {R('case when abs(Delta_S / (abs(S_D) + 1e-30)) >= 0.1 then F end')} as f_masked, {R('case when abs(Delta_S) > 1e-15 * abs(S_D) then F else 0 end')} as f_zero_relative, {R('case when abs(Delta_S) > 1e-30 then F else 0 end')} as f_zero_absolute from cr",
)
def _(spark, sf):
    pick = lambda name, **kw: _responses(spark, sf, **kw).select("model", "bin", r("F").alias(name))
    a = pick("f_masked", mask=0.1)
    return a.join(pick("f_zero_relative", policy="zero_relative"), ["model", "bin"]).join(
        pick("f_zero_absolute", policy="zero_absolute"), ["model", "bin"]
    )


@query("q03_tile_response", f"{_ALL} select mass_idx, shell_idx, bin, {R('F')} as dF from ti")
def _(spark, sf):
    s = _summary(spark, sf)
    lo, hi, alpha = resp.parse_model(F.col("model"))
    t = s.withColumn("m_lo", lo).withColumn("m_hi", hi).withColumn("alpha", alpha).where(F.col("m_hi") < math.inf)
    t = resp.tile_index(t, MASS_EDGES, ALPHA_EDGES).select("mass_idx", "shell_idx", "bin", "s")
    d = resp.tile_response(t, resp.baseline(s))
    return d.select("mass_idx", "shell_idx", "bin", r("dF").alias("dF"))


_PAT = f"""edges as (select cast(a as int) as mass_idx, cast(i as int) as shell_idx, {num_list(MASS_EDGES)}[a+1] as m_lo_t, {num_list(ALPHA_EDGES)}[i+2] as a_hi from (select unnest(range(4)) as a), (select unnest(range(4)) as i)),
pat as (select c.m_min, c.alpha_max, mass_idx, shell_idx, case when a_hi <= alpha_max then 1::double else 0::double end as lam from (select distinct m_min, alpha_max from cum) c, edges where m_lo_t >= m_min)"""


def _pattern(spark, sf, parsed=None):
    configs = _cumulative(spark, sf, parsed).select("m_min", "alpha_max").distinct()
    return resp.pattern(configs, MASS_EDGES, ALPHA_EDGES)


@query("q04_pattern", f"{_ALL}, {_PAT} select * from pat")
def _(spark, sf):
    return _pattern(spark, sf)


_LIN = "lin as (select m_min, alpha_max, bin, sum(lam * F) as F_lin from pat join ti using (mass_idx, shell_idx) group by all)"
_EPS = "ep as (select c.m_min, c.alpha_max, c.bin, (c.F - l.F_lin) / nullif(c.F, 0) as epsilon from cum c join lin l on l.m_min = c.m_min and l.alpha_max = c.alpha_max and l.bin = c.bin)"


def _lin(spark, sf, parsed):
    return resp.additive_prediction(_pattern(spark, sf, parsed), _indexed(spark, sf, parsed))


@query("q05_additive_prediction", f"{_ALL}, {_PAT}, {_LIN} select m_min, alpha_max, bin, {R('F_lin')} as F_lin from lin")
def _(spark, sf):
    return _sel(_lin(spark, sf, _stored(spark, sf)), ["m_min", "alpha_max", "bin"], ["F_lin"])


@query("q06_non_additivity", f"{_ALL}, {_PAT}, {_LIN}, {_EPS} select m_min, alpha_max, {R('avg(abs(epsilon))', 5)} as mean_abs_epsilon from ep group by all")
def _(spark, sf):
    p = _stored(spark, sf)
    true = _cumulative(spark, sf, p).select("m_min", "alpha_max", "bin", "F")
    e = resp.mean_non_additivity(resp.non_additivity(true, _lin(spark, sf, p)))
    return e.select("m_min", "alpha_max", r("mean_abs_epsilon", 5).alias("mean_abs_epsilon"))


@query("q07_multipoles", f"{_ALL} select mass_idx, shell_idx, bin, {R('case when abs(sum(F) over (partition by bin)) > 1e-30 then F / sum(F) over (partition by bin) else 0 end', 5)} as mu from ti")
def _(spark, sf):
    m = resp.multipoles(_indexed(spark, sf))
    return m.select("mass_idx", "shell_idx", "bin", r("mu", 5).alias("mu"))


@query(
    "q08_relative_errors",
    f"""{_B}, {_CR} select model, bin, {R('F')} as F, {R('abs(F) * sqrt(pow(case when abs(delta_S_R) > 1e-15 then delta_S_R_err / delta_S_R else 0 end, 2) + pow(case when abs(Delta_S) > 1e-15 then Delta_S_err / Delta_S else 0 end, 2))', 5)} as F_err from cr""",
)
def _(spark, sf):
    return _responses(spark, sf, policy="null_small", error="relative").select("model", "bin", r("F").alias("F"), r("F_err", 5).alias("F_err"))


@query(
    "q08_additivity_over_mass",
    f"""{_ALL}, st as (select alpha, bin, sum(delta_S_R) as st from ti group by all) select st.alpha, {R('avg(case when abs(delta_S_R) > 1e-15 then st / delta_S_R end)', 5)} as ratio from st join cum c on c.alpha = st.alpha and c.bin = st.bin where c.m_min = {num(MASS_EDGES[0])} group by all""",
)
def _(spark, sf):
    tiles = _indexed(spark, sf).select("alpha", "bin", F.col("delta_S_R").alias("delta_S"))
    direct = _cumulative(spark, sf).where(F.col("m_min") == MASS_EDGES[0])
    return resp.additivity_over_mass(tiles, direct).select("alpha", r("ratio", 5).alias("ratio"))


@query("q09_density_response", f"{_B}, {_CR} select model, bin, {R('F')} as F, {R('sqrt(S_R_std*S_R_std + S_D_std*S_D_std) / abs(Delta_S + 1e-15) / sqrt(least(n_R, n_D, n_H))', 5)} as F_err from cr")
def _(spark, sf):
    return _responses(spark, sf, policy="zero_relative", error="scaled").select("model", "bin", r("F").alias("F"), r("F_err", 5).alias("F_err"))


@query(
    "q10_ensemble_statistics",
    cte("kappa").rstrip()
    + f""", m as (select map_id, case map_id % 3 when 0 then 'dmo' when 1 then 'hydro' else 'replace' end as model, stddev_pop(v) as sd, avg(v) as mu, count(v) as n from kappa group by all)
 select model, count(*) as n_success, {R('avg(sd)', 8)} as std_mean, {R('avg(mu)', 8)} as mean_mean, (select count(distinct vec_id // 64) from embeddings) - (select count(*) from m) as n_failed from m group by all""",
)
def _(spark, sf):
    from ..operators import images

    per = images.summary(images.valid_maps(b.kappa(spark, sf), ["map_id"]), ["map_id"])
    model = F.when(F.col("map_id") % 3 == 0, "dmo").when(F.col("map_id") % 3 == 1, "hydro").otherwise("replace")
    per = per.withColumn("model", model)
    seen = b.read_table(spark, sf, "embeddings").selectExpr("vec_id div 64 as m").agg(F.count_distinct("m").alias("seen"))
    good = per.agg(F.count(F.lit(1)).alias("good"))
    failed = seen.crossJoin(F.broadcast(good)).select((F.col("seen") - F.col("good")).alias("n_failed"))
    g = per.groupBy("model").agg(F.count(F.lit(1)).alias("n_success"), r(F.avg("std"), 8).alias("std_mean"), r(F.avg("mean"), 8).alias("mean_mean"))
    return g.crossJoin(F.broadcast(failed))  # one row


@query("q11_response_matrix", f"{_ALL} select m_min, alpha_max, {R('avg(F)')} as F_mean, {R('avg(delta_S_R_err / abs(Delta_S))')} as F_err_mean from cum where bin between 2 and 12 and F is not null group by all")
def _(spark, sf):
    m = resp.response_matrix(_cumulative(spark, sf), F.col("bin").between(2, 12))
    return _sel(m, ["m_min", "alpha_max"], ["F_mean", "F_err_mean"])


@query(
    "q11_response_matrix_weighted",
    f"""{_ALL}, w as (select *, delta_S_R_err / abs(Delta_S) as F_err, case when abs(Delta_S) / sqrt(greatest(S_D, 1)) > 2 and S_D > 5 then Delta_S*Delta_S / greatest(S_D, 1) end as w from cum)
 select m_min, alpha_max, {R('sum(w*F)/sum(w)')} as F_mean, {R('sqrt(sum(w*F_err*F_err)/sum(w))')} as F_err_mean from w where w > 0 and F is not null group by all""",
)
def _(spark, sf):
    return _sel(resp.response_matrix_weighted(_cumulative(spark, sf)), ["m_min", "alpha_max"], ["F_mean", "F_err_mean"])


@query("q11_response_pivot", f"{_ALL} select m_min, {', '.join(R(f'avg(case when alpha_max = {num(a)} then F end)') + f' as a{int(a * 10)}' for a in ALPHA_EDGES[1:])} from cum group by all")
def _(spark, sf):
    c = _cumulative(spark, sf).withColumn("a", F.concat(F.lit("a"), (F.col("alpha_max") * 10).cast("int").cast("string")))
    p = c.groupBy("m_min").pivot("a", [f"a{int(a * 10)}" for a in ALPHA_EDGES[1:]]).agg(F.avg("F"))
    return _sel(p, ["m_min"], [f"a{int(a * 10)}" for a in ALPHA_EDGES[1:]])


@query("q12_significant_response", f"{_B}, {_CR} select model, bin, {R('case when abs(Delta_S) > 0.02::double * abs(S_D) then F end')} as F from cr")
def _(spark, sf):
    return resp.significant_response(_responses(spark, sf), 0.02).select("model", "bin", r("F").alias("F"))


@query("q12_weighted_response", f"{_B}, {_CR} select model, {R('sum(F * abs(Delta_S)) / sum(abs(Delta_S))')} as F_mean from cr where abs(Delta_S) > 0.02::double * abs(S_D) and bin between 1 and 13 group by all")
def _(spark, sf):
    return resp.weighted_response(_responses(spark, sf), 0.02, "bin", 1, 13).select("model", r("F_mean").alias("F_mean"))


_MN = "mn as (select distinct model from stats)"


@query(
    "q13_parse_model_names",
    f"{_ALL}, u as (select distinct model, m_lo, cast(hi_s as double) as m_hi, alpha from pm where m_lo is not null) select model, m_lo, case when m_hi = 'inf'::double then -1 else m_hi end as m_hi, alpha, model as rebuilt from u",
)
def _(spark, sf):
    m = b.stats(spark, sf).select("model").distinct()
    lo, hi, alpha = resp.parse_model(F.col("model"))
    m = m.withColumn("m_lo", lo).withColumn("m_hi", hi).withColumn("alpha", alpha).where(F.col("m_lo").isNotNull())
    again = resp.format_model(F.col("m_lo"), F.col("m_hi"), F.col("alpha"))
    return m.select("model", "m_lo", F.when(F.col("m_hi") == math.inf, F.lit(-1.0)).otherwise(F.col("m_hi")).alias("m_hi"), "alpha", again.alias("rebuilt"))


@query("q14_ratio_and_residual", _B + f" select bin, {R('S_H / S_D')} as ratio, {R('(S_H - S_D) / S_D')} as residual from base")
def _(spark, sf):
    j = resp.baseline(_summary(spark, sf))
    return j.select("bin", r(F.try_divide("S_H", "S_D")).alias("ratio"), r(F.try_divide(F.col("S_H") - F.col("S_D"), F.col("S_D"))).alias("residual"))


@query(
    "q14_regridded_suppression",
    _B
    + f""", k as (select unnest([1.5, 3.3, 7.7, 12.1]::double[]) as k), br as (select k, max(case when bin + 1 <= k then bin end) as a, min(case when bin + 1 >= k then bin end) as c from base, k group by all),
 v as (select k, pow(10::double, log10(x.S_H) + (log10(y.S_H) - log10(x.S_H)) * (log10(k) - log10(a + 1)) / (log10(c + 1) - log10(a + 1))) as h, pow(10::double, log10(x.S_D) + (log10(y.S_D) - log10(x.S_D)) * (log10(k) - log10(a + 1)) / (log10(c + 1) - log10(a + 1))) as d from br join base x on x.bin = a join base y on y.bin = c)
 select k as x_at, {R('h / d')} as ratio from v""",
)
def _(spark, sf):
    s = _summary(spark, sf).where(F.col("model").isin("dmo", "hydro")).withColumn("k", (F.col("bin") + 1).cast("double"))
    at = windows.interpolate(s, ["model"], "k", "s", [1.5, 3.3, 7.7, 12.1], log=True)
    side = lambda m, nm: at.where(F.col("model") == m).select("x_at", F.col("y_at").alias(nm))
    return side("hydro", "h").join(side("dmo", "d"), "x_at").select("x_at", r(F.try_divide("h", "d")).alias("ratio"))


@query("q15_suppression_metrics", f"{_B}, {_CR} select model, {R('max(abs(S_R / S_H - 1))')} as max_deviation, {R('avg(S_R / S_H)')} as mean_ratio, {R('sqrt(avg(pow(S_R / S_H - 1, 2)))')} as rms from cr where bin between 1 and 10 group by all")
def _(spark, sf):
    m = resp.suppression_metrics(_responses(spark, sf), ["model"], "bin", "S_R", "S_H", 1, 10)
    return _sel(m, ["model"], ["max_deviation", "mean_ratio", "rms"])


@query("q17_response_analysis", f"{_ALL}, {_PAT}, {_LIN}, {_EPS} select m_min, alpha_max, bin, {R('epsilon', 5)} as epsilon from ep")
def _(spark, sf):
    a = resp.ResponseAnalysis(b.stats(spark, sf))
    names = a.summary.select("model").distinct()
    lo, hi, alpha = resp.parse_model(F.col("model"))
    names = names.withColumn("m_lo", lo).withColumn("m_hi", hi).withColumn("alpha", alpha)
    configs = names.where(F.col("m_hi") == math.inf).select("model", F.col("m_lo").alias("m_min"), F.col("alpha").alias("alpha_max"))
    indexed = resp.tile_index(names.where(F.col("m_hi") < math.inf), MASS_EDGES, ALPHA_EDGES).select("model", "mass_idx", "shell_idx")
    e = a.additivity(configs, indexed, MASS_EDGES, ALPHA_EDGES)
    return e.select("m_min", "alpha_max", "bin", r("epsilon", 5).alias("epsilon"))


@query(
    "q18_peak_response",
    f"""with p as (select case event_type when 'view' then 'dmo' when 'click' then 'hydro' else 'replace' end as model, cast(event_id % 16 as int) as bin, count(*) as n from events group by all)
 select bin, {R('(r.n - d.n) / nullif(h.n - d.n, 0)::double')} as response from (select * from p where model = 'replace') r join (select * from p where model = 'dmo') d using (bin) join (select * from p where model = 'hydro') h using (bin)""",
)
def _(spark, sf):
    m = F.when(F.col("model").isin("dmo", "hydro"), F.col("model")).otherwise("replace")
    c = b.stats(spark, sf).withColumn("model", m).groupBy("bin").agg(*[F.count_if(F.col("model") == x).alias(x) for x in ("dmo", "hydro", "replace")])
    f = F.try_divide((F.col("replace") - F.col("dmo")).cast("double"), F.col("hydro") - F.col("dmo"))
    return c.select("bin", r(f).alias("response"))


# --- ordered differences ---------------------------------------------------------

_FM = f"{_ALL}, fm as (select m_min, alpha_max, avg(F) as F from cum group by all)"


def _matrix(spark, sf):
    return _cumulative(spark, sf).groupBy("m_min", "alpha_max").agg(F.avg("F").alias("F"))


@query("w04_mass_difference", f"{_FM} select * from (select m_min, alpha_max, {R('F - lead(F) over (partition by alpha_max order by m_min)')} as dF from fm) where dF is not null")
def _(spark, sf):
    d = windows.forward_difference(_matrix(spark, sf), ["alpha_max"], "m_min", "F", "dF")
    return d.where(F.col("dF").isNotNull()).select("m_min", "alpha_max", r("dF").alias("dF"))


@query("w04_radius_difference", f"{_FM} select * from (select m_min, alpha_max, {R('F - lag(F) over (partition by m_min order by alpha_max)')} as dF from fm) where dF is not null")
def _(spark, sf):
    d = windows.backward_difference(_matrix(spark, sf), ["m_min"], "alpha_max", "F", "dF")
    return d.where(F.col("dF").isNotNull()).select("m_min", "alpha_max", r("dF").alias("dF"))


@query("w04_tile_difference", f"{_FM}, d as (select m_min, alpha_max, F - lead(F) over (partition by alpha_max order by m_min) as d from fm) select * from (select m_min, alpha_max, {R('d - lag(d) over (partition by m_min order by alpha_max)')} as tile from d) where tile is not null")
def _(spark, sf):
    t = windows.mixed_difference(_matrix(spark, sf), [], "m_min", "alpha_max", "F")
    return t.select("m_min", "alpha_max", r("tile").alias("tile"))


@query(
    "w05_log_slope",
    f"{_FM} select * from (select m_min, alpha_max, {R('(lead(F) over w - F) / (lead(ln(m_min)) over w - ln(m_min))')} as slope from fm window w as (partition by alpha_max order by m_min)) where slope is not null",
)
def _(spark, sf):
    m = _matrix(spark, sf).withColumn("x", F.log("m_min"))
    return windows.slope(m, ["alpha_max"], "x", "F").where(F.col("slope").isNotNull()).select("m_min", "alpha_max", r("slope").alias("slope"))


@query(
    "w05_mixed_log_slope",
    f"""{_FM}, a as (select m_min, alpha_max, (lead(F) over w - F) / (lead(ln(m_min)) over w - ln(m_min)) as s from fm window w as (partition by alpha_max order by m_min))
 select * from (select m_min, alpha_max, {R('(lead(s) over w - s) / (lead(ln(alpha_max)) over w - ln(alpha_max))')} as slope from a window w as (partition by m_min order by alpha_max)) where slope is not null""",
)
def _(spark, sf):
    m = _matrix(spark, sf).withColumn("x", F.log("m_min")).withColumn("u", F.log("alpha_max"))
    one = windows.slope(m, ["alpha_max"], "x", "F", "s")
    two = windows.slope(one, ["m_min"], "u", "s")
    return two.where(F.col("slope").isNotNull()).select("m_min", "alpha_max", r("slope").alias("slope"))


@query("w06_percent_contributions", f"{_FM} select m_min, {R('(F - coalesce(lead(F) over (order by m_min), 0)) * 100')} as percent from fm where alpha_max = 5.0")
def _(spark, sf):
    m = _matrix(spark, sf).where(F.col("alpha_max") == 5.0)
    return windows.percent_contributions(m, ["alpha_max"], "m_min", "F").select("m_min", r("percent").alias("percent"))


@query(
    "w08_interpolation",
    _B + f""", pt as (select unnest([-1.0, 2.5, 7.0, 20.0]::double[]) as x_at), br as (select model, x_at, max(case when bin <= x_at then bin end) as a, min(case when bin >= x_at then bin end) as c from summary, pt group by all)
 select br.model, x_at, {R('case when a is null then y.s when c is null then x.s when a = c then x.s else x.s + (y.s - x.s) * ((x_at - a) / (c - a)) end', 4)} as y_at from br left join summary x on x.model = br.model and x.bin = a left join summary y on y.model = br.model and y.bin = c""",
)
def _(spark, sf):
    s = _summary(spark, sf).withColumn("x", F.col("bin").cast("double"))
    return windows.interpolate(s, ["model"], "x", "s", [-1.0, 2.5, 7.0, 20.0]).select("model", "x_at", r("y_at", 4).alias("y_at"))

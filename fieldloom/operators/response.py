"""Response algebra over a statistics table (model, realization, bin, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# policy for a vanishing denominator -> (limit, relative to |S_D|, result)
POLICIES: dict[str, tuple[float, bool, float | None]] = {
    "null": (0.0, False, None),
    "zero_relative": (1e-15, True, 0.0),
    "zero_absolute": (1e-30, False, 0.0),
    "null_small": (1e-15, False, None),
}


def summarise(stats: DataFrame, keys: Sequence[str] = ("model", "bin")) -> DataFrame:
    """Mean, population std, standard error and count over realizations."""
    v = F.col("value")
    return stats.groupBy(*keys).agg(
        F.avg(v).alias("s"),
        F.stddev_pop(v).alias("s_std"),
        (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("s_err"),
        F.count(v).alias("n_real"),
    )


def baseline(summary: DataFrame, dmo: str = "dmo", hydro: str = "hydro", axis: Sequence[str] = ("bin",)) -> DataFrame:
    """bin, S_D, S_H, Delta_S with errors."""
    pick = lambda m, x: summary.where(F.col("model") == m).select(
        *axis, F.col("s").alias(f"S_{x}"), F.col("s_err").alias(f"S_{x}_err"), F.col("s_std").alias(f"S_{x}_std"), F.col("n_real").alias(f"n_{x}")
    )
    j = pick(dmo, "D").join(pick(hydro, "H"), list(axis))
    return j.withColumn("Delta_S", F.col("S_H") - F.col("S_D")).withColumn(
        "Delta_S_err", F.sqrt(F.col("S_D_err") * F.col("S_D_err") + F.col("S_H_err") * F.col("S_H_err"))
    )


def ratio(num: Column, den: Column, scale: Column, policy: str = "null") -> Column:
    limit, relative, fallback = POLICIES[policy]
    bound = F.lit(limit) * F.abs(scale) if relative else F.lit(limit)
    ok = F.abs(den) > bound
    return F.when(ok, num / den) if fallback is None else F.when(ok, num / den).otherwise(F.lit(fallback))


def beside_baseline(summary: DataFrame, dmo: str = "dmo", hydro: str = "hydro", axis: Sequence[str] = ("bin",)) -> DataFrame:
    """``summary`` with the baseline's columns on every row, for bins that have both reference models.

    One window over the models of a bin, so the statistics are scanned and summarised once for S_D, S_H and all S_R.
    """
    w = Window.partitionBy(*axis)
    of = lambda m: F.max(F.when(F.col("model") == m, F.struct("s", "s_err", "s_std", "n_real"))).over(w)
    out = summary.withColumns({"_D": of(dmo), "_H": of(hydro)}).where(F.col("_D").isNotNull() & F.col("_H").isNotNull())
    names = {"s": "S_{}", "s_err": "S_{}_err", "s_std": "S_{}_std", "n_real": "n_{}"}
    out = out.select(*summary.columns, *[F.col(f"_{x}.{c}").alias(nm.format(x)) for x in ("D", "H") for c, nm in names.items()])
    quad = F.sqrt(F.col("S_D_err") * F.col("S_D_err") + F.col("S_H_err") * F.col("S_H_err"))
    return out.withColumn("Delta_S", F.col("S_H") - F.col("S_D")).withColumn("Delta_S_err", quad)


def cumulative_response(
    summary: DataFrame, base: DataFrame | None = None, mask: float = 0.0, policy: str = "null", error: str = "absolute", axis: Sequence[str] = ("bin",),
    reference_models: Sequence[str] = ("dmo", "hydro"),
) -> DataFrame:
    """F = (S_R - S_D)/(S_H - S_D) for every other model; without ``base``, the reference models of ``summary`` itself.

    error: absolute = sqrt(eR^2+eD^2)/|Delta_S|; relative = |F| times the relative errors of
    numerator and denominator in quadrature; scaled = sqrt(stdR^2+stdD^2)/|Delta_S|/sqrt(min n).
    """
    r = (beside_baseline(summary, *reference_models, axis) if base is None else summary).where(~F.col("model").isin(*reference_models))
    r = r.withColumnsRenamed({"s": "S_R", "s_err": "S_R_err", "s_std": "S_R_std", "n_real": "n_R"})
    j = (r if base is None else r.join(base, list(axis))).withColumn("delta_S_R", F.col("S_R") - F.col("S_D"))
    den = F.col("Delta_S")
    if mask > 0:
        den = F.when(F.abs(den / (F.abs("S_D") + F.lit(1e-30))) >= mask, den)
    f = ratio(F.col("delta_S_R"), den, F.col("S_D"), policy)
    quad = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    j = j.withColumn("F", f).withColumn("delta_S_R_err", quad("S_R_err", "S_D_err"))
    if error == "absolute":
        e = F.try_divide(F.col("delta_S_R_err"), F.abs("Delta_S"))
    elif error == "relative":
        rel = lambda a, b: F.when(F.abs(b) > 1e-15, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
        u, w = rel("delta_S_R_err", "delta_S_R"), rel("Delta_S_err", "Delta_S")
        e = F.abs("F") * F.sqrt(u * u + w * w)
    else:
        n = F.least("n_R", "n_D", "n_H")
        e = quad("S_R_std", "S_D_std") / F.abs(F.col("Delta_S") + F.lit(1e-15)) / F.sqrt(n)
    return j.withColumn("F_err", e)


def tile_response(tiles: DataFrame, base: DataFrame, axis: Sequence[str] = ("bin",), mask: float = 0.0, policy: str = "null") -> DataFrame:
    """dF(a, i) = (S_tile - S_D)/Delta_S; tiles: mass_idx, shell_idx, axis, s."""
    den = F.col("Delta_S")
    if mask > 0:
        den = F.when(F.abs(den / (F.abs("S_D") + F.lit(1e-30))) >= mask, den)
    j = tiles.join(base, list(axis))
    return j.withColumn("dF", ratio(F.col("s") - F.col("S_D"), den, F.col("S_D"), policy))


def pattern(configs: DataFrame, mass_edges: Sequence[float], alpha_edges: Sequence[float]) -> DataFrame:
    """Tiles of each (m_min, alpha_max): present when the bin starts at or above m_min, weight 1
    when the shell ends at or below alpha_max, else 0."""
    tiles = F.array(
        *[
            F.struct(
                F.lit(a).alias("mass_idx"), F.lit(i).alias("shell_idx"), F.lit(float(mass_edges[a])).alias("m_lo"), F.lit(float(alpha_edges[i + 1])).alias("a_hi")
            )
            for a in range(len(mass_edges) - 1)
            for i in range(len(alpha_edges) - 1)
        ]
    )
    rows = configs.withColumn("_t", F.explode(tiles)).where(F.col("_t.m_lo") >= F.col("m_min"))
    return rows.select(
        *configs.columns,
        F.col("_t.mass_idx").alias("mass_idx"),
        F.col("_t.shell_idx").alias("shell_idx"),
        F.when(F.col("_t.a_hi") <= F.col("alpha_max"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("lam"),
    )


def additive_prediction(patterns: DataFrame, tiles: DataFrame, config: Sequence[str] = ("m_min", "alpha_max"), axis: Sequence[str] = ("bin",)) -> DataFrame:
    """Sum of lambda * dF over the tiles that exist."""
    j = patterns.join(tiles.select("mass_idx", "shell_idx", *axis, "dF"), ["mass_idx", "shell_idx"])
    return j.groupBy(*config, *axis).agg(F.sum(F.col("lam") * F.col("dF")).alias("F_lin"))


def non_additivity(true: DataFrame, lin: DataFrame, config: Sequence[str] = ("m_min", "alpha_max"), axis: Sequence[str] = ("bin",)) -> DataFrame:
    """epsilon = (F - F_lin)/F per bin."""
    j = true.join(lin, [*config, *axis])
    return j.withColumn("epsilon", F.try_divide(F.col("F") - F.col("F_lin"), F.col("F")))


def mean_non_additivity(eps: DataFrame, config: Sequence[str] = ("m_min", "alpha_max")) -> DataFrame:
    return eps.groupBy(*config).agg(F.avg(F.abs("epsilon")).alias("mean_abs_epsilon"))


def multipoles(tiles: DataFrame, axis: Sequence[str] = ("bin",)) -> DataFrame:
    """dF over its sum across tiles; 0 where the sum vanishes."""
    total = tiles.groupBy(*axis).agg(F.sum("dF").alias("_sum"))
    mu = F.when(F.abs("_sum") > 1e-30, F.col("dF") / F.col("_sum")).otherwise(F.lit(0.0))
    return tiles.join(total, list(axis)).withColumn("mu", mu).drop("_sum")


def additivity_over_mass(tiles: DataFrame, cumulative: DataFrame) -> DataFrame:
    """Sphere models: sum of delta_S over mass bins at one radius against the direct model.

    tiles: alpha, bin, delta_S.  cumulative (lowest mass only): alpha, bin, delta_S_R.
    """
    s = tiles.groupBy("alpha", "bin").agg(F.sum("delta_S").alias("sum_tiles"))
    j = s.join(cumulative.select("alpha", "bin", F.col("delta_S_R").alias("direct")), ["alpha", "bin"])
    q = F.when(F.abs("direct") > 1e-15, F.col("sum_tiles") / F.col("direct"))
    return j.groupBy("alpha").agg(F.avg(q).alias("ratio"))


def response_matrix(responses: DataFrame, mask: Column, keys: Sequence[str] = ("m_min", "alpha_max")) -> DataFrame:
    """Mean F and error over the bins that pass ``mask`` and have a value."""
    return responses.where(mask & F.col("F").isNotNull()).groupBy(*keys).agg(F.avg("F").alias("F_mean"), F.avg("F_err").alias("F_err_mean"))


def response_matrix_weighted(responses: DataFrame, min_snr: float = 2.0, min_counts: float = 5.0, keys: Sequence[str] = ("m_min", "alpha_max")) -> DataFrame:
    """Mean F weighted by Delta_S^2/S_D over bins where the effect is detectable."""
    floor = F.greatest(F.col("S_D"), F.lit(1.0))
    snr = F.abs("Delta_S") / F.sqrt(floor)
    w = F.when((snr > min_snr) & (F.col("S_D") > min_counts), F.col("Delta_S") * F.col("Delta_S") / floor)
    r = responses.withColumn("_w", w).where((F.col("_w") > 0) & F.col("F").isNotNull())
    return r.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("F")) / F.sum("_w")).alias("F_mean"),
        F.sqrt(F.sum(F.col("_w") * F.col("F_err") * F.col("F_err")) / F.sum("_w")).alias("F_err_mean"),
    )


def significant_response(joined: DataFrame, threshold: float) -> DataFrame:
    """F where |Delta| > threshold*|S_D|, else NULL."""
    ok = F.abs("Delta_S") > F.lit(threshold) * F.abs("S_D")
    return joined.withColumn("F", F.when(ok, (F.col("S_R") - F.col("S_D")) / F.col("Delta_S")))


def weighted_response(joined: DataFrame, threshold: float, axis_col: str, lo: float, hi: float, keys: Sequence[str] = ("model",)) -> DataFrame:
    """|Delta|-weighted mean of F over significant bins in a closed range."""
    j = significant_response(joined, threshold).where(F.col(axis_col).between(lo, hi) & F.col("F").isNotNull())
    w = F.abs("Delta_S")
    return j.groupBy(*keys).agg((F.sum(F.col("F") * w) / F.sum(w)).alias("F_mean"))


# --- model names -----------------------------------------------------------------

# fixed format: <prefix>_Ml_<lo>_Mu_<hi or inf>_R_<alpha>
MODEL_PATTERN = r"_Ml_([0-9.e+]+)_Mu_(inf|[0-9.e+]+)_R_([0-9.]+)$"


def parse_model(name: Column) -> tuple[Column, Column, Column]:
    """(m_lo, m_hi, alpha); NULL for names of another form. An open upper end is infinite."""
    part = lambda k: F.nullif(F.regexp_extract(name, MODEL_PATTERN, k), F.lit(""))
    hi = F.when(part(2) == "inf", F.lit(math.inf)).otherwise(part(2).cast("double"))
    return part(1).cast("double"), hi, part(3).cast("double")


def format_model(lo: Column, hi: Column, alpha: Column, prefix: str = "replace") -> Column:
    """Mantissas with two decimals, exponents without a plus sign."""

    def sci(c: Column) -> Column:
        exp = F.floor(F.log10(c) + 1e-9)
        mant = F.round(c / F.pow(F.lit(10.0), exp), 2)
        # rounding may carry: 9.996 is 1.00 of the next power
        exp, mant = F.when(mant >= 10, exp + 1).otherwise(exp), F.when(mant >= 10, mant / 10).otherwise(mant)
        return F.concat(F.format_string("%.2f", mant), F.lit("e"), F.lpad(exp.cast("string"), 2, "0"))

    upper = F.when(hi == F.lit(math.inf), F.lit("inf")).otherwise(sci(hi))
    return F.concat(F.lit(f"{prefix}_Ml_"), sci(lo), F.lit("_Mu_"), upper, F.lit("_R_"), F.format_string("%.1f", alpha))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def tile_index(df: DataFrame, mass_edges: Sequence[float], alpha_edges: Sequence[float], lo: str = "m_lo", hi: str = "m_hi", alpha: str = "alpha") -> DataFrame:
    """mass_idx and shell_idx of a model with a finite mass range; others drop out."""
    mass = F.coalesce(
        *[
            F.when(is_close(F.lit(float(mass_edges[k])), F.col(lo)) & is_close(F.lit(float(mass_edges[k + 1])), F.col(hi)), F.lit(k))
            for k in range(len(mass_edges) - 1)
        ]
    )
    shell = F.coalesce(
        *[F.when(is_close(F.lit(float(alpha_edges[k + 1])), F.col(alpha)), F.lit(k)) for k in range(len(alpha_edges) - 1)]
    )
    return df.withColumn("mass_idx", mass).withColumn("shell_idx", shell).where(F.col("mass_idx").isNotNull() & F.col("shell_idx").isNotNull())


def suppression_metrics(curves: DataFrame, keys: Sequence[str], k: str, model: str, reference: str, lo: float, hi: float) -> DataFrame:
    """Largest |ratio-1|, mean ratio and rms of ratio-1 over a closed k range."""
    r = F.try_divide(F.col(model), F.col(reference))
    d = r - F.lit(1.0)
    return curves.where(F.col(k).between(lo, hi)).groupBy(*keys).agg(
        F.max(F.abs(d)).alias("max_deviation"), F.avg(r).alias("mean_ratio"), F.sqrt(F.avg(d * d)).alias("rms")
    )


class ResponseAnalysis:
    """The whole chain over one statistics table, every step a DataFrame."""

    def __init__(self, stats: DataFrame, dmo: str = "dmo", hydro: str = "hydro"):
        self.summary = summarise(stats)
        self.base = baseline(self.summary, dmo, hydro)
        self.reference_models = (dmo, hydro)

    def cumulative(self, **options) -> DataFrame:
        return cumulative_response(self.summary, self.base, reference_models=self.reference_models, **options)

    def tiles(self, indexed: DataFrame, **options) -> DataFrame:
        """indexed: model, mass_idx, shell_idx."""
        rows = self.summary.join(indexed, "model").select("model", "mass_idx", "shell_idx", "bin", "s", "s_err")
        return tile_response(rows, self.base, **options)

    def additivity(self, configs: DataFrame, indexed: DataFrame, mass_edges: Sequence[float], alpha_edges: Sequence[float]) -> DataFrame:
        """configs: model, m_min, alpha_max."""
        true = self.cumulative().join(configs, "model").select("m_min", "alpha_max", "bin", "F")
        plan = pattern(configs.select("m_min", "alpha_max").distinct(), mass_edges, alpha_edges)
        return non_additivity(true, additive_prediction(plan, self.tiles(indexed)))

    def multipoles(self, indexed: DataFrame) -> DataFrame:
        return multipoles(self.tiles(indexed))

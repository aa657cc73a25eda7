"""Quality classification by hierarchical empirical Bayes.

A document's evidence is a naive Bayes sum over binned text measures, learned from the labelled documents by counting. Sites give the prior:
documents' soft labels are summed by path (source and language) and by host (source), and each level is shrunk towards the level above,
path to host and host to the whole corpus, by as many pseudo-documents as the spread between its siblings warrants (a method-of-moments
beta-binomial fit). A document's own soft label is taken out of its sums at all three levels, so its evidence counts once: a site's only
document has the prior of the level above. The posterior joins the document's evidence with its path's prior. All of it is grouped aggregation over counts; the
tables that are joined back have a row for each site or for each bin.

Nulls: a null text counts as empty, a null source or language is a site of its own, null labels and labels of missing documents are left
out. Without labels of both kinds all evidence is 0. Repeated rows count each time. An empty table gives an empty result; extra columns
are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, table, written

#: Below this posterior a document is rejected.
KEEP = 0.5
#: Evidence is divided by this: the measures overlap, so their sum claims too much.
TEMPER = 2.0
#: Bins of each measure, a share, by its upper edges.
EDGES = (0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
#: Soft labels are summed as integers of this many parts, so that sums don't depend on their order.
PARTS = 1_000_000


def measures(text: Column) -> dict[str, Column]:
    """Shares of characters or words that tell prose from shouting, tables, symbol runs and repetition; null texts give 0."""
    t = F.coalesce(text, F.lit(""))
    chars, words = F.greatest(F.length(t), F.lit(1)), F.greatest(n_words(t), F.lit(1))

    def share(pattern: str, of: Column, weight: int = 1) -> Column:
        return F.regexp_count(t, F.lit(pattern)) * weight / of

    return {
        "capitals": share("[A-Z]", chars),
        "symbols": share(r"[^\sA-Za-z0-9.,\x80-\x{10FFFF}]", chars),
        "digits": share("[0-9]", chars),
        "lone_marks": share(r"(?:^|\s)[^\sA-Za-z0-9\x80-\x{10FFFF}]+(?=\s|$)", words),
        "mark_runs": share(r"[^\sA-Za-z0-9\x80-\x{10FFFF}]{2,}", words),
        "doubled": share(r"(?<=^|\s)(\S+)\s+(?=\1(?:\s|$))", words),
    }


def bins(text: Column) -> Column:
    """The bin number of each measure. Each measure is written once, so it is computed once."""
    edges = F.array(*[F.lit(e) for e in EDGES])
    return F.transform(F.array(*measures(text).values()), lambda x: F.size(F.filter(edges, lambda e: x > e)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def learn(rows: DataFrame, labels: DataFrame) -> list[list[float]]:
    """log(P(bin | good) / P(bin | bad)) for each measure and bin: counts of all labelled rows, with half a row added to each bin."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = rows.join(known, "doc_id").select("quality", F.posexplode("bins").alias("measure", "bin")).groupBy("measure", "bin", "quality").count().collect()
    m, n = len(measures(F.lit(""))), len(EDGES) + 1  # so at most 2 * m * n rows
    seen = {(r["measure"], r["bin"], r["quality"]): r["count"] for r in counts}
    total = [sum(seen.get((0, b, q), 0) for b in range(n)) for q in (0, 1)]
    if not all(total):
        return [[0.0] * n for _ in range(m)]
    part = [[[(seen.get((k, b, q), 0) + 0.5) / (total[q] + 0.5 * n) for q in (0, 1)] for b in range(n)] for k in range(m)]
    return [[math.log(part[k][b][1] / part[k][b][0]) for b in range(n)] for k in range(m)]


def evidence(of: Column, weights: list[list[float]]) -> Column:
    """The weights of the bins ``of``, summed."""
    tables = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in weights])
    parts = F.zip_with(of, tables, lambda b, t: F.element_at(t, b + 1))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.lit(TEMPER), 6)


def _shrunk(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (good + strength * prior) / (n + strength)


def _strength(sites: DataFrame, prior: Column) -> float:
    """Pseudo-documents of the level above: from the spread of the sites' shares beyond what their sizes explain. ``sites``: (n, good)."""
    v = F.greatest(prior * (1 - prior), F.lit(1e-6))
    # E[(p - prior)^2] = v / n + rho * v * (1 - 1/n); the strength is 1 / rho - 1
    excess = F.sum(F.round((F.col("n") * (F.col("good") / F.col("n") - prior) ** 2 - v) * PARTS).cast("long"))
    found = sites.agg(excess.alias("excess"), F.sum(F.round((F.col("n") - 1) * v * PARTS).cast("long")).alias("room")).first()
    rho = found["excess"] / found["room"] if found["room"] else 0.0
    return 1 / min(max(rho, 1e-4), 0.99) - 1


@dataclass
class Levels:
    """Sums of soft labels: ``sites`` has (host, path, host_n, host_s, path_n, path_s) for each source and language, in parts; strengths are
    those of the level above."""

    sites: DataFrame
    n: int
    s: int
    base: float
    host_strength: float
    path_strength: float

    def priors(self, soft: Column) -> tuple[Column, Column]:
        """(host prior, path prior) of a document joined to its site, without its own soft label."""
        others = F.least(F.greatest((F.lit(self.s) - soft) / PARTS / (self.n - 1), F.lit(0.01)), F.lit(0.99)) if self.n > 1 else F.lit(self.base)
        host = _shrunk((F.col("host_s") - soft) / PARTS, F.col("host_n") - 1, others, F.lit(self.host_strength))
        return host, _shrunk((F.col("path_s") - soft) / PARTS, F.col("path_n") - 1, host, F.lit(self.path_strength))


def _soft(evidence: Column, base: float) -> Column:
    return F.round(PARTS / (1 + F.exp(-(evidence + _logit(F.lit(base)))))).cast("long")


def fit(rows: DataFrame, labels: DataFrame) -> tuple[list[list[float]], Levels]:
    """(weights, levels) from ``rows``, a stored table of (doc_id, source, lang, bins)."""
    weights = learn(rows, labels)
    known = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality").alias("p")).first()["p"]
    base = _inside(known if known is not None else 0.5)
    paths = rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(_soft(evidence(F.col("bins"), weights), base)).alias("s"))
    paths = written(paths.withColumn("good", F.col("s") / PARTS), "quality-paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("good", F.col("s") / PARTS)
    corpus = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    n, s = corpus["n"] or 0, corpus["s"] or 0
    whole = F.lit(_inside(s / PARTS / n) if n else base)
    host_strength = _strength(hosts, whole)
    prior = _shrunk(F.col("good"), F.col("n"), whole, F.lit(host_strength))
    hosts = hosts.select(F.col("source").alias("host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), prior.alias("host_prior"))
    paths = paths.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    path_strength = _strength(paths, F.col("host_prior"))
    sites = paths.select("host", F.col("lang").alias("path"), "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s"))
    return weights, Levels(written(sites, "quality-sites"), n, s, base, host_strength, path_strength)


def _inside(p: float) -> float:
    return min(max(p, 0.01), 0.99)


def _posterior(evidence: Column, prior: Column) -> Column:
    return F.round(1 / (1 + F.exp(-(evidence + _logit(F.least(F.greatest(prior, F.lit(0.001)), F.lit(0.999)))))), 6)


def _scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """(row, evidence, host_prior, path_prior, posterior): ``row`` is a struct of ``columns`` of ``docs``. The rows are stored with their bins: the
    patterns cost far more than a copy."""
    stored = written(docs.select(F.struct(*columns).alias("row"), bins(F.col("text")).alias("bins")), "quality-bins")
    weights, levels = fit(stored.select("row.doc_id", "row.source", "row.lang", "bins"), labels)
    rows = stored.select("row", evidence(F.col("bins"), weights).alias("evidence"))
    rows = rows.join(levels.sites, F.col("row.source").eqNullSafe(F.col("host")) & F.col("row.lang").eqNullSafe(F.col("path")))
    host, path = levels.priors(_soft(F.col("evidence"), levels.base))
    rows = rows.select("row", "evidence", F.round(host, 6).alias("host_prior"), F.round(path, 6).alias("path_prior"))
    return rows.withColumn("posterior", _posterior(F.col("evidence"), F.col("path_prior")))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, lang, evidence, host_prior, path_prior, posterior)."""
    return _scored(docs, labels, ["doc_id", "source", "lang"]).select("row.*", "evidence", "host_prior", "path_prior", "posterior")


def keep(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches ``least``."""
    return _scored(docs, labels, docs.columns).where(F.col("posterior") >= least).select("row.*")


def op8_site_posteriors(spark, sf_dir):
    """Every document's evidence, priors and posterior, and whether it is kept."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.col("posterior") >= KEEP)

"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are cut into buckets of similar length. A query first meets the longest vectors, which gives it a score that its answer is sure
to reach; it then goes only to buckets whose greatest length can still reach that score. Inside a bucket, the score to reach over the product
of lengths is a local cosine threshold, and each query takes the cheaper of two exact prunings by it: by length (a prefix of the
bucket sorted by length) or by coordinate (the range which that cosine leaves for the normalised vectors' coordinate where the query is
largest). What is left is verified by full products; if most is left, as one matrix product. Bounds are widened by a relative 1e-9
against rounding.

Queries meet buckets as a join on bucket and query block, so a group holds at most ``BUCKET`` vectors and ``QUERIES`` queries, and only
its k best for each query leave it.

Vectors that are null, or hold null or non-finite components, take no part; vectors of other lengths than the query's score nothing with
it. Components are long, and products are summed in 64-bit arithmetic. Repeated ids are separate rows, of which a query excludes every
one of its own id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 5
#: Rows of a bucket, about, and queries of a block.
BUCKET, QUERIES = 16_384, 4_096
#: Longest vectors which set the first threshold of each query.
SEEDS = 1_024
SCALE = 256
#: Sums of products below this are exact as doubles.
EXACT = 2.0**53


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim, norm): components floor(scale * x)."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    out = vectors.where(fine).select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def _products(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    if most < EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T  # wraps like 64-bit sums


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(ids) > 4 * k:  # those that tie with the k-th stay in
        ids_at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        ids_at = np.arange(len(ids))
    return ids_at[np.lexsort((ids[ids_at], -scores[ids_at]))[:k]]


def _survivors(q: np.ndarray, qn: float, floor: float, unit: np.ndarray, norms: np.ndarray, ranks: list) -> np.ndarray | None:
    """Places in the bucket that can reach ``floor``; None: nearly all. Norms fall; ``ranks``: per coordinate (order, sorted values)."""
    n = len(norms)
    if not np.isfinite(floor) or floor <= 0 or qn == 0:
        return None if floor <= 0 or not np.isfinite(floor) else np.zeros(0, np.int64)
    prefix = int(np.searchsorted(-norms, -(floor / qn) * (1 - 1e-9), side="right"))
    cosine = floor / (qn * norms[0]) * (1 - 1e-9) if norms[0] > 0 else 2.0
    if cosine > 1 or prefix == 0:
        return np.zeros(0, np.int64)
    f = int(np.argmax(np.abs(q)))
    c = q[f] / qn
    spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - c * c)))
    # the angle to the query is at most acos(cosine): the coordinate lies within the query's angle to the axis, plus or minus that
    lo = c * cosine - spread if c > -cosine else -1.0
    hi = c * cosine + spread if c < cosine else 1.0
    order, values = ranks[f]
    a, b = np.searchsorted(values, lo - 1e-9, side="left"), np.searchsorted(values, hi + 1e-9, side="right")
    if b - a < prefix:
        at = order[a:b]
        at = at[at < prefix]
    else:
        at = np.arange(prefix)
    return None if 2 * len(at) > n else at


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_key": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return none
        vectors = vectors.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
        v, ids, norms = np.stack(vectors["v"].to_numpy()).astype(np.int64), vectors["vec_id"].to_numpy(), vectors["norm"].to_numpy()
        q, qids, qn = np.stack(queries["v"].to_numpy()).astype(np.int64), queries["vec_id"].to_numpy(), queries["norm"].to_numpy()
        qkeys = queries["query_key"].to_numpy()
        floors = queries["floor"].to_numpy(dtype=float, na_value=-np.inf)
        unit = v / np.where(norms > 0, norms, 1)[:, None]
        most = float(qn.max() * norms.max())
        ranks: dict[int, tuple] = {}
        for f in set(np.abs(q).argmax(axis=1).tolist()):
            order = np.argsort(unit[:, f], kind="stable")
            ranks[f] = (order, unit[order, f])
        out: list[tuple[np.ndarray, ...]] = []

        def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
            own = ids[at] != qids[i]
            at, scores = at[own], scores[own]
            best = _best(ids[at], scores, k)
            out.append((np.full(len(best), qids[i]), np.full(len(best), qkeys[i]), ids[at][best], scores[best]))

        full = []
        for i in range(len(q)):
            at = _survivors(q[i], qn[i], floors[i] if most < EXACT else -np.inf, unit, norms, ranks)
            if at is None:
                full.append(i)
            elif len(at):
                keep(i, at, _products(q[i : i + 1], v[at], most)[0])
        everything = np.arange(len(v))
        for s in range(0, len(full), 256):
            part = full[s : s + 256]
            for i, scores in zip(part, _products(q[part], v, most), strict=True):
                keep(i, everything, scores)
        if not out:
            return none
        return pd.DataFrame(dict(zip(none.columns, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return search


def bucketed(vectors: DataFrame, bucket: int) -> DataFrame:
    """``vectors`` with ``bucket``, of similar length and one dimension, in parts of about ``bucket`` rows."""
    n = vectors.count()
    cuts = max(1, math.ceil(n / bucket))
    edges = vectors.approxQuantile("norm", [i / cuts for i in range(1, cuts)], 0.1 / cuts) if cuts > 1 else []
    edges = sorted(set(edges))  # one for each bucket's worth of rows
    level = F.lit(0)
    if edges:
        level = F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: x < F.col("norm")))
    out = vectors.withColumn("level", level)
    # Equal lengths can't be cut by length: such levels are dealt into parts by a hash of the row.
    parts = out.groupBy("dim", "level").agg(F.ceil(F.count("*") / F.lit(bucket)).cast("int").alias("parts"))
    out = out.join(F.broadcast(parts) if cuts < 1000 else parts, ["dim", "level"])
    return out.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(10)), F.col("parts")).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, bucket: int = BUCKET, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query with all rows of other ids, ties to the smaller id.
    ``vectors`` as of ``quantised``."""
    stored = written(bucketed(vectors, bucket), "topk-vectors")
    queries = stored.where(is_query).select("vec_id", "v", "dim", "norm").dropDuplicates(["vec_id", "v"])
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int"))
    # The longest vectors, a fixed number of them, give each query a score to start from.
    longest = stored.orderBy(F.col("norm").desc(), "vec_id").limit(seeds).select("vec_id", "v", "dim", "norm")
    longest = longest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shape = "query_id long, query_key long, vec_id long, score long"
    started = queries.withColumns({"query_key": F.xxhash64("v"), "floor": F.lit(None).cast("double")})
    first = started.groupBy("block", "dim").cogroup(_renewed(longest).groupBy("block", "dim")).applyInPandas(_search(k), shape)
    reached = F.when(F.count("*") >= k, F.element_at(F.array_sort(F.collect_list("score")), -k))  # k scores at most
    floor = first.groupBy("query_id", "query_key").agg(reached.cast("double").alias("floor"))
    queries = started.drop("floor").join(floor, (F.col("vec_id") == F.col("query_id")) & (started["query_key"] == floor["query_key"]), "left")
    queries = written(queries.select("vec_id", "v", "dim", "norm", "block", started["query_key"], "floor"), "topk-queries")
    # A query goes to the buckets that can still reach its score.
    tops = stored.groupBy("dim", "level", "part").agg(F.max("norm").alias("longest"))
    reach = F.col("longest") * F.col("norm")
    sent = queries.join(tops, "dim").where(F.col("floor").isNull() | (reach * (1 + 1e-9) >= F.col("floor")) | (reach >= EXACT)).drop("longest")
    keys = ["dim", "level", "part", "block"]
    copies = stored.select("vec_id", "v", "norm", "dim", "level", "part").join(sent.select(*keys).distinct(), ["dim", "level", "part"])
    found = sent.groupBy(*keys).cogroup(_renewed(copies).groupBy(*keys)).applyInPandas(_search(k), shape)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _renewed(df: DataFrame) -> DataFrame:
    """``df`` with new column identities: the two sides of a cogroup may not share any."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def op10_norm_buckets(spark, sf_dir):
    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v, F.col("vec_id") % 50 == 0)


def oracle() -> str:
    return """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

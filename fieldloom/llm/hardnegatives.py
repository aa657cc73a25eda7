"""Hard-negative mining over an R-tree packed by sort-tile-recursive cuts.

Rows are cut into slabs by label, those by the coordinate of greatest spread, those by the next one (cut points are quantiles over all rows),
and tiles of more than ``SHARD`` rows, which ties make, are dealt into parts by row number. Inside such a shard the same packing goes
on to leaves of ``LEAF`` rows. A leaf and a shard have a box: the least and greatest value of each coordinate, and of the label.

A box gives each coordinate's product with the anchor an interval, and their sum an interval of scores. Boxes whose labels do not suit, or
whose interval lies outside all score windows of the anchor or strictly below the k-th best score found so far, are pruned; the rest
are a queue, taken best first in growing steps. First an anchor searches the shard of greatest reach; the k-th scores found there narrow
its windows, and with them it goes to every other shard whose box is not pruned. What is left is scored in integers, so results are exact.

Anchors meet shards as a join on shard and block of anchors: a group holds about ``SHARD`` rows and at most ``BLOCK`` anchors or so, and only
the k best of each window leave it. The boxes of shards are met in chunks too; nothing is broadcast or collected but the number of rows.

Rows without an id or label, and vectors that are null or hold null or non-finite components, take no part; vectors of another length than
the anchor's have no score with it. Each row is a row of its own, also where ids or whole rows repeat: a copy of an anchor can be its positive.
Scores are 64-bit. An empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a shard, about; rows of a leaf; anchors of a block; boxes of a chunk.
SHARD, LEAF, BLOCK, CHUNK = 16_384, 128, 2_048, 4_096
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
#: Sums of products below this are exact as doubles.
EXACT = 2.0**53
#: Bounds are widened by this share of the greatest sum against rounding.
SLACK = 1e-12
_LEAVES = "shard string, dim int, least long, most long, lo binary, hi binary, ids binary, labels binary, rows binary, m binary"
_BOXES = "shard string, dim int, least long, most long, lo binary, hi binary"
_FOUND = "anchor long, w long, vec_id long, score long"


def prepared(vectors: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v, dim), stored: components floor(scale * x), and a number for each row."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"), F.size(e).alias("dim"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.col("dim") > 0))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def _slabs(rows: DataFrame, within: list[str], axis: Column, n: int, name: str) -> DataFrame:
    """``rows`` with ``name``, the slab of about equal share that ``axis`` falls into, among rows that agree in ``within``."""
    if n < 2:
        return rows.withColumn(name, F.lit(0))
    cuts = rows.groupBy(*within).agg(F.percentile_approx(axis, [i / n for i in range(1, n)], 10_000).alias("cuts"))
    return rows.join(cuts, within).withColumn(name, F.size(F.filter("cuts", lambda c: c < axis))).drop("cuts")


def shards(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``shard``: tiles by label and two coordinates, of about ``size`` rows."""
    n = max(1, math.ceil(max(1, math.ceil(rows.count() / size)) ** (1 / 3) - 1e-9))
    spread = rows.select("dim", F.posexplode("v").alias("p", "x")).groupBy("dim", "p").agg(F.var_pop("x").alias("s"))
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("s").desc(), "p"))  # as many rows as coordinates
    axes = spread.withColumn("k", order).where("k <= 2").groupBy("dim").agg(F.min(F.when(F.col("k") == 1, F.col("p"))).alias("a"), F.coalesce(F.min(F.when(F.col("k") == 2, F.col("p"))), F.lit(0)).alias("b"))
    out = rows.join(axes, "dim")
    out = _slabs(out, ["dim"], F.col("label"), n, "t1")
    out = _slabs(out, ["dim", "t1"], F.get("v", F.col("a")), n, "t2")
    out = _slabs(out, ["dim", "t1", "t2"], F.get("v", F.col("b")), n, "t3")
    tile = ["dim", "t1", "t2", "t3"]
    parts = out.groupBy(*tile).agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return out.join(parts, tile).select("row", "vec_id", "label", "v", "dim", F.concat_ws("-", *tile, part).alias("shard"))


def _tiles(at: np.ndarray, axes: list[np.ndarray], leaf: int) -> list[np.ndarray]:
    """``at`` packed into leaves: sorted by the first axis, cut into slabs, each packed by the other axes."""
    if len(at) <= leaf:
        return [at]
    at = at[np.argsort(axes[0][at], kind="stable")]
    leaves = math.ceil(len(at) / leaf)
    slab = leaf if len(axes) == 1 else leaf * math.ceil(leaves / math.ceil(leaves ** (1 / len(axes))))
    cut = [at[s : s + slab] for s in range(0, len(at), slab)]
    return cut if len(axes) == 1 else [x for c in cut for x in _tiles(c, axes[1:], leaf)]


def _packed(leaf: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        m, labels = np.stack(pdf["v"].to_numpy()).astype(np.int64), pdf["label"].to_numpy(np.int64)
        ids, rows = pdf["vec_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)
        wide = np.argsort(-m.var(axis=0), kind="stable")[:3]
        out = []
        for at in _tiles(np.arange(len(m)), [labels, *[m[:, c] for c in wide]], leaf):
            box = m[at].min(axis=0).tobytes(), m[at].max(axis=0).tobytes()
            out.append((pdf["shard"].iloc[0], m.shape[1], labels[at].min(), labels[at].max(), *box, ids[at].tobytes(), labels[at].tobytes(), rows[at].tobytes(), m[at].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LEAVES.split(", ")])

    return pack


def _numbers(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int64) for x in column])


def _around(pdf: pd.DataFrame) -> pd.DataFrame:
    """The box around a shard's leaves."""
    box = _numbers(pdf["lo"]).min(axis=0).tobytes(), _numbers(pdf["hi"]).max(axis=0).tobytes()
    return pd.DataFrame([(pdf["shard"].iloc[0], pdf["dim"].iloc[0], pdf["least"].min(), pdf["most"].max(), *box)], columns=[c.split()[0] for c in _BOXES.split(", ")])


def tree(rows: DataFrame, shard: int = SHARD, leaf: int = LEAF, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(leaves, boxes): the packed rows, and a box for each shard with its ``chunk``; both stored."""
    leaves = written(shards(rows, shard).groupBy("shard").applyInPandas(_packed(leaf), _LEAVES), "negatives-leaves")
    boxes = written(leaves.select("shard", "dim", "least", "most", "lo", "hi").groupBy("shard").applyInPandas(_around, _BOXES), "negatives-boxes")
    chunks = max(1, math.ceil(boxes.count() / chunk))
    return leaves, boxes.withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks)))


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64) if most < EXACT else q @ m.T


def _reach(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each row of ``q`` with each box."""
    up, down, lo, hi = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), lo.astype(float), hi.astype(float)
    slack = (np.abs(q).astype(float) @ np.maximum(np.abs(lo), np.abs(hi)).T) * SLACK
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def _suits(label: np.ndarray, boxes: pd.DataFrame, same: bool) -> np.ndarray:
    least, most = boxes["least"].to_numpy(), boxes["most"].to_numpy()
    label = label[:, None]
    return (least <= label) & (label <= most) if same else ~((least == label) & (most == label))


def _open(asked: pd.DataFrame, boxes: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(alive, greatest score) for each anchor and box; alive: the box suits and meets one of the anchor's windows."""
    least, most = _reach(np.stack(asked["v"].to_numpy()).astype(np.int64), _numbers(boxes["lo"]), _numbers(boxes["hi"]))
    meets = np.zeros(most.shape, bool)
    for i, (los, his) in enumerate(zip(asked["lo"], asked["hi"], strict=True)):
        for lo, hi in zip(los, his, strict=True):
            meets[i] |= (most[i] >= lo) & (least[i] <= hi)
    return meets & _suits(asked["label"].to_numpy(), boxes, same), most


def _heads(same: bool):
    """For each anchor, the suitable shard of greatest reach within its windows."""

    def heads(asked: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": pd.Series(dtype="int64"), "shard": pd.Series(dtype="object"), "reach": pd.Series(dtype="float64")})
        if asked.empty or boxes.empty:
            return none
        alive, most = _open(asked, boxes, same)
        most = np.where(alive, np.minimum(most, asked["hi"].map(max).to_numpy(float)[:, None]), -np.inf)
        some = alive.any(axis=1)
        best = most.argmax(axis=1)
        return pd.DataFrame({"anchor": asked["anchor"][some], "shard": boxes["shard"].to_numpy()[best[some]], "reach": most.max(axis=1)[some]})

    return heads


def _sent(same: bool):
    """The shards that some anchor of the block has to search."""

    def sent(asked: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or boxes.empty:
            return pd.DataFrame({"dim": pd.Series(dtype="int32"), "block": pd.Series(dtype="int64"), "shard": pd.Series(dtype="object")})
        names = boxes["shard"].to_numpy()
        alive = _open(asked, boxes, same)[0] & (names[None, :] != asked["head"].to_numpy()[:, None])
        found = names[alive.any(axis=0)]
        return pd.DataFrame({"dim": asked["dim"].iloc[0], "block": asked["block"].iloc[0], "shard": found})

    return sent


class _Best:
    """The k best scores of each window of one anchor: highest first, then smallest id."""

    def __init__(self, los, his, k: int) -> None:
        self.floor, self.top, self.k = np.array(los, np.int64), np.array(his, np.int64), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.floor)

    def wants(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return ((most[:, None] >= self.floor) & (least[:, None] <= self.top)).any(axis=1)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for w in range(len(self.floor)):
            at = (scores >= self.floor[w]) & (scores <= self.top[w])
            if not at.any():
                continue
            i, s = np.concatenate([self.found[w][0], ids[at]]), np.concatenate([self.found[w][1], scores[at]])
            best = np.lexsort((i, -s))[: self.k]
            self.found[w] = i[best], s[best]
            if len(best) == self.k:
                self.floor[w] = s[best[-1]]  # from now on, what lies strictly below is of no use


def _search(k: int, same: bool):
    """Each anchor's best rows of one shard, through the queue of its leaves."""

    def search(asked: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _FOUND.split(", ")})
        if asked.empty or leaves.empty:
            return none
        ids, labels, rows = (np.concatenate([np.frombuffer(x, np.int64) for x in leaves[c]]) for c in ("ids", "labels", "rows"))
        m = np.concatenate([np.frombuffer(x, np.int64) for x in leaves["m"]]).reshape(len(ids), -1)
        leaf = np.repeat(np.arange(len(leaves)), [len(x) // 8 for x in leaves["ids"]])
        start = np.searchsorted(leaf, np.arange(len(leaves) + 1))
        q, label, own = np.stack(asked["v"].to_numpy()).astype(np.int64), asked["label"].to_numpy(), asked["anchor"].to_numpy()
        least, most = _reach(q, _numbers(leaves["lo"]), _numbers(leaves["hi"]))
        suits = _suits(label, leaves, same)
        boards = [_Best(a, b, k) for a, b in zip(asked["lo"], asked["hi"], strict=True)]

        def score(i: int, at: np.ndarray, scores: np.ndarray) -> None:
            good = ((labels[at] == label[i]) == same) & (rows[at] != own[i])
            boards[i].add(ids[at[good]], scores[good])

        wide = []
        for i, board in enumerate(boards):
            queue = np.flatnonzero(suits[i] & board.wants(least[i], most[i]))
            queue = queue[np.argsort(-most[i, queue], kind="stable")]
            step = 1
            while len(queue):
                if 2 * len(queue) > len(leaves) and step > 1:  # the bounds say little here: one product with all rows is cheaper
                    wide.append(i)
                    break
                part, queue, step = queue[:step], queue[step:], 2 * step
                at = np.concatenate([np.arange(start[x], start[x + 1]) for x in part])
                score(i, at, _products(q[i : i + 1], m[at])[0])
                queue = queue[board.wants(least[i, queue], most[i, queue])]
        every = np.arange(len(ids))
        for s in range(0, len(wide), 256):
            part = wide[s : s + 256]
            for i, scores in zip(part, _products(q[part], m), strict=True):
                board = boards[i] = _Best(asked["lo"].iloc[i], asked["hi"].iloc[i], k)  # its first leaf is among them
                board.floor = np.maximum(board.floor, np.array(asked["lo"].iloc[i], np.int64))
                score(i, every, scores)
        out = [(own[i], w, v, x) for i, b in enumerate(boards) for w, (vs, xs) in zip(asked["w"].iloc[i], b.found, strict=True) for v, x in zip(vs, xs, strict=True)]
        return pd.DataFrame(out, columns=list(none.columns)).astype("int64") if out else none

    return search


def _renewed(df: DataFrame) -> DataFrame:
    """``df`` with new column identities: the two sides of a cogroup may not share any."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def _meet(asked: DataFrame, others: DataFrame, keys: list[str], fn, shape: str) -> DataFrame:
    return asked.groupBy(*keys).cogroup(_renewed(others).groupBy(*keys)).applyInPandas(fn, shape)


def search(asked: DataFrame, leaves: DataFrame, boxes: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, w, rank, vec_id, score): for each window ``w`` of each row of ``asked`` (anchor, label, v, dim, block, w, lo, hi; the last three are
    arrays of equal length) the k highest scores within [lo, hi] among rows of the same label or of others."""
    blocks = asked.select("dim", "block").distinct()
    chunks = boxes.join(blocks, "dim")
    near = ["dim", "block", "chunk"]
    spread = lambda a: a.join(boxes.select("dim", "chunk").distinct(), "dim")
    heads = _meet(spread(asked), chunks, near, _heads(same), "anchor long, shard string, reach double")
    heads = heads.groupBy("anchor").agg(F.max(F.struct("reach", "shard"))["shard"].alias("head"))
    asked = written(asked.join(heads, "anchor"), "negatives-asked")  # anchors that suit no shard have no result
    met = ["shard", "block"]

    def visit(to: DataFrame) -> DataFrame:
        return _meet(to, leaves.join(to.select(*met).distinct(), "shard"), met, _search(k, same), _FOUND)

    first = written(visit(asked.withColumn("shard", F.col("head"))), "negatives-first")
    kth = first.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("floors"))  # one entry for each window
    rest = asked.join(kth, "anchor", "left")
    raised = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", F.get("w", i)), x)))
    rest = written(rest.withColumn("lo", raised).drop("floors"), "negatives-asked")
    sent = _meet(spread(rest), chunks, near, _sent(same), "dim int, block long, shard string").distinct()
    second = visit(rest.join(sent, ["dim", "block"]).where(F.col("shard") != F.col("head")))
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "vec_id"))
    return first.unionByName(second).withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``rows`` as of ``prepared``."""
    leaves, boxes = tree(rows, shard, leaf, chunk)
    anchors = rows.where(is_anchor).select(F.col("row").alias("anchor"), "vec_id", "label", "v", "dim")
    blocks = max(1, math.ceil(anchors.count() / block))
    anchors = written(anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))), "negatives-anchors")
    vector, window = ["anchor", "label", "v", "dim", "block"], lambda *x: F.array(*[F.lit(c).cast("long") if isinstance(c, int) else c for c in x])
    asked = anchors.select(*vector, window(0).alias("w"), window(-(2**63)).alias("lo"), window(2**63 - 1).alias("hi"))
    pairs = written(search(asked, leaves, boxes, positives, True), "negatives-positives")
    pairs = pairs.select("anchor", F.col("rank").cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 30 p <= 100 n <= 90 p, in integers; a negative p leaves no n
    s = F.col("positive_score")
    bounds = F.struct("w", F.expr("(3 * positive_score + 9) div 10").alias("lo"), F.expr("(9 * positive_score) div 10").alias("hi"))
    windows = pairs.where(s >= 0).groupBy("anchor").agg(F.sort_array(F.collect_list(bounds)).alias("b"))  # ``positives`` at most
    asked = anchors.select(*vector).join(windows, "anchor").select(*vector, F.col("b.w").alias("w"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    found = search(asked, leaves, boxes, negatives, False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    out = found.join(pairs, ["anchor", "w"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_packed_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(prepared(table(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 100 == 0)


def oracle() -> str:
    return """
with v as (select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.k as anchor, q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, cast(list_dot_product(q.v, c.v) as bigint) as score
      from v q join v c on c.k <> q.k and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
p as (select *, row_number() over (partition by anchor order by score desc, vec_id) as w from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor, p.w order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score where p.w <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

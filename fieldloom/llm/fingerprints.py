"""SimHash near-duplicates, linked exactly through vantage-point trees.

Fingerprints that differ in at most three bits differ in at most one bit of their upper or of their lower half. So there are two trees, each over
the Hamming distance within one half: a node holds a vantage point and a radius; fingerprints within the radius go left, the others go
right, and those outside by no more than the search distance also visit the left side, since the triangle inequality allows them partners
there. Deeper, visitors go to each side that their distance allows. Where a half no longer tells fingerprints apart (a crowd of near copies),
nodes use the distance within the other half, with search distance three. The trees are grown on a bounded sample of fingerprints and
every distinct fingerprint is sent down them; each leaf is a shard, in which residents are compared with all that arrived, in blocks.
A leaf above ``LEAF`` rows is dealt over several tasks. A task returns a spanning forest of the links it found instead of all pairs; the
forests' connected components are the links' components.

Links of three bits reach only texts that are all but equal: those of similarity 0.8 differ by ten bits, a distance at which triangle bounds prune
nothing. ``similar`` therefore adds links of verified word similarity, from texts that agree in a band of min-hashes, however far apart their
fingerprints are.

Copies of a fingerprint are one node throughout. Nulls: a null text counts as empty (fingerprint zero); null ids are kept, and a component
without any other id gets a null one. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unused, written
from .textcode import mix

BITS_APART = 3
SEED = 42
#: Fingerprints that the trees are grown on, and the sample's rows in a leaf.
SAMPLE, SAMPLE_LEAF = 40_000, 40
#: Rows of a leaf that one task takes; more are dealt over several.
LEAF = 50_000
#: Shingles hashed at once.
RUN = 1 << 16
#: Min-hashes of a band, and bands: of pairs of similarity 0.8, 0.998 share a band.
BAND, BANDS = 4, 12
#: Members of a group of one band that one task compares; larger groups are dealt into blocks, and all pairs of blocks are compared.
BLOCK = 256
_FACTORS = mix(np.arange(BAND * BANDS, dtype=np.uint64), 77) | np.uint64(1)
_HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))


def shingles(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in runs; nothing for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)
        return
    for s in range(0, len(words) - size + 1, RUN):
        part = words[s : s + RUN + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        m = len(part) - size + 1
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, m)


def sketch(text: bytes, size: int, bands: bool) -> tuple[int, np.ndarray]:
    """The fingerprint, and the band keys of the shingles' min-hashes if asked for and there are words."""
    counts, n, least = np.zeros(64, dtype=np.int64), 0, None
    for h in shingles(text, size):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        if bands:
            low = np.fromiter(((h * a).min() for a in _FACTORS), np.uint64, len(_FACTORS))
            least = low if least is None else np.minimum(least, low)
    fp = int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])
    if least is None:
        return fp, np.zeros(0, np.int64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key + least[k::BAND], 31 + k)
    return fp, key.view(np.int64)


def fingerprint(text: bytes, size: int) -> int:
    return sketch(text, size, False)[0]


def fingerprints(docs: DataFrame, size: int = 3, bands: bool = False) -> DataFrame:
    """(doc_id, code, fp): a hash of the text, and a signed long whose bits are the fingerprint; with ``bands`` also (keys), the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()) if not pa.types.is_null(b.column("text").type) else b.column("text")
            found = [sketch(t.as_py() or b"", size, bands) for t in texts]
            out = {"doc_id": b.column("doc_id"), "code": b.column("code"), "fp": pa.array(np.array([x for x, _ in found], np.uint64).view(np.int64))}
            if bands:
                out["keys"] = pa.array([x for _, x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("code"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, code long, fp long" + ", keys array<long>" * bands)


def distance(a: np.ndarray, b: np.ndarray, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


@dataclass
class Node:
    vantage: np.uint64
    mask: np.uint64
    radius: int
    apart: int  # the search distance within the mask
    left: Node | int
    right: Node | int


def grow(sample: np.ndarray, half: int, leaf: int = SAMPLE_LEAF) -> Node | int:
    """A tree over one half; leaves are numbered from 0."""
    rng, number = np.random.default_rng(half), iter(range(1 << 60))
    own, other = _HALVES[half], _HALVES[1 - half]

    def split(fp: np.ndarray) -> Node | int:
        if len(fp) > leaf:
            # The other half only where this one doesn't divide: its search distance is wider.
            for mask, apart in ((own, BITS_APART // 2), (other, BITS_APART)):
                best = None
                for v in [*fp[rng.integers(0, len(fp), 6)], *rng.integers(0, 2**64, 2, dtype=np.uint64)]:
                    d = distance(fp, v, mask)
                    radius = int(np.median(d))
                    for r in (radius - 1, radius):
                        inside = int((d <= r).sum())
                        visits = int(((d > r) & (d <= r + apart)).sum())
                        if min(inside, len(fp) - inside) >= len(fp) // 8 and (best is None or abs(2 * inside - len(fp)) + 2 * visits < best[0]):
                            best = (abs(2 * inside - len(fp)) + 2 * visits, v, r, d <= r)
                if best:
                    _, v, r, inside = best
                    return Node(v, mask, r, apart, split(fp[inside]), split(fp[~inside]))
        return next(number)

    return split(np.unique(sample))


def descend(tree: Node | int, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, fingerprints, whether they live there or visit)."""
    stack = [(tree, fp, np.ones(len(fp), dtype=bool))]
    while stack:
        node, x, home = stack.pop()
        if not len(x):
            continue
        if isinstance(node, int):
            yield node, x, home
            continue
        d = distance(x, node.vantage, node.mask).astype(np.int64)
        inside = d <= node.radius
        # Residents cross to the left only, visitors to either side that may hold partners.
        to_left, to_right = d <= node.radius + node.apart, np.where(home, ~inside, d > node.radius - node.apart)
        stack.append((node.left, x[to_left], (home & inside)[to_left]))
        stack.append((node.right, x[to_right], home[to_right]))


def _forest(home: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``home`` and ``there``: (a, b)."""
    nodes = np.unique(np.concatenate([home, there]))
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    full, a, b = np.uint64(2**64 - 1), [], []
    rows = max(1, 4_000_000 // max(1, len(there)))
    for s in range(0, len(home), rows):
        part = home[s : s + rows]
        i, j = np.nonzero(distance(part[:, None], there[None, :], full) <= BITS_APART)
        x, y = np.searchsorted(nodes, part[i]), np.searchsorted(nodes, there[j])
        for p, q in zip(x[x != y].tolist(), y[x != y].tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(nodes[min(p, q)])
                b.append(nodes[max(p, q)])
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs at most three bits apart. ``distinct``: a stored table of distinct ``fp``."""
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)  # bounded
    trees = [grow(sample, half) for half in (0, 1)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                for leaf, x, home in descend(tree, fp):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 2 * leaf + t)), pa.array(x.view(np.int64)), pa.array(home)], ["leaf", "fp", "home"])

    sent = written(distinct.select("fp").mapInArrow(send, "leaf long, fp long, home boolean"), "simhash-leaves")
    sizes = sent.groupBy("leaf").agg(F.count("*").alias("rows"))
    # Large leaves: residents are dealt into parts, and each part meets all that arrived, part by part.
    parts = sizes.select("leaf", F.ceil(F.col("rows") / LEAF).cast("int").alias("parts"))
    sent = sent.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("parts")).cast("int"))
    everyone = F.sequence(F.lit(0), F.col("parts") - 1)
    left = sent.where("home").withColumn("with", F.explode(everyone)).select("leaf", F.col("part").alias("p"), F.col("with").alias("q"), "fp", F.lit(True).alias("home"))
    right = sent.withColumn("with", F.explode(everyone)).select("leaf", F.col("with").alias("p"), F.col("part").alias("q"), "fp", F.lit(False).alias("home"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        a, b = _forest(fp[home], fp[~home])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return left.union(right).groupBy("leaf", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def similar_links(docs: DataFrame, coded: DataFrame, size: int, similar: float) -> DataFrame:
    """(a, b): links between the fingerprints of texts whose sets of shingles have a Jaccard similarity of ``similar`` or more. ``coded``: a
    stored table of ``fingerprints`` with band keys.

    Texts that agree in a band meet in a group; groups of the same members are one. A group above ``BLOCK`` is dealt into blocks, and each block
    meets each other one in a task. A task returns a spanning forest of the verified links.
    """
    rows = written(coded.select("code", "fp", F.explode("keys").alias("key")).distinct().withColumn("o", F.xxhash64("code", F.lit(7))), "simhash-bands")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("code")).alias("who"), F.min("fp").alias("x"), F.max("fp").alias("y"))
    groups = groups.where("n > 1 and x < y")
    once = groups.groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    groups = groups.join(once, "key", "left_semi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(groups, "key").withColumn("part", F.pmod("o", F.col("parts")).cast("int"))
    dealt = dealt.select("key", "code", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    members = written(dealt.select("key", "code", "fp", "part", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q")), "simhash-members")
    # The words of each text that is needed, from one row that has it.
    first = coded.groupBy("code").agg(F.min("doc_id").alias("first")).withColumnRenamed("code", "of")
    first = first.join(members.select(F.col("code").alias("of")).distinct(), "of", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("code"), F.col("text").cast("string").alias("text"))
    texts = texts.join(first, (F.col("code") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("code", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for code, t in zip(b.column("code").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                words = np.unique(np.concatenate(list(shingles(t.as_py(), size))))
                yield pa.RecordBatch.from_pydict({"code": pa.array([code]), "words": pa.array([words.tobytes()], pa.binary())})

    sets = written(texts.mapInArrow(run, "code long, words binary").dropDuplicates(["code"]), "simhash-sets")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fp", "code"])
        fp, words = pdf["fp"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["words"]]
        size, part = np.array([len(x) for x in words]), pdf["part"].to_numpy()
        apart = pdf["p"].iloc[0] != pdf["q"].iloc[0]  # pairs within a block are another task's
        root, a, b = list(range(len(fp))), [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(fp)):
            small, large = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
            # Copies of a fingerprint are one node, whatever their size.
            near = ((small >= similar * large) | (fp[i + 1 :] == fp[i])) & ((part[i + 1 :] != part[i]) | ~np.bool_(apart))
            for j in (np.flatnonzero(near) + i + 1).tolist():
                p, q = top(i), top(j)
                if p == q:
                    continue
                if fp[i] != fp[j]:
                    both = len(np.intersect1d(words[i], words[j], assume_unique=True))
                    if both < similar * (size[i] + size[j] - both):
                        continue
                    a.append(fp[i])
                    b.append(fp[j])
                root[max(p, q)] = min(p, q)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return members.join(sets, "code").select("key", "p", "q", "part", "code", "fp", "words").groupBy("key", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with links: large-star and small-star steps until nothing changes."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = written(small, "cc-small")
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, similar: float | None = None) -> DataFrame:
    """(doc_id, code, fp, root, component_id): the component by a fingerprint, and by the smallest id that links of at most three bits
    lead to; with ``similar`` also links of texts of that Jaccard similarity."""
    coded = written(fingerprints(docs, size, similar is not None), "simhash-codes")
    distinct = written(coded.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = links(distinct)
    if similar is not None:
        edges = edges.union(similar_links(docs, coded, size, similar))
    roots = components(edges)
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped, "simhash-grouped")
    ids = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.select(F.col("fp").alias("of"), "root").join(ids, "root")
    return coded.join(named, coded["fp"] == named["of"]).select("doc_id", "code", "fp", "root", "component_id")


def keep_one(docs: DataFrame, size: int = 5, similar: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id (null last), of several texts with that id the one of the least hash,
    of repeated rows any one."""
    near = written(near_duplicates(docs, size, similar), "simhash-near")
    own = unused(docs)
    best = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "code").agg(F.count("*").alias("n"))
    least = best.groupBy("root").agg(F.min("code").alias("least"))
    kept = best.join(least, "root").where("code = least").select(F.col("doc_id").alias(f"{own}id"), F.col("code").alias(f"{own}code"), F.col("n").alias(f"{own}n"))
    # Rows of null id and equal text hash are in one component, so (id, hash) names the kept rows.
    on = F.xxhash64("text") == F.col(f"{own}code"), F.col("doc_id").eqNullSafe(F.col(f"{own}id"))
    rows = docs.join(kept, on[0] & on[1])
    once, again = rows.where(F.col(f"{own}n") == 1), rows.where(F.col(f"{own}n") > 1).dropDuplicates([f"{own}id", f"{own}code"])
    return once.select(*docs.columns).union(again.select(*docs.columns))


def op7_simhash_components(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Toxic passages by maximum-scoring segments.

Words are coded twice, as a whole and by their first letters, so that inflected forms share evidence, into a table of ``BUCKETS`` codes.
Each code's weight is its log-odds between toxic and other labelled documents (counting a document once), with a Dirichlet prior in proportion to the
code's share of all labelled documents, and counts only if it stands out of its sampling error; all other words lose a fixed step,
so ordinary text drifts down. A linear scan per document finds all maximal scoring segments. Their scores are calibrated by an extreme-value
law: the best segments of non-toxic documents follow a Gumbel distribution that shifts with the logarithm of the length. A segment is significant
if chance would give such a one in few documents; the scores of a document's significant segments are added up, net of that shift. A logistic
fit on the labelled rows turns the sum into a score.

Only the text is an input of a score. Labels are learned from rows outside the held-out part. Nulls: a null text counts as empty and gets the
score of a document without evidence; null labels are left out. Without labels of both kinds, every score is 0. Repeated rows are scored
each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .textcode import LOWER, VALUES, Codes, blocks, mix, words

#: Codes of words and of word beginnings: a fixed table of 2 MB.
BUCKETS = 1 << 18
#: Bytes of the word beginnings.
STEMS = (4, 6)
#: Standard errors by which a weight must stand out, and the prior's documents.
SURE, PRIOR = 4.0, 50.0
#: What each word costs, and what a word with weight pays besides, so that words only a little commoner in toxic documents don't add up.
STEP, MARGIN = 0.05, 1.5
#: Labelled rows, at most, for the calibration; chosen by hash.
CALIBRATE = 50_000
#: Chance of a significant segment in a non-toxic document.
CHANCE = 0.02
THRESHOLD = 0.3
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[*range(33), *string.punctuation.encode(), 127]] = True


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The table codes of each word, whole and by its beginnings, and the row offsets. ASCII punctuation ends words, A-Z become small."""
    lo, hi, rows = words(data, offsets, _BETWEEN)
    c = Codes(data, VALUES[LOWER])
    ends = [hi, *(np.minimum(hi, lo + k) for k in STEMS)]
    return [(mix(c.of(lo, e) + (e - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407), k) >> np.uint64(46)).astype(np.int64) for k, e in enumerate(ends)], rows


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def distinct_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): the different codes of each text; what the join with the labels moves in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in blocks(b.column("text")):
                codes, rows = word_buckets(data, offsets)
                row = np.repeat(np.arange(j - i), np.diff(rows))
                once = np.unique(np.concatenate([row * BUCKETS + c for c in codes]))
                ends = np.searchsorted(once, np.arange(j - i + 1) * BUCKETS)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(once % BUCKETS, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), lists], ["doc_id", "codes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, codes array<int>")


def document_counts(labelled: DataFrame) -> DataFrame:
    """(code, n0, n1): labelled documents of either kind that hold a code. ``labelled``: (codes, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, dtype=np.int64)
        docs = np.zeros(2, dtype=np.int64)
        for b in batches:
            kind, codes = b.column("toxic").to_numpy(), b.column("codes")
            docs += np.bincount(kind, minlength=2)
            of = np.repeat(kind.astype(np.int64), codes.value_lengths().to_numpy())
            counts += np.bincount(of * BUCKETS + codes.flatten().to_numpy(), minlength=2 * BUCKETS)
        n = np.concatenate([counts.reshape(2, BUCKETS), docs[:, None]], axis=1)
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["code", "n0", "n1"])

    found = labelled.select("codes", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "code long, n0 long, n1 long")
    return found.groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def weights(counts: DataFrame) -> np.ndarray:
    """Log-odds of each code; 0 for codes that don't stand out. ``counts`` has at most BUCKETS + 1 rows."""
    pdf = counts.toPandas()
    n = np.zeros((2, BUCKETS + 1))
    if len(pdf):
        n[:, pdf["code"].to_numpy()] = pdf[["n0", "n1"]].to_numpy(dtype=float).T
    docs, n = n[:, BUCKETS], n[:, :BUCKETS]
    if not docs.all():
        return np.zeros(BUCKETS)
    share = (n.sum(axis=0) + 0.5) / (docs.sum() + 1)
    prior = PRIOR * share
    odds = []
    for y in (0, 1):
        a = n[y] + prior
        odds.append((np.log(a / (docs[y] + PRIOR - n[y] - prior + 1e-9).clip(1e-9)), 1 / a))
    delta, error = odds[1][0] - odds[0][0], np.sqrt(odds[0][1] + odds[1][1])
    return np.where(np.abs(delta) > SURE * error, delta, 0.0)


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of ``x`` as (first, after the last, score), in linear time: each keeps the sums before and after it, and
    joins back to the latest one that started lower as long as its own end is higher. A segment also keeps where that one stands: all between
    start no lower than itself, so a later search that passes it need not look at them."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, place of the latest one that starts lower
    for i in np.flatnonzero(x > 0).tolist():
        start, lo, hi, k = i, float(sums[i]), float(sums[i + 1]), len(found) - 1
        while k >= 0 and found[k][2] >= lo:
            k = found[k][4]
        while k >= 0 and found[k][3] < hi:
            start, lo, before = found[k][0], found[k][2], found[k][4]
            del found[k:]
            k = before
        found.append((start, i + 1, lo, hi, k))
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


def word_scores(codes: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Each word's strongest evidence, less the margin, or the step."""
    best = np.max([w[c] for c in codes], axis=0) if len(codes[0]) else np.zeros(0)
    return np.where(best > MARGIN, best - MARGIN, 0.0) - STEP


SHAPE = "doc_id long, held_out boolean, words long, starts array<long>, ends array<long>, scores array<double>"


def scan(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """(doc_id, held_out, words, starts, ends, scores): the maximal scoring segments of each text, by word."""
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, j, data, offsets in blocks(b.column("text")):
                codes, rows = word_buckets(data, offsets)
                x = word_scores(codes, w)
                hit = np.add.reduceat(np.concatenate([x > 0, [False]]), rows[:-1]) if j > i else []
                for k in range(j - i):
                    found = segments(x[rows[k] : rows[k + 1]]) if rows[k + 1] > rows[k] and hit[k] else []
                    out[0].append(int(rows[k + 1] - rows[k]))
                    for c in range(3):
                        out[c + 1].append([f[c] for f in found])
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *arrays], ["doc_id", "held_out", "words", "starts", "ends", "scores"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SHAPE)


def _gumbel(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """(rate, shift) of best segment scores of non-toxic texts: P(best < s) = exp(-words * exp(shift - rate * s)), by
    the median and the upper tenth."""
    if len(best) < 20:
        return 1.0, 0.0
    rate = 1.0
    for _ in range(30):  # the spread left after the logarithm of the length is taken out
        mid, high = np.quantile(best - np.log(words) / rate, [0.5, 0.9])
        rate = min(max(1.884 / max(float(high - mid), 1e-3), 0.5), 4.0)  # between these quantiles of the standard law
    return rate, float(rate * np.median(best - np.log(words) / rate) - 0.3665)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, by Newton steps with a slight ridge."""
    a = np.array([0.0, 0.0])
    m = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2), m.T @ (y - p) - 1e-2 * a)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def evidence(rate: float, shift: float) -> Column:
    """The significant segments' net scores, summed and damped: per segment, -log of its expected number in a text of this length."""
    room = F.log(F.greatest(F.col("words"), F.lit(1)).cast("double")) + F.lit(shift)
    net = F.transform(F.col("scores"), lambda s: s * F.lit(rate) - room)
    sure = F.filter(net, lambda s: s > F.lit(-math.log(CHANCE)))
    return F.log1p(F.aggregate(sure, F.lit(0.0), lambda a, s: a + s))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, starts, ends): score 0 to 1, and the word spans of significant passages."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    docs = docs.select("doc_id", "text")
    # The labels grow with the corpus, so they aren't broadcast at any size.
    known = known.hint("merge")
    learned = distinct_codes(docs.where(~held_out(F.col("doc_id")))).join(known, F.col("doc_id") == F.col("of"))
    w = weights(document_counts(learned))
    found = written(scan(docs, w), "toxic-segments")
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    sample = found.where("not held_out").join(known, F.col("doc_id") == F.col("of")).select("doc_id", "toxic", "words", best.alias("best"), "scores")
    sample = written(sample.orderBy(F.xxhash64("doc_id")).limit(CALIBRATE), "toxic-calibration")
    pdf = sample.where("toxic = 0").select("best", "words").toPandas().sort_values(["best", "words"])  # bounded
    rate, shift = _gumbel(pdf["best"].to_numpy(dtype=float), np.maximum(pdf["words"].to_numpy(dtype=float), 1))
    pairs = sample.select("toxic", evidence(rate, shift).alias("x")).toPandas().sort_values(["x", "toxic"])
    if pairs["toxic"].nunique() < 2:
        value = F.lit(0.0)
    else:
        a, b = _logistic(pairs["x"].to_numpy(dtype=float), pairs["toxic"].to_numpy(dtype=float))
        value = F.round(1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * evidence(rate, shift)))), 6)
    room = F.log(F.greatest(F.col("words"), F.lit(1)).cast("double")) + F.lit(shift) - F.lit(math.log(CHANCE))
    spans = F.filter(F.arrays_zip("starts", "ends", "scores"), lambda s: s["scores"] * F.lit(rate) > room)
    out = found.select("doc_id", "held_out", value.alias("score"), spans.alias("spans"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"))


def op6_toxic_segments(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

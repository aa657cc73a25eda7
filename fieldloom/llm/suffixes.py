"""Removal of long repeats by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``length`` bytes only, most significant digit first, and the groups that are still equal after the last digit
are the repeated windows. The first digit is chosen so that the suffixes needn't all be moved: the least 32-byte code inside a window (its
anchor, a function of the window's bytes alone). Equal windows have equal anchors at equal offsets, and consecutive windows mostly share one, so a row
stands for a run of windows, about one for 185 bytes. Anchors that occur once end there. A run whose bytes all occur elsewhere at the same offset is
repeated as a whole. The bytes of the other runs with repeated anchors, one for each distinct content, meet by anchor, and their windows are sorted by four
further digits, codes of 100 bytes, dropping groups of one after each pass. Anchors of more than ``GROUP`` contents are sorted as single windows
by their whole code instead, which any number of tasks can share.

Codes have 64 bits: two windows are taken for equal if the anchor's code and four codes agree (or, for whole runs and single windows, two).
Nulls: a null text is empty. Texts shorter than ``length`` stay whole. Repeated rows are other places, so they lose all their windows.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .textcode import Codes, blocks, mix, raw, signed, window_min

LENGTH, GRAM = 400, 32
#: Bytes of a text looked at in one go, windows at the seams included twice.
PIECE = 1 << 21
_PLACE = 22  # bits of a position within a piece
#: Distinct contents of an anchor that one task sorts; windows sorted at once.
GROUP, CHUNK = 4_000, 1_500_000
_SECOND = mix(np.arange(256, dtype=np.uint64), 11)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, first start, last start, anchor code, code of the run's bytes): runs of windows with one anchor."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    c = Codes(data)
    g = mix(c.every(gram))
    key = (g >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(g), dtype=np.uint64)
    low = window_min(key, length - gram + 1)
    rows = np.diff(offsets)
    ends = np.zeros(len(data) + 1, dtype=np.int32)
    long = rows >= length
    np.add.at(ends, offsets[:-1][long], 1)
    np.add.at(ends, offsets[1:][long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(ends)[: len(low)])
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    a = (low[p] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, p, side="right") - 1
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(a) != 0) | (np.diff(row) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
    s0, s1, a, row = p[first], p[last], a[first], row[first]
    shape = ((a - s0) * 1_000_003 + (s1 - s0)).astype(np.uint64)
    whole = mix(c.of(s0, s1 + length) + mix(shape, 3))
    return row, a - offsets[row], s0 - offsets[row], s1 - offsets[row], g[a], whole


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, code, a, s0, s1, h, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text")):
                pieces = [(0, data, offsets)]
                if len(data) > PIECE:  # one long text
                    pieces = [(s, data[s : s + PIECE], np.array([0, min(PIECE, len(data) - s)])) for s in range(0, len(data) - length + 1, PIECE - length + 1)]
                part = batch.slice(i, j - i)
                for base, d, o in pieces:
                    row, a, s0, s1, h, whole = runs(d, o, length, gram)
                    at = pa.array(row)
                    out = [part.column("doc_id").take(at), part.column("code").take(at), pa.array(a + base), pa.array(s0 + base), pa.array(s1 + base)]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(signed(h)), pa.array(signed(whole))], ["doc_id", "code", "a", "s0", "s1", "h", "whole"])

    return docs.mapInArrow(run, "doc_id long, code long, a long, s0 long, s1 long, h long, whole long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, n, doc_id, code, s0, offset, bytes): the bytes of the wanted runs. ``wanted``: (doc_id, code, h, n, kinds, a, s0, s1)."""
    lists = wanted.groupBy(F.col("doc_id").alias("id"), F.col("code").alias("c")).agg(F.collect_list(F.struct("h", "n", "kinds", "a", "s0", "s1")).alias("runs"))
    rows = docs.join(lists, (F.col("code") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "code", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(b.column("text"))
            lists = b.column("runs")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            f = lists.flatten()
            h, n, kinds, a, s0, s1 = (f.field(k) for k in range(6))
            lo, hi = s0.to_numpy() + offsets[rows], s1.to_numpy() + length + offsets[rows]
            for s in range(0, len(rows), 2000):
                e = min(len(rows), s + 2000)
                body = pa.array([data[x:y].tobytes() for x, y in zip(lo[s:e].tolist(), hi[s:e].tolist(), strict=True)], pa.binary())
                at = pa.array(rows[s:e])
                offset = pa.array(a.to_numpy()[s:e] - s0.to_numpy()[s:e])
                cut = slice(s, e)
                yield pa.RecordBatch.from_arrays(
                    [h[cut], n[cut], kinds[cut], b.column("doc_id").take(at), b.column("code").take(at), s0[cut], offset, body],
                    ["h", "n", "kinds", "doc_id", "code", "s0", "offset", "bytes"],
                )

    return rows.mapInArrow(run, "h long, n long, kinds long, doc_id long, code long, s0 long, offset long, bytes binary")


def _windows(data: np.ndarray, offsets: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in the data, context, distance of the start before the anchor) of all windows of the contexts."""
    count = np.diff(offsets) - length + 1
    context = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[context] + step, context, offset[context] - step


def repeated(anchor: np.ndarray, data: np.ndarray, offsets: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, first byte in it) of the windows that another context of the same anchor holds too: radix passes over groups."""
    start, context, before = _windows(data, offsets, offset, length)
    _, number = np.unique(anchor, return_inverse=True)
    group = number[context] * (length + 1) + before
    digit = max(1, length // 4)
    codes = Codes(data).every(digit)
    live = np.arange(len(start))
    for at in [*range(0, length - digit, digit), length - digit]:
        code = codes[start[live] + at]
        order = np.lexsort((code, group))
        g, c = group[order], code[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        size = np.bincount(number, minlength=1)
        many = size[number] > 1 if len(g) else np.zeros(0, bool)
        live, group = live[order][many], number[many]
    return context[live], start[live] - offsets[context[live]]


def _spans(context: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, lo, hi): windows joined to runs of bytes."""
    order = np.lexsort((at, context))
    context, at = context[order], at[order]
    cut = np.flatnonzero((np.diff(context) != 0) | (np.diff(at) > length)) + 1 if len(at) else np.zeros(0, np.int64)
    first, last = np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(at)]]).astype(np.int64) - 1
    if not len(at):
        return at, at, at
    return context[first], at[first], at[last] + length


SPANS = "doc_id long, code long, lo long, hi long"


def _sorted_groups(contexts: DataFrame, length: int, parts: int) -> DataFrame:
    """The repeated spans of contexts of small groups; each group lies in one partition, and memory holds a few groups."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        b = table.combine_chunks().to_batches()[0]
        data, offsets = raw(b.column("bytes"))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        context, at = repeated(b.column("h").to_numpy(), data, offsets, b.column("offset").to_numpy(), length)
        once = b.column("n").to_numpy()[context] == 1  # the others are removed as a whole already
        context, lo, hi = _spans(context[once], at[once], length)
        s0 = b.column("s0").to_numpy()[context]
        rows = pa.array(context)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("code").take(rows), pa.array(s0 + lo), pa.array(s0 + hi)], ["doc_id", "code", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b) * length // 2
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if end:
                yield from solve(t.slice(0, end))
            held = t.slice(end).to_batches()
            size = sum(len(x) for x in held) * length // 2
        if held:
            yield from solve(pa.Table.from_batches(held))

    return contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def _single_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The repeated windows of contexts of large groups, by counting codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                data, offsets = raw(part.column("bytes"))
                data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                start, context, _ = _windows(data, offsets, part.column("offset").to_numpy(), length)
                one = mix(Codes(data).every(length)[start])
                two = mix(Codes(data, _SECOND).every(length)[start])
                rows = pa.array(context)
                at = pa.array(part.column("s0").to_numpy()[context] + start - offsets[context])
                out = [pa.array(signed(one)), pa.array(signed(two)), part.column("n").take(rows), part.column("doc_id").take(rows), part.column("code").take(rows), at]
                yield pa.RecordBatch.from_arrays(out, ["one", "two", "n", "doc_id", "code", "lo"])

    w = contexts.mapInArrow(run, "one long, two long, n long, doc_id long, code long, lo long")
    many = w.groupBy("one", "two").agg(F.count("*").alias("times")).where("times > 1")
    return w.where("n = 1").join(many, ["one", "two"], "left_semi").select("doc_id", "code", "lo", (F.col("lo") + length).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, code, lo, hi): byte spans, overlapping, whose union holds the bytes of all repeated windows. ``docs``: (doc_id, code, text)."""
    found = written(anchors(docs, length, gram), "suffix-anchors")
    kinds = found.groupBy("h", "whole").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "code", "a", "s0", "s1")])
    kinds = written(kinds, "suffix-kinds")
    shared = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("times")).where("times > 1")
    shared = written(kinds.join(shared, "h"), "suffix-shared")
    entire = shared.where("n > 1").select("h", "whole")
    entire = found.join(entire, ["h", "whole"], "left_semi").select("doc_id", "code", F.col("s0").alias("lo"), (F.col("s1") + length).alias("hi"))
    contexts = written(_contexts(docs, shared.where("kinds > 1"), length), "suffix-contexts")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = _sorted_groups(contexts.where(F.col("kinds") <= group), length, parts)
    large = _single_windows(contexts.where(F.col("kinds") > group), length)
    return entire.union(small).union(large)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    kept, at, removed, n = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            kept.append(text[max(end, 0) : lo])
            n += 1
            removed += hi - lo
            end = hi
        elif hi > end:
            removed += hi - end
            end = hi
    kept.append(text[max(end, 0) :])
    return b"".join(kept), removed, n


def deduplicate(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept``, the bytes that are left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("code"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, length, **settings)
    lists = spans.groupBy(F.col("doc_id").alias("id"), F.col("code").alias("c")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(lists, (F.col("code") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for t, s in zip(b.column("text"), b.column("spans"), strict=True):
                body = (t.as_py() or "").encode()
                left, removed, n = cut(body, [(x["lo"], x["hi"]) for x in s.as_py()] if s.is_valid else [])
                for column, value in zip(out, (len(body), removed, n, left), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_radix_suffixes(spark, sf_dir):
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

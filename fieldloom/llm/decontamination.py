"""Benchmark decontamination by template canonicalisation.

Texts become template words: punctuation around words is dropped, ASCII capitals become small, and numbers, names (capitals inside a sentence) and units
after a number become typed placeholders, each with its value as a slot. Windows of five template words are joined by hash with those of the
benchmark; a bitmap of fixed size drops nearly all others before they are shuffled. Matches are grouped by document, item and place
(bands of the difference of positions, overlapping by half), and an item counts as leaked if its windows are covered to at least 0.8
there and its slots are consistent: equal values of the item stand for equal values in the document, so a re-parameterised question is
caught, and a text that merely shares phrases isn't. Of windows that are repeated, those of the best aligned places count.

Template windows need at least three literal words. Exact copies don't depend on templates: an item is cut into literal tiles, lower-cased runs of
five words of which the last two may overlap (one tile of all its words, if it has fewer), and a document in which all tiles stand at one shift holds
the item, whatever its capitals, numbers or length. Items of one or two words have to be the whole text. Items without words are never
matched. Nulls: a null text has no words. Repeated documents are matched each and reported once per id and text; repeated items are reported by id, items without an id are left out. Empty
tables give an empty result; extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unused, written
from .textcode import LOWER, Codes, VALUES, blocks, mix, shingle_codes, signed, words

WINDOW, LITERALS, COVERED = 5, 3, 0.8
#: Share of an item's values that stand for one value each in the document.
CONSISTENT = 0.9
#: Bits of the window bitmap: 2 MB.
BITMAP = 1 << 24
#: Units that may follow a number; fixed values.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec seconds min minutes h hr hours day days week weeks month months year years "
    "km/h mph m/s hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar k c f usd eur gbp dollars euros pounds cents percent "
    "meters metres kilometers kilometres grams kilograms liters litres miles feet inches degrees"
).split()
_NUM, _NAME, _UNIT = (mix(np.array([x], np.uint64))[0] for x in (1, 2, 3))


def _member(text: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(text.encode())] = True
    return out


_DIGIT = _member("0123456789")
_ALNUM = _member("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM[128:] = True
_UPPER = _member("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STOP = _member(".!?:;")


def _unit_codes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    lo, hi, _ = words(data, np.array([0, len(data)]))
    return np.sort(_core_codes(data, lo, hi, True))


def _core_codes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, lower: bool) -> np.ndarray:
    c = Codes(data, VALUES[LOWER] if lower else VALUES)
    return mix(c.of(lo, hi) + (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def template(data: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, slots, row offsets) of the template words; a slot is the value's code, 0 for literal words."""
    codes, slots, _, rows = _canonical(data, offsets, units)
    return codes, slots, rows


def _canonical(data: np.ndarray, offsets: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``template`` with the words' own codes as third, lower-cased."""
    lo, hi, rows = words(data, offsets)
    inner = np.flatnonzero(_ALNUM[data]) if len(data) else np.zeros(0, np.int64)
    if not len(lo) or not len(inner):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    a = inner[np.minimum(np.searchsorted(inner, lo), len(inner) - 1)]
    b = inner[np.maximum(np.searchsorted(inner, hi) - 1, 0)] + 1
    real = (a >= lo) & (a < hi)
    stops = _STOP[data[hi - 1]]
    opens = np.zeros(len(lo), dtype=bool)  # at the start of a sentence
    opens[1:] = stops[:-1]
    opens[rows[:-1][rows[:-1] < len(lo)]] = True
    a, b, opens = a[real], b[real], opens[real]
    rows = np.concatenate([[0], np.cumsum(real)])[rows]
    codes = _core_codes(data, a, b, True)
    value = _core_codes(data, a, b, False)
    first = data[a]
    second = data[np.minimum(a + 1, len(data) - 1)]
    number = _DIGIT[first]
    capital = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    name = capital & ~opens & ~number
    unit = np.zeros(len(codes), dtype=bool)
    unit[1:] = number[:-1]
    unit[rows[:-1][rows[:-1] < len(codes)]] = False
    at = np.minimum(np.searchsorted(units, codes), len(units) - 1)
    unit &= (units[at] == codes) & ~number
    name &= ~unit
    slot = number | name | unit
    kinds = np.where(number, _NUM, np.where(name, _NAME, np.where(unit, _UNIT, codes)))
    return kinds, np.where(slot, value | np.uint64(1), np.uint64(0)), codes, rows


def _windows(codes: np.ndarray, slots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window codes, first words, rows) of the windows that lie in one row and have enough literal words."""
    w = shingle_codes(codes, WINDOW)
    if not len(w):
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(w))
    row = np.searchsorted(rows, at, side="right") - 1
    literal = np.concatenate([[0], np.cumsum(slots == 0)])
    ok = (at + WINDOW <= rows[row + 1]) & (literal[WINDOW:] - literal[:-WINDOW] >= LITERALS)
    return w[ok], at[ok], row[ok]


def _tiles(literal: np.ndarray, rows: np.ndarray, size: int, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first words, rows) of literal runs of ``size`` words: all of them, or those that cover rows from their first word to their
    last. Below ``WINDOW``, a row's tile has all its words; below ``LITERALS``, so has a run that may match one."""
    w = mix(shingle_codes(literal, size), 11)
    if not len(w):
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(w))
    row = np.searchsorted(rows, at, side="right") - 1
    pos, n = at - rows[row], np.diff(rows)[row]
    ok = pos + size <= n
    if size < LITERALS or (size < WINDOW and not every):
        ok &= n == size
    elif not every:
        ok &= (pos % size == 0) | (pos + size == n)
    return w[ok], at[ok], row[ok]


def windows(df: DataFrame, keys: dict[str, str], bitmap: np.ndarray | None = None, sizes: Sequence[int] = range(1, WINDOW + 1)) -> DataFrame:
    """(keys, w, pos, size, slots): the template windows of ``text`` by position in their row, of size 0, and its literal tiles, without slots. With a
    bitmap, the windows and the literal runs of these ``sizes`` that it may hold."""
    names = list(keys)

    def some(w: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if bitmap is None:
            return w, at, row
        bit = w >> np.uint64(40)
        ok = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return w[ok], at[ok], row[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_codes()
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text")):
                codes, slots, literal, rows = _canonical(data, offsets, units)
                part = batch.slice(i, j - i)
                w, at, row = some(*_windows(codes, slots, rows))
                values = signed(slots[at[:, None] + np.arange(WINDOW)]).ravel() if len(w) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, WINDOW, dtype=np.int32)), pa.array(values))
                found = [(0, w, at, row, lists)]
                for size in sizes:
                    w, at, row = some(*_tiles(literal, rows, size, bitmap is not None))
                    found.append((size, w, at, row, pa.nulls(len(w), lists.type)))
                for size, w, at, row, lists in found:
                    if len(w):
                        out = [part.column(k).take(pa.array(row)) for k in names]
                        out += [pa.array(signed(w)), pa.array(at - rows[row]), pa.array(np.full(len(w), size, np.int32)), lists]
                        yield pa.RecordBatch.from_arrays(out, [*names, "w", "pos", "size", "slots"])

    shape = ", ".join(f"{k} {t}" for k, t in keys.items())
    return df.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{shape}, w long, pos long, size int, slots array<long>")


def _bitmap(items: DataFrame) -> np.ndarray:
    """A fixed number of bits, set for the windows of the benchmark."""
    bits = items.select(F.call_function("shiftrightunsigned", F.col("w"), F.lit(40)).alias("bit")).distinct().toPandas()["bit"].to_numpy(dtype=np.int64)
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    np.bitwise_or.at(out, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, code, item_id, coverage, slots, reparameterised): items that a document holds; ``code`` is a hash of its text. An exact copy that
    no template shows has coverage 1 and no slots."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("body"), "text").distinct()
    items = written(windows(items, {"item_id": "long", "body": "long"}), "leak-items")
    sizes = [r[0] for r in items.where("size > 0").select("size").distinct().collect()]  # at most WINDOW
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("code"), "text")
    found = written(windows(keyed, {"doc_id": "long", "code": "long"}, _bitmap(items), sizes), "leak-windows")
    good = _alike(found.where("size = 0"), items.where("size = 0")).union(_exact(found.where("size > 0"), items.where("size > 0")))
    best = F.min("reparameterised")  # if the item itself is there as well, it is that
    return good.groupBy("doc_id", "code", "item_id").agg(F.max("coverage").alias("coverage"), F.max("slots").alias("slots"), best.alias("reparameterised"))


def _exact(found: DataFrame, tiles: DataFrame) -> DataFrame:
    """Items of which all tiles stand in a document at one shift."""
    whole = tiles.groupBy("item_id", "body").agg(F.count("*").alias("tiles"))
    pairs = found.select("doc_id", "code", "w", "pos").join(tiles.select("w", "item_id", "body", F.col("pos").alias("item_pos")), "w")
    hits = pairs.withColumn("shift", F.col("pos") - F.col("item_pos")).groupBy("doc_id", "code", "item_id", "body", "shift").agg(F.countDistinct("item_pos").alias("n"))
    held = hits.join(whole, ["item_id", "body"]).where("n = tiles")
    return held.select("doc_id", "code", "item_id", F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("slots"), F.lit(False).alias("reparameterised"))


def _alike(found: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose template windows and slots agree with a place in a document."""
    sizes = items.groupBy("item_id").agg(F.countDistinct("w").alias("windows"), (F.max("pos") + 1).alias("length"))
    found = found.drop("size")
    pairs = found.join(items.select("w", "item_id", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")), "w").join(sizes, "item_id")
    # A band is as wide as two items; every place lies in the middle half of one.
    pairs = pairs.withColumn("shift", F.col("pos") - F.col("item_pos"))
    band = F.floor(F.col("shift") / F.col("length"))
    pairs = pairs.withColumn("band", F.explode(F.array(band, band + 1)))
    slots = F.filter(F.arrays_zip("item_slots", "slots"), lambda s: s["item_slots"] != 0)
    pairs = pairs.withColumn("pair", F.transform(slots, lambda s: F.struct(s["item_slots"].alias("item"), s["slots"].alias("doc"))))
    place = ["doc_id", "code", "item_id", "band"]
    # A window that the item or the document repeats meets itself at several shifts; each of the item's places keeps the one that most of its
    # windows agree with, of those the one with most values unchanged, then the least.
    hit = F.struct("item_pos", "w", "pair")
    shifts = pairs.groupBy(*place, "shift").agg(F.collect_set(hit).alias("hits"), F.first("windows").alias("windows"))
    same = F.size(F.filter("hits", lambda h: ~F.exists(h["pair"], lambda p: p["item"] != p["doc"])))
    shifts = shifts.withColumn("rank", F.struct(F.size("hits").alias("n"), same.alias("same"), (-F.col("shift")).alias("first")))
    kept = shifts.select(*place, "windows", "rank", F.explode("hits").alias("hit"))
    kept = kept.groupBy(*place, "hit.item_pos").agg(F.max_by("hit", "rank").alias("hit"), F.first("windows").alias("windows"))
    # Bounded by the item's length: distinct windows, and distinct pairs of values.
    covered = kept.groupBy(*place).agg(F.countDistinct("hit.w").alias("covered"), F.first("windows").alias("windows"), F.array_distinct(F.flatten(F.collect_set("hit.pair"))).alias("pairs"))
    coverage = F.col("covered") / F.col("windows")
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    consistent = (values == 0) | (values / F.greatest(F.size("pairs"), F.lit(1)) >= CONSISTENT)
    changed = F.exists("pairs", lambda p: p["item"] != p["doc"])
    return covered.where((coverage >= COVERED) & consistent).select("doc_id", "code", "item_id", F.round(coverage, 6).alias("coverage"), values.cast("long").alias("slots"), changed.alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    p = unused(docs)
    bad = written(leaks(docs, benchmark).select(F.col("doc_id").alias(f"{p}id"), F.col("code").alias(f"{p}code")).distinct(), "leak-docs")
    return docs.join(bad, (F.xxhash64("text") == F.col(f"{p}code")) & F.col("doc_id").eqNullSafe(F.col(f"{p}id")), "left_anti")


def op2_template_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("code")

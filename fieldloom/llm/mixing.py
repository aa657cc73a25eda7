"""Mixing sources to target weights along a curriculum.

Each source has a target number of words and a weight schedule over training time 0..1, piecewise linear. The integral of the schedule,
scaled to the target, is the source's cumulative demand; a document stands at the time at which the demand reaches the words of its source
that precede it. Documents of a source are passed in hash order, as often as the target asks; the last pass stops where the target is
reached. Sorting by position gives the training order.

Cumulative words are two-level sums: within slices of the hash range, and over slices, so a source that holds most rows is spread over as
many tasks as it has slices. Rows that agree in source, id and size are counted first, so repeated rows don't gather in one slice. Source
names, a table of the size of the configuration, are ranked in one window.

Nulls: a null text has size 0, a null source is a source of its own, named last. Documents of size 0 are never taken. An empty table
gives an empty result. Extra columns are ignored by ``plan`` and kept by ``emit``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, n_words, table, unused, written

WEIGHTS = (5, 2, 1)
#: Most passes over a source.
PASSES = 3
#: Knots (time, weight) of each weight class's schedule: even, rising, falling.
SCHEDULES = ([(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)], [(0.0, 1.5), (1.0, 0.5)])
#: Rows of a slice, about.
SLICE_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, kind, target): all words shared by weight, none above ``passes`` times its source.

    Sources sorted by cap per weight are capped up to some point; the level that shares the rest by weight is largest there.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("kind", (F.row_number().over(named) - 1) % len(weights))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), F.col("kind") + 1)
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * passes)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double") / after)
    share = F.max("level").over(everything) * F.col("w")
    return s.select("source", "source_size", "kind", F.least(F.col("cap").cast("double"), share).alias("target"))


def inverse(u: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches the share ``u`` of its whole."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
    out, done = None, 0.0
    pieces = []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        need = u * F.lit(area) - F.lit(done)  # of this piece
        slope = (b - a) / (t1 - t0)
        step = need / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        done += (t1 - t0) * (a + b) / 2
        pieces.append((done / area, F.lit(t0) + step))
    for upto, t in reversed(pieces):
        out = t if out is None else F.when(u <= F.lit(upto), t).otherwise(out)
    return out


def position(u: Column, kind: Column, schedules=SCHEDULES) -> Column:
    out = inverse(u, schedules[-1])
    for k in range(len(schedules) - 2, -1, -1):
        out = F.when(kind == k, inverse(u, schedules[k])).otherwise(out)
    return F.round(out, 6)


def keyed(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, n, h): rows that agree in all three are counted."""
    out = docs.select("source", "doc_id", n_words(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    return out.withColumn("h", hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, schedules=SCHEDULES) -> DataFrame:
    """(source, doc_id, size, n, source_size, target, kind, before, full, rest): ``before``, the words that precede the row in its source;
    ``full`` whole passes, and ``rest`` words of the last one. Row j of the n equal ones follows after j * size words."""
    keys = written(keyed(docs), "mix-keys")
    sources = targets(keys, weights, passes)
    bits = max(0, math.ceil(math.log2(max(1, keys.count()) / SLICE_ROWS)))
    keys = keys.withColumn("slice", F.call_function("shiftright", F.col("h"), F.lit(60 - bits)))
    words = F.sum(F.col("size") * F.col("n"))
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keys.groupBy("source", "slice").agg(words.alias("words"))
    slices = slices.select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("words").over(over), F.lit(0)).alias("start"))
    heads = slices.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    rows = keys.withColumn("inside", F.coalesce(words.over(inside), F.lit(0)))
    out = rows.join(heads, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.select(
        "source", "doc_id", "size", "n", "source_size", "target", "kind", (F.col("start") + F.col("inside")).alias("before"), full.alias("full"),
        (F.col("target") - full * F.col("source_size")).alias("rest"),
    )


def _last_pass(before: Column) -> Column:
    """Whether the last pass takes the document: its middle lies within the rest."""
    return (F.col("size") > 0) & (2 * before + F.col("size") <= 2 * F.col("rest"))


def emit(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, sorted by position. Rows that agree in source, id and size are taken
    alike."""
    p, own = plan(docs, weights, passes, schedules), unused(docs)
    taken = F.when(F.col("size") > 0, F.col("full") + _last_pass(F.col("before")).cast("long")).otherwise(0)
    p = p.withColumn("copies", taken).where("copies > 0")
    p = p.select(*[F.col(c).alias(own + c) for c in p.columns])
    on = F.col("source").eqNullSafe(F.col(f"{own}source")) & F.col("doc_id").eqNullSafe(F.col(f"{own}doc_id")) & (n_words(F.col("text")) == F.col(f"{own}size"))
    rows = docs.join(p, on).withColumn(f"{own}pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{own}copies") - 1)))
    u = (F.col(f"{own}pass") * F.col(f"{own}source_size") + F.col(f"{own}before") + F.col(f"{own}size") / 2) / F.col(f"{own}target")
    at = position(F.least(u, F.lit(1.0)), F.col(f"{own}kind"), schedules)
    return rows.withColumn(f"{own}at", at).orderBy(f"{own}at", "doc_id").select(*docs.columns)


def op9_curriculum_mix(spark, sf_dir):
    """doc_id, size, source_size, target, taken, and first_position, the training time at which the document first comes (null: never)."""
    p = plan(table(spark, sf_dir, "documents")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    p = p.withColumn("before", F.col("before") + F.col("j") * F.col("size"))
    taken = F.col("size") * (F.col("full") + _last_pass(F.col("before")).cast("long"))
    p = p.withColumn("taken", taken.cast("long"))
    u = (F.col("before") + F.col("size") / 2) / F.col("target")
    p = p.withColumn("first_position", F.when(F.col("taken") > 0, position(F.least(u, F.lit(1.0)), F.col("kind"))))
    return p.select("doc_id", "size", "source_size", "target", "taken", "first_position").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def _inverse_sql(u: str, knots: list[tuple[float, float]]) -> str:
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
    done, out = 0.0, "case"
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        need, slope = f"({u} * {area}::double - {done}::double)", (b - a) / (t1 - t0)
        step = f"{need} / {a}::double" if slope == 0 else f"(sqrt(greatest({a * a}::double + {2 * slope}::double * {need}, 0)) - {a}::double) / {slope}::double"
        done += (t1 - t0) * (a + b) / 2
        out += f" when {u} <= {done / area}::double then {t0}::double + {step}"
    return out + " end"


def oracle() -> str:
    at = "case kind " + " ".join(f"when {k} then {_inverse_sql('u', s)}" for k, s in enumerate(SCHEDULES)) + " end"
    return f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         cast('0x' || md5(coalesce(cast(doc_id as varchar), ''))[1:15] as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 as int) as kind from s),
w as (select *, case kind when 0 then 5 when 1 then 2 else 1 end as w, 3 * source_size as cap from r),
l as (select *, cast((select sum(source_size) from s)
                     - coalesce(sum(cap) over (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as double)
                / cast(sum(w) over (order by cap::double / w, source nulls last rows between current row and unbounded following) as double) as lev
      from w),
t as (select *, least(cap::double, (select max(lev) from l) * w) as target from l),
c as (select d.doc_id, d.size, t.source_size, t.target, t.kind,
             case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end as full_passes,
             cast(coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id nulls first, d.size
                                             rows between unbounded preceding and 1 preceding), 0) as bigint) as b
      from d join t on d.source is not distinct from t.source),
k as (select *, size * (full_passes + case when size > 0 and 2 * b + size <= 2 * (target - full_passes * source_size) then 1 else 0 end) as taken,
             least((b + size / 2) / target, 1.0) as u from c)
select doc_id, size, source_size, target, cast(taken as bigint) as taken, case when taken > 0 then round({at}, 6) end as first_position from k
"""

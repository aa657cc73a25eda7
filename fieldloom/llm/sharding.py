"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit row hash. A bucket, the rows that share a prefix, is split on its next bit
only while its bytes exceed the limit, so a shard is the shortest prefix whose bucket fits. Bytes are summed once for cells of
a fixed depth; the sums of all coarser prefixes follow from the cells, and only rows of cells that are still too large are counted again,
some bits deeper.

Rows whose hashes are equal can't be told apart by further bits: a bucket of one hash value stops splitting, and if several rows of it
exceed the limit together, they go to numbered pages of that bucket (the overflow chain of extendible hashing), each within the limit.
A single row above the limit is a shard of its own.

Nulls: a null id, text or size counts as empty (size 0). Repeated rows are kept, each in its place. An empty table gives an empty result.
Extra columns pass through; the columns ``shard``, ``depth``, ``page`` and ``shard_bytes`` replace input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, table, unused, written

HASH_BITS = 60
#: Bytes of a shard, as in common sharded training formats.
SHARD_BYTES = 64 << 20
#: Further bits for each look at cells that are still too large.
DEEPER = 8
OUT = ["shard", "depth", "page", "shard_bytes"]


def row_hash(doc_id: Column, text: Column) -> Column:
    return hash60(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def _prefix(h: Column, depth: int | Column) -> Column:
    return F.call_function("shiftright", h, F.lit(HASH_BITS) - (F.lit(depth) if isinstance(depth, int) else depth))


def _directory(keys: DataFrame, known: int, bits: int, limit: int) -> DataFrame:
    """For each cell of ``bits`` bits the depth of its shard, null if even the cell is too large; prefixes up to ``known`` bits are too large."""
    cells = keys.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    depth = F.explode(F.sequence(F.lit(known), F.lit(bits))).alias("depth")
    sums = (
        cells.select("*", depth)
        .groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth")).alias("prefix"))
        .agg(F.sum("b").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
        .select("depth", "prefix", "bytes")
    )
    up = cells.select("cell", depth).withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth")))
    first = up.join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    found = first.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth"))).join(sums, ["depth", "prefix"])
    return cells.select("cell").join(found.select("cell", "depth", "bytes"), "cell", "left")


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """(bits, cell, depth, bytes): the shard's depth for every cell of ``bits`` bits. ``keys``: a stored table of (h, n_bytes)."""
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    known, bits = 0, min(HASH_BITS, 3 + math.ceil(math.log2(max(1.0, total / limit))))
    found, rest = [], keys
    while True:
        cells = written(_directory(rest, known, bits, limit), "shard-cells")
        found.append(cells.where("depth is not null").select(F.lit(bits).alias("bits"), "cell", "depth", "bytes"))
        open_cells = cells.where("depth is null").select("cell")
        if bits == HASH_BITS or open_cells.isEmpty():
            break
        rest = rest.join(open_cells, _prefix(F.col("h"), bits) == F.col("cell"), "left_semi")
        known, bits = bits + 1, min(HASH_BITS, bits + DEEPER)
    out = found[0]
    for d in found[1:]:
        out = out.union(d)
    return out


def assign(df: DataFrame, h: Column, n_bytes: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """``df`` with ``shard`` (the prefix as a bit string, with a page number where rows of one hash overflow), ``depth``, ``page`` and
    ``shard_bytes`` (of the bucket)."""
    df = df.drop(*OUT)
    own = unused(df)
    keys = written(df.select(h.alias("h"), F.coalesce(n_bytes, F.lit(0)).cast("long").alias("n_bytes")), "shard-keys")
    cells = directory(keys, limit)
    depths = [r[0] for r in cells.select("bits").distinct().collect()]  # at most eight
    crowded = (
        keys.groupBy("h", "n_bytes").agg(F.count("*").alias("rows"))
        .where("rows > 1")
        .groupBy("h").agg(F.sum(F.col("rows") * F.col("n_bytes")).alias("of_hash"))
        .where(F.col("of_hash") > limit)
    )
    hashed = df.withColumn(f"{own}h", h).withColumn(f"{own}n", F.coalesce(n_bytes, F.lit(0)).cast("long"))
    out = None
    for bits in sorted(depths):
        part = cells.where(F.col("bits") == bits).select(F.col("cell").alias(f"{own}cell"), F.col("depth").alias(f"{own}depth"), F.col("bytes").alias(f"{own}bytes"))
        part = hashed.join(part, _prefix(F.col(f"{own}h"), bits) == F.col(f"{own}cell"))
        out = part if out is None else out.unionByName(part)
    if out is None:  # an empty table
        out = hashed.withColumns({f"{own}cell": F.lit(0).cast("long"), f"{own}depth": F.lit(0), f"{own}bytes": F.lit(0).cast("long")})
    out = out.withColumn(f"{own}page", F.lit(0).cast("long")) if crowded.isEmpty() else _paged(out, crowded, limit, own)
    bits = F.when(F.col(f"{own}depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix(F.col(f"{own}h"), F.col(f"{own}depth"))), F.col(f"{own}depth"), "0"))
    shard = F.when(F.col(f"{own}page") == 0, bits).otherwise(F.concat(bits, F.lit("."), F.col(f"{own}page").cast("string")))
    out = out.withColumns({"shard": shard, "depth": F.col(f"{own}depth").cast("int"), "page": F.col(f"{own}page"), "shard_bytes": F.col(f"{own}bytes")})
    return out.select(*df.columns, *OUT)


def _paged(out: DataFrame, crowded: DataFrame, limit: int, own: str) -> DataFrame:
    """Rows of an overflowing hash by pages. Equal rows are interchangeable, so they are counted and written out again page by page;
    no window has to hold them. Rows of one hash that differ don't share pages: their page numbers start with a rank among them."""
    same = out.columns
    crowded = crowded.select(F.col("h").alias(f"{own}of"))
    alone = out.join(crowded, F.col(f"{own}h") == F.col(f"{own}of"), "left_anti").withColumn(f"{own}page", F.lit(0).cast("long"))
    groups = out.join(crowded, F.col(f"{own}h") == F.col(f"{own}of"), "left_semi").groupBy(*same).agg(F.count("*").alias(f"{own}rows"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col(f"{own}n"), F.lit(1)))).cast("long")
    groups = groups.withColumn(f"{own}rank", F.row_number().over(Window.partitionBy(f"{own}h").orderBy(*same)) - 1).withColumn(f"{own}room", room)
    pages = groups.withColumn(f"{own}p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(f"{own}rows") - 1) / F.col(f"{own}room")).cast("long"))))
    copies = F.least(F.col(f"{own}room"), F.col(f"{own}rows") - F.col(f"{own}p") * F.col(f"{own}room"))
    pages = pages.withColumn(f"{own}page", F.col(f"{own}rank") * (1 << 32) + F.col(f"{own}p")).repartition(f"{own}h", f"{own}page")
    return alone.unionByName(pages.withColumn(f"{own}c", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*same, f"{own}page"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes the assigned rows as Parquet, a folder for each shard; rows of one shard meet in one task."""
    df.repartition("shard").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return assign(docs, row_hash(F.col("doc_id"), F.col("text")), F.octet_length(text), limit)


def op1_extendible_shards(spark, sf_dir):
    """Every document's shard: doc_id, n_bytes, shard, depth, shard_bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), "shard", "depth", "shard_bytes")


def oracle(limit: int = SHARD_BYTES) -> str:
    return f"""
with k as (
  select doc_id, strlen(coalesce(text, '')) as n_bytes,
         cast('0x' || md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, ''))[1:15] as bigint) as h
  from documents),
b as (select d.depth, h >> ({HASH_BITS} - d.depth) as prefix, cast(sum(n_bytes) as bigint) as bytes, min(h) as lo, max(h) as hi
      from k, range(0, {HASH_BITS + 1}) d(depth) group by all),
f as (select * from b where bytes <= {limit} or lo = hi),
m as (select k.doc_id, k.n_bytes, k.h, min(f.depth) as depth
      from k join f on f.prefix = k.h >> ({HASH_BITS} - f.depth) group by all)
select m.doc_id, m.n_bytes, case when m.depth = 0 then '' else lpad(bin(f.prefix), cast(m.depth as int), '0') end as shard,
       cast(m.depth as int) as depth, f.bytes as shard_bytes
from m join f on f.depth = m.depth and f.prefix = m.h >> ({HASH_BITS} - m.depth)
"""

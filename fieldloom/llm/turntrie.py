"""A prefix trie over conversations by truncation peeling.

A node is a distinct sequence of first turns. The trie is found from its deepest level upward: at each depth the conversations that end there
join the nodes which survive from the depth below, equal sequences merge by one aggregation, and each merged node is emitted complete
(members, children, leaves, saved characters, all sums over what was merged) and goes on without its last turn. A depth is one job; its
nodes are written, and the next job continues from there, so a lost executor costs one job at most.

A turn enters as a code (16 bytes of its SHA-256) and its length, and a sequence as the 16-byte codes of all its prefixes, so no text is
shuffled. Below the depth where a conversation has parted from all others its nodes have one member each. One count of the prefix codes
finds that depth, and the conversation starts peeling there: its own tail needs no regrouping and is emitted as it is. So the number of
jobs is the greatest depth that two conversations share.

Hot groups: merging is by sums and minima, which combine before the shuffle. The ids that end at a node are joined to strings of at most
2^``CHUNK`` ids first; a SHA-256 can only be computed in order, so one task streams the strings of a node through it, one at a time.
The join of children with their parents is an equi-join whose crowded parents adaptive execution splits.

Rows without a conv_id belong to no conversation and are left out. Null roles and texts are empty, null turns come first, and turns of equal
number are ordered by their code, so a repeated row is a repeated turn. An empty table has no nodes, not even a root. Further columns are
ignored, whatever their names. A conversation's codes and lengths (some 40 bytes a turn) have to fit into a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..session import shared_folder
from .common import table, written

#: Bytes of a code.
CODE = 16
#: A string of ended ids covers 2^CHUNK numbers.
CHUNK = 12
#: Conversations of one hundred share the opening of its first.
FAMILY, OPENINGS = 100, 6


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, code, n)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, CODE)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"), F.length(text).cast("long").alias("n"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code", "n"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation that opens the family, then the conversation's own after its first h."""
    own = turns(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % OPENINGS).cast("int"))
    own = own.withColumn("opens", F.col("conv_id") - F.col("conv_id") % FAMILY)
    first = own.where(F.col("conv_id") == F.col("opens")).select(F.col("opens").alias("o"), F.slice("turns", 1, OPENINGS - 1).alias("first"))
    both = own.join(first, F.col("opens") == F.col("o"), "left")
    opening = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(opening, rest).alias("turns"))


@F.pandas_udf(BinaryType())
def _codes(of: pd.Series) -> pd.Series:
    """The codes of all prefixes, one after the other: each is a hash of the turn codes so far."""

    def chain(codes) -> bytes:
        h, out = hashlib.sha256(), []
        for c in codes:
            h.update(c)
            out.append(h.copy().digest()[:CODE])
        return b"".join(out)

    return of.map(chain)


def _cut(prefix: str, depth: Column | int) -> Column:
    """The first ``depth`` codes."""
    return F.substring(prefix, F.lit(1), F.lit(CODE) * depth)


def _code(prefix: str, depth: Column | int) -> Column:
    """The code at ``depth``; the root's is empty."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(d > 0, F.substring(prefix, F.lit(CODE) * (d - 1) + 1, F.lit(CODE))).otherwise(F.lit(b""))


def parted(sequences: DataFrame) -> DataFrame:
    """``sequences`` (conv_id, codes, lens, depth) with ``shared``, the greatest depth at which another conversation has the same prefix."""
    prefixes = sequences.select("conv_id", "codes", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"))
    counted = prefixes.where("d > 0").groupBy(_code("codes", F.col("d")).alias("code")).agg(F.count("*").alias("k"), F.min("conv_id").alias("c"), F.min("d").alias("d"))
    alone = counted.where("k = 1").groupBy("c").agg(F.min("d").alias("first"))
    both = sequences.join(alone, F.col("conv_id") == F.col("c"), "left")
    return both.select("conv_id", "codes", "lens", "depth", F.coalesce(F.col("first") - 1, F.col("depth")).alias("shared"))


def _regroup(rows: DataFrame) -> DataFrame:
    """Equal sequences merged. ``lens`` follows from ``prefix`` and is a key only to be carried along."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = rows.groupBy("prefix", "lens").agg(F.min("conv_id").alias("conv_id"), *sums)
    last = F.coalesce(F.get("lens", F.size("lens") - 1), F.lit(0))
    return merged.select(
        "prefix", "lens", "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved"),
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` as children: without their last turn."""
    one = F.lit(1).cast("long").alias("n_children")
    return nodes.select(_cut("prefix", depth - 1).alias("prefix"), F.slice("lens", 1, depth - 1).alias("lens"), "conv_id", "n_convs", one, "n_leaves", "saved")


def _peel(entering: DataFrame, deepest: int) -> DataFrame:
    """All shared nodes: code, parent (its code), depth, conv_id, n_convs, n_children, n_leaves, saved."""
    spark = entering.sparkSession
    one, own = F.lit(1).cast("long"), (F.col("depth") > F.col("shared")).cast("long")  # own: a tail hangs below
    starts = entering.select("shared", F.col("codes").alias("prefix"), "lens", "conv_id", one.alias("n_convs"), own.alias("n_children"), own.alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
    paths, survivors = [], None
    for d in range(deepest, -1, -1):
        rows = starts.where(F.col("shared") == d).drop("shared")
        nodes = _regroup(rows if survivors is None else rows.unionByName(survivors))
        nodes = nodes.withColumn("depth", F.lit(d).cast("long"))
        paths.append(shared_folder(spark, f"trie-{d}"))
        nodes.write.parquet(paths[-1])
        survivors = _stripped(spark.read.schema(nodes.schema).parquet(paths[-1]), d)
    found = spark.read.schema(nodes.schema).parquet(*paths)
    parent = F.when(F.col("depth") > 0, _code("prefix", F.col("depth") - 1))
    return found.select(_code("prefix", F.col("depth")).alias("code"), parent.alias("parent"), "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each code's strings, joined by commas; they come sorted, and one is held at a time."""
    code, h = None, None
    send = lambda: pa.record_batch([pa.array([code], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["code", "sha"])
    for batch in batches:
        for c, text in zip(batch["code"], batch["ids"], strict=True):
            if c.as_py() != code:
                if h is not None:
                    yield send()
                code, h = c.as_py(), hashlib.sha256(text.as_py().encode())
            else:
                h.update(b"," + text.as_py().encode())
    if h is not None:
        yield send()


def ends(ended: DataFrame) -> DataFrame:
    """``ended`` (code, conv_id) as (code, sha): the digest of each code's ids, ascending, joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = ended.groupBy("code", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(ids.alias("ids"))
    return strings.repartition("code").sortWithinPartitions("code", "chunk").select("code", "ids").mapInArrow(_digests, "code binary, sha string")


def trie(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and code for each node of
    ``sequences`` (conv_id, turns), where conv_id is unique and turns are in order."""
    shape = sequences.select("conv_id", F.col("turns.code").alias("c"), F.col("turns.n").alias("lens"), F.size("turns").alias("depth"))
    stored = written(shape.select("conv_id", _codes("c").alias("codes"), "lens", "depth"), "trie-sequences")
    path = shared_folder(stored.sparkSession, "trie-parted")
    found = parted(stored)
    found.hint("rebalance", "shared").write.partitionBy("shared").parquet(path)
    found = stored.sparkSession.read.schema(found.schema).parquet(path)
    deepest = found.agg(F.max("shared")).first()[0]  # over the names of the folders
    shared = F.col("shared")
    cut = found.select("conv_id", _cut("codes", shared).alias("codes"), F.slice("lens", F.lit(1), shared).alias("lens"), "depth", "shared")
    nodes = _peel(cut, deepest or 0)
    long = lambda v: F.lit(v).cast("long")
    tails = found.where("depth > shared").withColumn("d", F.explode(F.sequence(shared + 1, F.col("depth"))))
    last = F.col("d") == F.col("depth")
    tails = tails.select(
        _code("codes", F.col("d")).alias("code"), F.when(F.col("d") == shared + 1, _code("codes", shared)).alias("parent"), F.col("d").cast("long").alias("depth"), "conv_id", long(1).alias("n_convs"),
        (~last).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved"), F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("sha"),
    )
    ended = ends(found.where("depth = shared").select(_code("codes", shared).alias("code"), "conv_id"))
    named = nodes.join(ended.withColumnRenamed("code", "e"), F.col("code") == F.col("e"), "left").drop("e")
    named = named.withColumn("sha", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    parents = nodes.select(F.col("code").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    hung = named.where("depth > 0").unionByName(tails.where(F.col("parent").isNotNull()))
    whole = hung.join(parents, F.col("parent") == F.col("p")).drop("p")
    whole = whole.unionByName(tails.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.col("conv_id")))
    whole = whole.unionByName(named.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"), "code")


def op13_turn_trie(spark, sf_dir):
    return trie(rebuilt(table(spark, sf_dir, "conversations"))).drop("code")


def oracle() -> str:
    return f"""
with ids as (select distinct conv_id from conversations where conv_id is not null),
b as (select conv_id, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) as crc from ids),
c as (select conv_id, xor(crc, 4294967295) % {OPENINGS} as h, conv_id - conv_id % {FAMILY} as opens from b),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as code, length(coalesce(text, '')) as n from conversations where conv_id is not null),
r as (select c.conv_id, t.pos, t.code, t.n from c join t on t.conv_id = c.opens where t.pos <= c.h
      union all select c.conv_id, t.pos, t.code, t.n from c join t on t.conv_id = c.conv_id where t.pos > c.h),
q as (select conv_id, row_number() over o as d, string_agg(code, '') over o as k, n from r window o as (partition by conv_id order by pos)),
p as (select conv_id, d, md5(k) as k, n from q union all select conv_id, 0, '', 0 from ids),
o as (select *, min(conv_id) over (partition by k) as owner, lag(k) over (partition by conv_id order by d) as parent, lead(d) over (partition by conv_id order by d) is null as ended from p),
f as (select *, not exists (select 1 from o x where x.parent = o.k) as leaf from o),
s as (select *, sum(case when owner = conv_id then 0 else n end) over u as saved, sum(case when owner = conv_id and leaf then 1 else 0 end) over u as leaves
      from f window u as (partition by conv_id order by d desc)),
nodes as (select k, parent, min(conv_id) as conv_id, min(d) as depth, count(*) as n_convs, sum(leaves) as n_leaves, sum(saved) as saved,
        string_agg(case when ended then conv_id::varchar end, ',' order by conv_id) as ends from s group by k, parent),
n as (select parent, count(*) as n_children from nodes group by parent)
select a.conv_id, cast(a.depth as bigint) as depth, b.conv_id as parent_conv_id, a.n_convs, coalesce(n.n_children, 0) as n_children, cast(a.n_leaves as bigint) as n_leaves,
  cast(a.saved as bigint) as saved_tokens, sha256(coalesce(a.ends, '')) as ends_sha256
from nodes a left join nodes b on a.parent = b.k left join n on n.parent = a.k
"""

"""The conversation trie against a plain version, with copies, truncations, deep chains and every odd row."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import turntrie

SHAPE = "conv_id long, turn long, role string, text string, code string, depth string, shared int, k int"


def plain(rows):
    """The contract, by walking all prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        opens = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(opens, [])[:h] + ts[h:])
    members = collections.defaultdict(set)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, who in members.items():
        over = ",".join(str(c) for c in sorted(c for c in who if whole[c] == n))
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n], hashlib.sha256(over.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, texts = [], ["a", "b", "", None, "çé𝄞", "some longer text", "a b"]
    for c in [*range(0, 60), *range(97, 130), 205, 206, -3, -100, -101, 10**12 + 7, 10**12]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        out += [(c, t, rng.choice(["user", "user", None]), rng.choice(texts[: rng.choice([1, 2, 7])])) for t in range(n)]
    chain = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(12)]
    for c, n in [(300, 12), (301, 12), (302, 9), (303, 11), (304, 12), (400, 4), (407, 12)]:  # copies and truncations of one chain
        out += [(c, t, *chain[t]) for t in range(n)]
    out += [(500, 3, "x", "late"), (500, None, "x", "first"), (500, 3, "y", "tie"), (500, 3, "x", "late"), (None, 0, "x", "y"), (None, None, None, None)]
    rng.shuffle(out)
    return [(*r, "mine", "mine", 1, 2) for r in out]


def nodes(df):
    return sorted((tuple(r) for r in df.drop("code").collect()), key=repr)


def test_nodes_are_those_of_a_plain_version(spark, rows):
    got = turntrie.trie(turntrie.rebuilt(spark.createDataFrame(rows, SHAPE).repartition(3)))
    assert nodes(got) == plain(rows)


def test_ended_ids_of_many_strings(spark, rows, monkeypatch):
    monkeypatch.setattr(turntrie, "CHUNK", 1)
    same = [(c, t, "user", f"{t}", *r) for c in (*range(600, 640), -7, 10**13) for t in range(2) for r in [("mine", "mine", 1, 2)]]
    assert nodes(turntrie.trie(turntrie.rebuilt(spark.createDataFrame(same, SHAPE)))) == plain(same)


def test_one_conversation_and_none(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    alone = [r for r in rows if r[0] == 300]
    assert nodes(turntrie.trie(turntrie.rebuilt(docs.where("conv_id = 300")))) == plain(alone)
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    turnless = [(c, 0, "user", "gone", "", "", 1, 1)]  # its opener is absent and its own turns are all replaced
    assert nodes(turntrie.trie(turntrie.rebuilt(spark.createDataFrame(turnless, SHAPE)))) == plain(turnless)
    assert nodes(turntrie.trie(turntrie.rebuilt(docs.where(F.lit(False))))) == []

"""The threshold table against a plain version, on small texts with every odd case in them."""

import collections
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import rules

SHAPE = "doc_id long, text string, n_words long, kept string, failed long, r int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = "the of and to in is that ba ku lorem dolor ipsum".split()
    prose = lambda n, of=some: " ".join(rng.choice(of) + rng.choice(["", "", "x", "yy", "zed", "qu", "om"]) for _ in range(n))
    line = prose(12)
    texts = ["", None, "   \n\t", "one", "one two", "a b c", "a b c a b c", "a a a a a", "a a a a b a a a", "x y x y x y", "\x0b\x0c a\rb", "word\n" * 80, "Ünï çödé 𝄞 ☃ \x00"]
    texts += [prose(n) for n in (49, 50, 51, 400, 5000)] + ["\n".join(prose(9) for _ in range(20)), "\n".join([line] * 9 + [prose(8) for _ in range(9)])]
    texts += ["\n".join(f"- {prose(8)}" for _ in range(12)), "\n".join(f"{prose(8)} ... " for _ in range(12)), prose(70) + " &&& ### $$$ |", " ".join(f"{w}###" for w in prose(60).split())]
    texts += [prose(60, ["zz", "kk"]), prose(60, some[:4]) + " 12" * 30, " ".join(["aa bb cc"] * 500 + [prose(3000)]), "x" * 30000, prose(3) + "\n\n" + prose(60) + "\r\n" + prose(4) + "\r\n"]
    out = [(i, t, 5, "mine", 7, 1) for i, t in enumerate(texts)]
    return out + [(None, texts[15], None, None, None, None), out[3], out[3]]


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}),
        "n_stop_words": sum(w in rules.STOP_WORDS for w in words),
        "n_other_words": sum(not any(unicodedata.category(c)[0] == "L" for c in w) for w in words),
        "n_bullets": sum(x.lstrip(" \t")[:1] in tuple("-*•‣◦") for x in lines),
        "n_ellipses": sum(x.rstrip("\x20\t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines),
    }


def breaks(c, r):
    part, whole = (c[r.part], 1) if r.whole is None else (100 * c[r.part], c[r.whole])
    return (r.least is not None and part < r.least * whole) or (r.most is not None and part > r.most * whole)


def test_counts_and_verdicts_are_those_of_a_plain_version(spark, rows):
    got = {}
    for r in rules.assess(spark.createDataFrame(rows, SHAPE).repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(r.asDict())
    for k, text, *_ in rows:
        c = plain(text)
        base = [r.name for r in rules.BASE if breaks(c, r)]
        failed = base + [r.name for r in rules.RULES if breaks(c, r)]
        want = {"doc_id": k, **c, "base_failed": bool(base), "failed": failed, "kept": not failed}
        assert all(g == want for g in got[k]), (text, want)
    assert len(got[3]) == 3


def test_keep_returns_the_rows_as_they_are(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    kept = rules.keep(docs)
    want = [r for r in rows if not any(breaks(plain(r[1]), x) for x in rules.BASE + rules.RULES)]
    assert want and kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    assert rules.keep(docs.where(F.lit(False))).count() == 0 and rules.assess(docs.where(F.lit(False))).count() == 0


def test_thresholds_may_come_from_a_table_or_be_none(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    held = spark.createDataFrame(list(rules.RULES), "name string, part string, whole string, least int, most int")
    by_name = sorted(rules.RULES)
    assert list(rules.from_table(held)) == by_name
    one = rules.assess(docs, rules.from_table(held)).select("doc_id", "kept").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, rules.assess(docs).select("doc_id", "kept").collect()))
    assert rules.keep(docs, (), ()).count() == len(rows)


def test_one_projection_without_python_or_shuffle(spark, rows):
    plan = rules.assess(spark.createDataFrame(rows, SHAPE))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Pandas", "Arrow", "Generate", "Aggregate"))

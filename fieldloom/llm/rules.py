"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule bounds one count, or one count as a percentage of another, from below, from above or both ways; bounds belong to the allowed range.
``compiled`` turns a table of rules into one expression over the text: the words and lines are taken once, each count is written once,
integer comparisons of ``100 * part`` with ``bound * whole`` give the verdict, and the rules that a text breaks come with it. A
table of rules may also be a small DataFrame (``from_table``), so that thresholds can be kept with the data. Nothing is shuffled, and no
user function runs.

The counts: ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``SYMBOLS``), ``n_lines`` (lines with a word),
``n_dup_lines`` (those equal to an earlier line), ``n_repeat_words`` (words inside windows of three words that the text holds twice or more),
``n_stop_words`` (words of ``STOP_WORDS``), ``n_other_words`` (words without a letter), ``n_bullets`` (lines that open with a list mark)
and ``n_ellipses`` (lines that end in an ellipsis). All cover the whole text.

A null text counts as empty: every count is 0, and a share of nothing passes any bound but the least number of words. Rows are judged one
by one, so ties and repeated rows have no effect on each other; an empty table gives an empty result. ``assess`` ignores further
columns, whatever their names; ``keep`` returns the rows as they are, and adds no column on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_other_words", "n_bullets", "n_ellipses")
#: Characters that prose has few of.
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW = 3
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for was on are as at by from this or an not but "
    "der die das und zu den mit von ist nicht ein eine auf für im dem "
    "le la les de et des un une que est dans pour en du qui sur "
    "el los las y por con para del se al es lo como"
).split()


class Rule(NamedTuple):
    """``part`` within [least, most], or with ``whole`` ``100 * part / whole`` within [least, most]; None leaves a side open."""

    name: str
    part: str
    whole: str | None
    least: int | None
    most: int | None


#: Texts that break one of these are no prose at all.
BASE = (
    Rule("few words", "n_words", None, 50, None),
    Rule("repeated words", "n_repeat_words", "n_words", None, 50),
)
#: The further thresholds.
RULES = (
    Rule("many words", "n_words", None, None, 1_000_000),
    Rule("word length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop words", "n_stop_words", "n_words", 2, None),
    Rule("words without letters", "n_other_words", "n_words", None, 20),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 30),
    Rule("list marks", "n_bullets", "n_lines", None, 90),
    Rule("ellipses", "n_ellipses", "n_lines", None, 30),
)


def from_table(rules: DataFrame) -> tuple[Rule, ...]:
    """Rules held in a table (name, part, whole, least, most). It is read to the driver; a table of thresholds has some dozens of rows."""
    return tuple(Rule(*r) for r in rules.select("name", "part", "whole", F.col("least").cast("long"), F.col("most").cast("long")).orderBy("name").collect())


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), of)[0]


def _repeated(words: Column) -> Column:
    """Words inside repeated windows. Sorted windows put equal ones side by side; the starts of those, sorted, give the covered words."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    windows = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        beside = lambda s: lambda x, k: F.when((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), x["i"])
        twice = _let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), lambda s: F.sort_array(F.array_compact(F.transform(s, beside(s)))))
        new = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(_let(twice, new), F.lit(0), lambda a, x: a + x)

    some = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(some)


def counts(text: Column) -> Column:
    """A struct of ``COUNTS``, all long."""
    t = F.coalesce(text, F.lit(""))
    spoken = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def of(b: Column) -> Column:
        words, lines = b["words"], b["lines"]
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated(words),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_other_words": F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))),
            "n_bullets": F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*•‣◦]"))),
            "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))),
        }
        return F.struct(*[found[c].cast("long").alias(c) for c in COUNTS])

    lines = F.filter(F.split(t, "\n", -1), spoken)
    return _let(F.struct(F.regexp_extract_all(t, F.lit(WORD), 0).alias("words"), lines.alias("lines")), of)


def broken(of: Column, rule: Rule) -> Column:
    """Whether the counts ``of`` break ``rule``."""
    part, whole = (of[rule.part], F.lit(1)) if rule.whole is None else (of[rule.part] * 100, of[rule.whole])
    sides = [part < whole * bound if low else part > whole * bound for bound, low in ((rule.least, True), (rule.most, False)) if bound is not None]
    return sides[0] if len(sides) == 1 else sides[0] | sides[1] if sides else F.lit(False)


def compiled(text: Column, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> Column:
    """A struct of ``COUNTS``, base_failed, failed (the names of the broken rules, in the table's order) and kept."""

    def of(c: Column) -> Column:
        names = lambda some: F.array_compact(F.array(*[F.when(broken(c, r), F.lit(r.name)) for r in some])) if some else F.array().cast("array<string>")
        verdict = lambda n: F.struct(*[c[k].alias(k) for k in COUNTS], (F.size(n[0]) > 0).alias("base_failed"), F.concat(n[0], n[1]).alias("failed"), (F.size(n[0]) + F.size(n[1]) == 0).alias("kept"))
        return _let(F.array(names(base), names(rules)), verdict)

    return _let(counts(text), of)


def assess(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, failed and kept for every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), compiled(F.col(text), rules, base).alias("r")).select("doc_id", "r.*")


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule."""
    return docs.where(compiled(F.col(text), rules, base)["kept"])


def op11_rule_table(spark, sf_dir):
    """Every document's counts, the rules that it breaks (joined by commas), base_failed and kept."""
    out = assess(table(spark, sf_dir, "documents"))
    return out.withColumn("failed", F.array_join("failed", ", "))


def _broken_sql(rule: Rule) -> str:
    part, whole = (rule.part, "1") if rule.whole is None else (f"100 * {rule.part}", rule.whole)
    sides = [f"{part} {sign} {bound} * {whole}" for bound, sign in ((rule.least, "<"), (rule.most, ">")) if bound is not None]
    return "(" + " or ".join(sides or ["false"]) + ")"


def oracle() -> str:
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    names = lambda rules: "concat_ws(', ', " + ", ".join(f"case when {_broken_sql(r)} then '{r.name}' end" for r in rules) + ")"
    either = lambda rules: " or ".join(_broken_sql(r) for r in rules)
    return f"""
with t as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, regexp_extract_all(text, '{word}+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from t),
e as (select k, unnest(words) as w, unnest(range(len(words))) as i from w),
g as (select k, i, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from e window o as (partition by k order by i)),
d as (select k, i, count(*) over (partition by k, w, w1, w2) > 1 as twice from g where w2 is not null),
c as (select distinct k, i + s.s as i from d, (values (0), (1), (2)) s(s) where twice),
r as (select k, count(*) as n from c group by k),
m as (select t.doc_id, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '{space}', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
  cast(len(list_filter(words, lambda x: x in ({stops}))) as bigint) as n_stop_words,
  cast(len(list_filter(words, lambda x: not regexp_matches(x, '\\p{{L}}'))) as bigint) as n_other_words,
  cast(len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•‣◦]'))) as bigint) as n_bullets,
  cast(len(list_filter(lines, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…){space}*$'))) as bigint) as n_ellipses
  from t join w on t.k = w.k left join r on t.k = r.k)
select *, ({either(BASE)}) as base_failed, {names(BASE + RULES)} as failed, not ({either(BASE + RULES)}) as kept from m
"""

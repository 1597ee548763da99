"""Quality rules in a short-circuit cascade (operator 7), without Python on the executors.

`signals` gives the counts that the result reports; `RULES` name a rejecting condition each, on these counts or on the text
itself. `order_rules` measures, on a sample spread over the whole table, how much each rule costs beyond a pass that looks at
nothing (the least of REPEATS runs) and how much it rejects, and puts the rules with the most rejection per cost first. `apply`
evaluates them in that order, and a text that the base rule or an earlier rule rejects is not looked at by later ones. The
order decides the cost and the reported `rejected_by`, never the verdict: a text is kept if no rule rejects it.

Null and empty texts have no words, so the base rule (fewer than 50 words) rejects them. Repeated rows each give a row, rows
with a null id too; an empty table gives none, and its rules are in order of name. Rules worth the same are in order of name.
Extra columns are not looked at. The result is one narrow pass over whole texts, however long: no shuffle, no Python.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored, words

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows, about, on which costs and rejections are measured. Only the order of the rules depends on them.
SAMPLE_ROWS = 2000
#: Runs of each rule over the sample.
REPEATS = 3


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_chars(text: Column) -> Column:
    return F.length(_without(text, SPACES)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _windows(w: Column) -> Column:
    """A hash of each window of three words."""
    return F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """Words in windows that are found twice or more: windows sorted by hash and place, those beside an equal one marked, their places merged."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.aggregate(
        F.sort_array(_twins(pairs)),
        F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def _twins(pairs: Column) -> Column:
    """Places of windows beside an equal one. Neighbours are zipped in, as an index into a computed array would compute it anew for each entry."""
    shifted = F.arrays_zip(pairs.alias("x"), F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))).alias("y"), F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))).alias("z"))
    return F.transform(F.filter(shifted, lambda t: F.coalesce(t["x"]["g"] == t["y"]["g"], F.lit(False)) | F.coalesce(t["x"]["g"] == t["z"]["g"], F.lit(False))), lambda t: t["x"]["i"])


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, text and what rules look at: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    df = documents(docs).select("doc_id", "text", words(F.col("text")).alias("_w"), _lines(F.col("text")).alias("_l"))
    df = df.select("doc_id", "text", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"), dup_lines(F.col("_l")).alias("n_dup_lines"), _windows(F.col("_w")).alias("_g"))
    none = F.size(F.array_distinct("_g")) == F.size("_g")
    return df.select("doc_id", "text", "n_words", word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), "n_lines", "n_dup_lines", F.when(none, F.lit(0)).otherwise(_covered(F.col("_g"))).cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects where the condition holds. The condition is SQL over the columns of `signals`; duck says the same to DuckDB, if in other words."""

    name: str
    condition: str
    duck: str | None = None


#: Thresholds are part of the rule; whole numbers only, so that no engine rounds them. The last four read the text anew.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("few_letters", r"2 * regexp_count(text, r'\p{L}') < word_chars", r"2 * len(regexp_extract_all(text, '\p{L}')) < word_chars"),
    Rule("digits", "10 * regexp_count(text, '[0-9]') > 3 * word_chars", "10 * len(regexp_extract_all(text, '[0-9]')) > 3 * word_chars"),
    Rule("few_kinds", r"50 * size(array_distinct(regexp_extract_all(text, r'([^\x20\x09-\x0D]+)', 1))) < n_words", r"50 * len(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) < n_words"),
    Rule("cut_lines", r"2 * regexp_count(text, r'\.\.\.(\n|\z)') > n_lines", r"2 * len(regexp_extract_all(text, '\.\.\.(\n|\z)')) > n_lines"),
)
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float  # seconds over the sample, beyond those of a pass that looks at nothing
    rejected: float  # share of the sample

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-6)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Measured]:
    """The rules, the one with the most rejection per cost first; ties by name."""
    n = docs.count()
    # written first, so that a rule's run is the rule's own work; in parts of their own, so that none is large
    sample = stored(signals(documents(docs).sample(min(1.0, rows / max(n, 1)), seed=7)))

    def run(condition: str) -> tuple[float, int, int]:
        best, out = float("inf"), None
        for _ in range(REPEATS):
            began = time.perf_counter()
            out = sample.select(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(f"CASE WHEN {condition} THEN 1 ELSE 0 END")), F.lit(0))).first()
            best = min(best, time.perf_counter() - began)
        return best, out[0], out[1]

    if n == 0:
        return sorted((Measured(r, 0.0, 0.0) for r in rules), key=lambda m: m.rule.name)
    empty = run("length(text) < 0 OR n_words < 0")[0]
    out = []
    for rule in rules:
        took, seen, hit = run(rule.condition)
        out.append(Measured(rule, max(0.0, took - empty), hit / max(seen, 1)))
    return sorted(out, key=lambda m: (-m.worth, m.rule.name))


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects; later conditions are not evaluated then."""
    c = None
    for r in rules:
        c = (F if c is None else c).when(F.expr(r.condition), F.lit(r.name))
    return F.lit(None).cast("string") if c is None else c.otherwise(F.lit(None).cast("string"))


def apply(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """signals with base_failed, rejected_by (null: by no rule, or failed before) and kept."""
    order = list(rules) if rules is not None else [m.rule for m in order_rules(docs)]
    df = signals(docs).withColumn("base_failed", F.expr(BASE))
    df = df.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(order)))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("text")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM w),
o AS (SELECT doc_id, rid, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (SELECT *, row_number() OVER () AS rid FROM g)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM o) WHERE c > 1) GROUP BY rid),
s AS (SELECT g.doc_id, g.text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, row_number() OVER () AS rid FROM g) g LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (RULES)) AS kept FROM b
""".replace("RULES", " OR ".join(f"({r.duck or r.condition})" for r in RULES))

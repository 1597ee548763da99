"""Dictionary search: tokens, a planner that chooses a strategy, ranks, and k-best segmentation."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, like

HEADWORDS = ("simplified", "traditional", "pinyin")
COLUMNS = (*HEADWORDS, "definitions_text")


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()


#: Letters of the basic plane that lose a mark and become another single letter, and what they become.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x2000)) if len(_plain(c)) == 1 and _plain(c) != c.lower())
PLAIN = "".join(map(_plain, MARKED))


def fold(s: str) -> str:
    return "".join(c for c in s.translate(str.maketrans(MARKED, PLAIN)) if unicodedata.category(c) != "Mn").lower()


def folded(c: Column) -> Column:
    """`fold` without Python: combining marks go, letters with marks become plain ones, all in lower case."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), MARKED, PLAIN), r"\p{Mn}", ""))


def tokens(c: Column, diacritics: bool = True) -> Column:
    """Runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(folded(c) if diacritics else F.lower(c), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def postings(entries: DataFrame, columns: tuple[str, ...] = COLUMNS, diacritics: bool = True) -> DataFrame:
    """id, col, token: the inverted index, without repeats."""
    parts = F.concat(*(F.transform(F.array_distinct(tokens(F.col(c), diacritics)), _tagged(c)) for c in columns))
    return entries.select("id", F.explode(parts).alias("t")).select("id", "t.col", "t.token")


def _tagged(name: str):  # noqa: ANN202
    return lambda t: F.struct(F.lit(name).alias("col"), t.alias("token"))


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool
    columns: tuple[str, ...]  # empty: any


class Stored(Protocol):
    """A stored index."""

    def holding(self, spark: SparkSession, terms: list[Term]) -> DataFrame:
        """Postings, among them all that fit a term."""


class Malformed(ValueError):
    pass


def sanitise(q: str) -> str:
    return re.sub(r'["()^]', "", q).strip()


def with_wildcards(q: str) -> str:
    """Adds a `*` to parts that end in an ASCII letter; to a whole query of ASCII letters, digits and spaces if no part did."""
    out = " ".join(f"{p}*" if re.search("[A-Za-z]$", p) else p for p in q.split())
    return f"{q}*" if out == " ".join(q.split()) and re.fullmatch(r"[a-zA-Z0-9\s]+", q) else out


def parse(expression: str, columns: tuple[str, ...] = ()) -> list[Term]:
    """Terms that must all match. A column filter binds to the first term only. Anything but words and trailing `*` is malformed."""
    out: list[Term] = []
    for i, part in enumerate(expression.split()):
        m = re.fullmatch(r"([\w-]+)(\*?)", part)
        if not m or m[1] in ("AND", "OR", "NOT"):
            raise Malformed(part)
        out.append(Term(fold(m[1]), bool(m[2]), columns if i == 0 else ()))
    if not out:
        raise Malformed("empty")
    return out


#: An expression: a term's number, or an operator with two expressions.
Tree = int | tuple[str, "Tree", "Tree"]


def parse_operators(parts: list[Term | str]) -> tuple[list[Term], Tree]:
    """Terms and the expression over them. Terms side by side must all match and bind closest, then NOT, AND and OR."""
    terms: list[Term] = []

    def cut(rest: list[Term | str], names: tuple[str, ...]) -> Tree:
        if not names:
            if not rest or any(isinstance(x, str) for x in rest):
                raise Malformed("an operator without a term")
            first = len(terms)
            terms.extend(rest)
            out: Tree = first
            for k in range(first + 1, len(terms)):
                out = ("AND", out, k)
            return out
        name, out, at = names[0], None, 0
        for end in [i for i, x in enumerate(rest) if x == name] + [len(rest)]:
            side = cut(rest[at:end], names[1:])
            out, at = side if out is None else (name, out, side), end + 1
        return out

    tree = cut(parts, ("OR", "AND", "NOT"))
    return terms, tree


def parse_definition(expression: str) -> list[Term | str]:
    """Terms and operators (in capitals) of a search in definitions, whose column filter binds to the first term only."""
    out: list[Term | str] = []
    for part in expression.split():
        out += [part] if part in ("AND", "OR", "NOT") else parse(part, () if any(isinstance(x, Term) for x in out) else ("definitions_text",))
    return out


def match(index: DataFrame, terms: list[Term], tree: Tree | None = None) -> DataFrame:
    """id of entries that hold every term, or for which the expression holds: one pass over the rows of the index that fit any
    term and one aggregation, however many terms there are."""

    def fits(t: Term) -> Column:
        c = F.col("token").startswith(t.text) if t.prefix else F.col("token") == t.text
        return c & F.col("col").isin(*t.columns) if t.columns else c

    def holds(x: Tree) -> Column:
        if isinstance(x, int):
            return F.col(f"t{x}")
        a, b = holds(x[1]), holds(x[2])
        return a | b if x[0] == "OR" else a & ~b if x[0] == "NOT" else a & b

    some = fits(terms[0])
    for t in terms[1:]:
        some = some | fits(t)
    out = index.where(some).groupBy("id").agg(*(F.bool_or(fits(t)).alias(f"t{k}") for k, t in enumerate(terms)))
    if tree is None:
        tree = parse_operators(list(terms))[1]
    return out.where(holds(tree)).select("id")


def search(entries: DataFrame, q: str = "", definition: str = "", tone: str = "", headwords: bool = False, limit: int = 50, substring: bool = False, diacritics: bool = True, index: DataFrame | Stored | None = None) -> DataFrame:
    """Entries found, ranked by length of the headword. entries: id, simplified, traditional, pinyin, definitions_text.

    index: what `postings` gave for the entries, or a stored index that reads what the terms need; else postings are made anew."""
    if not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a whole number, not negative")
    q, definition = sanitise(q), sanitise(definition)
    df = entries
    by_tone = F.col("pinyin").contains(tone) if tone in ("1", "2", "3", "4", "5") else None
    wild = "_" in q or ("*" in q[:-1] and not q.endswith("*"))
    if q and (wild or substring):
        pattern = f"*{q}*" if substring and not wild else q
        df = df.where(like(F.col("simplified"), pattern) | like(F.col("traditional"), pattern))
        if definition:
            df = df.where(like(F.col("definitions_text"), f"%{definition}%"))
    elif q or definition:
        try:
            parts: list[Term | str] = list(parse(with_wildcards(q), HEADWORDS if headwords else ())) if q else []
            if definition:
                parts += (["AND"] if parts else []) + parse_definition(definition if definition.endswith("*") else f"{definition}*")
            terms, tree = parse_operators(parts)
        except Malformed:
            return df.limit(0)
        rows = postings(df, diacritics=diacritics) if index is None else index if isinstance(index, DataFrame) else index.holding(df.sparkSession, terms)
        df = df.join(match(rows, terms, tree), "id", "left_semi")
    elif by_tone is None:
        return df.limit(0)
    if by_tone is not None:
        df = df.where(by_tone)
    return df.orderBy(F.length("simplified"), "simplified", "id").limit(min(limit, 200))


def with_definitions(entries: DataFrame, definitions: DataFrame) -> DataFrame:
    """entries with their definitions in order; none gives an empty list."""
    each = definitions.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "definition"))), lambda x: x["definition"]).alias("definitions"))
    return entries.join(each, "id", "left").withColumn("definitions", F.coalesce("definitions", F.array().cast("array<string>")))


def client_query(typed: str) -> dict[str, str]:
    """What a typed query asks for: prefixed tokens by name (the last valid one wins) and the rest as text."""
    valid = {"strokes": r"\d+(-\d+)?", "radical": r".+", "component": r".+", "tone": r"[1-5]", "def": r".+"}
    out: dict[str, str] = {}
    text = []
    for token in typed.split():
        name, colon, value = token.partition(":")
        if colon and name.lower() in valid:
            if re.fullmatch(valid[name.lower()], value):
                out[name.lower()] = value
        else:
            text.append(token)
    return out | ({"text": " ".join(text)} if text else {})


#: Characters of a query that the dictionary's own endpoint reads.
ENDPOINT = 20


def occurrences(queries: DataFrame, forms: DataFrame, longest: int | None = None) -> DataFrame:
    """query_id, pos, form, ids: where forms (form, ids) stand in queries (query_id, text). Substrings meet forms in an equal join.

    longest: only so many characters of a query are read (ENDPOINT does as the endpoint); None reads all. Substrings are no longer
    than the longest form."""
    n = F.length("text") if longest is None else F.least(F.length("text"), F.lit(longest))
    most = forms.agg(F.max(F.length("form")).alias("n")).first()["n"] or 0
    at = F.explode(F.sequence(F.lit(1), n)).alias("pos")
    df = queries.where("text <> ''").select("query_id", "text", n.alias("n"), at)
    df = df.select("query_id", "text", "pos", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), F.col("n") - F.col("pos") + 1)))).alias("len"))
    return df.select("query_id", "pos", F.expr("substring(text, pos, len)").alias("form")).join(forms, "form")


def segmentations(queries: DataFrame, forms: DataFrame, top: int = 5, longest: int | None = None) -> DataFrame:
    """query_id, rank, segments, score: the best full covers by the sum of squared lengths, ties by their text.

    Each query's places and forms (of at most `longest` characters, if given) go to one call that keeps the `top` best covers of each prefix, which
    is exact as a score is a sum over segments."""
    top = max(1, min(10, top))
    found = occurrences(queries, forms.select("form").distinct(), longest)
    n = F.length("text") if longest is None else F.least(F.length("text"), F.lit(longest))
    per = found.groupBy("query_id").agg(F.collect_list(F.struct("pos", "form")).alias("at")).join(queries.select("query_id", n.alias("n")), "query_id")

    @F.pandas_udf("array<struct<segments:string,score:int>>")
    def best(at: pd.Series, n: pd.Series) -> pd.Series:
        def one(rows: list, size: int) -> list:
            ends: dict[int, list] = {0: [(0, ())]}
            by_start: dict[int, list] = {}
            for r in rows:
                by_start.setdefault(r["pos"] - 1, []).append(r["form"])
            for i in range(size):
                for score, path in sorted(ends.get(i, []), key=lambda x: (-x[0], x[1]))[:top]:
                    for f in by_start.get(i, []):
                        ends.setdefault(i + len(f), []).append((score + len(f) ** 2, (*path, f)))
            return [{"segments": "|".join(p), "score": s} for s, p in sorted(ends.get(size, []), key=lambda x: (-x[0], x[1]))[:top] if p]

        return pd.Series([one(list(a), int(k)) for a, k in zip(at, n, strict=True)])

    return per.select("query_id", F.posexplode(best("at", "n")).alias("rank", "s")).select("query_id", (F.col("rank") + 1).alias("rank"), "s.segments", "s.score")


def contained_in(entries: DataFrame, q: str) -> DataFrame:
    """Entries whose headword stands in the query; empty headwords do not."""
    inside = lambda c: F.expr(f"instr({_lit(q)}, {c}) > 0 AND {c} <> ''")
    return entries.where(inside("simplified") | (inside("traditional") & (F.col("traditional") != F.col("simplified"))))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


__all__ = ["ascii_lower", "client_query", "contained_in", "match", "occurrences", "postings", "search", "segmentations", "with_definitions"]

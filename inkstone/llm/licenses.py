"""License scans by canonical digests (operator 1), without Python on the executors.

A text is put into canonical form: lower case, line noise and comment marks gone, copyright notices dropped (lines in which a
year, a mark or a holder follows the word; lines of a wrapped body that begin with it stay), equivalent spellings made one (as
the matching guidelines of license lists name them), quotes and punctuation removed, white space made single. Its SHA-256 is
joined with the digests of known license texts, which pass through the same expressions.

Beside the whole text, its lines and its paragraphs (between blank lines) are digested and joined in the same way, whole, so
that a notice or a license inside a longer text is found: `parts` names them. Only blocks that begin as some known text does
(`_fixed`), and whose canonical form is as long as one, are digested; no other can have its digest. Texts are read once; digests
alone are stored, and what follows reads those.

Null and empty texts, and texts of which nothing is left, have an empty canonical form; they match nothing. Repeated
rows each give a row, rows with a null id too; an empty table gives none; of several ids with one digest the first by name
counts. Extra columns are not looked at. Very long texts are read whole. The known side is as large as the list
given, whose size is checked before it is broadcast; a larger list is joined by a shuffle on the digest, whose hot
values AQE splits, as the known side has one row for each digest.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, is_small, stored
from .license_texts import FULL, SPELLINGS, TEXTS

#: Known digests that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Characters of a known text that a block is asked to begin with, at most, and how many beginnings with a length are asked for; if
#: more, every block is digested.
START_CHARS, STARTS = 24, 1_000

#: Applied in this order, after ASCII letters are in lower case. Each is valid for Java's and RE2's engines.
STEPS: tuple[tuple[str, str], ...] = (
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|--+|;+|dnl\b|rem\b|<!--|%+)+", ""),
    (r"(?m)^[ \t]*(?:(?:\(c\)[ \t]*)?copyright[ \t:]*(?:\(c\)|©|by\b|[0-9]{4}|[<\[{]year|[<\[{]yyyy)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved\b)[^\n]*$", ""),
    (r"(?m)^[ \t]*(?:spdx-license-identifier:)[^\n]*$", ""),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
)
#: Then, as plain text.
SAME: tuple[tuple[str, str], ...] = (("https ", "http "), *SPELLINGS)


def _plain(text: Column, steps: tuple[tuple[str, str], ...] = STEPS[:-1]) -> Column:
    t = F.translate(text, UPPER, LOWER)
    for pattern, new in steps:
        # lines end at \n alone, as RE2 has it
        t = F.regexp_replace(t, pattern.replace("(?m)", "(?md)"), new)
    return t


def _same(plain: Column) -> Column:
    """The last step and the spellings."""
    t = F.regexp_replace(plain, *STEPS[-1])
    for old, new in SAME:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(t)


def canonical(text: Column) -> Column:
    return _same(_plain(text))


def _fixed(start: str) -> str:
    """How a block began before its spellings were made one, if its canonical form begins with `start`.

    From the last replacement back: the new spelling, wherever it may stand, can be of this replacement from where the two spellings
    differ, so the start is kept up to there. One that runs over the end is taken to stand there."""
    for old, new in reversed(SAME):
        for i in range(len(start)):
            seen = start[i : i + len(new)]
            if new.startswith(seen):
                start = start[: i + len(commonprefix((old, new)))]
                break
    return start


def _begins(starts: list[str]) -> str:
    """What finds one of these beginnings (`_fixed`) of a line; marks between words may be any, line ends too."""
    other = STEPS[-1][0]
    return rf"(?md)^[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]*+(?:{'|'.join(s.replace(' ', other) for s in starts)})"


def blocks(plain: Column, starts: list[str] | None, lengths: list[int]) -> Column:
    """Digests of the canonical forms of a text's lines and paragraphs, in order and without repeats, from the text after all steps
    but the last. Only of blocks that begin with one of `starts` and have one of `lengths` in canonical form (None: of all blocks)."""
    found = F.concat(F.split(plain, r"\n"), F.split(plain, r"\n[ \t]*\n"))
    if starts is not None:
        begins = F.lit(_begins(starts))
        found = F.filter(found, lambda b: F.rlike(b, begins))
    forms = F.array_distinct(F.transform(found, _same))
    if starts is not None:
        forms = F.filter(forms, lambda c: F.length(c).isin(lengths))
    held = F.array_sort(F.transform(forms, lambda c: F.sha2(c, 256)))
    return held if starts is None else F.when(F.rlike(plain, begins), held)


def digests(texts: DataFrame) -> DataFrame:
    """license_id, digest, and start and length of the canonical form, one row for each digest (the first id by name) from rows of license_id and text."""
    df = texts.select("license_id", canonical(F.coalesce("text", F.lit(""))).alias("c")).where("c <> ''")
    return df.groupBy(F.sha2("c", 256).alias("canon_sha256")).agg(F.min("license_id").alias("license_id"), F.min(F.left("c", F.lit(START_CHARS))).alias("start"), F.min(F.length("c")).alias("n"))


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in sorted((TEXTS | FULL).items())], "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, canon_sha256, license_id (null: no known license), is_license, parts (ids of blocks, by name, joined) for every row."""
    lic = stored(digests(licenses if licenses is not None else known(docs.sparkSession)))
    seen = lic.select("start", "n").distinct().limit(STARTS + 1).collect()
    starts = sorted({_fixed(r["start"]) for r in seen}) if len(seen) <= STARTS else None
    lic = lic.drop("start", "n")
    if is_small(lic, BROADCAST_ROWS):
        lic = F.broadcast(lic)
    df = documents(docs).select("doc_id", _plain(F.col("text")).alias("t"))
    df = df.select("doc_id", F.sha2(_same(F.col("t")), 256).alias("canon_sha256"), blocks(F.col("t"), starts, sorted({r["n"] for r in seen})).alias("blocks"))
    # texts with the same blocks have the same parts: one digest of all stands for them
    df = stored(df.withColumn("h", F.when(F.size("blocks") > 0, F.sha2(F.array_join("blocks", ""), 256))))
    each = df.where("h is not null").groupBy("h").agg(F.first("blocks").alias("blocks")).select("h", F.explode("blocks").alias("canon_sha256"))
    held = each.join(lic, "canon_sha256").groupBy("h").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("parts"))
    held = stored(held)
    if is_small(held, BROADCAST_ROWS):
        held = F.broadcast(held)
    df = df.drop("blocks").join(lic, "canon_sha256", "left").join(held, "h", "left")
    return df.select("doc_id", "canon_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"), F.coalesce("parts", F.lit("")).alias("parts"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_steps(x: str, steps: tuple[tuple[str, str], ...]) -> str:
    out = f"translate({x}, '{UPPER}', '{LOWER}')"
    for pattern, new in steps:
        lit = "chr(10)" if new == "\n" else _sql_text(new)
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {lit}, 'g')"
    return out


def _sql_same(x: str) -> str:
    for old, new in SAME:
        x = f"replace({x}, {_sql_text(old)}, {_sql_text(new)})"
    return f"trim({x})"


def oracle() -> str:
    """Blocks are taken one by one here; each passes through the steps that a whole text does."""
    rows = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in sorted((TEXTS | FULL).items()))
    whole = lambda x: _sql_same(_sql_steps(x, STEPS))
    block = _sql_same(f"regexp_replace(b, {_sql_text(STEPS[-1][0])}, ' ', 'g')")
    return f"""
WITH k AS (SELECT sha256({whole('t')}) AS canon_sha256, min(k) AS license_id FROM (VALUES {rows}) v(k, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, sha256({whole("coalesce(text, '')")}) AS canon_sha256, {_sql_steps("coalesce(text, '')", STEPS[:-1])} AS t FROM documents),
e AS (SELECT rid, unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n[ \\t]*\\n'))) AS b FROM d),
p AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS parts FROM (SELECT rid, {block} AS c FROM e) JOIN k ON k.canon_sha256 = sha256(c) WHERE c <> '' GROUP BY 1)
SELECT d.doc_id, d.canon_sha256, k.license_id, k.license_id IS NOT NULL AS is_license, coalesce(p.parts, '') AS parts FROM d LEFT JOIN k USING (canon_sha256) LEFT JOIN p USING (rid)
"""

"""Markdown texts cut into chunks at block borders, then merged to readable sizes.

Both steps are folds in the JVM. The first goes over a text's lines, whose class (`_line`) says what it does to the block that is
open: blank lines and rules end a part, headings begin one, every other block joins the open part or begins one. The second goes over
the parts' places: a part joins the chunk before it while that one is small. Folds copy what they have so far whenever a part is
added, so time grows with the square of a text's parts, by 16 bytes each.

A null text has no chunks, nor has an empty or blank one; repeated rows each give their chunks; an empty table gives none. Only the key and
the content are looked at, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count

#: Sizes in characters. Fixed values.
LEAST, GOOD, MOST = 100, 200, 700
#: Classes of lines by what they match first; the rest are text. Fixed values of Markdown.
_CLASSES = {
    "blank": r"^\s*$",
    "fence": r"^ {0,3}(?:`{3,}|~{3,})",
    "heading": r"^ {0,3}#{1,6}(?:\s|$)",
    "rule": r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$",
    "item": r"^ {0,3}(?:>|[-*+] |\d{1,9}[.)] )",
}
_UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t]*$"
_MARK = r"^ {0,3}(`{3,}|~{3,})"
_PART = "array<struct<s:int,e:int>>"


def _line(line: Column) -> Column:
    kind = F.coalesce(*(F.when(F.regexp_like(line, F.lit(p)), F.lit(k)) for k, p in _CLASSES.items()), F.lit("text"))
    mark = F.regexp_extract(line, _MARK, 1)
    return F.struct(F.length(line).alias("n"), kind.alias("kind"), F.regexp_like(line, F.lit(_UNDERLINE)).alias("under"), mark.alias("mark"), F.regexp_like(line, F.lit(_MARK + r"\s*$")).alias("bare"))


def _with_next(lines: Column) -> Column:
    """Lines with the line end in their length, and whether the next one underlines them."""
    return F.transform(lines, lambda x, i: x.withField("n", x["n"] + (i + 1 < F.size(lines)).cast("int")).withField("titled", (x["kind"] == "text") & F.coalesce(F.get(lines, i + 1)["under"], F.lit(False))))


def _parts(lines: Column) -> Column:
    """Places of the runs of lines that stand together. The fold's state: where the next line begins, what block is open (mode), the mark
    that closes a fence, the part so far (from s to e; s is -1 if none is open) and the parts before it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("mode"), F.lit("").alias("fence"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast(_PART).alias("done"))

    def step(a: Column, x: Column) -> Column:
        end, mode, kind = a["at"] + x["n"], a["mode"], x["kind"]
        closes = x["bare"] & (F.substring(x["mark"], 1, 1) == F.substring(a["fence"], 1, 1)) & (F.length(x["mark"]) >= F.length(a["fence"]))
        goes_on = F.when(mode.isin("fence", "title"), True).when(mode == "text", kind == "text").when(mode == "item", kind.isin("text", "item")).otherwise(False)
        ends = ~goes_on & kind.isin("blank", "rule")
        begins = ~goes_on & ~ends & ((kind == "heading") | x["titled"] | (a["s"] < 0))
        left = (ends | begins) & (a["s"] >= 0)
        next_mode = (
            F.when(goes_on & (mode == "fence"), F.when(closes, "").otherwise("fence"))
            .when(goes_on & (mode == "title"), "")
            .when(goes_on, mode)
            .when(kind.isin("blank", "rule", "heading"), "")
            .when(x["titled"], "title")
            .otherwise(kind)
        )
        return F.struct(
            end.alias("at"),
            next_mode.alias("mode"),
            F.when(~goes_on & (kind == "fence"), x["mark"]).otherwise(a["fence"]).alias("fence"),
            F.when(ends, -1).when(begins, a["at"]).otherwise(a["s"]).alias("s"),
            F.when(ends, -1).otherwise(end).alias("e"),
            F.when(left, F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(lines, start, step, lambda a: F.when(a["s"] >= 0, F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["done"]))


def _merged(parts: Column) -> Column:
    """Parts as chunks: a chunk takes the next part while it is below LEAST, or below GOOD and not above MOST with it; a last chunk
    below LEAST goes to the one before."""
    last = lambda a: F.try_element_at(a, F.lit(-1))

    def step(a: Column, x: Column) -> Column:
        size = F.when(F.size(a) > 0, last(a)["e"] - last(a)["s"])
        joins = (size < LEAST) | ((size < GOOD) & (size + x["e"] - x["s"] <= MOST))
        return F.when(F.coalesce(joins, F.lit(False)), _widened(a, x["e"])).otherwise(F.concat(a, F.array(x)))

    def finish(a: Column) -> Column:
        small = (F.size(a) > 1) & (last(a)["e"] - last(a)["s"] < LEAST)
        return F.when(small, _widened(F.slice(a, 1, F.size(a) - 1), last(a)["e"])).otherwise(a)

    return F.aggregate(parts, F.array().cast(_PART), step, finish)


def _widened(a: Column, e: Column) -> Column:
    """A list of places whose last one ends at e."""
    return F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["s"].alias("s"), e.alias("e"))))


def chunks(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, chunk_order, s, e, text, char_count (ideographs) for every chunk of every text. Places are those in the text with single line ends."""
    df = docs.select(F.col(key).alias("key"), F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")).alias("whole"))
    # a column of its own for each step: an expression that stands in several places would be worked out anew in each
    df = df.withColumn("lines", F.transform(F.split("whole", "\n"), _line)).withColumn("lines", _with_next(F.col("lines")))
    df = df.withColumn("parts", _merged(_parts(F.col("lines"))))
    df = df.select("key", F.transform("parts", lambda x: F.struct(x["s"].alias("s"), F.substr(F.col("whole"), x["s"] + 1, x["e"] - x["s"]).alias("text"))).alias("parts"))
    own = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    head = lambda t: F.length(t) - F.length(F.regexp_replace(t, r"(?U)^\s+", ""))
    trimmed = F.transform("parts", lambda x: F.struct((x["s"] + head(x["text"])).alias("s"), own(x["text"]).alias("text")))
    df = df.select("key", F.posexplode(F.filter(trimmed, lambda x: x["text"] != "")).alias("chunk_order", "x"))
    return df.select(F.col("key").alias(key), "chunk_order", "x.s", (F.col("x.s") + F.length("x.text")).alias("e"), "x.text", char_count(F.col("x.text")).alias("char_count"))

"""Dictionary files, decomposition files, uploads, web pages."""

from __future__ import annotations

import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

TEXT_TYPES = ("text/plain", "text/markdown")
#: Types that a converter turns into markdown. Fixed values.
CONVERTED = {
    "application/pdf", "text/html", "application/xml", "text/xml", "text/csv", "image/jpeg", "image/png", "image/webp", "image/svg+xml",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.oasis.opendocument.text",
}
OPERATORS = {"⿰": 2, "⿱": 2, "⿴": 2, "⿵": 2, "⿶": 2, "⿷": 2, "⿸": 2, "⿹": 2, "⿺": 2, "⿻": 2, "⿲": 3, "⿳": 3}


def unzip_first(path: str, to: str) -> str:
    with zipfile.ZipFile(path) as z, open(to, "wb") as f:
        f.write(z.read(z.namelist()[0]))
    return to


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """traditional, simplified, pinyin, definitions of the entry lines in `value`; others are skipped."""
    entry = r"^(\S+) (\S+) \[([^\]]*)\] /(.*)/\s*$"
    df = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & F.col("value").rlike(entry))
    part = lambda k: F.regexp_extract("value", entry, k)
    return df.select(part(1).alias("traditional"), part(2).alias("simplified"), part(3).alias("pinyin"), F.split(part(4), "/").alias("definitions"))


def dictionary_header(lines: DataFrame) -> DataFrame:
    """epoch and date out of the `#!key=value` lines, one row; a missing epoch is an error."""
    of = lambda key: F.max(F.when(F.col("value").startswith(f"#! {key}=") | F.col("value").startswith(f"#!{key}="), F.regexp_extract("value", r"=(.*)$", 1)))
    row = lines.agg(of("time").alias("t"), of("date").alias("date"))
    return row.select(F.when(F.col("t").isNull(), F.raise_error(F.lit("no time header"))).otherwise(F.col("t")).cast("long").alias("epoch"), "date")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    epoch = dictionary_header(lines).first()["epoch"]
    return parse_dictionary(lines).withColumn("source", F.lit(f"cedict:{epoch}"))


def parse_decompositions(lines: DataFrame) -> DataFrame:
    """codepoint, character, position, ids, tags, obsolete: a row for each variant; an atomic character has one with null ids."""
    cells = F.split("value", "\t")
    df = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(cells.alias("c")).where(F.size("c") >= 3)
    raw = F.filter(F.transform(F.slice("c", 3, F.size("c")), lambda x: F.trim(x)), lambda x: x != "")
    df = df.select(F.get("c", F.lit(0)).alias("codepoint"), F.get("c", F.lit(1)).alias("character"), raw.alias("raw"))
    tag = lambda x: F.regexp_extract(x, r"\[([A-Z]+)\]$", 1)
    variants = F.filter(F.transform("raw", lambda x: F.struct(F.regexp_replace(x, r"\[[A-Z]+\]$", "").alias("ids"), tag(x).alias("t"))), lambda x: x["ids"] != F.col("character"))
    df = df.select("codepoint", "character", F.posexplode_outer(variants).alias("position", "v"))
    kept = F.replace(F.col("v.t"), F.lit("O"), F.lit(""))
    return df.select("codepoint", "character", "position", F.col("v.ids").alias("ids"), F.when(kept != "", kept).alias("tags"), F.coalesce(F.contains("v.t", F.lit("O")), F.lit(False)).alias("obsolete"))


def parse_ids(ids: str) -> list[tuple[int, int, int, str, str]]:
    """Pre-order rows (node, parent, position, kind, value) of a decomposition; parent -1 for the root.

    What follows a whole decomposition is ignored; one that ends early is an error."""
    rows: list[tuple[int, int, int, str, str]] = []
    chars = iter(ids)

    def node(parent: int, position: int) -> None:
        c = next(chars, None)
        if c is None:
            raise ValueError(f"decomposition ends early: {ids}")
        me = len(rows)
        if c in OPERATORS:
            rows.append((me, parent, position, "op", c))
            for k in range(OPERATORS[c]):
                node(me, k)
        elif "①" <= c <= "⑳":
            rows.append((me, parent, position, "unencoded", str(ord(c) - 0x245F)))
        else:
            rows.append((me, parent, position, "char", c))

    if ids:
        node(-1, 0)
    return rows


def decomposition_nodes(variants: DataFrame, key: list[str]) -> DataFrame:
    """key columns, node, parent, position, kind, value for each row's `ids`."""
    kind = "array<struct<node:int,parent:int,position:int,kind:string,value:string>>"

    @F.pandas_udf(kind)
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: [dict(zip(("node", "parent", "position", "kind", "value"), r, strict=True)) for r in parse_ids(x)] if x else [])

    return variants.select(*key, F.explode(run("ids")).alias("n")).select(*key, "n.*")


def uploads(files: DataFrame, stored: DataFrame) -> DataFrame:
    """id, content_hash, location, mimetype, already_exists: the first of equal files (by id) that is not stored yet is new."""
    df = files.withColumn("content_hash", F.sha2(F.col("content"), 256))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))
    known = stored.select("content_hash", F.lit(True).alias("known")).distinct()
    df = df.withColumn("nth", first).join(known, "content_hash", "left")
    return df.select("id", "content_hash", T.original_location(F.col("content_hash")).alias("location"), T.first_filled(F.col("mimetype"), F.lit("application/octet-stream")).alias("mimetype"), (F.coalesce("known", F.lit(False)) | (F.col("nth") > 1)).alias("already_exists"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and quotes of a page; scripts, styles, navigation and such are left out."""

    SKIP = {"script", "style", "nav", "footer", "aside", "noscript", "template", "svg", "head"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.now: list[str] = []
        self.prefix, self.skip = "", 0

    def flush(self, prefix: str = "") -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(self.prefix + text)
        self.now, self.prefix = [], prefix

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.flush("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.flush("- ")
        elif tag == "blockquote":
            self.flush("> ")
        elif tag in ("p", "div", "article", "section", "main", "ul", "ol", "table", "tr", "pre", "br", "hr", "header", "body"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "sup", "sub", "u", "td", "th"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.now.append(data)


def html_to_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.flush()
    return "\n\n".join(p.blocks)


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else html_to_markdown(x))


def extract(content: Column, mimetype: Column) -> Column:
    """Text as it is, web pages as markdown; other convertible types need a converter, the rest is an error."""
    bad = F.raise_error(F.concat(F.lit("no converter for "), mimetype))
    return F.when(mimetype.isin(*TEXT_TYPES), content).when(mimetype.isin("text/html", "text/csv", "text/xml", "application/xml"), F.when(mimetype == "text/html", markdown(content)).otherwise(content)).otherwise(bad)


def write_markdown(df: DataFrame, path: str) -> None:
    """location and content as Parquet, to be read back by location."""
    df.select("location", "content").write.mode("overwrite").parquet(path)


def read_markdown(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (location, ...) with the content written there; a location without one is an error."""
    held = wanted.sparkSession.read.parquet(path).dropDuplicates(["location"]).withColumn("_is", F.lit(True))
    out = wanted.join(held, "location", "left")
    missing = F.raise_error(F.concat(F.lit("nothing is stored at "), "location"))
    return out.withColumn("content", F.when(F.col("_is").isNull(), missing).otherwise(F.col("content"))).drop("_is")


def staged(df: DataFrame, path: str, rows: int = 5000) -> DataFrame:
    """Writes df as JSON files of so many rows at most and reads them back with the same schema."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)

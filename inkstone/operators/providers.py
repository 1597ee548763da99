"""Model calls behind an interface; the defaults need no model and always answer the same."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import find_spans


class EntityProvider(Protocol):
    def extract(self, chunks: DataFrame, types: DataFrame) -> DataFrame:
        """chunk, text, type, s, e."""


class Gazetteer:
    """Finds the examples of each node type (name, examples) as they are written."""

    def extract(self, chunks: DataFrame, types: DataFrame) -> DataFrame:
        return find_spans(chunks, types.select(F.col("name").alias("type"), F.explode("examples").alias("text")).distinct())


class Translator(Protocol):
    name: str

    def translate(self, chunks: DataFrame) -> DataFrame:
        """chunk, content."""


class Echo:
    """Gives the source back; a stand-in for machine translation."""

    name = "mt:echo"

    def translate(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk", "content")


def drafts(chunks: DataFrame, translators: list[tuple[int, Translator]]) -> DataFrame:
    """chunk, draft_number, translator, content: one draft from each translator."""
    out = [t.translate(chunks).select("chunk", F.lit(n).alias("draft_number"), F.lit(t.name).alias("translator"), "content") for n, t in translators]
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def prompt(*sections: tuple[str, str]):  # noqa: ANN201
    """A column: titled sections (title, column) one after the other, empty ones left out."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{t}:\n"), F.col(c))) for t, c in sections))

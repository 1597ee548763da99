"""A stored inverted index in files of token ranges with a directory, so that a term or prefix reads only the files that may hold it.

`postings` holds id, col, token, dealt into files by ranges of (token, id) and sorted by token in each: a token that stands in very many entries
spreads over several files. `directory` has a row for each file: its name, its first and last token, its number of rows. A search reads the
directory, then the files whose range meets a term; within them sorted row groups are passed over by their statistics.

Entries are those of `search`; a null column has no tokens, repeated entries have repeated postings, no entries give an index in which
nothing is found. The folder is written once; write a new one for new entries, or keep a `Snapshot` with its own postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import COLUMNS, Term, postings


@dataclass(frozen=True)
class RangeIndex:
    path: str

    def write(self, entries: DataFrame, files: int = 200, columns: tuple[str, ...] = COLUMNS, diacritics: bool = True) -> None:
        """Makes the index; choose files so that one is about 100 MB."""
        rows = postings(entries, columns, diacritics).repartitionByRange(files, "token", "id").sortWithinPartitions("token", "id", "col")
        rows.write.parquet(f"{self.path}/postings")
        held = entries.sparkSession.read.parquet(f"{self.path}/postings").select("token", F.col("_metadata.file_name").alias("file"))
        spans = held.groupBy("file").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.count(F.lit(1)).alias("n"))
        spans.coalesce(1).write.parquet(f"{self.path}/directory")

    def files(self, spark: SparkSession, terms: list[Term]) -> list[str]:
        """Names of the files that may hold a term: `files` of them at most."""
        some = F.lit(False)
        for t in terms:
            some = some | _meets(t)
        return sorted(r["file"] for r in spark.read.parquet(f"{self.path}/directory").where(some).select("file").collect())

    def holding(self, spark: SparkSession, terms: list[Term]) -> DataFrame:
        """id, col, token of the files that may hold a term."""
        names = self.files(spark, terms)
        if not names:
            return spark.read.parquet(f"{self.path}/postings").limit(0)
        return spark.read.parquet(*(f"{self.path}/postings/{n}" for n in names))


def _meets(t: Term) -> Column:
    """Whether a file from low to high may hold a term. Tokens with a prefix stand in one run that begins at the prefix itself."""
    low, high, text = F.col("low"), F.col("high"), F.lit(t.text)
    return (high >= text) & ((low <= text) | (low.startswith(text) if t.prefix else F.lit(False)))

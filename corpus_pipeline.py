"""A corpus through five stages: toxicity, near duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it again for the next. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import decontam, minhash, pii, sentencepiece_codec, toxicity
from inkstone.llm.common import discard, stored, table, version
from inkstone.llm.queries import piece_model

#: No SQL expresses these stages; tests/llm holds each stage and run() against plain Python on small tables.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text (by its hash) are in gone: doc_id, version. A null id is a value as any other."""
    gone = gone.select("doc_id", "version").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (version(docs["text"]) == gone["version"])
    return docs.join(gone, same, "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model, learned from the labelled ones among them, calls toxic.

    Null and empty texts get the bias's score, rows with a null id are judged by their text; repeated rows go or stay together.
    An empty table stays empty; without labels none goes. Columns of any name are kept as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(docs, model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates.

    Rows with a null id and null or empty texts are linked with nothing and stay. Rows that repeat an id and a text go or stay
    together; of rows that share an id only, each goes by its own text. An empty table stays empty; columns are kept as they are."""
    return _without(docs, minhash.groups(docs).where("NOT kept"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, rows with a null id among them.

    Null and empty texts hold none and stay; without items all stay. Repeated rows go or stay together. An empty table stays
    empty; columns are kept as they are."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what gives it away; n_chars, if there, follows the text.

    All rows stay, repeated ones and those with a null id too; a null text becomes the empty one. An empty table stays empty.
    Other columns are kept as they are, whatever their names."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    clean = pii.sanitise(pii.scan(docs, keep=rest)).select("own", "clean")
    made = {"text": F.col("clean").alias("text"), "n_chars": F.length("clean").cast("long").alias("n_chars")}
    return clean.select(*(made[c] if c in made else F.col("own").getField(c).alias(c) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded, n_tokens and digests of every row; null texts count as empty ones, which have no ids."""
    return sentencepiece_codec.encode(docs, piece_model())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", leaks), ("personal_data", personal_data), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, past = stored(stage(spark, docs, sf_dir)), docs
        discard(past)
    return docs

"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text with null as the empty string; other columns are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array, without Python."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one; a cluster's is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="inkstone-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstone-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the folders of stored tables that nothing reads any more, such as those of past rounds; others are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def version(text: Column) -> Column:
    """Tells texts with the same id apart; a null text is the empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def by_python(docs: DataFrame, run: Callable[[pd.DataFrame], Iterator[dict]], kind: str) -> DataFrame:
    """docs' doc_id (as it was, null or not) and what `run` gives for each batch: dicts of columns, together a value for each row in order.

    Ids travel as numbers without nulls beside a flag, as pandas would make a column with nulls a float and change large ids."""
    rest = [c for c in docs.columns if c != "doc_id"]

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = 0
            for part in run(pdf):
                n = len(next(iter(part.values())))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + n].to_numpy(), "no_id": pdf["no_id"].iloc[at : at + n].to_numpy(), **part})
                at += n

    own = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), *rest)
    out = own.mapInPandas(rows, f"doc_id long, no_id boolean, {kind}")
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: what may be broadcast is checked, not assumed."""
    return df.limit(rows + 1).count() <= rows

"""Merged entities: groups of a document's mentions under parents, kept up document by document.

Entities are rows (id, doc, type, text, parent, label, scope, ...): mentions have the scope `chunk`, parents the scope `document`, no text
and a label. Ids of mentions are positive and unique; a parent's id is minus the smallest id of its children, so that documents can be
merged apart from each other. Further columns of mentions are kept; parents have null there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, scratch
from .spans import coreference_edges

Grouping = Callable[[DataFrame], DataFrame]


def by_names(mentions: DataFrame) -> DataFrame:
    """doc, seq, id: mentions of a document and type whose texts are equal or similar, directly or through others; seq is the smallest id."""
    # different texts are joined, by their first mentions; the others take over their text's group
    texts = mentions.groupBy("doc", "type", "text").agg(F.min("id").alias("first"))
    roots = components(texts.select(F.col("first").alias("id")), coreference_edges(texts.withColumnRenamed("first", "id"))).withColumnRenamed("v", "first")
    found = texts.join(roots, "first").select("doc", "type", "text", "root")
    return mentions.join(found, ["doc", "type", "text"], "left").select("doc", F.coalesce("root", "id").alias("seq"), "id")


def merge(entities: DataFrame, groups: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """entities with groups (doc, seq, id) as parents; what parents there were before goes.

    Ids that are no mention of the group's document are dropped, then groups with fewer than two members are. A mention in several
    groups belongs to the one with the largest seq; a group left without any has no parent row. A parent has the type of the group's first member (the
    smallest id) and as its label the members' only text, else what labels (doc, seq, label) says, else the first member's text;
    blank labels count as none. Repeated rows of groups count once. Null ids and seqs are in no group; no groups leave mentions alone."""
    mentions = entities.where("scope = 'chunk'").drop("parent", "label")
    known = groups.where("seq IS NOT NULL").select("doc", "seq", "id").distinct().join(mentions.select("doc", "id", "type", "text"), ["doc", "id"])
    first = lambda c: F.min_by(c, "id")
    heads = known.groupBy("doc", "seq").agg(F.count_distinct("id").alias("n"), first("type").alias("type"), first("text").alias("first"), F.min("text").alias("low"), F.max("text").alias("high")).where("n >= 2")
    label = F.col("first")
    if labels is not None:
        told = labels.where("trim(label) <> ''").groupBy("doc", "seq").agg(F.min(F.trim("label")).alias("told"))
        heads, label = heads.join(told, ["doc", "seq"], "left"), F.coalesce("told", "first")
    heads = heads.select("doc", "seq", F.col("type").alias("kind"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(label).alias("name"))
    won = known.join(heads.select("doc", "seq"), ["doc", "seq"], "left_semi").groupBy("doc", "id").agg(F.max("seq").alias("seq"))
    heads = won.groupBy("doc", "seq").agg((-F.min("id")).alias("head")).join(heads, ["doc", "seq"])
    placed = won.join(heads.select("doc", "seq", "head"), ["doc", "seq"]).select(F.col("doc").alias("own_doc"), F.col("id").alias("own_id"), F.col("head").alias("parent"))
    there = mentions.join(placed, (mentions["doc"] == placed["own_doc"]) & (mentions["id"] == placed["own_id"]), "left").drop("own_doc", "own_id").withColumn("label", F.lit(None).cast("string"))
    parents = heads.select(F.col("head").alias("id"), "doc", F.col("kind").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("parent"), F.col("name").alias("label"), F.lit("document").alias("scope"))
    return there.unionByName(parents, allowMissingColumns=True)


def between(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, from_root, to_root, edge_type: edges (doc, from_id, to_id, edge_type) between what mentions belong to (their parents, or
    themselves), without loops and repeats. Edges whose ends are no mentions of their document are left out."""
    root = entities.where("scope = 'chunk'").select("doc", "id", F.coalesce("parent", "id").alias("root"))
    a = root.select("doc", F.col("id").alias("from_id"), F.col("root").alias("from_root"))
    b = root.select("doc", F.col("id").alias("to_id"), F.col("root").alias("to_root"))
    out = edges.select("doc", "from_id", "to_id", "edge_type").join(a, ["doc", "from_id"]).join(b, ["doc", "to_id"])
    return out.where("from_root <> to_root").select("doc", "from_root", "to_root", "edge_type").distinct()


@dataclass(frozen=True)
class Merged:
    """Entities, edges and document edges on disk, in buckets of documents (a hash of doc), of which a change reads and rewrites its own alone.

    Buckets are replaced by dynamic partition overwrite out of staged tables: a change that is cut off and made again ends in the same
    tables. Frames read before a change must be read again after it. A null doc is no document: its rows are never merged and never
    change, nor are mentions with a null id. Columns of mentions named bucket or held are left out."""

    path: str
    buckets: int = 256
    grouping: Grouping = by_names

    def bucket(self, doc: Column) -> Column:
        return F.pmod(F.xxhash64(doc.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, table: str, buckets: list[int] | None = None) -> DataFrame:
        """entities, edges or document_edges."""
        df = spark.read.parquet(f"{self.path}/{table}").where("held").drop("held")
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def create(self, mentions: DataFrame, edges: DataFrame) -> None:
        """Merges all documents: mentions (id, doc, type, text, ...), edges (doc, from_id, to_id, edge_type)."""
        found = mentions.drop("bucket", "held").withColumns({"parent": F.lit(None).cast("long"), "label": F.lit(None).cast("string"), "scope": F.lit("chunk")})
        self._put(self._merged(found), edges.select("doc", "from_id", "to_id", "edge_type").distinct(), None, None)

    def change(self, spark: SparkSession, docs: list, mentions: DataFrame | None = None, edges: DataFrame | None = None, gone: list[int] | None = None) -> None:
        """Merges some documents anew after mentions and edges were added and mentions (by id) taken away.

        An added mention takes the place of one with its id; edges of mentions that are gone go too. Rows of other documents are
        errors, as they would not be merged."""
        if not docs:
            return
        kind = spark.read.parquet(f"{self.path}/entities").schema["doc"].dataType
        # the documents of one change are given by hand; their buckets are as many numbers at most
        named = spark.createDataFrame([(x,) for x in docs], f"doc {kind.simpleString()}")
        buckets = [r["b"] for r in named.select(self.bucket(F.col("doc")).alias("b")).distinct().collect()]
        mine = F.coalesce(F.col("doc").isin(docs), F.lit(False))
        here = lambda df: df.withColumn("doc", F.when(F.coalesce(F.col("doc").isin(docs), F.lit(False)), F.col("doc")).otherwise(F.raise_error(F.lit("a document that is not named")).cast(kind)))
        entities, links = self.read(spark, "entities", buckets).drop("bucket"), self.read(spark, "edges", buckets).drop("bucket")
        found = entities.where(mine & (F.col("scope") == "chunk"))
        if gone:
            found = found.where(~F.col("id").isin(gone))
        if mentions is not None:
            new = here(mentions.drop("bucket", "held")).withColumns({"parent": F.lit(None).cast("long"), "label": F.lit(None).cast("string"), "scope": F.lit("chunk")})
            found = found.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True).select(*entities.columns)
        own = links.where(mine)
        if edges is not None:
            own = own.unionByName(here(edges).select("doc", "from_id", "to_id", "edge_type")).distinct()
        if gone:
            own = own.where(~F.col("from_id").isin(gone) & ~F.col("to_id").isin(gone))
        rest = entities.where(~mine), links.where(~mine), self.read(spark, "document_edges", buckets).drop("bucket").where(~mine)
        self._put(self._merged(found), own, buckets, rest)

    def _merged(self, mentions: DataFrame) -> DataFrame:
        there = mentions.where("doc IS NOT NULL AND id IS NOT NULL")
        return merge(mentions, self.grouping(there.select("id", "doc", "type", "text")))

    def _put(self, entities: DataFrame, edges: DataFrame, buckets: list[int] | None, rest: tuple[DataFrame, DataFrame, DataFrame] | None) -> None:
        spark = entities.sparkSession

        def staged(df: DataFrame) -> DataFrame:
            path = scratch(spark)
            df.write.parquet(path)
            return spark.read.parquet(path)

        entities, edges = staged(entities), staged(edges)
        tables = {"edges": edges, "entities": entities, "document_edges": between(edges, entities)}
        if rest is not None:
            tables = {name: staged(df.unionByName(other)) for (name, df), other in zip(tables.items(), (rest[1], rest[0], rest[2]), strict=True)}
        for name, df in tables.items():
            df = df.withColumns({"bucket": self.bucket(F.col("doc")), "held": F.lit(True)})
            if buckets:
                # an overwrite by buckets leaves a bucket alone for which there are no rows, so each gets one that is not held
                df = df.unionByName(spark.createDataFrame([(b, False) for b in buckets], "bucket int, held boolean"), allowMissingColumns=True)
            df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

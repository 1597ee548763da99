"""Closures, structural templates, folder trees, vectors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import OPERATORS


def _stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the session's shared folder; only a local master may do without one."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkstone-"))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the session's shared place, or on a local master's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="inkstone-")
    return f"{base}/inkstone-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table that scratch named, once nothing reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def closure(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """node: seeds (node) and all their ancestors over links (parent, child). Safe for cycles: each round follows new nodes only."""
    seen = _stored(seeds.select("node").distinct())
    frontier = seen
    while not frontier.isEmpty():
        up = links.join(frontier, links["child"] == frontier["node"], "left_semi").select(F.col("parent").alias("node")).distinct()
        frontier = _stored(up.join(seen, "node", "left_anti"))
        seen = _stored(seen.unionByName(frontier))
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """v, root: for every node (id) the smallest one it is joined with over edges (u, v).

    Each round moves every node's larger neighbours to its smallest one, then the smaller ones, so rounds grow with the logarithm
    of the longest chain. Edges do not grow in number; smallest neighbours come from partial aggregation."""
    e = _stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("low"))
        e = _stored(up.join(low, "u").select("v", "low").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == last:
            break
        last = now
    joined = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select(F.col("id").alias("v")).distinct().join(joined.select(F.col("u").alias("v"), "root"), "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def direct_containers(chars: DataFrame, links: DataFrame, character: str) -> DataFrame:
    """character: those whose root has an edge to a root of the given one. chars: character, root."""
    roots = chars.where(F.col("character") == character).select(F.col("root").alias("child"))
    return links.join(roots, "child", "left_semi").select(F.col("parent").alias("root")).join(chars, "root").select("character").distinct()


def containers(chars: DataFrame, links: DataFrame, character: str) -> DataFrame:
    """As direct_containers at any depth; the character itself is among them."""
    up = closure(chars.where(F.col("character") == character).select(F.col("root").alias("node")), links)
    return chars.join(up.select(F.col("node").alias("root")), "root", "left_semi").select("character").distinct()


def validate(template: object, depth: int = 0, size: list[int] | None = None) -> None:
    """A template is None (anything), {'char': c} or {'op': o, 'children': [...]}: at most 6 deep, 26 nodes in all."""
    size = [0] if size is None else size
    if template is None:
        return
    if depth > 6 or size[0] > 25:
        raise ValueError("template too large")
    size[0] += 1
    if not isinstance(template, dict) or ("char" in template) == ("op" in template):
        raise ValueError("a node is a character or an operator")
    if "char" in template:
        if len(template["char"]) != 1:
            raise ValueError("one character only")
        return
    if template["op"] not in OPERATORS:
        raise ValueError("unknown operator")
    for c in template.get("children", []):
        validate(c, depth + 1, size)


def template_matches(template: dict, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node: nodes (node, kind, value) whose subtree fits the template, by one pair of joins for each child that is not a wildcard."""
    validate(template)

    def fits(t: dict) -> DataFrame:
        kind, value = ("char", t["char"]) if "char" in t else ("op", t["op"])
        out = nodes.where((F.col("kind") == kind) & (F.col("value") == value)).select("node")
        for position, child in enumerate(t.get("children", [])):
            if child is not None:
                below = links.where(F.col("position") == position).join(fits(child).select(F.col("node").alias("child")), "child", "left_semi")
                out = out.join(below.select(F.col("parent").alias("node")), "node", "left_semi")
        return out

    return fits(template).distinct()


def structure_search(template: dict, chars: DataFrame, nodes: DataFrame, links: DataFrame, exact: bool = False, limit: int = 500) -> DataFrame:
    found = template_matches(template, nodes, links)
    if not exact:
        found = closure(found, links)
    return chars.join(found.select(F.col("node").alias("root")), "root", "left_semi").select("character").distinct().orderBy("character").limit(limit)


def tree(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """path, depth, kind, id in reading order: folders by name before documents by title (file name if it has none), ties by id.

    Places are compared name by name, never as one string, so a name may hold anything and a name comes before its
    continuations. Folders and documents whose parent is missing, and cycles, are not reached."""
    step = lambda rank, name, i: F.array(F.struct(F.lit(rank).alias("rank"), name.alias("name"), i.alias("id")))
    frontier = _stored(folders.where("parent IS NULL").select("id", F.lit(0).alias("depth"), step(0, F.col("name"), F.col("id")).alias("place")))
    seen = frontier
    while not frontier.isEmpty():
        f = folders.alias("f").join(frontier.alias("p"), F.col("f.parent") == F.col("p.id"))
        frontier = _stored(f.select(F.col("f.id").alias("id"), (F.col("p.depth") + 1).alias("depth"), F.concat("p.place", step(0, F.col("f.name"), F.col("f.id"))).alias("place")))
        seen = seen.unionByName(frontier)
    seen = _stored(seen)
    name = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("filename"))
    inside = documents.alias("d").join(seen.alias("p"), F.col("d.parent") == F.col("p.id")).select(F.col("d.id").alias("id"), (F.col("p.depth") + 1).alias("depth"), F.concat("p.place", step(1, name, F.col("d.id"))).alias("place"))
    loose = documents.where("parent IS NULL").select("id", F.lit(0).alias("depth"), step(1, name, F.col("id")).alias("place"))
    rows = seen.select("place", "depth", F.lit("folder").alias("kind"), "id").unionByName(inside.unionByName(loose).select("place", "depth", F.lit("document").alias("kind"), "id"))
    return rows.orderBy("place").select(F.array_join(F.transform("place", lambda x: x["name"]), "/").alias("path"), "depth", "kind", "id")


def element_max(vectors: DataFrame, key: str) -> DataFrame:
    """key, pos, x: the greatest value at each position."""
    return vectors.select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.max("x").alias("x"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by id, the new ones winning; of several new ones the last by seq."""
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return both.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("n = 1").drop("n", "seq")


def project(vectors: DataFrame) -> DataFrame:
    """id, x, y: two principal components (id, v: array of float); empty for fewer than two vectors."""
    if vectors.limit(2).count() < 2:
        return vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    out = PCA(k=2, inputCol="f", outputCol="p").fit(df).transform(df).select("id", vector_to_array("p").alias("p"))
    return out.select("id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))

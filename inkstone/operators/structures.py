"""Characters' structure as a shared graph: nodes and links out of parsed decompositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import OPERATORS, decomposition_nodes


def characters(parsed: DataFrame) -> DataFrame:
    """id, codepoint, character, ids, tags, obsolete, root out of `parse_decompositions`: a row for each variant.

    An id is the code point and the variant's place, so equal files give equal ids. Atomic characters and current variants that
    begin with an operator are nodes, named by their id; others have no root."""
    ident = F.concat_ws(":", "codepoint", F.coalesce("position", F.lit(0)).cast("string"))
    is_node = ~F.col("obsolete") & (F.col("ids").isNull() | F.substring("ids", 1, 1).isin(*OPERATORS))
    return parsed.select(ident.alias("id"), "codepoint", "character", "ids", "tags", "obsolete", F.when(is_node, ident).alias("root"))


def representatives(chars: DataFrame) -> DataFrame:
    """character, roots: its nodes, in order."""
    return chars.where("root IS NOT NULL").groupBy("character").agg(F.array_sort(F.collect_set("root")).alias("roots"))


def _inner(chars: DataFrame) -> DataFrame:
    """parent, node, position, kind, value below the roots. Nodes below a root are named by it and their place in pre-order."""
    below = decomposition_nodes(chars.where("root IS NOT NULL AND ids IS NOT NULL"), ["root"]).where("node > 0")
    name = lambda c: F.when(F.col(c) == 0, F.col("root")).otherwise(F.concat_ws("/", "root", F.col(c).cast("string")))
    return below.select(name("parent").alias("parent"), name("node").alias("node"), "position", "kind", "value")


def graph_of(chars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, kind, value) and links (parent, child, position).

    A character below a node is linked to each of its own nodes, to none if it has none; operators and unencoded strokes below a
    node are nodes of their own. Characters meet their nodes in an equal join."""
    roots = chars.where("root IS NOT NULL")
    own = roots.select(F.col("root").alias("node"), F.when(F.col("ids").isNull(), "char").otherwise("op").alias("kind"), F.when(F.col("ids").isNull(), F.col("character")).otherwise(F.substring("ids", 1, 1)).alias("value"))
    inner = _inner(chars)
    fresh = inner.where("kind <> 'char'")
    shared = inner.where("kind = 'char'").join(roots.select(F.col("character").alias("value"), F.col("root").alias("child")), "value")
    links = fresh.select("parent", F.col("node").alias("child"), "position").unionByName(shared.select("parent", "child", "position").distinct())
    return own.unionByName(fresh.select("node", "kind", "value")), links


def variants(chars: DataFrame, character: str) -> DataFrame:
    """id, codepoint, ids, tags, root of a character's current variants, in order."""
    return chars.where((F.col("character") == character) & ~F.col("obsolete")).select("id", "codepoint", "ids", "tags", "root").orderBy("id")

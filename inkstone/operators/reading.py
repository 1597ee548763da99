"""What a reader sees: marked spans, relations of an entity, and inputs of model calls."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import first_wins


def marked(content: Column, spans: Column) -> Column:
    """content with a tag around each span (s, e, id, title), put in from the last to the first so that places stay right."""
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("&quot;"))

    def put(text: Column, x: Column) -> Column:
        tag = F.concat(F.lit('<span class="entity-underline" data-entity-id="'), x["id"].cast("string"), F.lit('" title="'), quoted(x["title"]), F.lit('">'))
        return F.concat(F.substr(text, F.lit(1), x["s"]), tag, F.substr(text, x["s"] + 1, x["e"] - x["s"]), F.lit("</span>"), F.substr(text, x["e"] + 1))

    return F.aggregate(F.reverse(F.array_sort(spans)), content, put)


def relations(edges: DataFrame, types: DataFrame, names: DataFrame) -> DataFrame:
    """entity, edge, label, other: each edge (edge, from_id, to_id, edge_type) seen from both ends.

    Backwards it has its type's reverse name (types: edge_type, reverse_name), else an arrow and its name; an end without a name is `?`."""
    e = edges.join(types.select("edge_type", "reverse_name"), "edge_type", "left")
    for end in ("from", "to"):
        e = e.join(names.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left")
    seen = lambda me, you, label: e.select(F.col(f"{me}_id").alias("entity"), "edge", label.alias("label"), F.coalesce(f"{you}_name", F.lit("?")).alias("other"))
    back = F.coalesce("reverse_name", F.concat(F.lit("← "), "edge_type"))
    return seen("from", "to", F.col("edge_type")).unionByName(seen("to", "from", back))


def choice(reply: Column, entries: Column) -> tuple[Column, Column]:
    """Entry and explanation of a disambiguation reply: an id that is not among the entries gives the first, a missing explanation ''."""
    r = F.from_json(reply, "entryId long, explanation string")
    return F.when(F.array_contains(entries, F.coalesce(r["entryId"], F.lit(-1))), r["entryId"]).otherwise(F.get(entries, F.lit(0))), F.coalesce(r["explanation"], F.lit(""))


class Relations(Protocol):
    def relate(self, inputs: DataFrame) -> DataFrame:
        """window, edge_type, from_text, to_text, explanation out of relation_inputs."""


class KnownRelations:
    """Answers with the relations of a table (edge_type, from_text, to_text, explanation) whose ends are both among the entities."""

    def __init__(self, known: DataFrame) -> None:
        self.known = known

    def relate(self, inputs: DataFrame) -> DataFrame:
        each = inputs.select("window", "edge_type", F.explode("entities").alias("text"))
        a = each.select("window", "edge_type", F.col("text").alias("from_text"))
        b = each.select("window", "edge_type", F.col("text").alias("to_text"))
        return self.known.where("from_text <> to_text").join(a, ["edge_type", "from_text"]).join(b, ["window", "edge_type", "to_text"]).select("window", "edge_type", "from_text", "to_text", F.coalesce("explanation", F.lit("")).alias("explanation"))


def relation_inputs(windows: DataFrame, mentions: DataFrame, types: DataFrame) -> DataFrame:
    """window, edge_type, text, entities: a call for each window with two entities or more and each edge type (a short list)."""
    held = mentions.groupBy("window").agg(F.array_sort(F.collect_set("text")).alias("entities")).where(F.size("entities") >= 2)
    each = F.array(*(F.lit(r["edge_type"]) for r in types.select("edge_type").distinct().orderBy("edge_type").collect()))
    return windows.join(held, "window").select("window", F.explode(each).alias("edge_type"), "text", "entities")


class Labels(Protocol):
    def label(self, groups: DataFrame) -> DataFrame:
        """root, label out of root and texts."""


class FirstText:
    """The only text of a group, else its first."""

    def label(self, groups: DataFrame) -> DataFrame:
        return groups.select("root", F.get("texts", F.lit(0)).alias("label"))


class Embedder(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """id, v (array of float) out of id and text."""


class KnownVectors:
    """Vectors that are at hand, by id."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.select("id").join(self.vectors.select("id", "v"), "id")


def vectors_of(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors asked for, each once."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi")


def conflicts(spans: DataFrame, chunks: DataFrame, choices: DataFrame) -> DataFrame:
    """chunk, s, e, type, text: one span of each group of overlapping ones (those that start before the end of the group's first).

    choices: chunk, text (what a group covers), type. A group takes the first span of the chosen type, else its first one."""
    row = "struct<s:int,neg:int,e:int,type:string,text:string>"
    rows = F.array_sort(F.collect_set(F.struct(F.col("s").cast("int").alias("s"), (F.col("s") - F.col("e")).cast("int").alias("neg"), F.col("e").cast("int").alias("e"), "type", "text")))
    empty = F.array().cast(f"array<array<{row}>>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (x["s"] < F.get(last, F.lit(0))["e"])
        return F.when(joins, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(a, F.array(F.array(x))))

    groups = spans.groupBy("chunk").agg(rows.alias("rows")).select("chunk", F.explode(F.aggregate("rows", empty, lambda a, x: F.when(F.size(a) == 0, F.array(F.array(x))).otherwise(step(a, x)))).alias("g"))
    head = F.get("g", F.lit(0))
    groups = groups.join(chunks.select("chunk", "content"), "chunk").withColumn("covers", F.expr("substring(content, g[0].s + 1, array_max(transform(g, x -> x.e)) - g[0].s)")).drop("content")
    chosen = first_wins(choices.select("chunk", F.col("text").alias("covers"), F.col("type").alias("wanted")), ["chunk", "covers"], ["wanted"])
    found = groups.join(chosen, ["chunk", "covers"], "left")
    pick = F.coalesce(F.get(F.filter("g", lambda x: x["type"] == F.col("wanted")), F.lit(0)), head)
    return found.select("chunk", F.when(F.size("g") > 1, pick).otherwise(head).alias("x")).select("chunk", "x.s", "x.e", "x.type", "x.text")

"""Mentions: occurrences, overlaps, coreference, relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import near


#: Characters of a text by which chunks are found that may hold it.
GRAM = 6


def _grams(c: Column, q: int) -> Column:
    """All different stretches of q characters, by one pass of a pattern that takes none of them away."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def holding(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """chunk, version (the content's hash), text: which chunk may hold which text, without looking for each text in each chunk.

    A text is sought by that one of its stretches of GRAM characters (of all its characters, if it has fewer) that stands in the fewest
    chunks; a text none of whose stretches stands anywhere is dropped there. An equal join on stretches finds the chunks."""
    texts = texts.select("text").where("text <> ''").distinct().withColumn("q", F.least(F.length("text"), F.lit(GRAM)))
    sizes = [r["q"] for r in texts.select("q").distinct().collect()]  # GRAM rows at most
    each = lambda df, c, by: df.withColumn("gram", F.explode(F.flatten(F.array(*(F.when(F.lit(True) if by is None else F.col(by) == q, _grams(F.col(c), q)).otherwise(F.array().cast("array<string>")) for q in sizes)))))
    if not sizes:
        return chunks.select("chunk", F.xxhash64("content").alias("version"), F.lit("").alias("text")).limit(0)
    sought = each(texts, "text", "q").select("text", "gram")
    rows = chunks.select("chunk", "content").where("content <> ''").distinct()
    stand = each(rows, "content", None).select("chunk", F.xxhash64("content").alias("version"), "gram").join(sought.select("gram").distinct(), "gram", "left_semi")
    often = stand.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a stretch that stands nowhere rules its text out
    rare = sought.join(often, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("text", F.col("x.gram").alias("gram"))
    return stand.join(rare, "gram").select("chunk", "version", "text")


def find_spans(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """chunk, text, type, s, e: occurrences that do not overlap of each text in each chunk, leftmost first, by code point.

    Any number of texts may be sought. Nulls and empty texts and contents are found nowhere; repeated chunks each have their own
    occurrences, repeated texts count once for each type."""
    own = chunks.select("chunk", "content", F.xxhash64("content").alias("version"))
    kinds = texts.select("text", "type").distinct()
    held = holding(chunks, texts)
    same = own["chunk"].eqNullSafe(held["chunk"]) & (own["version"] == held["version"])
    cand = own.join(held, same).select(own["chunk"], "content", "text").where(F.contains("content", F.col("text"))).join(kinds, "text")
    gaps = F.split("content", F.regexp_replace("text", r"([^\p{L}\p{N}])", r"\\$1"), -1)
    # lengths only: places are running sums of the gaps' lengths and the text's own
    df = cand.select("chunk", "text", "type", F.transform(gaps, F.length).alias("gaps"))
    step = lambda a, g: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), -F.length("text")) + F.length("text") + g))
    starts = F.aggregate(F.slice("gaps", 1, F.size("gaps") - 1), F.array().cast("array<int>"), lambda a, g: step(a, g))
    df = df.select("chunk", "text", "type", F.explode(starts).alias("s"))
    return df.select("chunk", "text", "type", "s", (F.col("s") + F.length("text")).alias("e"))


def without_overlaps(spans: DataFrame, key: str = "chunk") -> DataFrame:
    """Spans kept greedily: earliest start first, the longer of equal starts, each starting at or after the last one's end."""
    rows = F.array_sort(F.collect_set(F.struct("s", (F.col("s") - F.col("e")).alias("neg"), "e", "type", "text")))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<s:int,neg:int,e:int,type:string,text:string>>").alias("out"))
    fold = F.aggregate("rows", start, lambda a, x: F.when(x["s"] >= a["end"], F.struct(x["e"].alias("end"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
    out = spans.withColumns({"s": F.col("s").cast("int"), "e": F.col("e").cast("int")}).groupBy(key).agg(rows.alias("rows"))
    return out.select(key, F.explode(fold).alias("x")).select(key, "x.s", "x.e", "x.type", "x.text")


def snippet(content: str = "content", s: str = "s", e: str = "e", around: int = 80):  # noqa: ANN201
    start = F.greatest(F.lit(0), F.coalesce(F.col(s), F.lit(0)) - around)
    end = F.least(F.length(content), F.coalesce(F.col(e), F.length(content)) + around)
    return F.substr(F.col(content), start + 1, end - start)


def coreference_edges(mentions: DataFrame, share: float = 0.3) -> DataFrame:
    """doc, u, v: mentions (id, doc, type, text) of one document and type with equal texts or, from three characters on, similar ones.

    Distinct texts are compared, within document and type, as far as they share a piece (see similarity); mentions with equal
    texts hang on the first of them. u's text comes first by the alphabet."""
    texts = mentions.groupBy("doc", "type", "text").agg(F.min("id").alias("id"))
    pairs = near(texts.where(F.length("text") >= 3), ["doc", "type"], share)
    pairs = pairs.select("doc", F.when(F.col("a") < F.col("b"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("a") < F.col("b"), F.col("v")).otherwise(F.col("u")).alias("v"))
    same = mentions.join(texts.withColumnRenamed("id", "first"), ["doc", "type", "text"]).where("id <> first").select("doc", F.col("first").alias("u"), F.col("id").alias("v"))
    return pairs.unionByName(same)


def parents(mentions: DataFrame, roots: DataFrame) -> DataFrame:
    """root, doc, type, label, members: groups of two or more; the label is the only text, else the first one's."""
    m = mentions.join(roots, mentions["id"] == roots["v"]).groupBy("root").agg(F.min("doc").alias("doc"), F.min_by("type", "id").alias("type"), F.min_by("text", "id").alias("label"), F.count(F.lit(1)).alias("members"))
    return m.where("members >= 2").select(F.col("root"), "doc", "type", "label", "members")


def relate(windows: DataFrame, mentions: DataFrame, replies: DataFrame) -> DataFrame:
    """from_id, to_id, edge_type, explanation: replies (window, from_text, to_text, edge_type, explanation) as edges between
    the mentions (window, id, text) of their window, without self-pairs, the first of equal edges."""
    m = mentions.join(windows.select("window"), "window", "left_semi")
    f = m.select("window", F.col("text").alias("from_text"), F.col("id").alias("from_id"))
    t = m.select("window", F.col("text").alias("to_text"), F.col("id").alias("to_id"))
    e = replies.where("from_text <> to_text").join(f, ["window", "from_text"]).join(t, ["window", "to_text"]).where("from_id <> to_id")
    nth = F.row_number().over(Window.partitionBy("from_id", "to_id", "edge_type").orderBy("window", F.coalesce("explanation", F.lit(""))))
    return e.withColumn("n", nth).where("n = 1").select("from_id", "to_id", "edge_type", F.coalesce("explanation", F.lit("")).alias("explanation"))


def promote(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """from_root, to_root, edge_type: edges between merged entities (parent, or the mention itself), without loops and repeats."""
    root = entities.select("id", F.coalesce("parent", "id").alias("root"))
    e = edges.join(root.select(F.col("id").alias("from_id"), F.col("root").alias("from_root")), "from_id").join(root.select(F.col("id").alias("to_id"), F.col("root").alias("to_root")), "to_id")
    return e.where("from_root <> to_root").select("from_root", "to_root", "edge_type").distinct()


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with one end or both among ids, each once."""
    by = lambda c: edges.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    return by("from_id").unionByName(by("to_id")).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    return edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def delete_entity(entities: DataFrame, edges: DataFrame, ident: int) -> tuple[DataFrame, DataFrame]:
    """What is left after an entity's group is removed: its root, all children, and every edge that touches them."""
    root = entities.where(F.col("id") == ident).select(F.coalesce("parent", "id").alias("root"))
    gone = entities.join(root, F.coalesce(entities["parent"], entities["id"]) == root["root"], "left_semi").select("id")
    left = entities.join(gone, "id", "left_anti")
    keep = edges.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return left, keep


def distance(a: Column, b: Column) -> Column:
    """Edit distance as a share of the longer text's length; 0 for two empty ones."""
    return F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def distances(texts: DataFrame, group: list[str]) -> DataFrame:
    """a, b, distance: every ordered pair of texts that stand in one group (text and the group's columns), once, with the share of edits between them.

    Texts that repeat in a group count once before they meet, and pairs that repeat between groups before they are compared, each in one
    direction alone: what is compared grows with different texts, not with rows. Null groups hold nothing; a null text has no distance."""
    own = texts.select(*group, "text").dropna(subset=group).distinct()
    met = own.withColumnRenamed("text", "a").join(own.withColumnRenamed("text", "b"), group)
    # each pair is there in both directions, as is a null text's
    one = met.where((F.col("a") <= F.col("b")) | F.col("a").isNull()).select("a", "b").distinct()
    far = one.withColumn("distance", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), distance(F.col("a"), F.col("b"))))
    back = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return far.select(F.explode(back).alias("x"), "distance").select("x.a", "x.b", "distance")

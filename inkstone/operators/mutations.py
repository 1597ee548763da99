"""Changes as functions from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import first_wins


def refresh_dictionary(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, definition, change: insert, update (the definition differs), touch (it does not) or keep (no longer in the source).

    Entries that repeat a key in the new snapshot: the smallest definition counts."""
    new = first_wins(new, key, ["definition"])
    o = old.select(*key, F.col("definition").alias("was"), F.lit(True).alias("in_old"))
    n = new.select(*key, F.col("definition").alias("now"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "keep").when(F.col("was").eqNullSafe(F.col("now")), "touch").otherwise("update")
    return o.join(n, key, "full_outer").select(*key, F.when(F.col("in_new"), F.col("now")).otherwise(F.col("was")).alias("definition"), change.alias("change"))


def lexicon(events: DataFrame) -> DataFrame:
    """term, learn_count, fail_count, first_learned, last_learned, last_failed out of events (term, kind, ts).

    Fails before a term was first learned do not count."""
    first = events.where("kind = 'learn'").groupBy("term").agg(F.min("ts").alias("first_learned"), F.max("ts").alias("last_learned"), F.count(F.lit(1)).alias("learn_count"))
    fails = events.where("kind = 'fail'").join(first.select("term", "first_learned"), "term").where("ts >= first_learned").groupBy("term").agg(F.count(F.lit(1)).alias("fail_count"), F.max("ts").alias("last_failed"))
    return first.join(fails, "term", "left").withColumn("fail_count", F.coalesce("fail_count", F.lit(0).cast("long")))


def set_preferences(current: dict, change: dict, defaults: dict) -> dict:
    """Defaults, then what is stored, then the change; unset fields fall through."""
    return defaults | {k: v for k, v in current.items() if v is not None} | {k: v for k, v in change.items() if v is not None}


def expire(accounts: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Accounts that have not expired."""
    return accounts.where(F.col("created") + F.expr(f"INTERVAL {hours} HOURS") > F.to_timestamp(F.lit(now)))


def orphaned_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Merged entities whose last child has gone."""
    return parents.join(children.select(F.col("parent").alias("id")), "id", "left_anti")


def affected_chunks(entities: DataFrame, ident: int) -> DataFrame:
    """chunk: where a preferred translation of an entity shows: the chunks of its group's members, else its own."""
    root = entities.where(F.col("id") == ident).select(F.col("parent").alias("p"), F.col("id").alias("i"))
    hit = entities.join(F.broadcast(root), F.when(F.col("p").isNotNull(), entities["parent"] == F.col("p")).otherwise(entities["id"] == F.col("i")))
    return hit.where("chunk IS NOT NULL").select("chunk").distinct()


FOLDER_TYPES = ("book", "series", "collection")


def folder_error(kind: Column, name: Column) -> Column:
    """What is wrong with a folder's type or name; null if nothing is."""
    return F.when(kind.isNull() | ~kind.isin(*FOLDER_TYPES), "type").when(F.coalesce(F.trim(name), F.lit("")) == "", "name")


def put_types(types: DataFrame, changes: DataFrame) -> DataFrame:
    """Ontology types (name, definition, reverse_name) after changes (the same, and seq); names and reverse names trimmed, blank
    ones of which are null. The last change of a name counts; a null definition deletes it. A blank name is an error."""
    clean = changes.select(F.trim("name").alias("name"), "definition", F.when(F.trim("reverse_name") != "", F.trim("reverse_name")).alias("reverse_name"), "seq")
    clean = clean.withColumn("name", F.when(F.coalesce("name", F.lit("")) == "", F.raise_error(F.lit("a type needs a name"))).otherwise(F.col("name")))
    last = first_wins(clean.withColumn("seq", -F.col("seq")), ["name"], ["seq"]).drop("seq")
    return types.join(last, "name", "left_anti").unionByName(last.where("definition IS NOT NULL"))


def same_list(a: Column, b: Column) -> Column:
    """Whether two ordered lists are equal; null is the empty list."""
    none = F.array().cast("array<string>")
    return F.coalesce(a, none) == F.coalesce(b, none)


def last_change(changes: DataFrame) -> DataFrame:
    """One row for each id: the change with the largest seq, if there is a column seq; of equal ones the smallest by its other columns."""
    rest = [c for c in changes.columns if c not in ("id", "seq")]
    order = [-F.col("seq")] if "seq" in changes.columns else []
    first = changes.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *rest)).alias("x"))
    return first.select("id", *(F.col(f"x.{c}").alias(c) for c in rest))


def rename_folders(folders: DataFrame, names: DataFrame) -> DataFrame:
    """folders (id, name, ...) with the trimmed new names (id, name, seq if there are several for an id; the last counts); blank ones change nothing.

    Folders keep all their columns, whatever their names."""
    new = last_change(names.where(F.trim("name") != "").withColumn("name", F.trim("name"))).alias("new")
    out = folders.alias("old").join(new, F.col("old.id") == F.col("new.id"), "left")
    return out.select(*(F.coalesce("new.name", "old.name").alias(c) if c == "name" else F.col(f"old.`{c}`") for c in folders.columns))


def move_documents(documents: DataFrame, moves: DataFrame, folders: DataFrame) -> DataFrame:
    """documents (id, parent, ...) after moves (id, target, seq if there are several for an id; the last that can be made counts): null is the root;
    a target that is no folder changes nothing. Documents keep all their columns, whatever their names."""
    known = folders.select(F.col("id").alias("target")).distinct()
    ok = moves.join(known, "target", "left_semi").unionByName(moves.where("target IS NULL"))
    new = last_change(ok.select("id", "target", *(["seq"] if "seq" in moves.columns else []))).withColumn("moves", F.lit(True)).alias("new")
    out = documents.alias("old").join(new, F.col("old.id") == F.col("new.id"), "left")
    to = F.when(F.col("new.moves"), F.col("new.target")).otherwise(F.col("old.parent"))
    return out.select(*(to.alias(c) if c == "parent" else F.col(f"old.`{c}`") for c in documents.columns))


def touch(documents: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """documents with last_accessed set for some ids."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    out = documents.join(hit, "id", "left")
    return out.withColumn("last_accessed", F.when(F.col("_hit"), F.to_timestamp(F.lit(now))).otherwise(F.col("last_accessed"))).select(*documents.columns)


def tagged_lexicon(events: DataFrame) -> DataFrame:
    """lexicon with tags (a list out of the `;`-joined `tags` of events): those of the first learning, or of the last `tags` event after it."""
    first = events.where("kind = 'learn'").groupBy("term").agg(F.min("ts").alias("_first"), F.min_by("tags", "ts").alias("_tags"))
    later = events.where("kind = 'tags'").join(first.select("term", "_first"), "term").where("ts >= _first").groupBy("term").agg(F.max_by("tags", "ts").alias("_later"), F.lit(True).alias("_set"))
    tags = first.join(later, "term", "left").select("term", F.when(F.col("_set"), F.col("_later")).otherwise(F.col("_tags")).alias("t"))
    return lexicon(events).join(tags.select("term", F.filter(F.split(F.coalesce("t", F.lit("")), ";"), lambda x: x != "").alias("tags")), "term")


def manual_entity(chunks: DataFrame, mentions: DataFrame, chunk: int, text: str, kind: str) -> DataFrame:
    """mentions (chunk, text, type, s, e) with one more for each place of a text in a chunk; none is an error."""
    from .spans import find_spans

    if not text.strip() or not kind.strip():
        raise ValueError("text and type are needed")
    one = chunks.sparkSession.createDataFrame([(text, kind)], "text string, type string")
    found = find_spans(chunks.where(F.col("chunk") == chunk), one).select("chunk", "text", "type", "s", "e")
    if found.isEmpty():
        raise ValueError("the text does not stand in the chunk")
    return mentions.select("chunk", "text", "type", "s", "e").unionByName(found)


def promoted(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities (id, type, text, parent) and edges between documents' entities (from_root, to_root, edge_type).

    Each end of an edge that has no parent gets one of its own, numbered after the largest id by the order of ids: of its type,
    labelled by its text. Loops and repeats are left out. Numbers need one pass over new parents alone."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    lone = entities.where("parent IS NULL").join(ends, "id", "left_semi")
    top = entities.agg(F.max(F.greatest("id", F.coalesce("parent", "id"))).alias("top")).first()["top"] or 0
    # a running number over blocks: each block's rows are numbered by themselves, after those of the blocks before it
    block = lone.select("id", F.floor(F.col("id") / 4096).alias("block"))
    before = block.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = block.join(before, "block").select("id", (F.lit(top) + F.col("n") + F.row_number().over(Window.partitionBy("block").orderBy("id"))).alias("new"))
    out = entities.join(number, "id", "left").withColumn("parent", F.coalesce("parent", "new"))
    root = out.select("id", F.coalesce("parent", "id").alias("root"))
    e = edges.join(root.select(F.col("id").alias("from_id"), F.col("root").alias("from_root")), "from_id").join(root.select(F.col("id").alias("to_id"), F.col("root").alias("to_root")), "to_id")
    parents = out.where("new IS NOT NULL").select(F.col("new").alias("id"), "type", "text", F.lit(None).cast("long").alias("parent"))
    return out.drop("new").unionByName(parents), e.where("from_root <> to_root").select("from_root", "to_root", "edge_type").distinct()

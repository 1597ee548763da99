"""Queries over tables on disk: snapshots of which a change rewrites its own part alone, drafts of which a stage reads those before it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafting, graph, layout, mutations, providers, search
from ..operators.coreference import Merged
from ..operators.inverted import RangeIndex
from ..operators.snapshots import Snapshot
from .catalog import _MENT, _ROOTS, entries, mentions, query, read
from .more import _ANY, _HAS, _PRE

# ---- the dictionary's snapshot ------------------------------------------------------------------------------------------

_PARTS = "o AS (SELECT p_partkey, p_type FROM part WHERE p_partkey % 11 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_type || '!' ELSE p_type END AS p_type FROM part WHERE p_partkey % 10 <> 0)"
_NOW = f"""{_PARTS}, e AS (SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN o.p_type ELSE n.p_type END AS definition,
CASE WHEN o.p_partkey IS NULL OR o.p_type <> n.p_type THEN 2 ELSE 1 END AS written, CASE WHEN n.p_partkey IS NULL THEN 2 END AS gone FROM o FULL JOIN n ON o.p_partkey = n.p_partkey)"""


def _refreshed(s, d) -> Snapshot:
    p = read(s, d, "part").select("p_partkey", F.col("p_type").alias("definition"))
    out = Snapshot(graph.scratch(s), ("p_partkey",), ("definition",), ("definition",), buckets=64)
    out.create(p.where("p_partkey % 11 <> 0"))
    out.refresh(p.where("p_partkey % 10 <> 0").withColumn("definition", F.when(F.col("p_partkey") % 7 == 0, F.concat("definition", F.lit("!"))).otherwise(F.col("definition"))), 2)
    return out


@query("MU1_stored_snapshot", f"WITH {_NOW} SELECT * FROM e")
def _(s, d):
    return _refreshed(s, d).entries(s).drop("bucket")


@query("MU1_stored_postings", f"WITH {_NOW} SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(definition), '[\\p{{L}}\\p{{N}}]+')) AS token FROM e")
def _(s, d):
    return _refreshed(s, d).postings(s).select("p_partkey", "token")


@query("SRC12_stored_upsert", """WITH n AS (SELECT c_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS label FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(vec_id, id) AS id, CASE WHEN id IS NULL THEN e.label::VARCHAR ELSE n.label END AS label, CASE WHEN id IS NULL OR e.label::VARCHAR IS NOT DISTINCT FROM n.label THEN 1 ELSE 2 END AS written FROM embeddings e FULL JOIN n ON vec_id = id""")
def _(s, d):
    out = Snapshot(graph.scratch(s), ("id",), ("label",), buckets=64)
    out.create(read(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label")))
    new = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out.upsert(new.select(F.col("c_custkey").cast("long").alias("id"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("seq")), 2)
    return out.entries(s).select("id", "label", "written")


# ---- postings in files of token ranges --------------------------------------------------------------------------------------

def _indexed(s, d) -> RangeIndex:
    out = RangeIndex(graph.scratch(s))
    out.write(entries(s, d), files=32)
    return out


@query("FTS4_range_files", f"SELECT p_partkey AS id FROM part WHERE ({_HAS('p_type', 'economy')} AND NOT {_ANY('widget')}) OR {_ANY('promo')} OR {_PRE('smal')} ORDER BY length(p_name), p_name, p_partkey LIMIT 200")
def _(s, d):
    return search.search(entries(s, d), definition="economy NOT widget OR promo OR smal", limit=200, index=_indexed(s, d)).select("id")


@query("FTS1_stored_tokens", f"WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+')) AS token FROM part) SELECT token, count(DISTINCT p_partkey) AS entries FROM t WHERE starts_with(token, 'b') OR token = 'red' GROUP BY 1")
def _(s, d):
    terms = [search.Term("b", True, ()), search.Term("red", False, ())]
    rows = _indexed(s, d).holding(s, terms).where("col = 'simplified' AND (startswith(token, 'b') OR token = 'red')")
    return rows.groupBy("token").agg(F.count_distinct("id").alias("entries"))


# ---- merged entities after a manual one ----------------------------------------------------------------------------------

#: One mention more, in document 3, with the name that the document's first mention has.
_MORE = "m AS (SELECT p_partkey AS id, p_size % 10 AS doc, p_name AS text FROM part UNION ALL SELECT 100000000, 3, arg_min(p_name, p_partkey) FROM part WHERE p_size % 10 = 3)"
_ALL = f"""WITH RECURSIVE {_ROOTS.replace(_MENT, _MORE)}, k AS (SELECT root, count(*) AS n, min(doc) AS doc, arg_min(text, id) AS label FROM g JOIN m ON m.id = g.v GROUP BY root),
e AS (SELECT m.id, m.doc, CASE WHEN n >= 2 THEN -root END AS parent FROM m JOIN g ON g.v = m.id JOIN k USING (root))"""
_PAIRS = "x2 AS (SELECT DISTINCT p.p_size % 10 AS doc, a.l_partkey AS from_id, b.l_partkey AS to_id, a.l_returnflag AS edge_type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey WHERE p.p_size % 10 = q.p_size % 10 UNION ALL SELECT 3, 100000000, min(p_partkey), 'NEW' FROM part WHERE p_size % 10 = 3)"


def _pairs(s, d):
    """Parts of one document on neighbouring lines of an order."""
    li = read(s, d, "lineitem")
    doc = read(s, d, "part").select("p_partkey", (F.col("p_size") % 10).alias("doc"))
    a = li.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("from_id"), F.col("l_returnflag").alias("edge_type")).join(doc.withColumnRenamed("p_partkey", "from_id"), "from_id")
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("to_id")).join(doc.withColumnRenamed("p_partkey", "to_id"), "to_id")
    return a.join(b, ["l_orderkey", "n", "doc"]).select("doc", "from_id", "to_id", "edge_type").distinct()


def _changed(s, d) -> Merged:
    out = Merged(graph.scratch(s), buckets=16)
    m = mentions(s, d)
    out.create(m, _pairs(s, d))
    first = m.where("doc = 3").groupBy("doc").agg(F.min("id").alias("first"), F.min_by("text", "id").alias("text"))
    new = first.select(F.lit(100000000).cast(m.schema["id"].dataType).alias("id"), "doc", F.lit("N").alias("type"), "text")
    edge = first.select("doc", F.lit(100000000).cast(m.schema["id"].dataType).alias("from_id"), F.col("first").alias("to_id"), F.lit("NEW").alias("edge_type"))
    out.change(s, [3], new, edge)
    return out


@query("MU8_merged_again", f"{_ALL} SELECT id, doc, parent, NULL::VARCHAR AS label FROM e UNION ALL SELECT -root, doc, NULL, label FROM k WHERE n >= 2")
def _(s, d):
    return _changed(s, d).read(s, "entities").select("id", "doc", "parent", "label")


@query("MU8_document_edges", f"{_ALL}, {_PAIRS} SELECT DISTINCT x2.doc, coalesce(a.parent, a.id) AS from_root, coalesce(b.parent, b.id) AS to_root, edge_type FROM x2 JOIN e a ON a.id = from_id JOIN e b ON b.id = to_id WHERE coalesce(a.parent, a.id) <> coalesce(b.parent, b.id)")
def _(s, d):
    return _changed(s, d).read(s, "document_edges").select("doc", "from_root", "to_root", "edge_type")


# ---- drafts ----------------------------------------------------------------------------------------------------------------

def _turns(s, d):
    """Turns as chunks of their conversation; like a turn are the next turn and those at its place in the four next conversations."""
    c = read(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("position"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk"), F.col("text").alias("content"))
    steps = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(k).alias("k")) for r, k in enumerate((1, 100, 200, 300, 400))))
    return c, c.select("chunk", F.explode(steps).alias("x")).select("chunk", (F.col("chunk") + F.col("x.k")).alias("other"), "x.rank")


def _sections(*parts: tuple[str, str]) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN {c} <> '' THEN '{t}:' || chr(10) || {c} END" for t, c in parts) + ")"


def _beside(name: str, of: str, value: str) -> str:
    side = lambda test: f"coalesce(string_agg(b.{value}, chr(10) ORDER BY o.position) FILTER (WHERE b.{value} <> '' AND o.position {test} a.position), '')"
    return f"{name} AS (SELECT a.chunk, {side('<')} AS before, {side('>')} AS after FROM c a LEFT JOIN c o ON o.doc = a.doc AND o.position BETWEEN a.position - 2 AND a.position + 2 LEFT JOIN {of} b ON b.chunk = o.chunk GROUP BY 1)"


_FAR = "w AS (SELECT a.chunk, a.chunk + k AS other, r AS rank FROM c a, (VALUES (0, 1), (1, 100), (2, 200), (3, 300), (4, 400)) v(r, k)), f AS (SELECT w.*, row_number() OVER (PARTITION BY w.chunk ORDER BY w.rank, w.other) AS n FROM w JOIN c a ON a.chunk = w.chunk JOIN c b ON b.chunk = w.other WHERE NOT (a.doc = b.doc AND abs(a.position - b.position) <= 2))"


def _shown(name: str, drafts: str) -> str:
    return f"{name} AS (SELECT f.chunk, string_agg(c.content || ' → ' || t.content, chr(10) ORDER BY f.rank) AS examples FROM f JOIN c ON c.chunk = f.other JOIN {drafts} t ON t.chunk = f.other WHERE n <= 3 GROUP BY 1)"


_HEAD = (("Before", "a.before"), ("Text", "c.content"), ("After", "a.after"), ("Similar passages", "x.examples"))
_JOINS = "FROM c LEFT JOIN a USING (chunk) LEFT JOIN {} x USING (chunk)"
#: The stages one after the other; a draft's chunk has every later draft too, as these texts are not blank.
_STAGES = f"""WITH c AS (SELECT conv_id AS doc, turn AS position, conv_id * 100 + turn AS chunk, coalesce(text, '') AS content FROM conversations), {_beside('a', 'c', 'content')}, {_FAR},
d0 AS (SELECT chunk, trim(content) AS content FROM c WHERE trim(content) <> ''), {_shown('x0', 'd0')},
d1 AS (SELECT c.chunk, sha256({_sections(*_HEAD, ("Machine translation", "d0.content"))}) AS content {_JOINS.format('x0')} LEFT JOIN d0 USING (chunk)), {_shown('x1', 'd1')},
d2 AS (SELECT c.chunk, sha256({_sections(*_HEAD)}) AS content {_JOINS.format('x1')}), {_shown('x2', 'd2')}, {_beside('b', 'd2', 'content')},
d3 AS (SELECT c.chunk, sha256({_sections(*_HEAD, ("Drafts before", "b.before"), ("Drafts after", "b.after"), ("Draft", "d2.content"))}) AS content {_JOINS.format('x2')} LEFT JOIN b USING (chunk) LEFT JOIN d2 USING (chunk))"""


def _drafted(s, d):
    c, like = _turns(s, d)
    return drafting.draft_all(c, like, providers.Echo(), drafting.Fingerprint())


@query("ML5_draft_stages", f"{_STAGES} SELECT chunk, -1 AS draft_number, 'mt:echo' AS translator, content FROM d0 UNION ALL SELECT chunk, 0, 'ai:fingerprint', content FROM d1 UNION ALL SELECT chunk, 1, 'ai:fingerprint', content FROM d2 UNION ALL SELECT chunk, 2, 'ai:fingerprint', content FROM d3")
def _(s, d):
    return _drafted(s, d)


@query("ML5_retranslation", f"""{_STAGES}, {_shown('x3', 'd3')}, h AS (SELECT conv_id * 100 + turn AS chunk FROM conversations WHERE role = (SELECT arg_min(role, conv_id * 100 + turn) FROM conversations))
SELECT c.chunk, 3 AS draft_number, 'ai:fingerprint' AS translator, sha256({_sections(*_HEAD, ("Draft", "d3.content"))} || chr(10) || chr(10) || 'Chosen translations:' || chr(10) || '「role」 → "part"') AS content {_JOINS.format('x3')} LEFT JOIN d3 USING (chunk) SEMI JOIN h ON h.chunk = c.chunk""")
def _(s, d):
    c, like = _turns(s, d)
    # a mention in each turn, merged by role; the translation of the first one's entity is chosen
    turns = read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk"), F.xxhash64("role").alias("parent"))
    first = turns.agg(F.min("chunk")).first()[0]
    hit = mutations.affected_chunks(turns.withColumn("id", F.col("chunk")), first)
    terms = hit.select("chunk", F.lit("role").alias("text"), F.lit("part").alias("translation"))
    return drafting.retranslate(c, _drafted(s, d), like, terms, drafting.Fingerprint())


# ---- the map of neighbours ---------------------------------------------------------------------------------------------------

@query("VZ1_library_map")
def _(s, d):
    """Vectors as passages of the documents that their labels name."""
    v = read(s, d, "embeddings").select(F.coalesce(F.col("label").cast("long"), F.lit(0)).alias("doc"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("v"))
    return layout.library_map(v)

"""Further queries by name, each with the SQL that gives the same rows: structure files, ontology and folder changes, displays, model inputs."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import pinyin as P
from ..functions import text as T
from ..operators import graph, mutations, providers, reading, search, spans, structures
from ..sources import files
from .catalog import _EDGES, _MENT, _SPANS, _chunk_docs, _mentions, edges, entries, mentions, query, read, sql_values, values

# ---- structure files ----------------------------------------------------------------------------------------------------

#: Lines of a decomposition file: atomic characters, variants, tags, strokes without a code point, an unusual variant, a cycle.
IDS_FILE = [
    "# comment", "U+4E00\t一\t一", "U+4E85\t亅\t亅", "U+4E28\t丨\t丨", "U+4E01\t丁\t⿱一亅", "U+53E3\t口\t口", "U+4E94\t五\t五", "U+543E\t吾\t⿱五口", "U+8A00\t言\t言",
    "U+8A9E\t語\t⿰言吾", "U+65E5\t日\t日", "U+6708\t月\t月", "U+660E\t明\t⿰日月[G]\t⿰囧月[J]", "U+6728\t木\t木", "U+5C11\t少\t⿱小丿[O]\t⿱小丿[GO]", "U+1B0A6\t𛂦\t⿰木𛂦", "U+76DF\t盟\t⿱明皿",
    "U+8857\t街\t⿲彳⿱土土亍", "U+4E0E\t与\t⿹②一[GTKV]\t⿻②一[J]", "U+571F\t土\t土", "U+5733\t圳\t⿰土⿲③丨丨", "U+3403\t㐃\t㐄", "", "U+4E02\tx",
]


def _chars(s):
    return structures.characters(files.parse_decompositions(values(s, "value string", [(x,) for x in IDS_FILE])))


_LINES = [tuple(x.split("\t")[:2]) + ("|".join(x.split("\t")[2:]),) for x in IDS_FILE if x.count("\t") > 1]
_IDS_SQL = f"""f AS (SELECT * FROM ({sql_values(_LINES)}) v(codepoint, character, cells)),
a AS (SELECT codepoint, character, list_filter(string_split(cells, '|'), lambda x: regexp_replace(x, '\\[[A-Z]+\\]$', '') <> character) AS v FROM f),
u AS (SELECT codepoint, character, unnest(CASE WHEN len(v) = 0 THEN [NULL] ELSE v END) AS raw, unnest(range(0, greatest(len(v), 1))) AS position FROM a),
chars AS (SELECT codepoint || ':' || position AS id, codepoint, character, regexp_replace(raw, '\\[[A-Z]+\\]$', '') AS ids,
  nullif(replace(regexp_extract(coalesce(raw, ''), '\\[([A-Z]+)\\]$', 1), 'O', ''), '') AS tags, contains(regexp_extract(coalesce(raw, ''), '\\[([A-Z]+)\\]$', 1), 'O') AS obsolete FROM u),
c AS (SELECT *, CASE WHEN NOT obsolete AND (ids IS NULL OR contains('⿰⿱⿲⿳⿴⿵⿶⿷⿸⿹⿺⿻', ids[1])) THEN id END AS root FROM chars)"""
#: Slots (parent, position) wait in a list; each character takes the first and an operator puts its own before the others.
_IDS_TREE = f"""{_IDS_SQL},
t AS (SELECT root, ids, 0 AS i, [{{'p': -1, 'k': 0}}] AS slots FROM c WHERE root IS NOT NULL AND ids IS NOT NULL
  UNION ALL SELECT root, ids, i + 1, list_concat(CASE WHEN contains('⿲⿳', ids[i + 1]) THEN [{{'p': i, 'k': 0}}, {{'p': i, 'k': 1}}, {{'p': i, 'k': 2}}] WHEN contains('⿰⿱⿴⿵⿶⿷⿸⿹⿺⿻', ids[i + 1]) THEN [{{'p': i, 'k': 0}}, {{'p': i, 'k': 1}}] ELSE [] END, slots[2:]) FROM t WHERE len(slots) > 0),
n AS (SELECT root, i, slots[1].p AS p, slots[1].k AS position, ids[i + 1] AS ch, CASE WHEN contains('⿰⿱⿲⿳⿴⿵⿶⿷⿸⿹⿺⿻', ids[i + 1]) THEN 'op' WHEN ids[i + 1] BETWEEN '①' AND '⑳' THEN 'unencoded' ELSE 'char' END AS kind,
  CASE WHEN i = 0 THEN root ELSE root || '/' || i END AS node, CASE WHEN slots[1].p = 0 THEN root ELSE root || '/' || slots[1].p END AS parent FROM t WHERE len(slots) > 0),
nodes AS (SELECT root AS node, CASE WHEN ids IS NULL THEN 'char' ELSE 'op' END AS kind, CASE WHEN ids IS NULL THEN character ELSE ids[1] END AS value FROM c WHERE root IS NOT NULL
  UNION ALL SELECT node, kind, CASE WHEN kind = 'op' THEN ch ELSE (unicode(ch) - 9311)::VARCHAR END FROM n WHERE i > 0 AND kind <> 'char'),
links AS (SELECT parent, node AS child, position FROM n WHERE i > 0 AND kind <> 'char' UNION SELECT parent, c.root, position FROM n JOIN c ON c.character = n.ch AND c.root IS NOT NULL WHERE i > 0 AND n.kind = 'char')"""


@query("ID2_characters", f"WITH {_IDS_SQL} SELECT id, character, ids, tags, obsolete, root FROM c")
def _(s, d):
    return _chars(s).drop("codepoint")


@query("ID2_nodes", f"WITH RECURSIVE {_IDS_TREE} SELECT node, kind, value FROM nodes")
def _(s, d):
    return structures.graph_of(_chars(s))[0]


@query("ID3_links", f"WITH RECURSIVE {_IDS_TREE} SELECT parent, child, position::INT AS position FROM links")
def _(s, d):
    return structures.graph_of(_chars(s))[1]


@query("MU2_replace", f"WITH {_IDS_SQL} SELECT id, root FROM c")
def _(s, d):
    path = graph.scratch(s)
    _chars(s).limit(3).write.parquet(path)
    _chars(s).write.mode("overwrite").parquet(path)
    return s.read.parquet(path).select("id", "root")


@query("AG12_representatives", f"WITH {_IDS_SQL} SELECT character, string_agg(root, ',' ORDER BY root) AS roots FROM c WHERE root IS NOT NULL GROUP BY 1")
def _(s, d):
    return structures.representatives(_chars(s)).select("character", F.array_join("roots", ",").alias("roots"))


@query("GR5_variants", f"WITH {_IDS_SQL} SELECT id, codepoint, ids, tags, root FROM c WHERE character = '与' AND NOT obsolete ORDER BY id")
def _(s, d):
    return structures.variants(_chars(s), "与")


@query("GR2_containers_of_a_file", f"WITH RECURSIVE {_IDS_TREE}, up AS (SELECT root AS node FROM c WHERE character = '口' AND root IS NOT NULL UNION SELECT parent FROM up JOIN links ON child = node) SELECT DISTINCT character FROM c WHERE root IN (SELECT node FROM up)")
def _(s, d):
    chars = _chars(s)
    return graph.containers(chars, structures.graph_of(chars)[1], "口")


@query("GR3_template_in_a_file", f"WITH RECURSIVE {_IDS_TREE}, up AS (SELECT l.parent AS node FROM links l JOIN nodes q ON q.node = l.child JOIN nodes p ON p.node = l.parent WHERE p.value = '⿱' AND l.position = 0 AND q.kind = 'char' AND q.value = '土' UNION SELECT parent FROM up JOIN links ON child = node) SELECT DISTINCT character FROM c WHERE root IN (SELECT node FROM up) ORDER BY 1")
def _(s, d):
    chars = _chars(s)
    nodes, links = structures.graph_of(chars)
    return graph.structure_search({"op": "⿱", "children": [{"char": "土"}, None]}, chars, nodes, links)


_TEMPLATES = [({"char": "口"}, True), ({"char": "口口"}, False), ({"op": "⿰", "children": [None, {"char": "木"}]}, True), ({"op": "x"}, False), (None, True), ({"op": "⿰", "char": "口"}, False)]


@query("GR4_validation", f"SELECT * FROM ({sql_values([(i, ok) for i, (_, ok) in enumerate(_TEMPLATES)])}) v(template, valid)")
def _(s, d):
    def valid(t) -> bool:
        try:
            graph.validate(t)
        except ValueError:
            return False
        return True

    return values(s, "template int, valid boolean", [(i, valid(t)) for i, (t, _) in enumerate(_TEMPLATES)])


# ---- search -----------------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_HAS = lambda c, t: f"len(list_filter({_TOK.format(c)}, lambda t: t = '{t}')) > 0"
_ANY = lambda t: "(" + " OR ".join(_HAS(c, t) for c in ("p_name", "p_brand", "p_type")) + ")"
_PRE = lambda t: "(" + " OR ".join(f"len(list_filter({_TOK.format(c)}, lambda t: starts_with(t, '{t}'))) > 0" for c in ("p_name", "p_brand", "p_type")) + ")"


@query("FTS4_operators", f"SELECT p_partkey AS id FROM part WHERE ({_HAS('p_type', 'economy')} AND NOT {_ANY('widget')}) OR {_ANY('promo')} OR {_PRE('smal')} ORDER BY length(p_name), p_name, p_partkey LIMIT 200")
def _(s, d):
    return search.search(entries(s, d), definition="economy NOT widget OR promo OR smal", limit=200).select("id")


@query("FTS4_stored_index", f"SELECT p_partkey AS id FROM part WHERE {_PRE('bl')} ORDER BY length(p_name), p_name, p_partkey LIMIT 50")
def _(s, d):
    path = graph.scratch(s)
    search.postings(entries(s, d)).write.parquet(path)
    return search.search(entries(s, d), "bl", index=s.read.parquet(path)).select("id")


_TYPED = [('a "b" (c)^ ', "a b c"), ("()", ""), ("  x y  ", "x y")]
_STARS = [("ma", "ma*"), ("ren5", "ren5*"), ("水 guo", "水 guo*"), ("水果", "水果"), ("12 34", "12 34*"), ("a1 b", "a1 b*")]


@query("FTS2_sanitise", f"SELECT * FROM ({sql_values(_TYPED)}) v(q, clean)")
def _(s, d):
    return values(s, "q string, clean string", [(q, search.sanitise(q)) for q, _ in _TYPED])


@query("FTS3_prefixes", f"SELECT * FROM ({sql_values(_STARS)}) v(q, expression)")
def _(s, d):
    return values(s, "q string, expression string", [(q, search.with_wildcards(q)) for q, _ in _STARS])


_CLIENT = [("water tone:3 Tone:9", "text=water tone=3"), ("strokes:4-6 def:big x y", "def=big strokes=4-6 text=x y"), ("component:口 component:木", "component=木"), ("a:b", "text=a:b")]


@query("FTS10_client_query", f"SELECT * FROM ({sql_values(_CLIENT)}) v(typed, parts)")
def _(s, d):
    return values(s, "typed string, parts string", [(q, " ".join(f"{k}={v}" for k, v in sorted(search.client_query(q).items()))) for q, _ in _CLIENT])


# ---- mentions and relations -------------------------------------------------------------------------------------------

_OVERLAPS = f"""{_SPANS},
o AS (SELECT chunk, s, (s + length(text))::INT AS e, type, text, row_number() OVER (PARTITION BY chunk ORDER BY s, length(text) DESC, type, text) AS k FROM (SELECT DISTINCT * FROM sp)),
r AS (SELECT chunk, k, s, e, type, text, k AS head, e AS until FROM o WHERE k = 1
      UNION ALL SELECT o.chunk, o.k, o.s, o.e, o.type, o.text, CASE WHEN o.s < r.until THEN r.head ELSE o.k END, CASE WHEN o.s < r.until THEN r.until ELSE o.e END FROM r JOIN o ON o.chunk = r.chunk AND o.k = r.k + 1)"""


@query("SP3_conflicts", f"""WITH RECURSIVE {_OVERLAPS},
h AS (SELECT chunk, head, min(s) AS gs, max(e) AS ge, count(*) AS n FROM r GROUP BY 1, 2),
w AS (SELECT h.*, CASE WHEN n > 1 AND substr(content, gs + 1, ge - gs) = 'then' AND chunk % 2 = 0 THEN 'b' END AS wanted FROM h JOIN c USING (chunk)),
p AS (SELECT r.*, row_number() OVER (PARTITION BY r.chunk, r.head ORDER BY CASE WHEN r.type = wanted THEN 0 ELSE 1 END, r.k) AS n FROM r JOIN w ON w.chunk = r.chunk AND w.head = r.head)
SELECT chunk, s, e, type, text FROM p WHERE n = 1""")
def _(s, d):
    chunks = _chunk_docs(s, d)
    choices = chunks.where("chunk % 2 = 0").select("chunk", F.lit("then").alias("text"), F.lit("b").alias("type"))
    return reading.conflicts(_mentions(s, d), chunks, choices)


@query("FN11_markup", f"""WITH RECURSIVE {_OVERLAPS}, k AS (SELECT chunk, s, e, type FROM r WHERE k = head),
p AS (SELECT chunk, s, e, type, lag(e, 1, 0) OVER (PARTITION BY chunk ORDER BY s) AS past FROM k),
m AS (SELECT chunk, string_agg(substr(content, past + 1, s - past) || '<span class="entity-underline" data-entity-id="' || s || '" title="' || type || ': x">' || substr(content, s + 1, e - s) || '</span>', '' ORDER BY s) AS t, max(e) AS last FROM p JOIN c USING (chunk) GROUP BY 1)
SELECT chunk, t || substr(content, last + 1) AS html FROM m JOIN c USING (chunk)""")
def _(s, d):
    kept = spans.without_overlaps(_mentions(s, d)).groupBy("chunk").agg(F.collect_list(F.struct("s", "e", F.col("s").alias("id"), F.concat("type", F.lit(": x")).alias("title"))).alias("spans"))
    return _chunk_docs(s, d).join(kept, "chunk").select("chunk", reading.marked(F.col("content"), F.col("spans")).alias("html"))


_TYPES = [("A", "after"), ("N", None)]


@query("FN10_relation_display", f"""WITH {_EDGES}, e AS (SELECT *, from_id * 1000000 + to_id * 10 AS edge FROM edges), t AS (SELECT * FROM ({sql_values(_TYPES)}) v(edge_type, reverse_name)), n AS (SELECT c_custkey AS id, c_name AS name FROM customer)
SELECT from_id AS entity, edge, e.edge_type AS label, coalesce(n.name, '?') AS other FROM e LEFT JOIN n ON n.id = to_id
UNION ALL SELECT to_id, edge, coalesce(reverse_name, '← ' || e.edge_type), coalesce(n.name, '?') FROM e LEFT JOIN t ON t.edge_type = e.edge_type LEFT JOIN n ON n.id = from_id""")
def _(s, d):
    e = edges(s, d).withColumn("edge", F.col("from_id") * 1000000 + F.col("to_id") * 10)
    names = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reading.relations(e, values(s, "edge_type string, reverse_name string", _TYPES), names)


@query("RL3_document_entities", f"""WITH {_EDGES}, c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 1000000 + c_nationkey END AS parent FROM customer),
ends AS (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges), top AS (SELECT max(greatest(id, coalesce(parent, id))) AS top FROM c),
fresh AS (SELECT id, top + row_number() OVER (ORDER BY id) AS new FROM c, top WHERE parent IS NULL AND id IN (SELECT id FROM ends)),
root AS (SELECT c.id, coalesce(parent, new, c.id) AS root FROM c LEFT JOIN fresh ON fresh.id = c.id)
SELECT DISTINCT a.root AS from_root, b.root AS to_root, edge_type FROM edges JOIN root a ON a.id = from_id JOIN root b ON b.id = to_id WHERE a.root <> b.root""")
def _(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("N").alias("type"), F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 2 == 0, F.lit(1000000) + F.col("c_nationkey")).cast("long").alias("parent"))
    return mutations.promoted(edges(s, d), c)[1]


@query("RL2_chunk_edges", "SELECT DISTINCT a.o_orderkey AS from_id, b.o_orderkey AS to_id, 'NEXT' AS edge_type FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderpriority LIKE '1%' AND b.o_orderpriority LIKE '2%' AND a.o_orderkey <> b.o_orderkey")
def _(s, d):
    m = read(s, d, "orders").select(F.col("o_custkey").alias("window"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    replies = m.select("window").distinct().select("window", F.lit("1-URGENT").alias("from_text"), F.lit("2-HIGH").alias("to_text"), F.lit("NEXT").alias("edge_type"), F.lit("").alias("explanation"))
    return spans.relate(m.select("window").distinct(), m, replies).drop("explanation")


@query("JN9_cross_in_window", "SELECT a.o_orderkey AS from_id, b.o_orderkey AS to_id, 'PAIR' AS edge_type, min(a.o_custkey)::VARCHAR AS explanation FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderpriority LIKE '1%' AND b.o_orderpriority LIKE '5%' GROUP BY 1, 2")
def _(s, d):
    m = read(s, d, "orders").select(F.col("o_custkey").alias("window"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    replies = m.select("window").distinct().select("window", F.lit("1-URGENT").alias("from_text"), F.lit("5-LOW").alias("to_text"), F.lit("PAIR").alias("edge_type"), F.col("window").cast("string").alias("explanation"))
    return spans.relate(m.select("window").distinct(), m, replies)


@query("JN7_similar_pairs", f"WITH {_MENT}, t AS (SELECT DISTINCT doc, text FROM m) SELECT a.doc, a.text AS a, b.text AS b FROM t a JOIN t b ON a.doc = b.doc AND a.text < b.text WHERE length(a.text) >= 3 AND length(b.text) >= 3 AND levenshtein(a.text, b.text) < 0.3 * greatest(length(a.text), length(b.text))")
def _(s, d):
    m = mentions(s, d)
    e = spans.coreference_edges(m)
    first = m.groupBy("doc", "text").agg(F.min("id").alias("id"))
    a, b = first.select(F.col("id").alias("u"), F.col("text").alias("a")), first.select(F.col("id").alias("v"), F.col("text").alias("b"))
    return e.join(a, "u").join(b, "v").where("a <> b").select("doc", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("CO2_distance", "SELECT DISTINCT a.p_name AS a, b.p_name AS b, round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) AS distance FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand")
def _(s, d):
    p = read(s, d, "part").select(F.col("p_name").alias("text"), "p_size", "p_brand")
    return spans.distances(p, ["p_size", "p_brand"]).withColumn("distance", F.round("distance", 6))


@query("JN12_snapshot_match", "SELECT o.p_partkey, o.p_type AS was, n.p_type AS now FROM (SELECT * FROM part WHERE p_partkey % 11 <> 0) o FULL JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NOT NULL AND n.p_partkey IS NOT NULL")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.col("p_type").alias("definition"))
    both = mutations.refresh_dictionary(p.where("p_partkey % 11 <> 0"), p.where("p_partkey % 10 <> 0"), ["p_partkey"]).where("change IN ('touch', 'update')")
    return both.join(p.select("p_partkey", F.col("definition").alias("was")), "p_partkey").select("p_partkey", "was", F.col("definition").alias("now"))


@query("MU8_manual_entity", f"WITH {_SPANS}, one AS (SELECT min(chunk) AS chunk FROM c WHERE contains(content, 'and')) SELECT chunk, text, 'new' AS type, s, (s + length(text))::INT AS e FROM sp JOIN one USING (chunk) WHERE text = 'and' UNION ALL SELECT chunk, text, type, s, (s + length(text))::INT FROM sp WHERE text = 'then'")
def _(s, d):
    chunks = _chunk_docs(s, d)
    first = chunks.where(F.contains("content", F.lit("and"))).agg(F.min("chunk").alias("c")).first()["c"]
    held = _mentions(s, d).where("text = 'then'")
    out = mutations.manual_entity(chunks, held, first, "and", "new")
    return out.select("chunk", "text", "type", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


# ---- aggregates, vectors ----------------------------------------------------------------------------------------------

@query("AG11_same_lists", "WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1) SELECT a.conv_id, coalesce(a.roles, []) = coalesce(b.roles, []) AS same FROM l a LEFT JOIN l b ON b.conv_id = a.conv_id + 1")
def _(s, d):
    each = read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    ahead = each.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("b"))
    return each.join(ahead, "conv_id", "left").select("conv_id", mutations.same_list(F.col("roles"), F.col("b")).alias("same"))


@query("SRC11_vectors_by_id", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def _(s, d):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return reading.vectors_of(v, read(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))).select("id", "label")


@query("ML4_known_vectors", "SELECT vec_id AS id, len(embedding)::BIGINT AS n FROM embeddings JOIN documents ON doc_id = vec_id")
def _(s, d):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return reading.KnownVectors(v).embed(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", F.size("v").cast("long").alias("n"))


# ---- changes ----------------------------------------------------------------------------------------------------------

_FOLDERS = [("book", "A"), ("shelf", "A"), ("series", "  "), (None, None), ("collection", "x")]


@query("FLT7_validation", f"SELECT t, n, CASE WHEN t IS NULL OR t NOT IN ('book', 'series', 'collection') THEN 'type' WHEN trim(n) = '' THEN 'name' END AS error FROM ({sql_values(_FOLDERS)}) v(t, n)")
def _(s, d):
    return values(s, "t string, n string", _FOLDERS).select("t", "n", mutations.folder_error(F.col("t"), F.col("n")).alias("error"))


@query("MU9_ontology", """SELECT r_name AS name, 'old' AS definition, NULL::VARCHAR AS reverse_name FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')
UNION ALL SELECT 'ASIA', 'second', 'ofx' UNION ALL SELECT 'NEW', 'made', NULL""")
def _(s, d):
    old = read(s, d, "region").select(F.col("r_name").alias("name"), F.lit("old").alias("definition"), F.lit(None).cast("string").alias("reverse_name"))
    changes = [(" ASIA", "first", "x", 1), ("ASIA ", "second", " ofx ", 2), ("NEW", "made", "  ", 1), ("EUROPE", None, None, 5)]
    return mutations.put_types(old, values(s, "name string, definition string, reverse_name string, seq int", changes))


@query("MU10_folders", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'Third' ELSE n_name END AS name FROM nation")
def _(s, d):
    f = read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return mutations.rename_folders(f, values(s, "id int, name string", [(3, " Third "), (4, "  ")]))


@query("MU10_repeated_moves", """WITH m AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 40 END AS target FROM orders),
k AS (SELECT id, arg_max(struct_pack(t := target), seq).t AS target FROM m WHERE target IS NULL OR target IN (SELECT n_nationkey FROM nation) GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN k.id IS NULL THEN c_nationkey ELSE k.target END AS parent, c_name AS moves FROM customer LEFT JOIN k ON k.id = c_custkey""")
def _(s, d):
    docs = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.col("c_name").alias("moves"))
    moves = read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 40).alias("target"))
    return mutations.move_documents(docs, moves, read(s, d, "nation").select(F.col("n_nationkey").alias("id")))


@query("MU10_repeated_names", "SELECT c_custkey AS id, coalesce((SELECT arg_max(o_orderstatus || o_orderkey, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0), c_name) AS name FROM customer")
def _(s, d):
    f = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    names = read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit(""), F.col("o_orderkey").cast("string"), F.lit(" "))).otherwise(" ").alias("name"), F.col("o_orderkey").alias("seq"))
    return mutations.rename_folders(f, names)


@query("MU10_moves", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 7 WHEN c_custkey % 5 = 1 THEN NULL ELSE c_nationkey END AS parent FROM customer")
def _(s, d):
    docs = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"))
    k = F.col("id") % 5
    moves = docs.where(k < 3).select("id", F.when(k == 0, 7).when(k == 2, 999).alias("target"))
    return mutations.move_documents(docs, moves, read(s, d, "nation").select(F.col("n_nationkey").alias("id")))


@query("MU11_touch", "SELECT o_orderkey AS id, CASE WHEN o_custkey < 20 THEN '2024-05-01' ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders")
def _(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("last_accessed"), "o_custkey")
    out = mutations.touch(o.drop("o_custkey"), o.where("o_custkey < 20").select("id"), "2024-05-01 00:00:00")
    return out.select("id", F.date_format("last_accessed", "yyyy-MM-dd").alias("day"))


@query("MU4_lexicon_tags", """WITH e AS (SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN 'learn' WHEN event_type = 'view' THEN 'tags' END AS kind, event_type || ';' || (event_id % 3) || ';' AS tags FROM events),
f AS (SELECT user_id, min(ts) AS f, arg_min(tags, ts) AS tags FROM e WHERE kind = 'learn' GROUP BY 1),
l AS (SELECT user_id, arg_max(e.tags, ts) AS tags FROM e JOIN f USING (user_id) WHERE kind = 'tags' AND ts >= f GROUP BY 1)
SELECT f.user_id AS term, rtrim(coalesce(l.tags, f.tags), ';') AS tags FROM f LEFT JOIN l USING (user_id)""")
def _(s, d):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "learn").when(F.col("event_type") == "view", "tags")
    tags = F.concat("event_type", F.lit(";"), (F.col("event_id") % 3).cast("string"), F.lit(";"))
    ev = read(s, d, "events").select(F.col("user_id").alias("term"), kind.alias("kind"), "ts", tags.alias("tags")).where("kind IS NOT NULL")
    return mutations.tagged_lexicon(ev).select("term", F.array_join("tags", ";").alias("tags"))


@query("MU5_preferences", "SELECT * FROM (VALUES ('pronunciation', 'zhuyin'), ('script', 'traditional'), ('theme', 'dark')) v(name, value)")
def _(s, d):
    got = mutations.set_preferences({"script": "traditional", "theme": None}, {"pronunciation": "zhuyin"}, {"script": "simplified", "pronunciation": "pinyin", "theme": "dark"})
    return values(s, "name string, value string", sorted(got.items()))


@query("MU12_expiry", "SELECT event_id AS id FROM events WHERE ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-02 12:00:00'")
def _(s, d):
    return mutations.expire(read(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created")), "2024-01-02 12:00:00").select("id")


# ---- functions, model inputs ------------------------------------------------------------------------------------------

_FORMS = [("me5", "me⁵", "ㄇㄜ˙"), ("ge4", "kê⁴", "ㄍㄜˋ"), ("ke3", "k'ê³", "ㄎㄜˇ"), ("he2", "hê²", "ㄏㄜˊ"), ("zi4", "tzu⁴", "ㄗˋ"), ("ci2", "tz'u²", "ㄘˊ"), ("si1", "ssu¹", "ㄙ"), ("zhi1", "chih¹", "ㄓ"), ("xyz3", "xyz³", "xyzˇ")]


@query("FN3_zhuyin", f"SELECT p, z AS zhuyin FROM ({sql_values(_FORMS)}) v(p, w, z)")
def _(s, d):
    return values(s, "p string", [(x[0],) for x in _FORMS]).select("p", P.formatted(F.col("p"), "zhuyin").alias("zhuyin"))


@query("FN4_wade_giles", f"SELECT p, w AS wade_giles FROM ({sql_values(_FORMS)}) v(p, w, z)")
def _(s, d):
    return values(s, "p string", [(x[0],) for x in _FORMS]).select("p", P.formatted(F.col("p"), "wade-giles").alias("wade_giles"))


@query("FN5_dispatch", f"SELECT p, p AS plain, p AS unknown FROM ({sql_values(_FORMS)}) v(p, w, z)")
def _(s, d):
    return values(s, "p string", [(x[0],) for x in _FORMS]).select("p", P.formatted(F.col("p"), "pinyin").alias("plain"), P.formatted(F.col("p"), "other").alias("unknown"))


_SCRIPTS = [("马", "马", "馬"), ("馬", "马", "馬"), ("水", "水", "水"), ("x", "马", "馬")]


@query("FN6_script", f"SELECT q, CASE WHEN q = s AND s <> t THEN s ELSE t END AS main, nullif(CASE WHEN q = s AND s <> t THEN t WHEN s = t THEN t ELSE s END, CASE WHEN q = s AND s <> t THEN s ELSE t END) AS other FROM ({sql_values(_SCRIPTS)}) v(q, s, t)")
def _(s, d):
    main, other = P.display_script(F.col("q"), F.col("s"), F.col("t"), "traditional")
    return values(s, "q string, s string, t string", _SCRIPTS).select("q", main.alias("main"), other.alias("other"))


_SIGNS = [("水", True), ("𠀀", True), ("a", False), ("か", False), ("豈", True), ("。", False)]


@query("FN1_ideograph", f"SELECT * FROM ({sql_values(_SIGNS)}) v(c, is_ideograph)")
def _(s, d):
    return values(s, "c string", [(x[0],) for x in _SIGNS]).select("c", (T.char_count(F.col("c")) == 1).alias("is_ideograph"))


@query("FN15_percent", "SELECT l_linenumber AS total, CASE WHEN l_linenumber > 0 THEN floor(100 * 1 / l_linenumber + 0.5)::BIGINT END AS pct FROM (SELECT DISTINCT l_linenumber FROM lineitem) UNION ALL SELECT 0, NULL")
def _(s, d):
    n = read(s, d, "lineitem").select(F.col("l_linenumber").alias("total")).distinct().unionByName(values(s, "total int", [(0,)]))
    return n.select("total", T.percent(F.lit(1), F.col("total")).cast("long").alias("pct"))


_REPLIES = [('{"entryId": 2, "explanation": "x"}', 2, "x"), ('{"entryId": 9}', 1, ""), ("broken", 1, ""), ('{"explanation": "y"}', 1, "y")]


@query("FN14_choice", f"SELECT * FROM ({sql_values(_REPLIES)}) v(reply, entry, explanation)")
def _(s, d):
    entry, why = reading.choice(F.col("reply"), F.array(*(F.lit(x).cast("long") for x in (1, 2, 3))))
    return values(s, "reply string", [(x[0],) for x in _REPLIES]).select("reply", entry.alias("entry"), why.alias("explanation"))


_KINDS = [("BEFORE",), ("NEAR",)]


def _relation_inputs(s, d):
    chunks = _chunk_docs(s, d).select(F.col("chunk").alias("window"), F.col("content").alias("text"))
    return reading.relation_inputs(chunks, _mentions(s, d).select(F.col("chunk").alias("window"), "text"), values(s, "edge_type string", _KINDS))


@query("ML2_relation_inputs", f"WITH {_SPANS}, h AS (SELECT chunk, string_agg(DISTINCT text, ',' ORDER BY text) AS entities, count(DISTINCT text) AS n FROM sp GROUP BY 1) SELECT chunk AS window, edge_type, content AS text, entities FROM h JOIN c USING (chunk), ({sql_values(_KINDS)}) v(edge_type) WHERE n >= 2")
def _(s, d):
    return _relation_inputs(s, d).withColumn("entities", F.array_join("entities", ","))


@query("ML2_known_relations", f"WITH {_SPANS} SELECT a.chunk AS window, 'NEAR' AS edge_type, 'and' AS from_text, 'the' AS to_text, '' AS explanation FROM (SELECT DISTINCT chunk FROM sp WHERE text = 'and') a JOIN (SELECT DISTINCT chunk FROM sp WHERE text = 'the') b ON a.chunk = b.chunk")
def _(s, d):
    known = values(s, "edge_type string, from_text string, to_text string, explanation string", [("NEAR", "and", "the", None), ("NEAR", "and", "and", None), ("FAR", "and", "the", None), ("NEAR", "and", "nowhere", "x")])
    return reading.KnownRelations(known).relate(_relation_inputs(s, d))


@query("ML3_labels", "SELECT p_size AS root, arg_min(p_name, p_partkey) AS label FROM part GROUP BY 1")
def _(s, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("texts")
    return reading.FirstText().label(read(s, d, "part").groupBy(F.col("p_size").alias("root")).agg(texts))


@query("ML6_explain_input", """SELECT a.conv_id, a.turn, concat_ws(chr(10) || chr(10), 'Passage:' || chr(10) || a.text, CASE WHEN x <> '' THEN 'Context:' || chr(10) || x END) AS prompt
FROM conversations a JOIN (SELECT a.conv_id, a.turn, string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn) AS x FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 GROUP BY 1, 2) c ON c.conv_id = a.conv_id AND c.turn = a.turn""")
def _(s, d):
    from ..operators import context

    around = context.surrounding(read(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", -2, 2)
    return around.select("conv_id", "turn", providers.prompt(("Passage", "text"), ("Context", "context")).alias("prompt"))


@query("ML6_entity_summary_input", f"""WITH {_SPANS}, q AS (SELECT chunk, text, s, substr(content, greatest(0, s - 80) + 1, least(length(content), s + length(text) + 80) - greatest(0, s - 80)) AS snippet, row_number() OVER (PARTITION BY text ORDER BY chunk, s) AS k FROM sp JOIN c USING (chunk))
SELECT text, string_agg(snippet, chr(10) ORDER BY k) AS snippets FROM q GROUP BY 1""")
def _(s, d):
    m = _mentions(s, d).withColumns({"s": F.col("s").cast("int"), "e": F.col("e").cast("int")}).join(_chunk_docs(s, d), "chunk")
    return m.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s", spans.snippet().alias("t")))), lambda x: x["t"]), "\n").alias("snippets"))




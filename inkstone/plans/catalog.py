
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pinyin as P
from ..functions import text as T
from ..operators import chunking, context, graph, mutations, providers, search, spans, vectors
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v))
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# ---- scans, filters, projections ------------------------------------------------------------------------------------

@query("SRC1_scan", "SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id")
def _(s, d):
    return read(s, d, "documents").select("doc_id", "source", "n_chars").orderBy("source", "doc_id")


@query("FLT1_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(s, d):
    return read(s, d, "orders").where("o_orderkey = 7")


@query("FLT2_in_list", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _(s, d):
    ids = read(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return read(s, d, "part").select("p_partkey", "p_name").join(ids, "p_partkey", "left_semi")


@query("FLT3_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(s, d):
    n = read(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return read(s, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("FLT4_wildcard", r"SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%e_ %' OR lower(p_type) LIKE '%e_ %'")
def _(s, d):
    return read(s, d, "part").where(T.like(F.col("p_name"), "*E_ *") | T.like(F.col("p_type"), "*E_ *")).select("p_partkey", "p_name")


@query("FLT5_tone", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%3%'")
def _(s, d):
    return read(s, d, "part").where(F.col("p_brand").contains("3")).select("p_partkey", "p_brand")


@query("FLT6_contained_in_query", "SELECT p_partkey AS id, p_name AS simplified FROM part WHERE instr('red ivory small blue', p_name) > 0 AND p_name <> ''")
def _(s, d):
    e = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("simplified"), F.col("p_name").alias("traditional"))
    return search.contained_in(e, "red ivory small blue").select("id", "simplified")


@query("FLT6_contained_in_names", "WITH q AS (SELECT string_agg(p_name, ' ' ORDER BY p_partkey) AS q FROM part WHERE p_partkey <= 3) SELECT p_partkey AS id, p_name AS simplified FROM part, q WHERE instr(q, p_name) > 0 AND p_name <> ''")
def _(s, d):
    e = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("simplified"), F.col("p_name").alias("traditional"))
    # what is typed: the names of three parts
    typed = " ".join(r["simplified"] for r in e.where("id <= 3").orderBy("id").collect())
    return search.contained_in(e, typed).select("id", "simplified")


@query("FLT8_null_safe", "SELECT conv_id, turn FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL AND role = 'user'")
def _(s, d):
    return read(s, d, "conversations").where("role IS NOT NULL AND text IS NOT NULL AND role = 'user'").select("conv_id", "turn")


_USERS = [("public",), ("user:7",), ("test:2024",), ("other",)]


@query("FLT9_user_type", f"SELECT u, CASE WHEN u = 'public' THEN 'public' WHEN u LIKE 'user:%' THEN 'authenticated' ELSE 'test' END AS kind FROM ({sql_values(_USERS)}) v(u)")
def _(s, d):
    return values(s, "u string", _USERS).select("u", T.user_type(F.col("u")).alias("kind"))


@query("PRJ1_fallbacks", "SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, ''), '?') AS label FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", T.first_filled(F.col("lang"), F.col("source"), F.lit("?")).alias("label"))


# ---- sources ----------------------------------------------------------------------------------------------------------

@query("SRC2_upload_dedup", """
SELECT doc_id AS id, sha256(text) AS content_hash, 'originals/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS location,
       'application/octet-stream' AS mimetype, (doc_id % 50 = 0 OR row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 OR bool_or(doc_id % 50 = 0) OVER (PARTITION BY text)) AS already_exists
FROM documents""")
def _(s, d):
    docs = read(s, d, "documents")
    known = docs.where("doc_id % 50 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return files.uploads(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("").alias("mimetype")), known)


@query("SRC3_html_to_markdown")
def _(s, d):
    return read(s, d, "pages").select("page_id", files.extract(F.col("html"), F.lit("text/html")).alias("content"))


@query("SRC4_extracted_location", "SELECT doc_id, 'extracted/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) || '.md' AS location FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", T.extracted_location(T.original_location(F.sha2("text", 256))).alias("location"))


_TITLES = [(1, "# One\n\nbody"), (2, "# One\n# Two"), (3, "plain"), (4, "intro\n# Late\nrest"), (5, "")]


@query("SRC5_title", f"SELECT id, t, CASE id WHEN 1 THEN 'body' WHEN 4 THEN 'intro' || chr(10) || 'rest' ELSE c END AS content FROM (SELECT id, c, CASE id WHEN 1 THEN 'One' WHEN 4 THEN 'Late' END AS t FROM ({sql_values(_TITLES)}) v(id, c))")
def _(s, d):
    c = F.col("c")
    return values(s, "id int, c string", _TITLES).select("id", T.title(c).alias("t"), T.without_title(c).alias("content"))


@query("SRC6_blob_round_trip", "SELECT doc_id, text AS content FROM documents")
def _(s, d):
    docs = read(s, d, "documents").select("doc_id", files.extract(F.col("text"), F.lit("text/plain")).alias("content"))
    docs = docs.withColumn("location", T.extracted_location(T.original_location(F.sha2("content", 256))))
    path = graph.scratch(s)
    files.write_markdown(docs, path)
    return files.read_markdown(docs.select("doc_id", "location"), path).select("doc_id", "content")


@query("SRC10_staging", "SELECT doc_id, lang, source, n_chars, sha256(text) AS sha FROM documents")
def _(s, d):
    return files.staged(read(s, d, "documents"), graph.scratch(s), 1000).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"))


_CEDICT = ["# comment", "#! time=1700000000", "#! date=2023-11-14", "", "水 水 [shui3] /water/river/", "馬 马 [ma3] /horse/", "broken line", "喝水 喝水 [he1 shui3] /to drink water/"]


@query("SRC7_dictionary_file", "SELECT * FROM (VALUES ('水', '水', 'shui3', 'water|river', 'cedict:1700000000'), ('馬', '马', 'ma3', 'horse', 'cedict:1700000000'), ('喝水', '喝水', 'he1 shui3', 'to drink water', 'cedict:1700000000')) v(traditional, simplified, pinyin, definitions, source)")
def _(s, d):
    lines = values(s, "value string", [(x,) for x in _CEDICT])
    epoch = files.dictionary_header(lines).select(F.concat(F.lit("cedict:"), F.col("epoch").cast("string")).alias("source"))
    return files.parse_dictionary(lines).withColumn("definitions", F.array_join("definitions", "|")).join(F.broadcast(epoch), F.lit(True))


_IDS = ["# c", "U+4E00\t一\t一", "U+4E01\t丁\t⿱一亅", "U+4E0E\t与\t⿹②一[GTKV]\t⿻②一[J]", "U+5C11\t少\t⿱少女[O]\t⿱小丿[GO]", "U+4E02\tx", "U+660E\t明\t⿰日月", "U+1B0A6\t𛂦\t⿰木𛂦"]


@query("SRC8_decomposition_file", "SELECT * FROM (VALUES ('一', NULL, NULL, NULL, false), ('丁', 0, '⿱一亅', NULL, false), ('与', 0, '⿹②一', 'GTKV', false), ('与', 1, '⿻②一', 'J', false), ('少', 0, '⿱少女', NULL, true), ('少', 1, '⿱小丿', 'G', true), ('明', 0, '⿰日月', NULL, false), ('𛂦', 0, '⿰木𛂦', NULL, false)) v(character, position, ids, tags, obsolete)")
def _(s, d):
    return files.parse_decompositions(values(s, "value string", [(x,) for x in _IDS])).drop("codepoint")


_IDS_NODES = [("⿰⿱一丨亅", 0, -1, 0, "op", "⿰"), ("⿰⿱一丨亅", 1, 0, 0, "op", "⿱"), ("⿰⿱一丨亅", 2, 1, 0, "char", "一"), ("⿰⿱一丨亅", 3, 1, 1, "char", "丨"), ("⿰⿱一丨亅", 4, 0, 1, "char", "亅"), ("⿲氵彳木", 0, -1, 0, "op", "⿲"), ("⿲氵彳木", 1, 0, 0, "char", "氵"), ("⿲氵彳木", 2, 0, 1, "char", "彳"), ("⿲氵彳木", 3, 0, 2, "char", "木"), ("⿱一③", 0, -1, 0, "op", "⿱"), ("⿱一③", 1, 0, 0, "char", "一"), ("⿱一③", 2, 0, 1, "unencoded", "3")]


@query("ID1_decomposition_tree", f"SELECT * FROM ({sql_values(_IDS_NODES)}) v(ids, node, parent, position, kind, value)")
def _(s, d):
    return files.decomposition_nodes(values(s, "ids string", [("⿰⿱一丨亅",), ("⿲氵彳木",), ("⿱一③",)]).withColumn("k", F.col("ids")), ["ids"])


@query("SRC12_vector_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE 'old' END AS origin FROM embeddings")
def _(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"))
    new = e.where("id % 7 = 0").select("id", F.lit("new").alias("origin"), F.lit(1).cast("long").alias("seq"))
    return graph.upsert(e.withColumn("origin", F.lit("old")), new)


@query("SRC13_progress", "SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS processed, floor(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) + 0.5)::BIGINT AS pct FROM orders GROUP BY 1")
def _(s, d):
    j = read(s, d, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("processed"))
    return j.withColumn("pct", T.percent(F.col("processed"), F.col("total")).cast("long"))


# ---- context windows ------------------------------------------------------------------------------------------------

def _around(low: str, high: str, name: str) -> str:
    return f"SELECT a.conv_id, a.turn, coalesce(string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn), '') AS {name} FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn {low} AND a.turn {high} GROUP BY a.conv_id, a.turn"


def _conv(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", "text")


@query("WN1_context", _around("- 2", "+ 2", "context"))
def wn1(s, d):
    return context.surrounding(_conv(s, d), "conv_id", "turn", "text", -2, 2).drop("text")


flagship = wn1


@query("WN2_preceding", _around("- 3", "- 1", "before"))
def _(s, d):
    return context.surrounding(_conv(s, d), "conv_id", "turn", "text", -3, -1, "before").drop("text")


@query("WN2_following", _around("+ 1", "+ 2", "after"))
def _(s, d):
    return context.surrounding(_conv(s, d), "conv_id", "turn", "text", 1, 2, "after").drop("text")


@query("JN5_band_join", _around("- 3", "+ 3", "context"))
def _(s, d):
    return context.surrounding(_conv(s, d), "conv_id", "turn", "text", -3, 3).drop("text")


@query("WN3_sliding_windows", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ix FROM conversations)
SELECT a.conv_id, a.ix AS centre, min(b.turn) AS first, max(b.turn) AS last, string_agg(b.text, chr(10) ORDER BY b.turn) AS text
FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.ix BETWEEN a.ix - 3 AND a.ix + 3 WHERE a.ix % 2 = 0 GROUP BY a.conv_id, a.ix""")
def _(s, d):
    return context.sliding_windows(_conv(s, d), "conv_id", "turn", "text")


@query("WN4_first_occurrence", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) n FROM orders) WHERE n = 1")
def _(s, d):
    return context.first_wins(read(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("WN5_latest_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders) WHERE n = 1")
def _(s, d):
    return context.latest(read(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("WN6_chunk_order", "SELECT doc_id, i - 1 AS chunk_order, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_order", "line"))


@query("AG4_group_concat", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id")
def _(s, d):
    return context.listed(read(s, d, "conversations"), ["conv_id"], "turn", "text", "text", "\n")


# ---- drafts -----------------------------------------------------------------------------------------------------------

_DRAFTS = "drafts AS (SELECT o_custkey AS chunk, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 2)::INT AS draft_number, CASE WHEN o_orderpriority LIKE '1%' THEN 'ai:x' WHEN o_orderpriority LIKE '2%' THEN 'mt:y' ELSE 'user:z' END AS translator, o_orderkey AS content FROM orders)"


def drafts(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = F.when(F.col("o_orderpriority").startswith("1"), "ai:x").when(F.col("o_orderpriority").startswith("2"), "mt:y").otherwise("user:z")
    return read(s, d, "orders").select(F.col("o_custkey").alias("chunk"), (F.row_number().over(w) - 2).alias("draft_number"), t.alias("translator"), F.col("o_orderkey").alias("content"))


@query("AG1_latest_draft", f"WITH {_DRAFTS} SELECT chunk, max(draft_number) AS draft_number, arg_max(translator, draft_number) AS translator, arg_max(content, draft_number) AS content FROM drafts GROUP BY chunk")
def _(s, d):
    return context.latest_draft(drafts(s, d))


@query("AG2_available_drafts", f"WITH {_DRAFTS} SELECT chunk, string_agg(draft_number::VARCHAR, ',' ORDER BY draft_number) AS drafts FROM drafts GROUP BY chunk")
def _(s, d):
    return context.listed(drafts(s, d), ["chunk"], "draft_number", "draft_number", "drafts")


@query("AG3_next_draft", f"WITH {_DRAFTS} SELECT c_custkey AS chunk, (coalesce(max(draft_number), 0) + 1)::INT AS next FROM customer LEFT JOIN drafts ON chunk = c_custkey GROUP BY 1")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("chunk")).join(drafts(s, d), "chunk", "left").groupBy("chunk").agg((F.coalesce(F.max("draft_number"), F.lit(0)) + 1).alias("next"))


@query("AG5_one_translation", f"WITH {_DRAFTS} SELECT translator, chunk, content FROM (SELECT *, row_number() OVER (PARTITION BY translator, chunk ORDER BY draft_number DESC) n FROM drafts) WHERE n = 1")
def _(s, d):
    return context.latest(drafts(s, d), ["translator", "chunk"], [F.desc("draft_number")]).select("translator", "chunk", "content")


@query("MU3_save_draft", f"""WITH {_DRAFTS}, last AS (SELECT chunk, max(draft_number) AS n, arg_max(translator, draft_number) AS t FROM drafts GROUP BY chunk)
SELECT c_custkey AS chunk, (CASE WHEN n IS NULL OR t LIKE 'ai:%' OR t LIKE 'mt:%' THEN coalesce(n, 0) + 1 ELSE n END)::INT AS draft_number, c_name AS content, (n IS NULL OR t LIKE 'ai:%' OR t LIKE 'mt:%') AS is_new FROM customer LEFT JOIN last ON chunk = c_custkey""")
def _(s, d):
    return context.save_draft(drafts(s, d), read(s, d, "customer").select(F.col("c_custkey").alias("chunk"), F.col("c_name").alias("content")))


@query("FN9_translator_status", f"WITH {_DRAFTS} SELECT content, CASE WHEN translator LIKE 'ai:%' OR translator LIKE 'mt:%' THEN 'ai' WHEN translator = 'user:z' AND chunk % 2 = 0 THEN 'self' ELSE 'other' END AS status FROM drafts")
def _(s, d):
    own = F.when(F.col("chunk") % 2 == 0, "user:z").otherwise("user:q")
    return drafts(s, d).select("content", T.translator_status(F.col("translator"), own).alias("status"))


# ---- search -----------------------------------------------------------------------------------------------------------

def entries(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("simplified"), F.col("p_name").alias("traditional"), F.col("p_brand").alias("pinyin"), F.col("p_type").alias("definitions_text"))


_TOK = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
_ANY = "list_concat(" + ", ".join(_TOK.format(c) for c in ("p_name", "p_brand", "p_type")) + ")"


@query("FTS1_postings", "SELECT p_partkey AS id, col, token FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS col, unnest({_TOK.format(c)}) AS token FROM part" for n, c in (("simplified", "p_name"), ("traditional", "p_name"), ("pinyin", "p_brand"), ("definitions_text", "p_type"))) + ")")
def _(s, d):
    return search.postings(entries(s, d))


@query("FTS4_match_all_terms", f"SELECT p_partkey AS id, p_name AS simplified FROM part WHERE len(list_filter({_ANY}, lambda t: starts_with(t, 're'))) > 0 AND len(list_filter({_ANY}, lambda t: starts_with(t, 'b'))) > 0 ORDER BY length(p_name), p_name, p_partkey LIMIT 200")
def _(s, d):
    return search.search(entries(s, d), "re b", limit=200).select("id", "simplified")


@query("FTS4_headword_filter_first_term", f"SELECT p_partkey AS id FROM part WHERE len(list_filter(list_concat({_TOK.format('p_name')}, {_TOK.format('p_brand')}), lambda t: starts_with(t, 'bl'))) > 0 AND len(list_filter({_ANY}, lambda t: starts_with(t, 's'))) > 0 ORDER BY length(p_name), p_name, p_partkey LIMIT 100")
def _(s, d):
    return search.search(entries(s, d), "bl s", headwords=True, limit=100).select("id")


@query("FTS5_tone_only", "SELECT p_partkey AS id FROM part WHERE p_brand LIKE '%2%' ORDER BY length(p_name), p_name, p_partkey LIMIT 50")
def _(s, d):
    return search.search(entries(s, d), tone="2").select("id")


@query("FTS6_like_with_definition", "SELECT p_partkey AS id FROM part WHERE lower(p_name) LIKE 'r__ %' AND lower(p_type) LIKE '%a%' ORDER BY length(p_name), p_name, p_partkey LIMIT 200")
def _(s, d):
    return search.search(entries(s, d), "r__ *", "a", limit=200).select("id")


@query("FTS7_rank_limit", "SELECT p_partkey AS id, p_name AS simplified FROM part WHERE p_name LIKE '%b_%' ORDER BY length(p_name), p_name, p_partkey LIMIT 30")
def _(s, d):
    return search.search(entries(s, d), "*b_*", limit=30).select("id", "simplified")


@query("FTS8_malformed", "SELECT p_partkey AS id FROM part WHERE false")
def _(s, d):
    return search.search(entries(s, d), "river, liquid").select("id")


@query("FTS9_definitions", "SELECT p_partkey AS id, coalesce((SELECT string_agg(l_shipdate::DATE::VARCHAR || '/' || l_orderkey || '/' || l_linenumber, ',' ORDER BY l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45), '') AS definitions FROM part")
def _(s, d):
    li = read(s, d, "lineitem").where("l_quantity > 45")
    defs = li.select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sort_order"), F.concat_ws("/", F.to_date("l_shipdate").cast("string"), "l_orderkey", "l_linenumber").alias("definition"))
    e = read(s, d, "part").select(F.col("p_partkey").alias("id"))
    return search.with_definitions(e, defs).select("id", F.array_join("definitions", ",").alias("definitions"))


_SEG = [(1, "redblue"), (2, "smallsmallred"), (3, "xred"), (4, "greenwhite")]


@query("SG1_segmentation", f"""
WITH RECURSIVE w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS form FROM part), q AS (SELECT * FROM ({sql_values(_SEG)}) v(query_id, text)),
r AS (SELECT query_id, text, 0 AS pos, '' AS segments, 0 AS score FROM q
      UNION ALL SELECT query_id, text, pos + length(form), CASE WHEN pos = 0 THEN form ELSE segments || '|' || form END, score + length(form) * length(form) FROM r JOIN w ON substr(text, pos + 1, length(form)) = form WHERE pos < length(text))
SELECT query_id, rank::INT AS rank, segments, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, string_split(segments, '|')) AS rank FROM r WHERE pos = length(text)) WHERE rank <= 5""")
def _(s, d):
    forms = read(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("form")).distinct()
    return search.segmentations(values(s, "query_id int, text string", _SEG), forms)


# ---- joins ------------------------------------------------------------------------------------------------------------

@query("JN1_inner", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_custkey")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("JN2_two_roles_left", "SELECT s_suppkey, c_custkey, n.n_name FROM supplier JOIN customer ON s_nationkey = c_nationkey LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND n.n_regionkey < 3")
def _(s, d):
    n = read(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    # names go with the customers, of which each row is dealt out fewer times
    cust = read(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey")).join(F.broadcast(n), "s_nationkey", "left")
    return context.dealt_join(cust, read(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "c_custkey", "n_name")


_EDGES = "edges AS (SELECT DISTINCT o_custkey AS from_id, l_suppkey AS to_id, l_returnflag AS edge_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def edges(s, d):
    o = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("from_id"))
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("to_id"), F.col("l_returnflag").alias("edge_type")).join(o, "o_orderkey").select("from_id", "to_id", "edge_type").distinct()


def _ids(s, d, every: int):
    return read(s, d, "customer").where(f"c_custkey % {every} = 0").select(F.col("c_custkey").alias("id"))


@query("JN3_both_ends", f"WITH {_EDGES} SELECT * FROM edges WHERE from_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND to_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def _(s, d):
    return spans.within(edges(s, d), _ids(s, d, 3))


@query("GR7_document_graph", f"WITH {_EDGES} SELECT edge_type, count(*) AS links FROM edges WHERE from_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND to_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def _(s, d):
    return spans.within(edges(s, d), _ids(s, d, 3)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("links"))


@query("JN4_either_end", f"WITH {_EDGES} SELECT * FROM edges WHERE from_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) OR to_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def _(s, d):
    return spans.touching(edges(s, d), _ids(s, d, 7)).select("from_id", "to_id", "edge_type")


@query("JN10_anti", f"WITH {_EDGES} SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.edge_type = 'A' AND x.from_id = e.from_id AND x.to_id = e.to_id) ")
def _(s, d):
    e = edges(s, d)
    return e.join(e.where("edge_type = 'A'").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


@query("JN11_orphaned_parents", "SELECT n_nationkey AS id, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey < 8)")
def _(s, d):
    left = read(s, d, "supplier").where("s_suppkey < 8").select(F.col("s_nationkey").alias("parent"))
    return mutations.orphaned_parents(read(s, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), left)


@query("JN8_occurrences", f"WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS form FROM part), q AS (SELECT * FROM ({sql_values(_SEG)}) v(query_id, text)) SELECT query_id, i::INT AS pos, form FROM (SELECT query_id, text, unnest(range(1, length(text) + 1)) AS i FROM q) JOIN w ON substr(text, i, length(form)) = form")
def _(s, d):
    forms = read(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("form")).distinct()
    return search.occurrences(values(s, "query_id int, text string", _SEG), forms)


# ---- aggregates -------------------------------------------------------------------------------------------------------

@query("AG6_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def _(s, d):
    return read(s, d, "part").select("p_brand", "p_size").distinct()


@query("AG7_element_max", "SELECT label, pos::INT AS pos, max(x)::DOUBLE AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def _(s, d):
    return graph.element_max(read(s, d, "embeddings").select("label", F.col("embedding").alias("v")), "label").withColumn("x", F.col("x").cast("double"))


@query("AG8_mention_counts", "SELECT 'merged' AS kind, l_returnflag || l_linestatus AS name, count(*) AS mentions, min(l_orderkey * 100000 + l_linenumber) AS first_seen FROM lineitem GROUP BY 2 UNION ALL SELECT 'single', o_orderpriority, count(*), min(o_orderkey * 100000) FROM orders GROUP BY 2")
def _(s, d):
    of = lambda df, kind, name, at: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("mentions"), F.min(at).alias("first_seen")).select(F.lit(kind).alias("kind"), "name", "mentions", "first_seen")
    return of(read(s, d, "lineitem"), "merged", F.concat("l_returnflag", "l_linestatus"), F.col("l_orderkey") * 100000 + F.col("l_linenumber")).unionByName(of(read(s, d, "orders"), "single", F.col("o_orderpriority"), F.col("o_orderkey") * 100000))


@query("AG9_character_counts", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS chars, len(list_distinct(regexp_extract_all(text, '[A-Za-zÀ-ɏ]'))) AS unique_chars FROM documents")
def _(s, d):
    letters = r"A-Za-z\x{C0}-\x{24F}"
    return read(s, d, "documents").select("doc_id", T.char_count(F.col("text"), letters).cast("long").alias("chars"), T.unique_char_count(F.col("text"), letters).cast("long").alias("unique_chars"))


_CJK = [("你好世界", 4, 4), ("你好你好", 4, 2), ("第1章第2节", 4, 3), ("Hello你好World世界", 4, 4), ("日本語を勉強する", 5, 5), ("かな한글", 0, 0), ("𠀀𠀀", 2, 1), ("你𠀀好", 3, 3), ("", 0, 0)]


@query("AG9_ideographs", f"SELECT * FROM ({sql_values(_CJK)}) v(t, char_count, unique_char_count)")
def _(s, d):
    t = F.col("t")
    return values(s, "t string", [(x[0],) for x in _CJK]).select("t", T.char_count(t).alias("char_count"), T.unique_char_count(t).alias("unique_char_count"))


@query("AG10_first_wins", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) n FROM orders) WHERE n = 1")
def _(s, d):
    return context.first_wins(read(s, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


# ---- top-k and pages --------------------------------------------------------------------------------------------------

@query("TK1_first_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def _(s, d):
    return context.page(read(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("TK1_next_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 11")
def _(s, d):
    return context.page(read(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 10, context.page_token("1998-01-01 00:00:00", 500))


@query("TK2_vector_top_k", """
WITH x AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label = b.label AS ctx, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM x),
m AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM k WHERE n <= 8 AND id <> query AND NOT (ctx AND id % 2 = 0))
SELECT query, id, score FROM m WHERE r <= 3""")
def _(s, d):
    e = read(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), "label")
    skip = q.join(e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "label"), "label").select("query", "id")
    return vectors.without(vectors.nearest(q.drop("label"), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))), skip)


_BY_COMPARING_ALL = "SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE n <= 8"


def _vector_index(s, d):
    """Queries, vectors and a stored index of the embeddings."""
    e = read(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    vectors.build(v, path := graph.scratch(s))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), v, path


@query("TK2_all_cells", _BY_COMPARING_ALL)
def _(s, d):
    q, _v, path = _vector_index(s, d)
    return vectors.search(q, path, probes=0)


@query("TK2_index_recall")
def _(s, d):
    q, v, path = _vector_index(s, d)
    return vectors.recall(vectors.search(q, path), vectors.nearest(q, v))


@query("TK5_recent", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 9")
def _(s, d):
    return read(s, d, "events").where("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(9).select("event_id")


@query("MU4_lexicon", """
WITH l AS (SELECT user_id AS term, min(ts) AS f, max(ts) AS last_learned, count(*) AS learn_count FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
SELECT term, learn_count, (SELECT count(*) FROM events WHERE user_id = term AND event_type = 'error' AND ts >= f) AS fail_count, epoch_us(f) AS first_us, epoch_us(last_learned) AS last_us FROM l""")
def _(s, d):
    ev = read(s, d, "events")
    ev = ev.select(F.col("user_id").alias("term"), F.when(F.col("event_type").isin("signup", "purchase"), "learn").when(F.col("event_type") == "error", "fail").alias("kind"), "ts").where("kind IS NOT NULL")
    return mutations.lexicon(ev).select("term", "learn_count", "fail_count", F.unix_micros(F.col("first_learned").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_learned").cast("timestamp")).alias("last_us"))


@query("TK6_lexicon_order", "SELECT user_id AS term, max(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(s, d):
    return read(s, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("term")).agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "term").limit(20)


# ---- mentions ---------------------------------------------------------------------------------------------------------

_NAMES = [("and", "a"), ("the", "b"), ("then", "a"), ("en the", "b")]


def _chunk_docs(s, d):
    return read(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk"), F.col("text").alias("content"))


def _mentions(s, d):
    return spans.find_spans(_chunk_docs(s, d), values(s, "text string, type string", _NAMES))


_SPANS = f"""c AS (SELECT conv_id * 100 + turn AS chunk, text AS content FROM conversations), n AS (SELECT * FROM ({sql_values(_NAMES)}) v(text, type)),
g AS (SELECT chunk, n.text, type, string_split(content, n.text) AS p FROM c JOIN n ON contains(content, n.text)),
sp AS (SELECT chunk, text, type, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(text))::INT AS s FROM (SELECT *, unnest(range(1, len(p))) AS k FROM g))"""


@query("SP1_occurrences", f"WITH {_SPANS} SELECT chunk, text, type, s, s + length(text)::INT AS e FROM sp")
def _(s, d):
    return _mentions(s, d).select("chunk", "text", "type", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@query("SP2_greedy_overlaps", f"""WITH RECURSIVE {_SPANS},
o AS (SELECT *, s + length(text) AS e, row_number() OVER (PARTITION BY chunk ORDER BY s, length(text) DESC, type, text) AS k FROM sp),
r AS (SELECT chunk, k, s, e, type, text, e AS lim, true AS keep FROM o WHERE k = 1
      UNION ALL SELECT o.chunk, o.k, o.s, o.e, o.type, o.text, CASE WHEN o.s >= r.lim THEN o.e ELSE r.lim END, o.s >= r.lim FROM r JOIN o ON o.chunk = r.chunk AND o.k = r.k + 1)
SELECT chunk, s, e::INT AS e, type, text FROM r WHERE keep""")
def _(s, d):
    return spans.without_overlaps(_mentions(s, d))


@query("CO1_snippet", f"WITH {_SPANS} SELECT chunk, text, s, substr(content, greatest(0, s - 80) + 1, least(length(content), s + length(text) + 80) - greatest(0, s - 80)) AS snippet FROM sp JOIN c USING (chunk)")
def _(s, d):
    m = _mentions(s, d).withColumns({"s": F.col("s").cast("int"), "e": F.col("e").cast("int")}).join(_chunk_docs(s, d), "chunk")
    return m.select("chunk", "text", "s", spans.snippet().alias("snippet"))


def mentions(s, d):
    """Names of parts as mentions; sizes modulo ten as documents."""
    return read(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("doc"), F.lit("N").alias("type"), F.col("p_name").alias("text"))


_MENT = "m AS (SELECT p_partkey AS id, p_size % 10 AS doc, p_name AS text FROM part)"
_NEAR = "a.text = b.text OR (length(a.text) >= 3 AND length(b.text) >= 3 AND levenshtein(a.text, b.text) < 0.3 * greatest(length(a.text), length(b.text)))"
#: Components over distinct texts of a document, by the smallest id of each.
_ROOTS = f"{_MENT}, t AS (SELECT doc, text, min(id) AS f FROM m GROUP BY 1, 2), x AS (SELECT a.doc, a.f AS u, b.f AS v FROM t a JOIN t b ON a.doc = b.doc AND ({_NEAR})), r AS (SELECT f AS v, f AS root FROM t UNION SELECT x.v, r.root FROM r JOIN x ON x.u = r.v), g AS (SELECT m.id AS v, min(root) AS root FROM r JOIN t ON t.f = r.v JOIN m ON m.doc = t.doc AND m.text = t.text GROUP BY 1)"


def coreference_roots(s, d):
    m = mentions(s, d)
    return graph.components(m.select("id"), spans.coreference_edges(m))


@query("CO3_coreference_edges", f"WITH {_MENT}, t AS (SELECT doc, text, min(id) AS f FROM m GROUP BY 1, 2) SELECT a.doc, a.f AS u, b.f AS v FROM t a JOIN t b ON a.doc = b.doc AND a.text < b.text AND ({_NEAR}) UNION ALL SELECT m.doc, t.f, m.id FROM m JOIN t USING (doc, text) WHERE m.id <> t.f")
def _(s, d):
    return spans.coreference_edges(mentions(s, d))


@query("CO4_components", f"WITH RECURSIVE {_ROOTS} SELECT v, root FROM g")
def _(s, d):
    return coreference_roots(s, d)


@query("CO5_merged_entities", f"WITH RECURSIVE {_ROOTS} SELECT root, min(doc) AS doc, 'N' AS type, arg_min(text, id) AS label, count(*) AS members FROM g JOIN m ON m.id = g.v GROUP BY root HAVING count(*) >= 2")
def _(s, d):
    return spans.parents(mentions(s, d), coreference_roots(s, d))


@query("RL1_relations", """
WITH f AS (SELECT n_regionkey AS w, n_nationkey AS id, substr(n_name, 1, 8) AS t FROM nation), p AS (SELECT a.w, a.t AS ft, b.t AS tt FROM f a JOIN f b ON a.w = b.w WHERE (a.id + b.id) % 3 = 0)
SELECT from_id, to_id, edge_type, explanation FROM (SELECT a.id AS from_id, b.id AS to_id, 'NEAR' AS edge_type, '' AS explanation, row_number() OVER (PARTITION BY a.id, b.id ORDER BY p.w) n FROM p JOIN f a ON a.w = p.w AND a.t = p.ft JOIN f b ON b.w = p.w AND b.t = p.tt WHERE p.ft <> p.tt AND a.id <> b.id) WHERE n = 1""")
def _(s, d):
    m = read(s, d, "nation").select(F.col("n_regionkey").alias("window"), F.col("n_nationkey").alias("id"), F.substring("n_name", 1, 8).alias("text"))
    a, b = m.alias("a"), m.alias("b")
    replies = a.join(b, F.col("a.window") == F.col("b.window")).where((F.col("a.id") + F.col("b.id")) % 3 == 0).select(F.col("a.window").alias("window"), F.col("a.text").alias("from_text"), F.col("b.text").alias("to_text"), F.lit("NEAR").alias("edge_type"), F.lit(None).cast("string").alias("explanation"))
    return spans.relate(m.select("window").distinct(), m, replies)


@query("RL3_promotion", f"WITH {_EDGES} SELECT DISTINCT CASE WHEN a.c_custkey % 2 = 0 THEN 1000000 + a.c_nationkey ELSE a.c_custkey END AS from_root, CASE WHEN b.c_custkey % 2 = 0 THEN 1000000 + b.c_nationkey ELSE b.c_custkey END AS to_root, edge_type FROM edges JOIN customer a ON a.c_custkey = from_id JOIN customer b ON b.c_custkey = to_id WHERE from_root <> to_root")
def _(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(1000000) + F.col("c_nationkey")).cast("long").alias("parent"))
    return spans.promote(edges(s, d), c)


@query("MU6_delete_entity", f"WITH {_EDGES}, g AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5)) SELECT * FROM edges WHERE from_id NOT IN (SELECT id FROM g) AND to_id NOT IN (SELECT id FROM g)")
def _(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(1000000) + F.col("c_nationkey")).alias("parent"))
    return spans.delete_entity(c, edges(s, d), 5)[1]


@query("MU7_affected_chunks", "SELECT DISTINCT c_custkey % 50 AS chunk FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5)")
def _(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), (F.col("c_custkey") % 50).alias("chunk"))
    return mutations.affected_chunks(c, 5)


# ---- graphs -----------------------------------------------------------------------------------------------------------

_CHARS = [("一", 1), ("亅", 2), ("丁", 3), ("口", 4), ("五", 5), ("吾", 6), ("語", 7), ("言", 8), ("日", 9), ("月", 10), ("明", 11), ("木", 12), ("𛂦", 13)]
_NODES = [(i, "char", c) for c, i in _CHARS if c in "一亅口五言日月木"] + [(3, "op", "⿱"), (6, "op", "⿱"), (7, "op", "⿰"), (11, "op", "⿰"), (13, "op", "⿰")]
_LINKS = [(3, 1, 0), (3, 2, 1), (6, 5, 0), (6, 4, 1), (7, 8, 0), (7, 6, 1), (11, 9, 0), (11, 10, 1), (13, 12, 0), (13, 13, 1)]
_IDS_CTE = f"chars AS (SELECT * FROM ({sql_values(_CHARS)}) v(character, root)), links AS (SELECT * FROM ({sql_values(_LINKS)}) v(parent, child, position)), nodes AS (SELECT * FROM ({sql_values(_NODES)}) v(node, kind, value))"


def _dag(s):
    return values(s, "character string, root int", _CHARS), values(s, "node int, kind string, value string", _NODES), values(s, "parent int, child int, position int", _LINKS)


@query("GR1_direct_containment", f"WITH {_IDS_CTE} SELECT DISTINCT c.character FROM chars x JOIN links ON child = x.root JOIN chars c ON c.root = parent WHERE x.character = '口'")
def _(s, d):
    c, _n, li = _dag(s)
    return graph.direct_containers(c, li, "口")


@query("GR2_transitive_containment", f"WITH RECURSIVE {_IDS_CTE}, up AS (SELECT root AS node FROM chars WHERE character = '口' UNION SELECT parent FROM up JOIN links ON child = node) SELECT character FROM chars WHERE root IN (SELECT node FROM up)")
def _(s, d):
    c, _n, li = _dag(s)
    return graph.containers(c, li, "口")


@query("GR2_cycle_safe", f"WITH RECURSIVE {_IDS_CTE}, up AS (SELECT root AS node FROM chars WHERE character = '木' UNION SELECT parent FROM up JOIN links ON child = node) SELECT character FROM chars WHERE root IN (SELECT node FROM up)")
def _(s, d):
    c, _n, li = _dag(s)
    return graph.containers(c, li, "木")


@query("GR3_template", f"WITH RECURSIVE {_IDS_CTE}, up AS (SELECT p.node FROM nodes p JOIN links l ON l.parent = p.node AND l.position = 1 JOIN nodes q ON q.node = l.child WHERE p.value = '⿱' AND q.value = '口' AND q.kind = 'char' UNION SELECT parent FROM up JOIN links ON child = node) SELECT character FROM chars WHERE root IN (SELECT node FROM up) ORDER BY 1 LIMIT 500")
def _(s, d):
    c, n, li = _dag(s)
    return graph.structure_search({"op": "⿱", "children": [None, {"char": "口"}]}, c, n, li)


@query("JN6_template_exact", f"WITH {_IDS_CTE} SELECT character FROM chars JOIN nodes ON node = root WHERE value = '⿱' AND node IN (SELECT parent FROM links JOIN nodes ON node = child WHERE position = 1 AND value = '口')")
def _(s, d):
    c, n, li = _dag(s)
    return graph.structure_search({"op": "⿱", "children": [None, {"char": "口"}]}, c, n, li, exact=True)


@query("JN13_ancestors", "SELECT DISTINCT 1000 + n_nationkey AS node FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10) UNION SELECT DISTINCT 2000 + n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10) UNION SELECT 100000 + c_custkey FROM customer WHERE c_custkey < 10")
def _(s, d):
    c = read(s, d, "customer").select((F.lit(1000) + F.col("c_nationkey")).cast("long").alias("parent"), (F.lit(100000) + F.col("c_custkey")).cast("long").alias("child"))
    n = read(s, d, "nation").select((F.lit(2000) + F.col("n_regionkey")).cast("long").alias("parent"), (F.lit(1000) + F.col("n_nationkey")).cast("long").alias("child"))
    return graph.closure(c.where("child < 100010").select(F.col("child").alias("node")), c.unionByName(n))


@query("GR6_folder_tree", """
WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN 'Vol' WHEN n_nationkey % 4 = 2 THEN 'Vol 2' WHEN n_nationkey % 4 = 3 THEN 'Vol/x' ELSE n_name END AS n, r_name AS r, r_regionkey AS rk FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT r_name AS path, 0 AS depth, 'folder' AS kind, 100 + r_regionkey AS id, r_name AS a, r_regionkey AS ak, -1 AS b0, '' AS b, -1 AS bk, -1 AS c0, '' AS c, -1 AS ck FROM region
 UNION ALL SELECT r || '/' || n, 1, 'folder', 200 + n_nationkey, r, rk, 0, n, n_nationkey, -1, '', -1 FROM n
 UNION ALL SELECT r || '/' || n || '/' || c_name, 2, 'document', c_custkey, r, rk, 0, n, n_nationkey, 1, c_name, c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey)
SELECT row_number() OVER (ORDER BY a, ak, b0, b, bk, c0, c, ck) AS place, path, depth, kind, id::BIGINT AS id FROM x""")
def _(s, d):
    r = read(s, d, "region").select((F.lit(100) + F.col("r_regionkey")).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent"))
    k = F.col("n_nationkey") % 4
    name = F.when(k == 1, "Vol").when(k == 2, "Vol 2").when(k == 3, "Vol/x").otherwise(F.col("n_name"))
    n = read(s, d, "nation").select((F.lit(200) + F.col("n_nationkey")).cast("long").alias("id"), name.alias("name"), (F.lit(100) + F.col("n_regionkey")).cast("long").alias("parent"))
    docs = read(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit("").alias("title"), F.col("c_name").alias("filename"), (F.lit(200) + F.col("c_nationkey")).cast("long").alias("parent"))
    # the rows' own order, numbered to be compared
    return graph.tree(r.unionByName(n), docs).withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


@query("VZ1_projection")
def _(s, d):
    return graph.project(read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


# ---- snapshots --------------------------------------------------------------------------------------------------------

@query("MU1_refresh", """
WITH o AS (SELECT p_partkey, p_type FROM part WHERE p_partkey % 11 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_type || '!' ELSE p_type END AS p_type FROM part WHERE p_partkey % 10 <> 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN o.p_type ELSE n.p_type END AS definition,
       CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN n.p_partkey IS NULL THEN 'keep' WHEN o.p_type = n.p_type THEN 'touch' ELSE 'update' END AS change FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""")
def _(s, d):
    p = read(s, d, "part").select("p_partkey", F.col("p_type").alias("definition"))
    new = p.where("p_partkey % 10 <> 0").withColumn("definition", F.when(F.col("p_partkey") % 7 == 0, F.concat("definition", F.lit("!"))).otherwise(F.col("definition")))
    return mutations.refresh_dictionary(p.where("p_partkey % 11 <> 0"), new, ["p_partkey"])


# ---- functions --------------------------------------------------------------------------------------------------------

_PINYIN = [("shui3 guo3", "shuǐ guǒ", "ㄕㄨㄟˇ ㄍㄨㄛˇ", "shui³ kuo³"), ("lv4", "lǜ", "ㄌㄩˋ", "lü⁴"), ("ma5", "ma", "ㄇㄚ˙", "ma⁵"), ("liu2 dou4", "liú dòu", "ㄌㄧㄡˊ ㄉㄡˋ", "liu² tou⁴"), ("xue2 zhong1", "xué zhōng", "ㄒㄩㄝˊ ㄓㄨㄥ", "hsüeh² chung¹"), ("abc", "abc", "abc", "abc")]


@query("FN2_pinyin_formats", f"SELECT * FROM ({sql_values(_PINYIN)}) v(p, marked, zhuyin, wade_giles)")
def _(s, d):
    p = F.col("p")
    return values(s, "p string", [(x[0],) for x in _PINYIN]).select("p", P.formatted(p, "marked-pinyin").alias("marked"), P.formatted(p, "zhuyin").alias("zhuyin"), P.formatted(p, "wade-giles").alias("wade_giles"))


_JSON = [('```json\n{"a": 1,}\n```', '{"a": 1}'), ('so {"a": 1} no {"b": [2, 3]}', '{"b": [2, 3]}'), ("none", "none")]


@query("FN7_json_reply", f"SELECT * FROM ({sql_values(_JSON)}) v(reply, json)")
def _(s, d):
    return values(s, "reply string", [(x[0],) for x in _JSON]).select("reply", T.json_object(F.col("reply")).alias("json"))


@query("FN8_digest", "SELECT doc_id, sha256(text) AS sha, base64(encode(lang)) AS b64 FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.base64(F.encode("lang", "UTF-8")).alias("b64"))


@query("FN12_word_diff")
def _(s, d):
    return values(s, "a string, b string", [("one two three", "one 2 three"), ("", "new")]).select("a", "b", T.word_diff(F.col("a"), F.col("b")).alias("diff"))


@query("FN13_prompt", "SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN role <> '' THEN 'Role:' || chr(10) || role END, CASE WHEN text <> '' THEN 'Text:' || chr(10) || text END) AS prompt FROM conversations")
def _(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", providers.prompt(("Role", "role"), ("Text", "text")).alias("prompt"))


@query("CH1_chunks")
def _(s, d):
    pages = read(s, d, "pages").select("page_id", files.markdown(F.col("html")).alias("content"))
    return chunking.chunks(pages, "page_id", "content")


@query("ML1_gazetteer", f"WITH {_SPANS} SELECT chunk, text, type, s, s + length(text)::INT AS e FROM sp WHERE type = 'a'")
def _(s, d):
    types = values(s, "name string, examples array<string>", [("a", ["and", "then"])])
    return providers.Gazetteer().extract(_chunk_docs(s, d), types).select("chunk", "text", "type", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@query("ML5_drafts", "SELECT conv_id * 100 + turn AS chunk, -1 AS draft_number, 'mt:echo' AS translator, text AS content FROM conversations")
def _(s, d):
    return providers.drafts(_chunk_docs(s, d), [(-1, providers.Echo())])


from . import more, stored  # noqa: E402, F401  (they add their queries)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

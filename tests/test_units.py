from __future__ import annotations

import random
import sqlite3

import pytest

from inkstone.functions import pinyin
from inkstone.functions.text import last_json_object
from inkstone.operators import search
from inkstone.operators.context import page_token
from inkstone.operators.graph import validate
from inkstone.operators.mutations import set_preferences
from inkstone.sources.files import html_to_markdown, parse_ids


def test_parse_ids():
    assert parse_ids("") == []
    assert [r[4] for r in parse_ids("⿰讠⿱五口")] == ["⿰", "讠", "⿱", "五", "口"]
    assert parse_ids("⿹②一")[1][3:] == ("unencoded", "2")
    assert parse_ids("⿰木𠀀")[2][4] == "𠀀"
    assert len(parse_ids("⿱一亅木")) == 3
    with pytest.raises(ValueError):
        parse_ids("⿰木")


def test_pinyin():
    assert pinyin.convert("mai4 jie2 gui4 dou4 ma5 lv4 ni", "marked-pinyin") == "mài jié guì dòu ma lǜ ni"
    assert pinyin.convert("zhi1 si4 yi1 wu3 yu2 yuan2 wei4 wo3 you3", "zhuyin") == "ㄓ ㄙˋ ㄧ ㄨˇ ㄩˊ ㄩㄢˊ ㄨㄟˋ ㄨㄛˇ ㄧㄡˇ"
    assert pinyin.convert("zhi1 si4 qi4 xue2", "wade-giles") == "chih¹ ssu⁴ ch'i⁴ hsüeh²"
    assert pinyin.convert("x1", "pinyin") == "x1"


def test_json():
    assert last_json_object('x {"a": [1,],} y') == '{"a": [1]}'
    assert last_json_object("nothing") == "nothing"
    assert last_json_object('{"a": {"b": 1}} then {broken} and } {"c": "2"}') == '{"a": {"b": 1}}'
    assert last_json_object('```json\n[1,]\n```') == "[1]"
    assert last_json_object('{"a": 1} {"b": 2,} {"c"') == '{"b": 2}'


def test_markdown():
    assert html_to_markdown("<nav>x</nav><h1>T</h1><p>a <b>b</b></p><ul><li>c</ul><script>z</script>") == "# T\n\na b\n\n- c"


def test_template_limits():
    validate({"op": "⿰", "children": [None, {"char": "口"}]})
    for bad in ({"op": "x"}, {"char": "ab"}, {"op": "⿰", "char": "口"}):
        with pytest.raises(ValueError):
            validate(bad)
    deep = {"char": "口"}
    for _ in range(8):
        deep = {"op": "⿰", "children": [deep, None]}
    with pytest.raises(ValueError):
        validate(deep)


def test_client_query():
    assert search.client_query("ma TONE:3 tone:9 def:horse shui def:") == {"text": "ma shui", "tone": "3", "def": "horse"}


def test_preferences():
    assert set_preferences({"script": "x", "theme": None}, {"script": "y"}, {"script": "s", "theme": "t"}) == {"script": "y", "theme": "t"}


ENTRIES = [(1, "水", "水", "shui3", "water; river"), (2, "水果", "水果", "shui3 guo3", "fruit"), (3, "喝水", "喝水", "he1 shui3", "to drink water"), (4, "司马", "司馬", "Si1 ma3", "surname Sima"), (5, "四", "四", "si4", "four"), (6, "绿", "綠", "lü4", "green"), (7, "旅", "旅", "lu:3", "trip")]


@pytest.mark.parametrize("q", ["水", "水*", "果", "si4", "si", "si*", "lu*", "shui", "shui guo", "river, liquid", "lu:3", "co-op", "four AND", "*", "SI"])
@pytest.mark.parametrize("headwords", [False, True])
def test_full_text_as_sqlite(spark, q, headwords):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(simplified, traditional, pinyin, definitions_text)")
    db.executemany("INSERT INTO f(rowid, simplified, traditional, pinyin, definitions_text) VALUES (?, ?, ?, ?, ?)", ENTRIES)
    expression = search.with_wildcards(search.sanitise(q))
    try:
        want = {r[0] for r in db.execute("SELECT rowid FROM f WHERE f MATCH ?", (("{simplified traditional pinyin}: " if headwords else "") + expression,))}
    except sqlite3.OperationalError:
        want = set()
    df = spark.createDataFrame(ENTRIES, "id int, simplified string, traditional string, pinyin string, definitions_text string")
    assert {r["id"] for r in search.search(df, q, headwords=headwords).collect()} == want


def test_limits(spark):
    df = spark.createDataFrame(ENTRIES, "id int, simplified string, traditional string, pinyin string, definitions_text string")
    assert [r["id"] for r in search.search(df, tone="3", limit=2).collect()] == [7, 1]
    assert {r["id"] for r in search.search(df, "水", substring=True).collect()} == {1, 2, 3}
    assert search.search(df).count() == 0
    with pytest.raises(ValueError):
        search.search(df, "x", limit=-1)


def test_page_token():
    assert page_token("2020-01-01", 5)


def test_lexicon_stream(spark, tmp_path):
    from inkstone.streaming.lexicon import counters

    spark.createDataFrame([("a", "learn", 1), ("a", "fail", 2), ("b", "learn", 3), ("a", "learn", 4)], "term string, kind string, ts long").write.parquet(str(tmp_path / "in"))
    q = counters(spark.readStream.schema("term string, kind string, ts long").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("lexicon_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("lexicon_counts").collect()} == {("a", 2, 1, 4), ("b", 1, 0, 3)}


def test_search_takes_every_twentieth(spark, tmp_path, monkeypatch):
    from inkstone.operators import vectors as search_vectors
    from inkstone.plans import catalog

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = {x["vec_id"]: x for x in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want = set()
    for q in range(0, 200, 20):
        score = {i: round(sum(a * b for a, b in zip(vectors[q]["embedding"], x["embedding"], strict=True)), 6) for i, x in vectors.items()}
        top = sorted(score, key=lambda i: (-score[i], i))[:8]
        want |= {(q, i) for i in [i for i in top if i != q and not (i % 2 == 0 and i % 3 == q % 3)][:3]}
    for block in (1024, 4):
        monkeypatch.setattr(search_vectors, "BLOCK", block)
        assert {(x["query"], x["id"]) for x in catalog.queries()["TK2_vector_top_k"](spark, str(tmp_path)).collect()} == want


def test_whole_tables(spark):
    from inkstone.plans import catalog

    d, q = "/root/testdata/sf0.001", catalog.queries()
    parts = [(x["p_partkey"], x["p_size"] % 10, x["p_name"]) for x in spark.read.parquet(f"{d}/part.parquet").collect()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    root = {i: i for i, _, _ in parts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, doc, a in parts:
        for j, other, b in parts:
            if i < j and doc == other and (a == b or (min(len(a), len(b)) >= 3 and distance(a, b) < 0.3 * max(len(a), len(b)))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    roots = {i: find(i) for i in root}
    assert {(x["v"], x["root"]) for x in q["CO4_components"](spark, d).collect()} == set(roots.items())
    sizes = {x: list(roots.values()).count(x) for x in set(roots.values())}
    assert {(x["root"], x["members"]) for x in q["CO5_merged_entities"](spark, d).collect()} == {(x, n) for x, n in sizes.items() if n > 1}
    assert all(roots[x["u"]] == roots[x["v"]] for x in q["CO3_coreference_edges"](spark, d).collect())
    table = lambda n: spark.read.parquet(f"{d}/{n}.parquet").collect()
    custs = {x["c_custkey"]: x["c_nationkey"] for x in table("customer")}
    names = {x["n_nationkey"]: x["n_name"] for x in table("nation") if x["n_regionkey"] < 3}
    assert {tuple(x) for x in q["JN2_two_roles_left"](spark, d).collect()} == {(x["s_suppkey"], c, names.get(n)) for x in table("supplier") for c, n in custs.items() if n == x["s_nationkey"]}
    orders = {x["o_orderkey"]: x["o_custkey"] for x in table("orders")}
    up = lambda c: 1000000 + custs[c] if c % 2 == 0 else c
    ends = {(orders[x["l_orderkey"]], x["l_suppkey"], x["l_returnflag"]) for x in table("lineitem") if x["l_orderkey"] in orders}
    assert {tuple(x) for x in q["RL3_promotion"](spark, d).collect()} == {(up(a), up(b), t) for a, b, t in ends if a in custs and b in custs and up(a) != up(b)}
    assert {tuple(x) for x in q["SRC6_blob_round_trip"](spark, d).collect()} == {(x["doc_id"], x["text"]) for x in table("documents")}


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from inkstone.operators import graph

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.scratch(spark)


def test_written_markdown(spark, tmp_path):
    from inkstone.sources import files

    df = spark.createDataFrame([("a", "x"), ("b", None)], "location string, content string")
    files.write_markdown(df, str(tmp_path / "md"))
    assert {tuple(r) for r in files.read_markdown(df.select("location"), str(tmp_path / "md")).collect()} == {("a", "x"), ("b", None)}
    with pytest.raises(Exception, match="nothing is stored"):
        files.read_markdown(spark.createDataFrame([("c",)], "location string"), str(tmp_path / "md")).collect()


def test_search_operators():
    from inkstone.operators import search

    terms, tree = search.parse_operators(search.parse_definition("a b NOT c AND d OR e*"))
    assert [t.text for t in terms] == ["a", "b", "c", "d", "e"] and tree == ("OR", ("AND", ("NOT", ("AND", 0, 1), 2), 3), 4)
    assert terms[0].columns == ("definitions_text",) and not terms[1].columns and terms[4].prefix
    for bad in ("a OR", "NOT a", "a AND OR b"):
        with pytest.raises(search.Malformed):
            search.parse_operators(search.parse_definition(bad))


def test_occurrences_read_whole_queries(spark):
    from inkstone.operators import search

    q = spark.createDataFrame([(1, "x" * 30 + "ab")], "query_id int, text string")
    forms = spark.createDataFrame([("ab",)], "form string")
    assert [(r["pos"], r["form"]) for r in search.occurrences(q, forms).collect()] == [(31, "ab")]
    assert search.occurrences(q, forms, search.ENDPOINT).count() == 0

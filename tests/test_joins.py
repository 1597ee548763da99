"""Chunks, searches and joins against plain Python, on odd rows and on more rows than a task should hold."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pytest

from inkstone.operators import chunking, graph, mutations, similarity, spans, vectors


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, body string").selectExpr("doc", "body", "1 AS lines", "2 AS parts", "3 AS s", "4 AS whole")
    out = [[] for _ in texts]
    for r in chunking.chunks(df, "doc", "body").orderBy("doc", "chunk_order").collect():
        assert r["chunk_order"] == len(out[r["doc"]])
        assert r["text"] == (texts[r["doc"]] or "").replace("\r\n", "\n")[r["s"] : r["e"]]
        out[r["doc"]].append((r["s"], r["e"]))
    return out


def test_chunk_sizes(spark):
    """Empty, blank and null texts, one long block, blank lines inside a fence, a small last chunk, small paragraphs, headings over and under."""
    tail = "A" * 600 + "\n\n" + "B" * 600 + "\n\ntiny"
    long = "w" * 250
    texts = ["", None, " \n\n ", "A" * 99, "A" * 5000, "```\n" + "x\n\n" * 1000 + "```", tail, "\n\n".join(["w" * 90] * 20), f"{long}\n# H\n{long}", f"{long}\nTitle\n---\n{long}", f"{long}\n\nTitle\n---\n{long}", f"{long}\r\n- a\r\n- b\r\n***\r\n{long}", "~~~~\n```\n~~~\n\n~~~~\n" + long]
    got = spans_of(spark, texts)
    assert got[:5] == [[], [], [], [(0, 99)], [(0, 5000)]]
    assert len(got[5]) == 1
    assert got[6] == [(0, 600), (602, len(tail))]
    assert len(got[7]) == 7
    assert got[8] == [(0, 250), (251, 505)]
    assert got[9] == [(0, 256), (261, 511)]  # a text of two lines is no heading; the rule ends it
    assert got[10] == [(0, 250), (252, 512)]
    assert got[11] == [(0, 258), (263, 513)]
    assert len(got[12]) == 1


def test_chunk_invariants(spark):
    r = random.Random(1)
    kinds = ["# Head", "para " * 30, "- item", "---", "", "> quote", "```", "    code", "text", "====", "~~~", "é" * 90]
    texts = ["\n".join(r.choice(kinds) for _ in range(r.randrange(40))) for _ in range(200)]
    for text, got in zip(texts, spans_of(spark, texts), strict=True):
        last = 0
        for s, e in got:
            assert last <= s < e <= len(text)
            assert text[s:e] == text[s:e].strip()
            last = e


@lru_cache(maxsize=None)
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("share", [0.3, 0.2, 0.5])
def test_similar_texts(spark, share):
    """All pairs below the share, of all lengths, within groups only; short texts, other scripts and nulls."""
    r = random.Random(2)
    base = ["".join(r.choice("abcdé語") for _ in range(r.randrange(1, 26))) for _ in range(60)]
    texts = {("g", t) for t in base}
    for t in base:
        for _ in range(3):
            chars = list(t)
            for _ in range(r.randrange(1, 7)):
                k = r.randrange(len(chars) + 1)
                chars[k : k + r.randrange(2)] = r.choice(["", "x", "語", "ab"])
            texts.add((r.choice("gh"), "".join(chars)))
    rows = [(g, i, t) for i, (g, t) in enumerate(sorted(texts))] + [(None, 999, "abc"), ("g", 998, None)]
    got = {(x["a"], x["b"], x["g"]) for x in similarity.near(spark.createDataFrame(rows, "g string, id int, text string"), ["g"], share).collect()}
    own = sorted(texts)
    want = {(max((len(a), a), (len(b), b))[1], min((len(a), a), (len(b), b))[1], g) for g, a in own for h, b in own if g == h and a < b and distance(a, b) < share * max(len(a), len(b))}
    assert got == want and want


def test_similar_texts_are_found_without_all_pairs(spark):
    """5,000 texts of one group: what shares a piece is a small part of 12.5 million pairs."""
    r = random.Random(3)
    names = [("g", i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randrange(8, 24)))) for i in range(5000)]
    names += [("g", 10_000 + i, t[:5] + "_" + t[6:]) for _, i, t in names[:100]]
    df = spark.createDataFrame(names, "g string, id int, text string")
    assert similarity.candidates(df, ["g"]).select("u", "v").distinct().count() < 12_500_000 // 10
    found = {(min(x["u"], x["v"]), max(x["u"], x["v"])) for x in similarity.near(df, ["g"]).collect()}
    assert {(i, 10_000 + i) for i in range(100)} <= found


def places(content, text):
    out, at = [], content.find(text)
    while at >= 0:
        out.append((at, at + len(text)))
        at = content.find(text, at + len(text))
    return out


def test_spans(spark):
    """Texts of any length and letters, overlapping themselves, with pattern signs; nulls, empty ones, repeated rows, two types of a text."""
    r = random.Random(4)
    contents = ["".join(r.choice("ab.*é\n語$") for _ in range(r.randrange(0, 60))) for _ in range(40)] + ["aaaaa", "", None, "\\E.\\Q", "\U0001f600a\U0001f600a"]
    texts = sorted({"".join(r.choice("ab.*é語") for _ in range(r.randrange(1, 9))) for _ in range(120)} | {"aa", "$", "\\E", "\U0001f600a", "a\U0001f600"})
    rows = [(i, c) for i, c in enumerate(contents)] + [(1, contents[1]), (3, "other a.b")]
    kinds = [(t, "x") for t in texts] + [("aa", "y"), ("aa", "x"), ("", "x"), (None, "x")]
    got = sorted(tuple(x) for x in spans.find_spans(spark.createDataFrame(rows, "chunk int, content string"), spark.createDataFrame(kinds, "text string, type string")).collect())
    want = sorted((i, t, k, s, e) for i, c in rows if c for t, k in {x for x in kinds if x[0]} for s, e in places(c, t))
    assert got == want and want


def test_many_texts(spark):
    """200,000 texts are sought at once, and not each in each chunk: no nested loop, no cross join."""
    chunks = spark.createDataFrame([(i, f"name {i * 7} and name {i} at the end") for i in range(500)], "chunk int, content string")
    texts = spark.range(200_000).selectExpr("concat('name ', id, ' ') AS text", "'n' AS type")
    found = spans.find_spans(chunks, texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 1000


def test_nearest(spark, monkeypatch):
    """Exact by slices and blocks and through all cells; the index finds nine of ten; ties, nulls, no rows, many queries."""
    r = np.random.default_rng(5)
    v = r.normal(size=(600, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[17] = v[16]
    rows = [(i, [float(x) for x in u]) for i, u in enumerate(v)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None)], "id long, v array<double>")
    q = df.where("id % 20 = 0").selectExpr("id AS query", "v AS q")
    monkeypatch.setattr(vectors, "SLICE", 100)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    want = set()
    for i in range(0, 600, 20):
        score = np.round(v @ v[i], 6)
        want |= {(i, int(j)) for j in np.lexsort((np.arange(600), -score))[:8]}
    pairs = lambda found: {(x["query"], x["id"]) for x in found.collect()}
    exact = vectors.nearest(q, df)
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs(exact) == want
    path = graph.scratch(spark)
    probes = vectors.build(df, path)
    assert 1 <= probes <= 25
    assert pairs(vectors.search(q, path, probes=0)) == want
    hits = vectors.recall(vectors.search(q, path), exact).selectExpr("sum(hits) / sum(of) AS r").first()["r"]
    assert hits >= 0.9
    assert vectors.nearest(q.limit(0), df).count() == vectors.nearest(q, df.limit(0)).count() == 0
    monkeypatch.setattr(vectors, "BLOCK", 1024)
    assert vectors.nearest(df.selectExpr("id AS query", "v AS q").where("id < 600"), df, k=1).count() == 600


def test_repeated_changes(spark):
    """The last change of an id counts, whatever columns rows have; a target that is no folder does not undo an earlier move."""
    folders = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    names = spark.createDataFrame([(1, "x", 1), (1, " y ", 3), (1, "z", 2), (2, " ", 9), (None, "n", 1)], "id int, name string, seq int")
    assert sorted(map(tuple, mutations.rename_folders(folders, names).collect())) == [(1, "y"), (2, "B")]
    assert mutations.rename_folders(folders, names.drop("seq")).count() == 2
    docs = spark.createDataFrame([(1, 1, True, "a"), (2, 2, False, "b"), (2, 2, False, "b")], "id int, parent int, moves boolean, _to string")
    moves = spark.createDataFrame([(1, 2, 1), (1, None, 2), (1, 77, 3), (2, 1, 1), (2, 1, 1)], "id int, target int, seq int")
    out = mutations.move_documents(docs, moves, folders)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None, True, "a"), (2, 1, False, "b"), (2, 1, False, "b")]


def test_dealt_join(spark, monkeypatch):
    """A join of few keys gives what a plain one does, and no task makes a whole key's rows."""
    from inkstone.operators import context

    monkeypatch.setattr(context, "DEALT", 16)
    monkeypatch.setattr(context, "MADE", 500)
    left = [(i, i % 3 if i % 7 else None) for i in range(200)]
    right = [(i, i % 2 if i % 5 else None) for i in range(100)]
    a, b = spark.createDataFrame(left, "l long, k int"), spark.createDataFrame(right, "r long, k int")
    out = context.dealt_join(a, b, "k").select("l", "r", "k")
    want = sorted((x, y, k) for x, k in left for y, j in right if k is not None and k == j)
    assert sorted(tuple(x) for x in out.collect()) == want
    tasks = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(tasks) > 4 and max(tasks) < len(want) / 2  # two keys have rows on both sides
    assert context.dealt_join(a, b.where("k > 5"), "k").count() == 0


def test_dealt_join_columns(spark, monkeypatch):
    """Several columns with nulls and repeated rows on either side, or none but the key; groups of one line and of many."""
    from inkstone.operators import context

    monkeypatch.setattr(context, "LINE", 8)
    left = [(i % 50, "x" if i % 3 else None, i % 4 if i % 9 else None) for i in range(120)]
    right = [(i % 40, None if i % 5 else "y", [i % 7], i % 3) for i in range(90)]
    a, b = spark.createDataFrame(left, "l long, m string, k int"), spark.createDataFrame(right, "r long, s string, t array<int>, k int")
    want = sorted(str((k, x, m, r, s, t)) for x, m, k in left for r, s, t, j in right if k == j)
    for dealt in (16_384, 4):
        monkeypatch.setattr(context, "DEALT", dealt)
        got = context.dealt_join(a, b, "k")
        assert got.columns == ["k", "l", "m", "r", "s", "t"]
        assert sorted(str(tuple(x)) for x in got.collect()) == want
        assert context.dealt_join(a.select("k"), b.select("k"), "k").count() == len(want)


def test_dealt_join_disk(spark, monkeypatch, tmp_path):
    """What a key's rows take in the shuffle grows with the rows, not with their square, and what is written takes little room."""
    from inkstone.operators import context

    put = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "repartition", lambda self, *a, f=frame.repartition: put.append(self.count()) or f(self, *a))
    for n in (20_000, 80_000):
        side = lambda name, n=n: spark.range(n).selectExpr(f"id AS {name}", "1 AS k")
        put.clear()
        context.dealt_join(side("l"), side("r"), "k")
        assert put and sum(put) <= 5 * 2 * n
    left, right = spark.range(2000).selectExpr("id AS l", "1 AS k"), spark.range(1237).selectExpr("id AS r", "1 AS k")
    context.dealt_join(left, right, "k").write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 2000 * 1237
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * 2000 * 1237


def test_distances(spark, tmp_path):
    """Repeated names meet once, and rows are those of SQL, null names too."""
    import duckdb

    from inkstone.plans import catalog, more  # noqa: F401

    rows = [("abc", 1, "x"), ("abd", 1, "x"), (None, 1, "x"), ("abd", 2, "y"), ("abc", 2, "y"), ("zz", 3, None), ("q", None, "x")] * 300
    spark.createDataFrame(rows, "p_name string, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    out = catalog.queries()["CO2_distance"](spark, str(tmp_path))
    key = lambda x: str(tuple(x))
    assert sorted(map(key, out.collect())) == sorted(map(key, con.sql(catalog.oracle_sql()["CO2_distance"]).fetchall()))
    done = spans.distances(spark.createDataFrame(rows, "text string, size int, brand string"), ["size", "brand"])
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") > plan.rindex("Join")  # names are made distinct below the join


def test_queries_go_to_slices_not_cells(spark, monkeypatch, tmp_path):
    """A query goes to a slice once, however many of its cells it reads there; what is found is the best of the cells read."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, rows[3][1])], "id long, v array<double>")
    monkeypatch.setattr(vectors, "LEAST", 100)
    monkeypatch.setattr(vectors, "SLICE", 200)
    vectors.build(df, path := str(tmp_path / "index"), cells=30, k=4)
    held = spark.read.parquet(f"{path}/vectors")
    near = np.array([r["v"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    first, parts = vectors._places(held)
    slices = int((first + parts).max())
    asks = df.where("id % 20 = 0").selectExpr("id AS query", "v AS q")
    assert slices < 12 and vectors._asked(asks, near, len(near) - 1, first, parts).count() <= asks.count() * slices
    cell = {r["id"]: r["cell"] for r in held.select("id", "cell").collect()}
    for probes in (0, 1, 7):
        got = sorted(tuple(r) for r in vectors.search(asks, path, 4, probes).collect())
        want = []
        for i in [*range(0, 600, 20), 600]:
            q = np.array(dict([*rows, (600, rows[3][1])])[i])
            read = set(np.argsort((near**2).sum(1) / 2 - near @ q, kind="stable")[: probes or len(near)])
            all_ = sorted((-round(float(q @ np.array(v)), 6), j) for j, v in [*rows, (600, rows[3][1])] if cell[j] in read)
            want += [(i, j, -s) for s, j in all_[:4]]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(want, key=lambda x: (x[0], x[1]))], probes

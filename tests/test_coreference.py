"""Merged entities: rules of a merge, and changes of one document against a merge of all."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkstone.operators.coreference import Merged, between, merge

MENTION = "id long, doc long, type string, text string"
ENTITY = MENTION + ", parent long, label string, scope string, chunk int"
EDGE = "doc long, from_id long, to_id long, edge_type string"
ROWS = [(1, 1, "P", "Confucius"), (2, 1, "P", "Confucius"), (3, 1, "P", "Confucias"), (4, 1, "L", "Confucius"), (5, 1, "P", "Mo"), (6, 2, "P", "Confucius"), (7, 2, "P", "Mencius"), (8, 2, "P", "Mencius"), (9, None, "P", "Mencius"), (10, 3, "P", "Xunzi"), (11, 3, "P", None)]
EDGES = [(1, 1, 5, "KNEW"), (1, 3, 5, "KNEW"), (1, 1, 3, "SAME"), (1, 5, 2, "TOLD"), (2, 6, 7, "KNEW"), (2, 6, 8, "KNEW"), (2, 6, 99, "LOST"), (3, 10, 11, "KNEW")]


def entities(df):
    return {r.id: (r.doc, r.type, r.text, r.parent, r.label, r.scope) for r in df.collect()}


def links(df):
    return sorted((r.doc, r.from_root, r.to_root, r.edge_type) for r in df.collect())


def test_merge(spark):
    old = [(i, 1, "P", t, -77, None, "chunk", i * 10) for i, t in enumerate(["a", "b", "b", "c", "d", "d"], 1)] + [(-77, 1, "P", None, None, "old", "document", None)]
    groups = [(1, 1, 1), (1, 1, 2), (1, 1, 2), (1, 1, 99), (1, 2, 2), (1, 2, 3), (1, 3, 4), (1, 3, 98), (1, 4, 5), (1, 4, 6), (1, None, 1), (1, 5, None), (2, 1, 1)]
    labels = [(1, 1, " both "), (1, 2, "not needed"), (1, 4, " ")]
    out = merge(spark.createDataFrame(old, ENTITY), spark.createDataFrame(groups, "doc long, seq long, id long"), spark.createDataFrame(labels, "doc long, seq long, label string"))
    got = entities(out)
    # group 1 lost 2 to group 2; group 3 has one known member
    assert {i: x[3] for i, x in got.items() if i > 0} == {1: -1, 2: -2, 3: -2, 4: None, 5: -5, 6: -5}
    assert {i: x[4] for i, x in got.items() if i < 0} == {-1: "both", -2: "b", -5: "d"}
    assert {r.id: r.chunk for r in out.collect()}[3] == 30


def test_merge_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, seq long, id long")
    assert merge(spark.createDataFrame([], ENTITY), none).count() == 0
    one = spark.createDataFrame([(1, 1, "P", "a", -1, None, "chunk", 1)], ENTITY)
    assert entities(merge(one, none)) == {1: (1, "P", "a", None, None, "chunk")}


@pytest.fixture
def merged(spark, tmp_path):
    m = Merged(str(tmp_path / "m"), buckets=8)
    m.create(spark.createDataFrame(ROWS, MENTION), spark.createDataFrame(EDGES, EDGE))
    return m


def again(spark, tmp_path, rows, edges):
    """The same tables made from the start."""
    m = Merged(str(tmp_path / "again"), buckets=8)
    m.create(spark.createDataFrame(rows, MENTION), spark.createDataFrame(edges, EDGE))
    return m


def same(spark, a, b):
    assert entities(a.read(spark, "entities")) == entities(b.read(spark, "entities"))
    assert links(a.read(spark, "document_edges")) == links(b.read(spark, "document_edges"))


def test_create(spark, merged):
    got = entities(merged.read(spark, "entities"))
    assert {i: x[3] for i, x in got.items() if i > 0} == {1: -1, 2: -1, 3: -1, 4: None, 5: None, 6: None, 7: -7, 8: -7, 9: None, 10: None, 11: None}
    assert got[-1] == (1, "P", None, None, "Confucius", "document")
    assert links(merged.read(spark, "document_edges")) == [(1, -1, 5, "KNEW"), (1, 5, -1, "TOLD"), (2, 6, -7, "KNEW"), (3, 10, 11, "KNEW")]
    assert between(spark.createDataFrame([], EDGE), merged.read(spark, "entities")).count() == 0


def test_added_mention_merges_its_document(spark, merged, tmp_path):
    new, edge = [(12, 2, "P", "Mencius"), (13, 2, "P", "Confucius")], [(2, 12, 13, "MET")]
    merged.change(spark, [2], spark.createDataFrame(new, MENTION), spark.createDataFrame(edge, EDGE))
    same(spark, merged, again(spark, tmp_path, ROWS + new, EDGES + edge))
    # the same change once more changes nothing
    merged.change(spark, [2], spark.createDataFrame(new, MENTION), spark.createDataFrame(edge, EDGE))
    assert entities(merged.read(spark, "entities"))[6][3] == -6


def test_mentions_that_go(spark, merged, tmp_path):
    merged.change(spark, [2], gone=[7])
    same(spark, merged, again(spark, tmp_path, [r for r in ROWS if r[0] != 7], [e for e in EDGES if 7 not in e[1:3]]))
    merged.change(spark, [1, 2, 3], gone=[1, 2, 3, 4, 5, 6, 8, 10, 11])
    assert entities(merged.read(spark, "entities")).keys() == {9}
    assert links(merged.read(spark, "document_edges")) == []


def test_other_documents_are_left_alone(spark, merged, tmp_path):
    mine = spark.range(1).select(merged.bucket(F.lit(2)).alias("b")).first()["b"]
    others = lambda: {p: p.stat().st_mtime_ns for p in Path(merged.path).glob("*/bucket=*/*.parquet") if p.parent.name != f"bucket={mine}"}
    before, new = others(), [(12, 2, "P", "Mencius")]
    assert before
    merged.change(spark, [2], spark.createDataFrame(new, MENTION))
    assert others() == before
    # what a change reads is chosen by folder
    plan = merged.read(spark, "entities", [mine])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    same(spark, merged, again(spark, tmp_path, ROWS + new, EDGES))


def test_rows_of_documents_that_are_not_named(spark, merged):
    with pytest.raises(Exception, match="not named"):
        merged.change(spark, [2], spark.createDataFrame([(12, 1, "P", "x")], MENTION))


def test_joins_different_texts_only(spark, monkeypatch):
    """Copies of a text take over its group: what is joined into groups grows with different texts, not with mentions."""
    from inkstone.operators import coreference

    seen, own = [], coreference.components

    def components(nodes, edges):
        seen.append((nodes.count(), edges.count()))
        return own(nodes, edges)

    monkeypatch.setattr(coreference, "components", components)
    rows = [(10 * i + j, 1 + i % 2, "N", t) for i in range(40) for j, t in enumerate(("large ring", "large rink", "cold plate"))] + [(9001, 1, "N", None), (9002, 1, "N", None)]
    got = {r.id: r.seq for r in coreference.by_names(spark.createDataFrame(rows, "id long, doc int, type string, text string")).collect()}
    first = {1: 0, 2: 10}
    assert got == {i: i if t is None else first[d] + (2 if t == "cold plate" else 0) for i, d, _, t in rows}
    assert seen[0][0] <= 7 and seen[0][1] <= 6

"""What near duplicates ask of the driver: no broadcasts, no rounds for links that need none."""

from __future__ import annotations

import random

from inkstone.llm import components as C
from inkstone.llm import minhash


def test_no_broadcasts(spark, monkeypatch):
    """Every table that is stored on the way, and the result, is planned without a side that passes through the driver."""
    r, plans, own = random.Random(5), [], minhash.stored
    words = ["".join(r.choice("abcdef") for _ in range(6)) for _ in range(200)]
    texts = [[r.choice(words) for _ in range(60)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join([*t[:-1], "other"])) for i, t in enumerate(texts[:8])] + [(200, " ".join([*texts[0][:-2], "other", "words"]))]

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(minhash, "stored", stored)
    monkeypatch.setattr(C, "stored", stored)
    out = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {x["doc_id"]: x["component_id"] for x in out.collect()} == {i: 0 if i == 200 else i % 100 for i, _ in rows}
    assert len(plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_rounds(spark, monkeypatch):
    """Stars need no round; a chain, a ring, repeated and turned edges and a loop come to their smallest node."""
    rounds, own = [], C.stored

    def stored(df):
        rounds.append(1)
        return own(df)

    monkeypatch.setattr(C, "stored", stored)

    def found(links):
        e = C.edges(spark.createDataFrame(links, "u long, v long"))
        rounds.clear()
        return {x["v"]: x["root"] for x in C.components(e).collect()}

    assert found([(1, 2), (3, 1), (1, 2), (7, 8), (5, 5)]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert not rounds
    assert found([]) == {}
    chain = [(i, i + 1) for i in range(40, 0, -1)]
    ring = [(100, 103), (103, 101), (101, 102), (102, 100), (102, 100)]
    assert found(chain + ring) == {i: 1 for i in range(1, 42)} | {i: 100 for i in range(100, 104)}
    assert rounds

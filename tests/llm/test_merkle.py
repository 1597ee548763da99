"""Operator 13 against a tree built in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from inkstone.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc, text):
    return h(*(part(x) for x in (doc[0], doc[3], doc[2], doc[4], text)))


def tree(leaves):
    """The root, and for each leaf the siblings (left, right) on each level."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, k in enumerate(at):
            run = runs[k // 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        level, at = [h(*run) for run in runs], [k // 16 for k in at]
    return level[0], paths


def plain(docs):
    by = defaultdict(list)
    for d in docs:
        by[d[3]].append(d)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
    trees = {s: tree([leaf(d, d[1]) for d in by[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, shared in zip(names, above, strict=True):
        for d, path in zip(by[s], trees[s][1], strict=True):
            low = d[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1])
            node = leaf(d, low if d[0] is not None and crc32(str(d[0]).encode()) % 5 == 0 else d[1])
            for left, right in path + shared:
                node = h(left, node, right)
            out.append((d[0], leaf(d, d[1]), trees[s][0], root, h(*(x + y for x, y in path + shared)), node, node == root))
    return sorted(out, key=str)


def found(spark, docs, **more):
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS place", "'q' AS `group`", "2 AS total", "3 AS digest").repartition(4)
    out = merkle.manifest(df, merkle.spoiled(df), **more)
    assert out.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return out


def test_manifest(spark):
    """A hot source of three levels, more sources than a block holds, lone rows, nulls in every column, ties and repeated rows."""
    r = random.Random(1)
    docs = [(r.randrange(10**12), r.choice(["Some Text", "low", "Ä B", ""]) + str(i), "en", "hot", i) for i in range(700)]
    docs += [(i, "X" * (i % 7), r.choice(["en", None]), f"s{i}", None) for i in range(290)]
    docs += [(None, None, None, None, None), (None, "A", "de", None, 1), (5, None, "-", "-", -3), (2**60 + 1, "Big", "en", "é", 3), (2**60 + 2, "Big", "en", "é", 3)]
    docs += [(3, "Same", "en", "hot", 4)] * 20 + [(3, "Other", "en", "hot", 5), (8, "L" * 300_000, "en", "", 1)]
    rows = [tuple(x) for x in found(spark, docs).collect()]
    assert sorted(rows, key=str) == plain(docs)
    assert {x[6] for x in rows} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_sizes(spark, n):
    docs = [(i, f"Text {i}", "en", "a", i) for i in range(n)]
    rows = found(spark, docs, with_paths=True).collect()
    assert sorted((tuple(x)[:7] for x in rows), key=str) == (plain(docs) if n else [])
    for x in rows:
        assert h(*(a + b for a, b in zip(x["lefts"], x["rights"], strict=True))) == x["proof_sha256"]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256])
def test_paths(n):
    """Scheduled paths are those of the whole tree, also of a block that ends early below a tall tree."""
    leaves = [h(str(i)) for i in range(n)]
    root, want = tree(leaves)
    height = merkle.levels(n)
    assert merkle.root(leaves, height) == root
    assert list(merkle.paths(leaves, height)) == want
    for own, path in zip(leaves, merkle.paths(leaves, 2), strict=True):
        for left, right in path:
            own = h(left, own, right)
        assert own == merkle.root(leaves, 2)

"""Each stage of the pipeline and the whole of it against plain Python, with odd rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from test_llm import base, classes, shingles

import corpus_pipeline as P
from inkstone.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, base int, clean string, n_email int, _gone int, version int, own string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
BIG = (1 << 60) + 1
BAD = ("zxqyr", "zxqyrr", "zxqqyr")


def made():
    r = random.Random(21)
    words = ["".join(r.choice("aeioubcdf") for _ in range(5)) for _ in range(300)]
    out, labels = [], []
    for i in range(700):
        t = [r.choice(words) for _ in range(60)]
        if i % 5 == 0:
            t[::12] = [r.choice(BAD) for _ in t[::12]]
        out.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    clean = [t for i, t in out if i % 5]
    copy = clean[3].split()
    copy[4] = "other"
    out += [(1000, clean[3]), (1001, " ".join(copy)), (1002, f"{clean[7]} {ITEM} {clean[8]}"), (1003, ITEM.upper()), (None, f"{clean[9]} {ITEM}")]
    out += [(1004, f"{clean[11]} write to me@x.org or 10.0.0.1"), (1005, None), (1006, ""), (1006, ""), (None, " ".join([*BAD] * 30)), (None, clean[3]), (1007, "short")]
    out += [(1008, clean[20] + " tail"), (1008, clean[40]), (1010, "b" * 30_000), (BIG, clean[60])]
    return out, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs, labels = made()
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "c", 2, 3, 4, "o") for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def toxic_words(text):
    return sum(w in BAD for w in (text or "").split()) > 2


def kept_by_toxic(rows):
    return Counter({k: n for k, n in rows.items() if not toxic_words(k[1])})


def kept_by_near(rows):
    docs = [k for k in rows if k[0] is not None]
    root = classes({k: shingles(k[1]) for k in sorted(docs, key=lambda k: (k[0], k[1] or ""))})
    least = {}
    for k in docs:
        least[root[k]] = min(least.get(root[k], k[0]), k[0])
    return Counter({k: n for k, n in rows.items() if k[0] is None or least[root[k]] == k[0]})


def kept_by_leaks(rows):
    want = ITEM.split()

    def holds(text):
        w = (text or "").lower().split()
        item = Counter(zip(*(want[i:] for i in range(5)), strict=False))
        for s in range(max(1, len(w) - len(want) + 1)):
            part = w[s : s + len(want)]
            mine = Counter(zip(*(part[i:] for i in range(5)), strict=False)) if len(part) >= 5 else Counter([tuple(part)] if part else [])
            both = sum((item & mine).values())
            if 100 * both >= 75 * (sum(item.values()) + sum(mine.values()) - both):
                return True
        return False

    return Counter({k: n for k, n in rows.items() if not holds(k[1])})


def test_filters(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for stage, want in ((P.toxic, kept_by_toxic), (P.near_duplicates, kept_by_near), (P.leaks, kept_by_leaks)):
        got = stage(spark, docs, tables)
        assert got.columns == docs.columns
        assert bag(got) == want(bag(docs)), stage.__name__
        assert sum(want(bag(docs)).values()) < docs.count()
        assert stage(spark, docs.limit(0), tables).count() == 0


def test_personal_data_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = P.personal_data(spark, docs, tables)
    assert got.columns == docs.columns and got.count() == docs.count()
    for r in got.collect():
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["spans"], r["base"], r["clean"], r["n_email"], r["_gone"], r["version"], r["own"]) == ("x", 1, "c", 2, 3, 4, "o")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = {r["doc_id"] for r in got.collect() if r["doc_id"] is not None and r["doc_id"] != 1008 and r["text"] != (before[r["doc_id"]] or "")}
    assert changed == {1004}
    assert P.personal_data(spark, docs.limit(0), tables).count() == 0


def test_whole(spark, tables):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    left = kept_by_leaks(kept_by_near(kept_by_toxic(bag(docs))))
    got = P.run(spark, tables).collect()
    assert Counter(g["doc_id"] for g in got) == sum((Counter({k[0]: n}) for k, n in left.items()), Counter())
    texts = {k[0]: k[1] or "" for k in left if k[0] is not None}
    for g in got:
        ids = sp.encode(g["decoded"])
        assert list(g["ids"]) == ids and g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        if g["doc_id"] not in (None, 1004, 1008):
            assert g["decoded"] == texts[g["doc_id"]]
        if g["doc_id"] == 1004:
            assert re.search("<EMAIL>.*<IP>", g["decoded"])

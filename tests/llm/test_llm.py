"""The training-data operators against plain Python, with odd rows: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from inkstone.llm import decontam, hmm, licenses, minhash, pii, quality, queries, sentencepiece_codec, suffix, token_counts, toxicity
from inkstone.llm.license_texts import FULL, TEXTS
from inkstone.llm.pieces import load

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, h long"


def rows(n=60, seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(150)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 160))]
        if i % 4 == 3 and out and out[-1][1]:
            words = out[-1][1].split()
            for _ in range(r.randint(0, 6)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i, " ".join(w + ("\n" if r.random() < 0.05 else "") for w in words), "en", "k", i))
    return out + [(100, None, None, None, None), (101, "", "en", "k", 1), (102, " \n\t", "en", "k", 1), (103, out[5][1], "en", "k", 1), (103, out[5][1], "en", "k", 1), (None, out[6][1], "en", "k", 1), (104, "word " * 30_000, "en", "k", 2), (105, "ABC Def", None, None, None), (106, "é\U0001f600 ▁x  y\x00", "fr", "k", 1)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_like_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = sentencepiece_codec.encode(docs, queries.piece_model()).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    seen = Counter()
    for doc_id, text in texts.elements():
        ids = sp.encode(text)
        seen[(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert seen == Counter((g["doc_id"], g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got)
    # counts and prefixes within a limit, by encoding prefixes anew
    most, counted = Counter(), Counter()
    for doc_id, text in texts.elements():
        n, fit = len(sp.encode(text)), len(text)
        if n > 20:
            fit = next(i for i in range(len(text) + 1) if len(sp.encode(text[: i + 1])) > 20)
        most[(doc_id, len(text.encode()), n, n > 20, fit)] += 1
    for c in token_counts.count(docs, queries.piece_model(), limit=20).collect():
        counted[(c["doc_id"], c["n_bytes"], c["n_tokens"], c["over_limit"], c["fit_chars"])] += 1
    assert most == counted
    assert sentencepiece_codec.encode(none, queries.piece_model()).count() == 0
    model = load(queries.piece_model())
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["the", " ", "ab", "é", "\n", "한", "  ", ".", "x", "\U0001f600"]) for _ in range(12))
        counts = token_counts.PrefixCounts(model, t)
        exact = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert [counts.at(i) for i in range(len(t) + 1)] == exact
        budget = r.randint(0, 8)
        assert counts.fit(budget) == max(i for i in range(len(t) + 1) if max(exact[: i + 1]) <= budget)


def test_licenses(spark, none):
    mit = TEXTS["MIT"]
    odd = "/*\n * Copyright (c) 2020 Somebody\n" + "\n".join(" * " + x for x in mit.upper().split("\n")) + "\n */"
    df = spark.createDataFrame([(1, mit), (2, odd), (3, mit + " more"), (4, None), (5, "RELEASED under the MIT Licence!"), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(df).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: "line-MIT", 6: None}
    assert licenses.scan(none).count() == 0


def test_licenses_wrapped_and_inside(spark):
    """Wrapped at any width, behind comment marks, and inside longer texts."""
    import textwrap

    rows_, want = [], {}
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        for width in range(58, 96):
            body = "\n\n".join(textwrap.fill(p, width) for p in TEXTS[name].split("\n\n"))
            rows_.append((len(rows_), f"Copyright (c) 2019, 2020 Some Holder\nAll rights reserved.\n\n{body}"))
            want[len(rows_) - 1] = name
    assert {g["doc_id"]: g["license_id"] for g in licenses.scan(spark.createDataFrame(rows_, "doc_id long, text string")).collect()} == want
    held = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, f"Title\n\n# {TEXTS['Apache-2.0-notice'].split(chr(10))[0]}\n\nEnd"), (3, "It was Released under the MIT License. by us"), (4, f"x\n\n{TEXTS['0BSD']}\n\ny")]
    ids = spark.createDataFrame([("para", TEXTS["Apache-2.0-notice"].split("\n\n")[0])], "license_id string, text string").unionByName(licenses.known(spark))
    got = {g["doc_id"]: (g["license_id"], g["parts"]) for g in licenses.scan(spark.createDataFrame(held, "doc_id long, text string"), ids).collect()}
    assert (got[1], got[2], got[3]) == ((None, "line-MIT"), (None, "para"), (None, ""))


def test_full_licenses(spark):
    names = sorted(FULL)
    assert {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0"} <= set(names)
    df = spark.createDataFrame([(i, FULL[n]) for i, n in enumerate(names)], "doc_id long, text string")
    assert {g["doc_id"]: g["license_id"] for g in licenses.scan(df).collect()} == dict(enumerate(names))


def test_licenses_in_one_reading(spark, tmp_path):
    """The result reads stored digests, no text again; odd rows are as in SQL."""
    import duckdb

    line, notice = TEXTS["line-MIT"], TEXTS["Apache-2.0-notice"]
    texts = [f"x\n{line.replace(' ', chr(1))}\ny", f"x\n{line[:8]}\x01\n{line[8:]}", f"\x01{line}", f"a\u2028// {line}", f"a\x85# {line}\nb", f"\u2028{line}", f"x\n\n***\n\t{line[:13]}\n{line[13:]}\n \t\ny", f"x\r\r// {line.upper().replace('LICENSE', 'LICENCE')}\r\n", f"a\n{line}\n{notice}\n\n{line}", "\n" * 500, f"{line}\n" * 40, f"This work is released.\nReleased under\n\n{line[:-4]}", None, "", f"é{line}", f"q\n{line} https://\nhttps", TEXTS["MIT"], notice.split("\n\n")[0] + "\n\n" + line, f"a\u2028Copyright 2020 {line}", "a\x85rem b"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[8]), (8, texts[8]), (8, "other")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = licenses.scan(spark.read.parquet(path))
    assert not [f for f in got.inputFiles() if "documents.parquet" in f]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(licenses.oracle()).fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert sum(w[4] != "" for w in want) == 8
    # more beginnings than are asked for: every block is digested
    some = spark.read.parquet(path)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(licenses, "STARTS", 3)
        m.setattr(licenses, "BROADCAST_ROWS", 2)
        assert Counter(tuple(r) for r in licenses.scan(some).collect()) == Counter(want)
    nothing = spark.createDataFrame([], "license_id string, text string")
    assert {(r["is_license"], r["parts"]) for r in licenses.scan(some, nothing).collect()} == {(False, "")}


def test_license_beginnings():
    """What a block began with before its spellings were made one; no block of another beginning has such a canonical form."""
    r = random.Random(8)
    bits = [x for pair in licenses.SAME for x in pair] + [x[:k] for pair in licenses.SAME for x in pair for k in (2, 4, 6)] + ["e", "s", " ", "mit", "copyright ", "s "]
    cut = 0
    for _ in range(20_000):
        raw = "".join(r.choice(bits) for _ in range(r.randint(1, 5))).strip()
        form = raw
        for old, new in licenses.SAME:
            form = form.replace(old, new)
        for n in (3, 8, 24):
            start = form[:n].strip()
            kept = licenses._fixed(start)
            assert start.startswith(kept) and raw.startswith(kept) and len(kept) >= min(3, len(start)), (raw, start)
            cut += kept != start
    assert cut > 1_000
    assert licenses._fixed("permission is hereby gra") == "permission is hereby gra"


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets):
    """The smallest doc_id reachable from each, by comparing all with all."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_near_duplicates(docs, none, small_batches):
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    root = classes(sets)
    got = minhash.groups(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"], r["n_shingles"]) == (root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"], len(sets[r["doc_id"]]))
    assert minhash.groups(none).count() == 0


@pytest.mark.parametrize("pairwise,block", [(32, 1 << 17), (2, 700)])
def test_near_duplicates_far_from_the_pivot(spark, small_batches, monkeypatch, pairwise, block):
    """A large group of which many are linked to some others only, by pairs and by blocks."""
    monkeypatch.setattr(minhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHARE", 9)
    r = random.Random(3)
    first = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = [list(first)]
    while len(texts) < 90:
        words = list(texts[r.randrange(len(texts))] if r.random() < 0.5 else first)
        for _ in range(r.choice([1, 2, 3, 5, 8])):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(words)
    r.shuffle(texts)
    sets = {i: shingles(" ".join(t)) for i, t in enumerate(texts)}
    root = classes(sets)
    assert 3 < len(set(root.values())) < 80
    got = {x["doc_id"]: x["component_id"] for x in minhash.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == root


def test_bayes_never_drops_equal():
    a = np.arange(minhash.HASHES, dtype=np.uint32)
    assert minhash.may_reach(a, a) and not minhash.may_reach(a, a + 1000)
    assert all(x < y for x, y in zip(minhash.least_matches(), minhash.least_matches()[1:], strict=False))


def test_decontamination(spark, docs, none):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows_ = [(900, "x " * 40 + near.upper() + " y" * 30), (901, near.replace("epsilon", "x")), (902, "one two three"), (903, "one two"), (None, near), (904, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in decontam.scan(df, bench).collect()} == {(900, 1, 40), (902, 4, 0)}
    assert decontam.scan(none, bench).count() == 0
    assert decontam.scan(df, bench.limit(0)).count() == 0


def test_short_items_inside_long_texts(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, "lone"), (3, "a b c d"), (4, "v w x y z")], "item_id long, text string")
    rows_ = [(1, "k " * 30 + "One two three" + " l" * 30), (2, "k k k k k k lone k"), (3, "a b c k d a b c d e f g"), (4, "k v w x y z k"), (5, "one two k three k k")]
    got = decontam.scan(spark.createDataFrame(rows_, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["n_words"]) for r in got} == {(1, 1, 30, 3), (2, 2, 6, 1), (3, 3, 5, 4), (4, 4, 1, 5)}


def test_toxicity(spark, none):
    r = random.Random(2)
    words = ["".join(r.choice("aeioubcdf") for _ in range(5)) for _ in range(300)]
    docs_, labels = [], []
    for i in range(1200):
        t = [r.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            t[::15] = [r.choice(["zxqyr", "zxqyrr", "zxqqyr"])] * len(t[::15])
        docs_.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(docs_ + [(5000, None), (None, "a b")], "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df, model).collect()
    held = [g for g in got if g["held_out"] and g["doc_id"] is not None]
    assert all(0 <= g["score"] <= 1 for g in got) and len(got) == 1202
    assert sum(g["predicted"] == int(g["doc_id"] % 5 == 0) for g in held) >= 0.95 * len(held)
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got if g["doc_id"] is not None)
    assert toxicity.score(none, toxicity.fit(none, lab.limit(0))).count() == 0


def test_toxicity_reads_whole_words():
    a, b = b"x" * 300, b"x" * 250 + b"zxqyr" + b"x" * 45
    assert set(toxicity.grams(b)) > set(toxicity.grams(a)) - {toxicity.grams(a)[0]}
    assert len(toxicity.grams(b)) == 1 + sum(302 - k + 1 for k in toxicity.NGRAMS)


def test_quality(docs, none):
    for r, g in zip(sorted(docs.where("doc_id < 110").collect(), key=str), sorted(quality.apply(docs.where("doc_id < 110"), quality.RULES).join(docs.select("doc_id", "text").distinct(), "doc_id").collect(), key=str), strict=True):
        del r
        t = g["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"], g["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g["kept"] and (g["base_failed"] or g["rejected_by"]))
    assert quality.apply(none, quality.RULES).count() == 0
    assert {m.rule.name for m in quality.order_rules(docs)} == {r.name for r in quality.RULES}


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP, CARD, PHONE = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, t) if 16 <= len(d(m.group())) <= 19 and luhn(d(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, t) if 8 <= len(d(m.group())) <= 15]


def test_quality_stops_at_the_first_rule(spark):
    """A rule that would fail the job is not evaluated behind one that rejects, nor for texts that the base rule rejects."""
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80))), (2, "few words")], "doc_id long, text string")
    all_, boom = quality.Rule("all", "n_words > 0"), quality.Rule("boom", "raise_error('evaluated') IS NULL")
    assert {(g["doc_id"], g["rejected_by"]) for g in quality.apply(df, [all_, boom]).collect()} == {(1, "all"), (2, None)}
    with pytest.raises(Exception, match="evaluated"):
        quality.apply(df, [boom, all_]).collect()
    dear = quality.Rule("dear", "length(repeat(text, 20000)) > 0")
    cheap = quality.Rule("cheap", "n_words > 0")
    many = df.where("doc_id = 1").crossJoin(spark.range(300)).select(pii.F.col("id").alias("doc_id"), "text")
    assert [m.rule.name for m in quality.order_rules(many, [dear, cheap])] == ["cheap", "dear"]
    assert [m.rule.name for m in quality.order_rules(df.limit(0), [dear, cheap])] == ["cheap", "dear"]


def test_personal_data(spark, none):
    r = random.Random(4)
    texts = ["".join(r.choice(["a@b.c", "_d@e.f", "1.2.3.4", ".5", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (555) 555-1234", "+", "é", "x.y", "@", "12", "\n", "a-b@c-d.e.f."]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1" * 50_000, "a." * 20_000, "1 " * 20_000, "+" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in pii.scan(df).collect():
        want = base(texts[g["doc_id"]] or "")
        assert [(x["kind"], x["s"], x["e"]) for x in g["base"]] == want
        assert [tuple(x) for x in g["spans"]][: len(want)] == want
    assert pii.scan(none).count() == 0


def test_disclosing_terms(spark):
    r = random.Random(6)
    filler = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(8))
    texts = [filler() for _ in range(300)] + [f"{filler()} Zorblax write me@x.org {filler()}" for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g["doc_id"]: g for g in pii.sanitise(pii.scan(df)).collect()}
    for i in range(300, 304):
        assert "Zorblax" not in got[i]["clean"] and "me@x.org" not in got[i]["clean"] and "<EMAIL>" in got[i]["clean"]
    assert all(got[i]["clean"] == texts[i] for i in range(300))


@pytest.mark.parametrize("term", ["ZX-48213", "user1234", "B7-4411", "998877", "#"])
def test_identifiers_disclose(spark, term):
    r = random.Random(8)
    filler = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(8))
    texts = [filler() for _ in range(300)] + [f"{filler()} {term} write me@x.org, or <me@x.org>{term} {filler()}" for _ in range(4)]
    got = {g["doc_id"]: g["clean"] for g in pii.sanitise(pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i in range(300, 304):
        assert f" {term} " not in got[i] and got[i].count("<EMAIL>") == 2
    assert all(got[i] == texts[i] for i in range(300))


def test_words_beside_spans(spark):
    F = pii.F
    texts = {"a me@x.org b": "a b", "me@x.org": "", "x(me@x.org)y z": "z", "a me@x.org,you@x.org b c": "a b c", "1.2.3.4/24 route 10": "10 route", "no data": "data no", "": ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: " ".join(sorted(r["w"])) for r in df.select("t", pii.beside(F.col("t"), pii.base_spans(F.col("t"))).alias("w")).collect()}
    assert got == texts


def test_disclosing_terms_of_rare_entities(spark):
    r = random.Random(7)
    filler = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(8))
    texts = [filler() for _ in range(2000)] + [f"{filler()}\nQuorvane\n{filler()} one@x.org Plimsey {filler()}", "Quorvane", f"{filler()} w1 two@x.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {g["doc_id"]: g for g in pii.sanitise(pii.scan(df)).collect()}
    # on one line, and on another line of the document
    assert "Plimsey" not in got[2000]["clean"] and "Quorvane" not in got[2000]["clean"]
    assert got[2001]["clean"] == texts[2001]
    # words that stand everywhere disclose nothing
    assert got[2002]["clean"] == texts[2002].replace("two@x.org", "<EMAIL>")
    assert all(got[i]["clean"] == texts[i] for i in range(2000))


def repeats(rows_):
    seen, out = set(), []
    for d, t in sorted(set(rows_), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        m = [False] * len(b)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                m[s : s + 100] = [True] * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, m, strict=True) if not g)
        out.append((d, len(b), sum(m), sum(1 for i, g in enumerate(m) if g and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return set(out)


@pytest.mark.parametrize("hot", [4000, 3, 1])
def test_suffix_dedup(spark, docs, none, small_batches, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    line = "A very common line that stands in many places and is longer than one hundred bytes, so that it goes away later. "
    more = [(200 + i, f"{i} start {line[: 60 + 7 * i]} {i * 7919} end {line[10:]}", "en", "k", 1) for i in range(12)] + [(300, "ab" * 400, "x", "k", 1), (301, "a" * 500, "x", "k", 1)]
    df = docs.where("doc_id < 104 OR doc_id > 104").unionByName(spark.createDataFrame(more, SCHEMA))
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(df).collect()}
    assert got == repeats([(r["doc_id"], r["text"]) for r in df.collect()])
    assert suffix.dedup(none).count() == 0


def test_suffix_sorter():
    r = np.random.default_rng(3)
    raw = r.integers(97, 99, 400).astype(np.uint8)
    at = r.integers(0, 380, 90)
    size = np.minimum(r.integers(1, 60, 90), 400 - at)
    group = r.integers(0, 3, 90)
    order = suffix.Sorter(raw, group, at, size).order()
    keys = [(group[i], raw[at[i] : at[i] + size[i]].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_hidden_markov(docs, none, small_batches, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 60)
    monkeypatch.setattr(hmm, "OWN", 20)
    monkeypatch.setattr(hmm, "STRETCH", 50)
    w = hmm.fit(docs, 4)
    table = {t["word"].encode(): t["c"] for t in w.counts.collect()}
    counts = Counter()
    for r in docs.collect():
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update([*hmm.tokens(r["text"] or ""), b""])
    assert table == counts and 50 < len(w.head) <= 61 < len(table)
    n, v = sum(counts.values()), len(counts)
    number = {x: i for i, x in enumerate(w.head)}
    # each state's words, and an unknown one of each class, add up to one
    every = w.emit[: len(w.head)].sum(0) + 0.1 * w.emit[len(w.head) :].sum(0)
    every += sum((c + 0.1) * w.emit[len(w.head) + hmm.class_of(x)] for x, c in counts.items() if x not in number)
    assert np.allclose(every, 1)

    def emit(x):
        return w.emit[number[x]] if x in number else (counts[x] + 0.1) * w.emit[len(w.head) + hmm.class_of(x)]

    want = Counter()
    for r in docs.collect():
        ws, state, score = [*hmm.tokens(r["text"] or ""), b""], w.start, 0.0
        for x in ws:
            state = (state @ w.move) * emit(x)
            score += np.log10(state.sum())
            state = state / state.sum()
        b = sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws)
        want[(r["doc_id"], len(ws), sum(x in table for x in ws), n, round(b, 4), round(score, 4))] += 1
    got = hmm.score(w).collect()
    assert want == Counter((g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 4), round(g["score"], 4)) for g in got)
    assert hmm.score(hmm.fit(none, 1)).count() == 0


def test_hidden_markov_recursion(monkeypatch):
    """Likelihood and expected counts against sums over all paths, one step after the other."""
    monkeypatch.setattr(hmm, "STRETCH", 4)
    r = np.random.default_rng(4)
    start, move, emit = r.dirichlet(np.ones(hmm.STATES)), r.dirichlet(np.ones(hmm.STATES), hmm.STATES), r.dirichlet(np.ones(7), hmm.STATES).T
    lengths = np.array([1, 4, 5, 13, 8, 2])
    flat = r.integers(0, 7, lengths.sum())
    own = hmm.Recursion(start, move, emit, flat, lengths)
    begins, moves, emits = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((7, hmm.STATES))
    at = 0
    for k, n in enumerate(lengths):
        x = flat[at : at + n]
        at += n
        alpha, beta = [start], [np.ones(hmm.STATES)]
        for c in x:
            alpha.append((alpha[-1] @ move) * emit[c])
        for c in x[::-1]:
            beta.insert(0, move @ (emit[c] * beta[0]))
        total = alpha[-1].sum()
        assert abs(own.loglik[k] - np.log(total)) < 1e-9
        begins += start * beta[0] / total
        for t, c in enumerate(x):
            moves += alpha[t][:, None] * move * (emit[c] * beta[t + 1])[None] / total
            emits[c] += alpha[t + 1] * beta[t + 1] / total
    for a, b in zip(own.expected(7), (begins, moves, emits), strict=True):
        assert np.allclose(a, b)


def test_hidden_markov_learns(spark, tmp_path):
    """Rounds raise the likelihood, and words of a class are told apart."""
    r = random.Random(8)
    texts = [" ".join(f"{'ab'[i % 2]}{r.randrange(4000)}" for _ in range(60)) for i in range(1200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [g for g in queries.op10_hidden_markov(spark, str(tmp_path)).collect() if g["held_out"]]
    gain = sum(g["score"] - g["base_score"] for g in got) / sum(g["n_tokens"] for g in got)
    assert gain > 0.1


def test_hidden_markov_end_token_outside_the_head(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 3)
    df = spark.createDataFrame([(0, "a a b b c c d d"), (1, "")], "doc_id long, text string")
    w = hmm.fit(df, 1)
    ends = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in (0, 1))
    got = {g["doc_id"]: g for g in hmm.score(w).collect()}
    assert w.head == [b""] and w.head_counts[0] == ends and got[1]["n_known"] == (ends > 0)
    assert abs(got[1]["base_score"] - (np.log10(ends + 0.1) - np.log10(w.tokens + 0.1 * (w.distinct + 1)))) < 1e-6


BIG = (1 << 60) + 1


def test_large_ids_beside_null_ones(spark):
    """Ids that no float holds come back as they were, and links between them are not lost."""
    r = random.Random(9)
    first = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(10):
        words = list(first)
        words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    rows_ = [(BIG + 2 * i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    want = sorted([d for d, _ in rows_], key=str)
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)
    found = [sentencepiece_codec.encode(df, queries.piece_model()), token_counts.count(df, queries.piece_model()), toxicity.score(df, model), suffix.dedup(df), hmm.score(hmm.fit(df, 2)), minhash.groups(df)]
    for out in found:
        assert sorted([g["doc_id"] for g in out.collect()], key=str) == want
    assert {g["component_id"] for g in found[-1].collect()} == {BIG, None}


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(10)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(60)]
    a, z = text(), text()
    near = [*z[:-1], "other"]
    rows_ = [(5, a), (5, z), (7, z), (11, near), (4, a), (4, text())]
    got = minhash.groups(spark.createDataFrame([(d, " ".join(t)) for d, t in rows_], "doc_id long, text string")).collect()
    assert sorted((g["doc_id"], g["component_id"]) for g in got) == [(4, 4), (4, 4), (5, 4), (5, 5), (7, 5), (11, 5)]


def test_repeated_rows_of_scores(spark, docs):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)
    assert len([g for g in toxicity.score(docs, model).collect() if g["doc_id"] == 103]) == 2
    assert len([g for g in pii.scan(docs).collect() if g["doc_id"] == 103]) == 2


def test_disclosing_terms_are_quoted(spark):
    r = random.Random(12)
    filler = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(8))
    odd = ["C:\\Email", "a.b*c", "x\\Q[y", "$1(z", "😀|q"]
    texts = [filler() for _ in range(2000)] + [f"{filler()} {o} m{i}@x.org {filler()}" for i, o in enumerate(odd)]
    got = {g["doc_id"]: g["clean"] for g in pii.sanitise(pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, o in enumerate(odd):
        assert got[2000 + i] == texts[2000 + i].replace(o, "<TERM>" if "<TERM>" in got[2000 + i] else "").replace(f"m{i}@x.org", "<EMAIL>")


def disclosed(units, compared):
    """entity, term: shares by the formulas over distinct units, in plain Python."""
    distinct = sorted(set(units))
    n, holds, stands = len(distinct), {}, Counter()
    for k, u in enumerate(distinct):
        found = {f"{kind}:{u[s:e].lower()}" for kind, s, e in base(u)}
        for w in set(u.split()):
            stands[w] += 1
        for x in found:
            holds.setdefault(x, []).append(k)
    out = {}
    for x, where in holds.items():
        ce, p = len(where), len(where) / n
        with_ = Counter(w for k in where for w in {m[0] for m in re.finditer(r"\S+", distinct[k]) if not any(s < m.end() and m.start() < e for _, s, e in base(distinct[k]))})
        for w, cet in with_.items():
            mean = stands[w] * ce / n
            bound = np.log(-np.expm1(-mean)) if cet <= 1 else -(cet * np.log(cet / mean) - cet + mean)
            share = np.log2((cet + pii.SMOOTH * p) / (stands[w] + pii.SMOOTH) / p) / max(-np.log2(p), 1e-9)
            if cet > mean and bound + np.log(compared) <= np.log(pii.CHANCE) and share >= pii.GENERALISE:
                out[(x, w)] = round(share, 9)
    return out


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_disclosure_measure(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    r = random.Random(13)
    word = lambda: f"w{min(int(r.paretovariate(0.7)), 3000)}"
    texts = []
    for i in range(400):
        lines = [" ".join(word() for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines[0] += f" u{i % 17}@x.org v{i % 17}q id-{i % 17:05d} {i % 17 + 100} (u{i % 17}@x.org)z {i % 17}"
        texts.append("\n".join(lines))
    texts += texts[:60] + [texts[5].split("\n")[0]] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = pii.scan(df).where("n_email > 0").select("text", pii._entities(pii.base_spans(pii.F.col("text"))).alias("entities"))
    got = {(g["entity"], g["term"]): round(g["share"], 9) for g in pii.disclosures(df, held).collect()}
    compared = len({w for t in texts for w in t.split()})
    by_line, by_text = disclosed([x for t in texts for x in t.split("\n")], compared), disclosed(texts, compared)
    want = {k: max(by_line.get(k, 0), by_text.get(k, 0)) for k in by_line.keys() | by_text.keys()}
    assert len(want) > 10 and got == want


def test_sql(spark):
    """The queries with SQL against DuckDB on the smallest tables."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        cell = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
        assert cell(got) == cell(want), name
        if name == "op1_license_scan":
            assert (got["parts"] != "").any()

"""Operator 12: ids against the library, places against the contract, the plan against exhaustive packing."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from inkstone.llm import packing
from inkstone.llm.queries import word_model

SCHEMA = "doc_id long, text string, source string, length string"
ODD = [
    "", " ", "a", "Hello  World", "it's DON'T we'll 'sTop ''s", "x<|endoftext|>y <|startoftext|>", "<|endoftext |>", "".join(map(chr, range(0xA0, 0x100))), "naïve CAFÉ Straße ÿ ÀÖ×÷", "é öx", "İstanbul ΣΑΣ ǅ", "日本語テキスト 한국어",
    "a b c\x1cd\x1fe\x85f", "tab\tnew\nline\x0bv\x0cf\rr", "12 345,6.7 ²½", "µ ª º", "\U0001f600‍ x\u0000y", "a" * 5000, "&&&***!!!", "ﬁ ﬂ", "wordword " * 3000,
]


@lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_model())


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def held(rows, docs, capacity):
    """Every document's pieces are there once, whole, and sequences are gapless and not overfull."""
    want = Counter()
    for doc, text, *_ in docs:
        own = ids(text) + [0]
        for piece, start in enumerate(range(0, len(own), capacity)):
            part = own[start : start + capacity]
            want[doc, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_the_librarys():
    own = packing.TokenIds(word_model())
    assert own.by_word
    r = random.Random(1)
    alphabet = "abcXYZ 's't\n\t.,!-0189éÉßñí×<|>_ ́Σ日\x1c"
    for text in [*ODD, *("".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000))]:
        assert own(text) == struct.pack(f"<{len(ids(text))}I", *ids(text)), text


@pytest.mark.parametrize("capacity", [2048, 12])
def test_pack(spark, capacity):
    """Odd texts, nulls, repeated rows, many equal lengths, clashing column names."""
    r = random.Random(2)
    docs = [(i, t, None, "x") for i, t in enumerate(ODD)] + [(None, "no id", "s", None), (None, None, None, None), (7, "again", "s", ""), (7, "again", "s", "")]
    docs += [(100 + i, " ".join(r.choice(["one", "two", "the"]) for _ in range(r.choice([1, 3, 3, 3, 8, 20, 700]))), "hot", "") for i in range(150)]
    df = packing.pack(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS piece", "2 AS task", "3 AS nth").repartition(5), word_model(), capacity)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = [tuple(x) for x in df.collect()]
    n = held(rows, docs, capacity)
    assert n <= packing.sequences([x[3] for x in rows], capacity) * 1.3 + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), word_model()).count() == 0


def best(lengths, capacity):
    """The fewest sequences, by trying all."""
    lengths, least = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, room):
        if len(room) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(room)
            return
        for j in {g: k for k, g in enumerate(room)}.values():
            if room[j] >= lengths[i]:
                place(i + 1, [*room[:j], room[j] - lengths[i], *room[j + 1 :]])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return least[0]


def unfolded(placed, capacity):
    by = defaultdict(list)
    for p in placed:
        for j in range(p.high - p.low):
            by[p.first + j // p.each].append((p.offset + j % p.each * p.length, p.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan():
    """Large items are packed as well as can be; mixed ones within one sequence of the best for so few; counts are kept."""
    r = random.Random(3)
    for _ in range(150):
        large = [r.randrange(11, 31) for _ in range(r.randrange(1, 9))]
        assert unfolded(packing.plan(Counter(large), 30), 30) == best(large, 30)
        mixed = [r.randrange(1, 31) for _ in range(r.randrange(1, 9))]
        assert unfolded(packing.plan(Counter(mixed), 30), 30) <= best(mixed, 30) + 1
    for _ in range(20):
        counts = {r.randrange(1, 2049): r.randrange(1, 10**9) for _ in range(2000)} | {2048: 10**9}
        placed = packing.plan(counts, 2048)
        got = Counter()
        for p in placed:
            got[p.length] += p.high - p.low
        assert got == Counter(counts)
        assert len(placed) < 60_000

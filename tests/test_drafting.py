"""Draft stages against a plain walk over the chunks; what a re-translation is asked."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from inkstone.operators.drafting import STAGES, Fingerprint, Stage, alike, around, draft_all, retranslate
from inkstone.operators.providers import Echo

CHUNK, LIKE = "doc int, position int, chunk int, content string", "chunk int, other int, rank int"
CHUNKS = [(1, 0, 10, "a"), (1, 1, 11, "b"), (1, 2, 12, ""), (1, 3, 13, "d"), (1, 4, 14, None), (1, 6, 16, "g"), (2, 0, 20, "a"), (2, 1, 21, "  y ")]
ALIKE = [(10, 11, 1), (10, 20, 2), (10, 13, 3), (10, 16, 4), (10, 21, 5), (10, 10, 0), (20, 10, 1), (20, 12, 2), (21, 99, 1), (13, 20, 1), (13, 10, 1), (13, 10, 1)]


class Loud:
    name = "ai:loud"

    def answer(self, requests):
        return requests.select("chunk", F.col("prompt").alias("content"))


def request(*sections):
    return "\n\n".join(f"{t}:\n{v}" for t, v in sections if v)


def plain():
    """All drafts by number and chunk, by loops."""
    content = {c: x or "" for _, _, c, x in CHUNKS}
    place = {c: (d, p) for d, p, c, _ in CHUNKS}
    at = {(d, p): c for d, p, c, _ in CHUNKS}

    def beside(c, of, steps):
        d, p = place[c]
        return "\n".join(of[n] for k in steps if (n := at.get((d, p + k))) is not None and of.get(n))

    def passages(c, last):
        ok = sorted({(r, o) for x, o, r in ALIKE if x == c and o != c and o in place and not (place[o][0] == place[c][0] and abs(place[o][1] - place[c][1]) <= 2)})[:3]
        return "\n".join(f"{content[o]} → {last[o]}" for _, o in ok if o in last)

    drafts = {-1: {c: x.strip() for c, x in content.items() if x.strip()}}
    last = dict(drafts[-1])
    for number in (0, 1, 2):
        made = {}
        for c in content:
            s = [("Before", beside(c, content, (-2, -1))), ("Text", content[c]), ("After", beside(c, content, (1, 2))), ("Similar passages", passages(c, last))]
            if number == 0:
                s.append(("Machine translation", drafts[-1].get(c)))
            if number == 2:
                s += [("Drafts before", beside(c, last, (-2, -1))), ("Drafts after", beside(c, last, (1, 2))), ("Draft", last.get(c))]
            made[c] = hashlib.sha256(request(*s).encode()).hexdigest()
        drafts[number] = made
        last |= made
    return drafts


def test_all_stages(spark):
    out = draft_all(spark.createDataFrame(CHUNKS, CHUNK), spark.createDataFrame(ALIKE, LIKE), Echo(), Fingerprint())
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.draft_number, {})[r.chunk] = r.content
        assert r.translator == ("mt:echo" if r.draft_number < 0 else "ai:fingerprint")
    assert got == plain()
    assert out.count() == sum(map(len, got.values()))


def test_surroundings_and_similar(spark):
    chunks = spark.createDataFrame(CHUNKS, CHUNK)
    got = {r.chunk: (r.before, r.after) for r in around(chunks, "content", "before", "after").collect()}
    assert got == {10: ("", "b"), 11: ("a", "d"), 12: ("a\nb", "d"), 13: ("b", ""), 14: ("d", "g"), 20: ("", "  y "), 21: ("a", "")}
    got = sorted((r.chunk, r.other) for r in alike(chunks, spark.createDataFrame(ALIKE, LIKE)).collect())
    assert got == [(10, 13), (10, 16), (10, 20), (13, 10), (13, 20), (20, 10), (20, 12)]


def test_one_stage_and_nothing(spark):
    none = spark.createDataFrame([], LIKE)
    assert draft_all(spark.createDataFrame([], CHUNK), none, Echo(), Fingerprint()).count() == 0
    out = draft_all(spark.createDataFrame(CHUNKS[:1], CHUNK), none, Echo(), Loud(), (Stage(5, revises=True),))
    assert sorted((r.draft_number, r.content) for r in out.collect()) == [(-1, "a"), (5, "Text:\na\n\nDraft:\na")]
    assert [s.number for s in STAGES] == [0, 1, 2]


def test_retranslation(spark):
    drafts = [(10, -1, "mt", "old"), (10, 3, "you", "mine"), (11, -1, "mt", "machine"), (13, 1, "ai", "thirteen")]
    terms = [(10, "b", "B"), (10, "a", "A"), (10, "a", "A"), (11, "b", "B"), (12, "x", "X"), (13, " ", "no"), (13, "d", None), (99, "a", "A")]
    args = spark.createDataFrame(CHUNKS, CHUNK), spark.createDataFrame(drafts, "chunk int, draft_number int, translator string, content string"), spark.createDataFrame(ALIKE, LIKE), spark.createDataFrame(terms, "chunk int, text string, translation string")
    got = {r.chunk: (r.draft_number, r.content) for r in retranslate(*args, Loud()).collect()}
    assert got == {
        10: (4, 'Text:\na\n\nAfter:\nb\n\nSimilar passages:\nd → thirteen\n\nDraft:\nmine\n\nChosen translations:\n「a」 → "A"\n「b」 → "B"'),
        11: (1, 'Before:\na\n\nText:\nb\n\nAfter:\nd\n\nDraft:\nmachine\n\nChosen translations:\n「b」 → "B"'),
        12: (1, 'Before:\na\nb\n\nAfter:\nd\n\nChosen translations:\n「x」 → "X"'),
    }

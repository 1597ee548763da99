"""Removal of repeated byte strings by hash-compared suffix sorting (operator 9).

Texts are UTF-8 bytes; a byte goes if a string of LENGTH bytes that covers it also starts earlier, in a document with a
smaller doc_id or earlier in the same one. Matches never cross documents, overlaps count, and the input alone decides.

Prefix polynomial hashes give the hash of any stretch of bytes in one step.

1. Each string of LENGTH bytes is looked after by one anchor in it: of its GRAM-byte substrings the one with the least hash
   (the leftmost of equal ones). Equal strings have equal anchors at equal places, so only strings with the same anchor
   need comparing. There is about one anchor for every 35 bytes; it stands for a run of consecutive starts.
2. Anchors meet by hash. Where all that an anchor looks after is equal (a second hash over it), only the earliest one stays
   and the others are repeats; each task does this for its own rows before any are sent, so a passage found in a third of
   all documents arrives once for each batch.
3. Anchors that meet with different surroundings are compared byte-exactly: their suffixes are mergesorted, where a binary
   search over hashes finds the common extension of two suffixes in a logarithmic number of steps. Runs of the sorted order
   with a long enough common extension, and equal hashes to the left of the anchor, are equal strings; their bytes are
   compared to rule out collisions. Anchors met by more than HOT others are compared string by string instead, spread over
   the cluster by the string's hash.
4. The ranges found are gathered for each document, cut out of its bytes, and what is left is hashed.

Nulls count as empty texts. Texts shorter than LENGTH bytes keep all. Rows with a null id come before all others. Rows that
repeat a doc_id: texts are told apart by a hash of the text; equal rows with equal ids count as one document and each give a
row. Extra columns are not looked at. Long texts are worked on in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

LENGTH = 100
GRAM = 32
#: Grams in a string of LENGTH bytes.
SPAN = LENGTH - GRAM + 1
#: Groups of more than twice as many anchors are dealt out, in chunks of that size.
HOT = 500
#: Copies of each such group's count, so that its rows learn of it in as many tasks.
PARTS = 64
#: Starts of one text that are worked on at a time.
BLOCK = 1 << 19
#: Anchors that are sorted together, about.
SORT_ROWS = 20_000
_BASE = 0x9E3779B97F4A7C13 | 3
_U = np.uint64
NULL_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    n = max(BLOCK + LENGTH + 1, SORT_ROWS * 400)
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[_U(1), np.full(n, _BASE, _U)])
        down = np.cumprod(np.r_[_U(1), np.full(n, inverse, _U)])
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hashes:
    """Prefix hashes of an array of bytes; the hash of any stretch of it."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = _powers()
        self.h = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.h[end] - self.h[start]) * self.down[start]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: place, hash, first start, number of starts and hash of all it looks after, for each anchor."""
    parts = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        block = raw[at : at + BLOCK + LENGTH - 1]
        h = Hashes(block)
        n = len(block) - GRAM + 1
        gram = _mix((h.h[GRAM:] - h.h[:n]) * h.down[:n])
        # least hash of each SPAN grams, the place in the low bits
        least = (gram & ~_U(0xFFFFF)) | np.arange(n, dtype=_U)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < SPAN:
            k = SPAN - width
            least = np.minimum(least[: len(least) - k], least[k:])
        place = (least & _U(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        many = np.diff(np.r_[first, len(place)])
        p = place[first]
        whole = _mix(h.of(first, first + many + LENGTH - 1) + _mix((p - first).astype(_U) * _U(1 << 20) + many.astype(_U)))
        parts.append((p + at, gram[p], first + at, many, whole))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z.astype(_U), z, z, z.astype(_U)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """key, whole, doc, version, start, many, lead, repeat: anchors; repeat for those with an equal, earlier one in the same batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [(d, v, anchors(_bytes(t))) for d, v, t in zip(pdf["doc_id"], pdf["version"], pdf["text"], strict=True)]
            sizes = [len(x[2][0]) for x in got]
            if not sum(sizes):
                continue
            doc = np.repeat(np.array([x[0] for x in got], np.int64), sizes)
            version = np.repeat(np.array([x[1] for x in got], np.int64), sizes)
            place, key, start, many, whole = (np.concatenate([x[2][k] for x in got]) for k in range(5))
            order = np.lexsort((start, version, doc, whole, key))
            k, w = key[order], whole[order]
            repeat = np.zeros(len(k), bool)
            repeat[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
            # repeats need no meeting: they go anywhere
            sent = np.where(repeat, _mix(_U(1) + doc[order].astype(_U)), k)
            yield pd.DataFrame({"key": sent.view(np.int64), "whole": w.view(np.int64), "doc": doc[order], "version": version[order], "start": start[order].astype(np.int32), "many": many[order].astype(np.int16), "lead": (place - start)[order].astype(np.int16), "repeat": repeat})

    return docs.mapInPandas(run, "key long, whole long, doc long, version long, start int, many short, lead short, repeat boolean")


def _meet(rows: DataFrame) -> DataFrame:
    """doc, version, start, many, lead, key (null: a repeat; else to be compared with others of the key): what came of anchors that met."""
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "repeat", "whole", "doc", "version", "start")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # key and hash of the last row
        pending: pd.DataFrame | None = None  # the last key's anchor, while it has only one kind
        several = False  # whether the last key has shown more than one kind
        for pdf in it:
            rep = pdf["repeat"].to_numpy()
            out = [pdf[rep].assign(key=None)]
            pdf = pdf[~rep]
            if len(pdf):
                k, w = pdf["key"].to_numpy(), pdf["whole"].to_numpy()
                same = np.zeros(len(k), bool)
                same[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
                same[0] = last is not None and last == (k[0], w[0])
                out.append(pdf[same].assign(key=None))
                kinds = pdf[~same]
                if len(kinds):
                    goes_on = several and last is not None and kinds["key"].iloc[0] == last[0]
                    kinds = kinds if pending is None else pd.concat([pending, kinds])
                    kk = kinds["key"].to_numpy()
                    edge = np.r_[True, kk[1:] != kk[:-1]]
                    single = edge & np.r_[edge[1:], True]
                    single[0] &= not goes_on
                    out.append(kinds[~single])
                    several = not single[-1]
                    pending = None if several else kinds.iloc[-1:]
                last = (k[-1], w[-1])
            got = pd.concat(out)
            yield pd.DataFrame({"doc": got["doc"], "version": got["version"], "start": got["start"], "many": got["many"], "lead": got["lead"], "key": got["key"].astype("Int64")})

    return sorted_rows.mapInPandas(run, "doc long, version long, start int, many short, lead short, key long")


class Sorter:
    """Suffixes of a byte array, each with its group, length and place; sorted by group and then bytes, compared by hash."""

    def __init__(self, raw: np.ndarray, group: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        self.raw = np.r_[raw, np.zeros(1, np.uint8)]
        self.hashes, self.group, self.at, self.length = Hashes(raw), group, at, length

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        a, b = self.at[x], self.at[y]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes.of(a, a + mid) == self.hashes.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix x comes before y; equal ones as told."""
        k = self.common(x, y)
        end_x, end_y = k == self.length[x], k == self.length[y]
        cx, cy = self.raw[self.at[x] + np.where(end_x, 0, k)], self.raw[self.at[y] + np.where(end_y, 0, k)]
        by_bytes = np.where(end_x, np.where(end_y, ties, True), np.where(end_y, False, cx < cy))
        return np.where(self.group[x] != self.group[y], self.group[x] < self.group[y], by_bytes)

    def order(self) -> np.ndarray:
        """Mergesort from below; all merges of a level at once, each element finding its place in the other run by binary search."""
        n = len(self.at)
        order = np.arange(n)
        width = 1
        while width < n:
            i = np.arange(n)
            own = i // width * width
            left = (i // width) % 2 == 0
            other = np.where(left, own + width, own - width)
            other_end = np.minimum(other + width, n)
            other = np.minimum(other, n)
            low, high = other.copy(), other_end.copy()
            for _ in range(width.bit_length()):
                open_ = low < high
                mid = np.minimum((low + high) >> 1, n - 1)
                # an element of the left run goes after those of the right one that are less; one of the right run after equal ones too
                before = self.less(order[mid], order, False) | (~left & ~self.less(order, order[mid], False))
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            pair = i // (2 * width) * (2 * width)
            target = pair + (i - own) + (low - other)
            out = np.empty(n, np.int64)
            out[target] = order
            order = out
            width *= 2
        return order


def repeats(raw: np.ndarray, offset: np.ndarray, group: np.ndarray, lead: np.ndarray, many: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings that an earlier one equals, as row and start. Row j's bytes begin at offset[j]; strings begin at its first many[j] places.

    rank orders documents; start is where the row's bytes begin in its document."""
    at = offset + lead
    length = many + LENGTH - 1 - lead
    s = Sorter(raw, group, at, length)
    order = s.order()
    x = order
    shared = np.zeros(len(x), np.int64)
    if len(x) > 1:
        shared[1:] = np.where(group[x[1:]] == group[x[:-1]], s.common(x[1:], x[:-1]), 0)
    rows, starts = [], []
    place = np.arange(len(x))
    for left in range(SPAN):
        run = np.cumsum(shared < LENGTH - left)
        fit = (left <= lead[x]) & (left > lead[x] - many[x])
        who = x[fit]
        if len(who) < 2:
            continue
        r = run[place[fit]]
        h = s.hashes.of(at[who] - left, at[who])
        begins = start[who] + lead[who] - left
        by = np.lexsort((begins, rank[who], h, r))
        who, r, h, begins = who[by], r[by], h[by], begins[by]
        twin = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
        if not twin.any():
            continue
        k = np.flatnonzero(twin)
        one, two = at[who[k]] - left, at[who[k + 1]] - left
        span = np.arange(LENGTH)
        for cut in range(0, len(k), 20_000):
            c = slice(cut, cut + 20_000)
            if (s.raw[one[c, None] + span] != s.raw[two[c, None] + span]).any():
                raise ArithmeticError("two different strings have the same hash; choose another base")
        rows.append(who[k + 1])
        starts.append(begins[k + 1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def _runs(doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Starts put together into ranges of bytes."""
    if not len(doc):
        return pd.DataFrame({"doc": doc, "version": version, "s": start, "e": start})
    by = np.lexsort((start, version, doc))
    doc, version, start = doc[by], version[by], start[by]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] > start[:-1] + LENGTH)])
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return pd.DataFrame({"doc": doc[first], "version": version[first], "s": start[first], "e": start[last] + LENGTH})


def _dealt(rows: DataFrame, turn: int) -> DataFrame:
    """rows by group: key, more (whether the group is dealt out, key being that of a chunk).

    A chunk's share of a group depends on the turn, so that rows that met once meet others next. There is one group to be dealt out
    for 2 * HOT rows at most; each is joined in PARTS copies, so that its rows need not come to one task to learn of it."""
    place = F.xxhash64("doc", "version", "start", F.lit(turn))
    per_key = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (2 * HOT)).alias("chunks")).where("chunks > 1")
    copies = per_key.select("key", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    held = rows.withColumn("part", F.pmod(place, F.lit(PARTS).cast("long"))).join(copies, ["key", "part"], "left")
    more = F.col("chunks").isNotNull()
    chunk = F.xxhash64("key", F.pmod(F.shiftrightunsigned(place, 8), "chunks"))
    return held.withColumn("more", more).withColumn("key", F.when(more, chunk).otherwise(F.col("key"))).drop("chunks", "part")


def _segments(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """key, more, doc, version, start, many, lead, raw: anchors with the bytes of all strings they look after."""
    tagged = _dealt(checks, 0).select("doc", "version", F.struct("start", "many", "lead", "key", "more").alias("x"))
    per_doc = tagged.groupBy("doc", "version").agg(F.collect_list("x").alias("x"))  # of one document: no more than its own length
    held = per_doc.join(docs.select(F.col("doc_id").alias("doc"), "version", "text").dropDuplicates(["doc", "version"]), ["doc", "version"])

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out: dict[str, list] = {c: [] for c in ("key", "more", "doc", "version", "start", "many", "lead", "raw")}
            for d, v, t, xs in zip(pdf["doc"], pdf["version"], pdf["text"], pdf["x"], strict=True):
                raw = t.encode("utf-8", "replace")
                for x in xs:
                    s, m = x["start"], x["many"]
                    out["key"].append(x["key"])
                    out["more"].append(x["more"])
                    out["doc"].append(d)
                    out["version"].append(v)
                    out["start"].append(s)
                    out["many"].append(m)
                    out["lead"].append(x["lead"])
                    out["raw"].append(raw[s : s + m + LENGTH - 1])
            if out["key"]:
                yield pd.DataFrame(out)

    return held.mapInPandas(cut, "key long, more boolean, doc long, version long, start int, many short, lead short, raw binary")


def _compared(docs: DataFrame, checks: DataFrame) -> list[DataFrame]:
    """doc, version, s, e: ranges of repeated strings among anchors that met in different surroundings, a stored table for each round."""
    ranges: list[DataFrame] = []
    rows, width = _segments(docs, checks), SPAN
    while True:
        width = -(-width // 2)
        done = stored(_sort_groups(rows, width))
        ranges.append(done.where("key IS NULL").select("doc", "version", "s", "e"))
        left = done.where("key IS NOT NULL")
        if left.isEmpty():
            return ranges
        rows = _dealt(left.select("key", "doc", "version", F.col("s").cast("int").alias("start"), "many", "lead", "raw"), len(ranges))


def _sort_groups(rows: DataFrame, width: int) -> DataFrame:
    """doc, version, s, e, key, many, lead, raw: ranges of repeats (key is null), and what of a chunk goes on."""

    def sort(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0
        for pdf in it:
            kept.append(pdf)
            size += len(pdf)
            if size >= SORT_ROWS:
                rows = pd.concat(kept, ignore_index=True)
                k = rows["key"].to_numpy()
                tail = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
                if tail:
                    yield from _sorted(rows.iloc[:tail], width)
                kept = [rows.iloc[tail:]]
                size = len(kept[0])
        if size:
            yield from _sorted(pd.concat(kept, ignore_index=True), width)

    kind = "doc long, version long, s long, e long, key long, many short, lead short, raw binary"
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(sort, kind)


def _going_on(part: pd.DataFrame, raw: np.ndarray, offset: np.ndarray, who: np.ndarray, begins: np.ndarray, width: int) -> pd.DataFrame | None:
    """Strings of chunks that no earlier one of the chunk equals: runs of starts with the anchor in one block of places.

    who, begins: strings that go, as row and start. A run's key is a hash of its block and the bytes that all strings of the block cover."""
    start, many, lead = (part[c].to_numpy(np.int64) for c in ("start", "many", "lead"))
    rows = np.flatnonzero(part["more"].to_numpy(bool))
    if not len(rows):
        return None
    first = np.cumsum(many) - many
    stays = np.ones(int(many.sum()), bool)
    stays[first[who] + begins - start[who]] = False
    row = np.repeat(np.arange(len(part)), many)
    i = np.arange(len(row)) - first[row]
    stays &= part["more"].to_numpy(bool)[row]
    row, i = row[stays], i[stays]
    if not len(row):
        return None
    block = (lead[row] - i) // width
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1) | (block[1:] != block[:-1])])
    last = np.r_[head[1:] - 1, len(row) - 1]
    row, block, a, n = row[head], block[head], i[head], last - head + 1
    low = block * width
    anchor = offset[row] + lead[row]
    covered = Hashes(raw).of(anchor - low, anchor + LENGTH - np.minimum(low + width, SPAN) + 1)
    key = _mix(covered + _mix(block.astype(_U) + _U(1)))
    raws = part["raw"].to_numpy()
    return pd.DataFrame(
        {
            "doc": part["doc"].to_numpy(np.int64)[row],
            "version": part["version"].to_numpy(np.int64)[row],
            "s": start[row] + a,
            "e": start[row] + a + n + LENGTH - 1,
            "key": key.view(np.int64),
            "many": n.astype(np.int16),
            "lead": (lead[row] - a).astype(np.int16),
            "raw": [raws[j][x : x + m + LENGTH - 1] for j, x, m in zip(row.tolist(), a.tolist(), n.tolist(), strict=True)],
        }
    )


def _sorted(rows: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Ranges of repeats in whole groups of anchors, some at a time so that hash tables stay small; and what goes on."""
    k = rows["key"].to_numpy()
    edges = np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + SORT_ROWS, "right")) - 1)
        part = rows.iloc[edges[a] : edges[b]]
        a = b
        raws = part["raw"].tolist()
        raw = np.frombuffer(b"".join(raws), np.uint8)
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        group = np.cumsum(np.r_[True, part["key"].to_numpy()[1:] != part["key"].to_numpy()[:-1]])
        doc, version = part["doc"].to_numpy(np.int64), part["version"].to_numpy(np.int64)
        by = np.lexsort((version, doc))
        rank = np.empty(len(part), np.int64)
        rank[by] = np.cumsum(np.r_[True, (doc[by][1:] != doc[by][:-1]) | (version[by][1:] != version[by][:-1])])
        offset = np.cumsum(size) - size
        who, start = repeats(raw, offset, group, part["lead"].to_numpy(np.int64), part["many"].to_numpy(np.int64), rank, part["start"].to_numpy(np.int64))
        gone = _runs(doc[who], version[who], start)
        yield gone.assign(key=pd.array([None] * len(gone), "Int64"), many=np.int16(0), lead=np.int16(0), raw=None)
        rest = _going_on(part, raw, offset, who, start, width)
        if rest is not None:
            yield rest


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text that is left) for every row."""
    df = documents(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    met = stored(_meet(_anchor_rows(df)))
    ranges = met.where("key IS NULL").select("doc", "version", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("many") + (LENGTH - 1)).cast("long").alias("e"))
    checks = met.where("key IS NOT NULL")
    found = reduce(DataFrame.unionByName, _compared(df, checks), ranges)
    per_doc = found.groupBy(F.col("doc").alias("doc_id"), "version").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    joined = df.join(per_doc, ["doc_id", "version"], "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for t, xs in zip(pdf["text"], pdf["x"], strict=True):
                raw = t.encode("utf-8", "replace")
                gone = spans = 0
                parts, at = [], 0
                for s, e in merged([(x["s"], x["e"]) for x in xs] if xs is not None else []):
                    parts.append(raw[at:s])
                    gone, spans, at = gone + e - s, spans + 1, e
                parts.append(raw[at:])
                kept = b"".join(parts)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(gone)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **out})

    done = joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out

"""Best-fit packing of token sequences (operator 12).

What a packing looks like depends on the lengths alone, and no length exceeds a sequence's. So the pieces are counted by length, a
table of at most `capacity` rows, and the whole packing is planned on these counts:

1. Large items, above a third of the capacity, of which a sequence holds two at most: the largest is matched with the largest that
   fits beside it, as many pairs at once as both lengths have (`_match`).
2. Smaller ones, from the largest down, go where the least room is left over (`_fit`); equal gaps of neighbouring sequences are one
   run, and a run takes all it can hold of a length at once.

The plan says where the pieces of a length go by their number: the first so many two to a sequence from this one on, the next
so many elsewhere. A run's gap more than halves whenever a length enters it and a length splits two runs at most, so a plan for 2048
tokens has some tens of thousands of rows, whatever the number of documents; it is broadcast. Each task numbers its pieces of
a length as it makes them, and a table of counts by task and length says where a task's numbers begin: nothing is sorted, and
a length or source with a third of all rows is no hot key.

Null texts are empty ones, of which the end id alone is left; repeated rows and rows with a null id are packed as any other; an empty
table gives none; extra columns are not looked at. A text takes memory in proportion to its own length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

#: White space that stands between words for every tokenizer at hand, and what Python takes for white space beyond that.
_SPACE = re.compile(r"[\t-\r ]+")
_WIDER = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words and parts of words that one worker keeps, those not longer than this.
MOST_KEPT, MOST_CHARS = 700_000, 40
#: What the word tokenizer drops and how it cuts words. Fixed values.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same for words of ASCII and Latin-1 letters, which are their own normal form and have one lower case each.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: Latin-1 letters as the letters that stand for their two bytes: bytes 128 to 160 and 173 have no letter of their own and take 290 on and 323.
_LETTERS = {c: "".join(chr(b + 162 if b <= 160 else 323 if b == 173 else b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Recent(dict):
    """What `make` gives for a word, kept in two generations: the older one goes when the younger is full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= MOST_CHARS:
            if len(self) >= MOST_KEPT // 2:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class TokenIds:
    """A tokenizer's ids of a text as little-endian unsigned 32-bit numbers, without special tokens at the ends.

    Where the tokenizer drops white space and cuts each word by itself, ids of words are kept and looked up, as are those of the parts
    that it cuts a plain word into; every other word, and every text of another tokenizer, goes to the library whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        first = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        own = made["added_tokens"]
        self.by_word = (made["normalizer"] or {}).get("normalizers") == _NORMAL and first.get("pattern") == {"Regex": _CUT} and first.get("behavior") == "Removed" and first.get("invert") is True
        self.by_word &= made["post_processor"] is None and made["truncation"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _SPACE.search(t["content"]) for t in own)
        # a word that may hold a special string is not cut
        self.special = re.compile("|".join(re.escape(t["content"]) for t in own) or r"(?!)")
        self.model = self.tokenizer.model
        self.parts = Recent(self._part)
        self.words = Recent(self._word)

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _part(self, part: str) -> bytes:
        """A part as the library's cutting leaves it, in the letters that stand for bytes, needs the library's merges alone."""
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(part.translate(_LETTERS)))

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or self.special.search(word):
            return self.library(word) if word else b""
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self.library(text)
        words = _SPACE.split(text) if _WIDER.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def load(path: str) -> TokenIds:
    """One for each worker process."""
    return TokenIds(path)


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, task, n_tokens, crcs and nth, lists with an entry for each piece of `capacity` tokens: the checksum of its ids, and
    how many pieces of its length the task has made before. Each text's ids are followed by end_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, made, width = load(tokenizer), [0] * (capacity + 1), 4 * capacity
        task = TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                own = ids(text) + end_id.to_bytes(4, "little")
                crcs, nth = [], []
                for at in range(0, len(own), width):
                    piece = own[at : at + width]
                    crcs.append(zlib.crc32(piece))
                    nth.append(made[len(piece) // 4])
                    made[len(piece) // 4] += 1
                rows.append((len(own) // 4, crcs, nth))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "task": task, "n_tokens": [r[0] for r in rows], "crcs": [r[1] for r in rows], "nth": [r[2] for r in rows]})

    own = documents(docs).select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = own.mapInPandas(run, "doc_id long, no_id boolean, task int, n_tokens long, crcs array<long>, nth array<long>")
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


@dataclass(frozen=True)
class Placement:
    """Pieces number low to high - 1 of a length: `each` to a sequence, from sequence `first` on, the first of each at `offset`."""

    length: int
    low: int
    high: int
    each: int
    first: int
    offset: int


class _Plan:
    def __init__(self, counts: Mapping[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {k: n for k, n in counts.items() if n}
        self.used = dict.fromkeys(self.left, 0)
        self.gaps: list[int] = []
        #: Runs (first sequence, sequences) by gap.
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sequences = 0
        self.placed: list[Placement] = []

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def keep(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                insort(self.gaps, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, n))

    def put(self, length: int, pieces: int, each: int, first: int, offset: int) -> None:
        low = self.used[length]
        self.used[length] = low + pieces
        self.left[length] -= pieces
        self.placed.append(Placement(length, low, low + pieces, each, first, offset))


def _match(plan: _Plan, large: list[int]) -> None:
    """Pairs of large items: each length, from the greatest down, with the greatest one that fits and is left."""
    for a in large:
        mates = [b for b in large if a + b <= plan.capacity and b <= a]
        for b in mates:
            n = plan.left[a] // 2 if a == b else min(plan.left[a], plan.left[b])
            if n:
                first = plan.open(n)
                plan.put(a, 2 * n if a == b else n, 2 if a == b else 1, first, 0)
                if a != b:
                    plan.put(b, n, 1, first, a)
                plan.keep(plan.capacity - a - b, first, n)
            if not plan.left[a]:
                break
        if n := plan.left[a]:
            first = plan.open(n)
            plan.put(a, n, 1, first, 0)
            plan.keep(plan.capacity - a, first, n)


def _fit(plan: _Plan, small: list[int]) -> None:
    """Small items, the greatest first, into the least gap that takes them; new sequences only where none does."""
    for s in small:
        while plan.left[s]:
            at = bisect_left(plan.gaps, s)
            if at == len(plan.gaps):
                n = -(-plan.left[s] // (plan.capacity // s))
                plan.keep(plan.capacity, plan.open(n), n)
                continue
            gap = plan.gaps[at]
            first, n = plan.runs[gap].pop()
            if not plan.runs[gap]:
                del plan.runs[gap], plan.gaps[at]
            each, offset = gap // s, plan.capacity - gap
            full = min(n, plan.left[s] // each)
            if full:
                plan.put(s, full * each, each, first, offset)
                plan.keep(gap - each * s, first, full)
            rest = plan.left[s] if full < n else 0
            if rest:
                plan.put(s, rest, rest, first + full, offset)
                plan.keep(gap - rest * s, first + full, 1)
            done = full + bool(rest)
            plan.keep(gap, first + done, n - done)


def plan(counts: Mapping[int, int], capacity: int) -> list[Placement]:
    """Where so many pieces of each length (1 to capacity) go."""
    out = _Plan(counts, capacity)
    order = sorted(out.left, reverse=True)
    _match(out, [k for k in order if 3 * k > capacity])
    _fit(out, [k for k in order if 3 * k <= capacity])
    return out.placed


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every text in its sequence of `capacity` tokens."""
    made = stored(cut(docs, tokenizer, capacity, end_id))
    each = made.select("doc_id", "task", "n_tokens", F.posexplode(F.arrays_zip("crcs", "nth")).alias("piece", "x"))
    start = F.col("piece").cast("long") * capacity
    pieces = each.select("doc_id", "piece", "task", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("length"), F.col("x.crcs").alias("ids_crc32"), F.col("x.nth").alias("nth"))
    counts = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each length, `capacity` at most
    planned = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    spark = docs.sparkSession
    places = spark.createDataFrame([(p.length, p.low, p.high, p.each, p.first, p.offset) for p in planned], "length long, low long, high long, each long, first long, base long")
    number = pieces.join(counts.select("length", "task", before.alias("before")), ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    found = number.join(F.broadcast(places), "length").where("number >= low AND number < high").withColumn("j", F.col("number") - F.col("low"))
    sequence = F.col("first") + F.floor(F.col("j") / F.col("each"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), (F.col("base") + F.col("j") % F.col("each") * F.col("length")).alias("offset"))


def sequences(lengths: Iterable[int], capacity: int) -> int:
    """A number of sequences that pieces of these lengths need at least: for their tokens, for those above half a sequence, of which
    one goes into each, and for those above a third, of which two do."""
    lengths = list(lengths)
    return max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths), -(-sum(3 * x > capacity for x in lengths) // 2))

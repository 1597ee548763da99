"""Hidden Markov language model (operator 10).

Tokens are words, ASCII letters in lower case, then one end token. Scores are the exact log10 likelihood of the whole text
by the scaled forward recursion over states that emit words.

1. Words are counted over all training texts, into a table that grows with the input.
2. Texts are written once as numbers: of the HEAD most frequent words (a fixed number, so they go to the workers), and of
   CLASSES classes (a hash of the word) for all others, which a text carries beside it.
3. Baum-Welch: each round every partition adds up expected counts over its training texts, the sums over partitions give the
   next model. While rounds go on, the OWN most frequent words have emissions of their own and other words share those of
   their classes, so what goes round is bounded. Rounds over one text in SAMPLE_EVERY come first and only give the start;
   those over all training texts follow until the likelihood has settled.
4. One more pass adds up how often each state emitted each head word and each class. A state emits a word by the word's
   smoothed count, from the table of all words, times the state's share in it: a head word's own share, smoothed by KAPPA
   tokens dealt as its class is, and the class's share for words outside the head and unknown ones. That count is the same
   factor in every state, so words outside the head meet the table in one join beside the recursion, not within it.

The recursions run over stretches of STRETCH tokens, all stretches of a batch at once. Where a text has several, the product
of a stretch's transition and emission matrices gives the state before the next one, which gives the same numbers as one step
after the other and makes a long text no slower than many short ones.

Null and empty texts have the end token only. Repeated rows each count and each give a row. Rows with a null id are scored
but not learned from, and are not held out. Equally frequent words are in the head or outside it together. Without any
training text all counts are zero and the model is uniform; an empty table gives no rows. Extra columns are not looked at.
Very long texts need memory in proportion to their own length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, stored

STATES = 4
OWN, CLASSES = 16_384, 4096
HEAD = 200_000
STRETCH = 256
BATCH_TOKENS = 200_000
#: Steps after which numbers are scaled; what so many emissions multiply to is far from what a double can hold.
SCALE_EVERY = 8
#: Added to expected counts.
SMOOTH = 0.1
MAX_KEPT = 250_000
#: Tokens dealt to states as those of its class are that count beside a word's own.
KAPPA = 1.0
#: Rounds end when the log10 likelihood a token gains less than SETTLED, or after MOST_ROUNDS.
SETTLED, MOST_ROUNDS = 1e-3, 20
#: One text in so many is in the first rounds, and its table has so many times fewer partitions.
SAMPLE_EVERY = 20
END = ""  # no word is empty
SUMS = [f"e{k}" for k in range(STATES)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def learned() -> Column:
    return F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES if word else CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c, cls: how often each token occurs in training texts. The end token is the empty word, with a class of its own."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        ends = 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in counts], "c": list(counts.values()), "cls": [class_of(w) for w in counts]})

        for pdf in it:
            for text in pdf["text"]:
                counts.update(tokens(text))
                if len(counts) > MAX_KEPT:
                    yield rows()
                    counts.clear()
            ends += len(pdf)
        if counts:
            yield rows()
        if ends:
            yield pd.DataFrame({"word": [END], "c": [ends], "cls": [CLASSES]})

    parts = documents(docs).where(learned()).select("text").mapInPandas(run, "word string, c long, cls int")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.first("cls").alias("cls"))


def _least(counts: DataFrame) -> int:
    """The count from which on words are in the head: from how many words have which count, largest first."""
    sizes = counts.where(F.col("word") != END).groupBy(F.least(F.col("c"), F.lit(1 << 20)).alias("c")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c"))
    least, total = 1 << 62, 0
    for row in sizes.limit(HEAD).toLocalIterator():
        total += row["k"]
        if total > HEAD:
            break
        least = row["c"]
    return least


class Recursion:
    """Forward (and backward) recursion over texts, given as one array of numbers and their lengths (at least 1 each).

    emit: number, state. Stretches lie side by side, longest first, so those that go on at a step are the first ones."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.start, self.move, self.lengths = start, move, lengths
        n = -(-lengths // STRETCH)
        text = np.repeat(np.arange(len(lengths)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(np.cumsum(lengths) - lengths, n) + number * STRETCH
        size = np.minimum(STRETCH, np.repeat(lengths, n) - number * STRETCH)
        order = np.argsort(-size, kind="stable")
        self.text, self.number, self.size = text[order], number[order], size[order]
        self.active = len(size) - np.searchsorted(np.sort(size), np.arange(1, size.max() + 1))
        self.offset = np.cumsum(self.active) - self.active
        total = int(self.active.sum())
        step = np.repeat(np.arange(len(self.active)), self.active)
        self.row = np.arange(total) - self.offset[step]
        self.flat = flat[first[order][self.row] + step]
        self.step = step
        self.emitted = emit[self.flat]
        self.before = np.broadcast_to(start, (len(size), STATES)).copy()
        self.levels: list[np.ndarray] = []
        if n.max() > 1:
            self._chain(np.flatnonzero(n[self.text] > 1))
        self._forward()

    def _chain(self, rows: np.ndarray) -> None:
        """State before each stretch of the texts that have several: the products of their matrices, chained text by text."""
        k = len(rows)
        m, size = np.broadcast_to(np.eye(STATES), (k, STATES, STATES)).copy(), self.size[rows]
        going = k - np.searchsorted(np.sort(size), np.arange(1, size.max() + 1))
        for t, a in enumerate(going):
            x = (m[:a].reshape(a * STATES, STATES) @ self.move).reshape(a, STATES, STATES)
            x *= self.emitted[self.offset[t] + rows[:a]][:, None, :]
            if t % SCALE_EVERY == SCALE_EVERY - 1:
                x /= x.reshape(a, -1).sum(1)[:, None, None]
            m[:a] = x
        self.product = m
        by_number = np.argsort(self.number[rows], kind="stable")
        cuts = np.searchsorted(self.number[rows][by_number], np.arange(self.number[rows].max() + 2))
        self.levels = [by_number[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.rows = rows
        state = np.broadcast_to(self.start, (len(self.lengths), STATES)).copy()
        for level in self.levels:
            who = self.text[rows[level]]
            self.before[rows[level]] = state[who]
            x = np.einsum("ni,nij->nj", state[who], m[level])
            state[who] = x / x.sum(1, keepdims=True)

    def _forward(self) -> None:
        self.alpha = np.empty_like(self.emitted)
        logs, last = np.zeros(len(self.size)), self.before
        for t, (o, a) in enumerate(zip(self.offset, self.active, strict=True)):
            x = np.matmul(last[:a], self.move, out=self.alpha[o : o + a])
            x *= self.emitted[o : o + a]
            if t % SCALE_EVERY == SCALE_EVERY - 1:
                s = x.sum(1)
                x /= s[:, None]
                logs[:a] += np.log(s)
            last = x
        ends = self.alpha[self.offset[self.size - 1] + np.arange(len(self.size))]
        self.loglik = np.bincount(self.text, logs + np.log(ends.sum(1)), len(self.lengths))

    def expected(self, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of the start state, of moves, and of numbers by state."""
        after = np.ones((len(self.size), STATES))
        right = np.ones((len(self.lengths), STATES))
        for level in reversed(self.levels):
            rows = self.rows[level]
            who = self.text[rows]
            after[rows] = right[who]
            x = np.einsum("nij,nj->ni", self.product[level], right[who])
            right[who] = x / x.sum(1, keepdims=True)
        beta, b, back = np.empty_like(self.alpha), after, self.move.T.copy()
        for t in range(len(self.active) - 1, -1, -1):
            o, a = self.offset[t], self.active[t]
            beta[o : o + a] = b[:a]
            x = (self.emitted[o : o + a] * b[:a]) @ back
            if t % SCALE_EVERY == 0:
                x /= x.sum(1, keepdims=True)
            b[:a] = x
        begins = self.number == 0
        start = self.start * b[begins]
        start = (start / start.sum(1, keepdims=True)).sum(0)
        gamma = self.alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        n = len(self.size)
        past = np.concatenate([self.before, self.alpha[self.offset[self.step[n:] - 1] + self.row[n:]]])
        beta *= self.emitted
        past /= ((past @ self.move) * beta).sum(1, keepdims=True)
        emit = np.stack([np.bincount(self.flat, gamma[:, s], numbers) for s in range(STATES)], 1)
        return start, (past.T @ beta) * self.move, emit


def _batches(it: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with their texts' numbers, about BATCH_TOKENS at a time."""
    for pdf in it:
        kept: list[np.ndarray] = []
        size = first = 0
        for i, raw in enumerate(pdf["codes"]):
            kept.append(np.frombuffer(raw, np.int32))
            size += len(kept[-1])
            if size >= BATCH_TOKENS:
                yield pdf.iloc[first : i + 1], kept
                kept, size, first = [], 0, i + 1
        if kept:
            yield pdf.iloc[first:], kept


@dataclass
class Words:
    """A trained model. Numbers: 0 the end token, then the head's words, the most frequent first, then classes."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # number, state: weights; for classes without the word's count
    counts: DataFrame  # word, c, cls
    head: list[bytes]
    head_counts: np.ndarray
    tokens: int
    distinct: int
    texts: DataFrame  # rid, doc_id, no_id, learn, codes, rare of all rows
    loglik: list[float]  # log10, of a token, in each round over all training texts


def _encoded(docs: DataFrame, head: list[bytes]) -> DataFrame:
    """rid, doc_id (0 for none), no_id, learn, codes (texts as numbers), rare (the words outside the head)."""
    shared = docs.sparkSession.sparkContext.broadcast(head)  # HEAD words

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: i for i, w in enumerate(shared.value) if w}
        known = len(shared.value)
        get, none = number.get, repeat(-1)
        for pdf in it:
            codes, rare = [], []
            for text in pdf["text"]:
                w = tokens(text)
                x = np.zeros(len(w) + 1, np.int32)
                x[:-1] = list(map(get, w, none))
                at = np.flatnonzero(x < 0)
                others = [w[i] for i in at.tolist()]
                x[at] = [known + zlib.crc32(o) % CLASSES for o in others]
                codes.append(x.tobytes())
                rare.append([o.decode() for o in others])
            yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "learn": pdf["learn"], "codes": codes, "rare": rare})

    own = documents(docs).select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), learned().alias("learn"), "text")
    return own.mapInPandas(run, "rid long, doc_id long, no_id boolean, learn boolean, codes binary, rare array<string>")


def _round(texts: DataFrame, units: object, n_units: int, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and units (by state) over texts, and the log10 likelihood of a token under the model given.

    units: the unit of each number, None if numbers are units."""
    shared = texts.sparkSession.sparkContext.broadcast((start, move, emit))  # units x states numbers

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, emit = shared.value
        unit = units.value if units is not None else None
        sums, one, moves, of_text = np.zeros((n_units, STATES)), np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((1, STATES))
        for _, codes in _batches(it):
            flat = np.concatenate(codes)
            r = Recursion(start, move, emit, flat if unit is None else unit[flat], np.array([len(x) for x in codes]))
            a, b, c = r.expected(n_units)
            one += a
            moves += b
            sums += c
            of_text[0, :2] += r.loglik.sum(), len(flat)
        x = np.concatenate([sums, one[None], moves, of_text])
        at = np.flatnonzero(x.any(1))
        if len(at):
            yield pd.DataFrame({"i": at} | {c: x[at, k] for k, c in enumerate(SUMS)})

    kind = "i int, " + ", ".join(f"{x} double" for x in SUMS)
    got = texts.select("codes").mapInPandas(run, kind).groupBy("i").agg(*(F.sum(x).alias(x) for x in SUMS)).toPandas()
    x = np.zeros((n_units + STATES + 2, STATES))
    x[got["i"]] = got[SUMS].to_numpy(float)
    return x[n_units], x[n_units + 1 : -1], x[:n_units], float(x[-1, 0] / np.log(10) / max(x[-1, 1], 1))


def _next(start: np.ndarray, move: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, move, sums = start + SMOOTH, move + SMOOTH, sums + SMOOTH
    return start / start.sum(), move / move.sum(1, keepdims=True), sums / sums.sum(0)


def _settled(loglik: list[float]) -> bool:
    return len(loglik) > 1 and abs(loglik[-1] - loglik[-2]) < SETTLED


def _weights(sums: np.ndarray, head: list[bytes], counts: np.ndarray, by_class: pd.DataFrame) -> np.ndarray:
    """number, state: what a state emits a number with, so that its words, one unknown word of each class among them, add up to one."""
    known = len(head)
    cls = np.array([class_of(w) for w in head], int)
    of_class = np.zeros((CLASSES + 1, STATES))
    np.add.at(of_class, cls, sums[:known])
    of_class[:CLASSES] += sums[known:]
    whole = (sums.sum(0) + SMOOTH) / (sums.sum() + SMOOTH * STATES)
    of_class = (of_class + SMOOTH * whole) / (of_class.sum(1, keepdims=True) + SMOOTH)
    own = (sums[:known] + KAPPA * of_class[cls]) / (sums[:known].sum(1, keepdims=True) + KAPPA) * (counts[:, None] + 0.1)
    # smoothed counts of the words outside the head, and of an unknown one, in each class
    rest = np.full(CLASSES, 0.1)
    at = by_class["cls"].to_numpy(int)
    rest[at] += by_class["n"].to_numpy(float) + 0.1 * by_class["v"].to_numpy(float)
    np.subtract.at(rest, cls[1:], counts[1:] + 0.1)
    weights = np.concatenate([own, of_class[:CLASSES]])
    return weights / (own.sum(0) + (np.maximum(rest, 0.1)[:, None] * of_class[:CLASSES]).sum(0))


def fit(docs: DataFrame, most: int = MOST_ROUNDS, seed: int = 11) -> Words:
    spark = docs.sparkSession
    counts = stored(word_counts(docs))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    by_class = counts.where(F.col("word") != END).groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # CLASSES rows
    frequent = counts.where((F.col("c") >= _least(counts)) & (F.col("word") != END))
    rows = frequent.select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])  # HEAD rows
    head = [b"", *map(str.encode, rows["word"])]
    head_counts = np.r_[float(total["ends"]), rows["c"].to_numpy(float)]
    known = len(head)
    texts = stored(_encoded(docs, head))
    # the units of the rounds: the end token, the most frequent words, classes of all others
    n_own = min(OWN + 1, known)
    n_units = n_own + CLASSES
    unit = np.arange(known + CLASSES, dtype=np.int32)
    unit[n_own:known] = [n_own + class_of(w) for w in head[n_own:]]
    unit[known:] = n_own + np.arange(CLASSES)
    units = spark.sparkContext.broadcast(unit)
    n = np.zeros(n_units)
    n[n_own + by_class["cls"].to_numpy(int)] = by_class["n"]
    n[:n_own] = head_counts[:n_own]
    np.subtract.at(n, [n_own + class_of(w) for w in head[1:n_own]], head_counts[1:n_own])
    # states that last and units dealt out far from evenly at random part sooner than nearly equal states
    rng = np.random.default_rng(seed)
    start = np.full(STATES, 1 / STATES)
    move = np.where(np.eye(STATES) > 0, 0.97, 0.03 / (STATES - 1))
    emit = np.exp(rng.normal(0, 2, (n_units, STATES)))
    emit = emit / emit.sum(1, keepdims=True) * (n + SMOOTH)[:, None]
    emit /= emit.sum(0)
    train = texts.where("learn")
    parts = texts.rdd.getNumPartitions()
    sample = stored(train.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE_EVERY)) == 0).select("codes").coalesce(max(1, parts // SAMPLE_EVERY)))
    logs: dict[bool, list[float]] = {True: [], False: []}
    for some in (True, False):
        while len(logs[some]) < most and not _settled(logs[some]):
            *sums, was = _round(sample if some else train, units, n_units, start, move, emit)
            start, move, emit = _next(*sums)
            logs[some].append(was)
    discard(sample)
    # once more, with sums of each head word's own
    *_, sums, _was = _round(train, None, known + CLASSES, start, move, emit[unit])
    return Words(start, move, _weights(sums, head, head_counts, by_class), counts, head, head_counts, int(total["n"]), int(total["v"]), texts, logs[False])


def score(w: Words) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row that fit was given."""
    # numbers of classes stand for words whose counts are added later
    n_log = np.r_[np.log10(w.head_counts + 0.1), np.zeros(CLASSES)]
    is_known = np.r_[w.head_counts > 0, np.zeros(CLASSES, bool)]
    shared = w.texts.sparkSession.sparkContext.broadcast((w.start, w.move, w.emit, n_log, is_known))  # HEAD x STATES numbers
    norm = float(np.log10(w.tokens + 0.1 * (w.distinct + 1)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move, emit, n_log, is_known = shared.value
        for pdf, codes in _batches(it):
            flat, lengths = np.concatenate(codes), np.array([len(x) for x in codes])
            first = np.cumsum(lengths) - lengths
            base = np.add.reduceat(n_log[flat], first) - lengths * norm
            known = np.add.reduceat(is_known[flat].astype(np.int64), first)
            r = Recursion(start, move, emit, flat, lengths)
            yield pd.DataFrame({"rid": pdf["rid"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "no_id": pdf["no_id"].to_numpy(), "n_tokens": lengths, "known": known, "base": base, "inside": r.loglik / np.log(10)})

    kind = "rid long, doc_id long, no_id boolean, n_tokens long, known long, base double, inside double"
    out = w.texts.select("rid", "doc_id", "no_id", "codes").mapInPandas(run, kind)
    rare = w.texts.select("rid", F.explode("rare").alias("word")).join(w.counts.select("word", "c"), "word", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("logs"), F.count("c").alias("rare_known"))
    out = out.join(rare, "rid", "left").withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id")))
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(w.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("inside") + logs).alias("score"),
    )

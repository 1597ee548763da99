"""Near duplicates by MinHash bands with sequential Bayesian verification (operator 4).

Words have ASCII letters in lower case; a document's set is its distinct shingles of SHINGLE words (all its words as one if
there are fewer; nothing without words). Two documents are linked if the Jaccard similarity of their sets is at least 0.75,
and documents joined by links form a group, of which the smallest doc_id stays.

1. Documents with the same set (a 128-bit digest) are one class; from here on there is a row, with a number, for each class only.
2. A signature of BANDS x ROWS minima is cut into bands; classes that agree in a band are in one bucket. Two sets at the
   threshold miss each other in all bands with a chance of (1 - 0.75^ROWS)^BANDS, 5 in a million, and less above it.
3. In each bucket, members are compared with a pivot, the one with the least number; a member looks at one of its buckets' pivots,
   then at four, then at all, but never at one that is in its group by then. A bucket of n near copies costs about n
   comparisons and not n squared. What is left are members outside the largest group of their bucket; each is compared with
   all of the bucket that are not in its group, so every pair that could join two groups is looked at. In buckets of up to
   PAIRWISE this is a join of pairs. In larger ones outside members are cut into blocks of BLOCK hashes, and the bucket
   streams past each block: a bucket of n with m outside ships n rows for each block, never a row for each pair.
4. A comparison looks at signatures BATCH minima at a time. After each batch the posterior of the similarity given the
   matches so far (uniform prior) must leave the threshold a chance of at least MISS, or the pair is dropped; survivors
   are confirmed on their full sets. The same rule runs first on the low four bits of each minimum and on set sizes, in the
   join that makes the pairs: equal minima have equal bits, so it drops no pair that the whole minima would keep, and a
   passage shared by many documents that are no copies makes no rows and ships no texts.
5. Groups are the connected components of confirmed links.

Joins are by a shuffle, whatever a side's size: there are many small ones, and each side that is broadcast passes through the driver.

Texts that are null or empty have the empty set, are linked with nothing and stay. Rows with a null id are linked with
nothing and stay, with a null component. Rows that repeat a doc_id each give a row; those with different texts are documents
of their own, which share no more than the id, and `version` tells them apart. Ties: the smallest doc_id. Extra columns are
not looked at. An empty table gives none. Very long texts need memory in proportion to their own length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_python, discard, documents, stored, version
from .components import components, edges

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
#: Chance with which a pair at the threshold may be dropped before its sets are compared.
MISS = 1e-6
#: Similarity as a fraction, so that whole numbers decide.
TOP, BOTTOM = 75, 100
#: Comparisons of one pivot that are dealt out together; pivots with more are dealt out in parts.
DEAL = 256
#: Largest bucket whose left-over pairs are made by a join.
PAIRWISE = 32
#: Shingles and minima of outside members that a task holds while a bucket streams by, and members that stream by in one task.
BLOCK, SHARE = 1 << 17, 1024
MAX_KEPT = 250_000
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class Words(dict):
    """64-bit hash of each word, kept; bounded."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_KEPT:
            self[word] = got
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = len(h) - SHINGLE + 1
    if len(h) == 0:
        return h
    if n < 1:
        n = 1
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out + h[k : k + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    a, b = _family()
    least = np.full(HASHES, _MASK, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, (s[i : i + 4096, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen (a batch) to a whole number."""
    bits = (sig & np.uint32(15)).astype(np.uint64).reshape(-1, BATCH) << np.arange(0, 4 * BATCH, 4, dtype=np.uint64)
    return bits.sum(axis=1, dtype=np.uint64).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, version, n_shingles, digest (null without shingles), sig, sketch. docs: doc_id, version, text."""
    kept: list[Words] = []

    def run(pdf: pd.DataFrame) -> Iterator[dict]:
        if not kept:  # once a task
            kept.append(Words())
        out: dict[str, list] = {c: [] for c in ("version", "n_shingles", "digest", "sig", "sketch")}
        out["version"] = pdf["version"].tolist()
        for text in pdf["text"]:
            s = shingle_set(text, kept[0])
            least = signature(s) if len(s) else None
            out["n_shingles"].append(len(s))
            out["digest"].append(None if least is None else xxhash.xxh3_128_digest(s.tobytes()))
            out["sig"].append(None if least is None else least.tobytes())
            out["sketch"].append(None if least is None else sketch(least))
        yield out

    return by_python(docs, run, "version long, n_shingles long, digest binary, sig binary, sketch array<long>")


@lru_cache(maxsize=1)
def least_matches(top: int = TOP, bottom: int = BOTTOM) -> tuple[int, ...]:
    """For each whole number of batches the fewest matches with which the similarity may still reach the threshold: the posterior of a
    uniform prior, Beta(matches + 1, misses + 1), has a tail above the threshold that is a sum of binomial terms."""
    t, out = top / bottom, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = lambda m, n=n: sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= MISS))
    return tuple(out)


def near(n: Column, m: Column, a: Column, b: Column) -> Column:
    """Whether sets of n and m shingles with sketches a and b may still be linked: set sizes, then batch after batch."""
    ok, same = BOTTOM * F.least(n, m) >= TOP * F.greatest(n, m), F.lit(0)
    for k, least in enumerate(least_matches()):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        same = same + (F.lit(BATCH) - F.bit_count(x))
        ok = ok & (same >= least)
    return ok


def may_reach(a: np.ndarray, b: np.ndarray) -> bool:
    same = 0
    for k, least in enumerate(least_matches()):
        same += int(np.count_nonzero(a[k * BATCH : (k + 1) * BATCH] == b[k * BATCH : (k + 1) * BATCH]))
        if same < least:
            return False
    return True


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if BOTTOM * min(len(a), len(b)) < TOP * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return BOTTOM * both >= TOP * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: the groups (ra, rb) of pairs (a, b) that are linked. sets: rep, sig, text of all that occur.

    Each pivot's text comes first and stays while its partners stream by, so a task holds two texts at a time; a pivot with
    many partners is dealt out in parts."""
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / DEAL).cast("long").alias("parts"))
    dealt = pairs.join(parts.hint("merge"), "a").select("a", "b", "ra", "rb", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    none = F.lit(-1).cast("long")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(sets.hint("merge"), F.col("a") == F.col("rep")).select("a", "part", none.alias("b"), none.alias("ra"), none.alias("rb"), "sig", "text")
    tails = dealt.join(sets.hint("merge"), F.col("b") == F.col("rep")).select("a", "part", "b", "ra", "rb", "sig", "text")
    # numbers of classes are not negative, so the head comes first
    rows = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        sig = whole = None
        text = ""
        for pdf in it:
            u, v = [], []
            for b, ra, rb, s, t in zip(pdf["b"], pdf["ra"], pdf["rb"], pdf["sig"], pdf["text"], strict=True):
                got = np.frombuffer(s, np.uint32)
                if b < 0:
                    sig, text, whole = got, t, None
                elif may_reach(sig, got):
                    if whole is None:
                        whole = shingle_set(text, words)
                    if linked(whole, shingle_set(t, words)):
                        u.append(int(ra))
                        v.append(int(rb))
            yield pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return rows.mapInPandas(run, "u long, v long")


def confirmed_in_blocks(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: groups that a link joins, of each outside member and all of its bucket. inside: key, band, rep, own (its group),
    outside, n_shingles of large buckets' members; sets: rep, sig, text.

    Of a pair in several buckets only the first band's task looks at it; of two outside members only the smaller one's block."""
    hashes = F.when(F.col("outside"), F.col("n_shingles") + HASHES).otherwise(F.lit(0))
    cuts = inside.groupBy("key").agg(F.ceil(F.sum(hashes) / BLOCK).cast("long").alias("blocks"), F.ceil(F.count(F.lit(1)) / SHARE).cast("long").alias("shares"))
    cut = inside.drop("n_shingles").join(cuts.where("blocks > 0").hint("merge"), "key")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    heads = cut.where("outside").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("share", each("shares")).withColumn("head", F.lit(True))
    tails = cut.withColumn("share", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("shares"))).withColumn("block", each("blocks")).withColumn("head", F.lit(False))
    rows = heads.unionByName(tails).drop("blocks", "shares").join(sets.hint("merge"), "rep")
    rows = rows.repartition("key", "block", "share").sortWithinPartitions("key", "block", "share", F.desc("head"), "rep")
    least = np.array(least_matches())

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        at = sigs = None
        reps, owns, held, texts, whole = [], [], [], [], {}
        for pdf in it:
            found = set()
            for key, block, share, head, band, rep, own, outside, sig, text in zip(*(pdf[c] for c in ("key", "block", "share", "head", "band", "rep", "own", "outside", "sig", "text")), strict=True):
                if (key, block, share) != at:
                    at, sigs = (key, block, share), None
                    reps, owns, held, texts, whole = [], [], [], [], {}
                got = np.frombuffer(sig, np.uint32)
                if head:
                    reps.append(rep)
                    owns.append(own)
                    held.append(got)
                    texts.append(text)
                    continue
                if not held:  # no outside member was dealt to this block
                    continue
                if sigs is None:
                    sigs, reps, owns = np.array(held).reshape(-1, HASHES), np.array(reps), np.array(owns)
                same = sigs == got
                look = owns != own
                if outside:
                    look &= reps < rep
                look &= same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                look &= (same.reshape(len(sigs), -1, BATCH).sum(axis=2).cumsum(axis=1) >= least).all(axis=1)
                mine = None
                for i in np.flatnonzero(look):
                    link = (min(own, owns[i]), max(own, owns[i]))
                    if link in found:
                        continue
                    if mine is None:
                        mine = shingle_set(text, words)
                    if i not in whole:
                        whole[i] = shingle_set(texts[i], words)
                    if linked(whole[i], mine):
                        found.add(link)
            yield pd.DataFrame(sorted(found), columns=["u", "v"], dtype="int64")

    return rows.mapInPandas(run, "u long, v long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, version (of the text) for every row."""
    df = documents(docs).withColumn("version", version(F.col("text")))
    f = stored(features(df))
    # a class goes by a number of its own, as ids may repeat; of its documents the one with the smallest id stands for it
    first = F.min(F.struct("doc_id", "version")).alias("first")
    classes = f.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("first.doc_id").alias("least"), "first.version", "n_shingles", "sig", "sketch"))
    keys = classes.select("rep", F.posexplode(F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)))).alias("band", "key"))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(keys.join(pivots.hint("merge"), "key"))
    members = buckets.select("rep").distinct()
    chosen = classes.join(members.hint("merge"), "rep", "left_semi").select(F.col("least").alias("doc_id"), "version", "rep", "sig")
    sets = stored(df.where("doc_id IS NOT NULL").join(chosen.hint("merge"), ["doc_id", "version"]).groupBy("rep").agg(F.min("text").alias("text"), F.min("sig").alias("sig")))
    short = stored(classes.join(members.hint("merge"), "rep", "left_semi").select("rep", "n_shingles", "sketch"))
    labels = stored(members.select(F.col("rep").alias("v"), F.col("rep").alias("root")))
    tried = None

    def label(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("v").alias(col), F.col("root").alias(name)).hint("merge"), col)

    def sized(df: DataFrame, col: str) -> DataFrame:
        """df with the set size and the sketch of col as n_col and s_col."""
        return df.join(short.select(F.col("rep").alias(col), F.col("n_shingles").alias(f"n_{col}"), F.col("sketch").alias(f"s_{col}")).hint("merge"), col)

    def untried(df: DataFrame) -> DataFrame:
        """Pairs (a, b) that were not compared, in whichever direction."""
        if tried is None:
            return df
        return df.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(tried.hint("merge"), ["x", "y"], "left_anti").drop("x", "y")

    def compare(pairs: DataFrame) -> None:
        """Confirms pairs (a, b) of groups (ra, rb) and lets their links join groups: components of what is still apart are few and small."""
        nonlocal tried
        now = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tried = now if tried is None else tried.unionByName(now)
        merge(confirmed(pairs, sets))

    def merge(links: DataFrame) -> None:
        """Lets links (u, v) of groups join them."""
        nonlocal labels
        links = edges(links)
        if not links.isEmpty():
            joined = components(links).select(F.col("v").alias("root"), F.col("root").alias("to"))
            labels, old = stored(labels.join(joined.hint("merge"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))), labels
            discard(old)

    # every member with its buckets' first pivots: one of them, then four, then all; those already in its group are passed over
    firsts = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    firsts = stored(sized(sized(firsts, "a"), "b").where(near(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"))).select("a", "b"))
    for several in (1, 4, BANDS):
        # before anything was compared each is a group of its own
        apart = firsts.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")) if tried is None else untried(label(label(firsts, "a", "ra"), "b", "rb").where("ra <> rb"))
        pairs = stored(apart.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("a"))).where(F.col("r") <= several).select("a", "b", "ra", "rb"))
        if pairs.isEmpty():
            break
        compare(pairs)
    # members outside the largest group of their bucket with all others; the pivot was looked at by all
    left = label(buckets.where("n > 2 AND rep <> pivot"), "rep", "own")
    main = left.groupBy("key", "own").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("own", F.struct("size", "own")).alias("main"), F.count(F.lit(1)).alias("several"))
    left = stored(left.join(main.where("several > 1").drop("several").hint("merge"), "key"))
    inside = left.where(F.col("n") > PAIRWISE).join(short.select("rep", "n_shingles").hint("merge"), "rep").select("key", "band", "rep", "own", (F.col("own") != F.col("main")).alias("outside"), "n_shingles")
    merge(confirmed_in_blocks(stored(inside), sets))
    left = stored(label(left.where(F.col("n") <= PAIRWISE).drop("own"), "rep", "own").select("key", "rep", "own", "main"))
    bucket = sized(left.select("key", "rep", "own"), "rep")
    chosen = sized(left.where("own <> main").select("key", F.col("rep").alias("p"), F.col("own").alias("p_own")), "p")
    apart = (F.col("own") != F.col("p_own")) & near(F.col("n_p"), F.col("n_rep"), F.col("s_p"), F.col("s_rep"))
    again = chosen.join(bucket.hint("merge"), "key").where(apart).select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b"), F.col("own").alias("ra"), F.col("p_own").alias("rb"))
    again = again.dropDuplicates(["a", "b"])
    fresh = stored(untried(again))
    if not fresh.isEmpty():
        compare(fresh)
    # a class's component, by the smallest id of all classes it is joined with
    of_class = classes.select("rep", "digest", "least").join(labels.select(F.col("v").alias("rep"), "root").hint("merge"), "rep", "left").select("digest", "least", F.coalesce("root", "rep").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least.hint("merge"), "root").select("digest", "component_id")
    rows = f.where("digest IS NOT NULL").select("doc_id", "version", "n_shingles", "digest").join(of_class.hint("merge"), "digest", "left").drop("digest")
    # rows without a set have no key to be joined by
    rows = rows.unionByName(f.where("digest IS NULL").select("doc_id", "version", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    rows = rows.withColumn("component_id", component)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "version")

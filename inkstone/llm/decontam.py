"""Benchmark decontamination by SimHash windows (operator 3), without Python on the executors.

A window is as many words of a document as the benchmark item has (the whole document if it has fewer). Words are
compared with ASCII letters in lower case; a shingle is five words (the whole sequence if there are fewer).

1. A window can only be similar to an item if they share a shingle, so shingles of documents are joined with those of the
   benchmark; each hit puts an item-sized window where the item would begin. No other window is fingerprinted, as none could
   be verified in step 3. An item of
   fewer than five words is one shingle, so documents are also cut into windows of each such length among the items.
2. Windows and items get a 64-bit SimHash of their shingles, weighted by how often each occurs. Cut into BLOCKS blocks,
   two fingerprints within RADIUS agree in some block up to RADIUS // BLOCKS bits; items are entered under all values
   that near, so equal joins on (size, block, value) miss no fingerprint within the radius.
3. Candidates are verified by the exact weighted Jaccard similarity of their shingles, sum of the lesser over sum of the
   greater counts, which must be at least THRESHOLD.

Null and empty texts and items have no words and match nothing. Items with the same id are each looked for; of repeated
rows and ids the best match counts, so there is one row for each doc_id and item_id. Rows with a null id are left out of
`scan`; `contaminated` names them by their text. Extra columns are not looked at; empty tables give no rows. Ties of
similarity go to the earliest window. Very long texts are read whole; only places go through joins until few texts are left.
The exact comparison of a window takes time in proportion to the square of the item's distinct shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, is_small, stored, version, words

SHINGLE = 5
THRESHOLD = 0.75
BITS = 64
#: At a similarity of 0.75 fingerprints differ in 11 bits on average, in more than 22 with a chance of about 1 in 10,000.
RADIUS = 22
BLOCKS = 8
#: Benchmark shingles that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Stands for a null doc_id, which would meet nothing in a join.
NULL_ID = -(1 << 63)


def shingles(w: Column) -> Column:
    """Hash of each five words in order; of all if there are fewer; none without words."""
    n = F.size(w)
    many = F.transform(F.slice(w, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def short_windows(w: Column, sizes: list[int]) -> Column:
    """pos, h: each window of each of the sizes (all under SHINGLE), hashed as shingles() hashes a text of that many words."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - n)
        all_ = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")).alias("h")))
        return F.when(F.size(w) > n, all_).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))

    return F.concat(*(of(n) for n in sizes))


def simhash(sh: Column) -> Column:
    """Bit b is set if more of the shingles (each as often as it occurs) have it than not."""
    zero = F.lit(0).cast("bigint")
    votes = lambda bit: F.aggregate(sh, F.lit(0), lambda a, h: a + F.when(h.bitwiseAND(bit) != 0, 1).otherwise(-1))
    bits = F.array(*(F.lit(1 << b if b < BITS - 1 else -(1 << b)).cast("bigint") for b in range(BITS)))
    return F.aggregate(bits, zero, lambda out, bit: out.bitwiseOR(F.when(votes(bit) > 0, bit).otherwise(zero)))


def _counts(sh: Column) -> Column:
    """Distinct shingles with how often each occurs; windows are short, so this is done in place."""
    return F.transform(F.array_distinct(sh), lambda h: F.struct(h.alias("h"), F.size(F.filter(sh, lambda x: x == h)).alias("n")))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles: equal ones paired off over all there are."""
    both = F.aggregate(_counts(a), F.lit(0), lambda s, x: s + F.least(x["n"], F.size(F.filter(b, lambda y: y == x["h"]))))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def _near() -> list[int]:
    """Differences of a block up to RADIUS // BLOCKS bits, as masks."""
    width = BITS // BLOCKS
    return [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), k)]


def _blocks(fp: Column) -> Column:
    width = BITS // BLOCKS
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k in range(BLOCKS)))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), sh (shingles), fp."""
    df = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w"))
    df = df.where(F.col("item_id").isNotNull() & (F.size("w") > 0)).select("item_id", F.size("w").alias("n"), shingles(F.col("w")).alias("sh"))
    return df.dropDuplicates(["item_id", "n", "sh"]).withColumn("fp", simhash(F.col("sh")))


#: What tells documents apart: rows that repeat an id may have different texts.
KEY = ["doc_id", "version"]


def _texts(docs: DataFrame) -> DataFrame:
    return documents(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), version(F.col("text")).alias("version"), words(ascii_lower(F.col("text"))).alias("w"))


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """doc_id (NULL_ID for a null), version, item_id, n, start, similarity of the windows that are similar to an item."""
    it = stored(items(benchmark))
    probes = it.select("n", F.posexplode("sh").alias("item_pos", "h")).distinct()
    if is_small(probes, BROADCAST_ROWS):
        probes = F.broadcast(probes)
    df = _texts(docs)
    # positions alone go through the join, never texts
    found = df.select(*KEY, F.size("w").alias("size"), F.posexplode(shingles(F.col("w"))).alias("pos", "h"))
    hits = found.join(probes, "h")
    sizes = sorted(x["n"] for x in it.where(F.col("n") < SHINGLE).select("n").distinct().collect())
    if sizes:  # four at most
        short = df.select(*KEY, F.size("w").alias("size"), F.explode(short_windows(F.col("w"), sizes)).alias("x")).select(*KEY, "size", "x.pos", "x.h")
        hits = hits.unionByName(short.join(probes.where(F.col("n") < SHINGLE), "h").select(*hits.columns))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("item_pos"), F.col("size") - F.col("n")))
    starts = hits.select(*KEY, "n", start.alias("start")).distinct().groupBy(*KEY).agg(F.collect_list(F.struct("n", "start")).alias("at"))
    at = stored(starts)
    held = at.select(*KEY)
    if is_small(held, BROADCAST_ROWS):
        held = F.broadcast(held)
    some = df.join(held, KEY, "left_semi").dropDuplicates(KEY)
    windows = some.join(at, KEY).select(*KEY, "w", F.explode("at").alias("x")).select(*KEY, "x.n", "x.start", F.expr("slice(w, x.start + 1, x.n)").alias("w"))
    windows = windows.select(*KEY, "n", "start", shingles(F.col("w")).alias("sh")).withColumn("fp", simhash(F.col("sh")))
    return _verified(stored(windows), it, threshold)


def _verified(windows: DataFrame, it: DataFrame, threshold: float) -> DataFrame:
    keys = it.select("item_id", "n", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select("item_id", "n", F.col("fp").alias("item_fp"), "b.block", "b.value")
    keys = keys.select("item_id", "n", "item_fp", "block", F.explode(F.array(*map(F.lit, _near()))).alias("mask"), "value").select("item_id", "n", "item_fp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    if is_small(keys, BROADCAST_ROWS):
        keys = F.broadcast(keys)
    probe = windows.select(*KEY, "n", "start", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select(*KEY, "n", "start", "fp", "b.block", "b.value")
    near = probe.join(keys, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select(*KEY, "n", "start", "item_id").distinct()
    pairs = near.join(windows, [*KEY, "n", "start"]).join(it.select("item_id", "n", F.col("sh").alias("item_sh")), ["item_id", "n"])
    return pairs.withColumn("similarity", similarity(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= threshold).select(*KEY, "item_id", "n", "start", "similarity")


def scan(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (of the best window, in words), n_words, similarity: every match."""
    pairs = _matches(docs.where("doc_id IS NOT NULL"), benchmark, threshold)
    best = F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", (-F.col("start")).alias("x"), "n")).alias("m")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("m.start").cast("long").alias("start"), F.col("m.n").cast("long").alias("n_words"), F.round("m.similarity", 6).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and version (of the text) of documents that hold a benchmark item."""
    return _matches(docs, benchmark, threshold).select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "version").distinct()

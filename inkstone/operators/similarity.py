"""Similarity join by edit distance: pairs of texts whose distance is below a share of the longer one's length.

A pair of lengths l <= L is allowed d = ceil(share * L) - 1 edits. If the shorter text is cut into d + 1 pieces, one of them is left as
it is, so it stands in the longer text: piece i at its own place moved by i at most, and, seen from the end, by d - i at most, counted from
the place moved by L - l. So every text is entered under its pieces, for each d that a longer partner may have, and every
text asks for the stretches of its own that could be a shorter text's piece: an equal join on (l, d, i, stretch) within the group,
which finds every pair. What it finds is compared by its edit distance. The number of entries of a text grows with the cube of its
length, not with the number of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edits(length: Column, share: float) -> Column:
    return (F.ceil(F.round(length * share, 9)) - 1).cast("int")


def _span(low: Column, high: Column) -> Column:
    """low to high, or nothing."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _key(group: list[str], l: Column, d: Column, i: Column, stretch: Column) -> Column:  # noqa: E741
    return F.xxhash64(*group, l, d, i, stretch)


def _piece(l: Column, d: Column, i: Column) -> tuple[Column, Column]:  # noqa: E741
    """Where piece i of d + 1 begins, and its length."""
    at = lambda k: F.floor(k * l / (d + 1)).cast("int")
    return at(i), at(i + 1) - at(i)


def entries(texts: DataFrame, group: list[str], share: float) -> DataFrame:
    """texts and key, a row for each piece under each number of edits that a partner at least as long may have."""
    n = F.length("text")
    # the longest partner has fewer than n / (1 - share) characters
    most = _edits(F.ceil(F.round(n / (1 - share), 9)).cast("int"), share)
    d = F.explode(_span(F.greatest(_edits(n, share), F.lit(0)), F.greatest(most, F.lit(0))))
    own = texts.withColumn("l", n).withColumn("d", d).where("l > d").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    at, size = _piece(F.col("l"), F.col("d"), F.col("i"))
    return own.withColumn("key", _key(group, F.col("l"), F.col("d"), F.col("i"), F.substr(F.col("text"), at + 1, size))).drop("l", "d", "i")


def probes(texts: DataFrame, group: list[str], share: float) -> DataFrame:
    """texts and key, a row for each stretch that could be a piece of a text at most as long."""
    n, d = F.col("n"), F.col("d")
    own = texts.withColumn("n", F.length("text")).withColumn("d", F.greatest(_edits(n, share), F.lit(0)))
    own = own.withColumn("l", F.explode(_span(n - d, n))).where("l > d").withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    at, size = _piece(F.col("l"), d, F.col("i"))
    moved, i = n - F.col("l"), F.col("i")
    low, high = F.greatest(F.lit(0), at - i, at + moved - (d - i)), F.least(n - size, at + i, at + moved + (d - i))
    own = own.withColumn("size", size).withColumn("at", F.explode(_span(low.cast("int"), high.cast("int"))))
    own = own.withColumn("key", _key(group, F.col("l"), d, i, F.substr(F.col("text"), F.col("at") + 1, F.col("size"))))
    return own.drop("n", "d", "l", "i", "size", "at")


def candidates(texts: DataFrame, group: list[str], share: float = 0.3) -> DataFrame:
    """group, u, a, v, b: pairs of different texts that share a piece, the one with the larger (length, text) first; a pair may stand several times.

    texts: id, text and the group's columns, each text once in a group. Rows with a null text or group are left out."""
    texts = texts.select(*group, "id", "text").dropna(subset=[*group, "text"])
    left = probes(texts, group, share).select("key", *group, F.col("id").alias("u"), F.col("text").alias("a"))
    right = entries(texts, group, share).select("key", *(F.col(g).alias(f"{g}_") for g in group), F.col("id").alias("v"), F.col("text").alias("b"))
    ahead = (F.length("b") < F.length("a")) | ((F.length("b") == F.length("a")) & (F.col("b") < F.col("a")))
    same = [F.col(g) == F.col(f"{g}_") for g in group]
    out = left.join(right, "key").where(ahead)
    for x in same:
        out = out.where(x)
    return out.select(*group, "u", "a", "v", "b")


def near(texts: DataFrame, group: list[str], share: float = 0.3) -> DataFrame:
    """group, u, a, v, b: the pairs of different texts of a group whose edit distance is below share of the longer one's length."""
    most = _edits(F.length("a"), share)
    found = candidates(texts, group, share)
    return found.where((most > 0) & (F.levenshtein("a", "b") <= most)).distinct()

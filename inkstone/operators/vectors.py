"""Nearest vectors, exactly or through a stored index of cells.

The index is an inverted file: k-means centres, fitted on a bounded sample (about SAMPLE vectors, taken by the hash of their ids),
cut space into cells; every vector is assigned to its nearest centre and written under its cell. A query reads the cells whose
centres are nearest to it; with all cells, or without an index, the result is exact.

Queries meet vectors by an equal join on (slice, block): cells are packed into slices of at most SLICE rows (a larger cell is dealt
over several), and the queries that read a slice into blocks of about BLOCK. A query goes to a slice once, however many of its cells it
reads there, and of a slice only its best k rows leave the task; no pair is emitted. So what is moved grows with the queries times the
slices that they read, not the cells; neither a hot cell nor many queries make a large task.

Scores are inner products rounded to six places; ties go to the smaller id. A null vector or id is left out; repeated ids are vectors
of their own; no queries or no vectors give no rows. Ids are numbers; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, about, and centres, at most.
SAMPLE, MOST_CELLS = 50_000, 2048
#: Vectors that are asked for to measure how many cells are needed.
TRIED = 256
#: Vectors of a slice at most (a SPREAD-th of all where that is less, yet no fewer than LEAST), queries of a block, about, and scores that a task holds at a time.
SLICE, SPREAD, LEAST, BLOCK, SCORES = 16384, 16, 2048, 8192, 1 << 22


def centres(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres of cells, a row each; as many as the root of the number of vectors, if not told. vectors: id, v."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    k = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    own = vectors.where("id IS NOT NULL AND v IS NOT NULL")
    if k < 2 or n < 2:
        return np.zeros((1, len((own.first() or {"v": [0.0]})["v"])))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / n)))
    # several tasks, whose rows depend on the ids alone
    own = own.where(share).repartition(SPREAD, "id").sortWithinPartitions("id")
    rows = own.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    out = np.asarray(KMeans(k=k, seed=seed, maxIter=15).fit(rows).clusterCenters())
    # near cells get near numbers, so that they lie in one slice
    return out[np.argsort((out - out.mean(0)) @ np.linalg.svd(out - out.mean(0), full_matrices=False)[2][0], kind="stable")]


def _by_cell(rows: DataFrame, vector: str, near: np.ndarray, probes: int) -> DataFrame:
    """rows with the cells of their `probes` nearest centres, a row each."""
    half = (near**2).sum(1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                far = half - np.stack(pdf[vector].to_list()).astype(float) @ near.T
                pdf["cell"] = list(np.argsort(far, axis=1, kind="stable")[:, :probes])
                yield pdf

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kind}, cell array<int>").select(*rows.columns, F.posexplode("cell").alias("rank", "cell"))


def build(vectors: DataFrame, path: str, cells: int | None = None, wanted: float = 0.95, k: int = 8) -> int:
    """Writes the index of vectors (id, v) to a folder: centres, the vectors under their cells, and how many cells a query has to read
    to find the `wanted` share of its k nearest, which is measured on TRIED of the vectors. Large cells are split over several files."""
    spark, near = vectors.sparkSession, centres(vectors, cells)
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(near)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    own = _by_cell(vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v"), "v", near, 1).drop("rank")
    own.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    probes = _probes_for(spark, path, near, wanted, k)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return probes


def _probes_for(spark: SparkSession, path: str, near: np.ndarray, wanted: float, k: int) -> int:
    """The least number of cells in which the wanted share of the sample's exact neighbours lies, by the cells' order for each query."""
    held = spark.read.parquet(f"{path}/vectors")
    asked = held.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIED).select(F.col("id").alias("query"), F.col("v").alias("q")).dropDuplicates(["query"])
    exact = search(asked, path, k + 1, len(near)).where("id <> query")
    order = _by_cell(asked, "q", near, len(near)).select("query", "rank", "cell")
    ranks = exact.join(held.select("id", "cell"), "id").join(order, ["query", "cell"]).groupBy("rank").count().orderBy("rank").collect()  # a row a cell at most
    need, got = wanted * sum(r["count"] for r in ranks), 0
    for r in ranks:
        got += r["count"]
        if got >= need:
            return r["rank"] + 1
    return len(near)


def _places(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each cell (by its number) the first of its slices and how many it has; none where it holds no vector."""
    sizes = {r["cell"]: r["count"] for r in vectors.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
    most = min(SLICE, max(LEAST, -(-sum(sizes.values()) // SPREAD)))
    first, parts, at, held = np.zeros(max(sizes, default=-1) + 1, int), np.zeros(max(sizes, default=-1) + 1, int), 0, 0
    for cell, n in sorted(sizes.items()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[cell], parts[cell] = at, -(-n // most)
        at, held = (at + parts[cell], 0) if n > most else (at, held + n)
    return first, parts


def _asked(queries: DataFrame, near: np.ndarray | None, probes: int, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """query, q, slice, cells: a row for each slice that holds cells among the `probes` nearest of a query, with these; all cells (near is None) are an empty list."""
    half = None if near is None else (near**2).sum(1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[i : i + 1024] for b in batches for i in range(0, len(b), 1024)):
            n = len(pdf)
            if near is None:
                slices = np.arange((first + parts).max(initial=0))
                row, at, cells = np.repeat(np.arange(n), len(slices)), np.tile(slices, n), [[]] * (n * len(slices))
            else:
                order = np.argsort(half - np.stack(pdf["q"].to_list()).astype(float) @ near.T, axis=1, kind="stable")[:, :probes]
                row, cell = np.repeat(np.arange(n), order.shape[1]), order.ravel()
                there = cell < len(parts)
                row, cell = row[there], cell[there]
                times = parts[cell]
                row, cell, nth = np.repeat(row, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                at = first[cell] + nth
                by = np.lexsort((cell, at, row))
                row, cell, at = row[by], cell[by], at[by]
                new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
                row, at, cells = row[new], at[new], np.split(cell, new[1:]) if len(new) else []
            yield pd.DataFrame({"query": pdf["query"].to_numpy()[row], "q": pdf["q"].to_numpy()[row], "slice": at, "cells": cells})

    kind = dict(queries.dtypes)
    return queries.select("query", "q").mapInPandas(run, f"query {kind['query']}, q {kind['q']}, slice int, cells array<int>")


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's best k; of equal ones the first columns."""
    if k >= scores.shape[1]:
        return np.nonzero(~np.isnan(scores))
    row, col = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k, None])
    return _first(row, col, scores[row, col], col, k)


def _first(row: np.ndarray, col: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((tie, -score, row))
    row, col = row[by], col[by]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _best(queries: DataFrame, vectors: DataFrame, k: int, near: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """query, id, score: the best k of the vectors (cell, id, v) in the `probes` nearest cells of a query (query, q), or in all of them."""
    spark = queries.sparkSession
    first, parts = _places(vectors)
    asked = _asked(queries, near, probes, first, parts)
    if near is None:
        n = queries.count()
        counts = [(i, n) for i in range(int((first + parts).max(initial=0)))]
    else:
        counts = [(r["slice"], r["count"]) for r in asked.groupBy("slice").count().collect()]  # as many as slices
    # small lists: a row for each cell, and for each slice that is asked for
    place = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(parts)) if parts[c]], "cell int, first int, parts int"))
    blocks = F.broadcast(spark.createDataFrame([(i, -(-n // BLOCK)) for i, n in counts if n], "slice int, blocks int"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asked.join(blocks, "slice").select("query", "q", "slice", "cells", dealt("query", "blocks").alias("block"))
    right = vectors.join(place, "cell").select("id", "v", "cell", (F.col("first") + dealt("id", "parts")).alias("slice")).join(blocks, "slice")
    right = right.select("id", "v", "cell", "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    keys = ["slice", "block"]

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        v = v.sort_values("id", kind="stable")
        ids, cell, own = v["id"].to_numpy(), v["cell"].to_numpy(), np.stack(v["v"].to_list()).astype(float)
        asks, lists = np.stack(q["q"].to_list()).astype(float), q["cells"].to_list()
        # which queries read which vectors: all of a slice's, or those of a cell
        if any(len(c) for c in lists):
            who, what = np.repeat(np.arange(len(q)), [len(c) for c in lists]), np.concatenate(lists)
            pairs = [(who[what == c], np.flatnonzero(cell == c)) for c in np.unique(what)]
        else:
            pairs = [(np.arange(len(q)), np.arange(len(v)))]
        row, col, got = [], [], []
        for rows, cols in pairs:
            step = max(1, SCORES // max(1, len(cols)))
            for i in range(0, len(rows) if len(cols) else 0, step):
                scores = np.round(asks[rows[i : i + step]] @ own[cols].T, 6)
                r, c = _top(scores, k)
                row.append(rows[i : i + step][r])
                col.append(cols[c])
                got.append(scores[r, c])
        if not row:
            return pd.DataFrame({"query": [], "id": [], "score": []})
        row, col, got = np.concatenate(row), np.concatenate(col), np.concatenate(got)
        row, at = _first(row, np.arange(len(row)), got, col, k)
        return pd.DataFrame({"query": q["query"].to_numpy()[row], "id": ids[col[at]], "score": got[at]})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("score", F.round("score", 6)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def search(queries: DataFrame, path: str, k: int = 8, probes: int | None = None) -> DataFrame:
    """query, id, score: the best k of an index's vectors for each query (query, q), among those of its `probes` nearest cells, if not told as many as were found to be needed; exact with all cells (probes=0)."""
    spark: SparkSession = queries.sparkSession
    near = np.asarray([r["v"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # MOST_CELLS rows at most
    if probes is None:
        probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    own = queries.where("query IS NOT NULL AND q IS NOT NULL").select("query", "q")
    return _best(own, spark.read.parquet(f"{path}/vectors"), k, near if 0 < probes < len(near) else None, probes)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 8) -> DataFrame:
    """query, id, score: the best k of vectors (id, v) for each query (query, q), by comparing all."""
    # one cell, by a term that the optimiser does not take for a constant: it would make the equal join a nested loop
    one = F.pmod(F.xxhash64("id"), F.lit(1)).cast("int").alias("cell")
    return _best(queries.where("query IS NOT NULL AND q IS NOT NULL").select("query", "q"), vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v", one), k)


def without(found: DataFrame, skip: DataFrame | None = None, keep: int = 3) -> DataFrame:
    """query, id, score: of what was found, what is neither the query itself nor in skip (query, id), at most keep for each query."""
    found = found.where("id <> query")
    if skip is not None:
        found = found.join(skip.select("query", "id"), ["query", "id"], "left_anti")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select("query", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query, hits, of: how many of a query's exact neighbours (query, id) were found."""
    hit = exact.select("query", "id").distinct().join(found.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left")
    return hit.groupBy("query").agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.count(F.lit(1)).alias("of"))

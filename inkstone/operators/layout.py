"""A map of vectors in two dimensions in which near ones lie together: a graph of nearest neighbours, laid out by forces.

Neighbours by cosine come from the vector index (`vectors`). Their distances become memberships (McInnes, Healy and Melville 2018): the nearest
one counts in full, the rest fall off at a rate by which a point's weights sum to log2 of their number; the two directions of an edge are united
as a + b - ab. The map starts from two principal components. In each round edges pull their ends together
and points push one another away within random blocks of about BLOCK points, new ones each round, which stand
for all others; steps shrink to nothing. Positions are written each round, so a lost executor costs one round; those of the round before go.

Edges are dealt into pieces by their first end once and stay there, in memory or on the executors' disks. A round ships positions alone: each
to the pieces that hold one of its edges, once however many they hold. Points that lie together in space are dealt into one piece as far as the index's cells
tell, so most neighbours are at hand. A piece has about PIECE points; one of a point with very many edges is larger by these.

Vectors are rows (id: long, v); null ids and vectors are left out, vectors without length lie near nothing in particular, repeated
ids must not be given. Fewer than two vectors give no rows. Blocks, samples and start depend on ids and seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import vectors as index
from .graph import dropped, element_max, project, scratch

#: Neighbours of a point, rounds, points of a block, first step, points of a piece of the graph.
NEIGHBOURS, ROUNDS, BLOCK, STEP, PIECE = 15, 40, 512, 0.3, 8192
#: The curve 1 / (1 + A d^2B) of similarity in the map for a least distance of 0.1 and a spread of 1.
A, B = 1.577, 0.895


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, path: str | None = None) -> DataFrame:
    """u, v, w: each edge in both directions with its weight above 0 to 1. The index of the vectors goes to path."""
    own = vectors.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    path = path or scratch(vectors.sparkSession)
    index.build(own.mapInPandas(_unit, "id long, v array<double>"), path, k=k)
    held = vectors.sparkSession.read.parquet(f"{path}/vectors")
    found = index.without(index.search(held.select(F.col("id").alias("query"), F.col("v").alias("q")), path, k + 1), keep=k)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.greatest(1 - F.col("score"), F.lit(0.0)).alias("d"), "id"))).alias("near"))
    weights = lists.select("query", F.col("near.id").alias("ids"), _memberships(F.col("near.d")).alias("ws"))
    one = weights.select("query", F.explode(F.arrays_zip("ids", "ws")).alias("x")).select(F.col("query").alias("u"), F.col("x.ids").alias("v"), F.col("x.ws").alias("w"))
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    # an edge has one or two weights; of one, the other is 0
    return both.groupBy("u", "v").agg((F.lit(1.0) - F.product(1 - F.col("w"))).alias("w")).where("w > 0")


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors of length 1; those without length stay."""
    for pdf in batches:
        if len(pdf):
            v = np.stack(pdf["v"].to_list())
            yield pdf.assign(v=list(v / np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-12)))


@F.pandas_udf(ArrayType(DoubleType()))
def _memberships(distances: pd.Series) -> pd.Series:
    """Weights of distances in ascending order."""
    sizes, out = distances.map(len), pd.Series([None] * len(distances), index=distances.index, dtype=object)
    for n in sizes.unique():
        at = sizes.index[sizes == n]
        d = np.stack(distances[at].to_list()).astype(float)
        over = np.maximum(d - d[:, :1], 0.0)
        low, high, goal = np.zeros(len(d)), np.maximum(1.0, over[:, -1] * 1e3), np.log2(max(2, n))
        for _ in range(64):
            rate = (low + high) / 2
            more = np.exp(-over / np.maximum(rate, 1e-12)[:, None]).sum(1) > goal
            low, high = np.where(more, low, rate), np.where(more, rate, high)
        out[at] = list(np.exp(-over / np.maximum(high, 1e-3 * np.maximum(d.mean(1), 1e-9))[:, None]))
    return out


def _push(points: pd.DataFrame) -> pd.DataFrame:
    """The mean push on each point of a block by the others."""
    at = points[["x", "y"]].to_numpy()
    apart = at[:, None, :] - at[None, :, :]
    d2 = (apart**2).sum(2)
    force = 2 * B / ((0.001 + d2) * (1 + A * d2**B))
    np.fill_diagonal(force, 0.0)
    mean = np.clip(force[:, :, None] * apart, -4, 4).sum(1) / max(1, len(at) - 1)
    return pd.DataFrame({"id": points["id"], "px": mean[:, 0], "py": mean[:, 1]})


def _pull(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The mean pull on each first end of a piece's edges (u, vs, ws)."""
    if not len(edges):
        return pd.DataFrame({"id": [], "ax": [], "ay": []})
    points, edges = points.sort_values("id"), edges.sort_values("u")
    ids, at = points["id"].to_numpy(), points[["x", "y"]].to_numpy()
    u, many = edges["u"].to_numpy(), edges["vs"].map(len).to_numpy()
    w = np.concatenate(edges["ws"].to_list())
    apart = np.repeat(at[np.searchsorted(ids, u)], many, axis=0) - at[np.searchsorted(ids, np.concatenate(edges["vs"].to_list()))]
    d2 = (apart**2).sum(1)
    some = np.maximum(d2, np.finfo(float).tiny)
    force = np.where(d2 > 0, -2 * A * B * some ** (B - 1) / (1 + A * some**B), 0.0)
    starts = np.cumsum(many) - many
    total = np.add.reduceat(w[:, None] * np.clip(force[:, None] * apart, -4, 4), starts, axis=0) / np.add.reduceat(w, starts)[:, None]
    return pd.DataFrame({"id": u, "ax": total[:, 0], "ay": total[:, 1]})


def layout(start: DataFrame, edges: DataFrame, rounds: int = ROUNDS, seed: int = 42, places: DataFrame | None = None) -> DataFrame:
    """id, x, y after rounds of pulls and pushes, from start (id, x, y) and edges (u, v, w).

    places (id, place) says which points lie together: equal or near numbers do. Without it points are dealt by hash."""
    spark, path = start.sparkSession, scratch(start.sparkSession)
    size = start.agg(F.count(F.lit(1)).alias("n"), *(F.max(F.abs(F.col(c))).alias(c) for c in "xy")).first()
    wide = 10 / max(size["x"] or 0, size["y"] or 0, 1e-12)
    blocks, pieces = max(1, round(size["n"] / BLOCK)), max(1, -(-size["n"] // PIECE))
    dealt = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(pieces)).cast("int").alias("piece")
    if places is None:
        own = start.select("id", dealt)
    else:
        own = places.join(F.broadcast(_pieces(places)), "place").select("id", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))).cast("int").alias("piece"))
        pieces = own.agg(F.max("piece")).first()[0] + 1
    own.write.parquet(f"{path}/pieces")
    own = spark.read.parquet(f"{path}/pieces")
    lists = edges.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("x")).select("u", F.col("x.v").alias("vs"), F.col("x.w").alias("ws"))
    lists.join(own.withColumnRenamed("id", "u"), "u").write.parquet(f"{path}/edges")
    lists = spark.read.parquet(f"{path}/edges").repartition(pieces, "piece").persist(StorageLevel.MEMORY_AND_DISK)
    # where a point's position goes: the pieces of its edges, which are there in both directions
    wanted = lists.select("piece", F.explode("vs").alias("id")).unionByName(lists.select("piece", F.col("u").alias("id"))).groupBy("id").agg(F.collect_set("piece").alias("to"))
    # no two points in one place: a push has no direction there
    jitter = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(10007)) / 1e5
    first = start.select("id", (F.col("x") * wide + jitter(1)).alias("x"), (F.col("y") * wide + jitter(2)).alias("y"))
    first.join(wanted, "id", "left").write.parquet(f"{path}/0")
    for r in range(rounds):
        at = spark.read.parquet(f"{path}/{r}")
        sent = at.select(F.explode("to").alias("piece"), "id", "x", "y").repartition(pieces, "piece")
        pull = sent.groupBy("piece").cogroup(lists.groupBy("piece")).applyInPandas(_pull, "id long, ax double, ay double")
        push = at.select("id", "x", "y").groupBy(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(blocks))).applyInPandas(_push, "id long, px double, py double")
        step = STEP * (1 - r / rounds)
        # an edge pulls at both ends when drawn, and each draw comes with five pushes
        moved = lambda c: (F.col(c) + step * (2 * F.coalesce(f"a{c}", F.lit(0.0)) + 5 * F.coalesce(f"p{c}", F.lit(0.0)))).alias(c)  # noqa: E731, B023
        at.join(pull, "id", "left").join(push, "id", "left").select("id", moved("x"), moved("y"), "to").write.parquet(f"{path}/{r + 1}")
        dropped(spark, f"{path}/{r}")
    lists.unpersist()
    return spark.read.parquet(f"{path}/{rounds}").select("id", "x", "y")


def _pieces(places: DataFrame) -> DataFrame:
    """place, first, parts: neighbouring places packed into pieces of PIECE points, a larger place over several. places are cells of an index."""
    sizes = places.groupBy("place").count().orderBy("place").collect()  # as many as cells
    rows, at, held = [], 0, 0
    for p in sizes:
        if held and held + p["count"] > PIECE:
            at, held = at + 1, 0
        parts = -(-p["count"] // PIECE)
        rows.append((p["place"], at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + p["count"])
    return places.sparkSession.createDataFrame(rows, "place int, first int, parts int")


def neighbour_map(vectors: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """id, x, y."""
    own = vectors.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v")
    # read several times: the start, the fit of the centres, the index
    own.write.parquet(held := scratch(vectors.sparkSession))
    own = vectors.sparkSession.read.parquet(held)
    if own.limit(2).count() < 2:
        return own.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    edges = neighbours(own, k, path := scratch(vectors.sparkSession))
    return layout(project(own), edges, rounds, seed, vectors.sparkSession.read.parquet(f"{path}/vectors").select("id", F.col("cell").alias("place")))


def library_map(chunks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind (chunk or document), id, x, y: one map of passages (doc, chunk, v) and of documents, as the greatest values of their passages."""
    best = element_max(chunks.where("doc IS NOT NULL AND v IS NOT NULL"), "doc")
    whole = best.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"].cast("double")).alias("v"))
    # chunks at even numbers, documents at odd ones
    parts = chunks.select((F.col("chunk").cast("long") * 2).alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    out = neighbour_map(parts.unionByName(whole.select((F.col("doc").cast("long") * 2 + 1).alias("id"), "v")), rounds=rounds)
    odd = F.pmod("id", F.lit(2)) == 1
    return out.select(F.when(odd, "document").otherwise("chunk").alias("kind"), F.floor(F.col("id") / 2).alias("id"), "x", "y")

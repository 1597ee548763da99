"""Merkle dataset manifest (operator 13).

Every row is a leaf of its group's tree, every group's root a leaf of one tree above; 16 nodes make one. A manifest needs the
siblings of each leaf on all levels up to the root, and no task may hold a whole group, so:

1. Leaves are sorted by group and id once, over all tasks; counts by task and group tell each leaf its place.
2. Places are cut into aligned blocks of 256 leaves, two levels of the tree. A treehash stack, which holds the open run of each
   level and no more, makes a block's root; the roots are cut into blocks again, until each group has one (`climb`).
3. Downwards (`descend`), a block learns the path of its root, shared by all below it, and its own paths are scheduled leaf by leaf
   (`paths`): on each level a treehash stack builds the run to come from leaves ahead of the present one, one leaf a step, so that
   it is ready when the present run ends; what is in memory are two runs a level. A leaf's path is the block's, then the shared one.
4. Each leaf as it is found later is folded with its siblings up to a root of its own, and verified if that is the manifest's.

Null values are `-`, apart from the string `-`, which carries its length; leaves of a group ascend by id, null ids first, then by digest, so
rows that repeat an id have places of their own and repeated rows equal ones side by side. A null group comes first. An empty
table gives none; extra columns are not looked at. A text takes memory in proportion to its own length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Nodes that make one, levels of a block, leaves of a block.
ARITY, LEVELS = 16, 2
BLOCK = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Makes the nodes of a level from leaves handed in one by one; holds the open run of each level below."""

    def __init__(self, level: int) -> None:
        self.open: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def push(self, node: str, level: int = 0) -> None:
        for run in self.open[level:]:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest(run)
            run.clear()
        self.nodes.append(node)

    def close(self) -> None:
        """No more leaves: runs that are not full become nodes as they are."""
        for level, run in enumerate(self.open):
            if run:
                node = digest(run)
                run.clear()
                self.push(node, level + 1)

    def take(self) -> list[str]:
        out, self.nodes = self.nodes, []
        return out


def levels(total: int) -> int:
    """Levels that a block has in a tree of so many leaves: a lone leaf stays as it is."""
    return 0 if total == 1 else 1 if total <= ARITY else LEVELS


def root(leaves: Sequence[str], height: int) -> str:
    stack = Treehash(height)
    for leaf in leaves:
        stack.push(leaf)
    stack.close()
    return stack.nodes[0]


def paths(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf, what stands left and right of its node in its run, level by level; digests joined."""
    spans = [ARITY ** (h + 1) for h in range(height)]
    coming, now = [Treehash(h) for h in range(height)], [[] for _ in range(height)]
    for stack, span in zip(coming, spans, strict=True):
        for leaf in leaves[:span]:
            stack.push(leaf)
    for i in range(len(leaves)):
        for h, span in enumerate(spans):
            if i % span == 0:
                if i + span >= len(leaves):
                    coming[h].close()
                now[h] = coming[h].take()
            if i + span < len(leaves):
                coming[h].push(leaves[i + span])
        at = [i // ARITY**h % ARITY for h in range(height)]
        yield [("".join(run[:k]), "".join(run[k + 1 :])) for run, k in zip(now, at, strict=True)]


def part(c: Column) -> Column:
    """A value with its length in bytes, so that no two rows give the same leaf."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(part(c) for c in columns)), 256)


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with their place in their group and the group's total. A global sort deals hot groups out over many tasks."""
    task = F.shiftright("at", 33)
    # the number holds the task and the place in it; what is written keeps it whatever is read how
    rows = stored(nodes.orderBy("group", *order).withColumn("at", F.monotonically_increasing_id()))
    own = rows.groupBy("group", task.alias("task")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("group", "task", (before - F.col("low")).alias("shift"), F.sum("n").over(group).alias("total"))
    return rows.withColumn("task", task).join(own, ["group", "task"]).withColumn("place", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """group, block, total, nodes: a row for each BLOCK places, in order."""
    rest = [c for c in nodes.columns if c not in ("group", "total", "place")]
    return nodes.groupBy("group", F.expr(f"place DIV {BLOCK}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", *rest))).alias("nodes"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and each group's root (group, digest). nodes: group, place, total, digest and others."""

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [root(own, levels(total)) for own, total in zip(pdf["digests"], pdf["total"], strict=True)]
            yield pd.DataFrame({"group": pdf["group"], "place": pdf["block"], "total": -(-pdf["total"] // BLOCK), "digest": made})

    tiers = []
    while True:
        tiers.append(stored(_blocks(nodes)))
        nodes = tiers[-1].select("group", "block", "total", F.col("nodes.digest").alias("digests")).mapInPandas(roots, "group string, place long, total long, digest string")
        if (tiers[-1].agg(F.max("total").alias("most")).first()["most"] or 0) <= BLOCK:
            return tiers, stored(nodes.select("group", "digest"))


_PATH = "lefts array<string>, rights array<string>"


def _each(pdf: pd.DataFrame) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Row, number of the node in it, and the node's whole path, for all nodes of some blocks with their roots' paths."""
    for row, (total, digests, lefts, rights) in enumerate(zip(pdf["total"], pdf["digests"], pdf["lefts"], pdf["rights"], strict=True)):
        for i, path in enumerate(paths(digests, levels(total))):
            yield row, i, [x for x, _ in path] + list(lefts), [y for _, y in path] + list(rights)


def descend(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest table of blocks with the path of each block's root (lefts, rights). top: group, lefts, rights of the groups' roots."""

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(pdf["group"].iloc[row], pdf["block"].iloc[row] * BLOCK + i, lefts, rights) for row, i, lefts, rights in _each(pdf)]
            yield pd.DataFrame(rows, columns=["group", "block", "lefts", "rights"])

    shared = top.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers[1:]):
        shared = _with_digests(tier.join(shared, ["group", "block"])).drop("nodes").mapInPandas(below, f"group string, block long, {_PATH}")
    return _with_digests(tiers[0].join(shared, ["group", "block"]))


def _with_digests(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("digests", F.col("nodes.digest"))


def named(blocks: DataFrame) -> DataFrame:
    """group, lefts, rights: the path of each node, by its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(pdf["names"].iloc[row][i], lefts, rights) for row, i, lefts, rights in _each(pdf)], columns=["group", "lefts", "rights"])

    return blocks.select("total", "digests", F.col("nodes.name").alias("names"), "lefts", "rights").mapInPandas(run, f"group string, {_PATH}")


def proved(blocks: DataFrame, with_paths: bool) -> DataFrame:
    """name, leaf, subroot, proof_sha256, folded_root and, if wanted, the path of each leaf; what is folded is `found`, or else the leaf."""
    extra = ["lefts", "rights"] if with_paths else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, own = [], {c: pdf[c].tolist() for c in ("names", "digests", "found", "subroot")}
            for row, i, lefts, rights in _each(pdf):
                proof = digest([x + y for x, y in zip(lefts, rights, strict=True)])
                node = own["found"][row][i] or own["digests"][row][i]
                for left, right in zip(lefts, rights, strict=True):
                    node = digest((left, node, right))
                rows.append((own["names"][row][i], own["digests"][row][i], own["subroot"][row], proof, node, *((lefts, rights) if with_paths else ())))
            yield pd.DataFrame(rows, columns=["name", "leaf", "subroot", "proof_sha256", "folded_root", *extra])

    rows = blocks.select("total", "digests", F.col("nodes.name").alias("names"), F.col("nodes.found").alias("found"), "subroot", "lefts", "rights")
    return rows.mapInPandas(run, "name string, leaf string, subroot string, proof_sha256 string, folded_root string" + f", {_PATH}" * with_paths)


def manifest(docs: DataFrame, seen: Column | None = None, with_paths: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with_paths: lefts and rights too, the siblings' digests level by level.

    seen: the text as it is found when the manifest is checked; the leaf made with it is folded. Without it, documents are as they were."""
    columns = {c: F.col(c) for c in COLUMNS}
    changed = F.lit(None).cast("string") if seen is None else F.when(~seen.eqNullSafe(F.col("text")), leaf([*(columns | {"text": seen}).values()]))
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = stored(docs.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf([*columns.values()]).alias("digest"), changed.alias("found")))
    sorted_leaves = placed(leaves, ["doc_id", "digest"])
    tiers, subroots = climb(sorted_leaves.select("group", "place", "total", "digest", "found", F.col("doc_id").cast("string").alias("name")))
    tops, top = climb(placed(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), ["name"]))
    root_ = (top.first() or {"digest": None})["digest"]
    none = F.array().cast("array<string>")
    upper = stored(named(descend(tops, top.select("group", none.alias("lefts"), none.alias("rights")))))
    out = proved(descend(tiers, upper).join(subroots.withColumnRenamed("digest", "subroot"), "group"), with_paths)
    whole = F.lit(root_).cast("string")
    return out.select(F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"), *(["lefts", "rights"] if with_paths else []))


def spoiled(docs: DataFrame, every: int = 5) -> Column:
    """The texts of documents whose id's checksum is divisible so, in lower case; a null id has none."""
    low = F.translate("text", UPPER, LOWER)
    return F.when(F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % every == 0, low).otherwise(F.col("text"))


def oracle(depth: int = 6) -> str:
    """DuckDB SQL for manifest() with spoiled() over the view documents, for sources of up to 16 ** depth rows."""
    own = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in (*COLUMNS[:-1], text)) + ")"
    bits = "list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    low = f"CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    ctes = [
        f"leaves AS (SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, doc_id, {own('text')} AS d, {own(f'({low})')} AS x FROM documents)",
        "s0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY g) AS m, doc_id, d, x FROM leaves)",
    ]

    def up(t: str) -> None:
        """Levels t1, t2, ... and their runs."""
        for k in range(depth):
            ctes.append(f"{t}r{k} AS (SELECT g, p // 16 AS r, max(m) AS m, list(d ORDER BY p) AS ds FROM {t}{k} GROUP BY 1, 2)")
            ctes.append(f"{t}{k + 1} AS (SELECT g, r AS p, CASE WHEN m = 1 THEN 1 ELSE (m + 15) // 16 END AS m, CASE WHEN m = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {t}r{k})")

    up("s")
    ctes.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS m, d, g AS name FROM s{depth})")
    up("t")
    ctes.append("f0 AS (SELECT s0.*, s0.p AS q, t0.p AS tp, t0.d AS sub, x AS f, '' AS proof FROM s0 JOIN t0 ON t0.name = s0.g)")
    at = 0
    for t, place, key in (("s", "q", "f.g"), ("t", "tp", "''")):
        for k in range(depth):
            left, right = f"array_to_string(ds[1:{place} % 16], '')", f"array_to_string(ds[{place} % 16 + 2:], '')"
            step = f"CASE WHEN r.m = 1 THEN f.f ELSE sha256({left} || f.f || {right}) END"
            side = f"f.proof || CASE WHEN r.m = 1 THEN '' ELSE {left} || {right} END"
            ctes.append(f"f{at + 1} AS (SELECT f.* REPLACE ({step} AS f, {side} AS proof, {place} // 16 AS {place}) FROM f{at} f JOIN {t}r{k} r ON r.g = {key} AND r.r = f.{place} // 16)")
            at += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, f.d AS leaf, sub AS subroot, t{depth}.d AS root, sha256(proof) AS proof_sha256, f.f AS folded_root, f.f = t{depth}.d AS verified FROM f{at} f, t{depth}"

"""Windows over ordered chunks, drafts, keyset pages, joins of few keys."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a dealt join: rows of a key that meet at one time, on either side; rows of the right in a line; rows that a task makes, about; how many
#: times a key's rows are written to the shuffle at most. Parquet packs values by 504, so that lines of as many repeat byte for byte.
DEALT, LINE, MADE, COPIES = 16_384, 504, 10_000_000, 4


def surrounding(df: DataFrame, group: str, order: str, content: str, low: int, high: int, name: str = "context", sep: str = "\n\n") -> DataFrame:
    """df with the contents whose order lies from low to high of a row's own, joined; empty if there is none."""
    w = Window.partitionBy(group).orderBy(order).rangeBetween(low, high)
    return df.withColumn(name, F.concat_ws(sep, F.collect_list(content).over(w)))


def sliding_windows(df: DataFrame, group: str, order: str, content: str, radius: int = 3, stride: int = 2) -> DataFrame:
    """Windows around every stride-th row by index: group, centre, first, last, text."""
    ix = Window.partitionBy(group).orderBy(order)
    around = ix.rowsBetween(-radius, radius)
    out = df.select(group, (F.row_number().over(ix) - 1).alias("centre"), F.first(order).over(around).alias("first"), F.last(order).over(around).alias("last"), F.concat_ws("\n", F.collect_list(content).over(around)).alias("text"))
    return out.where(F.col("centre") % stride == 0)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an order without ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def latest_draft(drafts: DataFrame) -> DataFrame:
    """For each chunk its draft with the greatest number, by partial aggregation and without a sort."""
    rest = [c for c in drafts.columns if c not in ("chunk", "draft_number")]
    m = F.max_by(F.struct("draft_number", *rest), "draft_number").alias("m")
    return drafts.groupBy("chunk").agg(m).select("chunk", "m.*")


def listed(df: DataFrame, key: list[str], order: str, value: str, name: str, sep: str = ",") -> DataFrame:
    """Values of a key in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), sep).alias(name))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return latest(df, key, [F.col(c) for c in order])


def save_draft(drafts: DataFrame, saves: DataFrame) -> DataFrame:
    """chunk, draft_number, content, is_new: a save opens a draft if there is none or the last is a machine's, else it overwrites the last."""
    last = latest_draft(drafts.select("chunk", "draft_number", "translator"))
    machine = F.col("translator").startswith("ai:") | F.col("translator").startswith("mt:")
    new = F.col("draft_number").isNull() | machine
    return saves.join(last, "chunk", "left").select("chunk", F.when(new, F.coalesce(F.col("draft_number"), F.lit(0)) + 1).otherwise(F.col("draft_number")).alias("draft_number"), "content", new.alias("is_new"))


def page(df: DataFrame, date: str, ident: str, limit: object = 20, token: str | None = None) -> DataFrame:
    """One page, newest first, and one row more if another page follows. A token that cannot be read is an error."""
    n = max(1, min(100, int(limit)))
    if token is not None:
        at = json.loads(base64.b64decode(token, validate=True))
        d, i = F.lit(at["date"]).cast(dict(df.dtypes)[date]), F.lit(at["id"])
        df = df.where((F.col(date) < d) | ((F.col(date) == d) & (F.col(ident) < i)))
    return df.orderBy(F.desc(date), F.desc(ident)).limit(n + 1)


def page_token(date: str, ident: int) -> str:
    return base64.b64encode(json.dumps({"date": date, "id": ident}).encode()).decode()


def dealt_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on a key with few values, of which each has many rows on both sides, so that the result is far larger than its inputs.

    Each value's rows are dealt into groups on both sides, by a hash of the row, and each group of the left meets each of the
    right: no value is one task, memory is bounded by two groups, and there are as many tasks as the result's rows need. A row
    is written to the shuffle once for each group that it meets, so groups are larger, up to DEALT, where a value's rows would
    be written more than COPIES times. In a task the rows of the right form lines of LINE, and a line meets all rows of the left before
    the next one does: written by columns, the result repeats at short distances and takes little room. Rows with a null key go."""
    own_l, own_r = ([c for c in df.columns if c != key] for df in (left, right))
    n_l, n_r = F.col("_l"), F.col("_r")
    sizes = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(name))
    # g by h groups write l * h + r * g rows, which is 2 * sqrt(g * h * l * r) at the least
    pairs = F.least(n_l * n_r / MADE, (COPIES * (n_l + n_r) / 2) ** 2 / (n_l * n_r))
    both = sizes(left, "_l").join(sizes(right, "_r"), key)
    both = both.withColumn("_h", F.greatest(F.lit(1), F.round(F.sqrt(pairs * n_r / n_l)), F.ceil(n_r / DEALT)).cast("int"))
    both = both.withColumn("_g", F.ceil(F.greatest(pairs / F.col("_h"), n_l / DEALT)).cast("int"))
    made, units, keys = both.agg(F.sum(n_l * n_r), F.sum(F.col("_g").cast("long") * F.col("_h")), F.count(F.lit(1))).first()
    # a given number of tasks, as the bytes that go into them say nothing of the rows that come out
    tasks = max(1, min(2 * (units or 0), int(2 * (made or 0) // MADE)))
    groups = both.select(key, "_g", "_h", F.ceil(n_r / F.col("_h") / LINE).cast("int").alias("_lines"))
    groups = F.broadcast(groups) if keys <= DEALT else groups
    on = [key, "_i", "_j"]
    group = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a side without other columns keeps its key for one
    row = lambda own: F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(own or [key])))
    together = lambda df, own: df.repartition(tasks, *on).groupBy(*on, "_lines").agg(F.collect_list(row(own)).alias("_rows"))
    a = together(left.join(groups, key).select(*left.columns, group(left, "_g").alias("_i"), every("_h").alias("_j"), "_lines"), own_l)
    b = together(right.join(groups, key).select(*right.columns, group(right, "_h").alias("_j"), every("_g").alias("_i"), "_lines"), own_r)
    a = a.select(*on, "_rows", every("_lines").alias("_line")).select(*on, "_line", F.inline("_rows"))
    # the last line takes whatever is left, so that no row is without one
    length = lambda x, n: F.when(n < F.col("_lines") - 1, LINE).otherwise(F.size(x))
    lines = lambda x: F.transform(F.sequence(F.lit(0), F.col("_lines") - 1), lambda n: F.slice(x, n * LINE + 1, length(x, n)))
    b = b.select(*on, *(lines(F.col("_rows")[f"_{k}"]).alias(f"_r{k}") for k in range(max(1, len(own_r)))))
    met = a.hint("merge").join(b, on).select("*", F.posexplode(F.col("_r0")[F.col("_line")]).alias("_at", "_v"))
    value = lambda k: F.col(f"_r{k}")[F.col("_line")][F.col("_at")] if k else F.col("_v")
    return met.select(key, *(F.col(f"_{k}").alias(c) for k, c in enumerate(own_l)), *(value(k).alias(c) for k, c in enumerate(own_r)))

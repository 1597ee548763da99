"""Snapshots on disk, in buckets of keys, of which a refresh reads and rewrites only those that changed.

A snapshot is three tables below one folder, each partitioned by `bucket` (a hash of the key):

- `entries`: the key, the values, `written` (the epoch of the last insert or update) and `gone` (the epoch of the first refresh whose
  source no longer held the entry; null while it does). Nothing changes in the row of an entry that is merely seen again.
- `postings`: the key, `col`, `token` of the indexed values, sorted by token. A bucket without any has one row without a token.
- `digests`: for each bucket the number of its entries that are not gone and two hashes of their set. A bucket of a source with equal ones
  is taken as unchanged: two different buckets agree with a chance of about 2^-128.

Buckets are replaced by dynamic partition overwrite out of a staged table, postings before entries before digests: a refresh that is cut off
leaves digests that differ from the source's, and the same refresh run again ends in the same tables. Frames read from a snapshot before a
refresh must be read again after it. Keys are compared with null as a value; of rows that repeat a key the smallest values count; an
empty source marks all entries as gone (none is removed); columns besides key and values are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search
from .graph import scratch

CHANGES = ("insert", "update", "keep", "touch")


@dataclass(frozen=True)
class Snapshot:
    """Where a snapshot lies and what it holds. Choose buckets so that one is a few hundred MB at most; their number is fixed."""

    path: str
    key: tuple[str, ...]
    values: tuple[str, ...]
    indexed: tuple[str, ...] = ()
    buckets: int = 256

    def bucket(self) -> Column:
        # to_json keeps apart what a hash of columns, which passes over nulls, does not
        return F.pmod(F.xxhash64(F.to_json(F.struct(*self.key))), F.lit(self.buckets)).cast("int")

    def entries(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        df = spark.read.parquet(f"{self.path}/entries")
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def postings(self, spark: SparkSession) -> DataFrame:
        """key, col, token, bucket."""
        return spark.read.parquet(f"{self.path}/postings").where("token IS NOT NULL")

    def create(self, source: DataFrame, epoch: int = 1) -> None:
        """Writes a new snapshot; the folder must not hold one."""
        staged = self._staged(self._unique(source).withColumns({"written": F.lit(epoch), "gone": F.lit(None).cast("int"), "change": F.lit("insert")}))
        if self.indexed:
            self._replace(self._indexed(staged), "postings", ("token",))
        self._replace(staged.drop("change"), "entries", self.key)
        self._replace(_digests(staged, self), "digests", ())

    def refresh(self, source: DataFrame, epoch: int) -> DataFrame:
        """key, change of the entries in changed buckets: insert, update, keep (not in the source) or touch (as it was).

        All entries of other buckets are as they were and in the source; they are neither read nor listed."""
        new = self._unique(source)
        return self._merge(new, self._differing(_digests(new.withColumn("gone", F.lit(None).cast("int")), self)), epoch, True)

    def upsert(self, rows: DataFrame, epoch: int) -> DataFrame:
        """As refresh, for some entries only: those not among rows stay as they are. With a column seq the row with the largest counts."""
        if "seq" in rows.columns:
            kept = [c for c in (*self.key, *self.values)]
            rows = rows.groupBy(*(F.col(c).alias(c) for c in self.key)).agg(F.max_by(F.struct(*self.values), F.struct("seq", *self.values)).alias("x"))
            rows = rows.select(*self.key, *(F.col(f"x.`{c}`").alias(c) for c in kept if c not in self.key))
        new = self._unique(rows)
        # at most as many numbers as there are buckets
        return self._merge(new, [r["bucket"] for r in new.select("bucket").distinct().collect()], epoch, False)

    def _unique(self, source: DataFrame) -> DataFrame:
        """One row for each key: the smallest values, by partial aggregation."""
        one = source.groupBy(*self.key).agg(F.min(F.struct(*self.values)).alias("x"))
        return one.select(*self.key, *(F.col(f"x.`{c}`").alias(c) for c in self.values), self.bucket().alias("bucket"))

    def _differing(self, incoming: DataFrame) -> list[int]:
        """Buckets whose digests differ between the snapshot and a source; at most as many numbers as there are buckets."""
        stored = incoming.sparkSession.read.parquet(f"{self.path}/digests").select("bucket", "n", "a", "b")
        none = {"n": 0, "a": 0, "b": 0}
        both = incoming.select("bucket", F.struct("n", "a", "b").alias("x")).join(stored.select("bucket", F.struct("n", "a", "b").alias("y")), "bucket", "full_outer")
        zero = lambda c: F.struct(*(F.coalesce(F.col(f"{c}.{k}"), F.lit(v)).cast("decimal(38,0)").alias(k) for k, v in none.items()))
        return [r["bucket"] for r in both.where(zero("x") != zero("y")).select("bucket").collect()]

    def _merge(self, new: DataFrame, buckets: list[int], epoch: int, whole: bool) -> DataFrame:
        spark = new.sparkSession
        if not buckets:
            return new.select(*self.key, F.lit("touch").alias("change")).limit(0)
        old = self.entries(spark, buckets).alias("o").withColumn("there", F.lit(True)).alias("o")
        new = new.where(F.col("bucket").isin(buckets)).withColumn("there", F.lit(True)).alias("n")
        same = F.lit(True)
        for c in ("bucket", *self.key):
            same = same & F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
        was, now = F.col("o.there").isNotNull(), F.col("n.there").isNotNull()
        equal = F.struct(*(F.col(f"o.`{c}`") for c in self.values)).eqNullSafe(F.struct(*(F.col(f"n.`{c}`") for c in self.values)))
        change = F.when(~was, "insert").when(~now, "keep" if whole else "touch").when(equal, "touch").otherwise("update")
        gone = F.when(now, F.lit(None)).otherwise(F.coalesce("o.gone", F.lit(epoch)) if whole else F.col("o.gone")).cast("int")
        out = old.join(new, same, "full_outer").select(
            *(F.when(was, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c) for c in ("bucket", *self.key)),
            *(F.when(now, F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) for c in self.values),
            F.when(was & (~now | equal), F.col("o.written")).otherwise(F.lit(epoch)).cast("int").alias("written"),
            gone.alias("gone"),
            change.alias("change"),
        )
        staged = self._staged(out)
        if self.indexed:
            fresh = staged.where("change IN ('insert', 'update')")
            kept = spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("token").isNotNull()).alias("p")
            again = F.lit(True)
            for c in ("bucket", *self.key):
                again = again & F.col(f"p.`{c}`").eqNullSafe(F.col(f"f.`{c}`"))
            kept = kept.join(fresh.alias("f"), again, "left_anti")
            held = spark.read.parquet(self._stage(self._indexed(fresh, staged).unionByName(kept)))
            self._replace(held, "postings", ("token",))
        self._replace(staged.drop("change"), "entries", self.key)
        self._replace(_digests(staged, self), "digests", ())
        return staged.select(*self.key, "change")

    def _indexed(self, rows: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """Postings of rows, and a row without a token for each bucket of `within` (of rows, if not told), so that none keeps old ones."""
        made = search.postings(rows.withColumn("id", F.struct("bucket", *self.key)), self.indexed).select("id.*", "col", "token")
        kinds = dict((rows if within is None else within).dtypes)
        blank = (rows if within is None else within).select("bucket").distinct()
        return made.unionByName(blank.select("bucket", *(F.lit(None).cast(kinds[c]).alias(c) for c in self.key), *(F.lit(None).cast("string").alias(c) for c in ("col", "token"))))

    def _stage(self, df: DataFrame) -> str:
        path = scratch(df.sparkSession)
        df.write.parquet(path)
        return path

    def _staged(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.read.parquet(self._stage(df))

    def _replace(self, df: DataFrame, table: str, order: tuple[str, ...]) -> None:
        """The buckets of df take the place of those in a table; a bucket is one file, sorted, so that row groups can be passed over."""
        out = df.repartition("bucket").sortWithinPartitions("bucket", *order)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")


def _digests(rows: DataFrame, snapshot: Snapshot) -> DataFrame:
    """bucket, n, a, b: entries that are not gone, and two sums of their hashes, which do not depend on the order."""
    here = F.col("gone").isNull()
    text = F.to_json(F.struct(*snapshot.key, *snapshot.values))
    total = lambda seed: F.coalesce(F.sum(F.when(here, F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"))
    return rows.groupBy("bucket").agg(F.count_if(here).cast("decimal(38,0)").alias("n"), total(1).alias("a"), total(2).alias("b"))

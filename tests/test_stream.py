"""The lexicon from a stream in several batches against the one from the table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.operators import mutations
from inkstone.streaming import lexicon

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "learn").when(F.col("event_type") == "error", "fail").otherwise("other")
    ev = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("term"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    # five batches, each later than the one before but for a seventh of the rows, which come one batch late
    batch = F.ntile(5).over(Window.orderBy("ts")) + (F.pmod(F.xxhash64("term", "ts"), F.lit(7)) == 0).cast("int")
    odd = spark.createDataFrame([(None, "learn"), ("x", "fail")], "term string, kind string").withColumn("ts", F.lit(None).cast("timestamp")).withColumn("batch", F.lit(1))
    rows = ev.withColumn("batch", batch).unionByName(odd).cache()
    source, out = str(tmp_path / "in"), []
    for b in range(1, 7):
        rows.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("term string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "60 days")
    q = lexicon.lexicon(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: out.append((i, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for _, part in sorted(out, key=lambda x: x[0]):
        got |= {r["term"]: r for r in part}
    want = {r["term"]: r for r in mutations.lexicon(ev).collect()}
    assert len([p for _, p in out if p]) >= 3 and len(want) > 10
    assert any(r["fail_count"] for r in want.values())
    assert got.keys() == want.keys()
    for t, w in want.items():
        assert all(got[t][c] == w[c] for c in ("learn_count", "fail_count", "first_learned", "last_learned", "last_failed")), (t, got[t], w)

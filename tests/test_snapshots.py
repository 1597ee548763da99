"""Snapshots whose changed buckets alone are rewritten, against a rebuild."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkstone.operators.mutations import refresh_dictionary
from inkstone.operators.search import postings
from inkstone.operators.snapshots import Snapshot

SCHEMA = "word string, sound string, definition string"
OLD = [("a", "1", "one thing"), ("a", None, "no sound"), (None, "1", "no word"), ("b", "1", "two things"), ("c", "1", None), ("d", "1", "")] + [(f"w{i}", "x", f"word {i}") for i in range(300)]


def files(path: str, table: str) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(path, table).iterdir() if p.name.startswith("bucket=")}


@pytest.fixture
def snapshot(spark, tmp_path):
    s = Snapshot(str(tmp_path / "snap"), ("word", "sound"), ("definition",), ("definition",), buckets=16)
    s.create(spark.createDataFrame(OLD, SCHEMA))
    return s


def held(spark, s):
    return {(r.word, r.sound): (r.definition, r.written, r.gone) for r in s.entries(spark).collect()}


def index(spark, s):
    return {(r.word, r.sound, r.token) for r in s.postings(spark).collect()}


def rebuilt(spark, s):
    e = s.entries(spark).withColumn("id", F.struct("word", "sound"))
    return {(r.id.word, r.id.sound, r.token) for r in postings(e, ("definition",)).collect()}


def test_equal_source_writes_nothing(spark, snapshot):
    before = files(snapshot.path, "entries")
    assert snapshot.refresh(spark.createDataFrame(OLD[::-1] + OLD[:3], SCHEMA), 2).count() == 0
    assert files(snapshot.path, "entries") == before


def test_only_changed_buckets_are_rewritten(spark, snapshot):
    new = [r for r in OLD if r[0] not in ("b", "w7")] + [("b", "1", "other things"), ("b", "1", "zz repeats the key"), ("new", None, "fresh")]
    new = spark.createDataFrame(new, SCHEMA)
    change = {(r.word, r.sound): r.change for r in snapshot.refresh(new, 2).collect()}
    assert {k: v for k, v in change.items() if v != "touch"} == {("b", "1"): "update", ("w7", "x"): "keep", ("new", None): "insert"}
    now = held(spark, snapshot)
    assert now["b", "1"] == ("other things", 2, None)
    assert now["w7", "x"] == ("word 7", 1, 2)
    assert now["new", None] == ("fresh", 2, None)
    assert now["a", None] == ("no sound", 1, None) and now[None, "1"] == ("no word", 1, None) and now["c", "1"] == (None, 1, None)
    assert len(now) == len(OLD) + 1
    assert index(spark, snapshot) == rebuilt(spark, snapshot)


def test_untouched_buckets_keep_their_files(spark, snapshot):
    before = {t: files(snapshot.path, t) for t in ("entries", "postings", "digests")}
    new = [("w7", "x", "changed") if r[0] == "w7" else r for r in OLD]
    snapshot.refresh(spark.createDataFrame(new, SCHEMA), 2)
    for t, was in before.items():
        now = files(snapshot.path, t)
        assert sum(now[b] != was[b] for b in was) == 1, t


def test_equal_to_the_full_refresh(spark, snapshot):
    old = spark.createDataFrame(OLD[5:], SCHEMA)
    new = old.where("word NOT LIKE '%3'").withColumn("definition", F.when(F.col("word").like("%5"), "five").otherwise(F.col("definition"))).unionByName(spark.createDataFrame([("z", "z", "last")], SCHEMA))
    s = Snapshot(snapshot.path + "-2", ("word", "sound"), ("definition",), (), buckets=8)
    s.create(old)
    s.refresh(new, 2)
    want = {(r.word, r.sound): (r.definition, 2 if r.change in ("insert", "update") else 1, 2 if r.change == "keep" else None) for r in refresh_dictionary(old, new, ["word", "sound"]).collect()}
    assert held(spark, s) == want


def test_gone_entries_come_back(spark, snapshot):
    full, less = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(OLD[:-1], SCHEMA)
    snapshot.refresh(less, 2)
    snapshot.refresh(less, 3)
    assert held(spark, snapshot)["w299", "x"] == ("word 299", 1, 2)
    snapshot.refresh(full, 4)
    assert held(spark, snapshot)["w299", "x"] == ("word 299", 1, None)


def test_empty_source_marks_all_as_gone(spark, snapshot):
    snapshot.refresh(spark.createDataFrame([], SCHEMA), 2)
    assert {v[2] for v in held(spark, snapshot).values()} == {2}
    assert index(spark, snapshot) == rebuilt(spark, snapshot)


def test_a_refresh_cut_off_is_made_good(spark, snapshot, monkeypatch):
    new = spark.createDataFrame([("w7", "x", "changed") if r[0] == "w7" else r for r in OLD], SCHEMA)
    whole = Snapshot._replace

    def cut(self, df, table, order):
        if table == "entries":
            raise RuntimeError("lost")
        whole(self, df, table, order)

    monkeypatch.setattr(Snapshot, "_replace", cut)
    with pytest.raises(RuntimeError):
        snapshot.refresh(new, 2)
    monkeypatch.setattr(Snapshot, "_replace", whole)
    snapshot.refresh(new, 2)
    assert held(spark, snapshot)["w7", "x"] == ("changed", 2, None)
    assert index(spark, snapshot) == rebuilt(spark, snapshot)
    assert ("w7", "x", "7") not in index(spark, snapshot)


def test_a_bucket_that_loses_its_last_token(spark, tmp_path):
    s = Snapshot(str(tmp_path / "one"), ("word",), ("definition",), ("definition",), buckets=4)
    s.create(spark.createDataFrame([("a", "one")], "word string, definition string"))
    s.refresh(spark.createDataFrame([("a", "...")], "word string, definition string"), 2)
    assert s.postings(spark).count() == 0


def test_upsert_takes_the_last_and_leaves_the_rest(spark, tmp_path):
    schema = "id long, v array<float>, label string"
    s = Snapshot(str(tmp_path / "v"), ("id",), ("v", "label"), buckets=8)
    s.create(spark.createDataFrame([(i, [float(i)], "old") for i in range(100)], schema))
    before = files(s.path, "entries")
    s.upsert(spark.createDataFrame([(5, [1.0], "x", 1), (5, [2.0], "y", 2), (200, None, "z", 1)], schema + ", seq int"), 2)
    now = {r.id: (r.v, r.label, r.written, r.gone) for r in s.entries(spark).collect()}
    assert now[5] == ([2.0], "y", 2, None) and now[200] == (None, "z", 2, None) and len(now) == 101
    assert all(now[i] == ([float(i)], "old", 1, None) for i in range(100) if i != 5)
    after = files(s.path, "entries")
    assert sum(after[b] != before.get(b) for b in after) <= 2
    assert s.upsert(spark.createDataFrame([], schema), 3).count() == 0

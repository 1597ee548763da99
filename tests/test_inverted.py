"""Postings in files of token ranges: the same rows as without, out of fewer files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkstone.operators import search
from inkstone.operators.inverted import RangeIndex

ENTRY = "id long, simplified string, traditional string, pinyin string, definitions_text string"
WORDS = [f"{a}{b}{c}" for a in "bcdé" for b in "aeiou" for c in "mnrst"]
ROWS = [(i, WORDS[i % len(WORDS)], None, f"x{i % 7}", f"the {WORDS[i * 3 % len(WORDS)]} thing") for i in range(2000)] + [(5000, "", None, None, "水果 fruit"), (5001, None, None, None, None)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, ENTRY)
    index = RangeIndex(str(tmp_path_factory.mktemp("index") / "i"))
    index.write(df, files=24)
    return df, index


@pytest.mark.parametrize("asked", [{"q": "bam"}, {"q": "ba"}, {"q": "éa*"}, {"q": "水果"}, {"q": "bam the"}, {"q": "zzz"}, {"definition": "bam OR thing NOT dut"}, {"definition": "the", "headwords": True}, {"q": "x3", "definition": "co"}])
def test_same_rows(spark, stored, asked):
    df, index = stored
    want = [r.id for r in search.search(df, **asked).collect()]
    assert [r.id for r in search.search(df, **asked, index=index).collect()] == want
    assert want or asked == {"q": "zzz"} or "headwords" in asked


def test_every_term_and_prefix(spark, stored):
    df, index = stored
    all_rows = search.postings(df)
    for text in ("bam", "bar", "dut", "the", "thing", "x3", "eam"):
        for prefix in (False, True):
            fits = F.col("token").startswith(text) if prefix else F.col("token") == text
            rows = lambda x: sorted(map(tuple, x.where(fits).collect()))  # noqa: E731, B023
            assert rows(index.holding(spark, [search.Term(text, prefix, ())])) == rows(all_rows)


def test_few_files_are_read(spark, stored):
    _, index = stored
    every = spark.read.parquet(f"{index.path}/postings")
    total = len(every.inputFiles())
    assert total >= 12
    rows = index.holding(spark, [search.Term("dut", False, ())]).where("token = 'dut'")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    read = plan.collectLeaves().head().metrics().apply("numFiles").value()
    assert 1 <= read <= 2
    # a token that stands in a third of the postings is spread over files
    assert len(index.files(spark, [search.Term("the", False, ())])) >= 3


def test_no_entries(spark, tmp_path):
    df, index = spark.createDataFrame([], ENTRY), RangeIndex(str(tmp_path / "none"))
    index.write(df, files=4)
    assert search.search(df, "a", index=index).count() == 0

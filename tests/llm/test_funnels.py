"""Operator 11 against plain Python, with blocks of any size, and on odd rows."""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from inkstone.llm import funnels
from inkstone.llm.queries import FUNNELS

BASE = datetime(2024, 1, 1)
SCHEMA = "client_id long, kind string, ts timestamp_ntz, bucket string"
HOUR = 3_600_000_000


def plain(rows, given, within=HOUR, percent=90):
    """The contract, attempt by attempt."""
    at = defaultdict(set)
    for client, kind, ts, *_ in rows:
        if None not in (client, kind, ts):
            at[client, kind].add((ts - BASE) // timedelta(microseconds=1))
    at = {k: sorted(v) for k, v in at.items()}
    took = defaultdict(lambda: defaultdict(list))
    for f in given:
        for client in {c for c, _ in at}:
            for start in at.get((client, f.steps[0]), []):
                prev = start
                took[f.name, client][1].append(0)
                for k, kind in enumerate(f.steps[1:], 2):
                    own = at.get((client, kind), [])
                    i = bisect_right(own, prev)
                    if i == len(own) or own[i] - prev > within or any(prev < x <= own[i] for e in f.excluding for x in at.get((client, e), [])):
                        break
                    took[f.name, client][k].append(own[i] - prev)
                    prev = own[i]
    out = {key: (tuple(len(v[k]) for k in (1, 2, 3, 4)), max(k for k in v if v[k]), tuple(sorted(v[k])[-(-percent * len(v[k]) // 100) - 1] if v[k] else None for k in (2, 3, 4))) for key, v in took.items() if v[1]}
    same = Counter((name, deepest) for (name, _), (_, deepest, _) in out.items())
    return {(name, client, *n, deepest, *t, same[name, deepest]) for (name, client), (n, deepest, t) in out.items()}


def found(spark, data, given=FUNNELS, **how):
    df = funnels.count(spark.createDataFrame(data, SCHEMA), given, **how)
    assert df.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def some(seed, n, hours, clients=4, grid=1_000_000):
    r = random.Random(seed)
    kinds = ["view"] * 6 + ["click"] * 5 + ["purchase"] * 3 + ["signup", "error", "other"]
    return [(0 if r.random() < 0.5 else r.randrange(1, clients), r.choice(kinds), BASE + timedelta(microseconds=r.randrange(int(hours * 3600e6 // grid)) * grid), "x") for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "hours", "grid", "rows"), [(1, 400, 6, 1_000_000, 3), (2, 300, 30, 60_000_000, 4), (3, 500, 2, 60_000_000, 2), (4, 600, 90, 1, 4096)])
def test_as_attempt_by_attempt(spark, seed, n, hours, grid, rows):
    """Ties on a grid of minutes, gaps of exactly an hour, attempts across block ends, and one client with half of the rows."""
    data = some(seed, n, hours, grid=grid)
    assert found(spark, data, rows=rows) == plain(data, FUNNELS)


def test_the_limits(spark):
    """An hour is reached, a microsecond more is not; an excluded row at the step's own time counts, at the step before not."""
    at = lambda m, us=0: BASE + timedelta(minutes=m, microseconds=us)
    data = [(1, "view", at(0), ""), (1, "click", at(60), ""), (2, "view", at(0), ""), (2, "click", at(60, 1), ""), (3, "view", at(0), ""), (3, "click", at(5), ""), (3, "error", at(5), "")]
    data += [(4, "view", at(0), ""), (4, "error", at(0), ""), (4, "click", at(5), ""), (5, "click", at(0), ""), (5, "click", at(0), ""), (6, "view", at(-3), ""), (6, "click", at(-2), "")]
    got = found(spark, data)
    assert got == plain(data, FUNNELS)
    assert {(c, n2) for f, c, _n1, n2, *_ in got if f == "A"} == {(1, 1), (2, 0), (3, 0), (4, 1), (6, 1)}


def test_odd_rows(spark):
    """Nulls in any column, repeated rows, unknown kinds, a column named like an internal one, an empty table."""
    data = some(5, 60, 3) * 2 + [(None, "view", BASE, None), (1, None, BASE, None), (1, "view", None, None), (9, "other", BASE, None), (9, "", BASE, "y" * 100_000)]
    got = found(spark, data, rows=5)
    assert got == plain(data, FUNNELS)
    assert all(c != 9 for _, c, *_ in got)
    assert found(spark, []) == set()
    clash = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS stop", "2 AS at", "'q' AS funnel", "3 AS n", "4 AS step", "5 AS kinds", "6 AS period", "7 AS bit")
    assert {tuple(r) for r in funnels.count(clash, FUNNELS, rows=5).collect()} == got


def test_other_funnels(spark):
    """Funnels of other lengths, several excluded kinds, names as clients, timestamps with a zone, another percentile."""
    given = (funnels.Funnel("one", ("view",)), funnels.Funnel("two", ("view", "view"), ("error", "signup")), funnels.Funnel("four", ("view", "click", "click", "view"), ("error",)))
    data = some(6, 300, 8)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("concat('c', client_id) AS client_id", "kind", "CAST(ts AS timestamp) AS ts")
    got = {tuple(r) for r in funnels.count(df, given, minutes=30, percent=50, rows=7).collect()}
    assert got == {(f, f"c{c}", *rest) for f, c, *rest in plain(data, given, HOUR // 2, 50)}

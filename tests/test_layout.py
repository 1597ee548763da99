"""The map of neighbours: keeps them better than principal components do; weights of a point; few points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkstone.operators.graph import project
from inkstone.operators.layout import library_map, neighbour_map, neighbours


def data(groups=24, each=12, width=24):
    """More groups than two straight directions can keep apart."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, width))
    return [(g * each + i, (centres[g] + 0.25 * rng.normal(size=width)).tolist()) for g in range(groups) for i in range(each)]


def trust(rows, places, k=8):
    """Trustworthiness (Venna and Kaski 2001): 1 if each point's k nearest in the map are its k nearest by cosine."""
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p, n = np.array([places[i] for i, _ in rows]), len(rows)
    far, flat = -(v @ v.T), ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(far, -np.inf)
    np.fill_diagonal(flat, np.inf)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    over = sum(max(0, rank[i, j] - k) for i in range(n) for j in np.argsort(flat[i])[:k])
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1))


def test_beats_principal_components(spark):
    rows = data()
    df = spark.createDataFrame(rows, "id long, v array<double>")
    place = lambda x: {r.id: (r.x, r.y) for r in x.collect()}
    ours, plain = trust(rows, place(neighbour_map(df, rounds=25))), trust(rows, place(project(df)))
    assert ours > plain and ours > 0.9, (ours, plain)
    print(ours, plain)


def test_weights(spark):
    df = spark.createDataFrame([*data(2, 10), (900, None), (None, [1.0] * 24)], "id long, v array<double>")
    rows = neighbours(df, 5).collect()
    w = {(r.u, r.v): r.w for r in rows}
    assert all(0 < x <= 1 + 1e-9 and w[v, u] == x for (u, v), x in w.items())
    assert {u for u, _ in w} == set(range(20))
    # each point is joined in full with its nearest one
    assert all(max(x for (a, _), x in w.items() if a == u) > 0.999 for u in range(20))


def test_few_points(spark):
    schema = "doc long, chunk long, v array<float>"
    assert library_map(spark.createDataFrame([], schema)).count() == 0
    out = library_map(spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 8, [1.0, 0.0]), (2, 9, [0.0, 0.0])], schema), rounds=2)
    assert sorted((r.kind, r.id) for r in out.collect()) == [("chunk", 7), ("chunk", 8), ("chunk", 9), ("document", 1), ("document", 2)]
    assert out.where(F.isnan("x") | F.isnan("y")).count() == 0


def test_round_over_pieces(spark, monkeypatch):
    """A round over many pieces moves points as plain arrays do, and a position goes to a piece once."""
    import pandas as pd

    from inkstone.operators import layout

    rng = np.random.default_rng(1)
    n = 60
    pos = rng.normal(size=(n, 2))
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n - 2, size=(200, 2)).tolist() if a != b})
    both = [(a, b, 0.1 + (a + b) % 9 / 10) for a, b in pairs] + [(b, a, 0.1 + (a + b) % 9 / 10) for a, b in pairs]
    start = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pos)], "id long, x double, y double")
    edges = spark.createDataFrame(both, "u long, v long, w double")
    before = {r.id: (r.x, r.y) for r in layout.layout(start, edges, rounds=0).collect()}
    at = np.array([before[i] for i in range(n)])
    pushed = layout._push(pd.DataFrame({"id": range(n), "x": at[:, 0], "y": at[:, 1]}))[["px", "py"]].to_numpy()
    total, weight = np.zeros((n, 2)), np.zeros(n)
    for a, b, w in both:
        apart = at[a] - at[b]
        d2 = (apart**2).sum()
        total[a] += w * np.clip(-2 * layout.A * layout.B * d2 ** (layout.B - 1) / (1 + layout.A * d2**layout.B) * apart, -4, 4)
        weight[a] += w
    want = at + layout.STEP * (2 * total / np.maximum(weight, 1e-12)[:, None] + 5 * pushed)
    monkeypatch.setattr(layout, "PIECE", 7)
    places = spark.createDataFrame([(i, i // 10) for i in range(n)], "id long, place int")
    for where in (None, places):
        got = {r.id: (r.x, r.y) for r in layout.layout(start, edges, rounds=1, places=where).collect()}
        assert np.allclose([got[i] for i in range(n)], want, atol=1e-9)

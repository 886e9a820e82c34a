"""Planted communities and a planted effect."""

import numpy as np
import pandas as pd

from quern.operators import effects, graph


def brute_labels(edges, rounds):
    weight = {}
    for u, v, w in edges:
        if u != v:
            weight[u, v] = weight.get((u, v), 0) + w
            weight[v, u] = weight.get((v, u), 0) + w
    label = {u: u for u, _ in weight}
    for _ in range(rounds):
        votes = {u: {label[u]: 1} for u in label}
        for (u, v), w in weight.items():
            votes[u][label[v]] = votes[u].get(label[v], 0) + w
        label = {u: min(x, key=lambda k: (-x[k], k)) for u, x in votes.items()}
    return label


def test_label_propagation(spark):
    rng = np.random.default_rng(1)
    edges = []
    for c in range(4):  # four dense groups, few edges between them, and one node next to all
        members = list(range(20 * c, 20 * c + 20))
        edges += [(int(a), int(b), 3) for a in members for b in members if a < b and rng.random() < 0.5]
    edges += [(int(a), int(b), 1) for a, b in rng.integers(0, 80, (12, 2))] + [(999, i, 1) for i in range(80)]
    frame = spark.createDataFrame([*edges, (None, 1, 1), (5, 5, 9), (1, 2, None)], "u long, v long, w long")
    want = brute_labels(edges, 5)
    for partitions, split in ((1, 1000), (40, 7)):
        got = {r.node: r.label for r in graph.label_propagation(frame.repartition(partitions), 5, split).collect()}
        assert got == want
    groups = [{want[i] for i in range(20 * c, 20 * c + 20)} for c in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    assert graph.label_propagation(frame.limit(0)).count() == 0


def test_effect_is_inside_its_interval(spark):
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(size=(n, 2))
    p = 1 / (1 + np.exp(-(0.9 * x[:, 0] - 0.6 * x[:, 1])))
    t = (rng.random(n) < p).astype(int)
    y = 2.0 * t + 1.5 * x[:, 0] + x[:, 1] + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "t": t, "a": x[:, 0], "b": 50 + 10 * x[:, 1]}))
    got = effects.effect(df, "y", "t", ["a", "b"]).first()
    assert got.low < 2.0 < got.high and got.error < 0.06 and got.naive > 2.4
    assert got.n == n and 0 < got.trimmed < n / 4
    again = effects.effect(df.repartition(9), "y", "t", ["a", "b"]).first()
    assert abs(again.effect - got.effect) < 1e-8
    none = effects.effect(df.where("t = 1"), "y", "t", ["a"]).first()
    assert none.effect is None and none.n == t.sum()
    assert effects.effect(df.limit(0), "y", "t", ["a"]).first().n == 0

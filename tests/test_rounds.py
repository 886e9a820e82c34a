"""Models trained in rounds: planted signals, gradients against finite differences, and the same result for any partitioning."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import click, factors, rounds, skipgram


def planted_ratings(seed=1, users=100, items=60, n=4000):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(0, 0.8, (users, 2)), rng.normal(0, 0.8, (items, 2))
    bu, bi = rng.normal(0, 0.3, users), rng.normal(0, 0.3, items)
    u, i = rng.integers(0, users, n), rng.integers(0, items, n)
    i[: n // 3] = 0  # one item has a third of all ratings
    r = np.clip(3 + bu[u] + bi[i] + (p[u] * q[i]).sum(1) + rng.normal(0, 0.2, n), 1, 5)
    part = np.array(["train"] * 6 + ["val", "test"])[rng.integers(0, 8, n)]
    return pd.DataFrame({"u": u, "i": i, "rating": r, "part": part})


def bias_rmse(rows, reg=10.0, turns=20):
    """Of biases alone, fitted in turns, on the test rows."""
    train, test = rows[rows.part == "train"], rows[rows.part == "test"]
    mu, bu, bi = train.rating.mean(), pd.Series(0.0, rows.u.unique()), pd.Series(0.0, rows.i.unique())
    for _ in range(turns):
        g = (train.rating - mu - train.i.map(bi)).groupby(train.u)
        bu.update(g.sum() / (g.count() + reg))
        g = (train.rating - mu - train.u.map(bu)).groupby(train.i)
        bi.update(g.sum() / (g.count() + reg))
    return float(np.sqrt(((np.clip(mu + test.u.map(bu) + test.i.map(bi), 1, 5) - test.rating) ** 2).mean()))


def test_factorisation_beats_biases_for_any_partitioning(spark):
    rows = planted_ratings()
    df = spark.createDataFrame(rows)
    model = factors.fit(df, epochs=8)
    got = model.rmse("test").first().rmse
    assert got < 0.8 * bias_rmse(rows)
    val = [loss for _, _, part, loss in model.fitted.history if part == "val"]
    assert model.fitted.best[0][1] == min(val) and model.fitted.best[0][0] % 2 == 0
    assert abs(factors.fit(df.repartition(11), epochs=8).rmse("test").first().rmse - got) < 1e-9


def test_a_hot_item_has_more_blocks(spark):
    rows = planted_ratings(2, n=2000)
    model = factors.fit(spark.createDataFrame(rows), epochs=1, block_rows=100)
    sizes = [r["count"] for r in model.blocks.table.selectExpr("part", "block", "size(rows) AS count").collect()]
    pairs = {}
    for r in model.blocks.table.select("block").distinct().collect():
        pairs[r.block // factors.MOST_SPLITS] = pairs.get(r.block // factors.MOST_SPLITS, 0) + 1
    assert sum(sizes) <= 2000 and max(sizes) < 200 and len(pairs) == 16 and max(pairs.values()) >= 2 * min(pairs.values())


def test_factorisation_on_odd_rows(spark):
    df = spark.createDataFrame([(1, 1, 5.0, "train"), (1, 1, 5.0, "train"), (None, 1, 1.0, "train"), (1, None, 1.0, "train"), (1, 2, None, "train"), (7, 8, 1.0, "test")], "u long, i long, rating double, part string")
    model = factors.fit(df, epochs=1)
    assert model.setting["mu"] == 5.0 and [(r.n, r.y) for r in model.scored("test").collect()] == [(1.0, 1.0)]
    assert factors.fit(df.limit(0), epochs=1).scored("test").count() == 0


def test_factor_gradients():
    rng = np.random.default_rng(0)
    w, u, i, r, n = rng.normal(size=(5, 4)), np.array([0, 1, 0]), np.array([2, 3, 4]), np.array([1.0, 4, 5]), np.array([1.0, 2, 1])
    _, g = factors.gradients(w, u, i, r, n, 3.0, 0.1)
    for place in [(0, 0), (0, 2), (3, 1), (4, 0)]:
        near = []
        for step in (1e-5, -1e-5):
            v = w.copy()
            v[place] += step
            near.append(factors.gradients(v, u, i, r, n, 3.0, 0.1)[0])
        assert abs((near[0] - near[1]) / 2e-5 - g[place]) < 1e-5


@pytest.mark.parametrize("kind", ["cross", "dots"])
def test_network_gradients(kind):
    rng, net = np.random.default_rng(2), click.Network(kind)
    shared = [rng.normal(0, 0.5, s) for s in net.shapes(2, 3, 4, 5)]
    x, e, y, n = rng.normal(size=(6, 2)), rng.normal(size=(6, 3, 4)), rng.integers(0, 2, 6).astype(float), np.array([1.0, 2, 1, 1, 3, 1])

    def loss():
        return click._log_loss(net.forward(shared, x, e)[0], y, n)[0]

    z, kept = net.forward(shared, x, e)
    grads, de = net.backward(shared, x, e, kept, n * (click._log_loss(z, y, n)[1] - y))
    for own, g in [*zip(shared, grads), (e, de)]:
        assert own.shape == g.shape
        for place in [tuple(rng.integers(0, k) for k in own.shape) for _ in range(6)]:
            was, near = own[place], []
            for step in (1e-5, -1e-5):
                own[place] = was + step
                near.append(loss())
            own[place] = was
            assert abs((near[0] - near[1]) / 2e-5 - g[place]) < 1e-4


def clicks(seed=4, n=4000):
    """Labels by a number, by categories, and by pairs of categories that only products see."""
    rng = np.random.default_rng(seed)
    a, b, c, x = rng.integers(0, 12, n), rng.integers(0, 12, n), rng.integers(0, 30, n), rng.normal(size=n)
    a[: n // 3] = 0
    z = 1.0 * x + rng.normal(0, 1.2, 30)[c] + 2.2 * np.where((a % 2) == (b % 2), 1, -1)
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    part = np.array(["train"] * 4 + ["val", "test"])[rng.integers(0, 6, n)]
    cat = lambda v: [None if k == 3 else str(k) for k in v]
    return pd.DataFrame({"id": np.arange(n), "y": y, "part": part, "x": x, "a": cat(a), "b": cat(b), "c": cat(c)})


def auc(rows):
    y, s = np.array([r.y for r in rows]), np.array([r.score for r in rows])
    rank = pd.Series(s).rank().to_numpy()
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def trained(rows, kind, setting, n_rounds):
    blocks, fitted, net = click.fit(rows, kind, [setting], n_rounds)
    return auc(click.scored(blocks, fitted, net, [setting], "test").collect()), fitted


def test_click_models(spark):
    df = spark.createDataFrame(clicks())
    plain, _ = trained(click.encoded(df, ["x"], [], 512), "logistic", {"numbers": 1, "lr": 0.3}, 8)
    rows = click.encoded(df, ["x"], ["a", "b", "c"], 512)
    linear, fitted = trained(rows, "logistic", {"numbers": 1, "lr": 0.3}, 10)
    assert plain > 0.52 and linear > plain + 0.03
    again, _ = trained(click.encoded(df.repartition(9), ["x"], ["a", "b", "c"], 512), "logistic", {"numbers": 1, "lr": 0.3}, 10)
    assert abs(again - linear) < 1e-9
    assert fitted.weights.where("feature < 0").count() == 1 and fitted.weights.count() == 1 + 12 + 12 + 30
    net = {"numbers": 1, "fields": 3, "width": 4, "hidden": 8, "lr": 0.1, "batch": 64, "passes": 2, "seed": 0}
    cross, _ = trained(rows, "cross", net, 8)
    dots, _ = trained(rows, "dots", net | {"spread": 0.3, "lr": 0.2}, 9)
    assert cross > linear + 0.05 and dots > linear + 0.05


def test_candidates_in_one_job(spark):
    """Candidates don't disturb each other, halving drops the worse, and a reading without gain stops one."""
    df = spark.createDataFrame(clicks(5, 1500))
    rows = click.encoded(df, ["x"], ["c"], 256)
    grid = [{"numbers": 1, "lr": lr} for lr in (0.3, 0.001, 5.0)]
    _, both, _ = click.fit(rows, "logistic", grid, 4, patience=None)
    _, alone, _ = click.fit(rows, "logistic", grid[1:2], 4, patience=None)
    assert {c: n for c, (n, _) in both.best.items()}[2] == 0 < both.best[0][0]
    assert np.allclose([h[3] for h in both.history if h[1] == 1], [h[3] for h in alone.history], rtol=1e-12)
    _, halved, _ = click.fit(rows, "logistic", grid, 4, keep=lambda reading, losses: sorted(losses, key=losses.get)[: max(1, 3 - reading)])
    assert {h[1] for h in halved.history if h[0] == 4} == {min(both.best, key=lambda c: both.best[c][1])}
    assert sorted(r.cand for r in halved.weights.select("cand").distinct().collect()) == [0, 1, 2]


def test_skipgram_finds_planted_synonyms(spark):
    rng = np.random.default_rng(6)
    topics = [[f"t{k}w{i}" for i in range(6)] for k in range(5)]
    twins = {f"t{k}w0": f"t{k}syn" for k in range(5)}
    text = []
    for _ in range(1500):
        k = rng.integers(0, 5)
        s = [topics[k][j] for j in rng.integers(0, 6, 6)]
        text.append([twins.get(w, w) if rng.random() < 0.5 else w for w in s] + ["the"])
    df = spark.createDataFrame([(s,) for s in [*text, None, [], [None, "once"]]], "words array<string>")
    args = {"dim": 12, "n_rounds": 4, "subsample": 1e-2, "block_words": 4000}
    found = {r.word: np.array(r.vector) for r in skipgram.fit(df, **args).collect()}
    assert "once" not in found and len(found) == 36
    near = lambda w: sorted((v for v in found if v != w), key=lambda v: -(found[v] @ found[w]) / np.linalg.norm(found[v]) / np.linalg.norm(found[w]))[:5]
    assert sum(twins[f"t{k}w0"] in near(f"t{k}w0") for k in range(5)) >= 4
    again = {r.word: np.array(r.vector) for r in skipgram.fit(df.repartition(7), **args).collect()}
    assert max(np.abs(found[w] - again[w]).max() for w in found) < 1e-9
    assert skipgram.fit(df.limit(0)).count() == 0


def test_alias_table_is_exact():
    w = np.array([5.0, 1, 0.5, 3, 0.25, 8])
    stay, other = skipgram.alias_table(w.copy())
    share = stay / len(w)
    np.add.at(share, other, (1 - stay) / len(w))
    assert np.allclose(share, w / w.sum())


def test_hashed_normal_depends_on_the_feature_only():
    a = rounds.hashed_normal(np.array([5, 9, -3]), 2000, 1, 2.0)
    assert np.array_equal(a[1], rounds.hashed_normal(np.array([9]), 2000, 1, 2.0)[0])
    assert abs(a.mean()) < 0.1 and abs(a.std() - 2) < 0.1 and abs(np.corrcoef(a)[0, 1]) < 0.1


def test_neighbours_of_every_word(spark):
    from quern.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    counts = Counter(w for t in texts if t for w in re.findall("[a-z0-9]+", t.lower()))
    near = QUERIES["skipgram_neighbours"](spark, sf)
    assert {r.word for r in near.select("word").distinct().collect()} == {w for w, n in counts.items() if n >= 5}

"""Neighbourhood predictions, ranking and match scores against plain numpy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import matching, similarity
from quern.plans import dialect, products, recommend
from quern.plans.registry import ORACLE_SQL, QUERIES, SPARK_STAGED, expand, in_spark

SF = "/root/testdata/sf0.001"


def dense(spark):
    rows = in_spark("SELECT u, i, rating, part FROM {rated} t")(spark, SF).toPandas()
    users, items = sorted(rows.u.unique()), sorted(rows.i.unique())
    at_u, at_i = {u: k for k, u in enumerate(users)}, {i: k for k, i in enumerate(items)}
    r = {p: np.zeros((len(users), len(items))) for p in ("train", "test")}
    for x in rows.itertuples():
        r[x.part][at_u[x.u], at_i[x.i]] = x.rating
    return users, items, r["train"], r["test"]


def test_item_neighbours_predict_as_matrices_do(spark):
    users, items, train, test = dense(spark)
    m = train > 0
    n = m.sum(1)
    mean = np.where(n > 0, train.sum(1) / np.maximum(n, 1), train[m].mean())
    d = (train - mean[:, None]) * m
    q = (d.T**2) @ m
    both = m.T.astype(float) @ m.astype(float)
    size = np.sqrt(q * q.T)
    sim = np.where(size > 1e-6, (d.T @ d) / np.maximum(size, 1e-12), 0) * both / (both + recommend.SHRINK)
    np.fill_diagonal(sim, 0)
    sim = np.maximum(sim, 0)
    got = QUERIES["cf_item_similarity"](spark, SF).toPandas()
    assert len(got) == (np.round(sim, 9) > 0).sum()  # fewer items than neighbours here
    for x in got.itertuples():
        assert abs(sim[items.index(x.i), items.index(x.j)] - x.sim) < 1e-5
    num, den = d @ sim.T, m @ sim.T
    pred = np.clip(mean[:, None] + np.divide(num, den, out=np.zeros_like(num), where=den > 1e-12), 1, 5)
    rows = QUERIES["cf_item_predict"](spark, SF).toPandas()
    assert len(rows) == (test > 0).sum()
    assert max(abs(pred[users.index(x.u), items.index(x.i)] - x.pred) for x in rows.itertuples()) < 1e-4


def test_ranking_leaves_out_seen_items(spark):
    users, items, train, test = dense(spark)
    score = {r.i: r.score for r in in_spark("SELECT i, score FROM {item_scores} t")(spark, SF).collect()}
    order = sorted(items, key=lambda i: (-score[i], i))
    want, shown = {k: [] for k in recommend.CUTS}, {k: set() for k in recommend.CUTS}
    for u in range(len(users)):
        good = {items[k] for k in np.flatnonzero(test[u] >= 4)}
        if good:
            top = [i for i in order if not train[u, items.index(i)]]
            for k in recommend.CUTS:
                hits = [x in good for x in top[:k]]
                shown[k] |= set(top[:k])
                ideal = sum(1 / np.log2(j + 2) for j in range(min(k, len(good))))
                want[k].append((sum(hits) / k, sum(hits) / len(good), sum(h / np.log2(j + 2) for j, h in enumerate(hits)) / ideal, any(hits)))
    for r in QUERIES["ranking_metrics_at_k"](spark, SF).collect():
        assert np.allclose((r.prec, r.rec, r.ndcg, r.hit_rate), np.mean(want[r.k], 0), atol=1e-8) and r.users == len(want[r.k])
        assert np.isclose(r.coverage, len(shown[r.k]) / len(items))


def test_worked_average(spark):
    r = spark.createDataFrame([(0.9, 4.0), (0.8, 5.0)], "s double, r double").agg((F.sum(F.col("s") * F.col("r")) / F.sum(F.abs("s"))).alias("a")).first()
    assert round(r.a, 4) == 4.4706


def test_a_row_counts_as_its_own_match(spark):
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "vec_id long, label int")
    near = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 1, 0.1)], "i long, j long, sim double")
    r = similarity.retrieval_f1(near, labels, 0.5).first()
    assert np.isclose(r.prec, np.mean([1, 1 / 2, 1])) and np.isclose(r.rec, np.mean([1, 1 / 2, 1])) and np.isclose(r.f1, np.mean([1, 2 / 4, 1]), atol=1e-8)


def test_learned_scores_find_a_planted_signal(spark, tmp_path):
    """Rows like the click view's, whose label follows the first number and the category; held-out scores are far from chance."""
    rng = np.random.default_rng(3)
    n = 2500
    quantity, status = rng.integers(1, 51, n), rng.choice(["F", "O"], n)
    flag = np.where(rng.random(n) < 1 / (1 + np.exp(-(quantity - 25) / 6.0 - np.where(status == "F", 1.5, -1.5))), "R", "N")
    rows = [(int(k), int(k % 7), int(q), float(q), 1000.0 + k % 900, s, f) for k, q, s, f in zip(range(n), quantity, status, flag)]
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("logreg_auc", "fm_auc", "mlp_auc", "gbt_auc"):
        assert 0.7 < QUERIES[name](spark, str(tmp_path)).first().auc <= 1, name
    grid = QUERIES["model_grid"](spark, str(tmp_path)).collect()
    assert len(grid) == 3 and all(r["mean"] < 0.6 and r["std"] < 0.1 for r in grid)
    models = {r.model: r for r in QUERIES["click_models"](spark, str(tmp_path)).collect()}
    assert all(m.auc > 0.7 and m.log_loss < 0.69 for m in models.values()) and models["categories"].auc > models["numbers"].auc
    chosen = [r for r in QUERIES["click_selection"](spark, str(tmp_path)).collect() if r.chosen]
    assert len(chosen) == 1 and chosen[0].test_auc > 0.7 and chosen[0].val_loss == min(r.val_loss for r in QUERIES["click_selection"](spark, str(tmp_path)).collect())


def test_factors_of_the_library(spark):
    spread = in_spark("SELECT stddev_pop(rating) AS s FROM {ratings} t")(spark, SF).first().s
    assert QUERIES["als_rmse"](spark, SF).first().rmse < 1.5 * spread
    assert {r.model for r in QUERIES["biased_factors"](spark, SF).collect()} == {"factors", "biases"}


def test_pair_models(spark):
    """Groups of products are told apart by title features; sets without text lose most."""
    rows = {r.features: r for r in QUERIES["ablation_refit"](spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 8 and rows["all"].auc > 0.6 and rows["all"].gain == 0
    assert QUERIES["pair_boosting"](spark, "/root/testdata/sf0.01").first().auc > 0.6


def test_co_rated_slices_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    held = {(int(u), int(i)): float(rng.normal()) for u, i in rng.integers(0, 300, (900, 2)) % np.array([300, 9])}
    rows = spark.createDataFrame([(u, i, d) for (u, i), d in held.items()], "u long, i long, d double")

    def want(members, key, k, asked=lambda m: True):
        out = set()
        for x in filter(asked, members):
            found = []
            for y in members:
                both = [(held[key(x, c)], held[key(y, c)]) for c in range(300) if y != x and key(x, c) in held and key(y, c) in held]
                q = sum(a * a for a, _ in both) * sum(b * b for _, b in both)
                s = round(sum(a * b for a, b in both) / q**0.5 * len(both) / (len(both) + 25), 9) if q > 1e-12 else 0
                found += [(-s, y, len(both))] if s > 0 else []
            out |= {(x, y, n, -s, r + 1) for r, (s, y, n) in enumerate(sorted(found)[:k])}
        return out

    close = lambda rows: {(x, y, n, round(s, 7), k) for x, y, n, s, k in rows}
    got = similarity.co_rated(rows, "u", "i", "d", 3, 25).collect()
    assert close(map(tuple, got)) == close(want(range(9), lambda x, c: (c, x), 3))
    got = similarity.co_rated(rows, "i", "u", "d", 4, 25, F.expr("u % 50 = 0")).collect()
    assert close(map(tuple, got)) == close(want(range(300), lambda x, c: (x, c), 4, lambda x: x % 50 == 0))


def test_pairs_of_a_group_meet_in_bounded_shares(spark, monkeypatch):
    """One group of 300 rows, 40 of them asked: each pair once, and no task makes a third of them."""
    monkeypatch.setattr(matching, "PAIRS", 500)
    rows = spark.range(300).selectExpr("id AS j", "CASE WHEN id < 290 THEN 'g' WHEN id < 298 THEN 'h' END AS grp")
    asked = rows.where("j < 40 OR j IN (295, 299)").withColumnRenamed("j", "i")
    met = matching.group_pairs(asked, rows, "grp").select("i", "j", F.spark_partition_id().alias("task")).toPandas()
    assert sorted(zip(met.i, met.j, strict=True)) == [(i, j) for i in range(40) for j in range(290)] + [(295, j) for j in range(290, 298)]
    assert met.groupby("task").size().max() < len(met) / 3


def test_random_partners_are_joined_by_id(spark, capsys):
    """Rows asked never meet all rows of other groups."""
    names = {n: spark.read.parquet(f"{SF}/part.parquet") for n in ("part",)}
    near = spark.createDataFrame([], "i long, j long")
    text = dialect.spelled(expand(products.VIEWS["negative_pairs"], SPARK_STAGED), dialect.SPARK)
    spark.sql(text, **names, text_nearest=near, hash_nearest=near).explain()
    plan = capsys.readouterr().out
    assert "grp" in plan
    assert not [line for line in plan.splitlines() if ("NestedLoop" in line or "Cartesian" in line) and "NOT (grp" in line]


def test_benchmark_pairs_are_scored_by_titles(spark, tmp_path, monkeypatch):
    """500 products of two groups make 2,445 pairs of a group and are scored as a few pairs of titles, as the SQL has it."""
    rows = [(k, f"red box {k % 2}", f"type {k % 2}", k % 3, f"brand {k % 7}") for k in range(500)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    seen, made = [], products._text_products
    monkeypatch.setattr(products, "_text_products", lambda view, pairs, kinds: seen.append(pairs.count()) or made(view, pairs, kinds))
    got = [tuple(r) for r in QUERIES["benchmark_kind_auc"](spark, str(tmp_path)).orderBy("kind").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT kind, n, auc FROM ({ORACLE_SQL['benchmark_kind_auc']}) q ORDER BY kind").fetchall()
    assert got == [pytest.approx(w) for w in want] and got
    assert max(seen) < 100

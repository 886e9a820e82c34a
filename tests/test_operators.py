"""Operators on small hand-made tables."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import graph, similarity, text
from quern.streaming import sessions


def test_components_of_chain_and_ring(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(8, 9), (9, 10), (10, 8)], "i long, j long")
    got = {r.id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(7)}, 7: 7, 8: 8, 9: 8, 10: 8, 11: 11}


def test_knn_join_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for metric in similarity.METRICS:
        got = similarity.knn_join(rows, rows, 3, metric, block_rows=17).collect()
        sim = np.round(similarity._similarity(x, x, metric), 6)
        np.fill_diagonal(sim, -np.inf)
        want = {i: sorted(range(60), key=lambda j: (-sim[i, j], j))[:3] for i in range(60)}
        assert {i: [r.j for r in sorted(got, key=lambda r: r.rank) if r.i == i] for i in range(60)} == want


def test_clipped_matches(spark):
    rows = spark.createDataFrame([(1, "the the the cat", "the cat sat"), (2, "", "a"), (3, None, None)], "id long, h string, r string")
    got = {r.id: (r.matched, r.hyp_total, r.ref_total) for r in text.clipped_matches(rows, "h", "r", 1).collect()}
    assert got == {1: (2, 4, 3), 2: (0, 0, 1), 3: (0, 0, 0)}


def test_sessions_on_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 00:30:00", 1), ("2024-01-01 03:00:00", 1), ("2024-01-02 00:00:00", 2), ("2024-01-03 00:00:00", 2)]
    spark.createDataFrame(rows, "ts string, user_id long").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    query = sessions.session_counts(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.user_id, r.n) for r in spark.table("closed").collect())[:2] == [(1, 1), (1, 2)]


def test_whitened_components_are_uncorrelated(spark):
    from quern.operators import whitening

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows, rows, "embedding", 3).orderBy("vec_id").collect()
    assert got[-1].white is None and np.allclose([np.linalg.norm(r.white) for r in got[:-1]], 1)
    c = np.cov(x.T, ddof=0)
    w, v = np.linalg.eigh(c)
    want = (x - x.mean(0)) @ (v[:, ::-1][:, :3] / np.sqrt(w[::-1][:3]))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.abs(want), np.abs([r.white for r in got[:-1]]), atol=1e-6)


def test_clustered_index_finds_most_neighbours(spark):
    from quern.plans.registry import QUERIES

    for size, asked in (("sf0.001", 10), ("sf0.1", 40)):
        recall = [r.recall for r in QUERIES["ann_recall"](spark, f"/root/testdata/{size}").collect()]
        assert len(recall) == asked and np.mean(recall) >= 0.9, size


def test_probes_are_measured():
    from quern.operators import approximate

    rng = np.random.default_rng(2)
    centres = np.eye(6)
    apart = np.repeat(centres, 30, axis=0) + rng.normal(0, 0.01, (180, 6))
    assert approximate.probes_for(rng.permutation(apart), centres, 5, 0.99) == 1
    assert approximate.probes_for(rng.normal(size=(300, 6)), centres, 5, 1.0) > 2
    assert approximate.probes_for(apart[:1], centres, 5, 0.9) == 6


def test_sparse_join_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, {int(t): float(w) for t, w in zip(rng.choice(40, rng.integers(0, 9), replace=False), rng.random(9))}) for i in range(50)]
    df = spark.createDataFrame([(i, list(v.items()) if i else None) for i, v in rows], "id long, vector array<struct<term: long, weight: double>>")
    rows[0] = (0, {})
    want = set()
    for i, a in rows:
        found = sorted(((-round(sum(w * b.get(t, 0) for t, w in a.items()), 6), j) for j, b in rows if j != i), key=lambda x: x)
        want |= {(i, j, -s) for s, j in [x for x in found if x[0] < 0][:4]}
    for block in (1 << 20, 2000):
        got = {(r.i, r.j, r.sim) for r in similarity.sparse_join(df, df, 4, block_bytes=block).collect()}
        assert got == want
    assert similarity.sparse_join(df.limit(0), df, 4).count() == 0


def test_generated_tables(spark):
    from quern.sources import synthetic

    made = synthetic.ratings(spark, 20, 30, 1000)
    assert made.count() == 1000 and made.where("rating NOT BETWEEN 1 AND 5 OR user_id >= 20 OR item_id >= 30").count() == 0
    assert made.repartition(7).exceptAll(synthetic.ratings(spark, 20, 30, 1000)).count() == 0
    sizes = {r["count"] for r in synthetic.listings(spark, 50).groupBy("label_group").count().collect()}
    assert sizes <= {1, 2, 3, 4, 5} and len(sizes) > 2
    pairs = synthetic.parallel(spark, 300)
    assert pairs.count() == 300 and 50 < pairs.select("src").distinct().count() < 300
    assert pairs.select("src").distinct().count() == pairs.distinct().select("src", "tgt").distinct().count()  # a sentence has one translation
    assert pairs.repartition(5).exceptAll(synthetic.parallel(spark, 300)).count() == 0
    talk = synthetic.dialogue(spark, 40)
    assert talk.groupBy("conversation_id").agg(F.countDistinct("docIdx").alias("d"), F.countDistinct("uid").alias("u")).where("d <> 1 OR u <> 2").count() == 0
    assert {r["count"] for r in talk.groupBy("conversation_id").count().collect()} <= {4, 5, 6, 7, 8}


def test_best_rows_of_a_block_hold_few_similarities():
    rng = np.random.default_rng(5)
    ids, own, sim = np.arange(0, 90, 3), rng.permutation(4000), np.round(rng.random((30, 4000)), 2)
    best = similarity._Best(ids, 4, 6)
    for lo in range(0, 4000, 150):
        best.add(own[lo : lo + 150], sim[:, lo : lo + 150])
    got = best.batch().to_pandas()
    for r, i in enumerate(ids):
        want = sorted(((-s, j) for s, j in zip(sim[r], own, strict=True) if j != i))[:4]
        assert sorted(zip(-got.sim[got.i == i], got.j[got.i == i], strict=True)) == want
    assert similarity._Best(np.arange(4096), 10, 6).rows * 4096 <= similarity.CELLS


def test_copies_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(7, 3))
    key = [int(v) for v in rng.integers(0, 7, 80)]
    rows = spark.createDataFrame([(i, k, x[k].tolist()) for i, k in enumerate(key)], "id long, key long, v array<double>")
    near = lambda q, b: similarity.knn_join(q, b, 5, "cosine", "id", "v")
    got = similarity.copies_join(rows, F.expr("id % 3 = 0"), 5, "key", near, F.lit(1.0)).collect()
    sim = np.round(similarity._similarity(x[key], x[key], "cosine"), 6) + 0.0
    want = {(i, j, sim[i, j], r + 1) for i in range(0, 80, 3) for r, j in enumerate(sorted((j for j in range(80) if j != i), key=lambda j: (-sim[i, j], j))[:5])}
    assert {(r.i, r.j, r.sim, r["rank"]) for r in got} == want


def test_pair_products_keep_pairs_without_common_terms(spark):
    vectors = spark.createDataFrame([(1, [(5, 0.5), (-2, 2.0)], [(1, 1.0)]), (2, [(-2, 3.0)], None), (3, [(9, 1.0)], [(1, 4.0)])], "id long, a array<struct<term: long, weight: double>>, b array<struct<term: long, weight: double>>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 1)], "i long, j long")
    got = {tuple(r) for r in similarity.pair_products(pairs, vectors, ("a", "b")).collect()}
    assert got == {(1, 2, 6.0, 0.0), (1, 3, 0.0, 4.0), (2, 3, 0.0, 0.0), (1, 1, 4.25, 1.0)}


def test_kept_rows_are_removed(spark):
    import os

    from quern.session import drop_rows, kept_rows

    rows, path = kept_rows(spark.range(5))
    local = path.removeprefix("file:")
    assert sorted(r.id for r in rows.collect()) == list(range(5)) and os.path.isdir(local)
    drop_rows(spark, path)
    assert not os.path.exists(local)


def test_knn_join_of_dealt_groups_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4))
    x[300:320] = x[0]  # ties
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None)], "vec_id long, embedding array<double>").repartition(3)
    for metric in similarity.METRICS:
        near = similarity.knn_join(rows, rows, 3, metric, block_rows=50)
        got = {}
        for r in near.orderBy("i", "rank").collect():
            got.setdefault(r.i, []).append(r.j)
        sim = np.round(similarity._similarity(x, x, metric), 6)
        np.fill_diagonal(sim, -np.inf)
        assert got == {i: sorted(range(700), key=lambda j: (-sim[i, j], j))[:3] for i in range(700)}


def test_neighbours_are_asked_for_every_row(spark):
    from quern.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for name in ("knn_cosine", "knn_dot", "knn_l2"):
        assert QUERIES[name](spark, sf).select("i").distinct().count() == n


def test_hits_are_counted_for_every_row(spark):
    from quern.plans.registry import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert QUERIES["missed_pairs"](spark, "/root/testdata/sf0.001").count() == rows.where("label IS NOT NULL").count()
    others = rows.groupBy("label").count().where("count > 1").agg({"count": "sum"}).first()[0]
    assert QUERIES["candidate_recall"](spark, "/root/testdata/sf0.001").first().queries == others

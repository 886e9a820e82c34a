"""Queries on candidate pairs, hashes and learned scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import approximate, matching, scores, similarity, whitening
from quern.plans.shaped import EVERY, _knn, _knn_sql
from quern.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def hamming_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows with the nearest text hashes for each row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", matching.hash_bits(F.substring(F.md5("text"), 1, 16)).alias("bits"))
    near = similarity.knn_join(rows.where("doc_id % 50 = 0"), rows, 10, "cosine", "doc_id", "bits")
    return near.select("i", "j", F.round(32 * (1 - F.col("sim"))).cast("long").alias("distance"), "rank")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed pairs that cosine or distance finds, with the label agreement."""
    pairs = matching.candidates(_knn("cosine")(spark, sf_dir), _knn("l2")(spark, sf_dir))
    both = matching.with_sides(pairs, table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return both.select("i", "j", F.coalesce((F.col("a.label") == F.col("b.label")).cast("int"), F.lit(0)).alias("y"))


def symmetric_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.symmetric(_knn("cosine")(spark, sf_dir))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = matching.with_sides(_knn("dot")(spark, sf_dir).select("i", "j"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return both.select("i", "j", F.round(matching.dot(F.col("a.embedding"), F.col("b.embedding")), 5).alias("dot"), F.round(matching.cosine(F.col("a.embedding"), F.col("b.embedding")), 5).alias("cosine"))


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length ratio and agreement of hash, source and language of the two documents of each candidate pair."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.md5("text").alias("h"), "source", "lang")
    both = matching.with_sides(_knn("cosine")(spark, sf_dir).select("i", "j"), docs, "doc_id")
    same = lambda c: F.coalesce((F.col(f"a.{c}") == F.col(f"b.{c}")).cast("int"), F.lit(0))
    return both.select("i", "j", F.round(F.least("a.n", "b.n") / F.greatest(F.col("a.n"), F.col("b.n"), F.lit(1)), 9).alias("len_ratio"), same("h").alias("hash_eq"), same("source").alias("same_source"), same("lang").alias("same_lang"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, others, hit, first): rows of the same label, how many of them were found, and whether the nearest is one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    size = rows.groupBy("label").agg((F.count("*") - 1).alias("others"))
    both = matching.with_sides(_knn("cosine", EVERY)(spark, sf_dir).select("i", "j", "rank"), rows, "vec_id").where(F.col("a.label") == F.col("b.label"))
    found = both.groupBy("i").agg(F.count("*").alias("hit"), F.sum((F.col("rank") == 1).cast("int")).alias("first"), F.sum((F.col("rank") <= 5).cast("int")).alias("five"))
    return rows.join(size, "label").select(F.col("vec_id").alias("i"), "others").join(found, "i", "left").fillna(0, ["hit", "first", "five"])


def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("hit") / F.least(F.col("others"), F.lit(10))
    return _hits(spark, sf_dir).where("others > 0").agg(F.round(F.avg(share), 9).alias("recall"), F.round(F.avg("first"), 9).alias("hit_at_1"), F.round(F.avg(F.col("five") / 5), 9).alias("precision_at_5"), F.count("*").alias("queries"))


def missed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of its own label each row's candidates lack."""
    return _hits(spark, sf_dir).select("i", "others", "hit", (F.col("others") - F.col("hit")).alias("missed"))


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % interval of the Brier score of scored rows."""
    from quern.plans.registry import in_spark

    rows = in_spark("SELECT id, y, s FROM {scored}")(spark, sf_dir)
    loss = (F.col("y") - F.col("s")) * (F.col("y") - F.col("s"))
    out = scores.bootstrap(rows, F.col("id"), lambda w: F.sum(w * loss) / F.sum(w))
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def _tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from quern.plans.registry import in_spark

    rows = in_spark("SELECT id, y, coalesce(x1, 25e0) AS x1, ln(1 + coalesce(x2, 0e0)) AS x2, CASE WHEN c1 = 'F' THEN 1e0 ELSE 0e0 END AS c, split FROM {ctr}")(spark, sf_dir)
    raw = VectorAssembler(inputCols=["x1", "x2", "c"], outputCol="raw").transform(rows)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw.where("split = 'train'")).transform(raw)


def _classifier(make: Callable[[], object]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml.evaluation import BinaryClassificationEvaluator

        rows = _tabular(spark, sf_dir)
        scored = make().fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'"))
        auc = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="probability").evaluate(scored)
        return spark.range(1).select(F.lit(round(auc, 3)).alias("auc"))

    return run


def _fm():
    from pyspark.ml.classification import FMClassifier

    return FMClassifier(labelCol="y", factorSize=4, maxIter=20, stepSize=0.05, seed=3)


def _mlp():
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(labelCol="y", layers=[3, 8, 2], maxIter=30, seed=3)


def _gbt():
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="y", maxIter=10, stepSize=0.08, seed=3)


def pca_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors on eight whitened components of unit length; the components are fitted on the training rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, rows.where("vec_id % 5 <> 0"), "embedding", 8).select("vec_id", F.transform("white", lambda x: F.round(x, 5)).alias("white"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the exact ten neighbours among those in the nearest cells of a clustered index, for each query row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = approximate.ivf_join(rows.where("vec_id % 50 = 0"), rows, 10)
    both = _knn("cosine")(spark, sf_dir).select("i", "j").join(near.select("i", "j", F.lit(1).alias("found")), ["i", "j"], "left")
    return both.groupBy("i").agg(F.round(F.avg(F.coalesce("found", F.lit(0))), 9).alias("recall"))


def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean and spread of the validation log loss over two splits for each strength of the penalty, best first."""
    from pyspark.ml.classification import LogisticRegression

    # held out by a hash of the row: the same rows whatever the partitions
    rows, out = _tabular(spark, sf_dir).where("split = 'train'").select("y", "features", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("r")), []
    for strength in (0.0, 0.01, 0.1):
        for seed in (0, 1):
            held = (F.col("r") >= 0.4 * seed) & (F.col("r") < 0.4 * seed + 0.2)
            model = LogisticRegression(labelCol="y", maxIter=10, regParam=strength).fit(rows.where(~held))
            p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1 - 1e-12))
            loss = model.transform(rows.where(held)).agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)))).first()[0]
            out.append((strength, float(loss)))
    frame = spark.createDataFrame(out, "strength double, loss double")
    return frame.groupBy("strength").agg(F.round(F.avg("loss"), 6).alias("mean"), F.round(F.stddev_pop("loss"), 6).alias("std")).orderBy("mean", "strength")


QUERIES: dict[str, Query] = {f.__name__: f for f in (hamming_knn, candidate_union, symmetric_closure, pair_scores, pair_features, candidate_recall, missed_pairs, bootstrap_interval, pca_whiten, ann_recall, model_grid)} | {"fm_auc": _classifier(_fm), "mlp_auc": _classifier(_mlp), "gbt_auc": _classifier(_gbt)}

_NN = f"({_knn_sql('cosine')})"
_NN_EVERY = f"({_knn_sql('cosine', '')})"
_HITS = f"""SELECT e.vec_id AS i, c.n - 1 AS others, coalesce(h.hit, 0) AS hit, coalesce(h.first, 0) AS first, coalesce(h.five, 0) AS five FROM {{embeddings}} e JOIN (SELECT label, count(*) AS n FROM {{embeddings}} GROUP BY label) c ON c.label = e.label
    LEFT JOIN (SELECT n.i, count(*) AS hit, sum((n.rank = 1)::INT)::BIGINT AS first, sum((n.rank <= 5)::INT)::BIGINT AS five FROM {_NN_EVERY} n JOIN {{embeddings}} a ON a.vec_id = n.i JOIN {{embeddings}} b ON b.vec_id = n.j AND b.label = a.label GROUP BY n.i) h ON h.i = e.vec_id"""
_DRAWN = " + ".join(f"(u >= {c!r})::INT" for c in scores.POISSON_STEPS)

ORACLE_SQL: dict[str, str] = {
    "hamming_knn": """SELECT i, j, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j)::INT AS rank FROM (SELECT a.doc_id AS i, b.doc_id AS j, bit_count(xor(a.h, b.h))::BIGINT AS distance
        FROM (SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS h FROM {documents}) a JOIN (SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS h FROM {documents}) b ON a.doc_id <> b.doc_id AND a.doc_id % 50 = 0 AND a.h IS NOT NULL AND b.h IS NOT NULL) s) t WHERE rank <= 10""",
    "candidate_union": f"SELECT p.i, p.j, coalesce((a.label = b.label)::INT, 0) AS y FROM (SELECT i, j FROM {_NN} x UNION SELECT i, j FROM ({_knn_sql('l2')}) z) p JOIN {{embeddings}} a ON a.vec_id = p.i JOIN {{embeddings}} b ON b.vec_id = p.j",
    "symmetric_closure": f"SELECT i, j FROM {_NN} x UNION SELECT j, i FROM {_NN} z",
    "pair_scores": f"SELECT p.i, p.j, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS dot, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM ({_knn_sql('dot')}) p JOIN {{embeddings}} a ON a.vec_id = p.i JOIN {{embeddings}} b ON b.vec_id = p.j",
    "pair_features": f"SELECT p.i, p.j, round(least(length(a.text), length(b.text))::DOUBLE / greatest(length(a.text), length(b.text), 1), 9) AS len_ratio, coalesce((a.text = b.text)::INT, 0) AS hash_eq, coalesce((a.source = b.source)::INT, 0) AS same_source, coalesce((a.lang = b.lang)::INT, 0) AS same_lang FROM {_NN} p JOIN {{documents}} a ON a.doc_id = p.i JOIN {{documents}} b ON b.doc_id = p.j",
    "candidate_recall": f"SELECT round(avg(hit::DOUBLE / least(others, 10)), 9) AS recall, round(avg(first), 9) AS hit_at_1, round(avg(five / 5), 9) AS precision_at_5, count(*) AS queries FROM ({_HITS}) h WHERE others > 0",
    "missed_pairs": f"SELECT i, others, hit, others - hit AS missed FROM ({_HITS}) h",
    "bootstrap_interval": f"SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM (SELECT r, sum(w * (y - s) * (y - s)) / sum(w) AS v FROM (SELECT r, y, s, {_DRAWN} AS w FROM (SELECT r, y, s, ('0x' || substr(md5(id || '-' || r), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM {{scored}} x, range(1, 301) q(r)) a) b GROUP BY r) c",
}

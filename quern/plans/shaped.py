"""Queries written with the DataFrame operators, and their SQL where there is an exact one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import graph, similarity, text
from quern.session import ensure_checkpoint_dir
from quern.sources.tables import table
from quern.streaming import sessions


def _knn(metric: str, asked: str = "vec_id % 50 = 0") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        return similarity.knn_join(vectors.where(asked), vectors, 10, metric)

    return run


#: All rows are asked for.
EVERY = "true"


def retrieval_f1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return similarity.retrieval_f1(_knn("cosine", EVERY)(spark, sf_dir), vectors, 0.3)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))


def tfidf_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tfidf(_titles(spark, sf_dir), "id", "title").select("id", "term", F.round("weight", 6).alias("weight"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    index = text.tfidf(_titles(spark, sf_dir), "id", "title").checkpoint()
    return text.retrieve(index.where("id % 50 = 0"), index, 5)


def token_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _titles(spark, sf_dir).select(F.explode(text.tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.orderBy(F.desc("n"), "token").limit(4996).withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 3)  # the limit bounds the window


def title_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, sf_dir).select("id", F.length(t).cast("long").alias("chars"), F.size(text.tokens(t)).cast("long").alias("words"), t.rlike("[0-9]").alias("has_digit"), (F.upper(t) == t).alias("capitals"), (F.length(F.regexp_replace(t, "[A-Za-z0-9 ]", "")) > 0).alias("other"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titles(spark, sf_dir)
    least = rows.groupBy("title").agg(F.min("id").alias("j"))
    edges = rows.join(least, "title").select(F.col("id").alias("i"), "j")
    return graph.connected_components(rows.select("id"), edges)


_PAIRS = """SELECT conv_id * 1000 + turn AS id, src, tgt FROM (SELECT conv_id, turn, role, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS tgt,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations} WHERE role <> 'system') t WHERE role = 'user' AND next_role = 'assistant'"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAIRS, conversations=table(spark, sf_dir, "conversations"))


def rouge_1_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for n in (1, 2):
        m = text.clipped_matches(_pairs(spark, sf_dir), "src", "tgt", n)
        f = F.when(F.col("matched") > 0, 2.0 * F.col("matched") / (F.col("hyp_total") + F.col("ref_total"))).otherwise(0.0)
        parts.append(m.agg(F.lit(n).alias("n"), F.round(F.avg(f), 9).alias("f1")))
    return parts[0].union(parts[1])


def bleu_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [text.clipped_matches(_pairs(spark, sf_dir), "src", "tgt", n).agg(F.lit(n).alias("n"), F.round(F.sum("matched") / F.sum("hyp_total"), 9).alias("precision")) for n in (1, 2, 3, 4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _pairs(spark, sf_dir).select(text.tokens(F.col("tgt")).alias("w"))
    parts = [words.select(F.explode(text.ngrams(F.col("w"), n)).alias("g")).agg(F.lit(n).alias("n"), F.round(F.countDistinct("g") / F.count("*"), 9).alias("share")) for n in (1, 2)]
    return parts[0].union(parts[1])


def repetition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    repeats = F.size(F.filter(F.zip_with(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return _pairs(spark, sf_dir).select(text.tokens(F.col("tgt")).alias("w")).agg(F.round(F.sum(repeats) / F.sum(F.greatest(F.size(w) - 1, F.lit(0))), 9).alias("rate"))


def dialogue_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return rows.select("conv_id", "turn", F.array_join(F.collect_list("text").over(before), "\n").alias("history"), F.count("*").over(before).alias("n"), F.col("text").alias("reply"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the two sides of each pair; 0 if both are empty."""
    rows = _pairs(spark, sf_dir).select("id", F.array_distinct(text.tokens(F.col("src"))).alias("a"), F.array_distinct(text.tokens(F.col("tgt"))).alias("b"))
    return rows.select("id", F.round(F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1)), 9).alias("jaccard"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_counts(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def als_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.recommendation import ALS

    from quern.plans.registry import in_spark

    rows = in_spark("SELECT CAST(u AS INT) AS u, CAST(i AS INT) AS i, CAST(rating AS FLOAT) AS rating, substr(md5(concat(CAST(u AS STRING), '-', CAST(i AS STRING))), 1, 1) AS h FROM {ratings}")(spark, sf_dir)
    model = ALS(rank=8, maxIter=5, regParam=0.1, userCol="u", itemCol="i", ratingCol="rating", seed=7, coldStartStrategy="drop").fit(rows.where("h < 'd'"))
    return model.transform(rows.where("h >= 'd'")).agg(F.round(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2)), 3).alias("rmse"))


def logreg_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    from quern.plans.registry import in_spark

    rows = in_spark("SELECT y, coalesce(x1, 25e0) AS x1, ln(1 + coalesce(x2, 0e0)) AS x2, split FROM {ctr}")(spark, sf_dir)
    rows = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="y", maxIter=20).fit(rows.where("split = 'train'"))
    auc = BinaryClassificationEvaluator(labelCol="y").evaluate(model.transform(rows.where("split = 'test'")))
    return spark.range(1).select(F.lit(round(auc, 3)).alias("auc"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "retrieval_f1_topk": retrieval_f1_topk,
    "knn_cosine": _knn("cosine", EVERY),
    "knn_dot": _knn("dot", EVERY),
    "knn_l2": _knn("l2", EVERY),
    "tfidf_word": tfidf_word,
    "tfidf_topk": tfidf_topk,
    "token_vocab": token_vocab,
    "title_features": title_features,
    "jaccard_pairs": jaccard_pairs,
    "connected_components": connected_components,
    "rouge_1_2": rouge_1_2,
    "bleu_precisions": bleu_precisions,
    "distinct_n": distinct_n,
    "repetition_rate": repetition_rate,
    "dialogue_history_window": dialogue_history_window,
    "stream_sessions": stream_sessions,
    "als_rmse": als_rmse,
    "logreg_auc": logreg_auc,
}

_T = "SELECT doc_id AS id, text AS title FROM {documents}"
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _knn_sql(metric: str, asked: str = " AND a.vec_id % 50 = 0") -> str:
    v = {"cosine": "list_cosine_similarity(a.v, b.v)", "dot": "list_dot_product(a.v, b.v)", "l2": "-list_distance(a.v, b.v)"}[metric]
    e = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings})"
    return f"SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j)::INT AS rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, round({v}, 6) AS sim FROM {e} a JOIN {e} b ON a.vec_id <> b.vec_id{asked}) s) t WHERE rank <= 10"


def _grams_sql(col: str, n: int) -> str:
    return f"SELECT id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT id, {_TOK.format(col)} AS w FROM ({_PAIRS}) p) q WHERE len(w) >= {n}) x"


def _matches_sql(n: int) -> str:
    h, r = (f"(SELECT id, g, count(*) AS c FROM ({_grams_sql(c, n)}) y GROUP BY id, g)" for c in ("src", "tgt"))
    sizes = f"SELECT id, greatest(len({_TOK.format('src')}) - {n - 1}, 0) AS ht, greatest(len({_TOK.format('tgt')}) - {n - 1}, 0) AS rt FROM ({_PAIRS}) p"
    return f"SELECT s.id, ht, rt, coalesce(m, 0) AS m FROM ({sizes}) s LEFT JOIN (SELECT a.id, sum(least(a.c, b.c)) AS m FROM {h} a JOIN {r} b ON a.id = b.id AND a.g = b.g GROUP BY a.id) k ON k.id = s.id"


_TFIDF = f"""WITH tok AS (SELECT id, unnest({_TOK.format('title')}) AS term FROM ({_T}) t), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + docs) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term), (SELECT count(*) AS docs FROM {{documents}})),
idx AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""

ORACLE_SQL: dict[str, str] = {
    "retrieval_f1_topk": f"""WITH nn AS ({_knn_sql('cosine', '')}), k AS (SELECT nn.i, count(*) AS n, sum((a.label = b.label)::INT) AS hit FROM nn JOIN {{embeddings}} a ON a.vec_id = nn.i JOIN {{embeddings}} b ON b.vec_id = nn.j WHERE sim >= 0.3 GROUP BY nn.i),
        r AS (SELECT coalesce(k.n, 0) AS n, coalesce(hit, 0)::DOUBLE AS hit, c.n AS own FROM {{embeddings}} e JOIN (SELECT label, count(*) AS n FROM {{embeddings}} GROUP BY label) c ON c.label = e.label LEFT JOIN k ON k.i = e.vec_id)
        SELECT round(avg((1 + hit) / (1 + n)), 9) AS prec, round(avg((1 + hit) / own), 9) AS rec, round(avg(2 * (1 + hit) / (1 + n + own)), 9) AS f1, sum(n)::BIGINT AS kept FROM r""",
    **{f"knn_{m}": _knn_sql(m, "") for m in similarity.METRICS},
    "tfidf_word": f"{_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM idx",
    "tfidf_topk": f"{_TFIDF}, s AS (SELECT a.id AS q, b.id AS id, round(sum(a.weight * b.weight), 6) AS score FROM idx a JOIN idx b ON a.term = b.term AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM s) t WHERE rank <= 5",
    "token_vocab": f"SELECT token, n, code FROM (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 3)::INT AS code FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK.format('title')}) AS token FROM ({_T}) t) a GROUP BY token HAVING count(*) >= 2) b) c WHERE code < 5000",
    "title_features": f"SELECT id, length(title)::BIGINT AS chars, len({_TOK.format('title')})::BIGINT AS words, regexp_matches(title, '[0-9]') AS has_digit, upper(title) = title AS capitals, length(regexp_replace(title, '[A-Za-z0-9 ]', '', 'g')) > 0 AS other FROM ({_T}) t",
    "jaccard_pairs": f"SELECT id, round(len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 9) AS jaccard FROM (SELECT id, list_distinct({_TOK.format('src')}) AS a, list_distinct({_TOK.format('tgt')}) AS b FROM ({_PAIRS}) p) q",
    "connected_components": f"SELECT id, min(id) OVER (PARTITION BY title) AS component FROM ({_T}) t",
    "rouge_1_2": " UNION ALL ".join(f"SELECT {n} AS n, round(avg(CASE WHEN m > 0 THEN 2.0::DOUBLE * m / (ht + rt) ELSE 0 END), 9) AS f1 FROM ({_matches_sql(n)}) z" for n in (1, 2)),
    "bleu_precisions": " UNION ALL ".join(f"SELECT {n} AS n, round(sum(m)::DOUBLE / sum(ht), 9) AS precision FROM ({_matches_sql(n)}) z" for n in (1, 2, 3, 4)),
    "distinct_n": " UNION ALL ".join(f"SELECT {n} AS n, round(count(DISTINCT g)::DOUBLE / count(*), 9) AS share FROM ({_grams_sql('tgt', n)}) z" for n in (1, 2)),
    "repetition_rate": f"SELECT round(sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE / count(*), 9) AS rate FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_TOK.format('tgt')} AS w FROM ({_PAIRS}) p) q) x) y",
    "dialogue_history_window": "SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER w, '') AS history, count(*) OVER w AS n, text AS reply FROM {conversations} WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "stream_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '1' HOUR THEN 1 ELSE 0 END AS fresh FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, s",
}

"""Queries on models that are trained in rounds, on chosen settings and on generated text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import sequences
from quern.operators import beam, click, corpus_split, effects, factors, graph, selection, similarity, skipgram, text
from quern.operators.scores import auc_by
from quern.sources.tables import table
from quern.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    from quern.plans.registry import in_spark

    return in_spark(sql)(spark, sf_dir)


#: Ratings in three parts, by a hash of user and item.
_RATED = """SELECT u, i, rating, CASE WHEN h < 'c' THEN 'train' WHEN h < 'e' THEN 'val' ELSE 'test' END AS part
    FROM (SELECT u, i, rating, substr(md5(concat(CAST(u AS STRING), '-', CAST(i AS STRING))), 1, 1) AS h FROM {ratings} r) q"""


def biased_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error on the test ratings of factors stopped on the validation ratings, and of shrunk biases alone."""
    rated = _view(spark, sf_dir, _RATED)
    model = factors.fit(rated, factors=8, epochs=4, patience=1, lr=0.01, reg=0.1)
    train = rated.where("part = 'train'")
    mu = train.agg(F.avg("rating").alias("mu"))
    own = lambda c: train.crossJoin(F.broadcast(mu)).groupBy(c).agg((F.sum(F.col("rating") - F.col("mu")) / (F.count("*") + 10)).alias(f"b{c}"))  # noqa: E731 - mu is one row
    alone = rated.where("part = 'test'").crossJoin(F.broadcast(mu)).join(own("u"), "u", "left").join(own("i"), "i", "left").fillna(0.0, ["bu", "bi"])
    pred = F.least(F.greatest(F.col("mu") + F.col("bu") + F.col("bi"), F.lit(1.0)), F.lit(5.0))
    biases = alone.agg(F.sqrt(F.avg((pred - F.col("rating")) ** 2)).alias("rmse"))
    rows = [model.rmse("test").select(F.lit("factors").alias("model"), "rmse"), biases.select(F.lit("biases").alias("model"), "rmse")]
    return rows[0].unionByName(rows[1]).select("model", F.round("rmse", 4).alias("rmse"))


#: Advertising-like rows in three parts; orders stay whole.
_CLICKS = "SELECT id, y, x1, x2, c1, c2, CASE WHEN split = 'test' THEN 'test' WHEN substr(md5(CAST(floor(id / 10) AS STRING)), 2, 1) < 'd' THEN 'train' ELSE 'val' END AS part FROM {ctr}"
_SETTING = {"numbers": 2, "fields": 2, "width": 4, "hidden": 8, "lr": 0.1, "batch": 256, "passes": 1, "seed": 0, "spread": 0.3}


def click_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve and log loss on test rows of logistic weights without and with categories, of cross layers and
    of pairwise dots, each by its best round on validation rows."""
    rows = _view(spark, sf_dir, _CLICKS)
    encoded = click.encoded(rows, ["x1", "x2"], ["c1", "c2"])
    plain = click.encoded(rows, ["x1", "x2"], [])
    out = None
    for name, kind, frame, n_rounds in (("numbers", "logistic", plain, 4), ("categories", "logistic", encoded, 4), ("cross", "cross", encoded, 3), ("dots", "dots", encoded, 3)):
        blocks, fitted, net = click.fit(frame, kind, [_SETTING], n_rounds)
        scored = click.scored(blocks, fitted, net, [_SETTING], "test")
        p = F.least(F.greatest("score", F.lit(click.LEAST_P)), F.lit(1 - click.LEAST_P))
        loss = scored.groupBy("cand").agg((-F.sum(F.col("n") * (F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))) / F.sum("n")).alias("log_loss"))
        row = auc_by(scored, "cand").join(loss, "cand").select(F.lit(name).alias("model"), F.round("auc", 4).alias("auc"), F.round("log_loss", 4).alias("log_loss"), F.lit(fitted.best.get(0, (0,))[0]).alias("best_round"))
        out = row if out is None else out.unionByName(row)
    return out


def click_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four step sizes of the logistic model for two seeds in one training, halved after the second and third round; and the
    chosen one's figures on the test rows over its seeds."""
    rows = click.encoded(_view(spark, sf_dir, _CLICKS), ["x1", "x2"], ["c1"])
    found = selection.select(rows, "logistic", {f"lr {lr}": {"numbers": 2, "lr": lr} for lr in (0.01, 0.1, 0.3, 1.0)}, 2, 4, halve_at=(2, 3))
    report = found.table(spark).select("setting", F.round("loss", 5).alias("val_loss"), F.round("spread", 5).alias("spread"), "best_round", "rounds", "chosen")
    test = found.test().select(F.round("auc", 4).alias("test_auc"), F.round("auc_std", 4).alias("test_auc_std"), F.round("log_loss", 4).alias("test_log_loss"))
    return report.join(F.broadcast(test), F.col("chosen"), "left")


def skipgram_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest words by skip-gram vectors of all documents, for each word of the vocabulary."""
    words = table(spark, sf_dir, "documents").select(text.tokens(F.col("text")).alias("words"))
    vectors = skipgram.fit(words, dim=16, window=2, negatives=3, n_rounds=3, passes=1, batch=1024, min_count=5).checkpoint()
    from quern.operators.ordering import numbered

    coded = numbered(vectors, [], [F.desc("n"), F.col("word")]).select((F.col("_row") - 1).alias("code"), "word", "vector").checkpoint()
    near = similarity.knn_join(coded, coded, 5, "cosine", "code", "vector")
    a, b = (coded.select(F.col("code").alias(x), F.col("word").alias(w)) for x, w in (("i", "word"), ("j", "neighbour")))
    return near.join(a, "i").join(b, "j").select("word", "neighbour", F.round("sim", 4).alias("sim"), "rank")


def beam_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best continuation, by beams over pairs of words of all assistant turns, of the last word of every user turn whose
    conversation's id is divisible by 50."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.tokens(F.col("text")).alias("words"))
    follow = beam.bigrams(turns.where("role = 'assistant'"))
    prompts = turns.where("role = 'user' AND conv_id % 50 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.element_at(F.when(F.size("words") > 0, F.col("words")), -1).alias("last"))
    return beam.search(prompts, follow, beam=4, max_len=6, no_repeat=2, min_len=2).select("id", F.array_join("tokens", " ").alias("reply"), F.round("score", 6).alias("score"))


FEATURES = "cos_word cos_pair cos_char cos_hash cos_vec ham phash_eq same_file len_ratio word_jacc num_jacc num_both num_conflict min_words".split()
#: Named groups of pair features, each of which one candidate lacks; and some that are all that a candidate has.
FEATURE_SETS = {
    "all": FEATURES,
    "without text": FEATURES[3:],
    "without image": [f for f in FEATURES if f not in ("cos_hash", "ham", "phash_eq", "same_file")],
    "without vectors": [f for f in FEATURES if f != "cos_vec"],
    "without overlaps": [f for f in FEATURES if f not in ("word_jacc", "num_jacc", "len_ratio", "min_words")],
    "without numbers": [f for f in FEATURES if not f.startswith("num_")],
    "text only": FEATURES[:3],
    "image only": ["cos_hash", "ham", "phash_eq", "same_file"],
}


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with their features, in parts by the first product's group, so that no group is in two parts."""
    sql = """SELECT i * 1000000000 + j AS id, f.*, CASE WHEN h < 'a' THEN 'train' WHEN h < 'd' THEN 'val' ELSE 'test' END AS part
        FROM {product_features} f JOIN (SELECT id AS own, substr(md5(grp), 1, 1) AS h FROM {products} p) g ON g.own = f.i"""
    return _view(spark, sf_dir, f"SELECT * FROM ({sql}) q").checkpoint()


def ablation_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fusion of the pair features, fitted anew for each set of features in one training; area under the curve on
    test pairs, against that of all features."""
    rows = click.encoded(_featured(spark, sf_dir), FEATURES, [], 1024)
    names = sorted(FEATURE_SETS)
    grid = [{"numbers": len(FEATURES), "lr": 0.3, "mask": [float(f in FEATURE_SETS[n]) for f in FEATURES]} for n in names]
    blocks, fitted, net = click.fit(rows, "logistic", grid, 8, patience=None)
    auc = auc_by(click.scored(blocks, fitted, net, grid, "test"), "cand")
    named = F.element_at(F.array(*map(F.lit, names)), F.col("cand") + 1)
    whole = auc.where(named == "all").select(F.col("auc").alias("whole"))
    gain = F.col("auc") - F.col("whole")
    verdict = F.when(gain < -0.002, "helps").when(gain > 0.002, "hurts").otherwise("same")
    return auc.join(F.broadcast(whole)).select(named.alias("features"), F.round("auc", 4).alias("auc"), F.round(gain, 4).alias("gain"), verdict.alias("what_is_left_out"))


def pair_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the 14 features of the training pairs, stopped on the validation pairs: figures on the test pairs."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_featured(spark, sf_dir).withColumns({f: F.col(f).cast("double") for f in FEATURES}))
    seen = rows.where("part <> 'test'").withColumn("held", F.col("part") == "val")
    trees = GBTClassifier(labelCol="y", maxIter=40, maxDepth=4, stepSize=0.1, seed=3, validationIndicatorCol="held", minInstancesPerNode=5).fit(seen)
    scored = trees.transform(rows.where("part = 'test'")).select(F.lit(0).alias("cand"), "y", vector_to_array("probability")[1].alias("score"), F.lit(1.0).alias("n"))
    return auc_by(scored, "cand").select(F.round("auc", 4).alias("auc"), F.lit(trees.getNumTrees).alias("trees"))


def conversation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of all conversations where none, only some, and all of them have one."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    own = F.when(F.col("conv_id") % 5 == 0, "val").when(F.col("conv_id") % 5 == 1, "test").otherwise("train")
    cases = {"none": F.lit(None).cast("string"), "some": F.when(F.col("conv_id") % 7 != 0, own), "all": own}
    parts = [corpus_split.conversation_split(ids.select("conv_id", c.alias("split"))).select(F.lit(name).alias("given"), "conv_id", "split") for name, c in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stream_change_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of all events that end by another kind of event or by an hour's gap."""
    found = changes.change_sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", "part", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "kind", "n")


def flat_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string and number inside the events' properties with its path, by a lateral join with a table function."""
    sequences.register(spark)
    table(spark, sf_dir, "events").select("event_id", "props").createOrReplaceTempView("quern_events")
    return spark.sql("SELECT event_id, place, path, value FROM quern_events, LATERAL flat_values(props)")


ROUNDS = 4


def word_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the words of products' names, types and brands that stand side by side in the same product."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(text.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("w"))
    pairs = words.select(F.explode("w").alias("u"), "w").select("u", F.explode("w").alias("v")).where("u < v")
    return graph.label_propagation(pairs.groupBy("u", "v").agg(F.count("*").alias("w")), ROUNDS)


def quantity_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of a discount of five hundredths or more on the quantity, beside tax, price and ship month."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_discount") >= 0.05).cast("int").alias("much"), "l_tax", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.month("l_shipdate").alias("month"))
    found = effects.effect(lines, "l_quantity", "much", ["l_tax", "price", "month"])
    return found.select(*[F.round(c, 4).alias(c) for c in ("effect", "error", "low", "high", "naive")], "n", "trimmed")


QUERIES: dict[str, Query] = {f.__name__: f for f in (word_communities, quantity_effect, biased_factors, click_models, click_selection, skipgram_neighbours, beam_replies, ablation_refit, pair_boosting, conversation_split, stream_change_sessions, flat_event_values)}

_VOTES = "SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, label) AS k FROM (SELECT e.u AS node, l.label, e.w FROM e JOIN {0} l ON l.node = e.v UNION ALL SELECT node, label, 1 FROM {0}) x GROUP BY node, label) y WHERE k = 1"
_OWN = "CASE WHEN conv_id % 5 = 0 THEN 'val' WHEN conv_id % 5 = 1 THEN 'test' ELSE 'train' END"
ORACLE_SQL: dict[str, str] = {
    "word_communities": r"""WITH p AS (SELECT list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+')) AS w FROM {part}),
        c AS (SELECT u, v, count(*) AS w FROM (SELECT u, unnest(w) AS v FROM (SELECT unnest(w) AS u, w FROM p) a) b WHERE u < v GROUP BY u, v),
        e AS (SELECT u, v, w FROM c UNION ALL SELECT v, u, w FROM c), l0 AS (SELECT DISTINCT u AS node, u AS label FROM e), """
    + ", ".join(f"l{i + 1} AS ({_VOTES.format(f'l{i}')})" for i in range(ROUNDS)) + f" SELECT node, label FROM l{ROUNDS}",
    "conversation_split": f"""WITH c AS (SELECT DISTINCT conv_id FROM {{conversations}}),
        r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('0-' || conv_id), conv_id) AS k, count(*) OVER () AS n FROM c),
        a AS (SELECT conv_id, CASE WHEN k <= floor(n * 0.1::DOUBLE) THEN 'test' WHEN k <= 2 * floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r)
        SELECT 'none' AS given, conv_id, split FROM a UNION ALL SELECT 'some' AS given, conv_id, split FROM a UNION ALL SELECT 'all' AS given, conv_id, {_OWN} AS split FROM c""",
    "stream_change_sessions": """WITH l AS (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS prev FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        p AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type OR ts > prev + INTERVAL '1' HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM l)
        SELECT user_id, part, min(ts) AS start, max(ts) AS end, any_value(event_type) AS kind, count(*) AS n FROM p GROUP BY user_id, part""",
    "flat_event_values": "SELECT event_id, 0::BIGINT AS place, 'k' AS path, json_extract_string(props, '$.k') AS value FROM {events} WHERE props IS NOT NULL",
}

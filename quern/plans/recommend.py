"""Neighbourhood recommenders and their ranking metrics. {name} stands for a table or a view; views are in VIEWS."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import similarity
from quern.operators.ordering import numbered

View = Callable[[str], DataFrame]

SHRINK, NEIGHBOURS = 25, 20


def _similarity(pairs: str) -> str:
    """(x, y, n, sim) of pairs (x, y, n, num, qa, qb): cosine over what both rated, shrunk by n / (n + SHRINK)."""
    return f"""SELECT x, y, n, round(CASE WHEN qa * qb > 1e-12 THEN num / sqrt(qa * qb) ELSE 0e0 END * n / (n + {SHRINK}e0), 9) AS sim
        FROM ({pairs}) p"""


def _nearest(similar: str) -> str:
    """The positive similarities of each x, the NEIGHBOURS largest."""
    return f"""SELECT x, y, n, sim, k FROM (SELECT x, y, n, sim, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS k
        FROM ({similar}) s WHERE sim > 0) t WHERE k <= {NEIGHBOURS}"""


VIEWS = {
    "rated": """SELECT u, i, rating, CASE WHEN substr(md5(concat(CAST(u AS STRING), '-', CAST(i AS STRING))), 1, 1) < 'd' THEN 'train' ELSE 'test' END AS part
        FROM {ratings} r""",
    "user_means": "SELECT u, AVG(rating) AS mean FROM {rated} r WHERE part = 'train' GROUP BY u",
    # both modes centre by the user's mean
    "centred": "SELECT r.u, r.i, r.rating - m.mean AS d FROM {rated} r JOIN {user_means} m ON m.u = r.u WHERE part = 'train'",
    # each pair of items once, then mirrored
    "item_pairs": """SELECT a.i AS x, b.i AS y, COUNT(*) AS n, SUM(a.d * b.d) AS num, SUM(a.d * a.d) AS qa, SUM(b.d * b.d) AS qb
        FROM {centred} a JOIN {centred} b ON a.u = b.u AND a.i < b.i GROUP BY a.i, b.i""",
    "item_neighbours": _nearest(
        _similarity(
            """SELECT CASE WHEN s = 0 THEN x ELSE y END AS x, CASE WHEN s = 0 THEN y ELSE x END AS y, n, num, CASE WHEN s = 0 THEN qa ELSE qb END AS qa,
            CASE WHEN s = 0 THEN qb ELSE qa END AS qb FROM {item_pairs} p CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 AS s) m"""
        )
    ),
    # the users whose number is divisible by 50 are asked for
    "user_neighbours": _nearest(
        _similarity(
            """SELECT a.u AS x, b.u AS y, COUNT(*) AS n, SUM(a.d * b.d) AS num, SUM(a.d * a.d) AS qa, SUM(b.d * b.d) AS qb
            FROM {centred} a JOIN {centred} b ON a.i = b.i AND a.u <> b.u WHERE a.u % 50 = 0 GROUP BY a.u, b.u"""
        )
    ),
    "item_scores": """SELECT c.i, coalesce(b.score, 0e0) AS score FROM (SELECT DISTINCT i FROM {ratings} r) c LEFT JOIN
        (SELECT i, round(SUM(rating - mu) / (COUNT(*) + 10e0), 9) AS score FROM {rated} r CROSS JOIN (SELECT AVG(rating) AS mu FROM {rated} q WHERE part = 'train') g
        WHERE part = 'train' GROUP BY i) b ON b.i = c.i""",
}


def _predicted(adjusted: str, asked: str) -> str:
    """The user's mean plus the weighted deviation of the neighbours, else the mean, else the mean of all; within 1 to 5."""
    return f"""SELECT t.u, t.i, t.rating, round(least(5e0, greatest(1e0, coalesce(m.mean, g.mean) + coalesce(p.adj, 0e0))), 6) AS pred
        FROM {{rated}} t LEFT JOIN ({adjusted}) p ON p.u = t.u AND p.i = t.i LEFT JOIN {{user_means}} m ON m.u = t.u
        CROSS JOIN (SELECT AVG(rating) AS mean FROM {{rated}} r WHERE part = 'train') g WHERE t.part = 'test'{asked}"""


_BY_ITEM = """SELECT t.u, t.i, SUM(s.sim * c.d) / SUM(s.sim) AS adj FROM {rated} t JOIN {item_neighbours} s ON s.x = t.i
    JOIN {centred} c ON c.u = t.u AND c.i = s.y WHERE t.part = 'test' GROUP BY t.u, t.i HAVING SUM(s.sim) > 1e-12"""
_BY_USER = """SELECT t.u, t.i, SUM(s.sim * c.d) / SUM(s.sim) AS adj FROM {rated} t JOIN {user_neighbours} s ON s.x = t.u
    JOIN {centred} c ON c.u = s.y AND c.i = t.i WHERE t.part = 'test' GROUP BY t.u, t.i HAVING SUM(s.sim) > 1e-12"""

QUERIES = {
    "cf_item_similarity": "SELECT x AS i, y AS j, n, round(sim, 6) AS sim, CAST(k AS BIGINT) AS k FROM {item_neighbours} t",
    "cf_user_similarity": "SELECT x AS u, y AS v, n, round(sim, 6) AS sim, CAST(k AS BIGINT) AS k FROM {user_neighbours} t",
    "cf_item_predict": f"SELECT u, i, pred FROM ({_predicted(_BY_ITEM, '')}) t",
    "cf_user_predict": f"SELECT u, i, pred FROM ({_predicted(_BY_USER, ' AND t.u % 50 = 0')}) t",
    "cf_item_rmse": f"""SELECT COUNT(*) AS n, round(sqrt(AVG((rating - pred) * (rating - pred))), 6) AS rmse, round(AVG(abs(rating - pred)), 6) AS mae
        FROM ({_predicted(_BY_ITEM, '')}) t""",
    # similarity-weighted mean of the neighbours' mean ratings
    "weighted_average": """SELECT s.x AS i, round(SUM(s.sim * m.mean) / SUM(abs(s.sim)), 6) AS mean FROM {item_neighbours} s
        JOIN (SELECT i, AVG(rating) AS mean FROM {rated} r WHERE part = 'train' GROUP BY i) m ON m.i = s.y GROUP BY s.x""",
    # graded gain 2^r - 1 over a user's held-out ratings, users with two or more
    "rated_ndcg": """SELECT COUNT(*) AS users, round(AVG(dcg / idcg), 9) AS ndcg FROM (SELECT u, SUM(CASE WHEN k <= 5 THEN gain * ln(2e0) / ln(k + 1e0) ELSE 0e0 END) AS dcg,
        SUM(CASE WHEN best <= 5 THEN gain * ln(2e0) / ln(best + 1e0) ELSE 0e0 END) AS idcg FROM (SELECT t.u, power(2e0, t.rating) - 1 AS gain,
        row_number() OVER (PARTITION BY t.u ORDER BY s.score DESC, t.i) AS k, row_number() OVER (PARTITION BY t.u ORDER BY t.rating DESC, t.i) AS best
        FROM {rated} t JOIN {item_scores} s ON s.i = t.i WHERE t.part = 'test') r GROUP BY u HAVING COUNT(*) >= 2) m""",
    "rank_decay": """SELECT CAST(k AS BIGINT) AS k, COUNT(*) AS n, round(AVG(CASE WHEN rating >= 4 THEN 1e0 ELSE 0e0 END), 9) AS prec FROM (SELECT t.rating,
        row_number() OVER (PARTITION BY t.u ORDER BY s.score DESC, t.i) AS k FROM {rated} t JOIN {item_scores} s ON s.i = t.i WHERE t.part = 'test') r WHERE k <= 10 GROUP BY k""",
}

#: Views that Spark computes once, however often a query reads them; and how it makes those whose SQL is for the check only.
SPARK_STAGED = ("rated", "user_means", "centred", "item_neighbours", "user_neighbours")


def item_neighbours(view: View) -> DataFrame:
    """The view of that name, summed up inside tasks: no row for each pair that a user rated."""
    return similarity.co_rated(view("SELECT u, i, d FROM {centred} c"), "u", "i", "d", NEIGHBOURS, SHRINK)


def user_neighbours(view: View) -> DataFrame:
    return similarity.co_rated(view("SELECT u, i, d FROM {centred} c"), "i", "u", "d", NEIGHBOURS, SHRINK, F.expr("u % 50 = 0"))


SPARK_VIEWS: dict[str, Callable[[View], DataFrame]] = {"item_neighbours": item_neighbours, "user_neighbours": user_neighbours}

CUTS = (5, 10, 20)


def ranking_metrics_at_k(view: View) -> DataFrame:
    """Precision, recall, NDCG, hit rate and coverage of the best unseen items, over users with a relevant held-out item.

    All users share one order of the items, so that a user's list lies within the first CUTS[-1] + (items seen) ranks:
    the rows made are as many as the ratings, not users times items.
    """
    items = numbered(view("{item_scores}"), [], [F.desc("score"), F.col("i")]).select("i", F.col("_row").alias("g"), F.col("_n").alias("catalogue"))
    rows = view("SELECT u, i, rating, part FROM {rated} r").join(items, "i")
    good = rows.where("part = 'test' AND rating >= 4").select("u", "g", F.lit(1).alias("good"))
    users = good.groupBy("u").agg(F.count("*").alias("rel"))
    seen = rows.where("part = 'train'").select("u", "g")
    bound = users.join(seen.groupBy("u").agg(F.count("*").alias("held")), "u", "left").crossJoin(F.broadcast(items.agg(F.max("catalogue").alias("catalogue"))))
    last = F.least(F.col("catalogue"), CUTS[-1] + F.coalesce("held", F.lit(0)))
    near = bound.select("u", "rel", "catalogue", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("g")).join(seen, ["u", "g"], "left_anti")
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("g"))).where(F.col("k") <= CUTS[-1]).join(good, ["u", "g"], "left").fillna(0, ["good"])
    gain = lambda k: F.log(F.lit(2.0)) / F.log(k + 1.0)
    cut = top.select("*", F.explode(F.array(*map(F.lit, CUTS))).alias("cut")).where("k <= cut")
    own = cut.groupBy("cut", "u").agg(F.max("rel").alias("rel"), F.sum("good").cast("double").alias("hits"), F.sum(F.col("good") * gain(F.col("k"))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("cut", "rel").cast("int")), F.lit(0.0), lambda a, k: a + gain(k))
    mean = own.groupBy("cut").agg(
        F.count("*").alias("users"),
        F.round(F.avg(F.col("hits") / F.col("cut")), 9).alias("prec"),
        F.round(F.avg(F.col("hits") / F.col("rel")), 9).alias("rec"),
        F.round(F.avg(F.col("dcg") / ideal), 9).alias("ndcg"),
        F.round(F.avg((F.col("hits") > 0).cast("double")), 9).alias("hit_rate"),
    )
    share = cut.groupBy("cut").agg(F.round(F.count_distinct("g") / F.max("catalogue"), 9).alias("coverage"))
    return mean.join(share, "cut").withColumnRenamed("cut", "k")


FORMS = {"ranking_metrics_at_k": ranking_metrics_at_k}
FORM_SQL = {
    "ranking_metrics_at_k": """WITH it AS (SELECT i, row_number() OVER (ORDER BY score DESC, i) AS g FROM {item_scores} s),
        us AS (SELECT u, count(*) AS rel FROM {rated} r WHERE part = 'test' AND rating >= 4 GROUP BY u),
        cand AS (SELECT us.u, us.rel, it.i, row_number() OVER (PARTITION BY us.u ORDER BY it.g) AS k FROM us CROSS JOIN it
            WHERE NOT EXISTS (SELECT 1 FROM {rated} r WHERE r.part = 'train' AND r.u = us.u AND r.i = it.i)),
        top AS (SELECT c.*, cut, CASE WHEN t.u IS NULL THEN 0 ELSE 1 END AS good FROM cand c CROSS JOIN (VALUES (5), (10), (20)) v(cut)
            LEFT JOIN {rated} t ON t.u = c.u AND t.i = c.i AND t.part = 'test' AND t.rating >= 4 WHERE k <= cut),
        own AS (SELECT cut, u, max(rel) AS rel, sum(good) AS hits, sum(good * ln(2) / ln(k + 1)) AS dcg FROM top GROUP BY cut, u),
        m AS (SELECT *, list_sum([ln(2) / ln(x + 1) for x in range(1, least(cut, rel) + 1)]) AS idcg FROM own)
        SELECT m.cut AS k, count(*) AS users, round(avg(hits / m.cut), 9) AS prec, round(avg(hits / rel), 9) AS rec, round(avg(dcg / idcg), 9) AS ndcg,
            round(avg((hits > 0)::INT), 9) AS hit_rate, round(max(c.n) / (SELECT count(*) FROM it), 9) AS coverage
        FROM m JOIN (SELECT cut AS own_cut, count(DISTINCT i) AS n FROM top GROUP BY cut) c ON c.own_cut = m.cut GROUP BY m.cut""",
}

"""Word statistics, TF-IDF and set overlap on DataFrames; tokens are runs of a-z and 0-9 of the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import similarity


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tfidf(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, term, weight): sublinear term frequency, smoothed idf, unit length."""
    tf = df.select(F.col(id_column).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = df.select(F.count("*").alias("docs"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df_, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1.0 + F.col("df"))) + 1))
    return raw.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("weight"))


def retrieve(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank): the k best rows of a TF-IDF index (id, term, weight) for each query by shared terms, itself
    excluded. Rows become sparse vectors, which tasks multiply with blocks of queries: no join by term."""
    whole = lambda df: df.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), "weight")).alias("vector"))  # noqa: E731 - a row's own terms
    near = similarity.sparse_join(whole(queries), whole(index), k)
    return near.select(F.col("i").alias("q"), F.col("j").alias("id"), F.col("sim").alias("score"), "rank")


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, each joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def clipped_sums(pairs: DataFrame, hyp: str, ref: str, sizes: tuple[int, ...], id_column: str = "id") -> DataFrame:
    """(id, m<n>, h<n>, r<n> for each n): n-gram multiset overlap of hypothesis and reference, and their n-grams.

    The n-grams of both sides meet in one aggregation by id, n and n-gram; pairs without any stay.
    """
    rows = pairs.select(F.col(id_column).alias("id"), tokens(F.col(hyp)).alias("h"), tokens(F.col(ref)).alias("r"))

    def tagged(n: int, side: str) -> Column:
        return F.transform(ngrams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(int(side == "h")).alias("own")))

    both = [tagged(n, side) for n in sizes for side in "hr"]
    each = rows.select("id", F.explode_outer(F.concat(*both)).alias("x")).select("id", "x.n", "x.g", "x.own")
    counts = each.groupBy("id", "n", "g").agg(F.sum("own").alias("h"), F.sum(1 - F.col("own")).alias("r"))
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0)).cast("long")
    return counts.groupBy("id").agg(*[of(n, c).alias(f"{name}{n}") for n in sizes for name, c in (("m", F.least("h", "r")), ("h", F.col("h")), ("r", F.col("r")))])


def clipped_matches(pairs: DataFrame, hyp: str, ref: str, n: int, id_column: str = "id") -> DataFrame:
    """(id, matched, hyp_total, ref_total): n-gram multiset overlap of hypothesis and reference."""
    return clipped_sums(pairs, hyp, ref, (n,), id_column).select("id", F.col(f"m{n}").alias("matched"), F.col(f"h{n}").alias("hyp_total"), F.col(f"r{n}").alias("ref_total"))

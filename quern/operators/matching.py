"""Candidates, pair features and key repair for entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges (i, j) in both directions, each once."""
    return edges.select("i", "j").union(edges.select("j", "i")).distinct()


def candidates(*neighbours: DataFrame) -> DataFrame:
    """The directed pairs (i, j) that at least one retriever found, each once."""
    out = neighbours[0].select("i", "j")
    for n in neighbours[1:]:
        out = out.union(n.select("i", "j"))
    return out.distinct()


def with_sides(pairs: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """pairs with the columns of both rows as structs a and b."""
    side = F.struct(*(c for c in rows.columns))
    left, right = rows.select(F.col(id_column).alias("i"), side.alias("a")), rows.select(F.col(id_column).alias("j"), side.alias("b"))
    return pairs.join(left, "i").join(right, "j")


#: Pairs that one share of a group makes.
PAIRS = 1 << 20


def group_pairs(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The columns of asked and of rows for all pairs that have one key. A key's rows are dealt to as many shares as keep PAIRS
    pairs each, and its asked rows are sent to all of them; Spark alone would join small tables in one task, however many
    pairs they make."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).join(asked.groupBy(key).agg(F.count("*").alias("_a")), key)
    total = sizes.agg(F.coalesce(F.sum(F.col("_n") * F.col("_a")), F.lit(0))).first()[0]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))
    shares = sizes.select(key, F.ceil(F.col("_n") * F.col("_a") / PAIRS).cast("int").alias("_shares"))
    sent = asked.join(shares, key).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    dealt = rows.join(shares, key).withColumn("_share", F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.col("_shares")).cast("int")).drop("_shares")
    return sent.repartition(parts, key, "_share").join(dealt.repartition(parts, key, "_share"), [key, "_share"]).drop("_share")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-12)


def hash_bits(digits: Column) -> Column:
    """A hash of 16 hexadecimal digits as a vector of 64 parts of +-1/8; the cosine of two is 1 - 2 * Hamming distance / 64."""
    halves = F.array(*(F.conv(F.substr(digits, F.lit(at), F.lit(8)), 16, 10).cast("long") for at in (1, 9)))
    bits = lambda half: F.transform(F.sequence(F.lit(31), F.lit(0)), lambda k: F.when(F.getbit(half, k) == 1, 0.125).otherwise(-0.125))
    return F.flatten(F.transform(halves, bits))


def best_documents(groups: DataFrame, documents: DataFrame, ratio: float = 1.25) -> DataFrame:
    """(key, best, score, second, confident): the document that shares most with each group of texts.

    groups (key, word) and documents (doc, word) hold distinct words. A shared word weighs ln(documents / documents with it);
    the sum is divided by the root of the document's number of words plus one. A match is confident if its score is positive
    and at least `ratio` times the runner-up's. Groups that share no weighted word have no row.
    """
    size = documents.groupBy("doc").agg(F.count("*").alias("words"))
    total = documents.agg(F.count_distinct("doc").alias("total"))
    idf = documents.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("word", F.log(F.col("total") / F.col("df")).alias("idf")).where("idf > 0")
    scores = groups.join(documents.join(idf, "word"), "word").groupBy("key", "doc").agg(F.sum("idf").alias("shared")).join(size, "doc").select("key", "doc", F.round(F.col("shared") / F.sqrt(F.col("words") + 1), 9).alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "doc")
    top = scores.withColumn("_k", F.row_number().over(order)).where("_k <= 2").groupBy("key").agg(F.max(F.when(F.col("_k") == 1, F.col("doc"))).alias("best"), F.max(F.when(F.col("_k") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    return top.withColumn("confident", (F.col("score") > 0) & (F.col("score") >= ratio * F.greatest("second", F.lit(1e-9))))


def realign(found: DataFrame, attached: DataFrame, least_right: float = 0.7, least_sure: float = 0.8) -> DataFrame:
    """(key, doc): the attached documents, or the best ones if most confident matches disagree and they are one to one.

    attached has a row (key, doc) for each group. Nothing changes without confident matches, if a share `least_right` of them
    is attached already, or if fewer than `least_sure` of the groups are confident or two of them claim one document.
    """
    sure = found.where("confident").join(attached, "key").select("key", "best", (F.col("best") == F.col("doc")).alias("right"))
    fact = sure.agg(F.count("*").alias("n"), F.sum(F.col("right").cast("int")).alias("ok"), F.count_distinct("best").alias("claimed")).crossJoin(attached.agg(F.count("*").alias("groups")))
    change = fact.select(((F.col("n") > 0) & (F.col("ok") < least_right * F.col("n")) & (F.col("n") >= least_sure * F.col("groups")) & (F.col("claimed") == F.col("n"))).alias("change"))
    return attached.join(sure.select("key", "best"), "key", "left").crossJoin(F.broadcast(change)).select("key", F.when(F.col("change"), F.coalesce("best", "doc")).otherwise(F.col("doc")).alias("doc"))

"""Generated tables for trials: every value comes from a hash of the row's number, so that any task makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(salt: str, bound: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(bound))


def ratings(spark: SparkSession, users: int, items: int, rows: int) -> DataFrame:
    """(user_id, item_id, rating, timestamp): each user has a taste and each item a quality; a pair may occur twice."""
    made = spark.range(rows).select("id", _draw("user", users).alias("user_id"), F.floor(F.pow(_draw("item", 1 << 20) / float(1 << 20), 2) * items).alias("item_id"))
    level = 3 + F.pmod(F.xxhash64("user_id"), F.lit(5)) / 4.0 - 0.5 + F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(5)) / 4.0 - 0.5 + (_draw("noise", 3) - 1)
    return made.select("user_id", "item_id", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.round(level))).alias("rating"), F.col("id").alias("timestamp"))


def listings(spark: SparkSession, groups: int) -> DataFrame:
    """(posting_id, image, image_phash, title, label_group): groups of one to five listings with shuffled titles."""
    rows = spark.range(groups).select(F.col("id").alias("label_group"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.pmod(F.xxhash64("id"), F.lit(5)))).alias("k"))
    word = lambda n: F.concat(F.lit("w"), F.pmod(F.xxhash64("label_group", F.lit(n)), F.lit(997)).cast("string"))
    words = F.array(*[word(n) for n in range(4)])
    title = F.concat_ws(" ", F.when(F.col("k") % 2 == 0, F.reverse(words)).otherwise(words))
    title = F.when(F.pmod(F.xxhash64("label_group", "k"), F.lit(5)) == 0, F.upper(title)).otherwise(title)
    name = F.concat_ws("-", F.col("label_group").cast("string"), F.col("k").cast("string"))
    return rows.select(name.alias("posting_id"), F.concat(name, F.lit(".jpg")).alias("image"), F.substring(F.md5(F.concat_ws("-", "label_group", (F.col("k") % 2).cast("string"))), 1, 16).alias("image_phash"), title.alias("title"), "label_group")


# Made-up words of two toy languages, and how the second one orders a sentence's parts.
TOY = {"en": "river stone bird lamp road cloud fish tree house moon".split(), "hi": "nadi patthar chidiya diya sadak badal machhli ped ghar chand".split()}
TOY_VERBS = {"en": "sees finds likes keeps".split(), "hi": "dekhta paata chahta rakhta".split()}


def _word(words: list[str], *salt: object) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", *[F.lit(str(s)) for s in salt]), F.lit(len(words))).cast("int") + 1)


def parallel(spark: SparkSession, rows: int) -> DataFrame:
    """(id, src, tgt): subject, verb and object in one toy language; subject, object and verb in the other. Sentences repeat."""
    side = lambda lang, order: F.concat_ws(" ", *[_word(TOY_VERBS[lang] if part == "v" else TOY[lang], part) for part in order])
    return spark.range(rows).select("id", side("en", "svo").alias("src"), side("hi", "sov").alias("tgt"))


def dialogue(spark: SparkSession, conversations: int, documents: int = 4) -> DataFrame:
    """(conversation_id, turn, uid, docIdx, utcTimestamp, text): two speakers in turn on one document each conversation, minutes
    apart; each document has words of its own, which its conversations use."""
    rows = spark.range(conversations).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), 3 + F.pmod(F.xxhash64("id"), F.lit(5)))))
    document = F.pmod(F.xxhash64("id", F.lit("document")), F.lit(documents))
    own = lambda n: F.concat(F.lit("d"), document.cast("string"), F.lit("w"), F.pmod(F.xxhash64("id", "turn", F.lit(n)), F.lit(20)).cast("string"))
    time = F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") * 86_400 + F.col("turn") * 60)
    return rows.select(F.col("id").alias("conversation_id"), "turn", F.concat(F.lit("user"), (F.col("turn") % 2).cast("string")).alias("uid"), document.alias("docIdx"), F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("utcTimestamp"), F.concat_ws(" ", *[own(n) for n in range(4)]).alias("text"))

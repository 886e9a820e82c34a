"""Train, validation and test parts of a parallel corpus: lengths, exact copies, missing parts, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordering import numbered

PARTS = ("val", "test")


def _carve(rows: DataFrame, part: str, share: float) -> DataFrame:
    """Moves a share of the training rows (one at least) to `part`, by the order of a hash of part and id."""
    mark = F.md5(F.concat_ws("-", F.lit(part), F.col("id").cast("string")))
    placed = numbered(rows.where("split = 'train'").withColumn("_h", mark), [], [F.col("_h"), F.col("id")])
    moved = F.col("_row") <= F.greatest(F.lit(1), F.floor(share * F.col("_n")))
    return rows.where("split <> 'train'").unionByName(placed.select("id", "src", "tgt", F.when(moved, part).otherwise("train").alias("split")))


def split_corpus(pairs: DataFrame, max_len: int = 30, shares: dict[str, float] | None = None) -> DataFrame:
    """(id, src, tgt, split) of pairs (id, src, tgt, split) whose sides are token arrays; a null split is a part of its own.

    Kept are pairs with 1 to max_len tokens on both sides, of equal pairs in one part that with the smallest id. Without a
    training part all rows are pooled and cut anew; else a missing part is carved out of training rows. Validation and test
    pairs that occur among the training rows go; a part that is empty then is carved again.
    """
    shares = shares or {"val": 0.05, "test": 0.05}
    fits = F.size("src").between(1, max_len) & F.size("tgt").between(1, max_len)
    rows = pairs.where(fits).groupBy(F.coalesce("split", F.lit("pool")).alias("split"), "src", "tgt").agg(F.min("id").alias("id")).select("id", "src", "tgt", "split").checkpoint()
    have = {r.split for r in rows.select("split").distinct().where(F.col("split").isin("train", *PARTS)).collect()}
    if "train" not in have:
        placed = numbered(rows.drop("split").withColumn("_h", F.md5(F.col("id").cast("string"))), [], [F.col("_h"), F.col("id")])
        test, val = (F.floor(shares[p] * F.col("_n")) for p in ("test", "val"))
        rows = placed.select("id", "src", "tgt", F.when(F.col("_row") <= test, "test").when(F.col("_row") <= test + val, "val").otherwise("train").alias("split"))
    else:
        rows = rows.where(F.col("split").isin("train", *PARTS))
        for p in PARTS:
            rows = rows if p in have else _carve(rows, p, shares[p])
    train = rows.where("split = 'train'")
    clean = train.unionByName(rows.where("split <> 'train'").join(train.select("src", "tgt"), ["src", "tgt"], "left_anti").select("id", "src", "tgt", "split")).checkpoint()
    left = {r.split for r in clean.select("split").distinct().collect()}
    for p in PARTS:
        clean = clean if p in left or "train" not in left else _carve(clean, p, shares[p])
    return clean


def conversation_split(conversations: DataFrame, shares: tuple[float, float] = (0.1, 0.1), seed: int = 0) -> DataFrame:
    """(conv_id, split) of conversations (conv_id, split): the given splits where every conversation has one of train, val and
    test; else all are split anew, the first of a hash order to test, the next to val (floors of the shares).

    One aggregate decides, and each branch joins its rows with that one-row answer: a branch that doesn't hold has no rows
    from there on. Rows that repeat an id count apiece.
    """
    known = F.coalesce(F.col("split").isin("train", *PARTS), F.lit(False))
    given = conversations.agg(F.coalesce(F.bool_and(known), F.lit(True)).alias("_given"))
    when = lambda answer: conversations.join(F.broadcast(given.where(F.col("_given") == answer)), F.lit(True), "left_semi")
    marked = when(False).select("conv_id", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("conv_id").cast("string"))).alias("_h"))
    placed = numbered(marked, [], [F.col("_h"), F.col("conv_id")])
    val, test = (F.floor(s * F.col("_n")) for s in shares)
    anew = placed.select("conv_id", F.when(F.col("_row") <= test, "test").when(F.col("_row") <= test + val, "val").otherwise("train").alias("split"))
    return when(True).select("conv_id", "split").unionByName(anew)

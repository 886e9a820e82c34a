"""Scores of generated text and of binary predictions that need more than one expression."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Cumulative probabilities of Poisson(1) for 0 to 7.
POISSON_STEPS = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(8)))


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays; null counts as empty.

    Bit-parallel over the shorter side, so that a long pair takes one big-integer step per token.
    """

    def length(x, y) -> int:
        if x is None or y is None or not len(x) or not len(y):
            return 0
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        at: dict[str, int] = {}
        for i, t in enumerate(x):
            at[t] = at.get(t, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for t in y:
            u = v & at.get(t, 0)
            v = ((v + u) | (v - u)) & full
        return len(x) - v.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def f1(matched: Column, hyp: Column, ref: Column) -> Column:
    return F.when(matched > 0, 2.0 * matched / (hyp + ref)).otherwise(0.0)


def bleu(sums: dict[int, tuple[Column, Column]], hyp: Column, ref: Column) -> Column:
    """BLEU x 100 from the (matched, total) of each n: brevity penalty, one added to both above n = 1, 0 if a precision is 0."""
    precisions = [F.when(t > 0, m / t).otherwise(0.0) if n == 1 else (m + 1) / (t + 1) for n, (m, t) in sorted(sums.items())]
    worst = F.least(*precisions) if len(precisions) > 1 else precisions[0]
    logs = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0]))
    penalty = F.when(hyp > ref, 1.0).otherwise(F.exp(1 - ref / hyp))
    return F.when((hyp == 0) | (worst <= 0), 0.0).otherwise(100 * penalty * F.exp(logs / len(precisions)))


def poisson_weight(key: Column) -> Column:
    """How often a bootstrap sample draws a row: Poisson(1) by the first eight hexadecimal digits of the key's md5."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2.0**32
    return sum((F.when(u >= s, 1).otherwise(0) for s in POISSON_STEPS), F.lit(0))


def bootstrap(df: DataFrame, key: Column, metric: Callable[[Column], Column], replicates: int = 300) -> DataFrame:
    """One row (low, high): the 2.5 % and 97.5 % points of metric over the replicates; metric gets the column of weights.

    The rows meet their replicates inside a task and are summed there; the shuffle carries one row per task and replicate.
    """
    drawn = df.withColumn("_replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("_weight", poisson_weight(F.concat_ws("-", key.cast("string"), F.col("_replicate").cast("string"))))
    each = drawn.groupBy("_replicate").agg(metric(F.col("_weight")).alias("_value"))
    return each.agg(F.percentile("_value", F.lit(0.025)).alias("low"), F.percentile("_value", F.lit(0.975)).alias("high"))


def auc_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, auc) of rows (key, y, score, n counts): the share of pairs of a positive and a negative in the right order, ties
    half. Scores are summed first; the running sum of a key's distinct scores is cut into ranges (operators/ordering.py).
    Null where a key has one label only."""
    from quern.operators.ordering import numbered

    sums = rows.groupBy(key, "score").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))
    run = numbered(sums, [key], [F.col("score")], ("pos", "neg"))
    below = F.col("_run_neg") - F.col("neg") / 2
    return run.groupBy(key).agg((F.sum(F.col("pos") * below) / F.nullif(F.max("_all_pos") * F.max("_all_neg"), F.lit(0.0))).alias("auc"))

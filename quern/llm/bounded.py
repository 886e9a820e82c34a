"""Bounded collections of the largest rows, without every task sending its own best to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 16


def frequent_rows(counts: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows with the largest counts: `bound` at most, and all above some count.

    A histogram of the counts on a logarithmic scale (a few hundred rows) gives the least count.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * STEPS)
    rows = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, None
    for s, n in rows:
        if total + n > bound:
            break
        total, least = total + n, s
    return counts.where(step >= F.lit(least)) if least is not None else counts.limit(0)


def most_frequent(counts: DataFrame, key: str, count: str, bound: int):
    """A pandas frame of frequent_rows: key and count."""
    return frequent_rows(counts, count, bound).select(key, count).toPandas()

"""Audit of how filters interact: what each order of filters keeps, removes and wastes, from one aggregation.

Every document has one failure flag a filter. Per part, one aggregation sums the products of flags of all subsets of
filters: how many documents fail all filters of a subset. Everything else follows per part from these sums by inclusion and
exclusion, whatever the number of documents: survivors of a set of filters, documents that only one filter fails, what a
filter finds already removed, and Shapley values as sums of Harsanyi dividends (a subset's dividend is its signed sum).

The duplicate flag of a text needs all rows with its text: rows are first counted by (text digest, part, flags, label),
with their smallest id, so that a text in a third of all rows is a few rows before it meets in one place.

Defined results: null text counts as empty; a null part is the empty string; a row without id has no smaller id, so it is no
duplicate; rows that repeat id and text count apiece, and none is the other's duplicate; a label row counts if its
value is 1, several rows of one id count once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text_stats import UPPER, count_of, words_of

LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_UPPER_PERCENT = 5
MARKS = "[#$%&*|]"
FILTERS = "ABCDE"


def failures(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns doc_id and source (as part), the text's digest, and the flags A to D that the text alone decides."""
    t = F.col("__text")
    rows = df.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", words_of(t)).withColumn("__n", F.size("__words"))
    return rows.select(
        "id",
        "part",
        F.unhex(F.sha2(t, 256)).alias("digest"),
        (F.col("__n") < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("__words")) < LEAST_DISTINCT_PERCENT * F.col("__n")).alias("B"),
        (100 * count_of(t, UPPER) > MOST_UPPER_PERCENT * F.length(t)).alias("C"),
        t.rlike(MARKS).alias("D"),
    )


def with_labels(rows: DataFrame, labels: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows counted by all their columns (n), with a flag for each of `names` {flag: column of labels}: the id has a label
    of 1. Rows without id are dealt by their digest."""
    one = [F.max((F.col(c) == 1).cast("int")).alias(f) for f, c in names.items()]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(*one).withColumn("deal", F.lit(0).cast("long"))
    dealt = rows.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    joined = dealt.join(known, ["id", "deal"], "left").withColumns({f: F.coalesce(F.col(f), F.lit(0)) == 1 for f in names})
    return joined.groupBy("id", "deal", *[c for c in rows.columns if c != "id"], *names).agg(F.count("*").alias("n"))


def with_duplicates(rows: DataFrame, flag: str = "E") -> DataFrame:
    """Rows counted by all columns but id and digest (n), with the flag: another row has the text and a smaller id."""
    same = [c for c in rows.columns if c not in ("id", "deal", "digest", "n")]
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    unnamed = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    groups = rows.groupBy("digest", *same).agg(F.sum("n").alias("n"), least.alias("least"), unnamed.alias("unnamed"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    passing = F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    both = F.array(*[F.struct(F.lit(fails).alias(flag), c.alias("n")) for fails, c in ((False, F.col("passing")), (True, F.col("n") - F.col("passing")))])
    split = groups.withColumn("passing", passing).select(*same, F.inline(both))
    return split.where("n > 0").groupBy(*same, flag).agg(F.sum("n").alias("n"))


def _subset_sums(rows: DataFrame, filters: str, measures: dict[str, Column]) -> DataFrame:
    """Per part, one array for each measure: at place m, its sum over rows that fail all filters of the bits of m."""

    def joint(m: int, measure: Column) -> Column:
        flags = [F.col(f).cast("long") for i, f in enumerate(filters) if m >> i & 1]
        return F.sum(reduce(lambda a, b: a * b, flags, measure))

    return rows.groupBy("part").agg(*[F.array(*[joint(m, c) for m in range(1 << len(filters))]).alias(name) for name, c in measures.items()])


def audit(rows: DataFrame, filters: str = FILTERS, losses: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters (all orders) and step: kept, removed, redundant, unique_fails, the `losses`
    {result: flag column} and shapley (over all orders together). rows: part, a flag a filter, n, the loss flags."""
    k, losses = len(filters), losses or {}
    n = F.col("n").cast("long")
    sums = _subset_sums(rows, filters, {"all": n, **{r: n * F.col(f).cast("long") for r, f in losses.items()}})
    masks = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def signed(name: str, weight) -> Column:
        """The sum over subsets t of (-1)^|t| times the joint sum of t times a weight."""
        return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, t: acc + (1 - 2 * (F.bit_count(t) % 2)) * F.get(F.col(name), t) * weight(t).cast("long"))

    def left(name: str) -> Column:
        """Survivors of every set of filters: signed joint sums of its subsets."""
        return F.transform(masks, lambda m: signed(name, lambda t: t.bitwiseAND(m) == t))

    def holding(weight) -> Column:
        """Per filter, minus the signed sums of the subsets that hold it."""
        return F.array(*[-signed("all", lambda t, i=i: F.when(t.bitwiseAND(F.lit(1 << i)) != 0, weight(t)).otherwise(0)) for i in range(k)])

    per_part = sums.select(
        "part",
        "all",
        *[left(name).alias(f"left_{name}") for name in ("all", *losses)],
        holding(lambda t: F.lit(1)).alias("only"),
        holding(lambda t: F.lit(factorial(k)) / F.bit_count(t)).alias("value"),
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = per_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = F.instr(F.lit(filters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    before = reduce(lambda a, b: a + b, [F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)])
    steps = steps.withColumns({"place": place, "bit": F.call_function("shiftleft", F.lit(1), place), "before": before})
    after = F.col("before") + F.col("bit")
    removed = {name: F.get(f"left_{name}", F.col("before")) - F.get(f"left_{name}", after) for name in ("all", *losses)}
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("left_all", after).alias("kept"),
        removed["all"].alias("removed"),
        (F.get("all", F.col("bit")) - removed["all"]).alias("redundant"),
        F.get("only", F.col("place")).alias("unique_fails"),
        *[removed[r].alias(r) for r in losses],
        F.get("value", F.col("place")).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, by source, with good and toxic documents lost."""
    rows = with_duplicates(with_labels(failures(docs), labels, {"good": "quality", "toxic": "toxic"}))
    return audit(rows, FILTERS, {"good_lost": "good", "toxic_lost": "toxic"})

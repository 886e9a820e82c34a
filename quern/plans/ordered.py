"""Spark forms of the queries whose SQL orders a whole table or a whole class: ranges are numbered apart (operators.ordering).

Their SQL in `portable` is what DuckDB runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordering import numbered

View = Callable[[str], DataFrame]


def _curve(view: View) -> DataFrame:
    """One row per distinct score, best first: tp and seen so far, total_pos and total."""
    blocks = view("{scored}").groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    run = numbered(blocks, [], [F.desc("s")], ("pos", "n"))
    return run.select("s", "pos", "n", F.col("_run_pos").alias("tp"), F.col("_run_n").alias("seen"), F.col("_all_pos").alias("total_pos"), F.col("_all_n").alias("total"))


def _auc(view: View, keys: list[str]) -> DataFrame:
    """Area under the ROC curve of each key by average ranks, from one row per key and score."""
    blocks = view("{scored}").groupBy(*keys, "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    run = numbered(blocks, keys, [F.col("s")], ("pos", "n"))
    rank = F.col("_run_n") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = run.groupBy(*keys).agg(F.sum(F.col("pos") * rank).alias("r"), F.max("_all_pos").cast("double").alias("p"), F.max(F.col("_all_n") - F.col("_all_pos")).cast("double").alias("q"))
    return sums.where("p > 0 and q > 0").select(*keys, F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 9).alias("auc"))


def average_precision(view: View) -> DataFrame:
    return _curve(view).agg(F.round(F.sum(F.col("pos") / F.col("total_pos") * (F.col("tp") / F.col("seen"))), 9).alias("ap"))


def best_f1_threshold(view: View) -> DataFrame:
    f1 = 2.0 * F.col("tp") / (F.col("seen") + F.col("total_pos"))
    return _curve(view).select(F.col("s").alias("threshold"), f1.alias("f")).orderBy(F.desc("f"), F.desc("threshold")).limit(1).select("threshold", F.round("f", 9).alias("f1"))


def reliability_ece(view: View) -> DataFrame:
    """Quantile bins as ntile cuts them: the first n % 10 bins get one row more."""
    rows = numbered(view("SELECT id, s, y FROM {scored}"), [], [F.col("s"), F.col("id")])
    size, more = F.floor(F.col("_n") / 10), F.col("_n") % 10
    head = more * (size + 1)
    bin_ = F.when(F.col("_row") <= head, F.ceil(F.col("_row") / (size + 1))).otherwise(more + F.ceil((F.col("_row") - head) / F.greatest(size, F.lit(1))))
    y = F.col("y").cast("double")
    return rows.groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("conf"), F.round(F.avg(y), 9).alias("acc"), F.round(F.abs(F.avg("s") - F.avg(y)) * F.count("*") / F.max("_n"), 9).alias("part"))


def _average_rank(counts: DataFrame, x: str, name: str) -> DataFrame:
    run = numbered(counts.groupBy(x).agg(F.sum("c").alias("c")), [], [F.col(x)], ("c",))
    return run.select(x, (F.col("_run_c") - F.col("c") + (F.col("c") + 1) / 2.0).alias(name))


def spearman_label(view: View) -> DataFrame:
    """Correlation of average ranks, weighted by the count of each pair of values."""
    counts = view("SELECT x1, y, COUNT(*) AS c FROM {ctr} WHERE x1 IS NOT NULL GROUP BY x1, y")
    rows = counts.join(_average_rank(counts, "x1", "rx"), "x1").join(_average_rank(counts, "y", "ry"), "y")
    rows = rows.crossJoin(F.broadcast(counts.agg(((F.sum("c") + 1) / 2.0).alias("m"))))
    a, b, c = F.col("rx") - F.col("m"), F.col("ry") - F.col("m"), F.col("c")
    return rows.agg(F.round(F.sum(c * a * b) / F.sqrt(F.sum(c * a * a) * F.sum(c * b * b)), 9).alias("rho"))


def id_reindex(view: View) -> DataFrame:
    codes = numbered(view("SELECT DISTINCT u FROM {ratings}"), [], [F.col("u")]).select("u", (F.col("_row") - 1).alias("code"))
    return view("SELECT u, i, rating FROM {ratings}").join(codes, "u").select("u", "code", "i", "rating")


def vocab_encode_oov(view: View) -> DataFrame:
    kept = view("SELECT coalesce(c2, '__MISSING__') AS val, COUNT(*) AS n FROM {ctr} WHERE split = 'train' GROUP BY 1 HAVING COUNT(*) >= 10")
    codes = numbered(kept, [], [F.desc("n"), F.col("val")]).select("val", F.col("_row").alias("code"))
    return view("SELECT id, coalesce(c2, '__MISSING__') AS val FROM {ctr}").join(codes, "val", "left").select("id", F.coalesce("code", F.lit(0)).cast("long").alias("code"))


def split_per_user(view: View) -> DataFrame:
    rows = numbered(view("SELECT u, i, md5(concat(CAST(u AS STRING), '-', CAST(i AS STRING))) AS h FROM {ratings}"), ["u"], [F.col("h")])
    held = F.greatest(F.lit(1), F.bround(0.1 * F.col("_n")))
    return rows.select("u", "i", F.when(F.col("_row") <= held, "test").when(F.col("_row") <= 2 * held, "val").otherwise("train").alias("split"))


def split_stratified(view: View) -> DataFrame:
    rows = numbered(view("SELECT id, y, md5(CAST(id AS STRING)) AS h FROM {ctr}"), ["y"], [F.col("h"), F.col("id")])
    return rows.select("id", "y", F.when(F.col("_row") <= F.bround(0.2 * F.col("_n")), "val").otherwise("train").alias("split"))


def split_by_group(view: View) -> DataFrame:
    groups = numbered(view("SELECT DISTINCT grp, md5(CAST(grp AS STRING)) AS h FROM {listings}"), [], [F.col("h")])
    cut: Callable[[float], Column] = lambda share: F.col("_row") <= F.floor(share * F.col("_n"))
    return view("SELECT id, grp FROM {listings}").join(groups.select("grp", F.when(cut(0.6), "train").when(cut(0.8), "val").otherwise("test").alias("split")), "grp").select("id", "grp", "split")


def top_outputs_share(view: View) -> DataFrame:
    counts = view("SELECT text, COUNT(*) AS n FROM {turns} WHERE role = 'assistant' GROUP BY text")
    top = counts.orderBy(F.desc("n"), "text").limit(5).agg(F.sum("n").alias("top"))
    return top.crossJoin(counts.agg(F.sum("n").alias("all"))).select(F.round(F.col("top") / F.col("all"), 9).alias("share"))


FORMS: dict[str, Callable[[View], DataFrame]] = {
    f.__name__: f for f in (average_precision, best_f1_threshold, reliability_ece, spearman_label, id_reindex, vocab_encode_oov, split_per_user, split_stratified, split_by_group, top_outputs_share)
} | {"roc_auc": lambda view: _auc(view, [])}

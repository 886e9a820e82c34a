"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of each text are built-in column expressions (`STATISTICS`).
2. Small regression trees are boosted on a bounded sample of labelled rows (`max_rows`, the only bound); every path from
   a root becomes a conjunctive rule.
3. A logistic model with an L1 penalty over the rules keeps few of them.
4. The kept rules are compiled into one Spark column expression, which scores all rows in one scan.

Defined results: null text counts as empty and gets a score too; rows without a label or id never train; labels of one
class or none give the constant base rate (0.5 without labels); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import text_stats as ts

STATISTICS = (
    "log_words",
    "mean_word_length",
    "symbol_ratio",
    "exclamation_ratio",
    "bar_ratio",
    "capital_ratio",
    "digit_ratio",
    "punctuation_ratio",
    "stop_word_ratio",
    "distinct_word_ratio",
    "duplicate_line_ratio",
    "words_per_line",
)
MAX_ROWS = 20_000


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """(__row, __s_<name> ...): the columns of df as a struct, and one double column per statistic."""
    df = ts.with_line_counts(ts.with_words(df, text))
    df = df.withColumn("__n", F.size("__words").cast("double")).withColumn("__c", F.length(F.translate("__text", ts.BLANKS, "")).cast("double"))
    body = F.col("__text")
    words, letters = F.greatest(F.col("__n"), F.lit(1.0)), F.greatest(F.col("__c"), F.lit(1.0))
    values = {
        "log_words": F.log1p("__n"),
        "mean_word_length": F.col("__c") / words,
        "symbol_ratio": ts.count_of(body, ts.SYMBOLS) / letters,
        "exclamation_ratio": ts.count_of(body, "!") / words,
        "bar_ratio": ts.count_of(body, "|") / words,
        "capital_ratio": ts.count_of(body, ts.UPPER) / letters,
        "digit_ratio": ts.count_of(body, "0123456789") / letters,
        "punctuation_ratio": ts.count_of(body, ".,;:?") / words,
        "stop_word_ratio": ts.stop_word_count(F.col("__words")) / words,
        "distinct_word_ratio": F.size(F.array_distinct("__words")) / words,
        "duplicate_line_ratio": F.col("__n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "words_per_line": F.col("__n") / F.greatest(F.col("__n_lines"), F.lit(1)),
    }
    return df.select("__row", *[values[s].cast("double").alias(f"__s_{s}") for s in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, is at most, threshold) hold; `weight` is added to the log-odds."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        held = F.lit(True)
        for name, low, cut in self.conditions:
            value = F.col(f"__s_{name}")
            held = held & ((value <= F.lit(cut)) if low else (value > F.lit(cut)))
        return F.when(held, F.lit(self.weight)).otherwise(F.lit(0.0))

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        parts = [(stats[n] <= c) if low else (stats[n] > c) for n, low, c in self.conditions]
        return np.logical_and.reduce(parts)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """The score as a column over with_statistics()."""
        logit = F.lit(self.intercept)
        for r in self.rules:
            logit = logit + r.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def score(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """The same score in numpy."""
        logit = self.intercept + sum((r.weight * r.holds(stats) for r in self.rules), np.zeros(len(next(iter(stats.values())))))
        return 1 / (1 + np.exp(-logit))


def _grow(x: np.ndarray, bins: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, columns: np.ndarray, least: int):
    """A regression tree on binned statistics: (column, bin, left, right), or the mean."""
    mean = residual[rows].mean()
    if depth == 0 or len(rows) < 2 * least:
        return mean
    best = (1e-9, -1, -1)
    for c in columns:
        n = np.bincount(bins[rows, c], minlength=64).cumsum()
        s = np.bincount(bins[rows, c], residual[rows], minlength=64).cumsum()
        right_n, right_s = n[-1] - n, s[-1] - s
        fits = (n >= least) & (right_n >= least)
        gain = np.where(fits, s**2 / np.maximum(n, 1) + right_s**2 / np.maximum(right_n, 1) - s[-1] ** 2 / n[-1], 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], c, k)
    _, c, k = best
    if c < 0:
        return mean
    go = bins[rows, c] <= k
    return c, k, _grow(x, bins, residual, rows[go], depth - 1, columns, least), _grow(x, bins, residual, rows[~go], depth - 1, columns, least)


def _predict(tree, bins: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(bins), tree)
    c, k, a, b = tree
    return np.where(bins[:, c] <= k, _predict(a, bins), _predict(b, bins))


def _paths(tree, cuts: list[np.ndarray], path: tuple = ()):
    if path:
        yield path
    if isinstance(tree, tuple):
        c, k, a, b = tree
        cut = float(cuts[c][k])
        yield from _paths(a, cuts, (*path, (STATISTICS[c], True, cut)))
        yield from _paths(b, cuts, (*path, (STATISTICS[c], False, cut)))


def fit(stats: dict[str, np.ndarray], label: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> RuleEnsemble:
    """Fits the ensemble on arrays: one per statistic, and labels 0 or 1."""
    y = np.asarray(label, float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    x = np.stack([np.asarray(stats[s], float) for s in STATISTICS], 1)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0.01, 0.99, 50))) for c in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cuts[c], x[:, c], "left") for c in range(x.shape[1])], 1)
    cuts = [np.append(c, np.inf) for c in cuts]
    rng, logit, found = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        if not len(rows):  # few labels
            continue
        tree = _grow(x, bins, y - 1 / (1 + np.exp(-logit)), rows, depth, columns, max(5, len(y) // 500))
        logit += _predict(tree, bins)
        for path in _paths(tree, cuts):
            found.setdefault(tuple(sorted(set(path))), None)
    rules = list(found)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    held = np.stack([Rule(r, 0.0).holds(stats) for r in rules], 1)
    support = held.mean(0)
    _, first = np.unique(np.packbits(held, axis=0), axis=1, return_index=True)
    use = sorted(i for i in first if 0.001 < support[i] < 0.999)
    if not use:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = held[:, use].astype(np.float32)
    centre, spread = a.mean(0), a.std(0)
    a = (a - centre) / spread
    step = 4 * len(y) / np.linalg.norm(a, 2) ** 2
    w, z, t, b = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0, float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(400):  # accelerated proximal gradient steps of the lasso logistic loss
        gap = 1 / (1 + np.exp(-(a @ z + b))) - y
        b -= 2 * gap.mean()
        new = z - step * (a.T @ gap) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_next * (new - w), new, t_next
    kept = [(use[i], w[i] / spread[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)]
    intercept = b - sum(float(w[i] / spread[i] * centre[i]) for i in np.flatnonzero(np.abs(w) > 1e-6))
    return RuleEnsemble(float(intercept), tuple(Rule(rules[i], float(v)) for i, v in kept))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_column: str = "doc_id", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fits on at most max_rows labelled rows, chosen by a hash of the id; only their texts are read into the sample.

    The sampled ids number at most max_rows, so that table may be broadcast. An id with several labels counts once, by the
    smallest; an id with several texts too, by the one with the smallest statistics in order. No other row is left out.
    """
    known = (
        labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("__y"))
        .where("__id is not null and __y in (0, 1)")
        .groupBy("__id")
        .agg(F.min("__y").alias("__y"))
    )
    share = min(1.0, 1.2 * max_rows / max(1, known.count()))  # of the hash range, so that few more rows than needed are sorted
    near = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    chosen = known.where(near < F.lit(int(share * (1 << 30)))).orderBy(near, "__id").limit(max_rows)
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__body")).join(F.broadcast(chosen), "__id")
    table = with_statistics(rows, "__body").withColumn("__id", F.col("__row.__id")).withColumn("__y", F.col("__row.__y")).drop("__row")
    first = F.min(F.struct(*[f"__s_{s}" for s in STATISTICS])).alias("first")
    table = table.groupBy("__id", "__y").agg(first).select("__id", "__y", "first.*").orderBy("__id").toPandas()
    return fit({s: table[f"__s_{s}"].to_numpy() for s in STATISTICS}, table["__y"].to_numpy())


def with_score(df: DataFrame, model: RuleEnsemble, text: str = "text", out: str = "score") -> DataFrame:
    """df plus the double column `out`; a column of df of that name is replaced."""
    own = [c for c in df.columns if c != out]
    return with_statistics(df, text).select(*ts.unpacked(own), ts.settled(model.column()).alias(out))


def keep_good(df: DataFrame, model: RuleEnsemble, least: float, text: str = "text") -> DataFrame:
    """The rows of df that score `least` or more, with the columns of df."""
    name = ts.free_name(df.columns, "__score")
    return with_score(df, model, text, name).where(F.col(name) >= least).drop(name)

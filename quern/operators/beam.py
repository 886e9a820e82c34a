"""Beam search over a table of next tokens, for many prompts at once.

The hypotheses are rows; a step joins them with the next tokens of their last token, takes out what is banned, keeps the best
of each prompt and ends those that reach the end token. A next-token row holds one token's continuations, best first, only as
many as any hypothesis can need: the beam's candidates plus all that a ban can take from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir

END = "</s>"


def bigrams(sentences: DataFrame) -> DataFrame:
    """(last, token, logp) of sentences (words array<string>): log shares of what follows each word, END after the last one.
    Null sentences and words count for nothing."""
    words = F.concat(F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: w.isNotNull()), F.array(F.lit(END)))
    pairs = sentences.select(F.explode(F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, 2, F.size(words) - 1).alias("b"))).alias("p"))
    counts = pairs.select(F.col("p.a").alias("last"), F.col("p.b").alias("token")).groupBy("last", "token").agg(F.count("*").alias("n"))
    totals = counts.groupBy("last").agg(F.sum("n").alias("all"))
    return counts.join(totals, "last").select("last", "token", F.log(F.col("n") / F.col("all")).alias("logp"))


def _continuations(table: DataFrame, most: int) -> DataFrame:
    """(last, next): the `most` likeliest next tokens of each token, ties by the token."""
    rank = F.row_number().over(Window.partitionBy("last").orderBy(F.desc("logp"), "token"))
    best = table.withColumn("r", rank).where(F.col("r") <= most)
    return best.groupBy("last").agg(F.array_sort(F.collect_list(F.struct("r", "token", "logp"))).alias("next"))


def _repeats(tokens: Column, token: Column, n: int) -> Column:
    """Whether the token would end an n-gram that the tokens hold already."""
    size = F.size(tokens)
    if n == 1:
        return F.array_contains(tokens, token)
    tail = F.slice(tokens, F.greatest(size - n + 2, F.lit(1)), n - 1)
    starts = F.sequence(F.lit(1), size - n + 1)
    same = F.exists(starts, lambda i: (F.slice(tokens, i, n - 1) == tail) & (F.get(tokens, i + n - 2) == token))
    return F.when(size >= n, same).otherwise(False)


def _normal(score: Column, length: Column, alpha: float) -> Column:
    return score / F.pow((5.0 + length) / 6.0, F.lit(alpha))


def search(prompts: DataFrame, table: DataFrame, beam: int = 5, max_len: int = 20, alpha: float = 0.6, no_repeat: int = 0, min_len: int = 0, banned: tuple[str, ...] = ()) -> DataFrame:
    """(id, tokens, score) of prompts (id, last): the best continuation of each.

    A step takes the 2 * beam best extensions of a prompt's hypotheses; an END closes one only from among the first `beam`;
    others fill the beam. A prompt is done when `beam` hypotheses are closed and none open is better, or nothing follows.
    Its result is the closed one with the best score over ((5 + length) / 6) ** alpha (END counts), or else the best open
    one. Ties go to the earlier hypothesis and the smaller token. Prompts that nothing follows, or without last, give no tokens.
    """
    ensure_checkpoint_dir(prompts.sparkSession)
    table = table.where(~F.col("token").isin(list(banned))) if banned else table
    # a ban by n-grams takes at most one token for each earlier one, min_len takes END
    steps = _continuations(table.where("last IS NOT NULL"), 2 * beam + max_len + 1).checkpoint()
    empty = F.array().cast("array<string>")
    alive = prompts.select("id", F.lit(0).alias("place"), empty.alias("tokens"), F.lit(0.0).alias("score"), "last")
    closed = alive.limit(0).select("id", F.lit(0).alias("step"), "place", "tokens", F.lit(0.0).alias("value"))
    first, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy(F.desc("score"), "place", "token")
    for step in range(max_len):
        met = alive.join(steps, "last")
        usable = F.filter("next", lambda x: (x.token != END) if step < min_len else F.lit(True))
        if no_repeat:
            usable = F.filter(usable, lambda x: ~_repeats(F.col("tokens"), x.token, no_repeat))
        each = met.select("id", "place", "tokens", F.col("score").alias("before"), F.explode(F.slice(usable, 1, 2 * beam)).alias("x"))
        ranked = each.select("id", "place", "tokens", F.col("x.token").alias("token"), (F.col("before") + F.col("x.logp")).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * beam)
        ranked = ranked.withColumn("ends", F.col("token") == END).withColumn("nth", F.sum((~F.col("ends")).cast("int")).over(Window.partitionBy("id").orderBy("rank")))
        grown = ranked.where((F.col("ends") & (F.col("rank") <= beam)) | (~F.col("ends") & (F.col("nth") <= beam)))
        grown = grown.select("id", "ends", F.col("rank").alias("place"), F.when(F.col("ends"), F.col("tokens")).otherwise(F.concat("tokens", F.array("token"))).alias("tokens"), "score", F.col("token").alias("last"))
        before = closed.groupBy("id").agg(F.count("*").alias("n_before"), F.max("value").alias("best_before"))
        value = _normal(F.col("score"), F.lit(float(step + 1)), alpha)
        grown = grown.join(before, "id", "left").withColumn("value", value)
        n_closed = F.coalesce("n_before", F.lit(0)) + F.sum(F.col("ends").cast("int")).over(first)
        best_closed = F.greatest(F.coalesce("best_before", F.lit(float("-inf"))), F.coalesce(F.max(F.when(F.col("ends"), F.col("value"))).over(first), F.lit(float("-inf"))))
        best_open = F.max(F.when(~F.col("ends"), F.col("value"))).over(first)
        grown = grown.withColumn("done", (n_closed >= beam) & (best_closed >= best_open)).checkpoint()
        closed = closed.union(grown.where("ends").select("id", F.lit(step + 1).alias("step"), "place", "tokens", "value")).checkpoint()
        # a prompt that nothing follows any more keeps its open hypotheses, as its last resort
        ended = alive.join(grown.select("id").distinct(), "id", "left_anti").where("size(tokens) > 0")
        resort = ended.select("id", F.lit(step + max_len + 1).alias("step"), "place", "tokens", _normal(F.col("score"), F.lit(float(max(step, 1))), alpha).alias("value"))
        closed = closed.union(resort.join(closed.select("id").distinct(), "id", "left_anti")).checkpoint()
        alive = grown.where("NOT ends AND NOT done").select("id", "place", "tokens", "score", "last").checkpoint()
        if alive.isEmpty():
            break
    rest = alive.join(closed.select("id").distinct(), "id", "left_anti").select("id", F.lit(2 * max_len + 1).alias("step"), "place", "tokens", _normal(F.col("score"), F.lit(float(max_len)), alpha).alias("value"))
    best = closed.union(rest).withColumn("r", F.row_number().over(first.orderBy(F.desc("value"), "step", "place"))).where("r = 1")
    return prompts.select("id").join(best, "id", "left").select("id", F.coalesce("tokens", empty).alias("tokens"), F.coalesce("value", F.lit(0.0)).alias("score"))

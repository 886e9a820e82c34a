"""Biased matrix factorisation by stratified block gradient descent, stopped on the validation error.

A rating is the mean, a bias of its user, one of its item and the product of their vectors. Users and items are dealt to p
parts each. A round works on one stratum: p pairs of parts that share neither users nor items, so that they are trained side
by side as if in a row; p rounds meet all ratings. A pair's ratings may lie in several blocks (`split`), whose steps are
averaged by their ratings: a user or item with a third of all ratings is spread over them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import rounds

#: About so many ratings lie in a block.
BLOCK_ROWS = 200_000
#: Numbers of blocks that one pair of parts may have.
MOST_SPLITS = 1 << 20
#: A vector that occurs often in one small batch takes at most so many steps at once.
STEPS_AT_ONCE = 8


def _init(features: np.ndarray, setting: dict) -> np.ndarray:
    w = rounds.hashed_normal(features, setting["factors"] + 1, setting["seed"], 0.1)
    w[:, 0] = 0.0
    return w


def _scores(w: np.ndarray, u: np.ndarray, i: np.ndarray, mu: float) -> np.ndarray:
    return mu + w[u, 0] + w[i, 0] + np.einsum("rk,rk->r", w[u, 1:], w[i, 1:])


def gradients(w: np.ndarray, u: np.ndarray, i: np.ndarray, r: np.ndarray, n: np.ndarray, mu: float, reg: float) -> tuple[float, np.ndarray]:
    """The regularised squared loss summed over ratings, and its gradient by w (column 0: biases)."""
    error = _scores(w, u, i, mu) - r
    loss = n @ (error**2 + reg * ((w[u] ** 2).sum(1) + (w[i] ** 2).sum(1)))
    g = np.zeros_like(w)
    for own, other in ((u, i), (i, u)):
        step = 2 * error[:, None] * np.concatenate([np.ones((len(r), 1)), w[other, 1:]], axis=1) + 2 * reg * w[own]
        np.add.at(g, own, n[:, None] * step)
    return float(loss), g


def _local(block: rounds.Block, setting: dict, number: int):
    w, at, r = block.matrix(), block.fixed(), block.dense[:, 0]
    u, i, mu = at[:, 0], at[:, 1], setting["mu"]
    error = np.clip(_scores(w, u, i, mu), setting["least"], setting["most"]) - r
    loss = block.n @ error**2
    if block.part != rounds.TRAIN:
        return loss, None, None
    start, size = w.copy(), setting["batch"]
    rng = np.random.default_rng([setting["seed"], number, block.number % (1 << 32)])
    for _ in range(setting["passes"]):
        order = rng.permutation(len(r))
        for lo in range(0, len(r), size):
            b = order[lo : lo + size]
            _, g = gradients(w, u[b], i[b], r[b], block.n[b], mu, setting["reg"])
            seen = np.bincount(at[b].ravel(), np.repeat(block.n[b], 2), minlength=len(w))
            w -= setting["lr"] * g / np.maximum(1.0, seen / STEPS_AT_ONCE)[:, None]
    mass = np.bincount(at.ravel(), np.repeat(block.n, 2), minlength=len(w))
    return loss, (w - start) * mass[:, None], mass


MODEL = rounds.Model(_init, _local, rounds.mean_steps)


class Factorisation:
    """What fit() gives: weights (feature, w), the blocks, the setting, and the history of mean squared errors."""

    def __init__(self, blocks: rounds.Blocks, fitted: rounds.Fitted, setting: dict):
        self.blocks, self.fitted, self.setting = blocks, fitted, setting

    def scored(self, part: str) -> DataFrame:
        """(id, n, y, score) of the ratings of a part, within the range of ratings."""
        score = lambda b, s: np.clip(_scores(b.matrix(), b.fixed()[:, 0], b.fixed()[:, 1], s["mu"]), s["least"], s["most"])
        return rounds.predict(self.blocks, self.fitted.weights, score, [self.setting], part).drop("cand")

    def rmse(self, part: str) -> DataFrame:
        return self.scored(part).agg(F.sqrt(F.sum(F.col("n") * (F.col("y") - F.col("score")) ** 2) / F.sum("n")).alias("rmse"))


def fit(ratings: DataFrame, factors: int = 8, epochs: int = 8, patience: int = 2, parts: int | None = None, split: int = 2, lr: float = 0.02, reg: float = 0.05, passes: int = 2, batch: int = 64, seed: int = 0, least: float = 1.0, most: float = 5.0, block_rows: int = BLOCK_ROWS) -> Factorisation:
    """Factors of ratings (u, i, rating, part: train, val or others), trained on `train`, stopped on `val`.

    Rows with a null user, item or rating are left out; without training rows the mean is 0. Users and items that training
    never met keep a bias of 0 and a near-zero vector. Parts grow with the root of the ratings unless given; a pair of parts
    has as many blocks as its own ratings need, `split` at least, so that a hot item's pairs have more.
    """
    rows = ratings.where("u IS NOT NULL AND i IS NOT NULL AND rating IS NOT NULL")
    n, mu = rows.agg(F.count("*"), F.avg(F.when(F.col("part") == rounds.TRAIN, F.col("rating")))).first()
    parts = parts or max(2, math.ceil(math.sqrt(n / (split * block_rows))))
    user, item = F.xxhash64(F.lit("u"), "u"), F.xxhash64(F.lit("i"), "i")
    paired = rows.withColumn("pair", F.pmod(user, F.lit(parts)) * parts + F.pmod(item, F.lit(parts)))
    splits = paired.groupBy("pair").agg(F.greatest(F.lit(split), F.ceil(F.count("*") / block_rows)).alias("splits"))  # parts * parts rows
    sub = F.pmod(F.xxhash64("u", "i", F.lit(seed)), F.col("splits"))
    dealt = paired.join(splits, "pair").select(F.xxhash64("u", "i").alias("id"), "part", (F.col("pair") * MOST_SPLITS + sub).alias("block"), F.array(user, item).alias("features"), F.array(F.col("rating").cast("double")).alias("dense"))
    blocks = rounds.Blocks(dealt)
    setting = {"factors": factors, "lr": lr, "reg": reg, "passes": passes, "batch": batch, "seed": seed, "mu": float(mu or 0.0), "least": least, "most": most}

    def active(number: int):
        pair = F.floor(F.col("block") / MOST_SPLITS)
        return (F.col("part") != rounds.TRAIN) | (F.pmod(pair % parts - F.floor(pair / parts), F.lit(parts)) == number % parts)

    fitted = rounds.fit(blocks, MODEL, [setting], epochs * parts, patience, active=active, every=parts)
    return Factorisation(blocks, fitted, setting)

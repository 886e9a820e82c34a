"""Choice of a setting by its validation loss over seeds, with successive halving, and the choice's figures on the test part.

All settings and seeds are candidates of one training (rounds.fit), so that a round is one job whatever the grid's size. At
each reading the worse part of the settings, by their mean loss over seeds, is left; each candidate keeps its best round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import fmean, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import click, rounds
from quern.operators.scores import auc_by


def halving(settings: int, seeds: int, at: tuple[int, ...]) -> Callable[[int, dict[int, float]], list[int]]:
    """keep() for rounds.fit: at the given readings the better half of the settings (rounded up) goes on."""

    def keep(reading: int, losses: dict[int, float]) -> list[int]:
        if reading not in at:
            return list(losses)
        mean = {s: fmean(losses[c] for c in losses if c // seeds == s) for s in {c // seeds for c in losses}}
        best = sorted(mean, key=lambda s: (mean[s], s))[: math.ceil(len(mean) / 2)]
        return [c for c in losses if c // seeds in best]

    return keep


class Selection:
    """table: one row a setting, best first: name, mean and spread of the best losses over seeds, mean best round, rounds
    trained, chosen. test(): the chosen setting's figures."""

    def __init__(self, names: list[str], grid: list[dict], seeds: int, blocks: rounds.Blocks, fitted: rounds.Fitted, net):
        self.grid, self.seeds, self.blocks, self.fitted, self.net = grid, seeds, blocks, fitted, net
        last = {c: max(h[0] for h in fitted.history if h[1] == c) for c in fitted.best}
        rows = []
        for s, name in enumerate(names):
            best = [fitted.best[s * seeds + k] for k in range(seeds)]
            rows.append((name, fmean(b[1] for b in best), pstdev([b[1] for b in best]), fmean(b[0] for b in best), max(last[s * seeds + k] for k in range(seeds)), s))
        self.rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.chosen = self.rows[0][5]

    def table(self, spark) -> DataFrame:
        rows = [(*r[:5], r[5] == self.chosen) for r in self.rows]
        return spark.createDataFrame(rows, "setting string, loss double, spread double, best_round double, rounds int, chosen boolean")

    def test(self, part: str = "test") -> DataFrame:
        """(seeds, auc, auc_std, log_loss, log_loss_std, best_round) of the chosen setting over its seeds, on the part."""
        mine = range(self.chosen * self.seeds, (self.chosen + 1) * self.seeds)
        rows = click.scored(self.blocks, self.fitted, self.net, self.grid, part).where(F.col("cand").isin(list(mine)))
        p = F.least(F.greatest("score", F.lit(click.LEAST_P)), F.lit(1 - click.LEAST_P))
        loss = rows.groupBy("cand").agg((-F.sum(F.col("n") * (F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))) / F.sum("n")).alias("loss"))
        each = auc_by(rows, "cand").join(loss, "cand")
        best = fmean(self.fitted.best[c][0] for c in mine)
        return each.agg(F.count("*").alias("seeds"), F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_std"), F.avg("loss").alias("log_loss"), F.stddev_pop("loss").alias("log_loss_std"), F.lit(best).alias("best_round"))


def select(rows: DataFrame, kind: str, settings: dict[str, dict], seeds: int, n_rounds: int, patience: int | None = 3, halve_at: tuple[int, ...] = ()) -> Selection:
    """Trains every named setting of a click model for every seed on encoded() rows; the least mean loss on `val` is chosen,
    ties go to the name."""
    names = sorted(settings)
    grid = [settings[n] | {"seed": k} for n in names for k in range(seeds)]
    blocks, fitted, net = click.fit(rows, kind, grid, n_rounds, patience, halving(len(names), seeds, halve_at) if halve_at else None)
    return Selection(names, grid, seeds, blocks, fitted, net)

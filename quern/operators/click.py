"""Click models over numbers and categories, trained in rounds: logistic weights, cross layers, pairwise dots.

Every category of every field is a feature with a vector of its own; the dense parameters are features that all blocks share.
Nothing but losses reaches the driver. Logistic weights take one Adagrad step a round against gradients summed over all
blocks; the networks take small steps inside each block, of which a round keeps the mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import rounds

LEAST_P = 1e-12


def category(field: str, value: Column) -> Column:
    """The feature of a category: not negative, and a null is a category of its own."""
    known = F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("missing"))
    return F.xxhash64(F.lit(field), known).bitwiseAND(F.lit((1 << 63) - 1))


def encoded(df: DataFrame, numbers: list[str], categories: list[str], block_rows: int = 4096) -> DataFrame:
    """Rows for rounds.Blocks of df (id, y 0 or 1, part, numbers, categories). Numbers become sign(x) ln(1 + |x|), less the
    training rows' mean, over their deviation; a null is the mean. Rows without y or part are left out."""
    df = df.where("y IS NOT NULL AND part IS NOT NULL")
    logs = {c: F.signum(F.col(c).cast("double")) * F.log1p(F.abs(F.col(c).cast("double"))) for c in numbers}
    train = F.col("part") == rounds.TRAIN
    sums = [f(F.when(train, x)) for x in logs.values() for f in (F.avg, F.stddev_pop)]
    found = df.agg(F.count("*"), *sums).first()
    scaled = [F.coalesce((x - F.lit(found[1 + 2 * i] or 0.0)) / F.lit((found[2 + 2 * i] or 0.0) + 1e-6), F.lit(0.0)) for i, x in enumerate(logs.values())]
    features = F.array(*[category(c, F.col(c)) for c in categories]) if categories else F.array().cast("array<bigint>")
    return df.select("id", "part", rounds.block_number(F.struct("id", "part"), found[0], block_rows).alias("block"), features.alias("features"), F.array(F.col("y").cast("double"), *scaled).alias("dense"))


def _log_loss(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed log loss and chances."""
    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    q = np.clip(p, LEAST_P, 1 - LEAST_P)
    return float(-(n @ (y * np.log(q) + (1 - y) * np.log(1 - q)))), p


class Logistic:
    """A weight for each number and one for each category. The shared feature -1 holds the bias and the numbers' weights. A
    setting's `mask` (a factor a number) takes numbers out, so that candidates may differ by what they see."""

    shared = (-1,)

    @staticmethod
    def init(features: np.ndarray, setting: dict) -> list[np.ndarray]:
        return [np.zeros(1 + setting["numbers"] if f < 0 else 1) for f in features]

    @staticmethod
    def numbers(block: rounds.Block, setting: dict) -> np.ndarray:
        return block.dense[:, 1:] * np.asarray(setting.get("mask", 1.0))

    @classmethod
    def scores(cls, block: rounds.Block, setting: dict) -> np.ndarray:
        dense, cats = block.vectors[0], np.array([v[0] for v in block.vectors])
        return dense[0] + cls.numbers(block, setting) @ dense[1:] + cats[block.fixed()].sum(1)

    @classmethod
    def local(cls, block: rounds.Block, setting: dict, number: int):
        loss, p = _log_loss(cls.scores(block, setting), block.dense[:, 0], block.n)
        if block.part != rounds.TRAIN:
            return loss, None, None
        g, at = block.n * (p - block.dense[:, 0]), block.fixed()
        k, width = len(block.features), at.shape[1]
        sums = np.bincount(at.ravel(), np.repeat(g, width), minlength=k)
        mass = np.bincount(at.ravel(), np.repeat(block.n, width), minlength=k)
        mass[0] = block.n.sum()
        return loss, [np.concatenate([[g.sum()], cls.numbers(block, setting).T @ g]), *sums[1:, None]], mass


class Network:
    """A network over numbers and category vectors. A kind gives the shapes of its shared parameters, forward and backward."""

    def __init__(self, kind: str):
        self.kind = kind
        self.shared = tuple(-1 - i for i in range(len(self.shapes(1, 1, 2, 2))))

    def shapes(self, numbers: int, fields: int, width: int, hidden: int) -> list[tuple[int, ...]]:
        """Shared parameters: output (bias first), the hidden layer's weights (bias first), then the kind's own."""
        d = numbers + fields * width
        if self.kind == "cross":
            return [(1 + d + hidden,), (1 + d, hidden), (2, d), (2, d)]
        pairs = (fields + 1) * fields // 2
        return [(1 + hidden,), (1 + width + pairs, hidden), (1 + numbers, width)]

    def _own(self, setting: dict) -> list[tuple[int, ...]]:
        return self.shapes(setting["numbers"], setting["fields"], setting["width"], setting["hidden"])

    def init(self, features: np.ndarray, setting: dict) -> list[np.ndarray]:
        shapes, out = self._own(setting), list(rounds.hashed_normal(features, setting["width"], setting["seed"], setting.get("spread", 0.1)))
        for i in np.flatnonzero(features < 0):
            shape = shapes[-1 - features[i]]
            size = int(np.prod(shape))
            out[i] = rounds.hashed_normal(features[i : i + 1], size, setting["seed"], 1.0 / np.sqrt(shape[-1] if len(shape) == 1 else shape[0]))[0]
        return out

    def unpacked(self, block: rounds.Block, setting: dict) -> tuple[list[np.ndarray], np.ndarray]:
        """The shared parameters and the matrix of category vectors; features are in order, so shared ones come first."""
        shapes = self._own(setting)
        k = len(shapes)
        shared = [block.vectors[k - 1 - i].reshape(s).copy() for i, s in enumerate(shapes)]
        return shared, np.stack(block.vectors[k:]) if len(block.vectors) > k else np.zeros((0, setting["width"]))

    def forward(self, shared: list[np.ndarray], x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of rows with numbers x and category vectors e (row, field, width), and what backward needs."""
        out, hid = shared[:2]
        if self.kind == "cross":
            x0 = np.concatenate([x, e.reshape(len(x), -1)], axis=1)
            steps = [x0]
            for w, b in shared[2:]:
                steps.append(x0 * (steps[-1] @ w)[:, None] + b + steps[-1])
            h = np.maximum(hid[0] + x0 @ hid[1:], 0)
            top = np.concatenate([steps[-1], h], axis=1)
            return out[0] + top @ out[1:], (x0, steps, h, top)
        low = shared[2]
        a = low[0] + x @ low[1:]
        z = np.concatenate([np.maximum(a, 0)[:, None, :], e], axis=1)
        i, j = np.tril_indices(z.shape[1], k=-1)
        top = np.concatenate([z[:, 0], np.einsum("rik,rjk->rij", z, z)[:, i, j]], axis=1)
        h = np.maximum(hid[0] + top @ hid[1:], 0)
        return out[0] + h @ out[1:], (a, z, i, j, top, h)

    def backward(self, shared: list[np.ndarray], x: np.ndarray, e: np.ndarray, kept: tuple, g: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients by the shared parameters and by e, for g: the loss's gradient by each score."""
        out, hid = shared[:2]
        if self.kind == "cross":
            x0, steps, h, top = kept
            d = x0.shape[1]
            grads = [np.concatenate([[g.sum()], top.T @ g])]
            down = g[:, None] * out[1:]
            dh = down[:, d:] * (h > 0)
            grads.append(np.vstack([dh.sum(0), x0.T @ dh]))
            dx, dx0, own = down[:, :d], dh @ hid[1:].T, []
            for (w, _), below in zip(reversed(shared[2:]), reversed(steps[:-1]), strict=True):
                t = (dx * x0).sum(1)
                own.append(np.stack([below.T @ t, dx.sum(0)]))
                dx0 = dx0 + dx * (below @ w)[:, None]
                dx = dx + t[:, None] * w
            return grads + own[::-1], (dx0 + dx)[:, x.shape[1] :].reshape(e.shape)
        a, z, i, j, top, h = kept
        dh = g[:, None] * out[1:] * (h > 0)
        dtop, width = dh @ hid[1:].T, z.shape[2]
        pair = np.zeros((len(x), z.shape[1], z.shape[1]))
        pair[:, i, j] = dtop[:, width:]
        dz = np.einsum("rij,rjk->rik", pair + pair.transpose(0, 2, 1), z)
        da = (dz[:, 0] + dtop[:, :width]) * (a > 0)
        return [np.concatenate([[g.sum()], h.T @ g]), np.vstack([dh.sum(0), top.T @ dh]), np.vstack([da.sum(0), x.T @ da])], dz[:, 1:]

    def scores(self, block: rounds.Block, setting: dict) -> np.ndarray:
        shared, vectors = self.unpacked(block, setting)
        return self.forward(shared, block.dense[:, 1:], vectors[block.fixed() - len(shared)])[0]

    def local(self, block: rounds.Block, setting: dict, number: int):
        shared, vectors = self.unpacked(block, setting)
        at, x, y, k = block.fixed() - len(shared), block.dense[:, 1:], block.dense[:, 0], len(shared)
        loss, _ = _log_loss(self.forward(shared, x, vectors[at])[0], y, block.n)
        if block.part != rounds.TRAIN:
            return loss, None, None
        before, vectors = [*(p.copy() for p in shared), vectors], vectors.copy()
        rng = np.random.default_rng([setting["seed"], number, block.number % (1 << 32)])
        lr, seen = setting["lr"] / (1 + setting.get("decay", 0.1) * number), [np.full_like(p, 1e-2) for p in before]
        for _ in range(setting["passes"]):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), setting["batch"]):
                b = order[lo : lo + setting["batch"]]
                e = vectors[at[b]]
                z, kept = self.forward(shared, x[b], e)
                _, p = _log_loss(z, y[b], block.n[b])
                grads, de = self.backward(shared, x[b], e, kept, block.n[b] * (p - y[b]) / block.n[b].sum())
                by_vector = np.zeros_like(vectors)
                np.add.at(by_vector, at[b], de)
                for own, g, s in zip([*shared, vectors], [*grads, by_vector], seen, strict=True):
                    s += g * g
                    own -= lr * g / np.sqrt(s)
        mass = np.bincount(at.ravel() + k, np.repeat(block.n, at.shape[1]), minlength=len(block.features))
        mass[:k] = block.n.sum()
        steps = [(a - b).ravel() * mass[0] for a, b in zip(shared, before, strict=False)][::-1]
        return loss, [*steps, *((vectors - before[-1]) * mass[k:, None])], mass


def model(kind: str) -> tuple[rounds.Model, object]:
    """Of a kind: logistic, cross (cross layers beside a hidden one) or dots (pairwise dots below a hidden layer)."""
    net = Logistic if kind == "logistic" else Network(kind)
    return rounds.Model(net.init, net.local, rounds.adagrad if kind == "logistic" else rounds.mean_steps, net.shared), net


def fit(rows: DataFrame, kind: str, grid: list[dict], n_rounds: int, patience: int | None = 3, keep=None) -> tuple[rounds.Blocks, rounds.Fitted, object]:
    """Trains all settings of the grid on encoded() rows at once: (blocks, what was fitted, the net)."""
    trained, net = model(kind)
    blocks = rounds.Blocks(rows, trained.shared)
    return blocks, rounds.fit(blocks, trained, grid, n_rounds, patience, keep=keep), net


def scored(blocks: rounds.Blocks, fitted: rounds.Fitted, net, grid: list[dict], part: str) -> DataFrame:
    """(cand, id, n, y, score): the chance of label 1 of each row of a part, by each candidate's best round."""
    return rounds.predict(blocks, fitted.weights, lambda b, s: 1 / (1 + np.exp(-np.clip(net.scores(b, s), -35, 35))), grid, part).drop("part")

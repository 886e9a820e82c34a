"""Exact k-nearest-neighbour joins on vectors.

The query side is read in blocks of a bounded number of rows and bytes; each block is sent to the executors, which multiply it
with a few of their own rows at a time and keep the best k of each query and task. Only those meet in the shuffle. Queries of
many blocks (a table against itself) don't pass the driver: both sides are dealt to groups, and each two groups meet in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir

BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20
#: Similarities that a task holds at once.
CELLS = 1 << 20
#: A term that one in so many queries of a block has is a row of its table.
DENSE = 24
#: Pairs of members that a task of co_rated sums up, and rows of a key that are sent at once.
PAIRS, SLICE = 1 << 22, 256
METRICS = ("cosine", "dot", "l2")
#: Blocks of queries that are sent by the driver; with more, both sides are dealt to groups of GROUP_BYTES, in chunks of rows.
SENT_BLOCKS, GROUP_BYTES, CHUNK = 8, 32 << 20, 512


def _similarity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        return (q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)) @ (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)).T
    return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0))


class _Best:
    """The k best rows of each query of a block in one task: a row that can't be among them costs one comparison."""

    def __init__(self, ids: np.ndarray, k: int, digits: int):
        self.ids, self.k, self.digits = ids, k, digits
        self.least = np.full(len(ids), -np.inf)  # the k-th best so far
        self.place, self.own, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = max(16, CELLS // max(1, len(ids)))  # rows that meet the block at once

    def add(self, own: np.ndarray, sim: np.ndarray, above: float = -np.inf) -> None:
        """sim[q, r] of the rows `own`; similarities must be greater than `above`."""
        least = self.least
        if len(own) > self.k + 1 and np.isneginf(least).any():  # k + 1 rows at once, one of which may be the query itself
            least = np.maximum(least, np.partition(sim, len(own) - self.k - 1, axis=1)[:, len(own) - self.k - 1])
        place, row = np.nonzero(sim >= least[:, None] - 10.0**-self.digits)
        values, own = np.round(sim[place, row], self.digits) + 0.0, own[row]
        keep = (values >= self.least[place]) & (values > above) & (self.ids[place] != own)
        self.new.append((place[keep], own[keep], values[keep]))
        if sum(len(n[0]) for n in self.new) > self.k * len(self.ids):
            self.cut()

    def cut(self) -> None:
        place, own, values = (np.concatenate(x) for x in zip((self.place, self.own, self.sim), *self.new, strict=True))
        order, self.new = np.lexsort((own, -values, place)), []
        place, own, values = place[order], own[order], values[order]
        keep = np.arange(len(place)) - np.searchsorted(place, np.arange(len(self.ids)))[place] < self.k
        self.place, self.own, self.sim = place[keep], own[keep], values[keep]
        held = np.bincount(self.place, minlength=len(self.ids))
        full = held == self.k
        self.least[full] = self.sim[(np.cumsum(held) - 1)[full]]

    def batch(self) -> pa.RecordBatch:
        self.cut()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.place], pa.int64()), pa.array(self.own, pa.int64()), pa.array(self.sim, pa.float64())], names=["i", "j", "sim"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", id_column: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, digits: int = 6) -> DataFrame:
    """(i, j, sim, rank): the k most similar rows j of base for each query i, itself excluded; ties by id.

    Similarities are rounded to `digits`, so that ties are the same whatever the order of summation. A task meets a block with
    CELLS / queries rows at once and keeps k rows a query, so its memory doesn't grow with the tables.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    total, size = queries.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, size))))
    blocks = max(1, -(-total // block_rows))
    if blocks > SENT_BLOCKS:
        return _ranked(_dealt_join(queries, base, k, metric, id_column, vector, block_rows, digits, size), k)
    parts = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(id_column), F.lit(blocks)) == b)
        rows = part.select(id_column, vector).toPandas()
        if not len(rows):
            continue
        sent = queries.sparkSession.sparkContext.broadcast((rows[id_column].to_numpy(np.int64), np.stack(rows[vector].to_numpy()).astype(float)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = _Best(ids, k, digits)
            for batch in batches:
                own, lists = batch.column(0).to_numpy(), batch.column(1)
                cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                for lo in range(0, len(own), best.rows):
                    hi = min(lo + best.rows, len(own))
                    x = values[cuts[lo] : cuts[hi]].reshape(hi - lo, -1).astype(float)
                    best.add(own[lo:hi], _similarity(q, x, metric))
            yield best.batch()

        parts.append(base.where(F.col(vector).isNotNull()).select(F.col(id_column).cast("long"), vector).mapInArrow(run, "i long, j long, sim double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], "i long, j long, sim double, rank int")
    return _ranked(reduce(DataFrame.union, parts), k)


def _dealt_join(queries: DataFrame, base: DataFrame, k: int, metric: str, id_column: str, vector: str, block_rows: int, digits: int, size: int) -> DataFrame:
    """(i, j, sim) of knn_join, the best k of each query and group of base. Rows go in chunks to groups of at most about
    GROUP_BYTES, each chunk once for each group of the other side; a task holds one group of both."""
    shuffled = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        df = df.where(F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
        n, kind = df.count(), df.schema["v"].dataType.simpleString()
        groups = max(1, -(-8 * size * n // GROUP_BYTES), min(math.isqrt(2 * shuffled) + 1, n // 256))
        rows = max(1, min(CHUNK, n // (8 * groups)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.arange(0, batch.num_rows, rows)
                ids, lists = batch.column(0), batch.column(1)
                ends = np.append(at, batch.num_rows).astype(np.int32)
                start = lists.offsets.to_numpy()
                flat = lists.values.slice(start[0], start[-1] - start[0])
                packed = [pa.ListArray.from_arrays(pa.array(ends), ids), pa.ListArray.from_arrays(pa.array((start[ends] - start[0]).astype(np.int32)), flat)]
                yield pa.RecordBatch.from_arrays(packed, names=["ids", "v"])

        packed = df.mapInArrow(pack, f"ids array<long>, v {kind}")
        return packed.withColumn(name, F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(groups)).cast("int")), groups

    (left, n_left), (right, n_right) = chunks(queries, "a"), chunks(base, "b")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = left.withColumn("b", each(n_right)), right.withColumn("a", each(n_left))
    parts = max(shuffled, n_left * n_right)
    left, right = (df.repartition(parts, "a", "b") for df in (left, right))

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table.column("ids").chunks)])
        values = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]
        x = np.concatenate(values).reshape(len(ids), -1).astype(float) if len(ids) else np.zeros((0, 0))
        return ids, x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if metric == "cosine" else x

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        (ids, q), (own, x) = arrays(asked), arrays(held)
        out = [pa.RecordBatch.from_pydict({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})]
        for at in range(0, len(ids) if len(own) else 0, block_rows):
            part = q[at : at + block_rows]
            best = _Best(ids[at : at + block_rows], k, digits)
            for lo in range(0, len(own), best.rows):
                best.add(own[lo : lo + best.rows], _similarity(part, x[lo : lo + best.rows], "dot" if metric == "cosine" else metric))
            out.append(best.batch())
        return pa.Table.from_batches(out)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "i long, j long, sim double")


def copies_join(rows: DataFrame, asked: Column, k: int, key: str, near: Callable[[DataFrame, DataFrame], DataFrame], itself: Column, id_column: str = "id") -> DataFrame:
    """(i, j, sim, rank) as of the joins above for rows (id, key, ...) of which those with one key are alike, at the cost of
    the distinct keys: near(queries, base) joins the classes, each under its smallest id; `itself` is a class's similarity to
    its own copies (null: none). The k best rows lie in the k best classes and the own one, and k + 1 ids of a class suffice.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    place = Window.partitionBy(key).orderBy(id_column)
    first = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)  # Spark cuts a key's rows before the shuffle
    classes = first.groupBy(key).agg(F.array_sort(F.collect_list(id_column)).alias("_ids"), *[F.min_by(c, id_column).alias(c) for c in rows.columns if c not in (key, id_column)]).withColumn(id_column, F.col("_ids")[0]).checkpoint()
    named = rows.where(asked).select(F.col(id_column).alias("_q"), key).join(classes.select(key, F.col(id_column).alias("i")), key).select("_q", "i").checkpoint()
    queries = classes.join(named.select(F.col("i").alias(id_column)).distinct(), id_column, "left_semi")
    found = near(queries, classes).select("i", "j", "sim").union(queries.where(itself.isNotNull()).select(F.col(id_column).alias("i"), F.col(id_column).alias("j"), itself.alias("sim")))
    each = found.join(classes.select(F.col(id_column).alias("j"), "_ids"), "j").select("i", F.explode("_ids").alias("j"), "sim")
    lists = _ranked(each, k + 1).select("i", "j", "sim")
    return _ranked(named.join(lists, "i").where("_q <> j").select(F.col("_q").alias("i"), "j", "sim"), k)


def sparse_join(queries: DataFrame, base: DataFrame, k: int, id_column: str = "id", vector: str = "vector", block_bytes: int = BLOCK_BYTES, digits: int = 6) -> DataFrame:
    """(i, j, sim, rank): the k rows of base with the largest products of sparse vectors (array<struct<term long, weight
    double>>, each term once) for each query, itself and rows without a positive product excluded; ties by id.

    A block of queries is sent to the tasks in two parts, of block_bytes at most: terms of many of its queries are a table of
    terms by queries, which is multiplied whole; the others are lists of the queries that have a term, so that a row costs
    its meetings only. The best k of each query and task are shuffled. Frequent terms are never a join key.
    """
    spark = queries.sparkSession
    queries, base = (df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()) for df in (queries, base))
    total, held = queries.agg(F.count("*"), F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()
    terms = queries.select(F.explode(vector).alias("x")).groupBy("x.term").agg(F.count("*").alias("n"))
    common = terms.where(F.col("n") * DENSE >= total).count()
    blocks = max(1, -(-(16 * held + 8 * common * total) // block_bytes), -(-total // BLOCK_ROWS))
    if blocks > 1:  # else each block would make the rows again
        ensure_checkpoint_dir(spark)
        queries, base = queries.checkpoint(), base.checkpoint()
    parts = []
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(id_column), F.lit(blocks)) == b)
        flat = part.select(F.col(id_column).alias("id"), F.explode(vector).alias("x")).select("id", "x.term", "x.weight").toPandas()
        if not len(flat):
            continue
        ids, column = np.unique(flat["id"].to_numpy(np.int64), return_inverse=True)
        terms, row = np.unique(flat["term"].to_numpy(np.int64), return_inverse=True)
        weight, order = flat["weight"].to_numpy(float), np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(terms) + 1))
        common = np.flatnonzero(DENSE * np.diff(cuts) >= len(ids))
        table = np.zeros((len(common), len(ids)))
        mine = np.isin(row, common)
        table[np.searchsorted(common, row[mine]), column[mine]] = weight[mine]
        sent = spark.sparkContext.broadcast((ids, terms, cuts, column[order], weight[order], common, table))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, terms, cuts, columns, weights, common, table = sent.value
            rare, best = np.diff(cuts), _Best(ids, k, digits)
            dense = np.full(len(terms), -1)
            rare[common], dense[common] = 0, np.arange(len(common))
            for batch in batches:
                own, lists = batch.column(0).to_numpy(), batch.column(1)
                ends, flat = lists.offsets.to_numpy(), lists.values
                term, weight = flat.field("term").to_numpy(), flat.field("weight").to_numpy()
                for lo in range(0, len(own), best.rows):
                    hi = min(lo + best.rows, len(own))
                    n, t, w = hi - lo, term[ends[lo] : ends[hi]], weight[ends[lo] : ends[hi]]
                    at = np.repeat(np.arange(n), np.diff(ends[lo : hi + 1]))
                    place = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
                    known = terms[place] == t
                    place, at, w = place[known], at[known], w[known]
                    much = dense[place] >= 0
                    x = np.zeros((n, len(common)))
                    x[at[much], dense[place[much]]] = w[much]
                    sim = (x @ table).ravel()
                    size = rare[place]
                    for cut in _pieces(size, CELLS):
                        s = size[cut]
                        step = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(cuts[place[cut]], s)
                        sim += np.bincount(np.repeat(at[cut] * len(ids), s) + columns[step], np.repeat(w[cut], s) * weights[step], minlength=len(sim))
                    best.add(own[lo:hi], sim.reshape(n, len(ids)).T, 0.0)
            yield best.batch()

        parts.append(base.select(F.col(id_column).cast("long"), vector).mapInArrow(run, "i long, j long, sim double"))
    if not parts:
        return spark.createDataFrame([], "i long, j long, sim double, rank int")
    return _ranked(reduce(DataFrame.union, parts), k)


def co_rated(rows: DataFrame, key: str, member: str, value: str, k: int, shrink: float, asked: Column | None = None) -> DataFrame:
    """(x, y, n, sim, k): for each member asked (else all) the k members with the largest positive similarity: the cosine of
    their values over the n keys that both have, times n / (n + shrink), rounded to 9 digits; ties by id.

    A key's rows are sent, in slices, to each of its members that are asked; a task sums up its own members' pairs and gives
    only the best. There are as many tasks as keep PAIRS pairs each, and no row is made, sorted or shuffled for a pair.
    """
    is_asked = F.lit(True) if asked is None else asked
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(is_asked, 1)).alias("a"))
    total = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("a")), F.lit(0))).first()[0]
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct(F.col(member).cast("long").alias("m"), F.col(value).cast("double").alias("d"), is_asked.alias("a"))
    lists = rows.groupBy(key).agg(F.collect_list(item).alias("l")).where(F.exists("l", lambda m: m["a"]))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / SLICE).cast("int")), lambda c: F.slice("l", c * SLICE + 1, SLICE))
    met = lists.select(F.explode(F.filter("l", lambda m: m["a"])).alias("x"), slices.alias("s")).select("x.m", "x.d", F.explode("s").alias("y"))
    met = met.select(F.col("m").alias("x"), "d", F.col("y.m").alias("y"), F.col("y.d").alias("e")).repartition(max(shuffled, -(-total // PAIRS)), "x")

    def summed(x, y, sums):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, int)
        return x[start], y[start], [np.add.reduceat(s[order], start) if len(start) else s for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, sums, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * 4, [], 0

        def merge():
            a, b = (np.concatenate([own, *(n[c] for n in new)]) for c, own in ((0, x), (1, y)))
            return summed(a, b, [np.concatenate([sums[c], *(n[2][c] for n in new)]) for c in range(4)])

        for batch in batches:
            cuts, ends = batch.column(2).offsets.to_numpy(), batch.column(3).offsets.to_numpy()
            size = np.diff(cuts)
            own, d = np.repeat(batch.column(0).to_numpy(), size), np.repeat(batch.column(1).to_numpy(), size)
            other, e = batch.column(2).values.to_numpy()[cuts[0] : cuts[-1]], batch.column(3).values.to_numpy()[ends[0] : ends[-1]]
            keep = own != other
            own, other, d, e = own[keep], other[keep], d[keep], e[keep]
            new.append((own, other, [np.ones(len(own)), d * e, d * d, e * e]))
            held += len(own)
            if held > max(CELLS, len(x)):
                (x, y, sums), new, held = merge(), [], 0
        x, y, (n, num, qa, qb) = merge()
        q = qa * qb
        sim = np.round(np.where(q > 1e-12, num / np.sqrt(np.where(q > 1e-12, q, 1.0)), 0.0) * n / (n + shrink), 9)
        x, y, n, sim = (v[sim > 0] for v in (x, y, n, sim))
        order = np.lexsort((y, -sim, x))
        x, y, n, sim = (v[order] for v in (x, y, n, sim))
        place = np.arange(len(x)) - np.searchsorted(x, x) + 1
        x, y, n, sim, place = (v[place <= k] for v in (x, y, n, sim, place))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n.astype(np.int64)), pa.array(sim), pa.array(place.astype(np.int32))], names=["x", "y", "n", "sim", "k"])

    return met.mapInArrow(run, "x long, y long, n long, sim double, k int")


def pair_products(pairs: DataFrame, vectors: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(i, j, columns): the products of the sparse vectors (id, columns; null: none) of both rows of each pair. The pairs meet
    whole vectors, so no row is made for a common term; neither side is sent to all tasks."""
    side = lambda c: vectors.select(F.col("id").alias(c), F.struct(*columns).alias(f"_{c}")).hint("merge")
    met = pairs.join(side("i"), "i").join(side("j"), "j")
    flat = [F.coalesce(F.col(f"_{c}.{name}.{f}"), F.array().cast(kind)).alias(f"{c}_{name}_{f}") for name in columns for c in "ij" for f, kind in (("term", "array<long>"), ("weight", "array<double>"))]

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cuts = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]], np.diff(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part, out = batch.slice(lo, 1024), []
                n = part.num_rows
                for name in columns:
                    (s, ns), (t, nt) = (lists(part.column(f"{c}_{name}_term")) for c in "ij")
                    (a, _), (b, _) = (lists(part.column(f"{c}_{name}_weight")) for c in "ij")
                    known, code = np.unique(np.concatenate([s, t]), return_inverse=True)
                    key = np.concatenate([np.repeat(np.arange(n), ns), np.repeat(np.arange(n), nt)]) * max(1, len(known)) + code
                    left, right = key[: len(s)], key[len(s) :]
                    order = np.argsort(right)
                    right, b = np.append(right[order], -1), np.append(b[order], 0.0)
                    at = np.searchsorted(right[:-1], left)
                    out.append(pa.array(np.bincount(left // max(1, len(known)), np.where(right[at] == left, a * b[at], 0.0), minlength=n)))
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("j"), *out], names=["i", "j", *columns])

    return met.select("i", "j", *flat).mapInArrow(run, ", ".join(["i long", "j long", *(f"{c} double" for c in columns)]))


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive places whose sizes sum to about `most`."""
    number = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def retrieval_f1(neighbours: DataFrame, labels: DataFrame, threshold: float, id_column: str = "vec_id", label: str = "label", asked: DataFrame | None = None) -> DataFrame:
    """One row: mean precision, recall and F1 of the kept neighbours against rows of the same label, over the rows asked
    (else all). A row itself counts as a hit, as kept and as one of its label's rows."""
    a, b = labels.select(F.col(id_column).alias("i"), F.col(label).alias("li")), labels.select(F.col(id_column).alias("j"), F.col(label).alias("lj"))
    size = labels.groupBy(F.col(label).alias("li")).agg(F.count("*").alias("true"))
    kept = neighbours.where(F.col("sim") >= threshold).join(a, "i").join(b, "j").groupBy("i").agg(F.count("*").alias("n"), F.sum((F.col("li") == F.col("lj")).cast("int")).alias("hit"))
    rows = (a if asked is None else asked.select(F.col(id_column).alias("i"), F.col(label).alias("li"))).join(size, "li").join(kept, "i", "left").fillna(0, ["n", "hit"])
    tp, pred, true = F.col("hit") + 1, F.col("n") + 1, F.col("true")
    mean = lambda c: F.round(F.avg(c), 9)
    return rows.agg(mean(tp / pred).alias("prec"), mean(tp / true).alias("rec"), mean(2.0 * tp / (pred + true)).alias("f1"), F.sum("n").alias("kept"))

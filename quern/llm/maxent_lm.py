"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). A word's class comes from its last two bytes, so it needs
no vocabulary; the most frequent endings have classes of their own.

The class factor is a softmax over hashed features of the history: the previous word, the word before it (a skip feature)
and the n-gram of the last three classes. The word factor has the features (word) and (word, group of the previous word's
ending). The latter partition the events, so that their maximum-entropy weights have a closed form, the relative
frequencies; they are mixed with the word's share of its class by the number of distinct words seen (c: counts, V: distinct,
p = PRIOR * V(class, group)): (c(word, group) + p * P(word | class)) / (c(class, group) + p), where P(word | class) is
(c(word) + 1) / (c(class) + V(class) + 1), with one share for all unknown words.

Training: every training text takes part once, in one of ROUNDS slices by a hash of the text. In a round all tasks compute
the gradient of their texts of the slice with the same weights; the sums make one update on the driver. The weights don't
depend on the partitions, but for the order of float sums. A task sends ROWS x CLASSES numbers at most, and a round has a
ROUNDS-th of the tasks, so the traffic is that of one pass. The tables of features grow with the number of distinct words
up to MAX_WORD_ROWS; beyond it words share rows.

Counts are exact and grow with the corpus: words and (word, group). The HOT most frequent words are sent to the executors
(a bounded table); all other words meet their counts in a shuffle join, which holds no frequent key. Words are keyed by
64-bit hashes.

Defined results: null text counts as empty, so that it has the end token only; a null id counts as an empty text id when
rows are held out; repeated rows are scored one by one; without training rows all counts are 0 and the class factor is
uniform; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bounded import frequent_rows
from quern.llm.text_stats import kept_apart
from quern.llm.wordhash import BLANK_WORDS, chunks, mix
from quern.llm.workers import released
from quern.session import ensure_checkpoint_dir

CLASSES = 32
END_CLASS = CLASSES - 1
ENDINGS = 4096
#: Groups of the previous word's ending; group 0 is the start of a text.
GROUPS = 16
MIN_WORD_ROWS, MAX_WORD_ROWS, WORDS_A_ROW, CLASS_ROWS = 1 << 10, 1 << 14, 64, 1 << 14
HOT = 1 << 17
BATCH, ROUNDS, STEP, SMOOTH = 4096, 4, 0.5, 10.0
#: The word's share of its class counts as so many times the distinct words seen after a group.
PRIOR = 4
END = mix(np.array([0x5EED], np.uint64))[0]


@dataclass(frozen=True)
class Tokens:
    """The tokens of a run of texts, an end token after each: word hashes, endings, and each text's first token."""

    words: np.ndarray
    endings: np.ndarray
    at: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    hashes, first, lengths, at = BLANK_WORDS.located(data, offsets)
    texts = len(offsets) - 1
    out = Tokens(np.full(len(hashes) + texts, END, np.uint64), np.full(len(hashes) + texts, -1, np.int64), at + np.arange(texts + 1))
    place = np.ones(len(out.words), bool)
    place[out.at[1:] - 1] = False
    out.words[place] = hashes
    if len(hashes):
        last = first + lengths - 1
        pair = BLANK_WORDS.value[data[last]] + np.uint64(3) * BLANK_WORDS.value[data[np.maximum(last - 1, first)]]
        out.endings[place] = (mix(pair) % np.uint64(ENDINGS)).astype(np.int64)
    return out


def classes(t: Tokens, class_of: np.ndarray) -> np.ndarray:
    return np.where(t.endings < 0, END_CLASS, class_of[t.endings])


def _before(t: Tokens, values: np.ndarray, k: int, start) -> np.ndarray:
    """For each token the value of the token k places before it in its text, or `start`."""
    out = np.empty_like(values)
    out[:k], out[k:] = start, values[:-k] if k < len(values) else values[:0]
    for j in range(k):
        at = t.at[:-1] + j
        out[at[at < t.at[1:]]] = start
    return out


def groups(t: Tokens) -> np.ndarray:
    """The group of each token's history: by the ending of the word before it."""
    last = _before(t, t.endings, 1, -1)
    return np.where(last < 0, 0, 1 + mix(last.astype(np.uint64)) % np.uint64(GROUPS - 1)).astype(np.int64)


def word_rows(distinct: int) -> int:
    """Rows of a word feature: the power of two next below a WORDS_A_ROW-th of the distinct words, within bounds."""
    return min(MAX_WORD_ROWS, max(MIN_WORD_ROWS, 1 << max(0, (distinct // WORDS_A_ROW).bit_length() - 1)))


def features(t: Tokens, label: np.ndarray, size: int) -> np.ndarray:
    """Rows of the weight table for each token: three columns. size: rows of a word feature."""
    back = [_before(t, t.words, k, END) for k in (1, 2)]
    seen = [_before(t, label, k, END_CLASS) for k in (1, 2, 3)]
    run = (seen[0] * CLASSES + seen[1]) * CLASSES + seen[2]
    return np.stack(
        [
            (back[0] % np.uint64(size)).astype(np.int64),
            size + (back[1] % np.uint64(size)).astype(np.int64),
            2 * size + (mix(run.astype(np.uint64)) % np.uint64(CLASS_ROWS)).astype(np.int64),
        ],
        1,
    )


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]]
    out += weights[rows[:, 1]]
    out += weights[rows[:, 2]]
    out += bias
    out -= out.max(1, keepdims=True)
    return out


class Gradient:
    """Sums over one task's texts: by row of the weight table, observed minus expected classes, and tokens that have it."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias
        self.total, self.met = np.zeros(weights.shape, np.float64), np.zeros(len(weights), np.int64)

    def add(self, rows: np.ndarray, label: np.ndarray) -> None:
        for lo in range(0, len(rows), BATCH):
            r, y = rows[lo : lo + BATCH], label[lo : lo + BATCH]
            p = np.exp(_logits(self.weights, self.bias, r))
            p /= -p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] += 1
            flat = r.ravel()
            order = np.argsort(flat.astype(np.uint16) if len(self.met) <= 1 << 16 else flat, kind="stable")  # 16 bits sort fast
            ordered = flat[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            touched = ordered[first]
            self.total[touched] += np.add.reduceat(p[order // 3], first, axis=0)
            self.met[touched] += np.diff(np.append(first, len(ordered)))


def updated(weights: np.ndarray, bias: np.ndarray, gradient: np.ndarray, met: np.ndarray) -> np.ndarray:
    """The weights after a round: steps along the gradient, scaled by what each row expects of each class."""
    expected = np.exp(weights + bias)
    expected *= (met / expected.sum(1))[:, None]
    step = np.log((np.maximum(gradient + expected, 0) + SMOOTH) / (expected + SMOOTH))
    return (weights + STEP * step).astype(np.float32)


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """log10 P(class | history) of each token."""
    out = np.empty(len(rows))
    for lo in range(0, len(rows), BATCH):
        z = _logits(weights, bias, rows[lo : lo + BATCH])
        y = label[lo : lo + BATCH]
        out[lo : lo + BATCH] = z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))
    return out / np.log(10)


@dataclass(frozen=True)
class Model:
    """What scoring needs; every table is bounded. By class: c and V; by class and group: c and V; hot words by hash."""

    weights: np.ndarray
    bias: np.ndarray
    class_of: np.ndarray
    hot: np.ndarray
    hot_count: np.ndarray
    hot_groups: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    group_total: np.ndarray
    group_distinct: np.ndarray
    size: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.distinct + 1))

    def within(self, count: np.ndarray, own: np.ndarray, label: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log10 P(word | class, group) of words with these counts, in all and in the group."""
        share = (count + 1) / (self.class_total[label] + self.class_distinct[label] + 1)
        c, v = self.group_total[label, group], PRIOR * self.group_distinct[label, group]
        return np.log10(np.where(v > 0, (own + v * share) / np.maximum(c + v, 1), share))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, ending, n, groups, counts): how often each word occurs, in all and after each group that it was seen after.
    Pairs are summed within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, endings, after = [], [], []
            for _, _, data, offsets in chunks(b.column(0)):
                t = tokens(data, offsets)
                words.append(t.words)
                endings.append(t.endings.astype(np.int32))
                after.append(groups(t).astype(np.uint8))
            if words:
                w, e, g = (np.concatenate(x) for x in (words, endings, after))
                key = mix(w + g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(w[first]), pa.array(e[first]), pa.array(g[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "ending", "g", "n"])

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(released(run), "word long, ending int, g int, n long")
    pairs = rows.repartition("word").groupBy("word", "g").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))
    return pairs.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"), F.collect_list("g").alias("groups"), F.collect_list("n").alias("counts"))


def assign_classes(by_ending: dict[int, int]) -> np.ndarray:
    """Endings -> classes: the most frequent ones have their own, the rest share the remaining half by hash."""
    own = sorted((e for e in by_ending if e >= 0), key=lambda e: (-by_ending[e], e))[: CLASSES - 8]
    shared = np.arange(ENDINGS) % 7 + CLASSES - 8
    shared[own] = np.arange(len(own))
    return shared.astype(np.int64)


def _hot(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words, by hash: their counts, in all and by group."""
    table = frequent_rows(counts, "n", HOT).select("word", "n", "groups", "counts").toArrow().combine_chunks()
    hot = table.column("word").to_numpy().view(np.uint64)
    by_group = np.zeros((len(hot), GROUPS), np.uint32)
    if len(hot):
        lists = table.column("groups").combine_chunks()
        row = np.repeat(np.arange(len(hot)), lists.value_lengths().to_numpy(zero_copy_only=False))
        by_group[row, lists.flatten().to_numpy(zero_copy_only=False)] = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(hot)
    return hot[order], table.column("n").to_numpy()[order], by_group[order]


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of all counts (word, n, groups, counts)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    counts = count_words(docs, text).checkpoint()
    rows = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # ENDINGS + 1 rows at most
    class_of = assign_classes({r.ending: r.n for r in rows})
    total, distinct = sum(r.n for r in rows), sum(r.v for r in rows)
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows:
        k = END_CLASS if r.ending < 0 else class_of[r.ending]
        class_total[k] += r.n
        class_distinct[k] += r.v
    group_total, group_distinct = np.zeros((CLASSES, GROUPS)), np.zeros((CLASSES, GROUPS))
    pairs = counts.select("ending", F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy("ending", F.col("x.groups").alias("g"))
    for r in pairs.agg(F.sum("x.counts").alias("n"), F.count("*").alias("v")).collect():  # (ENDINGS + 1) * GROUPS rows at most
        k = END_CLASS if r.ending < 0 else class_of[r.ending]
        group_total[k, r.g] += r.n
        group_distinct[k, r.g] += r.v
    bias = np.log((class_total + 1) / (total + CLASSES)).astype(np.float32)
    size = word_rows(distinct)
    weights = np.zeros((2 * size + CLASS_ROWS, CLASSES), np.float32)
    if total:
        body = docs.select(F.col(text).cast("string").alias("t"))
        for k in range(ROUNDS):
            part = body.where(F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(ROUNDS)) == k)
            weights = updated(weights, bias, *_gradient(part, weights, bias, class_of, size))
    hot = _hot(counts)
    model = Model(weights, bias, class_of, *hot, int(total), int(distinct), class_total, class_distinct, group_total, group_distinct, size)
    return model, counts.select("word", "n", "groups", "counts")


def _gradient(part: DataFrame, weights: np.ndarray, bias: np.ndarray, class_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of a slice's texts and the tokens that have each row."""
    sent = part.sparkSession.sparkContext.broadcast((weights, bias))
    names = ["row", "met", *(f"w{k}" for k in range(CLASSES))]
    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("met", T.LongType()), *(T.StructField(f"w{k}", T.FloatType()) for k in range(CLASSES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = Gradient(*sent.value)
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                t = tokens(data, offsets)
                label = classes(t, class_of)
                gradient.add(features(t, label, size), label)
        met = np.flatnonzero(gradient.met)
        for lo in range(0, len(met), 8192):
            rows = met[lo : lo + 8192]
            columns = gradient.total[rows].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(gradient.met[rows]), *(pa.array(np.ascontiguousarray(columns[:, k])) for k in range(CLASSES))], names=names)

    tasks = max(1, -(-part._jdf.queryExecution().toRdd().getNumPartitions() // ROUNDS))
    sums = part.coalesce(tasks).mapInArrow(released(run), schema).groupBy("row").agg(F.sum("met").alias("met"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(CLASSES)]).toPandas()
    total, met = np.zeros(weights.shape), np.zeros(len(weights))
    at = sums["row"].to_numpy(np.int64)
    total[at], met[at] = sums[names[2:]].to_numpy(np.float64), sums["met"].to_numpy(np.float64)
    return total, met


_SCORED = "__row long, n_tokens long, n_known long, base double, score double, __tail array<long>, __label array<int>, __group array<int>"


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, base_score and score (both log10)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sent = spark.sparkContext.broadcast(model)
    docs, keep = kept_apart(docs, keep, ("n_tokens", "n_known", "base_score", "score", "base", "__row", "__tail", "__label", "__group", "__known", "__base", "__within", "__text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(_SCORED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            k = len(keep)
            for lo, hi, data, offsets in chunks(b.column(k + 1)):
                t = tokens(data, offsets)
                label = classes(t, m.class_of)
                group = groups(t)
                scores = class_scores(m.weights, m.bias, features(t, label, m.size), label)
                place = np.minimum(np.searchsorted(m.hot, t.words), max(0, len(m.hot) - 1))
                held = m.hot[place] == t.words if len(m.hot) else np.zeros(len(t.words), bool)
                n = np.where(held, m.hot_count[place], 0) if len(m.hot) else np.zeros(len(t.words))
                own = np.where(held, m.hot_groups[place, group], 0) if len(m.hot) else n
                base, known = np.where(held, m.base(n), 0.0), np.where(held, 1, 0)
                scores += np.where(held, m.within(n, own, label, group), 0.0)
                first = t.at[:-1]
                cold = np.flatnonzero(~held)
                cuts = pa.array(np.searchsorted(cold, t.at).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).slice(lo, hi - lo) for i in range(k + 1)),
                        pa.array(np.diff(t.at)),
                        pa.array(np.add.reduceat(known, first)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(scores, first)),
                        pa.ListArray.from_arrays(cuts, _signed(t.words[cold])),
                        pa.ListArray.from_arrays(cuts, pa.array(label[cold].astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(group[cold].astype(np.int32))),
                    ],
                    names=schema.names,
                )

    rows = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), F.col(text).cast("string").alias("__text"))
    scored = rows.mapInArrow(released(run), schema).checkpoint()
    tail = scored.select("__row", F.explode(F.arrays_zip("__tail", "__label", "__group")).alias("x"))
    tail = tail.select("__row", F.col("x.__tail").alias("word"), F.col("x.__label").alias("label"), F.col("x.__group").alias("g"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    flat = lambda table: F.array(*[F.lit(float(x)) for x in np.asarray(table, float).ravel()])
    at = F.col("label") * GROUPS + F.col("g")
    c, v = F.get(flat(model.group_total), at), F.get(flat(PRIOR * model.group_distinct), at)
    place = F.array_position("groups", F.col("g"))
    own = F.coalesce(F.when(place > 0, F.get("counts", (place - 1).cast("int"))), F.lit(0)).cast("double")
    share = (n + 1) / F.get(flat(model.class_total + model.class_distinct + 1), F.col("label"))
    met = tail.join(counts, "word", "left").groupBy("__row").agg(
        F.sum(F.when(n > 0, 1).otherwise(0)).alias("__known"),
        F.sum(F.log10((n + 1) / F.lit(float(model.total + model.distinct + 1)))).alias("__base"),
        F.sum(F.log10(F.when(v > 0, (own + v * share) / (c + v)).otherwise(share))).alias("__within"),
    )
    out = scored.drop("__tail", "__label", "__group").join(met, "__row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*keep, "n_tokens", (F.col("n_known") + zero("__known")).alias("n_known"), (F.col("base") + zero("__base")).alias("base_score"), (F.col("score") + zero("__within")).alias("score"))


def held_out(doc_id: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder

"""Benchmark decontamination by winnowing.

Fingerprints are hashes of K-word grams; of each WINDOW consecutive grams the smallest is kept. Any span of
K + WINDOW - 1 = SPAN words that two texts share selects the same fingerprint in both, so joining the selected
fingerprints finds every shared span. Each joined fingerprint is extended to the SPAN-word windows that contain it,
and those that the benchmark holds mark their words.

Items shorter than SPAN words are one window of all their words; documents are probed for them by their first word and
then by the whole window.

The benchmark is read in blocks whose size in bytes is checked; each block's tables are sent to the executors once and
all documents pass them, so no document row is shuffled. Beyond one block the hits of a document are merged by its row.

Defined results: null text has no words; items without words or id never occur; items that share an id count once;
repeated documents are judged one by one; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text_stats import free_name
from quern.llm.wordhash import ALNUM_WORDS, chunks, gram_starts, grams
from quern.llm.workers import released

SPAN, K = 13, 8
WINDOW = SPAN - K + 1
BLOCK_BYTES = 64 << 20


def selected(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the selected grams of texts of SPAN words or more: the rightmost smallest of each window."""
    h = grams(words, K)
    starts = gram_starts(at, SPAN)
    if not len(starts):
        return starts, h[:0]
    best, where = h[starts], starts.copy()
    for j in range(1, WINDOW):
        other = h[starts + j]
        less = other <= best
        best = np.where(less, other, best)
        where[less] = starts[less] + j
    keep = np.append(True, where[1:] != where[:-1])
    return where[keep], best[keep]


class Probe:
    """The tables of one block of the benchmark."""

    def __init__(self, ids: list[str], texts: list[str]):
        column = pa.array(texts, pa.large_string())
        prints, windows, owners, short = [], [], [], {}
        for lo, hi, data, offsets in chunks(column):
            words, at = ALNUM_WORDS.hashes(data, offsets)
            prints.append(selected(words, at)[1])
            full = gram_starts(at, SPAN)
            windows.append(grams(words, SPAN)[full])
            owners.append(lo + np.searchsorted(at, full, "right") - 1)
            for d in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SPAN)):
                own = words[at[d] : at[d + 1]]
                short.setdefault(len(own), []).append((int(own[0]), int(grams(own, len(own))[0]), lo + int(d)))
        self.ids = ids
        self.prints = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]))
        self.full = self._table(np.concatenate([*windows, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)]))
        self.short = {n: (np.unique(np.array([x[0] for x in v], np.uint64)), self._table(np.array([x[1] for x in v], np.uint64), np.array([x[2] for x in v]))) for n, v in short.items()}

    @staticmethod
    def _table(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, and where the owners of each begin."""
        pairs = np.unique(np.stack([keys, owners.astype(np.uint64)], 1), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
        unique, first = np.unique(pairs[:, 0], return_index=True)
        return unique, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)

    def _owned(self, table, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(index into keys, owners) of the keys that the table holds."""
        unique, first, owners = table
        i = np.searchsorted(unique, keys)
        i[i == len(unique)] = 0
        for n in np.flatnonzero(unique[i] == keys) if len(unique) else ():
            yield int(n), owners[first[i[n]] : first[i[n] + 1]]

    def hits(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(position, length, owners) of every window of the block in the texts."""
        where, h = selected(words, at)
        joined = where[_member(self.prints, h)]
        if len(joined):
            doc = np.searchsorted(at, joined, "right") - 1
            starts = (joined[:, None] - np.arange(WINDOW)[None, :]).ravel()
            inside = (starts >= np.repeat(at[doc], WINDOW)) & (starts + SPAN <= np.repeat(at[doc + 1], WINDOW))
            starts = np.unique(starts[inside])
            span = np.lib.stride_tricks.sliding_window_view(words, SPAN)[starts]
            for n, owners in self._owned(self.full, _rows(span)):
                yield int(starts[n]), SPAN, owners
        for length, (firsts, table) in self.short.items():
            starts = gram_starts(at, length)
            starts = starts[_member(firsts, words[starts])]
            if len(starts):
                for n, owners in self._owned(table, _rows(np.lib.stride_tricks.sliding_window_view(words, length)[starts])):
                    yield int(starts[n]), length, owners


def _member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    i = np.searchsorted(table, keys)
    i[i == len(table)] = 0
    return table[i] == keys


def _rows(span: np.ndarray) -> np.ndarray:
    """The gram hash of each row of words."""
    n, k = span.shape
    return grams(np.ascontiguousarray(span).ravel(), k)[::k] if n else np.zeros(0, np.uint64)


_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _probe(column: pa.Array, probe: Probe) -> tuple[list[int], list, list, list]:
    """Per text: words, and the merged hit intervals and item ids."""
    counts, starts, ends, items = [], [], [], []
    for lo, hi, data, offsets in chunks(column):
        words, at = ALNUM_WORDS.hashes(data, offsets)
        found: dict[int, list] = {}
        for p, n, owners in probe.hits(words, at):
            d = int(np.searchsorted(at, p, "right")) - 1
            found.setdefault(d, []).append((p - int(at[d]), n, owners))
        counts += np.diff(at).tolist()
        for d in range(hi - lo):
            s, e, own = [], [], set()
            for p, n, owners in sorted(found.get(d, ()), key=lambda x: x[:2]):
                own.update(owners.tolist())
                if s and p <= e[-1]:
                    e[-1] = max(e[-1], p + n)
                else:
                    s.append(p)
                    e.append(p + n)
            starts.append(s)
            ends.append(e)
            items.append(sorted({probe.ids[i] for i in own}))
    return counts, starts, ends, items


def _blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark in blocks of about `size` bytes."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t").cast("double"))).first()[0] or 0
    n = int(total // size) + 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        got = part.collect()
        yield [r[0] for r in got], [r[1] for r in got]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs plus the struct `out`: n_words, starts and ends (word intervals that are hit), items (ids as strings)."""
    own = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in own]
    parts = []
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    schema = T.StructType([*own, T.StructField(out, _HITS)])
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    for ids, texts in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(Probe(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts, starts, ends, items = _probe(b.column(b.schema.get_field_index(text)), sent.value)
                hits = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*b.columns, hits], names=[*names, out])

        parts.append(docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(released(run), schema))
    if len(parts) == 1:
        return parts[0]
    return _merged(parts, names, text, out)


def _merged(parts: list[DataFrame], names: list[str], text: str, out: str) -> DataFrame:
    """The hits of several blocks as one row per document: equal rows are numbered, so that each is merged with itself."""
    from functools import reduce

    from pyspark.sql import Window

    key, no, w, s, i = (free_name([*names, out], n) for n in ("__key", "__no", "__w", "__s", "__i"))
    keyed = []
    for p in parts:
        p = p.withColumn(key, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])), 256))
        keyed.append(p.withColumn(no, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))))
    both = reduce(DataFrame.unionByName, keyed)
    firsts = [F.first(F.col(f"`{c}`")).alias(c) for c in names]
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col(f"{out}.starts").alias("s"), F.col(f"{out}.ends").alias("e")))))
    rows = both.groupBy(key, no).agg(*firsts, F.max(f"{out}.n_words").alias(w), spans.alias(s), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{out}.items")))).alias(i))
    joined = F.aggregate(
        s,
        F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).e >= x.s), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).s.alias("s"), F.greatest(F.element_at(acc, -1).e, x.e).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x.s.alias("s"), x.e.alias("e"))))),
    )
    rows = rows.withColumn(s, F.when(F.size(s) > 0, joined).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")))
    return rows.select(*[F.col(f"`{c}`") for c in names], F.struct(F.col(w).alias("n_words"), F.col(f"{s}.s").alias("starts"), F.col(f"{s}.e").alias("ends"), F.col(i).alias("items")).alias(out))


def hit_words(out: str = "hits"):
    """How many words the intervals hold."""
    return F.aggregate(F.zip_with(f"{out}.ends", f"{out}.starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)


def is_contaminated(out: str = "hits"):
    return (hit_words(out) > 0) & (20 * hit_words(out) >= F.col(f"{out}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The clean rows of docs, with its columns."""
    name = free_name(docs.columns, "__hits")
    return mark(docs, benchmark, text, out=name).where(~is_contaminated(name)).drop(name)


def ids_digest(items: list[str]) -> str:
    """The digest of item ids as op9 reports it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

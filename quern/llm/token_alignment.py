"""How two vocabularies cut the same texts: aligned groups, and how sure each linked pair of ids is over the corpus.

Side A is a byte-level byte-pair file of the tokenizers library and sees a space before the text; side B is a SentencePiece
model, which adds that space itself. Byte offsets at which tokens of both end cut a text into groups; all A-B occurrence
pairs of a group are linked.

Postings cogroup: a task encodes its documents and deals what it finds by buckets of A ids, in one exchange: first, how
many of its documents hold each id pair (summed before the shuffle), then each document's pairs with their multiplicities.
The exchange sorts (and spills) each partition so that the counts come first: a task sums them, takes each A id's highest
count, and then reads the documents' pairs as a stream, emitting one contribution a document and bucket. These are summed by
document. A bucket's documents are split over several partitions, each with all counts of the bucket, so that an id which
is in all documents does not stay in one task. Contributions are keyed by a 128-bit digest of the row, never by a row
number: recomputed tasks give the same keys.

Bounds: a task holds the distinct pairs of its documents up to `HELD` (then they go out), and in the second stage the distinct
pairs of one bucket, which are bounded by the vocabularies. A run of texts holds few links: long groups are paired by distinct
ids with multiplicities, bucket by bucket where even these are many.

Defined results: null and empty texts, and texts that one side doesn't give back byte for byte (such as texts with U+2581),
have no tokens: zeros and no groups; rows that repeat kept columns and text count as a document each and come out as often;
an empty table gives no rows; a kept column with the name of a result comes out with underscores behind.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text_stats import kept_apart
from quern.llm.token_counts import PIECES, byte_letters, follows_ranks, unsure
from quern.llm.workers import released
from quern.llm.wordhash import mix

RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Texts are encoded in runs of about so many characters.
RUN_CHARS = 1 << 18
#: Distinct pairs that a task holds before their counts go out.
HELD = 1 << 20
#: A document with more distinct pairs in its groups than this is paired bucket by bucket.
PAIRS_AT_ONCE = 1 << 21
#: Buckets of A ids, at least and at most, and the least number of partitions of a bucket.
BUCKETS, MOST_BUCKETS, SPLITS = 16, 256, 4
COUNTS, POSTINGS, DOCUMENT = 0, 1, 2


class Side:
    """One vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, raw: bytes, kind: str, ranked: bool = False):
        """ranked: merging whatever pair makes the earliest token gives the same ids as the .json's list of merges (see
        follows_ranks), so that the faster library of the two may encode."""
        if kind == "json":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(raw.decode())
            self.library.encode_special_tokens = True
            value = {c: b for b, c in enumerate(byte_letters())}
            vocab = self.library.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
            self.by_rank = None
            if ranked:
                import tiktoken

                plain = self.library.get_vocab(with_added_tokens=False).values()
                self.by_rank = tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks={self.bytes[i]: i for i in plain}, special_tokens={})
            self.encode = lambda texts: [self._behind_space(t) for t in texts]
        else:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_proto=raw)
            self.bytes = [self._piece(i) for i in range(self.library.get_piece_size())]
            self.encode = lambda texts: self.library.encode(texts, num_threads=1)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        #: An id followed by each of the three signs that may follow it.
        self.names = [[f"{i}{sign}" for i in range(len(self.bytes))] for sign in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        if self.library.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def _behind_space(self, text: str) -> list[int]:
        if self.by_rank is not None and (text.isascii() or not unsure(text)):
            return self.by_rank.encode_ordinary(" " + text)
        return self.library.encode(" " + text, add_special_tokens=False).ids

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Aligned:
    """The groups of one text."""

    def __init__(self, a: Side, b: Side, ids_a: list[int], ids_b: list[int]):
        self.a, self.b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])
        last = np.zeros(int(end_a[-1]) + 1, bool)
        last[end_a] = True
        self.cut_b = last[end_b]
        last[:] = False
        last[end_b] = True
        self.cut_a = last[end_a]
        self.n_groups = int(self.cut_a.sum())
        self.group_a = np.cumsum(self.cut_a) - self.cut_a
        self.group_b = np.cumsum(self.cut_b) - self.cut_b
        self.in_a, self.in_b = np.bincount(self.group_a), np.bincount(self.group_b)
        self.n_links = int(self.in_a @ self.in_b)

    def digest(self, a: Side, b: Side) -> bytes:
        """Of the ids as text: groups of A ids, a bar and B ids, with semicolons between."""
        names = np.empty(len(self.a) + len(self.b), object)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]
        for side, ids, cut, at, sign in ((a, self.a, self.cut_a, at_a, 1), (b, self.b, self.cut_b, at_b, 2)):
            inner, outer = side.names[0], side.names[sign]
            names[at] = [outer[i] if c else inner[i] for i, c in zip(ids.tolist(), cut.tolist(), strict=True)]
        return hashlib.sha256("".join(names)[:-1].encode()).digest()

    def pairs(self, n_b: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of (pair keys a * n_b + b, how often linked); a key is in one run only."""
        if self.n_links <= PAIRS_AT_ONCE:
            yield _summed(*self._linked(self.a, self.group_a, np.ones(len(self.a), np.int64), self.b, self.group_b, np.ones(len(self.b), np.int64), n_b))
            return
        (ga, ia), ta = np.unique(np.stack([self.group_a, self.a]), axis=1, return_counts=True)
        (gb, ib), tb = np.unique(np.stack([self.group_b, self.b]), axis=1, return_counts=True)
        if int(np.bincount(ga) @ np.bincount(gb)) <= PAIRS_AT_ONCE:
            yield _summed(*self._linked(ia, ga, ta, ib, gb, tb, n_b))
            return
        for bucket in range(buckets):
            mine = bucket_of(ia, buckets) == bucket
            if mine.any():
                yield _summed(*self._linked(ia[mine], ga[mine], ta[mine], ib, gb, tb, n_b))

    @staticmethod
    def _linked(ia, ga, ta, ib, gb, tb, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and multiplicities of all pairs of a group; ids are in order of groups."""
        in_b = np.bincount(gb, minlength=int(ga[-1]) + 1)
        first = np.cumsum(in_b) - in_b
        times = in_b[ga]
        offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(first[ga], times) + offset
        return np.repeat(ia, times) * n_b + ib[at], np.repeat(ta, times) * tb[at]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times[order], first)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(values: np.ndarray, ones: bytes | None = None) -> bytes:
    """Whole numbers in as few bytes as the largest needs, behind one byte that says how many; `ones`, if given, for all 1."""
    most = int(values.max())
    if ones is not None and most == 1:
        return ones
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes, n: int = 0) -> np.ndarray:
    if not raw:
        return np.ones(n, np.int64)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _rows(part: np.ndarray, owner: np.ndarray, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(partition, owner, packed keys, packed values) of each run of equal partition and owner."""
    order = np.lexsort((keys, owner, part))
    part, owner, keys, values = part[order], owner[order], keys[order], values[order]
    cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        yield int(part[lo]), int(owner[lo]), _packed(keys[lo:hi]), _packed(values[lo:hi], b"")


class _Finder:
    """Encodes runs of rows and deals out their documents, postings and pair counts."""

    def __init__(self, a: Side, b: Side, buckets: int, splits: int):
        self.a, self.b, self.buckets, self.splits, self.n_b = a, b, buckets, splits, len(b.bytes)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def counts(self, force: bool = False) -> list[tuple]:
        """The held pair counts, once they are many or the task ends: to every partition of their bucket."""
        if not self.held or not (force or self.n_held > HELD):
            return []
        keys, n = _summed(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))
        self.held, self.n_held = [(keys, n)], len(keys)
        if not force and len(keys) <= HELD // 2:
            return []
        self.held, self.n_held, out = [], 0, []
        for bucket, _, packed, values in _rows(bucket_of(keys // self.n_b, self.buckets), np.zeros(len(keys), np.int64), keys, n):
            out += [(bucket * self.splits + s, COUNTS, None, None, packed, values) for s in range(self.splits)]
        return out

    def run(self, texts: list[str], high: np.ndarray, low: np.ndarray) -> tuple[list[tuple], list[tuple]]:
        """(rows of postings, (n_a, n_b, n_groups, n_links, digest) of each text)."""
        found: list[tuple] = []
        owners, keys, times, rows = [], [], [], []
        for at, (text, ids_a, ids_b) in enumerate(zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True)):
            raw = (" " + text).encode()
            if not text or self.a.joined(ids_a) != raw or self.b.joined(ids_b) != raw:
                found.append((0, 0, 0, 0, None))
                continue
            aligned = Aligned(self.a, self.b, ids_a, ids_b)
            found.append((len(ids_a), len(ids_b), aligned.n_groups, aligned.n_links, aligned.digest(self.a, self.b)))
            for k, t in aligned.pairs(self.n_b, self.buckets):
                owners.append(np.full(len(k), at))
                keys.append(k)
                times.append(t)
                if len(k) > HELD // 4:
                    rows += self._dealt(owners, keys, times, high, low)
        return rows + self._dealt(owners, keys, times, high, low), found

    def _dealt(self, owners: list, keys: list, times: list, high: np.ndarray, low: np.ndarray) -> list[tuple]:
        """Rows of the collected pairs, which are then forgotten but for their counts."""
        if not keys:
            return []
        owner, key, time = map(np.concatenate, (owners, keys, times))
        owners.clear(), keys.clear(), times.clear()
        self.held.append(_summed(key, np.ones(len(key), np.int64)))
        self.n_held += len(self.held[-1][0])
        split = (low.view(np.uint64) % np.uint64(self.splits)).astype(np.int64)
        part = bucket_of(key // self.n_b, self.buckets) * self.splits + split[owner]
        return [(p, POSTINGS, int(high[o]), int(low[o]), k, t) for p, o, k, t in _rows(part, owner, key, time)]


def _sides(sent_a, sent_b, cache: dict = {}) -> tuple[Side, Side]:  # noqa: B006 - one pair of vocabularies a worker
    key = (sent_a.value[0], sent_b.value[0])
    if key not in cache:
        cache.clear()
        cache[key] = (Side(sent_a.value[1], "json", sent_a.value[2]), Side(sent_b.value[1], "model"))
    return cache[key]


def _read(path: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), raw


_FIXED = [("part", T.IntegerType(), pa.int32()), ("kind", T.ByteType(), pa.int8()), ("high", T.LongType(), pa.int64()), ("low", T.LongType(), pa.int64()), ("keys", T.BinaryType(), pa.binary()), ("vals", T.BinaryType(), pa.binary()),
          ("n_a", T.LongType(), pa.int64()), ("n_b", T.LongType(), pa.int64()), ("n_groups", T.LongType(), pa.int64()), ("n_links", T.LongType(), pa.int64()), ("groups", T.BinaryType(), pa.binary()), ("n_rows", T.LongType(), pa.int64())]
_SUMS = ("n_best", "count_sum")


def align(df: DataFrame, json_path: str, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), partitions: int | None = None) -> DataFrame:
    """The columns `keep` of df with n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is in as many documents as
    any pair of its A id), count_sum (documents holding the link's pair, over links) and groups_sha256."""
    spark = df.sparkSession
    context = spark.sparkContext
    digest_a, raw = _read(json_path)
    if (json.loads(raw)["model"]["type"], json.loads(raw)["pre_tokenizer"]["type"]) != ("BPE", "ByteLevel"):
        raise ValueError("side A is not a byte-level vocabulary")
    sent_a, sent_b = context.broadcast((digest_a, raw, follows_ranks(json_path))), context.broadcast(_read(model_path))
    wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(BUCKETS, wanted // SPLITS))
    splits = max(SPLITS, -(-wanted // buckets))
    df, keep = kept_apart(df, keep, (*RESULTS, "__text", "__high", "__low", "kept", *(n for n, _, _ in _FIXED), *_SUMS))
    kept = T.StructType([df.schema[c] for c in keep])
    schema = T.StructType([*(T.StructField(n, t) for n, t, _ in _FIXED), T.StructField("kept", kept)])
    row = [F.col(f"`{c}`") for c in keep]
    hashed = [x for c in row for x in (c, c.isNull())]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = df.select(*row, content.alias("__text")).select(F.struct(*row).alias("kept"), "__text", F.xxhash64(*hashed, "__text").alias("__high"), F.xxhash64(F.lit(1), *hashed, "__text").alias("__low"))

    def columns_of(rows: list[tuple]) -> list[pa.Array]:
        """Arrow columns of rows of which the last fields may be missing."""
        given = list(zip(*rows, strict=True))
        return [pa.array(given[i], t) if i < len(given) else pa.nulls(len(rows), t) for i, (_, _, t) in enumerate(_FIXED)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, struct = _Finder(*_sides(sent_a, sent_b), buckets, splits), None
        names = [*(n for n, _, _ in _FIXED), "kept"]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows), 1 << 13):
                some = rows[lo : lo + (1 << 13)]
                yield pa.RecordBatch.from_arrays([*columns_of(some), pa.nulls(len(some), struct)], names=names)

        for b in batches:
            struct = b.column(0).type
            column = b.column(1)
            high, low = (b.column(i).to_numpy() for i in (2, 3))
            lo = 0
            while lo < b.num_rows:
                texts, size, hi = [], 0, lo
                while hi < b.num_rows and (hi == lo or size < RUN_CHARS):
                    texts.append(column[hi].as_py())
                    size, hi = size + len(texts[-1]), hi + 1
                rows, found = finder.run(texts, high[lo:hi], low[lo:hi])
                yield from out(rows)
                parts = ((low[lo:hi].view(np.uint64) >> np.uint64(7)) % np.uint64(buckets * splits)).tolist()
                documents = [(p, DOCUMENT, h, w, None, None, *f, 1) for p, h, w, f in zip(parts, high[lo:hi].tolist(), low[lo:hi].tolist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns_of(documents), b.column(0).slice(lo, hi - lo)], names=names)
                yield from out(finder.counts())
                lo = hi
        yield from out(finder.counts(force=True))

    out_schema = T.StructType([*(T.StructField(n, t) for n, t, _ in _FIXED if n in ("high", "low", "n_a", "n_b", "n_groups", "n_links", "groups", "n_rows")), *(T.StructField(n, T.LongType()) for n in _SUMS), T.StructField("kept", kept)])
    carried = [n for n in out_schema.names if n not in _SUMS]

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_b = len(_sides(sent_a, sent_b)[1].bytes)
        state: dict = {}
        for b in batches:
            part, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
                run = b.slice(lo, hi - lo)
                if state.get("part") != part[lo]:
                    state = {"part": part[lo], "held": [], "n": 0}
                if kind[lo] == DOCUMENT:
                    zeros = pa.array(np.zeros(hi - lo, np.int64))
                    yield pa.RecordBatch.from_arrays([zeros if n in _SUMS else run.column(n) for n in out_schema.names], names=out_schema.names)
                elif kind[lo] == COUNTS:
                    _add_counts(state, run)
                else:
                    for best, total, some in _contributions(state, run, n_b):
                        values = {"n_best": pa.array(best), "count_sum": pa.array(total)}
                        yield pa.RecordBatch.from_arrays([values[n] if n in values else some.column(n) for n in out_schema.names], names=out_schema.names)

    dealt = source.mapInArrow(released(find), schema)
    dealt = dealt.repartitionById(buckets * splits, F.col("part")).sortWithinPartitions("kind")
    given = dealt.mapInArrow(released(contribute), out_schema)
    summed = given.groupBy("high", "low").agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.max(c).alias(c) for c in carried if c not in ("high", "low", "n_rows", "kept")],
        F.first("kept", ignorenulls=True).alias("kept"),
    )
    each = [(F.col(c) / F.col("n_rows")).cast("long").alias(c) for c in _SUMS]
    result = summed.select(
        *[F.col("kept").getField(c).alias(c) for c in keep], "n_a", "n_b", "n_groups", "n_links", *each, F.coalesce(F.lower(F.hex("groups")), F.lit("")).alias("groups_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("__copy")
    )
    return result.drop("__copy")


def _add_counts(state: dict, run: pa.RecordBatch) -> None:
    """Adds partial pair counts to the bucket's; what is held is summed whenever it has doubled."""
    for keys, n in zip(run.column("keys").to_pylist(), run.column("vals").to_pylist(), strict=True):
        keys = _unpacked(keys)
        state["held"].append((keys, _unpacked(n, len(keys))))
        state["n"] += len(keys)
    if state["n"] > max(HELD, 2 * state.get("distinct", 0)):
        _sum_counts(state)


def _sum_counts(state: dict) -> tuple[np.ndarray, np.ndarray]:
    if len(state["held"]) > 1:
        state["held"] = [_summed(np.concatenate([k for k, _ in state["held"]]), np.concatenate([n for _, n in state["held"]]))]
    state["n"] = state["distinct"] = len(state["held"][0][0])
    return state["held"][0]


def _contributions(state: dict, run: pa.RecordBatch, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(links with their A id's highest count, counts over links) of each posting row, in runs."""
    if "best" not in state:
        keys, n = _sum_counts(state)
        ids = keys // n_b
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(ids))))
        state["keys"], state["counts"], state["best"] = keys, n, n == most
    for lo in range(0, run.num_rows, 1 << 10):
        some = run.slice(lo, 1 << 10)
        keys = [_unpacked(k) for k in some.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        times = np.concatenate([_unpacked(t, n) for t, n in zip(some.column("vals").to_pylist(), sizes.tolist(), strict=True)])
        at = np.searchsorted(state["keys"], np.concatenate(keys))
        first = np.cumsum(sizes) - sizes
        yield np.add.reduceat(times * state["best"][at], first), np.add.reduceat(times * state["counts"][at], first), some

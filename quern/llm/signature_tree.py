"""N-gram Jaccard join with signature trees: exact connected classes of near-duplicate texts.

A text's set holds the 64-bit hashes of its distinct 5-word shingles (a text of fewer words has one shingle of all its
words). Two texts link when 100 * |intersection| >= 75 * |union|.

1. Texts with equal sets form one class, keyed by a digest; from here on only classes matter.
2. Two linked sets share one of their first n - ceil(0.75 n) + 1 shingles in any common order, which for the smaller set
   is even one of its first n - ceil(1.5 n / 1.75) + 1, as at least 0.75 / 1.75 of both sizes is common. So classes that
   share a shingle of such prefixes meet in a bucket, if one of them has it in the shorter prefix. The order puts frequent
   shingles (found in a sample of the documents; any order is right) last, so that common passages make no large buckets.
   Buckets with the same members are kept once.
3. In each bucket a signature tree is built: its leaves hold classes, nodes the OR of their token bitmaps, their range
   of set sizes and their largest number of bitmap collisions. A dual traversal drops node pairs whose sizes can't link
   or whose largest possible overlap is too small, down to pairs of classes. A pair is looked at in the first of its
   common buckets only: each class carries its earlier buckets, each node those that all its classes have, and node
   pairs with a common earlier bucket are dropped whole.
4. Pairs are checked on the full sets, and linked classes contracted to components.

Large buckets are split in blocks. The first rounds look inside blocks only and link each class with its best earlier
partner, which contracts groups of near copies in a number of pairs linear in their size; the last round traverses all
pairs of blocks that can hold classes of different components, so that no link between components is lost.

Defined results: null or blank text has an empty set and links with nothing; rows without id too (their component is
null); repeated rows get one component; other columns never matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bounded import most_frequent
from quern.llm.components import components
from quern.llm.text_stats import free_name
from quern.llm.wordhash import BLANK_WORDS, chunks, gram_starts, grams, mix
from quern.llm.workers import released
from quern.session import ensure_checkpoint_dir

SHINGLE, PERCENT = 5, 75
#: A bitmap has the power of two next above 1.5 times the set's size, in bits, and LEAST_BITS at least.
LEAST_BITS = 1024
LEAF, FANOUT = 32, 8
#: Buckets of so many classes are trees of one leaf, whose pairs are all looked at in the first round.
ALL_PAIRS = 8
BLOCK = 1024
SAMPLE, FREQUENT, MAX_FREQUENT = 8, 2, 1 << 18
#: Ids of documents to check that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
ROOT_SHARE = 256


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in chunks(column):
        words, at = BLANK_WORDS.hashes(data, offsets)
        starts = gram_starts(at, SHINGLE)
        all_of = grams(words, SHINGLE)[starts]
        counts = np.maximum(np.diff(at) - SHINGLE + 1, 0)
        ends = np.cumsum(counts)
        for d in range(hi - lo):
            n = at[d + 1] - at[d]
            yield np.unique(all_of[ends[d] - counts[d] : ends[d]]) if n >= SHINGLE else grams(words[at[d] : at[d + 1]], n) if n else all_of[:0]


def digest(u: np.ndarray) -> int:
    """The class key of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = mix(u).sum(dtype=np.uint64) + np.uint64(len(u)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = np.bitwise_xor.reduce(mix(u ^ np.uint64(0xABCDEF12345)))
    return int(mix(np.array([total ^ (mixed << np.uint64(1))], np.uint64)).view(np.int64)[0])


def width_of(n: int) -> int:
    return max(LEAST_BITS, 1 << (3 * n // 2).bit_length())


def bitmap(u: np.ndarray) -> bytes:
    width = width_of(len(u))
    bits = np.zeros(width, bool)
    bits[(u >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


class _Maps:
    """The bitmaps of some rows, by width; sets whose widths differ twofold or more in steps can't link."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([8 * len(x) for x in raw], np.int64)
        self.place, self.of = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.of[int(w)] = np.frombuffer(b"".join([raw[r] for r in rows]), np.uint64).reshape(len(rows), int(w) // 64)

    def at(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The bitmaps of rows of that width or the next one, at that width."""
        out = np.zeros((len(rows), width // 64), np.uint64)
        own = self.width[rows] == width
        if own.any():
            out[own] = self.of[width][self.place[rows[own]]]
        if not own.all():
            out[~own] = fold(self.of[2 * width][self.place[rows[~own]]])
        return out

    def levels(self) -> list[int]:
        return sorted(self.of)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def short_prefix(n: int) -> int:
    """The prefix of the smaller (or equal) set of a linked pair that meets the other one's prefix."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1


def _longs(u: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(u).view(np.int64))


def class_rows(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, n, ck, bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ck, bits = [], [], []
            for u in shingle_sets(b.column(1)):
                n.append(len(u))
                ck.append(digest(u))
                bits.append(bitmap(u) if len(u) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ck, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n", "ck", "bits"])

    return docs.select("doc_id", F.col(text).cast("string").alias("t")).mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ck long, bits binary")


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, documents of the sample that have it), by shingle: MAX_FREQUENT at most. They only steer the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [u[: 2 * prefix_length(len(u))] for u in shingle_sets(b.column(0))]
            if sets:
                u, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(u), pa.array(n.astype(np.int64))], names=["tok", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.col(text).cast("string").alias("t"))
    rows = part.mapInArrow(released(run), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).checkpoint()
    top = most_frequent(rows, "tok", "n", MAX_FREQUENT)
    tok, n = top["tok"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tok)
    return tok[order], n[order]


def prefix_of(u: np.ndarray, tok: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: rare ones by hash, then frequent ones by count and hash."""
    k = prefix_length(len(u))
    if not len(tok):
        return u[:k]
    i = np.searchsorted(tok, u)
    i[i == len(tok)] = 0
    often = tok[i] == u
    rare = u[~often]
    if len(rare) >= k:
        return rare[:k]
    rest, n = u[often], count[i[often]]
    return np.concatenate([rare, rest[np.lexsort((rest, n))][: k - len(rare)]])


def prefix_rows(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(tok, ck): the prefix of every class, once for each task it occurs in.

    The lowest bit of tok says whether the shingle is of the short prefix; the other bits name the shingle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, count = sent.value
        seen: set[int] = set()
        for b in batches:
            toks, cks = [], []
            for u in shingle_sets(b.column(0)):
                key = digest(u)
                if len(u) and key not in seen:
                    seen.add(key)
                    p = prefix_of(u, tok, count)
                    toks.append(p & ~np.uint64(1) | (np.arange(len(p)) < short_prefix(len(u))).astype(np.uint64))
                    cks.append(np.full(len(p), key, np.int64))
            if toks:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(toks)), pa.array(np.concatenate(cks))], names=["tok", "ck"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(released(run), "tok long, ck long")


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, m, ck): the classes that share a shingle which is of the short prefix of one of them, once for each distinct
    set of members."""
    from pyspark.sql import Window

    name, own = F.shiftright("tok", 1), Window.partitionBy("name")
    rows = rows.repartition(name).select(name.alias("name"), F.col("tok").bitwiseAND(1).alias("short"), "ck")
    rows = rows.groupBy("name", "ck").agg(F.max("short").alias("short"))
    rows = rows.select("ck", F.max("short").over(own).alias("short"), F.count("*").over(own).alias("m"), F.bit_xor(F.xxhash64("ck")).over(own).alias("x"), F.min("ck").over(own).alias("lo"), F.max("ck").over(own).alias("hi"))
    return rows.where("m > 1 and short = 1").select(F.xxhash64("m", "x", "lo", "hi").alias("bucket"), "m", "ck").distinct()


class _Tree:
    """A signature tree over rows sorted by set size: levels of (OR bitmaps, least and largest size, most collisions,
    earlier buckets that all rows below have)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, before: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, spare, before)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, sp, be = self.levels[-1]
            cut = np.arange(0, len(lo), step)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(b, cut),
                    np.minimum.reduceat(lo, cut),
                    np.maximum.reduceat(hi, cut),
                    np.maximum.reduceat(sp, cut),
                    np.bitwise_and.reduceat(be, cut),
                )
            )
            step = FANOUT

    def below(self, level: int, node: int) -> range:
        step = LEAF if level == 1 else FANOUT
        return range(node * step, min((node + 1) * step, len(self.levels[level - 1][1])))


def _possible(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The positions of node pairs (i, j) that can hold a link which is this bucket's to find: their size ranges meet, they
    don't meet in an earlier bucket, and the largest overlap suffices."""
    (ab, alo, ahi, asp, abe), (bb, blo, bhi, bsp, bbe) = a, b
    left = np.flatnonzero((100 * ahi[i] >= PERCENT * blo[j]) & (100 * bhi[j] >= PERCENT * alo[i]))
    left = left[~(abe[i[left]] & bbe[j[left]]).any(1)]
    i, j = i[left], j[left]
    most = np.bitwise_count(ab[i] & bb[j]).sum(1, dtype=np.int64) + np.minimum(asp[i], bsp[j])
    return left[(100 + PERCENT) * most >= PERCENT * (alo[i] + blo[j])]


def _enough(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs of rows can link by the largest overlap that their bitmaps allow."""
    spare = np.minimum(na - np.bitwise_count(a).sum(1, dtype=np.int64), nb - np.bitwise_count(b).sum(1, dtype=np.int64))
    most = np.bitwise_count(a & b).sum(1, dtype=np.int64) + spare
    return (100 + PERCENT) * most >= PERCENT * (na + nb)


def traverse(a: _Tree, b: _Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaf rows that the bounds allow; a is b: each pair once, the lower row first."""
    same, work = a is b, [(len(a.levels) - 1, len(b.levels) - 1, 0, 0)]
    while work:
        la, lb, i, j = work.pop()
        ia = a.below(la, i) if la >= lb and la else range(i, i + 1)
        jb = b.below(lb, j) if lb >= la and lb else range(j, j + 1)
        na, nb = (la - 1 if la >= lb and la else la), (lb - 1 if lb >= la and lb else lb)
        ii, jj = np.repeat(np.arange(ia.start, ia.stop), len(jb)), np.tile(np.arange(jb.start, jb.stop), len(ia))
        if same and na == nb:
            keep = ii < jj if na == 0 else ii <= jj
            ii, jj = ii[keep], jj[keep]
        keep = _possible(a.levels[na], b.levels[nb], ii, jj)
        ii, jj = ii[keep], jj[keep]
        if na == nb == 0:
            yield ii, jj
        else:
            work += [(na, nb, int(x), int(y)) for x, y in zip(ii, jj, strict=True)]


class _Earlier:
    """The earlier buckets of some rows, from a list column."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = lists.combine_chunks()
        self.at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.distinct, self.code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)

    def bits(self, lo: int, hi: int) -> np.ndarray:
        """A row of bits for each of rows lo to hi: one bit for each bucket that several of them have."""
        code = self.code[self.at[lo] : self.at[hi]]
        names, local, count = np.unique(code, return_inverse=True, return_counts=True)
        several = count > 1
        column = np.cumsum(several) - 1
        out = np.zeros((hi - lo, 64 * max(1, -(-int(several.sum()) // 64))), bool)
        row = np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))
        held = several[local]
        out[row[held], column[local[held]]] = True
        return np.packbits(out, axis=1).view(np.uint64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows of pairs (i, j) have no earlier bucket in common."""
        out = np.ones(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            keys = []
            for rows in (i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]):
                n = self.at[rows + 1] - self.at[rows]
                place = np.repeat(self.at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                keys.append(np.repeat(np.arange(len(rows)), n) * len(self.distinct) + self.code[place])
            both = np.sort(np.concatenate(keys), kind="stable")
            if len(both):
                out[lo + both[1:][both[1:] == both[:-1]] // len(self.distinct)] = False
        return out


def _join_group(side: np.ndarray, n: np.ndarray, maps: _Maps, before: np.ndarray, rows: np.ndarray, comp: np.ndarray, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) of one bucket's pair of blocks; rows are sorted by size, `before` has a row for each.

    There is a tree for each block and bitmap width; trees of neighbouring widths are traversed at the smaller one.
    """
    sides = np.unique(side)
    left, right, worth = [], [], []

    def tree(s: int, own: int, width: int) -> tuple[np.ndarray, _Tree] | None:
        held = (side == sides[s]) & (maps.width[rows] == own)
        r = rows[held]
        return (r, _Tree(n[r], maps.at(r, width), before[held])) if len(r) else None

    for width in maps.levels():
        same = [tree(s, width, width) for s in (0, -1)]
        if len(sides) == 1:
            same[1] = same[0]
        wider = [tree(s, 2 * width, width) for s in (0, -1)]
        pairs = [(same[0], same[1]), (same[0], wider[1])] + ([(wider[0], same[1])] if len(sides) > 1 else [])
        for a, b in pairs:
            if a is None or b is None:
                continue
            for i, j in traverse(a[1], b[1]):
                gi, gj = a[0][i], b[0][j]
                differ = comp[gi] != comp[gj]
                left.append(gi[differ])
                right.append(gj[differ])
                if spanning:
                    both = np.bitwise_count(a[1].levels[0][0][i[differ]] & b[1].levels[0][0][j[differ]]).sum(1, dtype=np.int64)
                    worth.append(both / (n[gi[differ]] + n[gj[differ]]))
    if not left:
        return rows[:0], rows[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    if spanning:  # each row with its best earlier partner
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((i, -np.concatenate(worth), j))
        first = np.append(True, j[order][1:] != j[order][:-1]) if len(order) else np.zeros(0, bool)
        i, j = i[order][first], j[order][first]
    return i, j


def _tree_join(spanning: bool):
    """Rows sorted by group and size -> candidate pairs; a group is held whole, and has 2 * BLOCK rows or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            group, side, ck, n, comp = (t.column(c).to_numpy() for c in ("grp", "side", "ck", "n", "comp"))
            maps, earlier = _Maps(t.column("bits").to_pylist()), _Earlier(t.column("before"))
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(cut, len(group)))
            left, right = [], []
            small = np.repeat(sizes <= ALL_PAIRS, sizes)
            for d in range(1, min(ALL_PAIRS, len(group))):  # trees of one leaf, all at once
                i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & (comp[:-d] != comp[d:]) & (100 * n[:-d] >= PERCENT * n[d:]))
                for width in maps.levels():
                    x = i[maps.width[i] == width]
                    x = x[maps.width[x + d] <= 2 * width]
                    both = (maps.at(r, width) for r in (x, x + d))
                    x = x[_enough(*both, n[x], n[x + d])]
                    x = x[earlier.apart(x, x + d)]
                    left.append(x)
                    right.append(x + d)
            for c, s in zip(cut[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS], strict=True):
                a, b = _join_group(side[c : c + s], n, maps, earlier.bits(c, c + s), np.arange(c, c + s), comp, spanning)
                left.append(a)
                right.append(b)
            a, b = (ck[np.concatenate([*x, cut[:0]])] for x in (left, right))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            group = t.column("grp").to_numpy()
            last = int(np.flatnonzero(np.append(True, group[1:] != group[:-1]))[-1])
            if last:
                yield pairs(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """members (bucket, m, ck, comp) with their block `side` and the blocks that it meets, `others`; members is read twice.

    In a bucket of more than BLOCK classes, a component of more than BLOCK has blocks of its own, which don't meet each
    other; all other classes share blocks that meet all. So a large group of near copies, once it is one component, costs as
    many rows as it has classes times the few blocks of the rest.
    """
    least = members.where(F.col("m") <= BLOCK).withColumn("side", F.lit(0).cast("long")).withColumn("others", F.array("side"))
    large = members.where(F.col("m") > BLOCK)
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = large.groupBy("bucket", "m", "comp").agg(F.count("*").alias("c"))
    own = own.select("bucket", "m", "comp", "c", blocks("c").alias("k"))
    plan = own.groupBy("bucket", "m").agg(
        F.collect_list(F.when(F.col("c") > BLOCK, F.struct("comp", "k"))).alias("big"),  # m / BLOCK rows at most
        F.sum(F.when(F.col("c") <= BLOCK, F.col("c")).otherwise(0)).alias("rest"),
    )
    number = lambda comp, k: F.xxhash64(comp, k)
    shared = F.when(F.col("rest") > 0, F.transform(F.sequence(F.lit(0), blocks("rest") - 1), lambda k: F.struct(F.lit(None).cast("long").alias("comp"), number(F.lit("rest"), k).alias("side"))))
    alone = F.flatten(F.transform("big", lambda b: F.transform(F.sequence(F.lit(0), b.k - 1), lambda k: F.struct(b.comp.alias("comp"), number(b.comp, k).alias("side")))))
    empty = F.array().cast("array<struct<comp:bigint,side:bigint>>")
    plan = plan.withColumn("sides", F.concat(alone, F.coalesce(shared, empty))).withColumn("share", F.explode(F.sequence(F.lit(0), blocks("m") - 1)))
    rows = large.withColumn("share", F.pmod(F.xxhash64("ck"), blocks("m")).cast("int")).join(plan.drop("m"), ["bucket", "share"])
    mine = F.filter("big", lambda b: b.comp == F.col("comp"))
    turn = lambda n: F.pmod(F.xxhash64("ck", "bucket"), n).cast("int")
    side = F.when(F.size(mine) > 0, number(F.col("comp"), turn(F.get(mine, F.lit(0)).k))).otherwise(number(F.lit("rest"), turn(F.greatest(blocks("rest"), F.lit(1)))))
    others = F.transform(F.filter("sides", lambda s: F.coalesce(s.comp != F.col("comp"), F.lit(True))), lambda s: s.side)
    return least.unionByName(rows.select("bucket", "m", "ck", "comp", side.alias("side"), others.alias("others")))


def candidates(members: DataFrame, classes: DataFrame, spanning: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of classes of different components; members: bucket, m, ck, comp.

    spanning: inside blocks only, a few pairs for each class; otherwise all pairs of blocks. A class's buckets, as many as
    its prefix has shingles at most, are gathered in order, so that each row knows the earlier ones.
    """
    if spanning:
        count = F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1))
        members = members.withColumn("side", F.pmod(F.xxhash64("ck", "bucket"), count)).withColumn("others", F.array("side"))
    else:
        members = _blocks(members.checkpoint())
    gathered = members.groupBy("ck").agg(F.min("comp").alias("comp"), F.array_sort(F.collect_list(F.struct("bucket", "side", "others"))).alias("own"))
    gathered = gathered.join(classes.select("ck", "n", "bits"), "ck")
    rows = gathered.select("ck", "n", "bits", "comp", F.col("own.bucket").alias("all"), F.posexplode("own").alias("i", "x"))
    rows = rows.select("ck", "n", "bits", "comp", "x.bucket", "x.side", F.explode("x.others").alias("other"), F.slice("all", F.lit(1), F.col("i")).alias("before"))
    rows = rows.withColumn("grp", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")))
    rows = rows.select("grp", "side", "ck", "n", "bits", "comp", "before").repartition("grp").sortWithinPartitions("grp", "n", "ck")
    return rows.mapInArrow(released(_tree_join(spanning)), "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """The pairs (u, v) that link, checked on the full sets. classes: ck, rep (one document's id).

    The first 16 bits of each shingle are compared first, a quarter of the bytes: they can only show more in common than
    there is, so that what they rule out doesn't link. The full sets of the other pairs decide.
    """
    left = _compared(pairs, docs, classes, text, np.uint16).select(F.col("u").alias("a"), F.col("v").alias("b")).checkpoint()
    return _compared(left, docs, classes, text, np.uint64)


def _compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str, kind: type) -> DataFrame:
    """The pairs (u, v) whose sets, cut to `kind`, have enough in common.

    The sets of a pair meet under its first class; a class of many pairs is spread over shares of ROOT_SHARE.
    """
    cut = np.uint64(64 - 8 * np.dtype(kind).itemsize)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / ROOT_SHARE).cast("int").alias("shares"))
    salted = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    wanted = salted.select(F.col("b").alias("ck"), F.col("a").alias("root"), "share").union(shares.select(F.col("a").alias("ck"), F.col("a").alias("root"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))
    wanted = wanted.groupBy("ck").agg(F.collect_list(F.struct("root", "share")).alias("roots")).join(classes.select("ck", "rep"), "ck").checkpoint()
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (wanted.agg(F.sum(F.size("roots"))).first()[0] or 0) <= BROADCAST_ROWS
    body = docs.select(F.col("doc_id").alias("rep"), F.col(text).cast("string").alias("t"))
    rows = body.join(F.broadcast(wanted) if small else wanted, "rep").select("t", "ck", F.col("roots.root").alias("root"), F.col("roots.share").alias("share"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, shares, cks, sets, held = [], [], [], [], 0
            for u, ck, own, part in zip(shingle_sets(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if digest(u) != ck:  # another row with the same id
                    continue
                raw = (u >> cut).astype(kind).tobytes()  # stays in order
                for r, s in zip(own, part, strict=True):
                    roots.append(r)
                    shares.append(s)
                    cks.append(ck)
                    sets.append(raw)
                    held += len(raw)
                if held > 16 << 20:
                    yield batch(roots, shares, cks, sets)
                    roots, shares, cks, sets, held = [], [], [], [], 0
            yield batch(roots, shares, cks, sets)

    def batch(roots, shares, cks, sets) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(shares, pa.int32()), pa.array(cks, pa.int64()), pa.array(sets, pa.binary())], names=["root", "share", "ck", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, None
        for b in batches:
            u, v = [], []
            for root, share, ck, raw in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                got = np.frombuffer(raw.as_py(), kind)
                if ck == root:
                    key, base = (root, share), got
                elif key == (root, share):
                    i = np.searchsorted(base, got)
                    i[i == len(base)] = 0
                    both = min(int((base[i] == got).sum()), len(base))
                    if 100 * both >= PERCENT * (len(base) + len(got) - both):
                        u.append(root)
                        v.append(ck)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sets = rows.mapInArrow(released(spread), "root long, share int, ck long, set binary").repartition("root", "share")
    return sets.sortWithinPartitions("root", "share", F.col("ck") != F.col("root")).mapInArrow(released(check), "u long, v long")


def classes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = class_rows(docs, text).checkpoint()
    named = docs.where("doc_id is not null")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("ck").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")).checkpoint()
    met = buckets(prefix_rows(named, text, frequent_shingles(named, text))).checkpoint()
    seen: list[DataFrame] = []
    comp = _round(met.select("bucket", "m", "ck", F.col("ck").alias("comp")), None, named, classes, text, True, seen)
    met = met.where(F.col("m") > ALL_PAIRS)  # the first round has seen all pairs of smaller buckets
    while met.where(F.col("m") > BLOCK).limit(1).count():  # large buckets: one class for each component, again inside blocks
        own, count = _open(met, comp), comp.count()
        heads = own.groupBy("bucket", "comp").agg(F.min("ck").alias("ck"))
        sizes = heads.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
        comp = _round(heads.join(sizes, "bucket"), comp, named, classes, text, True, seen)
        if comp.count() == count:
            break
    comp = _round(_open(met, comp), comp, named, classes, text, False, seen)
    of_class = classes.join(comp.withColumnRenamed("u", "ck"), "ck", "left").select("ck", "rep", F.coalesce(F.col("v"), F.col("ck")).alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named_by = of_class.join(least, "comp").select("ck", "component_id")
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("ck")).alias("ck")).join(named_by, "ck", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def _open(met: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of met with their component, for buckets that hold several components; large buckets are joined in shares."""
    own = met.join(comp.withColumnRenamed("u", "ck"), "ck", "left").select("bucket", "m", "ck", F.coalesce(F.col("v"), F.col("ck")).alias("comp"))
    shares = F.ceil(F.col("m") / BLOCK).cast("int")
    several = own.groupBy("bucket", "m").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    several = several.select("bucket", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    return own.withColumn("share", F.pmod(F.xxhash64("ck"), shares).cast("int")).join(several, ["bucket", "share"], "left_semi").drop("share")


def _round(members: DataFrame, comp: DataFrame | None, docs: DataFrame, classes: DataFrame, text: str, spanning: bool, seen: list[DataFrame]) -> DataFrame:
    """The components after the candidates of these members (bucket, m, ck, comp) have been checked; seen: pairs checked
    so far, which are not checked again."""
    found = candidates(members, classes, spanning)
    for other in seen:
        found = found.join(other, ["a", "b"], "left_anti")
    found = found.checkpoint()
    seen.append(found)
    links = verify(found, docs, classes, text)
    return components(links if comp is None else comp.union(links))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the near copies: of each component the rows with its smallest id stay; of rows that repeat an id and
    its text one stays; rows without id stay."""
    own = docs.columns
    name, times = (free_name(own, n) for n in ("__id", "__times"))
    classes = classes_of(docs.select("doc_id", F.col(text).alias("text")))
    firsts = classes.where("component_id = doc_id").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias(times)).checkpoint()
    ids = F.broadcast(firsts) if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else firsts
    met = docs.join(ids, F.col("doc_id") == F.col(name), "left").where(F.col(times).isNotNull() | F.col("doc_id").isNull())
    if not firsts.where(F.col(times) > 1).limit(1).count():
        return met.select(*[F.col(f"`{c}`") for c in own])
    once, more = met.where(F.col(times).isNull() | (F.col(times) == 1)), met.where(F.col(times) > 1).dropDuplicates(["doc_id", text])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in own])

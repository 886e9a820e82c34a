"""URL filters: a Bloom filter cascade gives exact membership of URL keys without joins.

A listed key is a host suffix with a path prefix ("example.org/es/"). The keys a URL could match have the shapes
(labels of the host, length of the path) that occur in the lists. The distinct keys of all URLs are the complete
universe: level 0 of a cascade encodes the listed keys, level 1 the keys of the universe that level 0 takes wrongly,
level 2 the listed keys that level 1 takes wrongly, and so on until no key is wrong. Only the first level's false
positives leave the executors; the first filter is sized so that they number about as many as the listed keys.
Lists are configuration: they and all levels are bounded by MAX_KEYS, whatever the size of the corpus.

Defined results: a null URL, or one without "://", has an empty host and path and matches no rule; a key in both lists
is blocked; of two fitting rules the longer text wins, then the one with more host labels; repeated rows are judged one
by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text_stats import kept_apart, lower_ascii

MAX_KEYS = 2_000_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `bits` in 64-bit words, `hashes` probes, salted by `number`."""

    number: int
    size: int
    hashes: int
    bits: tuple[int, ...]

    def probes(self, key: str) -> list[int]:
        raw = key.encode()
        return [_signed(xxhash.xxh64_intdigest(raw, _seed(self.number, j))) % self.size for j in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 6] >> (p & 63) & 1 for p in self.probes(key))

    def column(self, key: Column) -> Column:
        words = F.array(*[F.lit(_signed(w)) for w in self.bits]) if len(self.bits) < 64 else F.lit(np.array(self.bits, np.uint64).astype(np.int64))
        hit = F.lit(True)
        for j in range(self.hashes):
            p = F.pmod(F.xxhash64(F.lit(self.number * 64 + j).cast("bigint"), key), F.lit(self.size))
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            hit = hit & (F.getbit(word, (p % 64).cast("int")) == 1)
        return hit


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _seed(level: int, j: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", level * 64 + j), 42)


def build_level(number: int, keys: set[str], rate: float) -> Level:
    """A Bloom filter of the keys with about the given false-positive rate."""
    size = max(64, math.ceil(1.4427 * len(keys) * math.log2(1 / rate) / 64) * 64)
    level = Level(number, size, max(1, round(math.log2(1 / rate))), ())
    bits = [0] * (size // 64)
    for k in keys:
        for p in level.probes(k):
            bits[p >> 6] |= 1 << (p & 63)
    return Level(number, size, level.hashes, tuple(bits))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def column(self, key: Column) -> Column:
        """Exact membership for the keys of the universe."""
        inside = F.lit(False)
        for level in reversed(self.levels):
            inside = level.column(key) & ~inside
        return inside

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def first_level(listed: set[str], universe: int) -> Level:
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * max(1, len(listed)) / max(1, universe)))
    return build_level(0, listed, rate)


def complete(first: Level, listed: set[str], wrong: set[str]) -> Cascade:
    """Adds levels until neither the listed keys nor the first level's false positives are wrong."""
    levels, encode, others = [first], set(wrong) - listed, set(listed)
    while encode:
        if len(levels) > 60:
            raise ValueError("the cascade doesn't end: two keys can't be told apart")
        level = build_level(len(levels), encode, 0.5)
        levels.append(level)
        encode, others = {k for k in others if k in level}, encode
    return Cascade(tuple(levels))


def shapes_of(keys: set[str]) -> list[tuple[int, int]]:
    """(host labels, path length) of the listed keys."""
    return sorted({(k.split("/", 1)[0].count(".") + 1, len(k) - len(k.split("/", 1)[0])) for k in keys})


def with_keys(df: DataFrame, url: str, shapes: list[tuple[int, int]]) -> DataFrame:
    """df plus __host, __path and __keys: array<struct<size, labels, key>> of the keys the URL has."""
    df = df.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    df = df.withColumn("__labels", F.split("__host", r"\."))
    keys = []
    for labels, length in shapes:
        host = F.array_join(F.slice("__labels", -labels, labels), ".")
        key = F.concat(host, F.substring(F.col("__path"), 1, length))
        fits = (F.col("__host") != "") & (F.size("__labels") >= labels) & (F.length("__path") >= length)
        keys.append(F.when(fits, F.struct(F.length(key).alias("size"), F.lit(labels).alias("labels"), key.alias("key"))))
    return df.withColumn("__keys", F.filter(F.array(*keys), lambda k: k.isNotNull()))


def build(df: DataFrame, url: str, lists: dict[str, set[str]]) -> dict[str, Cascade]:
    """A cascade for each list over the complete key universe of df."""
    every = set().union(*lists.values())
    if len(every) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} listed keys: split the lists")
    if not every:
        return {name: Cascade(()) for name in lists}
    universe = with_keys(df.select(url), url, shapes_of(every)).select(F.explode("__keys.key").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    firsts = {name: first_level(keys, size) for name, keys in lists.items() if keys}
    taken = reduce(lambda a, b: a | b, [f.column(F.col("key")) for f in firsts.values()])
    wrong = {r[0] for r in universe.where(taken).distinct().toLocalIterator()}
    return {name: complete(firsts[name], keys, {k for k in wrong if k in firsts[name]}) if keys else Cascade(()) for name, keys in lists.items()}


def judge(df: DataFrame, url: str, allow: set[str], block: set[str], blocked_hosts: set[str] = frozenset(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of df with host, path, rule and verdict.

    The longest rule of allow and block decides; without one, hosts in blocked_hosts and their subdomains are blocked
    and all others allowed.
    """
    cascades = build(df, url, {"allow": set(allow) - set(block), "block": set(block), "hosts": set(blocked_hosts)})
    shapes = shapes_of({*allow, *block, *blocked_hosts})
    df, keep = kept_apart(df, keep, ("host", "path", "rule", "verdict", "__host", "__path", "__labels", "__keys", "__named", "__rule", "__url"))
    df = df.select(*keep, F.col(f"`{url}`").alias("__url"))
    staged = with_keys(df, "__url", shapes or [(1, 0)])
    named = F.transform(
        "__keys",
        lambda k: F.struct(k["size"].alias("size"), k["labels"].alias("labels"), k["key"].alias("key"), cascades["allow"].column(k["key"]).alias("allow"), cascades["block"].column(k["key"]).alias("block"), cascades["hosts"].column(k["key"]).alias("spam")),
    )
    staged = staged.withColumn("__named", named)
    staged = staged.withColumn("__rule", F.array_max(F.filter("__named", lambda k: k["allow"] | k["block"])))
    verdict = F.when(F.col("__rule").isNotNull(), F.when(F.col("__rule.block"), "block").otherwise("allow")).when(F.exists("__named", lambda k: k["spam"]), "block").otherwise("allow")
    return staged.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.key").alias("rule"), verdict.alias("verdict"))

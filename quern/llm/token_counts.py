"""Token counts of byte-level byte-pair vocabularies, without making ids.

A text is cut at the special strings (one token each) and into the vocabulary's pieces. A piece starts as its UTF-8 bytes
in a doubly linked list; a heap gives the adjacent pair of the lowest rank (the leftmost of equals), which is merged, until
no pair has a rank. The piece's count is its bytes less the merges. Counts of frequent pieces are kept in a bounded cache
of each worker, so a corpus costs a look-up a piece and a merge run a distinct piece. One scan, no shuffle.

Pieces come from the usual pattern; texts with characters that this Python's Unicode tables don't know are cut by the
library itself, whose tables may differ there.

Defined results: null text counts as empty, with no bytes and no tokens; equal rows count alike; an empty table gives no
rows; texts and pieces of any length are counted whole, in n log n steps; a kept column whose name is that of a result
comes out with underscores behind.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text_stats import kept_apart
from quern.llm.workers import released

#: The piece pattern of the public byte-level vocabularies, and what it is on ASCII texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\r0-9A-Za-z]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Pieces whose counts a worker keeps, in a younger and an older half of so many, and the longest of them.
HALF_CACHE, CACHED_CHARS = 3 << 16, 64
#: Longer texts are read piece by piece instead of as one list of pieces.
LIST_CHARS = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def plain_byte_level(spec: dict) -> bool:
    """Whether a .json vocabulary cuts texts by PIECES and merges bytes, without a normaliser or chance."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    usual = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(usual and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))


def read_vocabulary(path: str) -> dict:
    """What counting needs of a byte-level .json or of a .tiktoken file: `bytes`, the symbol of each byte; `pairs`, rank and
    symbol of each mergeable (left, right); `specials`; `whole`, pieces that are one token as they are; the raw .json."""
    with open(path, "rb") as f:
        raw = f.read()
    if path.endswith(".tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        pairs = {(ranks[t[:i]], ranks[t[i:]]): (r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        return {"bytes": [ranks[bytes([b])] for b in range(256)], "pairs": pairs, "specials": [], "whole": ranks, "json": None}
    spec = json.loads(raw)
    if not plain_byte_level(spec):
        raise ValueError("not a plain byte-level vocabulary")
    model = spec["model"]
    vocab, letters = model["vocab"], byte_letters()
    added = list(spec.get("added_tokens", []))
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added) or any(c not in vocab for c in letters):
        raise ValueError("added tokens that take their neighbours, or bytes without a symbol")
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return {"bytes": [vocab[c] for c in letters], "pairs": pairs, "specials": [a["content"] for a in added], "whole": {}, "json": raw.decode()}


_KNOWN_CHARACTERS: set[str] = set()


def unsure(text: str) -> bool:
    """Whether the text has characters that this Python's Unicode tables leave open. Those once looked up are remembered."""
    new = set(text) - _KNOWN_CHARACTERS
    if not new:
        return False
    known = {c for c in new if unicodedata.category(c) not in ("Cn", "Co", "Cs")}
    _KNOWN_CHARACTERS.update(known)
    return len(known) < len(new)


class Counter(dict):
    """Token counts of pieces; pieces not met so far are merged."""

    def __init__(self, vocabulary: dict, specials: bool = True):
        self.bytes, self.whole = vocabulary["bytes"], vocabulary["whole"]
        self.pairs = {a << 32 | b: v for (a, b), v in vocabulary["pairs"].items()}
        found = sorted(vocabulary["specials"], key=len, reverse=True) if specials else []
        self.specials = re.compile("|".join(map(re.escape, found))) if found else None
        self.ascii, self.any = re.compile(ASCII_PIECES), regex.compile(PIECES)
        self.json, self.library, self.older = vocabulary["json"], None, {}

    def __missing__(self, piece: str) -> int:
        """The count from the older half of the cache, or by merging; the younger half takes it, and is the older one next."""
        n = self.older.get(piece) or self.merged(piece.encode())
        if len(piece) <= CACHED_CHARS:
            if len(self) >= HALF_CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        """Bytes less merges."""
        count = len(piece)
        if count < 2 or piece in self.whole:
            return min(count, 1)
        pairs, symbols = self.pairs, [self.bytes[b] for b in piece]
        left, right = list(range(-1, count - 1)), list(range(1, count + 1))
        end, heap = count, []
        for i in range(end - 1):
            found = pairs.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                heap.append((found[0], i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if symbols[i] < 0 or j >= end:
                continue
            found = pairs.get(symbols[i] << 32 | symbols[j])
            if not found or found[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = found[1], -1
            right[i] = k = right[j]
            count -= 1
            if k < end:
                left[k] = i
                found = pairs.get(symbols[i] << 32 | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i))
            k = left[i]
            if k >= 0:
                found = pairs.get(symbols[k] << 32 | symbols[i])
                if found:
                    heapq.heappush(heap, (found[0], k))
        return count

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        pattern = self.ascii if text.isascii() else self.any
        if pattern is self.any and self.json and unsure(text):
            return self._by_library(text)
        if len(text) > LIST_CHARS:
            return sum(self[m.group()] for m in pattern.finditer(text))
        return sum(map(self.__getitem__, pattern.findall(text)))

    def _by_library(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.json).pre_tokenizer
        return sum(self[text[a:b]] for _, (a, b) in self.library.pre_tokenize_str(text))

    def count(self, text: str) -> int:
        if self.specials is None:
            return self._plain(text)
        n = at = 0
        for m in self.specials.finditer(text):
            n += 1 + self._plain(text[at : m.start()])
            at = m.end()
        return n + self._plain(text[at:] if at else text)


@lru_cache(maxsize=4)
def follows_ranks(path: str) -> bool:
    """Whether a .json vocabulary gives the same ids when merging whatever adjacent pair makes the token of the least id.

    So it is if ids follow the merges' order and every token comes whole out of its own bytes: where two neighbours make a
    token, nothing has crossed its ends, so they stand as in that token alone, where the next merge is the listed one.
    """
    with open(path, "rb") as f:
        spec = json.load(f)
    if not plain_byte_level(spec):
        return False
    vocabulary = read_vocabulary(path)
    made = [symbol for _, symbol in sorted(vocabulary["pairs"].values())]
    counter, value = Counter(vocabulary, specials=False), {c: b for b, c in enumerate(byte_letters())}
    added = {a["content"] for a in spec.get("added_tokens", [])}
    tokens = [t for t in spec["model"]["vocab"] if t not in added]
    return made == sorted(set(made)) and max(vocabulary["bytes"]) < made[0] and all(counter.merged(bytes(value[c] for c in t)) == 1 for t in tokens)


_COUNTERS: dict = {}


def _counter(key: tuple, vocabulary) -> Counter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary.value, specials=key[1])
    return _COUNTERS[key]


def count_tokens(df: DataFrame, vocabulary_path: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",), specials: bool = True) -> DataFrame:
    """The columns `keep` of df with n_bytes (UTF-8), n_tokens, and over_limit: more than `limit` tokens.

    With `specials`, each special string inside a text is one token, as in the library's default; else it is plain text.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    key = (vocabulary_path, specials)
    df, keep = kept_apart(df, keep, ("n_bytes", "n_tokens", "over_limit", "__text"))
    results = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, vocabulary)
        for b in batches:
            texts = pc.fill_null(b.column(b.num_columns - 1), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n_bytes, n, pc.greater(n, limit)], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(released(run), schema)

"""SentencePiece encoding and decoding with source offsets.

The model file is read once and sent to the executors as bytes. Ids come from the sentencepiece library. Offsets come
from our own normaliser: it reads the compiled character map of the model (a double-array trie with its replacement
strings), takes the longest matching prefix at each point and records, for every normalised byte, the source bytes it
came from. Each piece then covers a run of normalised bytes, and so a span of source bytes.

Defined results: null text counts as empty and has no pieces; equal rows encode alike; an empty table gives no rows;
texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text_stats import kept_apart
from quern.llm.workers import released

SPACE = "▁".encode()
#: Texts are encoded in runs of about so many characters, so that a worker holds few ids at a time.
RUN_CHARS = 1 << 19


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[i]
            out, shift, i = out | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return out, i

    i = 0
    while i < len(raw):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        elif tag & 7 == 2:
            n, i = number(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


class CharacterMap:
    """A compiled character map: source prefix -> replacement. An empty one maps nothing."""

    def __init__(self, blob: bytes):
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.strings = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest key that begins at text[at]."""
        if not len(self.units):
            return None
        found, node, unit = None, 0, int(self.units[0])
        node ^= self._offset(unit)
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            unit = int(self.units[node])
            if unit & (1 << 31 | 0xFF) != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class SpanCodec:
    """Encoder and decoder of one model, with the source span of each piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.dummy_prefix = self.remove_spaces = self.escape_spaces = True
        self.map = CharacterMap(b"")
        for field, value in _fields(model):
            if field == 3:  # the normaliser's settings
                for n, v in _fields(value):
                    if n == 2:
                        self.map = CharacterMap(v)
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.remove_spaces = bool(v)
                    elif n == 5:
                        self.escape_spaces = bool(v)
        n = self.library.get_piece_size()
        self.piece_bytes = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(self.library.id_to_piece(i).encode()) for i in range(n)])
        self.unknown = self.library.unk_id()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the source bytes [from, to) it stands for."""
        raw = text.encode()
        if len(self.map.units) or self.remove_spaces:
            return self._normalise_slowly(raw)
        source = np.frombuffer(raw, np.uint8)
        blank = (source == 0x20) & self.escape_spaces
        size = np.where(blank, len(SPACE), 1)
        out = np.repeat(source, size)
        first = np.cumsum(size) - size
        for j, b in enumerate(SPACE):
            out[first[blank] + j] = b
        at = np.repeat(np.arange(len(raw)), size)
        return self._prefixed(out.tobytes(), at, at + 1)

    def _prefixed(self, out: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        if self.dummy_prefix and out:
            mark = SPACE if self.escape_spaces else b" "
            return mark + out, np.append(np.zeros(len(mark), np.int64), begin), np.append(np.zeros(len(mark), np.int64), end)
        return out, begin, end

    def _normalise_slowly(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        steps, at = [], 0
        while at < len(raw):
            got = self.map.longest(raw, at)
            if got is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                got = n, raw[at : at + n]
            steps.append((at, at + got[0], got[1]))
            at += got[0]
        if self.remove_spaces:
            kept: list = []
            for step in steps:
                word = step[2]
                if not kept or kept[-1][2].endswith(b" "):
                    word = word.lstrip(b" ")
                if word:
                    kept.append((step[0], step[1], word))
            while kept and not kept[-1][2].strip(b" "):
                kept.pop()
            steps = kept
        out, begin, end = [], [], []
        for b, e, word in steps:
            word = word.replace(b" ", SPACE) if self.escape_spaces else word
            out.append(word)
            begin += [b] * len(word)
            end += [e] * len(word)
        return self._prefixed(b"".join(out), np.array(begin, np.int64), np.array(end, np.int64))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans [begin, end) of the pieces; the mark before the first word has an empty one."""
        out, begin, end = self.normalise(text)
        sizes = self.piece_bytes[ids] if ids else np.zeros(0, np.int64)
        if self.unknown in ids and not self.library.is_byte(self.unknown):
            unknown = np.flatnonzero(np.array(ids) == self.unknown)
            if int(sizes.sum()) != len(out) and len(unknown):
                sizes = self._unknown_sizes(out, ids, sizes)
        stop = np.cumsum(sizes)
        if len(stop) and stop[-1] != len(out):
            raise ValueError("the pieces don't cover the normalised text")
        start = stop - sizes
        return (begin[start], end[stop - 1]) if len(stop) else (start, stop)

    def covering_spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """spans(), or ValueError if they leave out source bytes (but blanks that the normaliser removes)."""
        begin, end = self.spans(text, ids)
        raw = text.encode()
        lo = np.append(0, np.maximum.accumulate(end)) if len(end) else np.zeros(1, np.int64)
        hi = np.append(begin, len(raw))
        for i in np.flatnonzero(lo < hi):
            if not self.remove_spaces or raw[lo[i] : hi[i]].strip(b" "):
                raise ValueError("the spans don't cover the source")
        return begin, end

    def _unknown_sizes(self, out: bytes, ids: list[int], sizes: np.ndarray) -> np.ndarray:
        sizes, at = sizes.copy(), 0
        for n, i in enumerate(ids):
            if i == self.unknown:
                following = next((self.library.id_to_piece(j).encode() for j in ids[n + 1 :] if j != self.unknown), None)
                sizes[n] = (out.index(following, at) if following else len(out)) - at
            at += sizes[n]
        return sizes


@lru_cache(maxsize=4)
def _codec(model: bytes) -> SpanCodec:
    return SpanCodec(model)


_KINDS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "begins": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "ends": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def _encoded(codec: SpanCodec, texts: list[str], wanted: tuple[str, ...], names: list[str], check_spans: bool = False) -> Iterator[dict]:
    lo = 0
    while lo < len(texts):
        hi, n = lo + 1, len(texts[lo])
        while hi < len(texts) and n + len(texts[hi]) <= RUN_CHARS:
            n, hi = n + len(texts[hi]), hi + 1
        for text, ids in zip(texts[lo:hi], codec.encode(texts[lo:hi]), strict=True):
            row: dict = {"n_tokens": len(ids), "ids": ids}
            if check_spans:
                row["begins"], row["ends"] = codec.covering_spans(text, ids)
            elif "begins" in wanted or "ends" in wanted:
                row["begins"], row["ends"] = codec.spans(text, ids)
            if "decoded" in wanted or "decoded_sha256" in wanted:
                row["decoded"] = codec.decode(ids)
            if "ids_sha256" in wanted:
                row["ids_sha256"] = hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest()
            if "decoded_sha256" in wanted:
                row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
            yield row
        lo = hi


def encode(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"), check_spans: bool = False) -> DataFrame:
    """The columns `keep` of df with the outputs: n_tokens, ids, begins and ends (source byte spans), decoded, and the
    SHA-256 digests ids_sha256 (decimal ids joined by commas) and decoded_sha256.

    With check_spans, the spans of all pieces are computed whatever the outputs, and must cover the source.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    df, keep = kept_apart(df, keep, (*outputs, "__text"))
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *(T.StructField(o, _KINDS[o][0]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        names = [str(i) for i in range(codec.library.get_piece_size())]
        for b in batches:
            column, lo = b.column(b.num_columns - 1), 0
            while lo < b.num_rows or (lo == 0 and not b.num_rows):
                hi = min(b.num_rows, lo + 512)
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                got: dict[str, list] = {o: [] for o in outputs}
                for row in _encoded(codec, texts, outputs, names, check_spans):
                    for o in outputs:
                        got[o].append(row[o])
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), *(pa.array(got[o], _KINDS[o][1]) for o in outputs)], names=[*keep, *outputs])
                lo = hi
                if not b.num_rows:
                    break

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(released(run), schema)

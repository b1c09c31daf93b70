"""Operator 13: byte-level BPE encoding and decoding with the tokenizers library.

A vocabulary of byte strings with ranks becomes a ``tokenizers`` model: every byte is written as a
printable character (the byte table below), every way to split a token into two tokens is a merge
of that token's rank, and a word that is a token itself is taken whole. Texts are split by the
vocabulary's pattern, each match encoded separately. Arrow batches are cut where the pattern
certainly ends a match (white space after a character that is none); only pieces that a worker has
not met go through the library, the others' ids and offsets are looked up, so that memory and time
stay bounded and ids stay the same. Offsets count code points; tokens that split a character all
get that character's place.

Decoding looks tokens up in a table of characters, turns these back into bytes, and joins the
bytes of a row. ``decode_windows`` decodes slices of a row's ids: the bytes of a character that a
slice boundary splits come whole with the slice that ends it.

Defined results: a NULL or empty text has no ids, and decodes to no bytes. NULL ids decode to
NULL; an id outside the vocabulary raises an error. Bytes that are no UTF-8 (ids cut inside a
character at a row's end) become U+FFFD in texts and stay as they are in bytes. Rows that repeat a
key are separate rows. Other columns are kept; one that has the name of an output, in any case, is
replaced.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from canopyframe.llm.text import chunks, span_hashes

#: Bytes of text or of decoded ids that are handled at once.
CHUNK = 1 << 19


@lru_cache(maxsize=1)
def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return [table[b] if b in table else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def shown_tokens(path: str) -> dict[str, int]:
    """The ranks' tokens as characters of the byte table."""
    table = byte_table()
    return {"".join(table[b] for b in token): rank for token, rank in read_ranks(path).items()}


@lru_cache(maxsize=2)
def model(path: str, pattern: str):
    """The library's tokenizer for the ranks; a worker builds it once."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = shown_tokens(path)
    missing = [c for c in byte_table() if c not in ranks]
    if missing:
        raise ValueError(f"{path} lacks the tokens of {len(missing)} bytes")
    merges = [(t[:i], t[i:]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(ranks, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of the pieces of each row's bytes that encode separately to the same ids.

    A piece starts where white space follows a character that is none: no match of the pattern holds
    both, and what is matched from there on does not depend on what stands before.
    """
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    left = np.zeros(len(data), bool)
    # ASCII but for controls, two-byte characters from U+00C0 on and three-byte ones from U+4000 on hold no white space.
    left[1:] = (data[:-1] > 32) & (data[:-1] < 127)
    left[2:] |= (data[1:-1] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    left[3:] |= (data[1:-2] >= 0x80) & (data[:-3] >= 0xE4) & (data[:-3] < 0xF0)
    left &= white[data]
    left[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    start = np.flatnonzero(left)
    return start, np.searchsorted(bounds, start, "right") - 1


class SegmentIds:
    """Ids and places of pieces of text, kept between batches of one Python worker.

    ``limit`` pieces are kept; beyond it the memory starts anew, which costs time and changes no
    result. Pieces are told apart by 64-bit hashes (n of them share one with a chance below n * n / 2^65).
    """

    def __init__(self, path: str, pattern: str, limit: int = 400_000) -> None:
        self.encoder, self.limit = model(path, pattern), limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros((0, 3), np.int32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        for lo in range(0, len(texts), 4096):
            part = self.encoder.encode_batch(texts[lo : lo + 4096], add_special_tokens=False)
            count = np.fromiter((len(e) for e in part), np.int64, len(part))
            ids = np.fromiter((i for e in part for i in e.ids), np.int32, int(count.sum()))
            places = np.array([o for e in part for o in e.offsets], np.int32).reshape(-1, 2)
            self.keys = np.concatenate([self.keys, keys[lo : lo + 4096]])
            self.begin = np.concatenate([self.begin, len(self.tokens) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.tokens = np.concatenate([self.tokens, np.column_stack([ids, places])])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.begin, self.count = self.keys[order], self.begin[order], self.count[order]

    def __call__(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, first and last + 1 code point in the piece) of all tokens in order, and the number of each piece."""
        if not len(start):
            return np.zeros((0, 3), np.int32), np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))
        u, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        new = np.setdiff1d(u, self.keys, assume_unique=True)
        if len(new):
            if len(self.keys) + len(new) > self.limit:
                self._clear()
                new = u
            at = first[np.searchsorted(u, new)]
            raw = data.tobytes()
            self._learn(new, [raw[a:b].decode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist())])
        at = np.searchsorted(self.keys, u)[inverse]
        count = self.count[at]
        jump = np.repeat(self.begin[at] - (np.cumsum(count) - count), count)
        return self.tokens[jump + np.arange(len(jump))], count


@lru_cache(maxsize=2)
def segment_ids(path: str, pattern: str) -> SegmentIds:
    return SegmentIds(path, pattern)


def _lists(values: np.ndarray, counts: np.ndarray, packed: bool) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    if packed:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends * 4), pa.py_buffer(values.astype("<u4"))])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _fields(df: DataFrame, outputs: list[StructField], keep: Sequence[str] | None = None) -> tuple[list[str], StructType]:
    """Names of the columns to keep (none named like an output) and the schema of the result."""
    names = {f.name.lower() for f in outputs}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    return [f.name for f in kept], StructType([*kept, *outputs])


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", spans: tuple[str, str] | None = None,
           packed: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the ids of each text, and with ``spans`` the first and last + 1 code point of each token.

    ``packed`` ids are BINARY, little-endian unsigned 32-bit, else an array. ``keep`` names the columns
    to keep (all).
    """
    numbers = ArrayType(IntegerType(), False)
    outputs = [StructField(ids, BinaryType() if packed else numbers), *(StructField(c, numbers) for c in spans or ())]
    kept, schema = _fields(docs, outputs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segment_ids(ranks, pattern)
        for b in batches:
            at = [b.schema.get_field_index(c) for c in kept]
            for lo, hi, data, bounds in chunks(b.column(b.schema.get_field_index(text)), CHUNK):
                start, row = segments(data, bounds)
                tokens, count = encoder(data, start)
                per_row = np.bincount(row, weights=count, minlength=hi - lo).astype(np.int64) if len(row) else np.zeros(hi - lo, np.int64)
                values = [_lists(tokens[:, 0], per_row, packed)]
                if spans:
                    # Code points before each piece, counted from the start of its row.
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    shift = np.repeat(points[start] - points[bounds[row]], count)
                    values += [_lists(tokens[:, i] + shift, per_row, False) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in at), *values], schema.names)

    return docs.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def byte_strings(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, bytes) of every id's bytes, by the reversed byte table; length -1 where an id is free."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocabulary = shown_tokens(path)
    tokens: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for shown, i in vocabulary.items():
        tokens[i] = bytes(back[c] for c in shown)
    length = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
    size = np.maximum(length, 0)
    return np.cumsum(size) - size, length, np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)


def id_bytes(values: np.ndarray, strings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the ids, number of bytes of each id)."""
    start, length, data = strings
    if len(values) and (values.min() < 0 or values.max() >= len(length) or length[values].min() < 0):
        raise ValueError("an id is not in the vocabulary")
    n = length[values]
    jump = np.repeat(start[values] - (np.cumsum(n) - n), n)
    return data[jump + np.arange(len(jump))], n


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row bounds, which rows are NULL) of a list column or packed ids."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        rows = [x or b"" for x in column.to_pylist()]
        return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])]).astype(np.int64), null
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if values.null_count:
        raise ValueError("an id is NULL")
    return values.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), null


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "bytes", text: str | None = None) -> DataFrame:
    """Adds the bytes of each row's ids (an array or packed), and with ``text`` their text."""
    outputs = [StructField(out, BinaryType()), *([StructField(text, StringType())] if text else [])]
    kept, schema = _fields(df, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = byte_strings(ranks)
        for b in batches:
            at = [b.schema.get_field_index(c) for c in kept]
            values, bounds, null = _rows(b.column(b.schema.get_field_index(ids)))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK, "right")) - 1)
                data, n = id_bytes(values[bounds[lo] : bounds[hi]], strings)
                ends = np.concatenate([[0], np.cumsum(n)])[bounds[lo : hi + 1] - bounds[lo]].tolist()
                raw = data.tobytes()
                found = [None if gone else raw[x:y] for x, y, gone in zip(ends[:-1], ends[1:], null[lo:hi].tolist())]
                columns = [*(b.column(i).slice(lo, hi - lo) for i in at), pa.array(found, pa.binary())]
                if text:
                    columns.append(pa.array([None if f is None else f.decode("utf-8", "replace") for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                lo = hi

    return df.mapInArrow(run, schema)


def decode_windows(df: DataFrame, ranks: str, size: int, ids: str = "ids", out: str = "texts") -> DataFrame:
    """Adds the texts of each row's consecutive slices of ``size`` ids; joined, they are the row's text.

    A character split between slices stands in the slice that ends it, a broken one (U+FFFD) where
    it is found broken, at the latest in the last slice.
    """
    kept, schema = _fields(df, [StructField(out, ArrayType(StringType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = byte_strings(ranks)
        for b in batches:
            at = [b.schema.get_field_index(c) for c in kept]
            values, bounds, null = _rows(b.column(b.schema.get_field_index(ids)))
            for i in range(b.num_rows):
                texts: list[str] = []
                reader = codecs.getincrementaldecoder("utf-8")("replace")
                for first in range(bounds[i], bounds[i + 1], size):
                    last = min(first + size, bounds[i + 1])
                    data, _ = id_bytes(values[first:last], strings)
                    texts.append(reader.decode(data.tobytes(), last == bounds[i + 1]))
                found = pa.array([None if null[i] else texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in at), found], schema.names)

    return df.mapInArrow(run, schema)

"""Shared text helpers: Arrow strings as byte arrays, words and their 64-bit hashes.

Everything here works on one bounded chunk of an Arrow batch with NumPy; Spark decides which
rows a task sees. A word is a run of bytes outside the ASCII white space 0x20 and 0x09-0x0D,
which never cuts a UTF-8 character. NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The white space of all word contracts, as a regular expression class and as characters.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: list[np.ndarray] = []


def _powers_at_least(log_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least 2 ** ``log_n`` of each; a worker keeps one pair."""
    n = 1 << log_n
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    if lower:
        table[65:91] += 32
    return table + np.uint64(1)


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row bounds) for runs of rows of about ``size`` bytes.

    ``bounds`` has one more entry than rows and counts from the start of the bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of the chunk, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_space()[data]
    left = np.empty(len(data), bool)
    left[0], left[1:] = True, ~inside[:-1]
    left[bounds[:-1][bounds[:-1] < len(data)]] = True
    right = np.empty(len(data), bool)
    right[-1], right[:-1] = True, ~inside[1:]
    right[bounds[1:][bounds[1:] > 0] - 1] = True
    start, end = np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every span of bytes; equal bytes give equal hashes anywhere."""
    up, down = _powers_at_least(max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``k`` words within one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out) + h[i : n + i]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[at]), at


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n)[:n] if len(row) else np.zeros(n, np.int64)

"""Operator 9: cross-entropy difference under matched n-gram models.

The background model counts the words and word pairs of all documents, the target model those of the
documents of a target set. Both use one vocabulary, the words seen at least ``MIN_COUNT`` times in
the background (all others are one unknown word), and one smoothing: pairs are interpolated with
single words and these with the uniform distribution. A document's score is the mean over its tokens
of target loss minus background loss, in nats: the lower, the closer to the target. Counts cover all
documents and are exact, and both models grow with the corpus. Words, and pairs with a word that is not
broadcast, are told apart by 62-bit hashes, the latter without their last bit: among n of them any two share
one with a chance below n * n / 2 ** 62. All other pairs are exact: they are numbered by the places of both words.

A document needs the counts of its words and pairs, in three exact classes. The commonest (``TABLE``
words and as many pairs at most) are broadcast. A pair that only one row has is counted by that row
itself. The others meet their counts piece by piece of the range of hashes; a bit table of at most 32 MB
tells which pairs can be among them, and one that it names wrongly finds no count there and is again
counted by its row. Where not all known words are broadcast, the pairs with another word wait until a
join has told which of those words are known. Texts are shuffled only to meet a target set too large to
broadcast; otherwise tasks send packed pairs, counted together for some millions of tokens, so no piece has a key commoner than the number of such parcels.
What the pieces add to documents' sums goes on packed as well, by pieces of the range of documents.

Defined results: a NULL or empty text has no tokens and score 0.0. Rows with a NULL ``doc_id`` count as
background and are scored. A document listed several times in the target counts once; repeated rows
count as often as they occur. With an empty target both models' difference is that of the uniform
distribution. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import SPACE_CLASS, chunks, mix, span_hashes, words
from canopyframe.session import broadcast_if_small, cut

#: Not a table's size: the range of the hashes. The last is the unknown word, the one after it the start of a text.
HASH_BITS = 62
WORD_CELLS = 1 << HASH_BITS
UNKNOWN, START = WORD_CELLS - 1, WORD_CELLS
#: Stands for all words in the table of words.
TOTAL = -1
#: A word is known from this count on.
MIN_COUNT = 2
#: Codes of the start of a text and of the unknown word, beside places in the table of words.
BEGIN, RARE = -1, -2
#: Weights of pair, word and uniform distribution.
WEIGHTS = (0.5, 0.4, 0.1)
#: Bytes of text handled together.
CHUNK = 1 << 21
#: Tokens whose pairs a task counts together before it sends them.
FLUSH = 1 << 21
#: Words, and pairs, that are broadcast at most (24 bytes each); the rest take the exact ways above.
TABLE = 1 << 20
#: Tokens of the corpus for one piece of the pairs, and pieces at most.
PIECE_TOKENS, MAX_PIECE_BITS = 1 << 18, 20
#: So many pieces, as a power of two, meet their rows together: a row is named once in a parcel.
JOINT_BITS = 5
#: Tokens of the corpus for two pieces of the documents' sums.
SUM_TOKENS = 1 << 23
#: Bits of a pair's number at least, and odd factors that spread the numbers evenly.
PAIR_BITS, SPREAD = 32, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
#: Bits of the table of pairs that can be in the join.
MIN_BITS, MAX_BITS = 22, 28


def _word_cells(data: np.ndarray, bounds: np.ndarray, rare: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word; those in ``rare`` become the unknown word."""
    start, end, row = words(data, bounds)
    cell = (span_hashes(data, start, end, lower=True) % np.uint64(WORD_CELLS - 1)).astype(np.int64) if len(start) else start
    return (cell if rare is None else np.where(np.isin(cell, rare), UNKNOWN, cell)), row


def _before(cell: np.ndarray, row: np.ndarray, start: int = START) -> np.ndarray:
    """The previous word; before the first of a row stands the start mark."""
    before = np.empty_like(cell)
    if len(cell):
        before[0] = start
        before[1:] = np.where(row[1:] == row[:-1], cell[:-1], start)
    return before


def _pair_hashes(before: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (mix(mix(before.astype(np.uint64)) + cell.astype(np.uint64)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _pair_cells(cell: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of (previous word, word)."""
    return _pair_hashes(_before(cell, row), cell)


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers below 2 ** ``bits`` that deals neighbours evenly."""
    x, half, mask = x.astype(np.uint64), np.uint64((bits + 1) // 2), np.uint64((1 << bits) - 1)
    for odd in SPREAD:
        x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
    return (x ^ (x >> half)).astype(np.int64)


def _unspread(x: np.ndarray, bits: int) -> np.ndarray:
    x, half, mask = x.astype(np.uint64), np.uint64((bits + 1) // 2), np.uint64((1 << bits) - 1)
    x = x ^ (x >> half)
    for odd in reversed(SPREAD):
        x = (x * np.uint64(pow(odd, -1, 1 << 64))) & mask
        x = x ^ (x >> half)
    return x.astype(np.int64)


def _zeros(key: np.ndarray, base: int = 0) -> int:
    """Low bits that are zero in all keys and in ``base``; all of them if nothing else is there."""
    some = base | (int(np.bitwise_or.reduce(key)) if len(key) else 0)
    return (some & -some).bit_length() - 1 if some else HASH_BITS


def _sorted_order(key: np.ndarray) -> np.ndarray:
    """The stable order of keys; of short ones by sorting them with their places behind."""
    low, bits = _zeros(key), len(key).bit_length()
    if not len(key) or key.dtype != np.int64 or key.min() < 0 or (int(key.max()) >> low).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort(((key >> low) << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in it): equal keys together, otherwise as they came."""
    order = _sorted_order(key)
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key in the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Places:
    """Places of sorted and different keys of ``HASH_BITS`` bits, looked up by their leading bits."""

    def __init__(self, key: np.ndarray) -> None:
        bits = max(1, (len(key) - 1).bit_length())
        self.key, self.shift = key, HASH_BITS - bits
        self.first = np.searchsorted(key, np.arange((1 << bits) + 1) << self.shift).astype(np.int32)

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each wanted key; the place counts only where it is."""
        if not len(self.key):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        lead = wanted >> self.shift
        at = self.first[lead].astype(np.int64)
        hit = self.key[np.minimum(at, len(self.key) - 1)] == wanted
        on = np.flatnonzero(~hit)
        end = self.first[lead[on] + 1]
        while len(on):
            at[on] += 1
            inside = at[on] < end
            on, end = on[inside], end[inside]
            here = self.key[at[on]] == wanted[on]
            hit[on[here]] = True
            on, end = on[~here], end[~here]
        return at, hit


def _pack_keys(key: np.ndarray, base: int, *rest: np.ndarray) -> bytes:
    """Ascending keys from ``base`` on and other columns, without the low bits that are zero in all keys and in ``base``."""
    low = _zeros(key, base)
    keys = _pack(np.diff(key >> low, prepend=base >> low))
    # Keys are as good as random, the rest is mostly zeros and ones.
    return bytes([low]) + len(keys).to_bytes(8, "little") + keys + (zlib.compress(_pack(*rest), 1) if rest else b"")


def _unpack_keys(blob: bytes, base: int, columns: int) -> list[np.ndarray]:
    end = 9 + int.from_bytes(blob[1:9], "little")
    rest = _unpack(zlib.decompress(blob[end:]), columns - 1) if columns > 1 else []
    return [((base >> blob[0]) + np.cumsum(_unpack(blob[9:end], 1)[0])) << blob[0], *rest]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of BIGINT of one length by bytes of equal weight, without those that are zero in all rows."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        c = c.astype("<i8", copy=False)
        # The sign goes to the lowest bit, so that small numbers have few bytes.
        planes = ((c << 1) ^ (c >> 63)).view(np.uint8).reshape(-1, 8).T
        used = planes.any(axis=1)
        out += [np.packbits(used).tobytes(), planes[used].tobytes()]
    return b"".join(out)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for _ in range(columns):
        used = np.unpackbits(np.frombuffer(blob, np.uint8, 1, at)).astype(bool)
        end = at + 1 + n * int(used.sum())
        rows = np.zeros((n, 8), np.uint8)
        rows[:, used] = np.frombuffer(blob, np.uint8, end - at - 1, at + 1).reshape(-1, n).T if n else 0
        c, at = rows.view("<u8").reshape(-1), end
        out.append((c >> np.uint64(1)).astype(np.int64) ^ -(c & np.uint64(1)).astype(np.int64))
    return out


@dataclass
class Words:
    """The broadcast words, sorted by hash, and the totals of both models; ``whole`` if no known word is missing."""

    key: np.ndarray
    n: np.ndarray
    nt: np.ndarray
    whole: bool
    least: int
    known: int
    total: int
    target_total: int
    rare: int
    target_rare: int

    @cached_property
    def places(self) -> Places:
        return Places(self.key)

    def find(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, code) of every word of a chunk; a word that is not broadcast has the code ``RARE``."""
        cell, row = _word_cells(data, bounds, None)
        at, hit = self.places.found(cell)
        return row, cell, np.where(hit, at, RARE)

    @property
    def pair_bits(self) -> int:
        return max(PAIR_BITS, ((len(self.key) + 2) ** 2 - 1).bit_length())

    def pairs(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Even keys of pairs of places or marks, in the range of the hashes; those of other pairs are odd."""
        bits = self.pair_bits
        return _spread((before + 2) * (len(self.key) + 2) + word + 2, bits) << (HASH_BITS - bits)

    def codes(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(before, word) of the keys of ``pairs``."""
        bits = self.pair_bits
        before, word = np.divmod(_unspread(pair >> (HASH_BITS - bits), bits), len(self.key) + 2)
        return before - 2, word - 2

    def counts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, count in the target) of coded words: places in the table, marks, or the two counts themselves."""
        n, nt = np.full(len(code), self.rare, np.int64), np.full(len(code), self.target_rare, np.int64)
        at = code >= 0
        n[at], nt[at] = self.n[code[at]], self.nt[code[at]]
        at = code == BEGIN
        n[at], nt[at] = self.total, self.target_total
        at = code < RARE
        n[at], nt[at] = np.divmod(RARE - 1 - code[at], self.least)
        return n, nt

    def difference(self, pn: np.ndarray, pnt: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Target loss minus background loss of coded pairs with these counts."""
        a, b, c = WEIGHTS
        (hn, hnt), (n, nt), uniform = self.counts(before), self.counts(word), c / (self.known + 1)
        return (np.log(a * pn / np.maximum(hn, 1) + b * n / max(self.total, 1) + uniform)
                - np.log(a * pnt / np.maximum(hnt, 1) + b * nt / max(self.target_total, 1) + uniform))


def _first_kept(sizes: dict[int, int], table: int) -> int:
    """The least power of two from which on at most ``table`` counts lie; ``sizes`` has their number by bit length."""
    bits, left = 64, table
    while bits > 1 and left >= sizes.get(bits - 1, 0):
        bits -= 1
        left -= sizes.get(bits, 0)
    return 1 << (bits - 1)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, nt) of (text, target): counts of every known word, and of all words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            target = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, bounds in chunks(b.column(0), CHUNK):
                cell, row = _word_cells(data, bounds, None)
                if len(cell):
                    order, first = _groups(cell)
                    mine = target[lo:hi][row].astype(np.int64)
                    n, nt = np.diff(np.append(first, len(cell))), np.add.reduceat(mine[order], first)
                    columns = [np.append(cell[order[first]], TOTAL), np.append(n, len(cell)), np.append(nt, mine.sum())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "n", "nt"])

    parts = rows.select("text", "target").mapInArrow(run, "word bigint, n bigint, nt bigint")
    sums = parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("nt").alias("nt"))
    return sums.filter((F.col("n") >= MIN_COUNT) | (F.col("word") == TOTAL))


def common_words(counts: DataFrame, table: int) -> Words:
    """The at most ``table`` commonest words and the totals, at the driver."""
    known = counts.filter(F.col("word") != TOTAL)
    # At most 64 rows.
    levels = known.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)), F.sum("n"), F.sum("nt")).collect()
    least = _first_kept({r[0]: r[1] for r in levels}, table)
    kept = known.filter(F.col("n") >= least).toArrow()
    key, n, nt = (kept.column(c).to_numpy() for c in ("word", "n", "nt"))
    order = np.argsort(key)
    whole = counts.filter(F.col("word") == TOTAL).first()
    total, target_total = (whole.n, whole.nt) if whole else (0, 0)
    return Words(key[order], n[order], nt[order], sum(r[1] for r in levels) == len(key), least, sum(r[1] for r in levels), total, target_total,
                 total - sum(r[2] for r in levels), target_total - sum(r[3] for r in levels))


def open_pairs(rows: DataFrame, counts: DataFrame, model) -> DataFrame:
    """(id, target, open, more): each row's pairs with a word that is not broadcast, and the known ones of those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, bounds in chunks(b.column(1), CHUNK):
                row, cell, code = model.value.find(data, bounds)
                other = code == RARE
                order, first = _groups(mix(mix(row[other].astype(np.uint64)) + cell[other].astype(np.uint64)))
                at = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][row[other][at]]), pa.array(cell[other][at])], ["id", "word"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, target = b.column(0).to_numpy(), b.column(2)
            for lo, hi, data, bounds in chunks(b.column(1), CHUNK):
                row, cell, code = model.value.find(data, bounds)
                # A word that is not broadcast stands as its hash, below the marks.
                code = np.where(code == RARE, RARE - 1 - cell, code)
                before = _before(code, row, BEGIN)
                at = np.flatnonzero((code < RARE) | (before < RARE))
                some, first = np.unique(row[at], return_index=True)
                blobs = [zlib.compress(_pack(before[i], code[i]), 1) for i in np.split(at, first[1:])] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][some]), target.slice(lo, hi - lo).take(pa.array(some)), pa.array(blobs, pa.binary())],
                                                 ["id", "target", "open"])

    found = rows.select("id", "text").mapInArrow(run, "id bigint, word bigint")
    more = found.join(counts.filter((F.col("n") < model.value.least) & (F.col("word") != TOTAL)), "word").groupBy("id").agg(
        F.collect_set(F.struct("word", "n", "nt")).alias("more"))
    return cut(rows.mapInArrow(cut_out, "id bigint, target boolean, open binary").join(more, "id", "left"))


@dataclass
class Pairs:
    """Pairs of some rows in their order: row, hash, codes of both words; ``size`` has the words of each row."""

    ids: np.ndarray
    target: np.ndarray
    size: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    word: np.ndarray


def _pairs_of_texts(w: Words, batch: pa.RecordBatch) -> Iterator[Pairs]:
    """Of (id, text, target): the pairs of broadcast words; of all words, if those are all known ones."""
    ids, target = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
    for lo, hi, data, bounds in chunks(batch.column(1), CHUNK):
        row, _, code = w.find(data, bounds)
        size = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64)
        before = _before(code, row, BEGIN)
        if not w.whole:
            kept = (code != RARE) & (before != RARE)
            row, before, code = row[kept], before[kept], code[kept]
        yield Pairs(ids[lo:hi], target[lo:hi], size, row, w.pairs(before, code), before, code)


def _pairs_left_open(w: Words, batch: pa.RecordBatch) -> Iterator[Pairs]:
    """Of ``open_pairs``: all other pairs; their words count among those of the texts."""
    if not batch.num_rows:
        return
    ids, target = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    before, word = zip(*(_unpack(zlib.decompress(x.as_py()), 2) for x in batch.column(2)))
    row = np.repeat(np.arange(len(ids)), [len(x) for x in word])
    known, n, nt = (c.to_numpy() for c in batch.column(3).flatten().flatten())
    known, first = np.unique(known, return_index=True)
    of_known = RARE - 1 - (n[first] * w.least + nt[first])

    def resolved(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.where(code == BEGIN, START, UNKNOWN)
        cell[code >= 0] = w.key[code[code >= 0]]
        other = np.flatnonzero(code < RARE)
        at, there = _found(known, RARE - 1 - code[other])
        code[other] = RARE
        code[other[there]] = of_known[at[there]]
        cell[other[there]] = known[at[there]]
        return cell, code

    (b_cell, b_code), (w_cell, w_code) = resolved(np.concatenate(before)), resolved(np.concatenate(word))
    yield Pairs(ids, target, np.zeros(len(ids), np.int64), row, _pair_hashes(b_cell, w_cell) | 1, b_code, w_code)


def pair_parts(rows: DataFrame, read, model, piece_bits: int) -> DataFrame:
    """(piece, part): packed (pair, n, nt, whether several rows have it), counted together for some millions of pairs."""
    shift = HASH_BITS - piece_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, past = [], 0, 0

        def send() -> pa.RecordBatch:
            pair, row, mine = (np.concatenate(x) for x in zip(*kept))
            order, first = _groups(pair)
            last = np.append(first[1:], len(pair)) - 1
            key, n, nt = pair[order[first]], last - first + 1, np.add.reduceat(mine[order].astype(np.int64), first)
            several = row[order[first]] != row[order[last]]
            pieces, at = np.unique(key >> shift, return_index=True)
            ends = np.append(at[1:], len(key))
            blobs = [_pack_keys(key[i:j], p << shift, n[i:j], nt[i:j], several[i:j]) for p, i, j in zip(pieces.tolist(), at, ends)]
            return pa.RecordBatch.from_arrays([pa.array(pieces), pa.array(blobs, pa.binary())], ["piece", "part"])

        for b in batches:
            for x in read(model.value, b):
                if len(x.pair):
                    kept.append((x.pair, (x.row + past).astype(np.int32), x.target[x.row]))
                    size += len(x.pair)
                past += len(x.ids)
                if size >= FLUSH:
                    yield send()
                    kept, size, past = [], 0, 0
        if kept:
            yield send()

    return rows.mapInArrow(count, "piece bigint, part binary")


def pair_counts(parts: DataFrame, piece_bits: int) -> DataFrame:
    """(piece, pairs, sizes): the packed (pair, n, nt) of all pairs that several rows have, by pieces of the hashes' range."""
    shift = HASH_BITS - piece_bits

    def merge(part: pa.Table) -> pa.Table:
        piece = part.column("piece")[0].as_py()
        key, n, nt, several = (np.concatenate(x) for x in zip(*(_unpack_keys(x.as_py(), piece << shift, 4) for x in part.column("part"))))
        order, first = _groups(key)
        several = (np.add.reduceat(several[order], first) > 0) | (np.diff(np.append(first, len(key))) > 1)
        key, n, nt = key[order[first]][several], np.add.reduceat(n[order], first)[several], np.add.reduceat(nt[order], first)[several]
        sizes = np.bincount(np.frexp(n.astype(float))[1], minlength=64)
        return pa.table({"piece": pa.array([piece], pa.int64()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                         "pairs": pa.array([_pack_keys(key, piece << shift, n, nt)], pa.binary())})

    return parts.groupBy("piece").applyInArrow(merge, "piece bigint, sizes array<bigint>, pairs binary")


def _pairs_of(batch: pa.RecordBatch, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("pairs")):
        yield piece, *_unpack_keys(blob.as_py(), piece << shift, 3)


def common_pairs(pairs: DataFrame, piece_bits: int, table: int) -> tuple[tuple[np.ndarray, ...], int, np.ndarray]:
    """(the at most ``table`` commonest pairs, bits, table of bits of all other pairs), at the driver."""
    # At most 64 rows.
    sizes = {r.pos: r.n for r in pairs.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    least = _first_kept(sizes, table)
    others = sum(n for size, n in sizes.items() if 1 << size <= least)
    bits = max(piece_bits + 3, MIN_BITS, min(MAX_BITS, (16 * others).bit_length()))
    shift = HASH_BITS - piece_bits

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, key, n, nt in _pairs_of(b, shift):
                common = n >= least
                slots = np.zeros(1 << (bits - piece_bits), np.uint8)
                slots[(key[~common] >> (HASH_BITS - bits)) - (piece << (bits - piece_bits))] = 1
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([piece], pa.int64()), "common": pa.array([zlib.compress(_pack(key[common], n[common], nt[common]), 1)], pa.binary()),
                    "slots": pa.array([zlib.compress(np.packbits(slots, bitorder="little").tobytes(), 1)], pa.binary())})

    found, slots = [], np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (bits - piece_bits - 3)
    # A row for each piece; the pairs and bits together stay within their bounds.
    for r in pairs.select("piece", "pairs").mapInArrow(split, "piece bigint, common binary, slots binary").collect():
        slots[r.piece * step : (r.piece + 1) * step] = np.frombuffer(zlib.decompress(r.slots), np.uint8)
        found.append((r.piece, _unpack(zlib.decompress(r.common), 3)))
    found.sort(key=lambda x: x[0])
    columns = tuple(np.concatenate([c[i] for _, c in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return columns, bits, slots


def row_parts(rows: DataFrame, read, model, common, bits: int, piece_bits: int) -> DataFrame:
    """(piece, local, part, ids), by joint pieces: packed sums (id, words, sum) over the pairs known here, and the pairs that can be among the others'."""
    piece_bits -= min(JOINT_BITS, piece_bits)
    shift = HASH_BITS - piece_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ((keys, pn, pnt), slots) = model.value, common.value
        places = Places(keys)
        kept, size = [], 0

        def send() -> pa.RecordBatch:
            ids, pair, *rest = (np.concatenate(x) for x in zip(*kept))
            order = _sorted_order(pair)
            ids, pair, rest = ids[order], pair[order], [x[order] for x in rest]
            pieces, at = np.unique(pair >> shift, return_index=True)
            parts, of = [], []
            for p, i, j in zip(pieces.tolist(), at, np.append(at[1:], len(pair))):
                some, place = np.unique(ids[i:j], return_inverse=True)
                parts.append(_pack_keys(pair[i:j], p << shift, place, *(x[i:j] for x in rest)))
                of.append(_pack(some))
            return batch(pieces, [None] * len(pieces), parts, of)

        def batch(pieces, local, parts, of) -> pa.RecordBatch:
            columns = [pa.array(pieces, pa.int64()), pa.array(local, pa.binary()), pa.array(parts, pa.binary()), pa.array(of, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["piece", "local", "part", "ids"])

        for b in batches:
            for x in read(w, b):
                if not len(x.ids):
                    continue
                at, hit = places.found(x.pair)
                at = at[hit]
                s = np.bincount(x.row[hit], w.difference(pn[at], pnt[at], x.before[hit], x.word[hit]), len(x.ids)).astype(float)
                rest = np.flatnonzero(~hit)
                order, first = _groups(mix(mix(x.row[rest].astype(np.uint64)) + x.pair[rest].astype(np.uint64)))
                k, rest = np.diff(np.append(first, len(order))), rest[order[first]]
                mine = x.target[x.row[rest]]
                slot = x.pair[rest] >> (HASH_BITS - bits)
                sent = (slots[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                here, k_here = rest[~sent], k[~sent]
                s += np.bincount(x.row[here], w.difference(k_here, k_here * mine[~sent], x.before[here], x.word[here]) * k_here, len(x.ids))
                some = (x.size > 0) | (s != 0)
                # Any piece will do for the sums.
                yield batch([int(x.ids[0]) & ((1 << piece_bits) - 1)], [_pack(x.ids[some], x.size[some], s[some].view(np.int64))], [None], [None])
                at = rest[sent]
                if len(at):
                    # Even pairs tell their words.
                    told = (x.before[at], x.word[at]) if x.pair[0] & 1 else ()
                    kept.append((x.ids[x.row[at]], x.pair[at], k[sent], mine[sent], *told))
                    size += len(at)
                if size >= FLUSH // 2:
                    yield send()
                    kept, size = [], 0
        if kept:
            yield send()

    return rows.mapInArrow(run, "piece bigint, local binary, part binary, ids binary")


def row_sums(parts: DataFrame, pairs: DataFrame, model, piece_bits: int, sum_bits: int) -> DataFrame:
    """(id, mean): mean difference of rows; pairs meet their counts piece by piece, and a row's sums meet by pieces of the ids' range."""
    joint = min(JOINT_BITS, piece_bits)
    shift, sum_shift = HASH_BITS - piece_bits, 63 - sum_bits

    def total(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, words, sum) of ascending ids, from parts of them."""
        ids, k, s = (np.concatenate(x) for x in zip(*found))
        ids, place = np.unique(ids, return_inverse=True)
        return ids, np.bincount(place, k, len(ids)).astype(np.int64), np.bincount(place, s, len(ids)).astype(float)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w, sums = model.value, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        found = sorted((x for b in right.to_batches() for x in _pairs_of(b, shift)), key=lambda x: x[0])
        key, pn, pnt = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *(x[1:] for x in found)))
        for piece, local, part, of in zip(*(left.column(c) for c in ("piece", "local", "part", "ids"))):
            if local.is_valid:
                ids, k, s = _unpack(local.as_py(), 3)
                sums.append((ids, k, s.view(float)))
                continue
            blob, base = part.as_py(), piece.as_py() << (shift + joint)
            (ids,) = _unpack(of.as_py(), 1)
            if blob[0]:
                pair, place, k, mine = _unpack_keys(blob, base, 4)
                before, word = w.codes(pair)
            else:
                pair, place, k, mine, before, word = _unpack_keys(blob, base, 6)
            at, hit = _found(key, pair)
            n, nt = k.copy(), k * mine
            n[hit], nt[hit] = pn[at[hit]], pnt[at[hit]]
            sums.append((ids, np.zeros(len(ids), np.int64), np.bincount(place, w.difference(n, nt, before, word) * k, len(ids)).astype(float)))
        ids, k, s = total(sums)
        some, at = np.unique(ids >> sum_shift, return_index=True)
        blobs = [_pack(np.diff(ids[i:j], prepend=p << sum_shift), k[i:j], s[i:j].view(np.int64)) for p, i, j in zip(some.tolist(), at, np.append(at[1:], len(ids)))]
        return pa.table({"of": pa.array(some, pa.int64()), "sums": pa.array(blobs, pa.binary())})

    def means(part: pa.Table) -> pa.Table:
        base, found = part.column("of")[0].as_py() << sum_shift, []
        for blob in part.column("sums"):
            delta, k, s = _unpack(blob.as_py(), 3)
            found.append((base + np.cumsum(delta), k, s.view(float)))
        ids, k, s = total(found)
        return pa.table({"id": ids, "mean": s / k})

    counts = pairs.select(F.shiftright("piece", joint).alias("joint"), "piece", "pairs").groupBy("joint")
    sums = parts.groupBy("piece").cogroup(counts).applyInArrow(run, "of bigint, sums binary")
    return sums.groupBy("of").applyInArrow(means, "id bigint, mean double")


def scored(docs: DataFrame, target_ids: DataFrame, table: int = TABLE) -> DataFrame:
    """(doc_id, n_tokens, ce_difference) of every row. ``table`` bounds what is broadcast and does not change the result."""
    sc = docs.sparkSession.sparkContext
    listed = broadcast_if_small(target_ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("target", F.lit(True)), 1_000_000)
    # Equal rows share an id and have equal scores.
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("id"))
    rows = own.join(listed, "doc_id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = cut(word_counts(rows))
    w = common_words(counts, table)
    model = sc.broadcast(w)
    piece_bits = min(MAX_PIECE_BITS, (w.total // PIECE_TOKENS).bit_length())
    sources = [(rows, _pairs_of_texts)]
    if not w.whole:
        sources.append((open_pairs(rows, counts, model), _pairs_left_open))

    def of_all(part, *args) -> DataFrame:
        return reduce(DataFrame.unionAll, [part(df, read, model, *args, piece_bits) for df, read in sources])

    pairs = cut(pair_counts(of_all(pair_parts), piece_bits))
    columns, bits, slots = common_pairs(pairs, piece_bits, table)
    sum_bits = min(MAX_PIECE_BITS, (w.total // SUM_TOKENS).bit_length())
    means = row_sums(of_all(row_parts, sc.broadcast((columns, slots)), bits), pairs, model, piece_bits, sum_bits)
    text = F.coalesce("text", F.lit(""))
    n_tokens = F.size(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")).cast("bigint")
    return own.select("doc_id", "id", n_tokens.alias("n_tokens")).join(means, "id", "left").select(
        "doc_id", "n_tokens", F.coalesce("mean", F.lit(0.0)).alias("ce_difference"))

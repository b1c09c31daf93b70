"""Operator 6: pack token pieces into sequences by cutting-stock column generation.

Documents are tokenized and cut at multiples of the sequence length, so each leaves some full
pieces and one shorter piece. Full pieces are sequences of their own. The histogram of short
lengths, in units of a few tokens, is the demand of a cutting-stock problem: a linear program over
patterns (how many pieces of each length share a sequence) is solved by the simplex method, with
an unbounded-knapsack dynamic program pricing new columns, until Farley's bound shows the gap to be
small. The solution is rounded down; the documents of a length, ranked by a distributed count, fill
the slots of its patterns in order. The few pieces beyond the rounded patterns (at most one
sequence per pattern) are packed by their exact lengths with best-fit decreasing.

The driver only sees histograms of at most ``size`` lengths; token ids never leave the tasks.

Defined results: a NULL or empty text is its end token alone. Rows that repeat a ``doc_id`` are
separate documents with equal pieces; NULL ``doc_id`` is carried along. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.text import chunks, mix, span_hashes, words
from canopyframe.session import cut

END_ID = 1
UNIT = 4
GAP = 1e-3


class WordIds:
    """Ids of white-space-separated words, kept between batches of one Python worker.

    The tokenizer drops white space and never joins characters across it, so a text's ids are its
    words' ids in order. ``limit`` words are kept (ids take two or four bytes each); beyond it the
    memory starts anew, which costs time and changes no result.
    """

    def __init__(self, path: str, limit: int = 1_500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the number of ids of each."""
        texts = [b.decode("utf-8", "replace") for b in found]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        first = np.cumsum(lengths + 1) - lengths - 1
        at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
        return np.array(e.ids, np.uint32), np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(texts))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's words in order, and the number of ids of each word."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        u, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == u) if len(self.keys) else np.zeros(len(u), bool)
        if not known.all():
            if len(self.keys) + len(u) > self.limit:
                self._clear()
                known[:] = False
            new = first[~known]
            raw = data.tobytes()
            ids, count = self._encode([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            keys = np.concatenate([self.keys, u[~known]])
            begin = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            counts = np.concatenate([self.count, count.astype(np.int32)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.start, self.count = keys[order], begin[order], counts[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, u)
        count = self.count[at][inverse].astype(np.int64)
        begin = self.start[at][inverse]
        jump = np.repeat(begin - (np.cumsum(count) - count), count)
        return self.ids[jump + np.arange(len(jump))], count


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece, cut at multiples of ``size``: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1), 1 << 21):
                start, end, row = words(data, bounds)
                ids, count = encode(data, start, end)
                per_row = np.bincount(row, weights=count, minlength=hi - lo).astype(np.int64) if len(row) else np.zeros(hi - lo, np.int64)
                # Put the end token after each document.
                stop = np.cumsum(per_row)
                ids = np.insert(ids, stop, END_ID).astype("<u4")
                tokens = per_row + 1
                begin = np.cumsum(tokens) - tokens
                n = -(-tokens // size)
                doc = np.repeat(np.arange(hi - lo), n)
                first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, tokens[doc] - first)
                a = (begin[doc] + first).tolist()
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k in zip(a, length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(first), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(tokens[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best value and the number of each item."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1, np.int32)
    for i in np.argsort(-weight):
        w, v = int(weight[i]), value[i]
        if v <= 0:
            continue
        for a in range(w, room + 1, w):  # a block may build on the block before it
            b = min(room + 1, a + w)
            new = best[a - w : b - w] + v
            better = new > best[a:b] + 1e-12
            if better.any():
                best[a:b][better] = new[better]
                last[a:b][better] = i
    count = np.zeros(len(value), np.int64)
    at = int(np.argmax(best))
    while at > 0 and last[at] >= 0:
        count[last[at]] += 1
        at -= int(weight[last[at]])
    return float(best.max()), count


def first_fit_basis(weight: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: first-fit-decreasing patterns, each used until one of its lengths runs out.

    Later patterns lack that length, so the columns form a triangular, invertible matrix.
    """
    m = len(weight)
    left, alive = demand.astype(np.float64), np.ones(m, bool)
    columns, use = np.zeros((m, m)), np.zeros(m)
    for t in range(m):
        space, column = room, np.zeros(m)
        for i in np.flatnonzero(alive)[::-1].tolist():
            if weight[i] <= space:
                k = min(space // weight[i], max(1, int(left[i]))) if column.any() else 1
                column[i] = k
                space -= int(k * weight[i])
        ratio = np.full(m, np.inf)
        has = column > 0
        ratio[has] = left[has] / column[has]
        i = int(np.argmin(ratio))
        columns[:, t], use[t] = column, ratio[i]
        left -= ratio[i] * column
        left[i], alive[i] = 0.0, False
    return columns, use


def cutting_stock(weight: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used) of the relaxed cutting-stock problem.

    Stops when the solution is within ``gap`` of the best bound (Farley's, or all rooms filled), or
    after ``rounds`` columns; every stop leaves a valid solution.
    """
    columns, use = first_fit_basis(weight, demand, room)
    inverse = np.linalg.inv(columns)
    sound = columns.copy(), use
    bound = weight @ demand / room
    for turn in range(1, rounds + 1):
        price = inverse.sum(axis=0)
        value, pattern = knapsack(np.maximum(price, 0.0), weight, room)
        bound = max(bound, price @ demand / value)
        if price @ pattern <= 1 + 1e-9 or use.sum() * (1 - gap) <= bound:
            break
        step = inverse @ pattern
        ratio = np.full(len(weight), np.inf)
        rising = step > 1e-7
        ratio[rising] = np.maximum(use[rising], 0.0) / step[rising]
        # Of equal ratios the largest pivot keeps the basis well conditioned.
        out = int(np.argmax(np.where(ratio <= ratio.min() + 1e-9, step, -np.inf)))
        by = ratio[out]
        use = use - by * step
        use[out] = by
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if turn % 25 == 0:
            # Start again from an exact inverse; a basis that has become singular is given up.
            try:
                inverse = np.linalg.inv(columns)
            except np.linalg.LinAlgError:
                return sound[0].astype(np.int64), sound[1]
            use = np.maximum(inverse @ demand, 0.0)
            if not np.allclose(columns @ use, demand, rtol=1e-6, atol=1e-6):
                return sound[0].astype(np.int64), sound[1]
            sound = columns.copy(), use
    use = np.maximum(use, 0.0)
    if not np.allclose(columns @ use, demand, rtol=1e-6, atol=1e-6):
        columns, use = sound
    return columns.astype(np.int64), use


def best_fit(lengths: dict[int, int], room: int) -> Counter:
    """Patterns (tuples of lengths, longest first) of best-fit decreasing on a histogram."""
    open_bins: list[list[tuple[int, ...]]] = [[] for _ in range(room + 1)]
    for length in sorted(lengths, reverse=True):
        for _ in range(lengths[length]):
            left = next((r for r in range(length, room + 1) if open_bins[r]), None)
            old: tuple[int, ...] = open_bins[left].pop() if left is not None else ()
            open_bins[(room if left is None else left) - length].append((*old, length))
    return Counter(p for b in open_bins for p in b)


def ranked(df: DataFrame, group: str, rank: str, groups: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each value of the int column ``group`` (below ``groups``).

    Each task numbers its own rows; counts per task and group carry the start. A group may hold any
    share of the rows. ``df`` must be materialised, so that its partitions stay as they are.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(groups, np.int64)
        for b in batches:
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(g, kind="stable")
            s = g[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            within = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
            at = np.empty(len(s), np.int64)
            at[order] = within + seen[s]
            seen += np.bincount(g, minlength=groups)
            part = pa.array(np.full(len(s), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, part, pa.array(at)], [*b.schema.names, "_task", rank])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    out = cut(df.mapInArrow(local, f"{fields}, _task int, {rank} bigint"))
    tasks = out.groupBy("_task", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("_task", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return out.join(starts, ["_task", group]).withColumn(rank, F.col(rank) + F.col("_from")).drop("_task", "_from")


class Slots:
    """Where the n-th piece of a group goes: sequence and slot, from patterns and their use."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], groups: int, first: int) -> None:
        runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(groups)]  # (from rank, per sequence, first sequence, first slot)
        filled = np.zeros(groups, np.int64)
        for pattern, times in patterns:
            slot = 0
            for g in np.flatnonzero(pattern)[::-1].tolist():
                k = int(pattern[g])
                runs[g].append((int(filled[g]), k, first, slot))
                filled[g] += k * times
                slot += k
            first += times
        self.filled, self.next = filled, first
        self.starts = np.cumsum([0, *map(len, runs)])
        flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 4)
        self.base, self.per, self.sequence, self.slot = flat.T
        # Ranks of all groups on one line, so that one search finds every row's run.
        self.span = int(filled.max(initial=0)) + 1
        self.line = self.base + np.repeat(np.arange(groups), np.diff(self.starts)) * self.span

    def __call__(self, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.line, group * self.span + rank, "right") - 1
        within = rank - self.base[run]
        return self.sequence[run] + within // self.per[run], self.slot[run] + within % self.per[run]


def _placed(df: DataFrame, group: str, rank: str, slots: Slots) -> DataFrame:
    if not len(slots.line):
        return df.filter("false").withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("slot", F.lit(0).cast("bigint"))
    shared = df.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (group, rank))
            s, slot = shared.value(g, r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, sequence_id bigint, slot bigint")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, unit: int = UNIT) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    room, longest = size // unit, size // unit
    all_pieces = cut(pieces(docs, tokenizer, size).withColumn(
        "bin", F.when(F.col("length") == size, 0).otherwise(F.ceil(F.col("length") / unit)).cast("int")))
    counts = {r["bin"]: r["n"] for r in all_pieces.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.pop(0, 0)
    in_bins = cut(ranked(all_pieces, "bin", "rank", longest + 1))
    schema = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = in_bins.filter("bin = 0").select(*schema, F.col("rank").alias("sequence_id"), F.lit(0).cast("bigint").alias("slot"))
    used: list[tuple[np.ndarray, int]] = []
    if counts:
        weight = np.array(sorted(counts), np.int64)
        columns, use = cutting_stock(weight, np.array([counts[w] for w in weight], np.float64), room)
        for column, times in zip(columns.T, np.floor(use + 1e-9).astype(np.int64)):
            if times > 0:
                pattern = np.zeros(longest + 1, np.int64)
                pattern[weight] = column
                used.append((pattern, int(times)))
    # Rounding and the gap's tolerance may leave a pattern more slots than pieces: trim those.
    left = np.zeros(longest + 1, np.int64)
    for w, n in counts.items():
        left[w] = n
    fitting = []
    for pattern, times in used:
        has = pattern > 0
        times = min(times, int((left[has] // pattern[has]).min()))
        if times > 0:
            fitting.append((pattern, times))
            left -= pattern * times
    slots = Slots(fitting, longest + 1, full)
    limit = F.element_at(F.array(*[F.lit(int(x)) for x in slots.filled]), F.col("bin") + 1)
    short = in_bins.filter("bin > 0").withColumn("_in", F.col("rank") < limit)
    main = _placed(short.filter("_in").select(*schema, "bin", "rank"), "bin", "rank", slots).select(*schema, "sequence_id", "slot")
    rest = cut(short.filter(~F.col("_in")).select(*schema, F.col("length").cast("int").alias("exact")))
    lengths = {int(r["exact"]): int(r["n"]) for r in rest.groupBy("exact").agg(F.count(F.lit(1)).alias("n")).collect()}
    fits = []
    for bins, times in sorted(best_fit(lengths, size).items()):
        pattern = np.zeros(size + 1, np.int64)
        np.add.at(pattern, list(bins), 1)
        fits.append((pattern, times))
    tail = _placed(ranked(rest, "exact", "rank", size + 1), "exact", "rank", Slots(fits, size + 1, slots.next)).select(*schema, "sequence_id", "slot")
    placed = whole.unionByName(main).unionByName(tail)
    # A sequence holds at most ``size`` pieces.
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*schema, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))

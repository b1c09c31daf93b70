"""Operator 4: quality classifier of naive-Bayes-scaled n-grams under a linear hinge loss.

Features are n-gram indicators: word unigrams and bigrams, and uni- to trigrams of word shapes (letter
case, digits, trailing sign, repetition of recent words), hashed into ``BUCKETS`` cells. Spark counts
each cell over all labelled training rows of either class; the log ratio of the smoothed counts scales
the indicators. A linear model on the scaled, normalised vectors is fitted by dual coordinate descent
on the ``SAMPLE`` different training rows of least hash, fewer where their texts exceed ``SAMPLE_BYTES``
(bounds on what the driver holds: mostly some 3 bytes of cells a byte of text, 10 at worst), its weights are averaged with their mean size as usual for this model, and a logistic curve fitted on rows
of the sample that the descent did not see turns margins into scores.

Defined results: a NULL or empty text has no features and gets the score of margin 0 shifted by the
curve. Labels are taken from ``quality``; NULL ones are ignored, and of several for one document the
largest counts. A NULL ``doc_id`` is never held out, has no label and is scored. Repeated rows get
equal scores and count once in the sample. Without labels of both classes every score is the share of label 1 (0.5 if there are no
labels). Empty tables give empty results. Other columns are ignored: neither ``lang`` nor ``source``
nor ``doc_id`` is read by the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.text import chunks, gram_hashes, mix, span_hashes, words
from canopyframe.operators.ordered import smallest
from canopyframe.session import broadcast_if_small, cut

BUCKETS = 1 << 18
SAMPLE = 12_000
SAMPLE_BYTES = 64 << 20
FOLDS = 5
THRESHOLD = 0.3

_KIND = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 byte of another letter
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A small code of each word's look: letter case, digits, signs, last sign, recent repetition."""
    kind = _KIND[data]
    counts = []
    for k in (0, 1, 2, 3):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=sums[1:])
        counts.append(sums[end] - sums[start])
    lower, upper, digit, sign = counts
    last = data[end - 1].astype(np.uint64)
    code = np.minimum(upper, 2) * 3 + np.minimum(lower, 2)
    code = (code * 2 + (digit > 0)) * 4 + np.minimum(sign, 3)
    code = code.astype(np.uint64) * np.uint64(256) + np.where(_KIND[data[end - 1]] == 3, last, np.uint64(0))
    near = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3, 4):
        if len(h) > back:
            near[back:] |= ((h[back:] == h[:-back]) & (row[back:] == row[:-back])).astype(np.uint64) << np.uint64(back > 1)
    return mix(code * np.uint64(4) + near)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell), each pair once, sorted by row."""
    start, end, row = words(data, bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hashes(data, start, end, lower=True)
    shape = _shapes(data, start, end, h, row)
    keys = []
    for salt, (values, n) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3))):
        g, at = gram_hashes(values, row, n)
        cell = mix(g + np.uint64(salt * 7919 + 13)) % np.uint64(BUCKETS)
        keys.append(row[at].astype(np.uint64) * np.uint64(BUCKETS) + cell)
    key = np.unique(np.concatenate(keys))
    return (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of labelled documents that are not held out."""
    y = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    y = broadcast_if_small(y.filter(~held_out(F.col("doc_id"))), 1_000_000)
    return docs.select("doc_id", "text").join(y, "doc_id")


def cell_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of label 1 and of label 0 that have each cell; the last entry counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in chunks(b.column(0)):
                row, cell = features(data, bounds)
                for k in (0, 1):
                    total[k, :-1] += np.bincount(cell[y[lo:hi][row] == k], minlength=BUCKETS)
                    total[k, -1] += int((y[lo:hi] == k).sum())
        cells = np.flatnonzero(total.any(axis=0))
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[1, cells]), pa.array(total[0, cells])], ["cell", "good", "poor"])

    sums = rows.select("text", "y").mapInArrow(count, "cell bigint, good bigint, poor bigint").groupBy("cell").agg(
        F.sum("good").alias("good"), F.sum("poor").alias("poor"))
    good, poor = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in sums.toLocalIterator():  # at most BUCKETS + 1 rows
        good[r["cell"]], poor[r["cell"]] = r["good"], r["poor"]
    return good, poor


def log_ratio(good: np.ndarray, poor: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = good[:-1] + alpha, poor[:-1] + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(cells: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM by dual coordinate descent.

    The penalty of each class is weighted so that both count alike.
    """
    w, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2
    upper = c * share
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            f, v = cells[i], values[i]
            slope = y[i] * (w[f] @ v + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), upper[i])
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                w[f] += step * v
                bias += step
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of most likely labels, with smoothed targets, by Newton steps."""
    n1, n0 = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * theta)
        theta += np.clip(step, -5, 5)
    return float(max(theta[0], 0.0)), float(theta[1])


class Model:
    """``weight`` already holds the scaling ratio; margins are divided by the norm of the scaled vector."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.square, self.weight, self.bias, self.slope, self.shift = (ratio**2).astype(np.float32), (weight * ratio).astype(np.float32), bias, slope, shift

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, cell = features(data, bounds)
        n = len(bounds) - 1
        dot = np.bincount(row, weights=self.weight[cell], minlength=n)
        norm = np.sqrt(np.bincount(row, weights=self.square[cell], minlength=n))
        return dot / np.maximum(norm, 1e-9) + self.bias

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, bounds) + self.shift, -30, 30)))


def drawn_rows(rows: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(place, text, y) of the ``sample`` different (doc_id, text) of least place, a hash of both.

    The last place is found on hashes and sizes alone by radix selection, so no task gathers texts, and it
    comes earlier where the texts, each counted with at most ``BUCKETS`` bytes, would exceed ``most_bytes``.
    """
    placed = rows.select(F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 1).alias("place"), "text", "y")
    size = F.least(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(BUCKETS)).cast("bigint")
    sizes = cut(placed.select("place", size.alias("size")).groupBy("place").agg(F.max("size").alias("size")))
    least = smallest(sizes, sample, F.col("place"), ["place"]).toPandas().sort_values("place")  # at most ``sample`` rows of two numbers
    inside = least["place"][least["size"].cumsum() <= max(most_bytes, BUCKETS)]
    return placed.filter(F.col("place") <= F.lit(int(inside.max()) if len(inside) else -1)).dropDuplicates(["place"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, smooth: float = 0.25) -> Model | float:
    """The model, or the constant score where there are no two classes to learn from."""
    rows = training_rows(docs, labels)
    good, poor = cell_counts(rows)
    if not good[-1] or not poor[-1]:
        return float(good[-1] / (good[-1] + poor[-1])) if good[-1] + poor[-1] else 0.5
    ratio = log_ratio(good, poor)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1)):
                row, cell = features(data, bounds)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
                raw = cell.astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                    pa.array([raw[4 * a : 4 * e] for a, e in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())], ["place", "y", "cells"])

    drawn = drawn_rows(rows, sample).mapInArrow(listed, "place bigint, y int, cells binary").toPandas().sort_values("place")
    y = np.where(drawn["y"].to_numpy() > 0, 1, -1)
    cells = [np.frombuffer(c, np.int32) for c in drawn["cells"]]
    values = [v / max(float(np.sqrt(v @ v)), 1e-9) for v in (ratio[c] for c in cells)]
    place = drawn["place"].to_numpy()
    apart = place % 4 == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    inside = np.flatnonzero(~apart)
    if len(set(y[inside])) < 2:
        return float(good[-1] / (good[-1] + poor[-1]))
    w, bias = descend([cells[i] for i in inside], [values[i] for i in inside], y[inside])
    used = w[w != 0]
    w = (1 - smooth) * (np.abs(used).mean() if len(used) else 0.0) + smooth * w
    test = np.flatnonzero(apart) if apart.any() else inside
    margin = np.array([w[cells[i]] @ values[i] + bias for i in test])
    return Model(ratio, w, bias, *logistic(margin, y[test]))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1)):
                s = np.full(hi - lo, m) if isinstance(m, float) else m.scores(data, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

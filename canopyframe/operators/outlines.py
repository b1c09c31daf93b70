"""Outlines of zones from their unit edges, traced by blocks and joined over block borders.

The edges of a zone form closed curves: every edge has one edge after it, a right turn where two
outlines meet in a corner. Each block of a zone is traced on its own, which gives finished rings and
open chains that leave the block. A chain's successor starts at the corner where it ends, so one
equi-join links all chains; pointer jumping then finds in logarithmically many rounds which chains
belong to one ring and in what order. Only the last step holds a whole ring, which its output row
does anyway. Tracing, cleaning and simplification are vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.session import cut

ZONE = ("scene_id", "risk_class", "zone")
#: So many open chains are put in order by one task; more by pointer jumping, with the same result.
FEW = 200_000
_ZONE = "scene_id string, risk_class int, zone bigint"
#: Steps along an edge by direction: right, down, left, up; the zone lies on the right hand.
DX, DY = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])
_POINTS = "array<struct<x:int,y:int>>"
_CHAIN = f"{_ZONE}, chain bigint, head bigint, tail bigint, n bigint, points {_POINTS}"


def corner_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (y.astype(np.int64) << 32) | x.astype(np.int64)


def successors(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Index of the edge after each edge (start corner and direction), or -1 where it is not among them.

    A right turn stays with the same pixel, so it is here if it exists at all; without one only one
    edge starts at the corner, here or elsewhere.
    """
    n = len(x)
    start, end = corner_key(x, y), corner_key(x + DX[d], y + DY[d])
    order = np.lexsort((d, start))
    keys, turns = start[order], d[order]
    lo, hi = np.searchsorted(keys, end, "left"), np.searchsorted(keys, end, "right")
    here = hi > lo
    first, second = np.minimum(lo, n - 1), np.minimum(hi - 1, n - 1)
    right = (d + 1) % 4
    pick = np.where(turns[second] == right, second, first)
    return np.where(here, order[pick], -1)


def chains(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bounds, closed) of the paths and cycles of a successor table.

    ``order`` lists the edges path by path, a path's edges in order, a cycle's from its least index.
    """
    n = len(after)
    jump = np.append(np.where(after < 0, n, after), n)
    step, least = jump.copy(), np.append(np.arange(n), n)
    rounds = int(n).bit_length() + 1
    for _ in range(rounds):
        least = np.minimum(least, least[step])
        step = step[step]
    cyclic = step[:n] < n
    # Cut every cycle before its least edge.
    cutting = cyclic & (jump[:n] == least[:n])
    jump[:n][cutting] = n
    left = np.append(np.ones(n, np.int64), 0)
    last = np.where(jump == n, np.arange(n + 1), jump)
    step = jump.copy()
    for _ in range(rounds):
        left = left + left[step]
        last = last[last]
        step = step[step]
    order = np.lexsort((-left[:n], last[:n]))
    ends = last[:n][order]
    bounds = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1], [True]])) if n else np.zeros(1, np.int64)
    return order, bounds, cyclic[order[bounds[:-1]]] if n else np.zeros(0, bool)


def corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points of a closed curve of horizontal and vertical steps are turns."""
    dx, dy = np.sign(np.roll(x, -1) - x), np.sign(np.roll(y, -1) - y)
    return (dx != np.roll(dx, 1)) | (dy != np.roll(dy, 1))


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept of a line by recursive splitting at the farthest point beyond ``tolerance``."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        p, a, v = points[lo + 1 : hi], points[lo], points[hi] - points[lo]
        length = float(v @ v)
        t = np.clip((p - a) @ v / length, 0.0, 1.0) if length > 0 else np.zeros(len(p))
        gap = np.hypot(*(p - a - t[:, None] * v).T)
        far = int(np.argmax(gap))
        if gap[far] > tolerance:
            keep[lo + 1 + far] = True
            todo += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    return np.flatnonzero(keep)


def _points(x: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)


def block_chains(edges: DataFrame, block: int) -> DataFrame:
    """Traced chains of every block of a zone: (zone, chain, head corner, tail corner or NULL if closed, edges, turns)."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = F.when(dx > 0, 0).when(dy > 0, 1).when(dx < 0, 2).otherwise(3)
    e = edges.select(*ZONE, F.col("x0").alias("x"), F.col("y0").alias("y"), turn.alias("d"))
    # The pixel on the right hand of the edge says the block, so that a right turn never leaves it.
    px = F.col("x") - F.when(F.col("d").isin(1, 2), 1).otherwise(0)
    py = F.col("y") - F.when(F.col("d").isin(2, 3), 1).otherwise(0)
    e = e.withColumns({"_r": F.floor(py / F.lit(block)), "_c": F.floor(px / F.lit(block))})
    # At most four edges for each pixel of a block.
    groups = e.groupBy(*ZONE, "_r", "_c").agg(F.collect_list(F.struct("x", "y", "d")).alias("e")).select(*ZONE, "e.x", "e.y", "e.d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y, d = (b.column(k)[i].values.to_numpy().astype(np.int64) for k in (3, 4, 5))
                order, bounds, closed = chains(successors(x, y, d))
                x, y, d = x[order], y[order], d[order]
                first, last = bounds[:-1], bounds[1:] - 1
                turns = np.concatenate([[True], d[1:] != d[:-1]])
                turns[first] = True
                n = len(first)
                head = corner_key(x[first], y[first])
                tail = corner_key(x[last] + DX[d[last]], y[last] + DY[d[last]])
                kept = np.concatenate([[0], np.cumsum(turns)])[bounds]
                same = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(k).slice(i, 1).take(same) for k in range(3)), pa.array(head * 4 + d[first]), pa.array(head), pa.array(tail, mask=closed),
                    pa.array(np.diff(bounds).astype(np.int64)), _points(x[turns], y[turns], kept)], ["scene_id", "risk_class", "zone", "chain", "head", "tail", "n", "points"])

    return groups.mapInArrow(run, _CHAIN)


def _ordered_at_once(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if batches else None
        if t is None or not t.num_rows:
            return
        zone = pa.compute.dictionary_encode(pa.array([f"{a}|{b}|{c}" for a, b, c in zip(*(t.column(i).to_pylist() for i in range(3)))])).indices.to_numpy().astype(np.int64)
        chain, after = (t.column(i).to_numpy() for i in (3, 4))
        by = np.lexsort((chain, zone))
        pair = np.empty(len(by), [("z", np.int64), ("c", np.int64)])
        pair["z"], pair["c"] = zone[by], chain[by]
        want = np.empty(len(by), pair.dtype)
        want["z"], want["c"] = zone[by], after[by]
        order, bounds, _ = chains(np.searchsorted(pair, want))
        ring = np.repeat(pair["c"][order[bounds[:-1]]], np.diff(bounds))
        place = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(order))
        rows = t.take(pa.array(by[order])).combine_chunks()
        yield from pa.Table.from_arrays([*(rows.column(i) for i in range(4)), pa.array(ring), pa.array(place.astype(np.int64))],
                                        ["scene_id", "risk_class", "zone", "chain", "ring", "place"]).to_batches()

    return links.select(*ZONE, "chain", "after").coalesce(1).mapInArrow(run, f"{_ZONE}, chain bigint, ring bigint, place bigint")


def ring_order(links: DataFrame) -> DataFrame:
    """(zone, chain, ring, place) from (zone, chain, after): cycles of chains by pointer jumping.

    A ring is named by its least chain; its chains have falling ``place``, the least one first.
    """
    if links.count() <= FEW:
        return _ordered_at_once(links)
    state = links.select(*ZONE, "chain", F.col("after").alias("jump"), F.least("chain", "after").alias("ring"))
    while True:
        state = cut(state)
        ahead = state.select(*ZONE, F.col("chain").alias("jump"), F.col("jump").alias("_j"), F.col("ring").alias("_r"))
        moved = state.join(ahead, [*ZONE, "jump"])
        if moved.filter("_r != ring").isEmpty():
            break
        state = moved.select(*ZONE, "chain", F.col("_j").alias("jump"), F.least("ring", "_r").alias("ring"))
    rings = state.select(*ZONE, "chain", "ring")
    # Cut before the least chain, then count the chains up to the end.
    open_ = links.join(rings, [*ZONE, "chain"]).select(
        *ZONE, "chain", "ring", F.when(F.col("after") != F.col("ring"), F.col("after")).alias("jump"), F.lit(1).cast("bigint").alias("place"))
    while True:
        open_ = cut(open_)
        if open_.filter("jump is not null").isEmpty():
            return open_.select(*ZONE, "chain", "ring", "place")
        ahead = open_.select(*ZONE, F.col("chain").alias("jump"), F.col("jump").alias("_j"), F.col("place").alias("_p"))
        open_ = open_.join(ahead, [*ZONE, "jump"], "left").select(
            *ZONE, "chain", "ring", F.col("_j").alias("jump"), (F.col("place") + F.coalesce("_p", F.lit(0))).alias("place"))


def zone_rings(edges: DataFrame, simplify_px: float = 0.5, block: int = 256) -> DataFrame:
    """Outline rings per zone, simplified; ``rings`` in pixel corners, the largest (outer) first.

    ``edges``: scene_id, risk_class, zone and unit steps x0, y0, x1, y1 with the zone on the right hand.
    A ring starts and ends at its corner of least x, then y.
    """
    pieces = cut(block_chains(edges, block))
    loose = pieces.filter("tail is not null")
    if loose.isEmpty():
        placed = pieces.withColumns({"ring": F.col("chain"), "place": F.lit(1).cast("bigint")})
    else:
        heads = loose.select(*ZONE, F.col("head").alias("tail"), F.col("chain").alias("after"))
        order = ring_order(cut(loose.select(*ZONE, "chain", "tail").join(heads, [*ZONE, "tail"]).select(*ZONE, "chain", "after")))
        # A zone's rings only meet their chains here.
        joined = loose.join(order, [*ZONE, "chain"])
        placed = pieces.filter("tail is null").withColumns({"ring": F.col("chain"), "place": F.lit(1).cast("bigint")}).unionByName(joined)
    whole = placed.groupBy(*ZONE, "ring").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("k"), "points"))), lambda c: c["points"])).alias("p")).select(*ZONE, "p.x", "p.y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y = (b.column(k)[i].values.to_numpy().astype(np.int64) for k in (3, 4))
                turns = corners(x, y)
                ring = np.column_stack([x[turns], y[turns]]).astype(np.float64)
                ring = np.roll(ring, -int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), axis=0)
                closed = np.concatenate([ring, ring[:1]])
                if simplify_px > 0:
                    slim = closed[thinned(closed, simplify_px)]
                    closed = slim if len(slim) >= 4 else closed
                u, v = closed[:-1].T
                area = abs(float(np.sum(np.roll(u, 1) * v - u * np.roll(v, 1)))) / 2.0
                points = pa.ListArray.from_arrays(pa.array(np.arange(len(closed) + 1, dtype=np.int32) * 2), pa.array(closed.ravel()))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(k).slice(i, 1) for k in range(3)), pa.array([-area]), pa.array([closed[0, 0]]), pa.array([closed[0, 1]]),
                    pa.ListArray.from_arrays(pa.array([0, len(closed)], pa.int32()), points)], ["scene_id", "risk_class", "zone", "k", "x", "y", "ring"])

    traced = whole.mapInArrow(run, f"{_ZONE}, k double, x double, y double, ring array<array<double>>")
    return traced.groupBy(*ZONE).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y", "ring"))), lambda r: r["ring"]).alias("rings"))

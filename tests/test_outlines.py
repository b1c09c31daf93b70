"""Outlines over blocks: combs, holes, pinched corners, many blocks, against a plain walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.functions import geometry as G
from canopyframe.operators import outlines as OL
from canopyframe.operators import zones as Z


def edges_of(mask):
    """Unit edges (x0, y0, x1, y1) of a boolean image."""
    m = np.pad(mask, 1)
    out = []
    for y, x in zip(*np.nonzero(mask)):
        if not m[y, x + 1]:
            out.append((x, y, x + 1, y))
        if not m[y + 1, x + 2]:
            out.append((x + 1, y, x + 1, y + 1))
        if not m[y + 2, x + 1]:
            out.append((x + 1, y + 1, x, y + 1))
        if not m[y + 1, x]:
            out.append((x, y + 1, x, y))
    return [tuple(map(int, e)) for e in out]


def walked(edges):
    """Rings by walking, right turns first, turns only, from the least corner."""
    nxt = {}
    for a, b, c, d in edges:
        nxt.setdefault((a, b), []).append((c, d))
    rings = []
    while nxt:
        start = min(nxt)
        at, heading, ring = start, None, []
        while True:
            options = nxt[at]
            right = None if heading is None else (at[0] - heading[1], at[1] + heading[0])
            to = right if right in options else options[0]
            options.remove(to)
            if not options:
                del nxt[at]
            heading = (to[0] - at[0], to[1] - at[1])
            ring.append(at)
            at = to
            if at == start:
                break
        n = len(ring)
        turns = [p for i, p in enumerate(ring) if (ring[i - 1][0] - p[0]) * (ring[(i + 1) % n][1] - p[1]) != (ring[i - 1][1] - p[1]) * (ring[(i + 1) % n][0] - p[0])]
        low = turns.index(min(turns))
        rings.append([*turns[low:], *turns[:low]])
    return sorted(rings)


def traced(spark, mask, block, simplify=0.0):
    rows = [("s", 1, 7, *e) for e in edges_of(mask)]
    df = spark.createDataFrame(rows, "scene_id string, risk_class int, zone bigint, x0 int, y0 int, x1 int, y1 int").repartition(4)
    (row,) = OL.zone_rings(df, simplify, block).collect()
    return row.rings


def comb(h, w):
    mask = np.zeros((h, w), bool)
    mask[:2] = True
    mask[:, ::2] = True
    return mask


@pytest.mark.parametrize("block", [7, 64])
def test_rings_equal_a_walk(spark, block):
    draw = np.random.default_rng(3)
    for mask in (comb(23, 31), draw.random((20, 20)) < 0.6, np.pad(np.zeros((5, 5), bool), 3, constant_values=True), np.eye(9, dtype=bool), np.ones((1, 1), bool)):
        rings = traced(spark, mask, block)
        assert sorted([tuple(map(int, p)) for p in r[:-1]] for r in rings) == walked(edges_of(mask))
        assert all(r[0] == r[-1] for r in rings)
        sizes = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) for r in rings]
        assert sizes == sorted(sizes, reverse=True)


def test_pointer_jumping_gives_the_same_order(spark, monkeypatch):
    mask = np.random.default_rng(4).random((24, 24)) < 0.6
    few = traced(spark, mask, 7)
    monkeypatch.setattr(OL, "FEW", 0)
    assert traced(spark, mask, 7) == few


def test_a_comb_over_many_blocks(spark):
    """A comb of 2 000 x 2 000 pixels over 64 blocks: one ring, its area, no piece larger than a block."""
    n, block = 2000, 250
    px = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    inside = lambda x, y: (x >= 0) & (x < n) & (y >= 0) & (y < n) & ((y < 2) | (x % 2 == 0))
    x, y = F.col("x"), F.col("y")
    side = lambda out, *p: F.when(~out, F.struct(*[c.cast("int").alias(k) for c, k in zip(p, ("x0", "y0", "x1", "y1"))]))
    steps = F.array_compact(F.array(side(inside(x, y - 1), x, y, x + 1, y), side(inside(x + 1, y), x + 1, y, x + 1, y + 1),
                                    side(inside(x, y + 1), x + 1, y + 1, x, y + 1), side(inside(x - 1, y), x, y + 1, x, y)))
    edges = px.filter(inside(x, y)).select(F.lit("s").alias("scene_id"), F.lit(1).alias("risk_class"), F.lit(0).cast("bigint").alias("zone"), F.explode(steps).alias("e")).select(
        "scene_id", "risk_class", "zone", "e.*")
    pieces = OL.block_chains(edges, block)
    assert pieces.agg(F.max("n")).first()[0] <= 4 * block * block
    (row,) = OL.zone_rings(edges, 0.0, block).select(F.size("rings").alias("n"), G.polygon_area(F.col("rings")).alias("area"), F.size(F.get("rings", F.lit(0))).alias("points")).collect()
    assert row.n == 1 and row.area == 2 * n + (n - 2) * (n // 2) and row.points == 4 * (n // 2) + 3


def test_simplification_keeps_what_is_far(spark):
    line = np.array([[0, 0], [1, 0.2], [2, 0], [3, 5], [4, 0]], float)
    assert OL.thinned(line, 0.5).tolist() == [0, 2, 3, 4]
    draw = np.random.default_rng(5)
    walk = np.cumsum(draw.integers(-2, 3, (300, 2)), axis=0).astype(float)
    kept = OL.thinned(walk, 1.5)
    for a, b in zip(kept, kept[1:]):
        v = walk[b] - walk[a]
        t = np.clip((walk[a:b + 1] - walk[a]) @ v / max(v @ v, 1e-12), 0, 1)
        assert np.hypot(*(walk[a:b + 1] - walk[a] - t[:, None] * v).T).max() <= 1.5
    whole, slim = traced(spark, np.tri(30, dtype=bool), 8), traced(spark, np.tri(30, dtype=bool), 8, 0.75)
    assert len(slim[0]) < len(whole[0]) / 5 and slim[0][0] == slim[0][-1]


def test_no_edges(spark):
    assert OL.zone_rings(spark.createDataFrame([], "scene_id string, risk_class int, zone bigint, x0 int, y0 int, x1 int, y1 int")).count() == 0


def test_zones_use_them():
    assert Z.zone_rings is OL.zone_rings

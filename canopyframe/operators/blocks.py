"""Neighbourhood work on fixed-size blocks with a halo of copied border pixels.

A block never exceeds (block + 2*halo) squared pixels, whatever the scene, so no task can be
handed an unbounded group; the halo costs a few percent of extra rows instead of one copy per
neighbour offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.grid import floordiv
from canopyframe.session import broadcast_if_small

KEY_BASE = 2**32  # pixel key = row * KEY_BASE + col


def pixel_key(row, col):
    return row.cast("bigint") * KEY_BASE + col


def with_halo(px: DataFrame, block: int, halo: int) -> DataFrame:
    """Copy each pixel to every block whose halo contains it; adds ``br, bc``."""

    def ids(axis: str):
        x = F.col(axis)
        return F.explode(F.sequence(floordiv(x - halo, block), floordiv(x + halo, block)))

    return px.withColumn("br", ids("row")).withColumn("bc", ids("col")).filter((F.col("br") >= 0) & (F.col("bc") >= 0))


def smooth(px: DataFrame, values: str | Sequence[str], sizes: DataFrame, sigma: float = 1.0, block: int = 256) -> DataFrame:
    """Gaussian smoothing of one or several maps in one halo shuffle, with replicated edges; missing values count as 0 before it.

    Returns ``scene_id, row, col`` and ``smoothed`` (for one name) or the names given, for every raster
    position of the blocks that a pixel row of ``px`` lies in or near; a block far from any pixel row
    yields nothing.
    """
    names = [values] if isinstance(values, str) else list(values)
    outs = ["smoothed"] if isinstance(values, str) else names
    radius = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [v / sum(w) for v in w]
    rows = px.join(broadcast_if_small(sizes), "scene_id").select(
        "scene_id", "row", "col", "height", "width", *[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(pdf.br.iloc[0]), int(pdf.bc.iloc[0])
        height, width = int(pdf.height.iloc[0]), int(pdf.width.iloc[0])
        top, left = max(0, br * block - radius), max(0, bc * block - radius)
        bottom, right = min(height, (br + 1) * block + radius), min(width, (bc + 1) * block + radius)
        if br * block >= height or bc * block >= width:
            none = pd.DataFrame({"scene_id": [], "row": [], "col": [], **{o: [] for o in outs}})
            return none.astype({"scene_id": str, "row": np.int32, "col": np.int32, **{o: float for o in outs}})
        h, wd = min(block, height - br * block), min(block, width - bc * block)
        r, c = np.mgrid[0:h, 0:wd]
        res = {"scene_id": pdf.scene_id.iloc[0], "row": (r.ravel() + br * block).astype(np.int32), "col": (c.ravel() + bc * block).astype(np.int32)}
        pad = ((top - (br * block - radius), (br + 1) * block + radius - bottom), (left - (bc * block - radius), (bc + 1) * block + radius - right))
        at = (pdf.row.to_numpy() - top, pdf.col.to_numpy() - left)
        for i, o in enumerate(outs):
            a = np.zeros((bottom - top, right - left))
            a[at] = np.nan_to_num(pdf[f"v{i}"].to_numpy(float))
            a = np.pad(a, pad, mode="edge")
            a = sum(x * a[k : k + block, :] for k, x in enumerate(weights))
            a = sum(x * a[:, k : k + block] for k, x in enumerate(weights))
            res[o] = a[:h, :wd].ravel()
        return pd.DataFrame(res)

    halo = with_halo(rows, block, radius)
    return halo.groupBy("scene_id", "br", "bc").applyInPandas(run, "scene_id string, row int, col int, " + ", ".join(f"{o} double" for o in outs))


def neighbour_counts(mask: DataFrame, keys: tuple[str, ...] = ("scene_id", "risk_class"), block: int = 256) -> DataFrame:
    """True pixels of the same keys in the 3x3 surroundings of every true pixel, itself included: column ``n``."""
    fields = [f for f in mask.schema.fields if f.name in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "row int", "col int", "n bigint"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(pdf.br.iloc[0]), int(pdf.bc.iloc[0])
        a = np.zeros((block + 2, block + 2), np.int64)
        a[pdf.row.to_numpy() - br * block + 1, pdf.col.to_numpy() - bc * block + 1] = 1
        n = sum(a[i : i + block, j : j + block] for i in range(3) for j in range(3))
        r, c = np.nonzero(a[1:-1, 1:-1])
        res = pd.DataFrame({"row": (r + br * block).astype(np.int32), "col": (c + bc * block).astype(np.int32), "n": n[r, c]})
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "row", "col", "n"]]

    return with_halo(mask.select(*keys, "row", "col"), block, 1).groupBy(*keys, "br", "bc").applyInPandas(run, schema)


def open_and_label(
    mask: DataFrame, keys: tuple[str, ...] = ("scene_id", "risk_class"), iterations: int = 1,
    block: int = 256, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Binary opening (3x3 square, outside is false) and 4-connected labels inside each block.

    ``mask`` holds the true pixels only. One shuffle; returns the opened pixels with ``label``
    (smallest pixel key of the block-local component), ``sides`` (bit set of outline sides:
    1 north, 2 east, 4 south, 8 west) and the carried columns.
    """
    halo = 2 * iterations + 1
    fields = [f for f in mask.schema.fields if f.name in keys]
    extra = [f for f in mask.schema.fields if f.name in carry]
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["row int", "col int", "label bigint", "sides int"]
        + [f"{f.name} {f.dataType.simpleString()}" for f in extra])
    rows = with_halo(mask.select(*keys, "row", "col", *carry), block, halo)
    base = KEY_BASE

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(pdf.br.iloc[0]), int(pdf.bc.iloc[0])
        top, left, n = br * block - halo, bc * block - halo, block + 2 * halo
        a = np.zeros((n + 2, n + 2), bool)
        rr, cc = pdf.row.to_numpy() - top + 1, pdf.col.to_numpy() - left + 1
        a[rr, cc] = True

        def shift_all(m, fold):
            out = m.copy()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    out = fold(out, np.roll(np.roll(m, dr, 0), dc, 1))
            out[0, :] = out[-1, :] = out[:, 0] = out[:, -1] = False
            return out

        for _ in range(iterations):
            a = shift_all(a, np.logical_and)
        for _ in range(iterations):
            a = shift_all(a, np.logical_or)
        inner = slice(halo + 1, halo + 1 + block)
        core = a[inner, inner]
        out_cols = {k: pdf[k].iloc[0] for k in keys}
        r, c = np.nonzero(core)
        key = (r + br * block).astype(np.int64) * base + (c + bc * block)
        number = np.full(core.shape, -1)
        number[r, c] = np.arange(r.size)
        pairs = []
        for s, t in ((number[:-1, :], number[1:, :]), (number[:, :-1], number[:, 1:])):
            ok = (s >= 0) & (t >= 0)
            pairs.append(np.stack([s[ok], t[ok]]))
        one, two = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
        root = np.arange(r.size)
        # Hook the larger root under the smaller, then flatten, until every pair agrees.
        while True:
            p, q = root[one], root[two]
            if np.array_equal(p, q):
                break
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while True:
                flat = root[root]
                if np.array_equal(flat, root):
                    break
                root = flat
        h = halo + 1
        sides = (
            1 * ~a[r + h - 1, c + h] + 2 * ~a[r + h, c + h + 1] + 4 * ~a[r + h + 1, c + h] + 8 * ~a[r + h, c + h - 1]
        ).astype(np.int32)
        res = pd.DataFrame({
            "row": (r + br * block).astype(np.int32), "col": (c + bc * block).astype(np.int32),
            "label": key[root] if r.size else key, "sides": sides})
        for k in keys:
            res[k] = out_cols[k]
        if carry:
            at = np.full(a.shape, -1)
            at[rr, cc] = np.arange(len(pdf))
            pos = at[r + h, c + h]
            for name in carry:
                res[name] = pdf[name].to_numpy()[pos]
        return res[[*keys, "row", "col", "label", "sides", *carry]]

    return rows.groupBy(*keys, "br", "bc").applyInPandas(run, schema)


def border_pairs(labelled: DataFrame, keys: tuple[str, ...] = ("scene_id", "risk_class"), block: int = 256) -> DataFrame:
    """Pairs of block-local labels that touch across a block border: (keys, a, b)."""
    p = labelled.select(*keys, "row", "col", "label")
    out = None
    for axis in ("row", "col"):
        edge = p.filter(F.col(axis) % block == block - 1).withColumn(axis, F.col(axis) + 1).withColumnRenamed("label", "a")
        other = p.filter(F.col(axis) % block == 0).withColumnRenamed("label", "b")
        touch = edge.join(other, [*keys, "row", "col"]).select(*keys, "a", "b")
        out = touch if out is None else out.unionByName(touch)
    return out.distinct()


def apply_blocks(px: DataFrame, fn, schema: str, block: int = 256, halo: int = 0) -> DataFrame:
    """Run ``fn(pandas) -> pandas`` on every block (with ``br, bc`` columns) of bounded size."""
    return with_halo(px, block, halo).groupBy("scene_id", "br", "bc").applyInPandas(fn, schema)

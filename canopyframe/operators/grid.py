"""Grids, windows and crops. A grid is columns ``a,b,c,d,e,f`` (affine), ``width``, ``height``, ``epsg``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions import projection as P
from canopyframe.functions.geometry import feather
from canopyframe.session import deal


def floordiv(x: Column, n: int) -> Column:
    """Floor division that also holds below zero."""
    return F.floor(x / F.lit(n)).cast("int")


def scene_sizes(px: DataFrame) -> DataFrame:
    """Height and width per scene from pixel positions."""
    return px.groupBy("scene_id").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))


def axis_offsets(n: Column, size: int, overlap: int) -> Column:
    """Window offsets along one axis; the last one is shifted back to the edge."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    last = F.greatest(F.lit(0), n - size)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(size - overlap)), F.array(last)))


def windows(sizes: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """All windows of every scene: (scene_id, row_off, col_off, h, w)."""
    rows = sizes.withColumn("row_off", F.explode(axis_offsets(F.col("height"), size, overlap)))
    both = rows.withColumn("col_off", F.explode(axis_offsets(F.col("width"), size, overlap)))
    return both.select(
        "scene_id", "row_off", "col_off",
        F.least(F.lit(size), F.col("height") - F.col("row_off")).alias("h"),
        F.least(F.lit(size), F.col("width") - F.col("col_off")).alias("w"))


def blocks(sizes: DataFrame, size: int = 256) -> DataFrame:
    """Disjoint blocks, the edge ones truncated."""
    step = F.lit(size)
    rows = sizes.withColumn("row_off", F.explode(F.sequence(F.lit(0), F.col("height") - 1, step)))
    both = rows.withColumn("col_off", F.explode(F.sequence(F.lit(0), F.col("width") - 1, step)))
    return both.select(
        "scene_id", "row_off", "col_off",
        F.least(step, F.col("height") - F.col("row_off")).alias("h"),
        F.least(step, F.col("width") - F.col("col_off")).alias("w"))


def draw(bound: Column, *parts: Column) -> Column:
    """A repeatable integer draw in [0, bound) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), bound.cast("bigint")).cast("int")


def sample_windows(sizes: DataFrame, size: int = 256, n: int = 32, seed: int = 0) -> DataFrame:
    """``n`` hash-drawn windows per scene, inside the raster."""
    h, w = F.least(F.lit(size), F.col("height")), F.least(F.lit(size), F.col("width"))
    flat = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda room, axis: draw(room + 1, F.lit(seed), F.col("scene_id"), F.col("draw"), F.lit(axis))
    return flat.select(
        "scene_id", "draw", at(F.col("height") - h, "r").alias("row_off"), at(F.col("width") - w, "c").alias("col_off"),
        h.alias("h"), w.alias("w"))


def axis_hits(x: Column, n: Column, size: int, overlap: int) -> Column:
    """Offsets of the windows that contain position ``x``: pure arithmetic, at most a few."""
    stride = size - overlap
    last = F.greatest(F.lit(0), n - size)
    first = F.greatest(F.lit(0), F.ceil((x - size + 1) / F.lit(stride)).cast("int"))
    top = F.least(F.floor(x / F.lit(stride)).cast("int"), F.floor(last / F.lit(stride)).cast("int"))
    regular = F.when(first <= top, F.sequence(first * stride, top * stride, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    edge = F.when(x >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(regular, edge))


def tile_pixels(px: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """Each pixel once per window that contains it; window ids are computed, not range-joined.

    Needs ``height`` and ``width`` columns; adds ``row_off, col_off, i, j, weight``.
    """
    rows = px.withColumn("row_off", F.explode(axis_hits(F.col("row"), F.col("height"), size, overlap)))
    both = rows.withColumn("col_off", F.explode(axis_hits(F.col("col"), F.col("width"), size, overlap)))
    i, j = F.col("row") - F.col("row_off"), F.col("col") - F.col("col_off")
    return both.withColumns({"i": i, "j": j}).withColumn(
        "weight", feather(F.col("i"), size, overlap) * feather(F.col("j"), size, overlap))


def nonempty_windows(win: DataFrame, valid_px: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows that contain at least one valid pixel (left semi join on computed window ids)."""
    hit = tile_pixels(valid_px, size, overlap).select("scene_id", "row_off", "col_off")
    return win.join(hit, ["scene_id", "row_off", "col_off"], "left_semi")


def with_xy(px: DataFrame) -> DataFrame:
    """Pixel-centre coordinates ``x, y`` from the affine columns."""
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    return px.withColumns({
        "x": F.col("a") * c + F.col("b") * r + F.col("c"),
        "y": F.col("d") * c + F.col("e") * r + F.col("f"),
    })


def crop_window(minx: Column, miny: Column, maxx: Column, maxy: Column, pad: int = 1) -> dict[str, Column]:
    """Pixel window of a north-up grid covering bounds: floor the start, round the length up, pad, clip.

    ``row_off`` is NULL when the bounds miss the grid.
    """
    a, e = F.col("a"), F.abs(F.col("e"))
    x0, y0 = (minx - F.col("c")) / a, (F.col("f") - maxy) / e
    x1, y1 = (maxx - F.col("c")) / a, (F.col("f") - miny) / e
    c0, r0 = F.floor(x0), F.floor(y0)
    w, h = F.ceil(x1 - x0), F.ceil(y1 - y0)
    left, top = F.greatest(F.lit(0), c0 - pad), F.greatest(F.lit(0), r0 - pad)
    right = F.least(F.col("width"), c0 + w + pad)
    bottom = F.least(F.col("height"), r0 + h + pad)
    ok = (right > left) & (bottom > top)
    return {
        "row_off": F.when(ok, top).cast("int"), "col_off": F.when(ok, left).cast("int"),
        "h": F.when(ok, bottom - top).cast("int"), "w": F.when(ok, right - left).cast("int"),
    }


def intersect_windows(a: Sequence[str], b: Sequence[str]) -> dict[str, Column]:
    """Overlap of two windows given as (row, col, h, w) column names; NULL when disjoint."""
    (r1, c1, h1, w1), (r2, c2, h2, w2) = [[F.col(n) for n in s] for s in (a, b)]
    top, left = F.greatest(r1, r2), F.greatest(c1, c2)
    bottom, right = F.least(r1 + h1, r2 + h2), F.least(c1 + w1, c2 + w2)
    ok = (bottom > top) & (right > left)
    return {"row_off": F.when(ok, top), "col_off": F.when(ok, left),
            "h": F.when(ok, bottom - top), "w": F.when(ok, right - left)}


def aligned_offset(outer: str, inner: str) -> tuple[Column, Column]:
    """(row, col) of the inner grid's origin in the outer one when both share pixels, else NULL.

    ``outer`` and ``inner`` name struct columns with ``epsg,a,b,c,d,e,f``. With an offset,
    moving pixels between the grids is a key shift instead of a reprojection.
    """
    o, i = F.col(outer), F.col(inner)

    def close(p: Column, q: Column, rel: float = 1e-5, tol: float = 1e-8) -> Column:
        return F.abs(p - q) <= tol + rel * F.abs(q)

    same = (o.epsg == i.epsg) & close(o.a, i.a) & close(o.b, i.b) & close(o.d, i.d) & close(o.e, i.e)
    det = o.a * o.e - o.b * o.d
    dx, dy = i.c - o.c, i.f - o.f
    col = F.try_divide(o.e * dx - o.b * dy, det)
    row = F.try_divide(o.a * dy - o.d * dx, det)
    near = lambda v: F.abs(v - F.rint(v)) <= 1e-6 + 1e-5 * F.abs(F.rint(v))
    ok = same & near(col) & near(row)
    return F.when(ok, F.rint(row)).cast("int"), F.when(ok, F.rint(col)).cast("int")


STEPS = 21  # parts of each edge


def _edge_points(w: Column, h: Column, steps: int = STEPS) -> Column:
    """Points along the four edges of a w x h pixel rectangle."""
    t = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / F.lit(float(steps)))
    make = lambda fx, fy: F.transform(t, lambda v: F.struct(fx(v).alias("c"), fy(v).alias("r")))
    zero = F.lit(0.0)
    return F.concat(
        make(lambda v: v * w, lambda v: zero), make(lambda v: v * w, lambda v: h * F.lit(1.0)),
        make(lambda v: zero, lambda v: v * h), make(lambda v: w * F.lit(1.0), lambda v: v * h))


def _edges(grids: DataFrame) -> DataFrame:
    """Every grid once per point along its edges, with the point's longitude and latitude ``_lon, _lat``.

    One row per point keeps the projection in generated code; the grids are dealt to all tasks before.
    """
    flat = deal(grids).select("*", F.explode(_edge_points(F.col("width"), F.col("height"))).alias("_p"))
    x = F.col("a") * F.col("_p.c") + F.col("b") * F.col("_p.r") + F.col("c")
    y = F.col("d") * F.col("_p.c") + F.col("e") * F.col("_p.r") + F.col("f")
    at = flat.withColumns({"_x": x, "_y": y}).drop("_p")
    return P.with_grid_lonlat(at, F.col("_x"), F.col("_y"), F.col("epsg"), "_lon", "_lat").drop("_x", "_y")


def _box(points: DataFrame, columns: Sequence[str], **ends: Column) -> DataFrame:
    """One row per grid again, with ``ends`` (aggregates over its points); equal grids keep their number of rows.

    A grid's points are put together in its task, so one row per grid is shuffled.
    """
    g = points.groupBy(*columns).agg(*[v.alias(k) for k, v in ends.items()], F.count(F.lit(1)).alias("_n"))
    return g.withColumn("_n", F.explode(F.sequence(F.lit(1), F.expr(f"cast(_n div {4 * (STEPS + 1)} as int)")))).drop("_n")


def lonlat_bounds(grids: DataFrame) -> DataFrame:
    """West, south, east, north of UTM or geographic grids with densified edges, and the centre.

    ``no_utm`` tells that the centre lies beyond the latitudes that UTM covers.
    """
    out = _box(_edges(grids), grids.columns, west=F.min("_lon"), south=F.min("_lat"), east=F.max("_lon"), north=F.max("_lat"))
    return out.withColumns({
        "centre_lon": (F.col("west") + F.col("east")) / 2.0, "centre_lat": (F.col("south") + F.col("north")) / 2.0}).withColumn(
        "no_utm", ~P.has_utm(F.col("centre_lat")))


def plan_grid(grids: DataFrame, epsg: int | None = None, resolution: float | None = None) -> DataFrame:
    """Target grid per scene: unchanged if system and resolution already match, else a north-up grid around it.

    The system is ``epsg`` or the UTM zone of the scene's centre; sources may be UTM or geographic. Without
    a ``resolution`` a changed grid's pixels are such that its diagonal has as many of them as the source's.
    Adds ``dst`` = struct(epsg, a..f, width, height), ``unchanged``, and the columns of ``lonlat_bounds``; a scene
    with ``no_utm`` gets the grid of its nominal zone.
    """
    g = lonlat_bounds(grids)
    target = F.lit(epsg) if epsg else P.utm_epsg(F.col("centre_lon"), F.col("centre_lat"))
    g = g.withColumn("_t", target)
    same_res = F.lit(True) if resolution is None else F.abs(F.abs(F.col("a")) - resolution) <= 1e-8 + 1e-5 * resolution
    pts = P.with_grid_position(_edges(g), F.col("_lon"), F.col("_lat"), F.col("_t"), "_x", "_y")
    g = _box(pts, g.columns, _x0=F.min("_x"), _x1=F.max("_x"), _y0=F.min("_y"), _y1=F.max("_y"))
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    diagonal = F.sqrt(dx * dx + dy * dy) / F.sqrt((F.col("width") * F.col("width") + F.col("height") * F.col("height")).cast("double"))
    g = g.withColumn("_s", F.lit(float(resolution)) if resolution else diagonal)
    res = F.col("_s")
    # A given size covers everything; the default one is rounded to whole pixels.
    count = (lambda span: F.ceil(span / res - 1e-6)) if resolution else (lambda span: F.greatest(F.lit(1), F.floor(span / res + 0.5)))
    made = F.struct(
        F.col("_t").cast("int").alias("epsg"), res.alias("a"), F.lit(0.0).alias("b"), F.col("_x0").alias("c"),
        F.lit(0.0).alias("d"), (-res).alias("e"), F.col("_y1").alias("f"), count(dx).cast("int").alias("width"), count(dy).cast("int").alias("height"))
    kept = F.struct(*[F.col(n).cast("double").alias(n) if n in "abcdef" else F.col(n).cast("int").alias(n)
                      for n in ("epsg", "a", "b", "c", "d", "e", "f", "width", "height")])
    same = (F.col("_t") == F.col("epsg")) & same_res
    return g.withColumn("dst", F.when(same, kept).otherwise(made)).withColumn("unchanged", same).drop("_t", "_s", "_x0", "_x1", "_y0", "_y1")


def source_window(win: DataFrame, pad: int = 2) -> DataFrame:
    """Source-pixel window of each destination window; NULL when it misses the source.

    Needs structs ``src`` and ``dst`` (grids) and the window columns ``row_off, col_off, h, w``.
    """
    s, d = F.col("src"), F.col("dst")
    pts = _edge_points(F.col("w"), F.col("h"))

    def project(p: Column) -> Column:
        cc, rr = p.c + F.col("col_off"), p.r + F.col("row_off")
        x, y = d.a * cc + d.b * rr + d.c, d.d * cc + d.e * rr + d.f
        return F.struct(x.alias("x"), y.alias("y"))

    def moved(p: Column) -> Column:
        ll = P.to_lonlat(p.x, p.y, d.epsg)
        return P.from_lonlat(ll.lon, ll.lat, s.epsg)

    g = win.withColumn("_p", F.transform(pts, project))
    g = g.withColumn("_q", F.when(d.epsg == s.epsg, F.col("_p")).otherwise(
        F.transform(F.transform("_p", moved), lambda q: F.struct(q.x.alias("x"), q.y.alias("y"))))).drop("_p")
    xs, ys = F.transform("_q", lambda p: p.x), F.transform("_q", lambda p: p.y)
    g = g.withColumns({"a": s.a, "c": s.c, "e": s.e, "f": s.f, "width": s.width, "height": s.height,
                       "_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    out = crop_window(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), pad)
    return g.withColumns({f"src_{k}": v for k, v in out.items()}).drop("_q", "_x0", "_x1", "_y0", "_y1", "a", "c", "e", "f", "width", "height")


def reproject(px: DataFrame, plans: DataFrame) -> DataFrame:
    """Nearest-neighbour gather of pixels onto a target grid; both may be UTM or geographic.

    ``plans`` has one row per scene with structs ``src`` and ``dst``. Destination pixels are
    generated per scene row by row (the explode is spread before it), each computes its source
    position, and one equi-join on (scene, row, col) fetches the values. Where the grids share
    pixels the position is a plain key shift.
    """
    rows = plans.select("scene_id", "src", "dst", F.explode(F.sequence(F.lit(0), F.col("dst.height") - 1)).alias("row"))
    grid = deal(rows, "scene_id", "row").select("*", F.explode(F.sequence(F.lit(0), F.col("dst.width") - 1)).alias("col"))
    s, d = F.col("src"), F.col("dst")
    grid = grid.withColumns({
        "_x": d.a * (F.col("col") + 0.5) + d.b * (F.col("row") + 0.5) + d.c,
        "_y": d.d * (F.col("col") + 0.5) + d.e * (F.col("row") + 0.5) + d.f})
    if not plans.filter("src.epsg <> dst.epsg").isEmpty():
        # Only when some scene changes its system: through longitude and latitude.
        grid = P.with_grid_lonlat(grid, F.col("_x"), F.col("_y"), d.epsg, "_lon", "_lat")
        grid = P.with_grid_position(grid, F.col("_lon"), F.col("_lat"), s.epsg, "_ux", "_uy")
        same = d.epsg == s.epsg
        grid = grid.withColumns({
            "_x": F.when(same, F.col("_x")).otherwise(F.col("_ux")), "_y": F.when(same, F.col("_y")).otherwise(F.col("_uy"))})
        grid = grid.drop("_lon", "_lat", "_ux", "_uy")
    sx, sy = F.col("_x"), F.col("_y")
    det = s.a * s.e - s.b * s.d
    grid = grid.withColumns({
        "_sc": F.floor((s.e * (sx - s.c) - s.b * (sy - s.f)) / det).cast("int"),
        "_sr": F.floor((s.a * (sy - s.f) - s.d * (sx - s.c)) / det).cast("int"),
    })
    src = px.withColumnRenamed("row", "_sr").withColumnRenamed("col", "_sc")
    return grid.drop("src", "dst", "_x", "_y").join(src, ["scene_id", "_sr", "_sc"], "left").drop("_sr", "_sc")

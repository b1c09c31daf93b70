"""Web-map tiles of any zoom: backward mapping near and above the native zoom, means far below it.

A scene's outline in longitude and latitude bounds the tile pixels it can touch. Where these are
smaller than two source pixels, every one is generated, its centre is taken back through Mercator
and the scene's projection, and an equi-join fetches the source pixel it falls in: no tile pixel
over the raster stays empty, however far one zooms in. Where they are larger, source pixels are
averaged in the tile pixel they fall in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions import projection as P
from canopyframe.functions.rules import colorize
from canopyframe.operators.grid import lonlat_bounds
from canopyframe.session import broadcast_if_small, deal

SIZE = 256
#: Equatorial metres per tile pixel at zoom 0.
METRES = 2 * math.pi * 6378137.0 / SIZE
#: Mercator ends here.
MAX_LAT = 85.0511287798066
KEY = ("z", "x", "y", "px", "py")


def mercator_pixels(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Position in pixels of the whole map at a zoom level, from its north-west corner."""
    n = F.pow(F.lit(2.0), zoom) * SIZE
    rad = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    return (lon + 180.0) / 360.0 * n, (1.0 - F.asinh(F.tan(rad)) / math.pi) / 2.0 * n


def mercator_lonlat(u: Column, v: Column, zoom: Column) -> tuple[Column, Column]:
    """The inverse of ``mercator_pixels``."""
    n = F.pow(F.lit(2.0), zoom) * SIZE
    return u / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * v / n))))


def covered_range(scenes: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Scenes x zooms with the range of map pixels ``u0..u1, v0..v1`` and whether they are mapped ``backward``.

    ``scenes``: scene_id, epsg, a..f, width, height. A scene outside the map has no row.
    """
    b = lonlat_bounds(scenes).withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in zooms])))
    last = F.pow(F.lit(2.0), F.col("z")) * SIZE - 1
    clip = lambda c: F.greatest(F.lit(0.0), F.least(last, F.floor(c))).cast("bigint")
    u0, v0 = mercator_pixels(F.col("west"), F.col("north"), F.col("z"))
    u1, v1 = mercator_pixels(F.col("east"), F.col("south"), F.col("z"))
    # Ground size of a source pixel: metres, or degrees of longitude and latitude.
    cos = F.cos(F.radians("centre_lat"))
    step = F.when(P.is_geographic(F.col("epsg")), F.least(F.abs("a") * cos, F.abs("e")) * (math.pi * 6378137.0 / 180.0)).otherwise(
        F.least(F.sqrt(F.col("a") * F.col("a") + F.col("d") * F.col("d")), F.sqrt(F.col("b") * F.col("b") + F.col("e") * F.col("e"))))
    ground = F.lit(METRES) * cos / F.pow(F.lit(2.0), F.col("z"))
    known = b.filter((F.col("south") < MAX_LAT) & (F.col("north") > -MAX_LAT))
    return known.select(*scenes.columns, "z", clip(u0).alias("u0"), clip(v0).alias("v0"), clip(u1).alias("u1"), clip(v1).alias("v1"), (ground < 2.0 * step).alias("backward"))


def _backward(risk: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per tile pixel whose centre falls in a source pixel."""
    rows = ranges.select("scene_id", "epsg", *"abcdef", "z", "u0", "u1", F.explode(F.sequence("v0", "v1")).alias("v"))
    # Scenes of few rows spread over the tasks before they are blown up.
    grid = deal(rows, "scene_id", "z", "v").select("scene_id", "epsg", *"abcdef", "z", "v", F.explode(F.sequence("u0", "u1")).alias("u"))
    lon, lat = mercator_lonlat(F.col("u") + 0.5, F.col("v") + 0.5, F.col("z"))
    grid = P.with_grid_position(grid.withColumns({"_lon": lon, "_lat": lat}), F.col("_lon"), F.col("_lat"), F.col("epsg"), "_x", "_y")
    dx, dy = F.col("_x") - F.col("c"), F.col("_y") - F.col("f")
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    at = grid.select("scene_id", "z", "u", "v", F.floor((F.col("a") * dy - F.col("d") * dx) / det).cast("int").alias("row"),
                     F.floor((F.col("e") * dx - F.col("b") * dy) / det).cast("int").alias("col"))
    # Few rows were blown up to very many here, which Spark's sizes do not tell: never broadcast them.
    return at.hint("merge").join(risk, ["scene_id", "row", "col"]).select("z", "u", "v", "p0", "valid")


def _forward(risk: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per source pixel and zoom, in the tile pixel it falls in."""
    px = risk.join(broadcast_if_small(ranges.select("scene_id", "epsg", *"abcdef", "z")), "scene_id")
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    px = P.with_grid_lonlat(px, F.col("a") * c + F.col("b") * r + F.col("c"), F.col("d") * c + F.col("e") * r + F.col("f"), F.col("epsg"), "_lon", "_lat")
    u, v = mercator_pixels(F.col("_lon"), F.col("_lat"), F.col("z"))
    n = F.pow(F.lit(2.0), F.col("z")) * SIZE
    inside = px.select("z", F.floor(u).cast("bigint").alias("u"), F.floor(v).cast("bigint").alias("v"), "p0", "valid")
    return inside.filter((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < n) & (F.col("v") < n))


def render_tiles(risk: DataFrame, scenes: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Tile pixels (z, x, y, px, py) with the healthy probability and colour.

    ``risk``: scene_id, row, col, p0, valid. ``scenes``: scene_id, epsg, a..f, width, height, on UTM or
    geographic grids. Invalid source pixels are transparent; pixels over no raster have no row.
    Scenes that overlap are averaged.
    """
    if not all(0 <= z <= 22 for z in zooms):
        raise ValueError("zoom levels go from 0 to 22")
    px = risk.select("scene_id", "row", "col", "p0", "valid")
    ranges = covered_range(scenes.select("scene_id", "epsg", *"abcdef", "width", "height"), zooms)
    both = _backward(px, ranges.filter("backward")).unionByName(_forward(px, ranges.filter("NOT backward")))
    mean = both.groupBy("z", "u", "v").agg(F.avg(F.when(F.col("valid"), F.col("p0"))).alias("p_healthy"))
    split = lambda c: (F.expr(f"cast({c} div {SIZE} as int)"), (F.col(c) % SIZE).cast("int"))
    (x, px_), (y, py_) = split("u"), split("v")
    out = mean.select("z", x.alias("x"), y.alias("y"), px_.alias("px"), py_.alias("py"), "p_healthy")
    return out.withColumns(colorize(1.0 - F.coalesce("p_healthy", F.lit(0.0)), F.col("p_healthy").isNotNull()))


def tile_index(tiles: DataFrame) -> DataFrame:
    """The tiles that have any pixel, and how many of each are opaque."""
    return tiles.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("alpha") > 0).alias("n_opaque"))

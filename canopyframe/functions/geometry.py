"""Planar geometry on nested arrays: rings are ``ARRAY<ARRAY<DOUBLE>>`` of (x, y)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyframe.constants import SQM_PER_ACRE

# The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563


def ring_of(points: Sequence[tuple[float, float]]) -> Column:
    """A constant ring."""
    return F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def _sides(ring: Column) -> Column:
    """Each vertex with the one before it; the first is paired with the last."""
    shifted = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, F.lit(1), F.size(ring) - 1))
    return F.zip_with(ring, shifted, lambda p, q: F.struct(
        F.get(p, F.lit(0)).alias("xi"), F.get(p, F.lit(1)).alias("yi"),
        F.get(q, F.lit(0)).alias("xj"), F.get(q, F.lit(1)).alias("yj")))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: count the sides a ray to the right crosses."""

    def crosses(s: Column) -> Column:
        straddles = (s.yi > y) != (s.yj > y)
        at = (s.xj - s.xi) * (y - s.yi) / F.when(straddles, s.yj - s.yi) + s.xi
        return F.coalesce(straddles & (x < at), F.lit(False))

    return F.size(F.filter(_sides(ring), crosses)) % 2 == 1


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the outer ring and outside the holes (parity over all rings)."""
    inside = F.transform(rings, lambda r: point_in_ring(x, y, r).cast("int"))
    return F.aggregate(inside, F.lit(0), lambda a, v: a + v) % 2 == 1


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of the listed vertices, the closing one included."""

    def mean(i: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(i))) / F.size(ring)

    return mean(0), mean(1)


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area."""
    twice = F.aggregate(_sides(ring), F.lit(0.0), lambda a, s: a + (s.xj * s.yi - s.xi * s.yj))
    return F.abs(twice) / 2.0


def polygon_area(rings: Column) -> Column:
    """Outer ring minus holes."""
    areas = F.transform(rings, ring_area)
    return 2.0 * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda a, v: a + v)


def polygon_acres(rings: Column, unit: Column | float = 1.0) -> Column:
    u = unit if isinstance(unit, Column) else F.lit(float(unit))
    return polygon_area(rings) * u * u / SQM_PER_ACRE


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs = F.transform(ring, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(ring, lambda p: F.get(p, F.lit(1)))
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def polygons_bounds(polygons: Column) -> dict[str, Column]:
    """Bounds of an array of polygons (array of rings each)."""
    return ring_bounds(F.flatten(F.flatten(polygons)))


def valid_aoi(polygons: Column) -> Column:
    """Non-empty, closed rings of at least four points, inside lon/lat limits."""
    rings = F.flatten(polygons)
    closed = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1)))
    b = polygons_bounds(polygons)
    inside = (b["minx"] >= -180) & (b["maxx"] <= 180) & (b["miny"] >= -90) & (b["maxy"] <= 90)
    return F.coalesce((F.size(rings) > 0) & closed & inside, F.lit(False))


def pixel_acres(a: Column, b: Column, d: Column, e: Column, unit: Column | float = 1.0) -> Column:
    """Area of one pixel of a projected grid in acres."""
    u = unit if isinstance(unit, Column) else F.lit(float(unit))
    return F.abs(a * e - b * d) * u * u / SQM_PER_ACRE


def geographic_pixel_acres(lat0: Column, lat1: Column, dlon: Column) -> Column:
    """Area of a longitude/latitude cell on the ellipsoid, by the authalic latitude function."""
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    semi_minor = WGS84_A * (1 - WGS84_F)

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - e2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)

    return F.abs(q(lat1) - q(lat0)) * F.abs(F.radians(dlon)) * semi_minor**2 / 2 / SQM_PER_ACRE


def feather(i: Column, n: Column | int, overlap: int) -> Column:
    """Weight along one axis: a ramp over ``overlap`` pixels at both ends, always above zero."""
    if overlap <= 0:
        return F.lit(1.0)
    n = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.lit(1.0), (i + 0.5) / overlap, (n - i - 0.5) / overlap)

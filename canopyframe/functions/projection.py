"""Transverse-Mercator (UTM) and web-Mercator mathematics as Column expressions.

Krueger's series to sixth order in the third flattening: published, and far below a millimetre
inside a zone. ``with_*`` run it as staged projections in generated code (the per-pixel path);
``*_point`` are single expressions for points inside arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.functions.geometry import WGS84_A, WGS84_F

N = WGS84_F / (2 - WGS84_F)
K0 = 0.9996
RECTIFYING = WGS84_A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ECC = math.sqrt(WGS84_F * (2 - WGS84_F))

# Series coefficients in powers of the third flattening, forward and inverse.
_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)


def _sum(row: tuple[float, ...]) -> float:
    return sum(c * N ** (i + 1) for i, c in enumerate(row))


ALPHA = tuple(_sum(r) for r in _FORWARD)
BETA = tuple(_sum(r) for r in _INVERSE)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone that contains a point."""
    zone = (F.floor((lon + 180.0) / 6.0) % 60 + 1).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def is_utm(epsg: Column) -> Column:
    return F.coalesce(epsg.between(32601, 32660) | epsg.between(32701, 32760), F.lit(False))


def central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def _false_northing(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(1e7)).otherwise(F.lit(0.0))


Get = Callable[[str], Column]
Stage = Callable[[Get], dict[str, Column]]


def _series(xi: Column, eta: Column, coefficients: tuple[float, ...], sign: int) -> tuple[Column, Column]:
    a, b = xi, eta
    for j, c in enumerate(coefficients, start=1):
        a = a + sign * c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b + sign * c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return a, b


# Each stage only reads the results of the ones before it, so that no term is written out twice.
def _f1(g: Get) -> dict[str, Column]:
    return {"lam": F.radians(g("lon") - central_meridian(g("epsg"))), "s": F.sin(F.radians(g("lat")))}


def _f2(g: Get) -> dict[str, Column]:
    return {"t": F.sinh(F.atanh(g("s")) - ECC * F.atanh(ECC * g("s")))}


def _f3(g: Get) -> dict[str, Column]:
    return {"xi": F.atan2(g("t"), F.cos(g("lam"))), "eta": F.atanh(F.sin(g("lam")) / F.sqrt(1 + g("t") * g("t")))}


def _f4(g: Get) -> dict[str, Column]:
    xi, eta = _series(g("xi"), g("eta"), ALPHA, 1)
    return {"x": 500000.0 + K0 * RECTIFYING * eta, "y": _false_northing(g("epsg")) + K0 * RECTIFYING * xi}


def _i1(g: Get) -> dict[str, Column]:
    return {"xi": (g("y") - _false_northing(g("epsg"))) / (K0 * RECTIFYING), "eta": (g("x") - 500000.0) / (K0 * RECTIFYING)}


def _i2(g: Get) -> dict[str, Column]:
    xi, eta = _series(g("xi"), g("eta"), BETA, -1)
    return {"xi0": xi, "eta0": eta}


def _i3(g: Get) -> dict[str, Column]:
    xi, eta = g("xi0"), g("eta0")
    psi = F.asinh(F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi)))
    return {"psi": psi, "dl": F.atan2(F.sinh(eta), F.cos(xi))}


def _i4(g: Get) -> dict[str, Column]:
    # Isometric to geodetic latitude by fixed-point steps; five leave no measurable error.
    s = F.tanh(g("psi"))
    for _ in range(5):
        s = F.tanh(g("psi") + ECC * F.atanh(ECC * s))
    return {"lon": central_meridian(g("epsg")) + F.degrees(g("dl")), "lat": F.degrees(F.asin(s))}


FORWARD, INVERSE = (_f1, _f2, _f3, _f4), (_i1, _i2, _i3, _i4)


def _staged(df: DataFrame, given: dict[str, Column], stages: tuple[Stage, ...], out: dict[str, str]) -> DataFrame:
    """Run the stages as successive projections; all of them stay in generated code.

    The results pass a condition on the partition number, which is always true but not
    deterministic: without it a filter on a result (even an inferred IS NOT NULL on a join key)
    would be pushed down through every stage and written out to an expression of enormous size.
    """
    get = lambda name: F.col(f"_tm_{name}")
    d = df.withColumns({f"_tm_{k}": v for k, v in given.items()})
    for stage in stages:
        d = d.withColumns({f"_tm_{k}": v for k, v in stage(get).items()})
    d = d.withColumns({name: F.when(F.spark_partition_id() >= 0, get(k)) for k, name in out.items()})
    return d.drop(*[c for c in d.columns if c.startswith("_tm_")])


def _bound(given: dict[str, Column], stages: tuple[Stage, ...]) -> Column:
    """Run the stages inside one expression, each result bound to a lambda variable."""
    def step(env: Column, names: tuple[str, ...], rest: tuple[Stage, ...]) -> Column:
        if not rest:
            return env
        new = rest[0](lambda n: env[n])
        merged = F.struct(*[env[n].alias(n) for n in names if n not in new], *[v.alias(k) for k, v in new.items()])
        after = tuple(n for n in names if n not in new) + tuple(new)
        return F.get(F.transform(F.array(merged), lambda e: step(e, after, rest[1:])), F.lit(0))

    start = F.struct(*[v.alias(k) for k, v in given.items()])
    return F.get(F.transform(F.array(start), lambda e: step(e, tuple(given), stages)), F.lit(0))


def with_utm(df: DataFrame, lon: Column, lat: Column, epsg: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Append easting and northing in metres."""
    return _staged(df, {"lon": lon, "lat": lat, "epsg": epsg}, FORWARD, {"x": x, "y": y})


def with_lonlat(df: DataFrame, x: Column, y: Column, epsg: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Append longitude and latitude in degrees."""
    return _staged(df, {"x": x, "y": y, "epsg": epsg}, INVERSE, {"lon": lon, "lat": lat})


def utm_point(lon: Column, lat: Column, epsg: Column) -> Column:
    """Struct with fields ``x, y``; for points inside arrays (metadata and ring corners)."""
    return _bound({"lon": lon, "lat": lat, "epsg": epsg}, FORWARD)


def lonlat_point(x: Column, y: Column, epsg: Column) -> Column:
    """Struct with fields ``lon, lat``; for points inside arrays (metadata and ring corners)."""
    return _bound({"x": x, "y": y, "epsg": epsg}, INVERSE)


# Positions in any of the grids' systems: UTM zones, or longitude and latitude themselves.
GEOGRAPHIC = 4326


def is_geographic(epsg: Column) -> Column:
    return F.coalesce(epsg == GEOGRAPHIC, F.lit(False))


def has_utm(lat: Column) -> Column:
    """UTM is defined from 80 degrees south to 84 north."""
    return lat.between(-80.0, 84.0)


def _pair(point: Column, first: str, second: str) -> Column:
    """Two fields of a struct, which is computed once."""
    return F.get(F.transform(F.array(point), lambda p: F.struct(p[first].cast("double").alias(first), p[second].cast("double").alias(second))), F.lit(0))


def to_lonlat(x: Column, y: Column, epsg: Column) -> Column:
    """Struct ``lon, lat`` of a grid position, for points inside arrays."""
    return F.when(is_geographic(epsg), F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))).otherwise(_pair(lonlat_point(x, y, epsg), "lon", "lat"))


def from_lonlat(lon: Column, lat: Column, epsg: Column) -> Column:
    """Struct ``x, y`` of a grid position, for points inside arrays."""
    return F.when(is_geographic(epsg), F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))).otherwise(_pair(utm_point(lon, lat, epsg), "x", "y"))


def _either(df: DataFrame, staged: Callable[..., DataFrame], first: Column, second: Column, epsg: Column, out: tuple[str, str]) -> DataFrame:
    d = staged(df.withColumns({"_g1": first, "_g2": second, "_ge": epsg}), F.col("_g1"), F.col("_g2"), F.col("_ge"), "_o1", "_o2")
    plain = is_geographic(F.col("_ge"))
    return d.withColumns({o: F.when(plain, F.col(f"_g{i}")).otherwise(F.col(f"_o{i}")) for i, o in enumerate(out, 1)}).drop("_g1", "_g2", "_ge", "_o1", "_o2")


def with_grid_lonlat(df: DataFrame, x: Column, y: Column, epsg: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Append longitude and latitude of positions in UTM or geographic grids."""
    return _either(df, with_lonlat, x, y, epsg, (lon, lat))


def with_grid_position(df: DataFrame, lon: Column, lat: Column, epsg: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Append the position of points in UTM or geographic grids."""
    return _either(df, with_utm, lon, lat, epsg, (x, y))


def to_wgs84(rings: Column, epsg: Column, digits: int = 7) -> Column:
    """Polygon rings from UTM metres to rounded longitude/latitude."""
    points = F.transform(rings, lambda r: F.transform(r, lambda p: lonlat_point(F.get(p, F.lit(0)), F.get(p, F.lit(1)), epsg)))
    return F.transform(points, lambda r: F.transform(r, lambda p: F.array(F.round(p.lon, digits), F.round(p.lat, digits))))


def from_wgs84(rings: Column, epsg: Column) -> Column:
    """Polygon rings from longitude/latitude to UTM metres."""
    points = F.transform(rings, lambda r: F.transform(r, lambda p: utm_point(F.get(p, F.lit(0)), F.get(p, F.lit(1)), epsg)))
    return F.transform(points, lambda r: F.transform(r, lambda p: F.array(p.x, p.y)))


def with_mercator_tile(df: DataFrame, lon: Column, lat: Column, zoom: Column, size: int = 256) -> DataFrame:
    """Append the tile ``x, y`` and the pixel ``px, py`` in it of a point at a zoom level."""
    rad = F.radians(lat)
    d = df.withColumns({
        "_fx": (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom),
        "_fy": (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)})
    d = d.withColumns({"x": F.floor("_fx").cast("int"), "y": F.floor("_fy").cast("int")})
    return d.withColumns({
        "px": F.floor((F.col("_fx") - F.col("x")) * size).cast("int"),
        "py": F.floor((F.col("_fy") - F.col("y")) * size).cast("int")}).drop("_fx", "_fy")

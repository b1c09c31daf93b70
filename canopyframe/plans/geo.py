"""Registered queries over geometry, projections, areas of interest and map tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import geometry as G
from canopyframe.functions import projection as P
from canopyframe.operators import aoi as AO
from canopyframe.operators import blocks as BL
from canopyframe.operators import grid as GR
from canopyframe.operators import tiles as TL
from canopyframe.plans import adapters as A
from canopyframe.plans.adapters import rnd
from canopyframe.plans.registry import query, r4, r6, with_ctes

PK = ["scene_id", "row", "col"]
PKQ = 'scene_id, "row", col'

# One farm polygon per supplier on a unit grid (x = column, y = minus row): rectangle, triangle or
# concave ring, corners off the pixel centres.
SHAPES = (
    ((0.2, 0.3), (9.7, 0.3), (9.7, 7.8), (0.2, 7.8), (0.2, 0.3)),
    ((0.1, 0.2), (12.3, 4.1), (3.3, 11.9), (0.1, 0.2)),
    ((0.3, 0.1), (14.2, 0.1), (14.2, 13.7), (7.1, 4.6), (0.3, 13.7), (0.3, 0.1)),
)
POLY_SQL = "pv AS (SELECT s_suppkey AS fid, 'r' || (s_suppkey % 2) AS scene_id, v.i, (s_suppkey * 37) % 110 + v.x AS x, -((s_suppkey * 53) % 110 + v.y) AS y, v.n FROM supplier JOIN (VALUES " + ", ".join(
    f"({s}, {i}, {x}::DOUBLE, {y}::DOUBLE, {len(ring)})" for s, ring in enumerate(SHAPES) for i, (x, y) in enumerate(ring)
) + ") v(s, i, x, y, n) ON s_suppkey % 3 = v.s)"
PIP_SQL = f"""
pe AS (SELECT a.fid, a.scene_id, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM pv a JOIN pv b ON a.fid = b.fid AND b.i = (a.i + a.n - 1) % a.n),
pbx AS (SELECT fid, scene_id, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM pv GROUP BY 1, 2),
pin AS (SELECT ra.scene_id, ra."row", ra.col, pe.fid FROM ra JOIN pbx ON pbx.scene_id = ra.scene_id AND ra.col + 0.5 BETWEEN minx AND maxx AND -(ra."row" + 0.5) BETWEEN miny AND maxy
   JOIN pe ON pe.fid = pbx.fid WHERE (yi > -(ra."row" + 0.5)) <> (yj > -(ra."row" + 0.5)) AND ra.col + 0.5 < (xj - xi) * (-(ra."row" + 0.5) - yi) / (yj - yi) + xi
   GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)"""


def polygons(t):
    k = F.col("s_suppkey")
    dx, dy = k * 37 % 110, k * 53 % 110
    rings = [F.array(*[F.array(dx + F.lit(x), -(dy + F.lit(y))) for x, y in ring]) for ring in SHAPES]
    ring = F.when(k % 3 == 0, rings[0]).when(k % 3 == 1, rings[1]).otherwise(rings[2])
    return t("supplier").select(
        k.alias("field_id"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("scene_id"), ring.alias("ring"), F.array(F.array(ring)).alias("polygons"))


def unit_grids(t):
    return GR.scene_sizes(A.raster(t)).select("*", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"),
                                              F.lit(0.0).alias("d"), F.lit(-1.0).alias("e"), F.lit(0.0).alias("f"))


def located(t):
    return A.raster(t).withColumns({"x": F.col("col") + 0.5, "y": -(F.col("row") + 0.5)})


@query("j2_pixels_in_polygons", with_ctes(A.RASTER_SQL, POLY_SQL, PIP_SQL, body=f"SELECT {PKQ}, fid AS field_id FROM pin"))
def _(t):
    """Pixels inside farm polygons, by scan-line runs and an equi-join."""
    return AO.pixels_in_fields(located(t), polygons(t), unit_grids(t)).select(*PK, "field_id")


@query("g14_aoi_mask", with_ctes(A.RASTER_SQL, POLY_SQL, PIP_SQL, body=f"""
SELECT ra.scene_id, ra."row", ra.col, p.c IS NOT NULL AS inside FROM ra LEFT JOIN (SELECT {PKQ}, count(*) AS c FROM pin GROUP BY {PKQ}) p
ON p.scene_id = ra.scene_id AND p."row" = ra."row" AND p.col = ra.col"""))
def _(t):
    return AO.mask_aoi(located(t), polygons(t), unit_grids(t)).select(*PK, "inside")


@query("g14_missed_aoi", with_ctes(A.RASTER_SQL, POLY_SQL, PIP_SQL, body="""
SELECT DISTINCT fid AS field_id, 'AOI does not cover any scene pixel' AS error FROM pv WHERE fid NOT IN (SELECT fid FROM pin)"""))
def _(t):
    """Fields that cover no pixel of their scene, as error rows."""
    return AO.missing_aoi(polygons(t), AO.pixels_in_fields(located(t), polygons(t), unit_grids(t)))


CROP_SQL = f"""
sz AS (SELECT scene_id, max("row") + 1 AS height, max(col) + 1 AS width FROM ra GROUP BY 1),
cr0 AS (SELECT fid, p.scene_id, height, width, floor(minx) AS c0, floor(-maxy) AS r0, ceil(maxx - minx) AS w, ceil(-miny + maxy) AS h FROM pbx p JOIN sz USING (scene_id)),
cr1 AS (SELECT fid, scene_id, greatest(0, c0 - 1) AS l, greatest(0, r0 - 1) AS t, least(width, c0 + w + 1) AS rt, least(height, r0 + h + 1) AS b FROM cr0),
cr AS (SELECT fid, scene_id, CASE WHEN rt > l AND b > t THEN t END AS row_off, CASE WHEN rt > l AND b > t THEN l END AS col_off, CASE WHEN rt > l AND b > t THEN b - t END AS h, CASE WHEN rt > l AND b > t THEN rt - l END AS w FROM cr1)"""


def crops(t):
    b = G.polygons_bounds(F.col("polygons"))
    f = polygons(t).join(unit_grids(t), "scene_id").withColumns({f"_{k}": v for k, v in b.items()})
    w = GR.crop_window(F.col("_minx"), F.col("_miny"), F.col("_maxx"), F.col("_maxy"), 1)
    return f.select("field_id", "scene_id", *[v.alias(k) for k, v in w.items()])


@query("g10_crop_to_geometry", with_ctes(A.RASTER_SQL, POLY_SQL, PIP_SQL, CROP_SQL, body="""
SELECT fid AS field_id, scene_id, CAST(row_off AS INTEGER) AS row_off, CAST(col_off AS INTEGER) AS col_off, CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w FROM cr"""))
def _(t):
    return crops(t)


@query("g15_clip_to_aoi", with_ctes(A.RASTER_SQL, POLY_SQL, PIP_SQL, CROP_SQL, body="""
SELECT cr.fid AS field_id, ra.scene_id, ra."row", ra.col, p.fid IS NOT NULL AS inside FROM cr JOIN ra ON ra.scene_id = cr.scene_id AND ra."row" >= row_off AND ra."row" < row_off + h AND ra.col >= col_off AND ra.col < col_off + w
LEFT JOIN pin p ON p.fid = cr.fid AND p.scene_id = ra.scene_id AND p."row" = ra."row" AND p.col = ra.col"""))
def _(t):
    """Crop window of each field filled with its pixels, outside ones flagged."""
    cells = crops(t).filter("h IS NOT NULL").withColumn("row", F.explode(F.expr("sequence(row_off, row_off + h - 1)")))
    cells = cells.withColumn("col", F.explode(F.expr("sequence(col_off, col_off + w - 1)"))).select("field_id", "scene_id", "row", "col")
    hit = AO.pixels_in_fields(located(t), polygons(t), unit_grids(t)).select(*PK, "field_id").withColumn("inside", F.lit(True))
    out = cells.join(A.raster(t).select(*PK), PK).join(hit, [*PK, "field_id"], "left")
    return out.select("field_id", *PK, F.coalesce("inside", F.lit(False)).alias("inside"))


@query("g16_point_in_polygon", with_ctes(POLY_SQL, """
pe AS (SELECT a.fid, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM pv a JOIN pv b ON a.fid = b.fid AND b.i = (a.i + a.n - 1) % a.n),
pt AS (SELECT c_custkey, c_custkey % (SELECT count(*) FROM supplier) AS fid, c_custkey % 16 AS ox, (c_custkey // 16) % 16 AS oy FROM customer),
px AS (SELECT c_custkey, pt.fid, (fid * 37) % 110 + ox + 0.05::DOUBLE AS x, -((fid * 53) % 110 + oy + 0.07::DOUBLE) AS y FROM pt)""", body="""
SELECT c_custkey, px.fid AS field_id, count(*) FILTER (WHERE (yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / CASE WHEN yj = yi THEN 1 ELSE yj - yi END + xi) % 2 = 1 AS inside FROM px JOIN pe USING (fid) GROUP BY 1, 2"""))
def _(t):
    c = t("customer").select("c_custkey", (F.col("c_custkey") % t("supplier").count()).alias("field_id"))
    f = polygons(t)
    k = F.col("field_id")
    x = k * 37 % 110 + F.col("c_custkey") % 16 + 0.05
    y = -(k * 53 % 110 + F.expr("(c_custkey div 16) % 16") + 0.07)
    return c.join(f, "field_id").select("c_custkey", "field_id", G.point_in_ring(x, y, F.col("ring")).alias("inside"))


@query("g17_ring_centroid", with_ctes(POLY_SQL, body=f"SELECT fid AS field_id, {r6('avg(x)')} AS cx, {r6('avg(y)')} AS cy FROM pv GROUP BY fid"))
def _(t):
    x, y = G.ring_centroid(F.col("ring"))
    return polygons(t).select("field_id", rnd(x).alias("cx"), rnd(y).alias("cy"))


@query("g18_pixel_area", f"""
SELECT c_custkey, {r6('abs((10.0 + c_custkey % 30) * -(10.0 + c_custkey % 20) - (c_custkey % 3) * (c_custkey % 5)) / 4046.8564224')} AS acres FROM customer""")
def _(t):
    k = F.col("c_custkey")
    a = G.pixel_acres(10.0 + k % 30, (k % 3).cast("double"), (k % 5).cast("double"), -(10.0 + k % 20))
    return t("customer").select("c_custkey", rnd(a).alias("acres"))


@query("g18_geographic_pixel_area", f"""
WITH p AS (SELECT c_custkey, 0.0818191908426215 AS e, (c_custkey % 160 - 80)::DOUBLE AS a, (c_custkey % 160 - 80) + 0.01::DOUBLE AS b FROM customer),
q AS (SELECT c_custkey, sin(radians(b)) / (1 - e * e * pow(sin(radians(b)), 2)) + ln((1 + e * sin(radians(b))) / (1 - e * sin(radians(b)))) / (2 * e)
  - sin(radians(a)) / (1 - e * e * pow(sin(radians(a)), 2)) - ln((1 + e * sin(radians(a))) / (1 - e * sin(radians(a)))) / (2 * e) AS d FROM p)
SELECT c_custkey, {r4('abs(d) * radians(0.02) * pow(6356752.314245179, 2) / 2 / 4046.8564224')} AS acres FROM q""")
def _(t):
    lat = (F.col("c_custkey") % 160 - 80).cast("double")
    return t("customer").select("c_custkey", rnd(G.geographic_pixel_acres(lat, lat + 0.01, F.lit(0.02)), 4).alias("acres"))


@query("g19_polygon_area", with_ctes(POLY_SQL, body=f"""
, e AS (SELECT a.fid, b.x * a.y - a.x * b.y AS cross2 FROM pv a JOIN pv b ON a.fid = b.fid AND b.i = (a.i + a.n - 1) % a.n)
SELECT fid AS field_id, {r6('abs(sum(cross2)) / 2 * 900 / 4046.8564224 * 0.75')} AS acres FROM e GROUP BY fid"""))
def _(t):
    """Area of polygons with a half-size hole, 30 m units."""
    x, y = G.ring_centroid(F.col("ring"))
    hole = F.transform("ring", lambda p: F.array(x + (F.get(p, F.lit(0)) - x) / 2, y + (F.get(p, F.lit(1)) - y) / 2))
    f = polygons(t).withColumn("rings", F.array(F.col("ring"), hole))
    return f.select("field_id", rnd(G.polygon_acres(F.col("rings"), 30.0)).alias("acres"))


@query("f8_aoi_sanity", with_ctes(POLY_SQL, body="""
, b AS (SELECT fid, min(x + CASE WHEN fid % 7 = 0 THEN 100 ELSE 0 END) AS minx, max(x + CASE WHEN fid % 7 = 0 THEN 100 ELSE 0 END) AS maxx, min(y) AS miny, max(y) AS maxy FROM pv GROUP BY fid)
SELECT fid AS field_id, (fid % 5 <> 0 AND fid % 9 <> 0 AND minx >= -180 AND maxx <= 180 AND miny >= -90 AND maxy <= 90) AS ok FROM b"""))
def _(t):
    k = F.col("field_id")
    moved = F.transform("ring", lambda p: F.array(F.get(p, F.lit(0)) + F.when(k % 7 == 0, 100).otherwise(0), F.get(p, F.lit(1))))
    ring = F.when(k % 5 == 0, F.slice(moved, F.lit(1), F.size(moved) - 1)).otherwise(moved)
    polys = F.when(k % 9 == 0, F.array().cast("array<array<array<array<double>>>>")).otherwise(F.array(F.array(ring)))
    return polygons(t).select("field_id", G.valid_aoi(polys).alias("ok"))


@query("g5_utm_zone", with_ctes(A.SCENES_SQL, body="""
SELECT scene_id, CAST((CASE WHEN south >= 0 THEN 32600 ELSE 32700 END) + CAST(floor((west + 180) / 6) AS INTEGER) % 60 + 1 AS INTEGER) AS zone_epsg,
  coalesce(epsg BETWEEN 32601 AND 32660 OR epsg BETWEEN 32701 AND 32760, FALSE) AS tagged_utm FROM sn"""))
def _(t):
    return A.scenes(t).select("scene_id", P.utm_epsg(F.col("west"), F.col("south")).cast("int").alias("zone_epsg"), P.is_utm(F.col("epsg")).alias("tagged_utm"))


SCALE = repr(P.K0 * P.RECTIFYING)


def _terms(fn: str, hyper: str, coefficients, sign: str) -> str:
    return "".join(f" {sign} {c!r} * {fn}({2 * j} * xi) * {hyper}({2 * j} * eta)" for j, c in enumerate(coefficients, 1))


def sql_lonlat(name: str, source: str, x: str, y: str, epsg: str, lon: str = "lon", lat: str = "lat") -> str:
    """CTEs that add longitude and latitude of grid positions to ``source`` (4326: they are the position)."""
    return f"""{name}_1 AS (SELECT *, ({y} - CASE WHEN {epsg} >= 32700 THEN 1e7 ELSE 0.0 END) / {SCALE} AS xi, ({x} - 500000.0) / {SCALE} AS eta FROM {source}),
{name}_2 AS (SELECT * EXCLUDE (xi, eta), xi{_terms('sin', 'cosh', P.BETA, '-')} AS xi0, eta{_terms('cos', 'sinh', P.BETA, '-')} AS eta0 FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE (xi0, eta0), asinh(sin(xi0) / sqrt(sinh(eta0) * sinh(eta0) + cos(xi0) * cos(xi0))) AS psi, atan2(sinh(eta0), cos(xi0)) AS dl FROM {name}_2),
{name}_4 AS (SELECT *, tanh(psi) AS s0 FROM {name}_3),
""" + "".join(f"{name}_{5 + i} AS (SELECT * EXCLUDE (s{i}), tanh(psi + {P.ECC!r} * atanh({P.ECC!r} * s{i})) AS s{i + 1} FROM {name}_{4 + i}),\n" for i in range(5)) + f"""{name} AS (
  SELECT * EXCLUDE (psi, dl, s5), CASE WHEN {epsg} = 4326 THEN {x} ELSE ({epsg} % 100) * 6.0 - 183.0 + degrees(dl) END AS {lon},
    CASE WHEN {epsg} = 4326 THEN {y} ELSE degrees(asin(s5)) END AS {lat} FROM {name}_9)"""


def sql_utm(name: str, source: str, lon: str, lat: str, epsg: str, x: str = "x", y: str = "y") -> str:
    """CTEs that add grid positions of longitudes and latitudes to ``source``."""
    return f"""{name}_1 AS (SELECT *, radians({lon} - (({epsg} % 100) * 6.0 - 183.0)) AS lam, sin(radians({lat})) AS sn_ FROM {source}),
{name}_2 AS (SELECT * EXCLUDE (sn_), sinh(atanh(sn_) - {P.ECC!r} * atanh({P.ECC!r} * sn_)) AS tt FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE (lam, tt), atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM {name}_2),
{name} AS (
  SELECT * EXCLUDE (xi, eta), CASE WHEN {epsg} = 4326 THEN {lon} ELSE 500000.0 + {SCALE} * (eta{_terms('cos', 'sinh', P.ALPHA, '+')}) END AS {x},
    CASE WHEN {epsg} = 4326 THEN {lat} ELSE CASE WHEN {epsg} >= 32700 THEN 1e7 ELSE 0.0 END + {SCALE} * (xi{_terms('sin', 'cosh', P.ALPHA, '+')}) END AS {y} FROM {name}_3)"""


def zone_of(lon: str, lat: str) -> str:
    return f"CAST(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + CAST(floor(({lon} + 180.0) / 6.0) AS INTEGER) % 60 + 1 AS INTEGER)"


# Points along the edges of a grid (w x h pixels from c0, r0), 22 on each side.
EDGE_SQL = """(SELECT k / 21.0 AS v, side FROM range(22) AS g(k), (VALUES (0), (1), (2), (3)) AS s(side)) AS ep"""


def edge_points(source: str, w: str = "width", h: str = "height", c0: str = "0", r0: str = "0", grid: str = "") -> str:
    """``source`` with 88 points ``ex, ey`` of each row's grid."""
    g = {n: f"{grid}{n}" for n in "abcdef"}
    c = f"({c0} + CASE side WHEN 0 THEN v * {w} WHEN 1 THEN v * {w} WHEN 2 THEN 0.0 ELSE CAST({w} AS DOUBLE) END)"
    r = f"({r0} + CASE side WHEN 0 THEN 0.0 WHEN 1 THEN CAST({h} AS DOUBLE) ELSE v * {h} END)"
    return f"SELECT q.*, {g['a']} * {c} + {g['b']} * {r} + {g['c']} AS ex, {g['d']} * {c} + {g['e']} * {r} + {g['f']} AS ey FROM {source} q, {EDGE_SQL}"


#: The catalogue's scenes on 30 m grids around their own corner.
GRIDS_SQL = ",\n".join([
    A.SCENES_SQL, f"g0 AS (SELECT scene_id, k, west + 0.3 AS lon0, south + 0.4 AS lat0, {zone_of('west + 0.3', 'south')} AS epsg, width, height FROM sn)",
    sql_utm("g1", "g0", "lon0", "lat0", "epsg", "c", "f"),
    "gr AS (SELECT scene_id, k, epsg, 30.0::DOUBLE AS a, 0.0::DOUBLE AS b, c, 0.0::DOUBLE AS d, -30.0::DOUBLE AS e, f, width, height FROM g1)"])


def bounds_sql(source: str, name: str = "bo") -> str:
    """Bounds in longitude and latitude of the grids of ``source``."""
    return ",\n".join([f"{name}p AS ({edge_points(source)})", sql_lonlat(f"{name}q", f"{name}p", "ex", "ey", "epsg"), f"""{name} AS (
  SELECT * EXCLUDE (ex, ey, lon, lat), min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, (min(lon) + max(lon)) / 2.0 AS centre_lon, (min(lat) + max(lat)) / 2.0 AS centre_lat
  FROM {name}q GROUP BY ALL)"""])


def utm_grids(t):
    """Every scene of the catalogue on a 30 m grid around its own corner."""
    s = A.scenes(t).withColumn("epsg", P.utm_epsg(F.col("west") + 0.3, F.col("south")).cast("int"))
    s = P.with_utm(s, F.col("west") + 0.3, F.col("south") + 0.4, F.col("epsg"), "c", "f")
    return s.select("scene_id", "k", "epsg", F.lit(30.0).alias("a"), F.lit(0.0).alias("b"), "c", F.lit(0.0).alias("d"), F.lit(-30.0).alias("e"), "f", "width", "height")


@query("g6_lonlat_bounds", with_ctes(GRIDS_SQL, bounds_sql("gr"), body=f"""
SELECT scene_id, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in ('west', 'south', 'east', 'north', 'centre_lon', 'centre_lat'))}, NOT centre_lat BETWEEN -80.0 AND 84.0 AS no_utm FROM bo"""))
def _(t):
    """Bounds of every scene; those beyond the latitudes of UTM are flagged."""
    b = GR.lonlat_bounds(utm_grids(t))
    return b.select("scene_id", *[rnd(c, 7).alias(c) for c in ("west", "south", "east", "north", "centre_lon", "centre_lat")], "no_utm")


def plan_sql(source: str, target: str | None, resolution: float | None) -> str:
    """Target grids ``pl`` of the grids of ``source``; ``target`` is an EPSG code or NULL for the centre's zone."""
    span = lambda hi, lo, size: f"({hi} - {lo}) / {size}"
    count = (lambda d: f"ceil({d} - 1e-6)") if resolution else (lambda d: f"greatest(1, floor({d} + 0.5))")
    res = repr(float(resolution)) if resolution else "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / sqrt(CAST(width * width + height * height AS DOUBLE))"
    same = f"(te = epsg AND abs(abs(a) - {resolution}) <= 1e-8 + 1e-5 * {resolution})" if resolution else "(te = epsg)"
    return ",\n".join([
        bounds_sql(source), f"pt AS (SELECT *, {target or zone_of('centre_lon', 'centre_lat')} AS te FROM bo)", f"pp AS ({edge_points('pt')})",
        sql_lonlat("pq", "pp", "ex", "ey", "epsg", "plon", "plat"), sql_utm("pr", "pq", "plon", "plat", "te", "tx", "ty"),
        "ps AS (SELECT * EXCLUDE (ex, ey, plon, plat, tx, ty), min(tx) AS x0, max(tx) AS x1, min(ty) AS y0, max(ty) AS y1 FROM pr GROUP BY ALL)",
        f"pu AS (SELECT *, {res} AS res, {same} AS unchanged FROM ps)",
        f"""pl AS (SELECT *, CASE WHEN unchanged THEN a ELSE res END AS da, CASE WHEN unchanged THEN c ELSE x0 END AS dc, CASE WHEN unchanged THEN f ELSE y1 END AS df,
  CAST(CASE WHEN unchanged THEN width ELSE {count(span('x1', 'x0', 'res'))} END AS INTEGER) AS dw, CAST(CASE WHEN unchanged THEN height ELSE {count(span('y1', 'y0', 'res'))} END AS INTEGER) AS dh FROM pu)"""])


PLAN_BODY = f"""SELECT scene_id, unchanged, CAST(te AS INTEGER) AS epsg, {r4('da')} AS resolution, {r4('dc')} AS x0, {r4('df')} AS y0, dw AS width, dh AS height FROM pl"""


def _plan_rows(p):
    return p.select("scene_id", "unchanged", "dst.epsg", rnd("dst.a", 4).alias("resolution"), rnd("dst.c", 4).alias("x0"), rnd("dst.f", 4).alias("y0"), "dst.width", "dst.height")


@query("g7_target_grid_plan", with_ctes(GRIDS_SQL, plan_sql("gr", None, 20.0), body=PLAN_BODY))
def _(t):
    """A 20 m grid in the zone of every scene's centre."""
    return _plan_rows(GR.plan_grid(utm_grids(t), resolution=20.0))


#: Catalogue scenes on geographic grids of about 30 m.
GEO_SQL = A.SCENES_SQL + """,
gg AS (SELECT scene_id, 4326 AS epsg, 0.0003::DOUBLE AS a, 0.0::DOUBLE AS b, west + 0.3 AS c, 0.0::DOUBLE AS d, -0.0003::DOUBLE AS e, south + 0.4 AS f, width, height FROM sn)"""


def geographic_grids(t):
    return A.scenes(t).select("scene_id", F.lit(4326).alias("epsg"), F.lit(0.0003).alias("a"), F.lit(0.0).alias("b"), (F.col("west") + 0.3).alias("c"), F.lit(0.0).alias("d"),
                              F.lit(-0.0003).alias("e"), (F.col("south") + 0.4).alias("f"), "width", "height")


@query("g7_geographic_plan", with_ctes(GEO_SQL, plan_sql("gg", None, None), body=PLAN_BODY))
def _(t):
    """Geographic scenes planned to UTM without a resolution: the diagonal keeps its number of pixels."""
    return _plan_rows(GR.plan_grid(geographic_grids(t)))


@query("g7_projection_round_trip", with_ctes(
    A.SCENES_SQL, f"t0 AS (SELECT scene_id, west + 0.3 AS lon0, south + 0.4 AS lat0, {zone_of('west + 0.3', 'south + 0.4')} AS zn FROM sn)", sql_utm("t1", "t0", "lon0", "lat0", "zn"),
    body=f"SELECT scene_id, {r4('x')} AS x, {r4('y')} AS y, round(lon0, 7) + 0.0 AS lon, round(lat0, 7) + 0.0 AS lat FROM t1"))
def _(t):
    """Longitude/latitude to UTM and back, every scene."""
    lon, lat = F.col("west") + 0.3, F.col("south") + 0.4
    s = A.scenes(t).withColumn("zone", P.utm_epsg(lon, lat))
    s = P.with_lonlat(P.with_utm(s, lon, lat, F.col("zone")), F.col("x"), F.col("y"), F.col("zone"))
    return s.select("scene_id", rnd("x", 4).alias("x"), rnd("y", 4).alias("y"), rnd("lon", 7).alias("lon"), rnd("lat", 7).alias("lat"))


@query("g8_polygons_to_wgs84")
def _(t):
    """Farm rings placed on a UTM grid and written as WGS84 at 7 decimals."""
    ring = F.transform("ring", lambda p: F.array(500000 + 30 * F.get(p, F.lit(0)), 3420000 + 30 * F.get(p, F.lit(1))))
    w = P.to_wgs84(F.array(ring), F.lit(32643))
    first = F.get(F.get(w, F.lit(0)), F.lit(0))
    return polygons(t).select("field_id", F.get(first, F.lit(0)).alias("lon"), F.get(first, F.lit(1)).alias("lat"))


ALIGN_SQL = """al AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 32644 ELSE 32643 END AS epsg, CASE WHEN c_custkey % 11 = 0 THEN 20.0 ELSE 30.0 END AS a,
  500000 + 30 * (c_custkey % 17) + CASE WHEN c_custkey % 3 = 0 THEN 7.5 ELSE 0 END AS c, 3420000 - 30 * (c_custkey % 23) AS f FROM customer)"""


@query("g11_aligned_offset", with_ctes(ALIGN_SQL, body="""
SELECT k, CAST(CASE WHEN epsg = 32643 AND a = 30 AND k % 3 <> 0 THEN k % 23 END AS INTEGER) AS row_off, CAST(CASE WHEN epsg = 32643 AND a = 30 AND k % 3 <> 0 THEN k % 17 END AS INTEGER) AS col_off FROM al"""))
def _(t):
    k = F.col("c_custkey")
    res = F.when(k % 11 == 0, 20.0).otherwise(30.0)
    grid = lambda epsg, a, c, f: F.struct(epsg.alias("epsg"), a.alias("a"), F.lit(0.0).alias("b"), c.alias("c"), F.lit(0.0).alias("d"), (-a).alias("e"), f.alias("f"))
    g = t("customer").select(k.alias("k"), grid(F.lit(32643), F.lit(30.0), F.lit(500000.0), F.lit(3420000.0)).alias("outer"), grid(
        F.when(k % 7 == 0, 32644).otherwise(32643), res, 500000.0 + 30 * (k % 17) + F.when(k % 3 == 0, 7.5).otherwise(0.0), 3420000.0 - 30 * (k % 23)).alias("inner"))
    r, c = GR.aligned_offset("outer", "inner")
    return g.select("k", r.alias("row_off"), c.alias("col_off"))


def _plans(t, shift=(15.0, 15.0), epsg=32643):
    """Source grid of each raster scene and a target grid; one row per scene."""
    s = GR.scene_sizes(A.raster(t))
    make = lambda zone, c, f: F.struct(
        F.lit(zone).alias("epsg"), F.lit(30.0).alias("a"), F.lit(0.0).alias("b"), F.lit(c).alias("c"), F.lit(0.0).alias("d"), F.lit(-30.0).alias("e"), F.lit(f).alias("f"),
        F.col("width").alias("width"), F.col("height").alias("height"))
    return s.select("scene_id", make(32643, 500000.0, 3420000.0).alias("src"), make(epsg, 500000.0 + shift[0], 3420000.0 - shift[1]).alias("dst"))


@query("j6_gather_shifted_grid", with_ctes(A.RASTER_SQL, body="""
SELECT d.scene_id, d."row", d.col, s.k FROM ra d LEFT JOIN ra s ON s.scene_id = d.scene_id AND s."row" = d."row" + 2 AND s.col = d.col + 3"""))
def _(t):
    """Target grid three columns and two rows further: a pure key shift."""
    return GR.reproject(A.raster(t).select(*PK, "k"), _plans(t, (90.0, 60.0))).select(*PK, "k")


#: Height and width of the raster's scenes, and reprojection of raster values onto the grids of ``pl``.
SIZE_SQL = 'sz AS (SELECT scene_id, CAST(max("row") + 1 AS INTEGER) AS height, CAST(max(col) + 1 AS INTEGER) AS width FROM ra GROUP BY scene_id)'


def gather_sql(source: str) -> str:
    """(scene_id, row, col, k) of destination grids de, da, dc, df, dw, dh from sources epsg, a, c, e, f."""
    return ",\n".join([
        f"""dp AS (SELECT q.*, r.r AS drow, cc.c AS dcol, da * (cc.c + 0.5) + dc AS gx, -da * (r.r + 0.5) + df AS gy FROM {source} q, unnest(range(dh)) AS r(r), unnest(range(dw)) AS cc(c))""",
        sql_lonlat("dq", "dp", "gx", "gy", "te", "glon", "glat"), sql_utm("dr", "dq", "glon", "glat", "epsg", "sx", "sy"),
        """out AS (SELECT dr.scene_id, CAST(drow AS INTEGER) AS "row", CAST(dcol AS INTEGER) AS col, ra.k FROM dr
  LEFT JOIN ra ON ra.scene_id = dr.scene_id AND ra.col = CAST(floor((sx - dr.c) / dr.a) AS BIGINT) AND ra."row" = CAST(floor((sy - dr.f) / dr.e) AS BIGINT))"""])


@query("g13_reprojection", with_ctes(
    A.RASTER_SQL, SIZE_SQL, "u0 AS (SELECT scene_id, 32643 AS epsg, 32644 AS te, 500000.0::DOUBLE AS c, 3420000.0::DOUBLE AS f, 30.0::DOUBLE AS a, -30.0::DOUBLE AS e, 30.0::DOUBLE AS da, width AS dw, height AS dh FROM sz)",
    sql_lonlat("u1", "u0", "c", "f", "epsg", "ulon", "ulat"), sql_utm("u2", "u1", "ulon", "ulat", "te", "dc", "df"), gather_sql("u2"), body="SELECT * FROM out"))
def _(t):
    """Raster on zone 43 seen from a zone 44 grid over the same place: nearest source pixel."""
    p = _plans(t)
    p = P.with_lonlat(p, F.lit(500000.0), F.lit(3420000.0), F.lit(32643))
    p = P.with_utm(p, F.col("lon"), F.col("lat"), F.lit(32644), "tx", "ty")
    p = p.select("scene_id", "src", F.struct(F.lit(32644).alias("epsg"), F.lit(30.0).alias("a"), F.lit(0.0).alias("b"), F.col("tx").alias("c"), F.lit(0.0).alias("d"), F.lit(-30.0).alias("e"), F.col("ty").alias("f"),
                                     F.col("dst.width").alias("width"), F.col("dst.height").alias("height")).alias("dst"))
    return GR.reproject(A.raster(t).select(*PK, "k"), p).select(*PK, "k")


RASTER_GRID = "rgd AS (SELECT scene_id, 4326 AS epsg, 0.0003::DOUBLE AS a, 0.0::DOUBLE AS b, 75.0::DOUBLE AS c, 0.0::DOUBLE AS d, -0.0003::DOUBLE AS e, 31.0::DOUBLE AS f, width, height FROM sz)"


@query("g13_geographic_source", with_ctes(A.RASTER_SQL, SIZE_SQL, RASTER_GRID, plan_sql("rgd", None, None), gather_sql("pl"), body="SELECT * FROM out"))
def _(t):
    """The raster on a geographic grid, planned to its UTM zone and reprojected."""
    g = GR.scene_sizes(A.raster(t)).select("scene_id", F.lit(4326).alias("epsg"), F.lit(0.0003).alias("a"), F.lit(0.0).alias("b"), F.lit(75.0).alias("c"), F.lit(0.0).alias("d"),
                                           F.lit(-0.0003).alias("e"), F.lit(31.0).alias("f"), "width", "height")
    p = GR.plan_grid(g).select("scene_id", F.struct("epsg", *"abcdef", "width", "height").alias("src"), "dst")
    return GR.reproject(A.raster(t).select(*PK, "k"), p).select(*PK, "k")


@query("g12_source_windows")
def _(t):
    """Source window of every 48-pixel destination block, padded by two pixels."""
    win = GR.blocks(GR.scene_sizes(A.raster(t)), 48).join(_plans(t), "scene_id")
    return GR.source_window(win).select("scene_id", "row_off", "col_off", "src_row_off", "src_col_off", "src_h", "src_w")


def _tile_scenes(t):
    return GR.scene_sizes(A.raster(t)).select("scene_id", F.lit(32643).alias("epsg"), F.lit(30.0).alias("a"), F.lit(0.0).alias("b"), F.lit(500000.0).alias("c"), F.lit(0.0).alias("d"),
                                              F.lit(-30.0).alias("e"), F.lit(3420000.0).alias("f"), "width", "height")


def tiles_sql(zooms, means) -> str:
    """Tile pixels of the raster; ``means`` are the zooms far below the native one."""
    zs = ", ".join(f"({z})" for z in zooms)
    far = ", ".join(map(str, means)) or "-1"
    merc = lambda lat: f"(1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0"
    return ",\n".join([
        A.RASTER_SQL, SIZE_SQL,
        "tg AS (SELECT scene_id, 32643 AS epsg, 30.0::DOUBLE AS a, 0.0::DOUBLE AS b, 500000.0::DOUBLE AS c, 0.0::DOUBLE AS d, -30.0::DOUBLE AS e, 3420000.0::DOUBLE AS f, width, height FROM sz)",
        bounds_sql("tg"), f"""tr AS (SELECT bo.*, zz.z, pow(2.0, zz.z) * 256 AS n, CAST(floor((west + 180.0) / 360.0 * n) AS BIGINT) AS u0, CAST(floor((east + 180.0) / 360.0 * n) AS BIGINT) AS u1,
  CAST(floor({merc('north')} * n) AS BIGINT) AS v0, CAST(floor({merc('south')} * n) AS BIGINT) AS v1 FROM bo, (VALUES {zs}) AS zz(z))""",
        "tp AS (SELECT tr.*, u.u, v.v, (u.u + 0.5) / n * 360.0 - 180.0 AS mlon, degrees(atan(sinh(pi() * (1.0 - 2.0 * (v.v + 0.5) / n)))) AS mlat FROM tr, unnest(range(u0, u1 + 1)) AS u(u), unnest(range(v0, v1 + 1)) AS v(v) "
        f"WHERE z NOT IN ({far}))",
        sql_utm("tu", "tp", "mlon", "mlat", "epsg", "sx", "sy"),
        """tb AS (SELECT z, u, v, p0, valid FROM tu JOIN ra ON ra.scene_id = tu.scene_id AND ra.col = CAST(floor((sx - tu.c) / tu.a) AS BIGINT) AND ra."row" = CAST(floor((sy - tu.f) / tu.e) AS BIGINT))""",
        'fp AS (SELECT tg.*, p0, valid, c + a * (ra.col + 0.5) AS fx, f + e * (ra."row" + 0.5) AS fy FROM tg JOIN ra USING (scene_id))', sql_lonlat("fq", "fp", "fx", "fy", "epsg", "flon", "flat"),
        f"""tf AS (SELECT zz.z, CAST(floor((flon + 180.0) / 360.0 * pow(2.0, zz.z) * 256) AS BIGINT) AS u, CAST(floor({merc('flat')} * pow(2.0, zz.z) * 256) AS BIGINT) AS v, p0, valid
  FROM fq, (VALUES {zs}) AS zz(z) WHERE zz.z IN ({far}))""",
        "tm AS (SELECT z, u, v, avg(CASE WHEN valid THEN p0 END) AS p FROM (SELECT * FROM tb UNION ALL SELECT * FROM tf) GROUP BY z, u, v)"])


TILES_BODY = f"""SELECT CAST(z AS INTEGER) AS z, CAST(u // 256 AS INTEGER) AS x, CAST(v // 256 AS INTEGER) AS y, CAST(u % 256 AS INTEGER) AS px, CAST(v % 256 AS INTEGER) AS py, {r6('p')} AS p_healthy, CAST(CASE WHEN p IS NOT NULL THEN 210 ELSE 0 END AS INTEGER) AS alpha FROM tm"""


def _tile_rows(t, zooms):
    return TL.render_tiles(A.raster(t), _tile_scenes(t), zooms).select("z", "x", "y", "px", "py", rnd("p_healthy").alias("p_healthy"), "alpha")


@query("g26_web_map_tiles", with_ctes(tiles_sql((11, 12), (11,)), body=TILES_BODY))
def _(t):
    """Risk raster as web-map tile pixels: means of source pixels at zoom 11, every tile pixel filled at 12."""
    return _tile_rows(t, [11, 12])


@query("g26_tiles_above_native_zoom", with_ctes(tiles_sql((13, 14), ()), body=TILES_BODY))
def _(t):
    """Zooms whose tile pixels are smaller than the raster's: all of them filled."""
    return _tile_rows(t, [13, 14])


@query("x3_block_transform", with_ctes(A.RASTER_SQL, body=f"""
SELECT {PKQ}, {r6('onset - avg(onset) OVER (PARTITION BY scene_id, "row" // 32, col // 32)')} AS centred FROM ra"""))
def _(t):
    """A user function shipped to every 32-pixel block."""

    def centre(pdf):
        return pdf.assign(centred=pdf.onset - pdf.onset.mean())[["scene_id", "row", "col", "centred"]]

    out = BL.apply_blocks(A.raster(t).select(*PK, "onset"), centre, "scene_id string, row int, col int, centred double", 32)
    return out.withColumn("centred", rnd("centred"))



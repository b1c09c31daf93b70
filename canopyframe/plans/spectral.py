"""Registered queries over pixel spectra and band tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import bandmath as B
from canopyframe.functions import rules
from canopyframe.functions import spectral as S
from canopyframe.operators import bands as BD
from canopyframe.operators import reflectance as RF
from canopyframe.operators import resample as R
from canopyframe.operators import stats as ST
from canopyframe.operators import zones as Z
from canopyframe.plans import adapters as A
from canopyframe.plans.adapters import big, rnd
from canopyframe.plans.registry import query, r4, r6, with_ctes
from canopyframe.session import deal
from canopyframe.sources import cubes

WL = A.FX_WAVELENGTHS
PK = ["scene_id", "row", "col"]
PKQ = 'scene_id, "row", col'


def near(nm: float) -> str:
    """SQL for the nearest band of the test sensor (list positions start at 1)."""
    best = 0
    for i, w in enumerate(WL):
        if abs(w - nm) < abs(WL[best] - nm):
            best = i
    return f"s[{best + 1}]"


def lerp(nm: float) -> str:
    i = min(max(math.ceil((nm - 400.0) / 20.0) - 1, 0), 62)
    t = (nm - WL[i]) / 20.0
    return f"({1 - t!r} * s[{i + 1}] + {t!r} * s[{i + 2}])"


def nd(a: str, b: str) -> str:
    return f"(CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END)"


def rep_sql(get, eps: str = "") -> str:
    rise = f"({get(740)} - {get(700)}{eps})"
    lift = f"(({get(670)} + {get(780)}) / 2.0 - {get(700)})"
    return f"(CASE WHEN {rise} <> 0 THEN 700.0 + 40.0 * {lift} / {rise} END)"


STRICT = {
    "ndvi": nd(near(800), near(670)), "ndre": nd(near(790), near(720)), "rep": rep_sql(near),
    "pri": nd(near(531), near(570)), "cci": nd(near(531), near(645)),
    "mcari": f"(CASE WHEN {near(670)} <> 0 THEN (({near(700)} - {near(670)}) - 0.2 * ({near(700)} - {near(550)})) * ({near(700)} / {near(670)}) END)",
    "ndwi": nd(near(860), near(1240)),
}


def soft(a: str, b: str) -> str:
    return f"(({a} - {b}) / ({a} + {b} + 1e-6))"


INTERP = {
    "ndvi": soft(lerp(800), lerp(670)), "ndre": soft(lerp(790), lerp(720)), "pri": soft(lerp(531), lerp(570)),
    "cci": soft(lerp(531), lerp(645)), "ndwi": soft(lerp(860), lerp(1240)),
    "rep": f"least(780.0, greatest(670.0, {rep_sql(lerp, ' + 1e-6')}))",
}

# ------------------------------------------------------------------ sources


@query("s1_windowed_cube_scan", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, {r6('s[1]')} AS first_band, {r6('list_sum(s)')} AS total FROM px
WHERE "row" >= 2 AND "row" < 9 AND col >= 5 AND col < 20 AND s IS NOT NULL"""))
def _(t):
    """Pixels of one window: position filters reach the scan."""
    w = cubes.window_filter(A.pixels(t), row_off=2, col_off=5, h=7, w=15)
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)
    return w.filter("spectrum IS NOT NULL").select(*PK, rnd(F.get("spectrum", F.lit(0))).alias("first_band"), rnd(total).alias("total"))


@query("s2_band_subset_scan", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
SELECT {PKQ}, CAST(band AS INTEGER) AS band, {r6('v')} AS value FROM long WHERE band IN (7, 8, 13, 15, 42)"""))
def _(t):
    """Only the diagnostic bands of every pixel."""
    picked = ST.picked_bands(A.pixels(t), PK, {B.nearest_index(WL, nm) for nm in (531, 550, 570, 670, 700, 1240)})
    return picked.select(*PK, "band", rnd("v").alias("value"))


@query("s3_decimated_scan", with_ctes(A.RASTER_SQL, body="""
, sz AS (SELECT scene_id, max("row") + 1 AS h, max(col) + 1 AS w FROM ra GROUP BY scene_id)
SELECT ra.scene_id, ra."row", ra.col, ra.k FROM ra JOIN sz USING (scene_id)
WHERE ra."row" % greatest(1, CAST(ceil(greatest(h, w) / 40.0) AS INTEGER)) = 0
  AND ra.col % greatest(1, CAST(ceil(greatest(h, w) / 40.0) AS INTEGER)) = 0"""))
def _(t):
    from canopyframe.operators.grid import scene_sizes

    px = A.raster(t)
    return Z.decimate(px.join(scene_sizes(px), "scene_id"), 40).select(*PK, "k")


@query("s13_labelled_source", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, label, {r6('list_sum(list_transform(s, lambda x: greatest(0.0, least(1.0, (12000 * x) / 10000.0))))')} AS total
FROM px WHERE s IS NOT NULL"""))
def _(t):
    raw = A.pixels(t).withColumn("spectrum", F.transform("spectrum", lambda x: 12000 * x))
    px = cubes.load_labelled(raw, 10000.0)
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)
    return px.filter("spectrum IS NOT NULL").select(*PK, "label", rnd(total).alias("total"))


# ------------------------------------------------------------------ radiometry


def _dn(t):
    return A.pixels(t).filter("spectrum IS NOT NULL").withColumn("dn", F.transform("spectrum", lambda x: F.floor(x * 1000).cast("double")))


GAIN = [0.02 + 0.001 * i for i in range(64)]
OFFSET = [0.1 * (i % 5) for i in range(64)]
GAIN_SQL = "(0.02 + 0.001 * (i - 1))"
OFFSET_SQL = "(0.1 * ((i - 1) % 5))"


@query("p1_dn_to_radiance", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, {r6(f'list_sum(list_transform(s, lambda x, i: floor(x * 1000) * CAST({GAIN_SQL} AS DOUBLE) + CAST({OFFSET_SQL} AS DOUBLE)))')} AS total,
       {r6('0.5 * list_sum(list_transform(s, lambda x: floor(x * 1000))) + 64.0')} AS scalar_total
FROM px WHERE s IS NOT NULL"""))
def _(t):
    df = _dn(t).withColumn("r", S.radiance("dn", GAIN, OFFSET)).withColumn("q", S.radiance("dn", 0.5, 1.0))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return df.select(*PK, rnd(add("r")).alias("total"), rnd(add("q")).alias("scalar_total"))


@query("p2_earth_sun_distance", f"""
SELECT o_orderkey, {r6('1.0 - 0.01672 * cos(radians(0.9856 * (dayofyear(o_orderdate) - 4)))')} AS au FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", rnd(S.earth_sun_distance(F.dayofyear("o_orderdate"))).alias("au"))


PLANCK_SQL = (
    f"(2.0 * {K.PLANCK!r} * {K.LIGHT_SPEED!r} * {K.LIGHT_SPEED!r} / pow(nm * 1e-9, 5)"
    f" / (exp({K.PLANCK * K.LIGHT_SPEED / (K.BOLTZMANN * K.SUN_TEMP_K)!r} / (nm * 1e-9)) - 1.0)"
    f" * pi() * {(K.SUN_RADIUS_M / K.AU_M) ** 2!r} * 1e-6)"
)


@query("p3_solar_irradiance", with_ctes(A.SB_SQL, body=f"""
, g AS (SELECT CAST(range AS DOUBLE) AS nm, {PLANCK_SQL.replace('nm', 'CAST(range AS DOUBLE)')} AS e FROM range(250, 4000))
SELECT sensor_id, band, {r4('sum(exp(-0.5 * pow((nm - wl) / (fwhm / 2.3548), 2)) * e) / sum(exp(-0.5 * pow((nm - wl) / (fwhm / 2.3548), 2)))')} AS esun
FROM sb, g WHERE p_size % 7 <> 0 GROUP BY sensor_id, band
UNION ALL
SELECT sensor_id, band, {r4('(1 - (wl - floor(wl))) * a.e + (wl - floor(wl)) * b.e')} AS esun
FROM sb JOIN g a ON a.nm = floor(wl) JOIN g b ON b.nm = floor(wl) + 1 WHERE p_size % 7 = 0"""))
def _(t):
    """Irradiance of every sensor band; bands without a width take the point value."""
    b = A.sensor_bands(t).withColumn("fwhm_nm", F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(F.col("fwhm_nm")))
    return BD.solar_irradiance(b).select("sensor_id", "band", rnd("esun", 4).alias("esun"))


@query("p4_radiance_to_toa", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, {r6('''list_sum(list_transform(s, lambda x, i: pi() * (100.0 * x) *
  pow(1.0 - 0.01672 * cos(radians(0.9856 * (vec_id % 365 + 1 - 4))), 2)
  / (CAST(1000.0 + 10.0 * (i - 1) AS DOUBLE) * sin(radians(CAST(20 + vec_id % 50 AS DOUBLE))))))''')} AS total
FROM px WHERE s IS NOT NULL"""))
def _(t):
    px = A.pixels(t).filter("spectrum IS NOT NULL").withColumn("rad", F.transform("spectrum", lambda x: 100.0 * x))
    toa = S.toa_reflectance("rad", [1000.0 + 10.0 * i for i in range(64)], 20 + F.col("vec_id") % 50, F.col("vec_id") % 365 + 1)
    return px.select(*PK, rnd(F.aggregate(toa, F.lit(0.0), lambda a, x: a + x)).alias("total"))


NOT_FINITE = "(isnan(x) OR isinf(x))"


@query("p5_clip_reflectance", with_ctes(A.FAULTY_SQL, body=f"""
SELECT {PKQ}, {r6(f'CASE WHEN vec_id % 13 <> 0 AND len(list_filter(s, lambda x: {NOT_FINITE})) = 0 THEN list_sum(list_transform(s, lambda x: greatest(0.0, least(1.0, x)))) END')} AS total
FROM faulty"""))
def _(t):
    c = S.clip_reflectance("spectrum", F.col("vec_id") % 13 == 0)
    return A.faulty_pixels(t).select(*PK, rnd(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("p6_dark_object_subtraction", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, dark AS (SELECT scene_id, band, quantile_cont(v, 0.005) AS d FROM long GROUP BY scene_id, band)
SELECT l.scene_id, l."row", l.col, {r6('sum(CASE WHEN d IS NULL THEN v ELSE greatest(0.0, v - d) END)')} AS total FROM long l LEFT JOIN dark USING (scene_id, band)
GROUP BY l.scene_id, l."row", l.col"""))
def _(t):
    """Every scene's own dark values."""
    px = A.pixels(t)
    out = ST.subtract_dark_values(px, ST.dark_values(px))
    return out.filter("spectrum IS NOT NULL").select(*PK, rnd(F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("p7_sensor_values", with_ctes(A.FAULTY_SQL, body=f"""
SELECT {PKQ},
  (len(list_filter(s[:32], lambda x: {NOT_FINITE})) > 0 OR len(list_filter(s[:32], lambda x: x <> -1.0)) = 0) AS invalid,
  {r6('''CASE WHEN isnan(s[3]) OR isinf(s[3]) THEN NULL WHEN vec_id % 2 = 0 THEN pi() * (0.5 * s[3] + 1.0) * pow(1.0 - 0.01672 * cos(radians(0.9856 * (100 - 4))), 2) / (1500.0 * sin(radians(40.0)))
           ELSE 0.5 * s[3] + 1.0 END''')} AS third_band
FROM faulty"""))
def _(t):
    """All-good-bands-equal-nodata validity and the radiance or reflectance dispatch."""
    px = A.faulty_pixels(t).withColumn("v", S.radiance("spectrum", 0.5, 1.0))
    quantity = F.when(F.col("vec_id") % 2 == 0, "radiance").otherwise("reflectance")
    out = S.unit_dispatch("v", quantity, [1500.0] * 64, F.lit(40.0), F.lit(100))
    good = [i < 32 for i in range(64)]
    third = F.get(out, F.lit(2))
    return px.select(*PK, S.all_bands_nodata("spectrum", -1.0, good).alias("invalid"), F.when(~S.not_finite(third), rnd(third)).alias("third_band"))


# ------------------------------------------------------------------ band tables

WATER_SQL = "((wl BETWEEN 1340 AND 1460) OR (wl BETWEEN 1790 AND 1960))"
SIG = repr(BD.SIGMA)


@query("p8_wavelength_in_ranges", with_ctes(A.SB_SQL, body=f"SELECT sensor_id, band, {WATER_SQL} AS inside FROM sb"))
def _(t):
    return A.sensor_bands(t).select("sensor_id", "band", S.in_ranges(F.col("wavelength_nm"), K.WATER_WINDOWS_NM).alias("inside"))


@query("p9_bad_band_mask", with_ctes(A.SB_SQL, body=f"""
SELECT sensor_id, band, (sensor_bad OR {WATER_SQL} OR wl < 380 OR wl > 2510) AS bad FROM sb"""))
def _(t):
    return BD.bad_bands(A.sensor_bands(t)).select("sensor_id", "band", "bad")


WEIGHTS_SQL = f"""
dst AS (SELECT CAST(range AS INTEGER) AS dst, round(400.0 + 2100.0 * range / 199, 2) AS dwl FROM range(200)),
sbb AS (SELECT *, (sensor_bad OR {WATER_SQL} OR wl < 380 OR wl > 2510) AS bad FROM sb),
sp AS (SELECT sensor_id, coalesce(median(d), 1.0) AS spacing FROM
       (SELECT sensor_id, wl - lag(wl) OVER (PARTITION BY sensor_id ORDER BY wl) AS d FROM sb) GROUP BY sensor_id),
ov AS (SELECT sensor_id, band, dst, CASE WHEN bad THEN 0.0 ELSE
         exp(-0.5 * pow(dwl - wl, 2) / (pow(10.55 * {SIG}, 2) + pow(fwhm * {SIG}, 2))) / sqrt(2.0 * pi() * (pow(10.55 * {SIG}, 2) + pow(fwhm * {SIG}, 2))) END AS o
       FROM sbb, dst),
wt AS (SELECT ov.*, sum(o) OVER (PARTITION BY sensor_id, dst) AS tot FROM ov)"""


@query("p10_response_overlap_weights", with_ctes(A.SB_SQL, WEIGHTS_SQL, body=f"""
SELECT wt.sensor_id, dst, band, (tot * spacing >= 0.25) AS covered, {r6('CASE WHEN tot * spacing >= 0.25 THEN o / tot ELSE 0.0 END')} AS weight
FROM wt JOIN sp USING (sensor_id)"""))
def _(t):
    w = BD.response_weights(BD.bad_bands(A.sensor_bands(t)), K.canonical_wavelengths())
    return w.select("sensor_id", "dst", "band", "covered", rnd("weight").alias("weight"))


@query("p11_point_response_weights", with_ctes(A.SB_SQL, WEIGHTS_SQL, body=f"""
, pt AS (SELECT sensor_id, band, dst, exp(-0.5 * pow(dwl - wl, 2) / pow((2100.0 / 199.0) * {SIG}, 2)) AS o FROM sb, dst),
pw AS (SELECT *, sum(o) OVER (PARTITION BY sensor_id, dst) AS tot FROM pt)
SELECT sensor_id, dst, band, {r6('CASE WHEN tot > 1e-12 THEN o / tot ELSE 0.0 END')} AS weight FROM pw"""))
def _(t):
    w = BD.response_weights(A.sensor_bands(t), K.canonical_wavelengths(), K.CANONICAL_FWHM_NM_MEAN, mode="point")
    return w.select("sensor_id", "dst", "band", rnd("weight").alias("weight"))


@query("j4_band_pairs", with_ctes(A.SB_SQL, WEIGHTS_SQL, body=f"""
SELECT sensor_id, dst, count(*) AS n_bands, {r6('sum(o)')} AS mass FROM wt GROUP BY sensor_id, dst"""))
def _(t):
    """Source band by target band pairing, without a cross join."""
    # Dealt by sensor before the explode, which the sums below then need not shuffle.
    b = deal(BD.bad_bands(A.sensor_bands(t)), "sensor_id")
    flat = b.select("*", F.explode(F.transform(S.doubles(K.canonical_wavelengths()), lambda w, i: F.struct(i.cast("int").alias("dst"), w.alias("w")))).alias("d"))
    s2 = (10.55 * BD.SIGMA) ** 2
    var = s2 + F.pow(F.col("fwhm_nm") * BD.SIGMA, F.lit(2.0))
    o = F.when(F.col("bad"), 0.0).otherwise(F.exp(-0.5 * F.pow(F.col("d.w") - F.col("wavelength_nm"), F.lit(2.0)) / var) / F.sqrt(2.0 * math.pi * var))
    return flat.groupBy("sensor_id", F.col("d.dst").alias("dst")).agg(F.count(F.lit(1)).alias("n_bands"), rnd(F.sum(o)).alias("mass"))


# The 64-band test sensor as seen by the resampler.
DST20 = [410.0 + 11.0 * i for i in range(100)]
SRC_BAD = [i % 9 == 4 for i in range(64)]


@query("p12_apply_weights", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, d AS (SELECT CAST(range AS INTEGER) AS dst, 410.0 + 11.0 * range AS dwl FROM range(100)),
w0 AS (SELECT dst, range AS band, exp(-0.5 * pow((dwl - (400.0 + 20.0 * range)) / ((2100.0 / 199.0) * {SIG}), 2)) AS o FROM d, range(64)),
w AS (SELECT *, sum(o) OVER (PARTITION BY dst) AS tot FROM w0)
SELECT {PKQ}, dst, {r6('sum(v * CASE WHEN tot > 1e-12 THEN o / tot ELSE 0.0 END)')} AS value
FROM long JOIN w USING (band) GROUP BY {PKQ}, dst"""))
def _(t):
    """Matrix product per spectrum in Arrow batches (no shuffle)."""
    m = R.weight_matrix(t.spark, WL, [A.FX_FWHM] * 64, [False] * 64, DST20, K.CANONICAL_FWHM_NM_MEAN, "point")[0]
    px = R.apply_matrix(A.pixels(t).filter("spectrum IS NOT NULL").select(*PK, "spectrum"), m)
    return px.select(*PK, F.posexplode("spectrum").alias("dst", "v")).select(*PK, "dst", rnd("v").alias("value"))


@query("j3_spectrum_weight_join", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, w AS (SELECT CAST(range % 10 AS INTEGER) AS dst, range AS band, 1.0 / (1 + range) AS weight FROM range(64))
SELECT {PKQ}, dst, {r6('sum(v * weight)')} AS value FROM long JOIN w USING (band) GROUP BY {PKQ}, dst"""))
def _(t):
    """The same product as a hash join of exploded values with a weight table."""
    w = t.spark.range(64).select((F.col("id") % 10).cast("int").alias("dst"), F.col("id").cast("int").alias("band"), (1.0 / (1 + F.col("id"))).alias("weight"))
    return R.apply_weights(A.pixels(t), w, PK).select(*PK, "dst", rnd("value").alias("value"))


@query("p13_full_resampler")
def _(t):
    """Sensor spectra with planted faults to the 200-band grid; checked with NumPy in the tests."""
    px = R.resample(A.faulty_pixels(t), WL, [A.FX_FWHM] * 64, SRC_BAD, dst_wl=K.canonical_wavelengths()[:120])
    return px.select(*PK, F.posexplode_outer("spectrum").alias("band", "v")).select(*PK, "band", rnd("v").alias("value"))


@query("p14_alternative_resampler", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, d AS (SELECT CAST(range AS INTEGER) AS dst, round(400.0 + 2100.0 * range / 199, 2) AS dwl FROM range(200)),
c AS (SELECT *, greatest(0, least(CAST(ceil((dwl - 400.0) / 20.0) AS INTEGER) - 1, 62)) AS lo,
             (400.0 - (2100.0 / 199.0) / 2 <= dwl AND 1660.0 + (2100.0 / 199.0) / 2 >= dwl) AS covered FROM d),
lastc AS (SELECT max(dst) AS m FROM c WHERE covered),
e AS (SELECT c.dst, c.covered, f.lo, greatest(0.0, least(1.0, (f.dwl - (400.0 + 20.0 * f.lo)) / 20.0)) AS tt
      FROM c, lastc JOIN c f ON f.dst = least(c.dst, lastc.m))
SELECT px.scene_id, px."row", px.col, dst, covered, {r6('(1 - tt) * s[lo + 1] + tt * s[lo + 2]')} AS value FROM px, e WHERE s IS NOT NULL"""))
def _(t):
    """Linear resampling to 200 bands with edge extension and a coverage flag."""
    px, covered = R.resample_canonical(A.pixels(t).filter("spectrum IS NOT NULL").select(*PK, "spectrum"), WL)
    flags = F.array(*[F.lit(c) for c in covered])
    return px.select(*PK, F.posexplode("spectrum").alias("dst", "v")).select(*PK, "dst", F.get(flags, F.col("dst")).alias("covered"), rnd("v").alias("value"))


@query("j5_bracketing_bands", with_ctes(A.SB_SQL, body=f"""
, d AS (SELECT CAST(range AS INTEGER) AS dst, round(400.0 + 2100.0 * range / 199, 2) AS dwl FROM range(200)),
o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY wl) - 1 AS pos, count(*) OVER (PARTITION BY sensor_id) AS n FROM sb),
l AS (SELECT sensor_id, dst, dwl, max(n) AS n, count(*) FILTER (WHERE wl < dwl) AS below, min(abs(wl - dwl)) AS nearest FROM o, d GROUP BY sensor_id, dst, dwl),
p AS (SELECT *, greatest(0, least(below - 1, n - 2)) AS lft FROM l WHERE n >= 2)
SELECT p.sensor_id, dst, a.band AS lo_band, b.band AS hi_band, {r6('greatest(0.0, least(1.0, (dwl - a.wl) / greatest(b.wl - a.wl, 1e-12)))')} AS t,
       {r6('nearest')} AS nearest_nm
FROM p JOIN o a ON a.sensor_id = p.sensor_id AND a.pos = lft JOIN o b ON b.sensor_id = p.sensor_id AND b.pos = lft + 1"""))
def _(t):
    b = BD.brackets(A.sensor_bands(t), K.canonical_wavelengths())
    return b.select("sensor_id", "dst", "lo_band", "hi_band", rnd("t").alias("t"), rnd("nearest_nm").alias("nearest_nm"))


TARGETS = [470.0, 531.0, 570.0, 660.0, 670.0, 700.0, 740.0, 800.0, 860.0, 1240.0, 1650.0]


@query("p15_nearest_band", with_ctes(A.SB_SQL, body=f"""
, nms AS (SELECT unnest({TARGETS}::DOUBLE[]) AS nm),
r AS (SELECT sensor_id, nm, band, row_number() OVER (PARTITION BY sensor_id, nm ORDER BY abs(wl - nm), band) AS rn FROM sb, nms)
SELECT sensor_id, nm, band FROM r WHERE rn = 1"""))
def _(t):
    return BD.nearest_band(A.sensor_bands(t), TARGETS)


@query("p16_interpolated_band", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, {', '.join(f'{r6(lerp(nm))} AS b{nm}' for nm in (531, 645, 670, 740, 1240))} FROM px WHERE s IS NOT NULL"""))
def _(t):
    at = B.interpolated_value(F.col("spectrum"), WL)
    return A.pixels(t).filter("spectrum IS NOT NULL").select(*PK, *[rnd(at(nm)).alias(f"b{nm}") for nm in (531, 645, 670, 740, 1240)])


# ------------------------------------------------------------------ indices


def _index_query(name, layers, dialect, texts):
    sql = with_ctes(A.PX_SQL, body=f"SELECT {PKQ}, {', '.join(f'{r6(texts[n])} AS {n}' for n in layers)} FROM px")

    @query(name, sql)
    def _(t):
        px = B.with_indices(A.pixels(t), layers, dialect, WL)
        return px.select(*PK, *[rnd(n).alias(n) for n in layers])


ZONAL = {
    "ndvi": soft(near(800), near(670)), "ndre": soft(near(790), near(720)), "pri": soft(near(531), near(570)),
    "cci": soft(near(531), near(645)), "ndwi": soft(near(860), near(1240)), "rep": rep_sql(near, " + 1e-6"),
    "ci_re": f"({near(780)} / ({near(710)} + 1e-6) - 1.0)",
}


def probe_nd(a: str, b: str) -> str:
    return f"(({a} - {b}) / (CASE WHEN {a} + {b} = 0 THEN 1e-5 ELSE {a} + {b} END))"


PROBE = {
    "ndvi": f"round({probe_nd(near(840), near(670))}, 3)", "ndre": f"round({probe_nd(near(790), near(720))}, 3)",
    "pri": f"round({probe_nd(near(531), near(570))}, 3)", "ndwi": f"round({probe_nd(near(860), near(1240))}, 3)",
    "rep": f"round(CASE WHEN abs({near(740)} - {near(700)}) < 1e-5 THEN 715.0 ELSE greatest(692.0, least(738.0, 700.0 + 40.0 * (({near(670)} + {near(780)}) / 2.0 - {near(700)}) / ({near(740)} - {near(700)}))) END, 1)",
    "mcari": f"round((({near(700)} - {near(670)}) - 0.2 * ({near(700)} - {near(550)})) * ({near(700)} / (CASE WHEN {near(670)} = 0 THEN 1e-5 ELSE {near(670)} END)), 3)",
}

_index_query("p17_normalised_differences", ("ndvi", "ndre", "pri", "cci", "ndwi"), "strict", STRICT)
_index_query("p17_normalised_differences_interp", ("ndvi", "ndre", "pri", "cci", "ndwi"), "interp", INTERP)
_index_query("p17_normalised_differences_zonal", ("ndvi", "ndre", "pri", "cci", "ndwi"), "zonal", ZONAL)
_index_query("p17_normalised_differences_probe", ("ndvi", "ndre", "pri", "ndwi"), "probe", PROBE)
_index_query("p18_red_edge_position", ("rep",), "strict", STRICT)
_index_query("p18_red_edge_position_interp", ("rep",), "interp", INTERP)
_index_query("p18_red_edge_position_probe", ("rep",), "probe", PROBE)
_index_query("p19_mcari", ("mcari",), "strict", STRICT)
_index_query("p19_mcari_probe", ("mcari",), "probe", PROBE)
_index_query("p20_red_edge_chlorophyll", ("ci_re",), "zonal", ZONAL)


@query("p21_index_bundle", with_ctes(A.FAULTY_SQL, body=f"""
, ok AS (SELECT * FROM faulty WHERE len(list_filter(s, lambda x: {NOT_FINITE} OR x = -1.0)) = 0)
SELECT f.scene_id, f."row", f.col, {', '.join(f'ix.{n}' for n in B.BUNDLE)}
FROM faulty f LEFT JOIN (SELECT vec_id, {', '.join(f'{r6(STRICT[n])} AS {n}' for n in B.BUNDLE)} FROM ok) ix USING (vec_id)"""))
def _(t):
    """All seven layers in one projection; a pixel with any nodata band has no index."""
    px = A.faulty_pixels(t).withColumn("spectrum", S.null_if_missing("spectrum"))
    ix = B.with_indices(px, B.BUNDLE, "strict", WL)
    return ix.select(*PK, *[rnd(n).alias(n) for n in B.BUNDLE])


# ------------------------------------------------------------------ masks and statistics


@query("p22_robust_scaling", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, st AS (SELECT scene_id, band, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM long GROUP BY scene_id, band)
SELECT l.scene_id, l."row", l.col, CAST(l.band AS INTEGER) AS band,
       {r6('CASE WHEN lo IS NULL THEN v ELSE greatest(0.0, least(1.0, (v - lo) / CASE WHEN hi - lo > 1e-6 THEN hi - lo ELSE 1.0 END)) END')} AS value
FROM long l LEFT JOIN st USING (scene_id, band)"""))
def _(t):
    """Every scene's own statistics."""
    px = A.pixels(t)
    scaled = ST.apply_scaling(px, ST.band_stats(px, keys=["scene_id"]), keys=["scene_id"])
    return scaled.filter("spectrum IS NOT NULL").select(*PK, F.posexplode("spectrum").alias("band", "v")).select(*PK, "band", rnd("v").alias("value"))


@query("p23_nodata_mask", with_ctes(A.FAULTY_SQL, body=f"""
SELECT {PKQ}, len(list_filter(s, lambda x: {NOT_FINITE} OR x = -1.0)) > 0 AS missing FROM faulty"""))
def _(t):
    return A.faulty_pixels(t).select(*PK, S.any_band_missing("spectrum").alias("missing"))


CLOUD = f"({near(470)} > 0.25 AND coalesce({nd(near(860), near(660))}, 0) < 0.2)"


@query("p24_cloud_shadow", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, {CLOUD} AS cloud, ({near(860)} < 0.35 AND {near(1650)} < 0.35 AND {near(860)} >= 0 AND NOT {CLOUD}) AS shadow FROM px WHERE s IS NOT NULL"""))
def _(t):
    px = ST.cloud_shadow(A.pixels(t).filter("spectrum IS NOT NULL"), WL, shadow_nir=0.35, shadow_swir=0.35)
    return px.select(*PK, "cloud", "shadow")


@query("p25_scene_transform_chain")
def _(t):
    """Counts to canonical reflectance: gains, sun angle, dark values, resampling, smoothing, masks."""
    targets = K.canonical_wavelengths()[:120]
    sensor = RF.Sensor(
        WL, [A.FX_FWHM] * 64, SRC_BAD, gain=0.9, offset=0.01, quantity=F.when(F.col("scene_id") == "scn_0", "radiance").otherwise("reflectance"),
        esun=[3.0] * 64, sun_elevation=F.lit(55.0), day_of_year=F.lit(120))
    px = RF.to_reflectance(A.faulty_pixels(t), sensor, RF.Steps(dark_fraction=0.005, targets=targets, smooth=True, outside=F.col("row") < 1))
    return px.select(*PK, F.col("spectrum").isNotNull().alias("kept"), rnd(F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("p26_vegetation_mask", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, coalesce(label IN (2, 3, 5) OR (coalesce({INTERP['ndvi']} >= 0.1, FALSE) AND label = 0), FALSE) AS vegetation FROM px"""))
def _(t):
    px = A.pixels(t)
    v = B.ndvi(B.band_reader("spectrum", WL, "interp"), "interp")
    return ST.vegetation_mask(px, [2, 3, 5], v, 0.1).select(*PK, "vegetation")


@query("u5_combined_masks", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, (s IS NULL OR coalesce({CLOUD}, FALSE)
  OR coalesce({near(860)} < 0.04 AND {near(1650)} < 0.03 AND NOT {CLOUD}, FALSE) OR NOT ("row" BETWEEN 1 AND 8)) AS masked FROM px"""))
def _(t):
    px = ST.cloud_shadow(A.pixels(t), WL)
    m = ST.combine_masks(F.col("spectrum").isNull(), F.col("cloud"), F.col("shadow"), ~F.col("row").between(1, 8))
    return px.select(*PK, m.alias("masked"))


@query("f11_valid_pixel_filter", with_ctes(A.FAULTY_SQL, body=f"""
SELECT {PKQ} FROM faulty WHERE len(list_filter(s, lambda x: {NOT_FINITE} OR x = -1.0)) = 0"""))
def _(t):
    return ST.valid_pixels(A.faulty_pixels(t)).select(*PK)


@query("a1_band_percentiles", with_ctes(A.FAULTY_SQL, body=f"""
, ok AS (SELECT * FROM faulty WHERE len(list_filter(s, lambda x: {NOT_FINITE} OR x = -1.0)) = 0),
long AS (SELECT i - 1 AS band, s[i] AS v FROM ok, range(1, 65) AS g(i))
SELECT CAST(band AS INTEGER) AS band, {r6('quantile_cont(v, 0.02)')} AS low, {r6('quantile_cont(v, 0.98)')} AS high, count(*) AS n_pixels FROM long GROUP BY band"""))
def _(t):
    return ST.band_stats(A.faulty_pixels(t)).select("band", rnd("low").alias("low"), rnd("high").alias("high"), big("n_pixels").alias("n_pixels"))


@query("a2_dark_values", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
SELECT scene_id, CAST(band AS INTEGER) AS band, {r6('quantile_cont(v, 0.005)')} AS dark FROM long GROUP BY scene_id, band"""))
def _(t):
    return ST.dark_values(A.pixels(t)).select("scene_id", "band", rnd("dark").alias("dark"))


@query("a5_scene_summary", with_ctes(A.PX_SQL, body=f"""
SELECT scene_id, CAST(max("row") + 1 AS INTEGER) AS height, CAST(max(col) + 1 AS INTEGER) AS width,
       CAST(ceil((max("row") + 1) / 8.0) * ceil((max(col) + 1) / 8.0) AS BIGINT) AS n_blocks, count(s) AS n_valid,
       {r6('count(s) / CAST((max("row") + 1) * (max(col) + 1) AS DOUBLE)')} AS valid_fraction FROM px GROUP BY scene_id"""))
def _(t):
    return ST.scene_summary(A.pixels(t), 8).withColumn("valid_fraction", rnd("valid_fraction"))


def zonal_sql(get) -> dict[str, str]:
    return {
        "reip": rep_sql(get, " + 1e-6"), "pri": soft(get(531), get(570)),
        "ci_re": f"({get(780)} / ({get(710)} + 1e-6) - 1.0)", "ndwi": soft(get(860), get(1240)),
    }


def _bands_agg(fn: str) -> str:
    return ", ".join(f"{fn.format(near(nm))} AS b{nm}" for nm in B.ZONE_BANDS_NM)


ZCOL = zonal_sql(lambda nm: f"b{nm}")
REF_SQL = f"med AS (SELECT scene_id, {_bands_agg('quantile_cont({}, 0.5)')} FROM px WHERE s IS NOT NULL GROUP BY scene_id)"
MEAN_SQL = f"zm AS (SELECT scene_id, col // 5 AS zone, {_bands_agg('avg({})')} FROM px WHERE s IS NOT NULL GROUP BY scene_id, col // 5)"


def _zone_px(t):
    return A.pixels(t).filter("spectrum IS NOT NULL").withColumn("zone", F.expr("col div 5").cast("int"))


@query("a8_scene_reference", with_ctes(A.PX_SQL, REF_SQL, body=f"SELECT scene_id, {', '.join(f'{r6(e)} AS ref_{n}' for n, e in ZCOL.items())} FROM med"))
def _(t):
    ref = Z.scene_reference(A.pixels(t), WL)
    return ref.select("scene_id", *[rnd(f"ref_{n}").alias(f"ref_{n}") for n in ZCOL])


@query("a9_zone_indices", with_ctes(A.PX_SQL, MEAN_SQL, body=f"SELECT scene_id, CAST(zone AS INTEGER) AS zone, {', '.join(f'{r6(e)} AS {n}' for n, e in ZCOL.items())} FROM zm"))
def _(t):
    z = Z.zone_indices(_zone_px(t), WL, ["scene_id", "zone"])
    return z.select("scene_id", "zone", *[rnd(n).alias(n) for n in ZCOL])


DROPS = ", ".join(
    f"{{'d': (m_{n} - z_{n}) / {s}::DOUBLE, 'o': {-i}, 'n': '{name}'}}" for i, (n, s, name) in enumerate(K.INDICATOR_SCALES))


@query("a10_dominant_indicator", with_ctes(A.PX_SQL, REF_SQL, MEAN_SQL, body=f"""
, mr AS (SELECT scene_id, {', '.join(f'{e} AS m_{n}' for n, e in ZCOL.items())} FROM med),
zr AS (SELECT scene_id, zone, {', '.join(f'{e} AS z_{n}' for n, e in ZCOL.items())} FROM zm)
SELECT scene_id, CAST(zone AS INTEGER) AS zone, list_max([{DROPS}]).n AS dominant_indicator FROM zr JOIN mr USING (scene_id)"""))
def _(t):
    z = Z.zone_indices(_zone_px(t), WL, ["scene_id", "zone"])
    return Z.dominant_indicator(z, Z.scene_reference(A.pixels(t), WL)).select("scene_id", "zone", "dominant_indicator")


@query("j10_zone_scene_join", with_ctes(A.PX_SQL, REF_SQL, MEAN_SQL, body=f"""
SELECT zm.scene_id, CAST(zone AS INTEGER) AS zone, {r6('med.b670 - zm.b670')} AS red_drop FROM zm JOIN med USING (scene_id)"""))
def _(t):
    """Zone means next to their scene's medians, one reference row per scene."""
    from canopyframe.operators.quantiles import exact_percentiles
    from canopyframe.session import broadcast_if_small

    i = B.nearest_index(WL, 670)
    px = _zone_px(t).withColumn("v", F.get("spectrum", F.lit(i)))
    ref = broadcast_if_small(exact_percentiles(px, ["scene_id"], "v", [0.5]))
    z = px.groupBy("scene_id", "zone").agg(F.avg("v").alias("m"))
    return z.join(ref, "scene_id").select("scene_id", "zone", rnd(F.col("q0") - F.col("m")).alias("red_drop"))


IX_SQL = f"""
ix AS (SELECT {PKQ}, vec_id, s IS NOT NULL AS valid, {', '.join(f'{INTERP[n]} AS {n}' for n in ('rep', 'ndre', 'pri', 'cci', 'ndvi'))} FROM px),
veg AS (SELECT *, valid AND coalesce(ndvi >= 0.4, FALSE) AS vegetation FROM ix),
base AS (SELECT scene_id, {', '.join(f'quantile_cont({n}, 0.5) AS b_{n}' for n in ('rep', 'ndre', 'pri', 'cci', 'ndvi'))} FROM veg WHERE vegetation GROUP BY scene_id),
df AS (SELECT veg.*, {', '.join(f'coalesce(b_{i}, 0.0) - {i} AS {d}' for d, i in ST.DEFICIT_OF.items())} FROM veg LEFT JOIN base USING (scene_id))"""

LABEL_SQL = """
sc1 AS (SELECT *,
  CASE WHEN rep_shift_nm >= 3 THEN 1.0 ELSE 0 END + CASE WHEN ndre_drop >= 0.03 THEN 1.0 ELSE 0 END
   + CASE WHEN pri_drop >= 0.02 THEN 0.5 ELSE 0 END + CASE WHEN cci_drop >= 0.03 THEN 0.5 ELSE 0 END AS early,
  CASE WHEN rep_shift_nm >= 8 THEN 1.0 ELSE 0 END + CASE WHEN ndre_drop >= 0.08 THEN 1.0 ELSE 0 END
   + CASE WHEN pri_drop >= 0.05 THEN 0.5 ELSE 0 END + CASE WHEN cci_drop >= 0.08 THEN 0.5 ELSE 0 END AS high,
  coalesce(ndvi_drop >= 0.15, FALSE) AS visible FROM df),
sc2 AS (SELECT *, CASE WHEN visible THEN 3 WHEN high >= 1.5 THEN 2 WHEN early >= 1.5 THEN 1 ELSE 0 END AS c0,
               vegetation OR (valid AND visible) AS keep FROM sc1),
lb AS (SELECT *, CASE WHEN keep THEN c0 END AS cls,
   CASE WHEN NOT keep THEN 0.0 ELSE (CASE c0 WHEN 3 THEN 3.0 WHEN 2 THEN high WHEN 1 THEN early ELSE 3.0 - early END) / 3.0 END AS confidence,
   CASE WHEN NOT keep THEN 30.0 ELSE (CASE c0 WHEN 0 THEN 30.0 WHEN 1 THEN 16.0 WHEN 2 THEN 4.0 ELSE 0.0 END) END AS onset FROM sc2)"""


def _with_indices(t):
    ix = B.with_indices(A.pixels(t), tuple(ST.DEFICIT_OF.values()), "interp", WL)
    ix = ix.withColumn("valid", F.col("spectrum").isNotNull())
    return ix.withColumn("vegetation", F.col("valid") & F.coalesce(F.col("ndvi") >= 0.4, F.lit(False)))


@query("a11_vegetation_baselines", with_ctes(A.PX_SQL, IX_SQL, body=f"SELECT scene_id, {', '.join(f'{r6(f'b_{n}')} AS base_{n}' for n in ('rep', 'ndre', 'pri', 'cci', 'ndvi'))} FROM base"))
def _(t):
    b = ST.index_baselines(_with_indices(t))
    return b.select("scene_id", *[rnd(f"base_{n}").alias(f"base_{n}") for n in ST.DEFICIT_OF.values()])


@query("j15_pixel_deficits", with_ctes(A.PX_SQL, IX_SQL, body=f"SELECT {PKQ}, {', '.join(f'{r6(d)} AS {d}' for d in ST.DEFICIT_OF)} FROM df"))
def _(t):
    ix = _with_indices(t)
    return ST.deficits(ix, ST.index_baselines(ix)).select(*PK, *[rnd(d).alias(d) for d in ST.DEFICIT_OF])


@query("a12_proxy_labels", with_ctes(A.PX_SQL, IX_SQL, LABEL_SQL, body=f"SELECT {PKQ}, CAST(cls AS INTEGER) AS cls, {r6('confidence')} AS confidence, {r6('onset')} AS onset FROM lb"))
def _(t):
    lab = ST.proxy_labels(A.pixels(t), WL, smooth_sigma=0.0)
    return lab.select(*PK, F.col("cls").cast("int").alias("cls"), rnd("confidence").alias("confidence"), rnd("onset").alias("onset"))


_GAUSS = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
_INDEX_NAMES = ("rep", "ndre", "pri", "cci", "ndvi")
SMOOTH_SQL = f"""
ix AS (SELECT {PKQ}, vec_id, s IS NOT NULL AS valid, {', '.join(f'{INTERP[n]} AS {n}' for n in _INDEX_NAMES)} FROM px),
sz AS (SELECT scene_id, max("row") + 1 AS h, max(col) + 1 AS w FROM px GROUP BY scene_id),
kn(o, g) AS (VALUES {', '.join(f'({i - 4}, {x / sum(_GAUSS)!r})' for i, x in enumerate(_GAUSS))}),
u AS ({' UNION ALL '.join(f"SELECT {PKQ}, '{n}' AS name, CASE WHEN {n} IS NULL OR isnan({n}) THEN 0.0 ELSE {n} END AS v FROM ix" for n in _INDEX_NAMES)}),
u1 AS (SELECT a.scene_id, a."row", a.col, a.name, sum(kn.g * b.v) AS v FROM u a JOIN sz ON sz.scene_id = a.scene_id, kn, u b
  WHERE b.scene_id = a.scene_id AND b.name = a.name AND b.col = a.col AND b."row" = greatest(0, least(sz.h - 1, a."row" + o)) GROUP BY 1, 2, 3, 4),
u2 AS (SELECT a.scene_id, a."row", a.col, a.name, sum(kn.g * b.v) AS v FROM u1 a JOIN sz ON sz.scene_id = a.scene_id, kn, u1 b
  WHERE b.scene_id = a.scene_id AND b.name = a.name AND b."row" = a."row" AND b.col = greatest(0, least(sz.w - 1, a.col + o)) GROUP BY 1, 2, 3, 4),
sm AS (SELECT {PKQ}, {', '.join(f"max(CASE WHEN name = '{n}' THEN v END) AS {n}" for n in _INDEX_NAMES)} FROM u2 GROUP BY 1, 2, 3),
veg AS (SELECT ix.scene_id, ix."row", ix.col, vec_id, valid, {', '.join(f'sm.{n}' for n in _INDEX_NAMES)}, valid AND coalesce(ix.ndvi >= 0.4, FALSE) AS vegetation
  FROM ix JOIN sm ON sm.scene_id = ix.scene_id AND sm."row" = ix."row" AND sm.col = ix.col),
base AS (SELECT scene_id, {', '.join(f'quantile_cont({n}, 0.5) AS b_{n}' for n in _INDEX_NAMES)} FROM veg WHERE vegetation GROUP BY scene_id),
df AS (SELECT veg.*, {', '.join(f'coalesce(b_{i}, 0.0) - {i} AS {d}' for d, i in ST.DEFICIT_OF.items())} FROM veg LEFT JOIN base USING (scene_id))"""


@query("a12_smoothed_labels", with_ctes(A.PX_SQL, SMOOTH_SQL, LABEL_SQL, body=f"SELECT {PKQ}, CAST(cls AS INTEGER) AS cls, {r6('confidence')} AS confidence, {r6('onset')} AS onset FROM lb"))
def _(t):
    """Proxy labels with the default smoothing of the index maps."""
    lab = ST.proxy_labels(A.pixels(t), WL, block=16)
    return lab.select(*PK, F.col("cls").cast("int").alias("cls"), rnd("confidence").alias("confidence"), rnd("onset").alias("onset"))


@query("flagship_stress_acres", with_ctes(A.PX_SQL, IX_SQL, LABEL_SQL, body=f"""
SELECT scene_id, CAST(cls AS INTEGER) AS risk_class, count(*) AS n_pixels, {r4('count(*) * (900.0 / 4046.8564224)')} AS acres, {r6('avg(confidence)')} AS mean_confidence
FROM lb WHERE cls IS NOT NULL GROUP BY scene_id, cls"""))
def flagship(t):
    """For each scene: pixels and acres in every vegetation-stress class."""
    lab = ST.proxy_labels(A.pixels(t), WL, smooth_sigma=0.0).filter(F.col("cls").isNotNull())
    n = F.count(F.lit(1))
    return lab.groupBy("scene_id", F.col("cls").cast("int").alias("risk_class")).agg(
        n.alias("n_pixels"), rnd(n * (900.0 / K.SQM_PER_ACRE), 4).alias("acres"), rnd(F.avg("confidence")).alias("mean_confidence"))


@query("a29_mean_spectrum", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
SELECT scene_id, ("row" < 5 AND col < 12) AS healthy_region, CAST(band AS INTEGER) AS band, {r6('avg(v)')} AS mean FROM long GROUP BY 1, 2, 3"""))
def _(t):
    px = A.pixels(t).withColumn("healthy_region", (F.col("row") < 5) & (F.col("col") < 12))
    return ST.mean_spectrum(px, ["scene_id", "healthy_region"]).withColumn("mean", rnd("mean"))


# ------------------------------------------------------------------ interpolation and smoothing along bands

BADS = [i in (0, 1, 7, 8, 9, 30, 63) for i in range(64)]


@query("w1_interpolate_bands", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, g AS (SELECT *, CASE WHEN band NOT IN (0, 1, 7, 8, 9, 30, 63) THEN band END AS gb FROM long),
n AS (SELECT *, max(gb) OVER (PARTITION BY {PKQ} ORDER BY band ROWS UNBOUNDED PRECEDING) AS lo,
              min(gb) OVER (PARTITION BY {PKQ} ORDER BY band DESC ROWS UNBOUNDED PRECEDING) AS hi FROM g)
SELECT n.scene_id, n."row", n.col, CAST(n.band AS INTEGER) AS band,
  {r6('CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL OR lo = hi THEN a.v ELSE (1.0 - (n.band - lo) / CAST(hi - lo AS DOUBLE)) * a.v + (n.band - lo) / CAST(hi - lo AS DOUBLE) * b.v END')} AS value
FROM n LEFT JOIN long a ON a.vec_id = n.vec_id AND a.band = lo LEFT JOIN long b ON b.vec_id = n.vec_id AND b.band = hi"""))
def _(t):
    px = R.interpolate_bands(A.pixels(t).filter("spectrum IS NOT NULL"), WL, BADS)
    return px.select(*PK, F.posexplode("spectrum").alias("band", "v")).select(*PK, "band", rnd("v").alias("value"))


# Quadratic smoothing of a 7-point window: centre kernel and the fits of the end windows, exact fractions.
SG = [[32, 15, 3, -4, -6, -3, 5], [5, 4, 3, 2, 1, 0, -1], [1, 3, 4, 4, 3, 1, -2], [-2, 3, 6, 7, 6, 3, -2]]
SG_DEN = [42, 14, 14, 21]


def _sg_sql() -> str:
    rows = []
    for b in range(64):
        k = b if b < 3 else (63 - b if b > 60 else 3)
        start = min(max(b - 3, 0), 57)
        weights = SG[k] if b <= 60 else SG[k][::-1]
        rows += [f"({b}, {start + j}, {w}.0 / {SG_DEN[k]})" for j, w in enumerate(weights)]
    return ", ".join(rows)


@query("w2_savitzky_golay", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
, k(dst, band, w) AS (VALUES {_sg_sql()})
SELECT {PKQ}, dst AS band, {r6('sum(w * v)')} AS value FROM long JOIN k USING (band) GROUP BY {PKQ}, dst"""))
def _(t):
    px = R.savgol(A.pixels(t).filter("spectrum IS NOT NULL").select(*PK, "spectrum"), 64)
    return px.select(*PK, F.posexplode("spectrum").alias("band", "v")).select(*PK, "band", rnd("v").alias("value"))


@query("w3_band_gradient", with_ctes(A.SB_SQL, body=f"""
, n AS (SELECT *, lag(wl) OVER w AS l, lead(wl) OVER w AS r FROM sb WINDOW w AS (PARTITION BY sensor_id ORDER BY band))
SELECT sensor_id, band, {r6('abs(CASE WHEN l IS NULL AND r IS NULL THEN 10.0 WHEN l IS NULL THEN r - wl WHEN r IS NULL THEN wl - l ELSE (r - l) / 2 END)')} AS spacing FROM n"""))
def _(t):
    return BD.gradient(A.sensor_bands(t)).select("sensor_id", "band", rnd("spacing").alias("spacing"))


@query("w4_median_spacing", with_ctes(A.SB_SQL, WEIGHTS_SQL, body=f"SELECT sensor_id, {r6('spacing')} AS median_spacing FROM sp"))
def _(t):
    return BD.median_spacing(A.sensor_bands(t)).withColumn("median_spacing", rnd("median_spacing"))


@query("s7_nominal_sensor_bands", f"""
WITH b AS (SELECT p_partkey, CAST(p_partkey % 242 + 1 AS INTEGER) AS n FROM part)
SELECT p_partkey, n AS band_number,
  {r6('CASE WHEN n <= 70 THEN 355.59 + (1057.68 - 355.59) / 69.0 * (n - 1) ELSE 851.92 + (2577.08 - 851.92) / 171.0 * (n - 71) END')} AS wavelength_nm,
  {r6('CASE WHEN n <= 70 THEN 1.0 / 40.0 ELSE 1.0 / 80.0 END')} AS gain,
  NOT (n BETWEEN 8 AND 57 OR n BETWEEN 77 AND 224) AS sensor_bad FROM b""")
def _(t):
    """Nominal 242-band table looked up for the band number of every part."""
    b = t("part").select("p_partkey", (F.col("p_partkey") % 242 + 1).cast("int").alias("band_number"))
    n = BD.nominal_band(F.col("band_number"))
    return b.select("p_partkey", "band_number", rnd(n["wavelength_nm"]).alias("wavelength_nm"), rnd(n["gain"]).alias("gain"), n["sensor_bad"].alias("sensor_bad"))


@query("s8_merge_band_sets", with_ctes(A.SB_SQL, body=f"""
, m AS (SELECT sensor_id, band % 2 AS detector, band, CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE wl END AS wl, p_retailprice / 1000.0::DOUBLE AS lo, p_size::DOUBLE AS hi FROM sb)
SELECT sensor_id, CAST(row_number() OVER (PARTITION BY sensor_id ORDER BY wl <= 0, wl, detector, band) - 1 AS INTEGER) AS position, CAST(detector AS INTEGER) AS detector, band,
  round((hi - lo) / 65535.0::DOUBLE, 9) + 0.0 AS gain, wl <= 0 AS sensor_bad FROM m"""))
def _(t):
    b = A.sensor_bands(t).select(
        "sensor_id", "band", F.when(F.col("p_partkey") % 13 == 0, 0.0).otherwise(F.col("wavelength_nm")).alias("wavelength_nm"), "fwhm_nm",
        (F.col("p_retailprice") / 1000.0).alias("lo"), F.col("p_size").cast("double").alias("hi"))
    m = BD.merge_band_sets(b.filter("band % 2 = 0"), b.filter("band % 2 = 1"))
    return m.select("sensor_id", "position", "detector", "band", rnd("gain", 9).alias("gain"), "sensor_bad")


@query("s9_bands_from_tags", with_ctes(A.SB_SQL, body=f"""
, g AS (SELECT *, CASE WHEN sensor_id % 2 = 0 THEN fwhm END AS tag, lag(wl) OVER w AS l, lead(wl) OVER w AS r FROM sb WINDOW w AS (PARTITION BY sensor_id ORDER BY band))
SELECT sensor_id, band, {r6('coalesce(tag, abs(CASE WHEN l IS NULL AND r IS NULL THEN 10.0 WHEN l IS NULL THEN r - wl WHEN r IS NULL THEN wl - l ELSE (r - l) / 2 END))')} AS fwhm_nm FROM g"""))
def _(t):
    tags = A.sensor_bands(t).select("sensor_id", "band", F.create_map(
        F.lit("wavelength_nm"), F.col("wavelength_nm").cast("string"),
        F.lit("fwhm_nm"), F.when(F.col("sensor_id") % 2 == 0, F.col("fwhm_nm").cast("string"))).alias("tags"))
    return cubes.bands_from_tags(tags).select("sensor_id", "band", rnd("fwhm_nm").alias("fwhm_nm"))


@query("u2_remove_bands", with_ctes(A.SB_SQL, body="SELECT sensor_id, band FROM sb EXCEPT SELECT sensor_id, band FROM sb WHERE sensor_bad"))
def _(t):
    b = A.sensor_bands(t)
    return BD.remove_bands(b, b.filter("sensor_bad").select("sensor_id", "band")).select("sensor_id", "band")


FAULTY_BANDS_SQL = """fb AS (SELECT sensor_id, band, 400.0 + 31.0 * band + CASE WHEN p_partkey % 7 = 0 THEN 0.3 ELSE 0.01 END AS got FROM sb WHERE p_partkey % 9 <> 0)"""
GRID31 = [400.0 + 31.0 * i for i in range(60)]


@query("j14_wavelength_check", with_ctes(A.SB_SQL, FAULTY_BANDS_SQL, body="""
, want AS (SELECT sensor_id, CAST(range AS INTEGER) AS band, 400.0 + 31.0 * range AS w FROM (SELECT DISTINCT sensor_id FROM fb), range(60)),
j AS (SELECT coalesce(want.sensor_id, fb.sensor_id) AS sensor_id, coalesce(want.band, fb.band) AS band,
        CASE WHEN w IS NULL THEN 'unexpected' WHEN got IS NULL THEN 'missing' WHEN abs(got - w) > 0.05 THEN 'off_grid' END AS issue
      FROM want FULL JOIN fb ON want.sensor_id = fb.sensor_id AND want.band = fb.band)
SELECT * FROM j WHERE issue IS NOT NULL"""))
def _(t):
    """Observed against expected wavelengths: full outer join with a tolerance."""
    fb = A.sensor_bands(t).filter("p_partkey % 9 <> 0").withColumn(
        "wavelength_nm", 400.0 + 31.0 * F.col("band") + F.when(F.col("p_partkey") % 7 == 0, 0.3).otherwise(0.01))
    return BD.check_wavelengths(fb, GRID31)


@query("a32_scene_info", with_ctes(A.SB_SQL, WEIGHTS_SQL, body=f"""
, b AS (SELECT sensor_id, count(*) AS n_bands, count(*) FILTER (WHERE bad) AS n_bad, round(min(wl), 2) AS wl_min, round(max(wl), 2) AS wl_max FROM sbb GROUP BY sensor_id)
SELECT s_suppkey, s_name, n_bands, n_bad, wl_min, wl_max, {r6('s_acctbal')} AS sun_elevation FROM supplier JOIN b ON sensor_id = s_suppkey % 8"""))
def _(t):
    s = t("supplier").withColumn("sensor_id", F.col("s_suppkey") % 8)
    info = BD.scene_info(s, BD.bad_bands(A.sensor_bands(t)))
    return info.select("s_suppkey", "s_name", "n_bands", "n_bad", "wl_min", "wl_max", rnd("s_acctbal").alias("sun_elevation"))


@query("x1_registered_index", with_ctes(A.PX_SQL, body=f"SELECT {PKQ}, {r6(nd(near(750), near(705)))} AS ndre705 FROM px"))
def _(t):
    """A user index added to the dictionary of builders."""
    if "ndre705" not in B.INDEX_BUILDERS:
        B.register_index("ndre705", lambda r, dialect: B.normalised_difference(r(750), r(705), dialect))
    return B.with_indices(A.pixels(t), ("ndre705",), "strict", WL).select(*PK, rnd("ndre705").alias("ndre705"))


@query("p27_label_for_days", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN NOT inf OR d > 25 THEN 0 WHEN d > 7 THEN 1 WHEN d > 0 THEN 2 ELSE 3 END AS INTEGER) AS cls,
  CAST(CASE WHEN inf AND d <= 25 THEN greatest(0.0, least(30.0, d)) ELSE 30.0 END AS DOUBLE) AS onset
FROM (SELECT *, l_quantity - 10 AS d, l_returnflag <> 'N' AS inf FROM lineitem)""")
def _(t):
    """Class and onset target from days to symptoms, for every line item."""
    d, inf = F.col("l_quantity") - 10, F.col("l_returnflag") != "N"
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.label_for_days(d, inf).cast("int").alias("cls"),
                                rules.onset_for_days(d, inf).alias("onset"))

"""Operators on band tables: one row per sensor band, ``(sensor_id, band, wavelength_nm, fwhm_nm)``.

A sensor has at most a few hundred bands, so windows per sensor are bounded by the instrument.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import spectral as S
from canopyframe.session import deal

SIGMA = 1.0 / (2.0 * math.sqrt(2.0 * math.log(2.0)))
# Nominal 242-band sensor (detector spans in nm, FWHM, count scales, calibrated bands).
VNIR_COUNT, VNIR_SPAN, VNIR_SCALE = 70, (355.59, 1057.68), 40.0
SWIR_COUNT, SWIR_SPAN, SWIR_SCALE = 172, (851.92, 2577.08), 80.0
NOMINAL_FWHM = 10.9
CALIBRATED = ((8, 57), (77, 224))


def nominal_band(number: Column) -> dict[str, Column]:
    """Wavelength, FWHM, count scale and bad flag of band 1..242 of the nominal sensor."""
    vnir = number <= VNIR_COUNT
    step_v = (VNIR_SPAN[1] - VNIR_SPAN[0]) / (VNIR_COUNT - 1)
    step_s = (SWIR_SPAN[1] - SWIR_SPAN[0]) / (SWIR_COUNT - 1)
    wl = F.when(vnir, VNIR_SPAN[0] + step_v * (number - 1)).otherwise(SWIR_SPAN[0] + step_s * (number - VNIR_COUNT - 1))
    good = F.lit(False)
    for lo, hi in CALIBRATED:
        good = good | number.between(lo, hi)
    return {
        "wavelength_nm": wl,
        "fwhm_nm": F.lit(NOMINAL_FWHM),
        "gain": F.when(vnir, 1.0 / VNIR_SCALE).otherwise(1.0 / SWIR_SCALE),
        "sensor_bad": ~good,
    }


def bad_bands(bands: DataFrame, out: str = "bad") -> DataFrame:
    """Sensor-flagged, inside a water window, outside the usable range, or not finite."""
    wl = F.col("wavelength_nm")
    lo, hi = K.USABLE_RANGE_NM
    bad = S.in_ranges(wl, K.WATER_WINDOWS_NM) | (wl < lo) | (wl > hi) | S.not_finite(wl)
    return bands.withColumn(out, F.coalesce(bad, F.lit(True)) | F.coalesce("sensor_bad", F.lit(False)))


def gradient(bands: DataFrame, out: str = "spacing") -> DataFrame:
    """Local spacing: central difference over neighbours by position, one-sided at the ends."""
    w = Window.partitionBy("sensor_id").orderBy("band")
    wl = F.col("wavelength_nm")
    left, right = F.lag(wl).over(w), F.lead(wl).over(w)
    spacing = F.when(left.isNull() & right.isNull(), F.lit(10.0)).when(left.isNull(), right - wl).when(
        right.isNull(), wl - left).otherwise((right - left) / 2.0)
    return bands.withColumn(out, F.abs(spacing))


def fwhm_from_tags(bands: DataFrame) -> DataFrame:
    """Use the tagged FWHM when every band of the sensor has one, else the local spacing."""
    all_tagged = F.min(F.col("fwhm_tag").isNotNull()).over(Window.partitionBy("sensor_id"))
    g = gradient(bands, "_spacing")
    return g.withColumn("fwhm_nm", F.when(all_tagged, F.col("fwhm_tag")).otherwise(F.col("_spacing"))).drop("_spacing")


def median_spacing(bands: DataFrame) -> DataFrame:
    """Median distance between neighbouring wavelengths of each sensor (1 for a single band)."""
    w = Window.partitionBy("sensor_id").orderBy("wavelength_nm")
    diff = bands.withColumn("_d", F.col("wavelength_nm") - F.lag("wavelength_nm").over(w))
    return diff.groupBy("sensor_id").agg(F.coalesce(F.percentile("_d", F.lit(0.5)), F.lit(1.0)).alias("median_spacing"))


def solar_irradiance(bands: DataFrame) -> DataFrame:
    """Band-averaged irradiance at 1 AU: black-body sun under a Gaussian response on a 1 nm grid."""
    k = K
    nm = F.explode(F.sequence(F.lit(250), F.lit(3999)))
    lam = F.col("nm") * 1e-9
    c1 = 2.0 * k.PLANCK * k.LIGHT_SPEED**2 * math.pi * (k.SUN_RADIUS_M / k.AU_M) ** 2 * 1e-6
    c2 = k.PLANCK * k.LIGHT_SPEED / (k.BOLTZMANN * k.SUN_TEMP_K)

    def planck(l: Column) -> Column:
        return c1 / F.pow(l, F.lit(5.0)) / F.expm1(c2 / l)

    sigma = F.col("fwhm_nm") / 2.3548
    # Each band becomes 3750 rows, which are summed where they arise.
    key = ("sensor_id", "band", "wavelength_nm", "fwhm_nm")
    grid = deal(bands.filter(F.col("fwhm_nm") > 0).select(*key).distinct()).withColumn("nm", nm)
    weight = F.exp(-0.5 * F.pow((F.col("nm") - F.col("wavelength_nm")) / sigma, F.lit(2.0)))
    wide = grid.groupBy(*key).agg(
        (F.sum(weight * planck(lam)) / F.sum(weight)).alias("esun"))
    low = F.greatest(F.lit(250.0), F.least(F.lit(3998.0), F.floor("wavelength_nm").cast("double")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("wavelength_nm") - low))
    point = (1 - t) * planck(low * 1e-9) + t * planck((low + 1) * 1e-9)
    narrow = bands.filter(F.col("fwhm_nm") <= 0).select(*key, point.alias("esun"))
    return wide.unionByName(narrow)


def _targets(targets: Sequence[float]) -> Column:
    rows = F.transform(S.doubles(targets), lambda w, i: F.struct(i.cast("int").alias("dst"), w.alias("dst_wl")))
    return F.explode(rows).alias("d")


def response_weights(
    bands: DataFrame, targets: Sequence[float], target_fwhm: float = K.CANONICAL_FWHM_NM,
    mode: str = "overlap", min_coverage: float = 0.25,
) -> DataFrame:
    """Response weights of every source band for every target band: (sensor, dst, band, weight, covered).

    ``overlap`` integrates source and target responses and needs a minimum coverage; ``point``
    samples the target response at the source wavelengths. Each source band explodes into the
    fixed target list; the only shuffle is that of the band rows by sensor.
    """
    s_dst = target_fwhm * SIGMA
    # Dealt by sensor before the explode, which the window and the join below then need not shuffle.
    w = Window.partitionBy("sensor_id", "dst")
    bands = deal(bands, "sensor_id")
    flat = bands.select("*", _targets(targets)).select("*", "d.dst", "d.dst_wl").drop("d")
    diff2 = F.pow(F.col("dst_wl") - F.col("wavelength_nm"), F.lit(2.0))
    if mode == "point":
        raw = F.exp(-0.5 * diff2 / (s_dst * s_dst))
        rows = flat.withColumn("_o", raw).withColumn("_t", F.sum("_o").over(w))
        covered = F.col("_t") > 1e-12
    else:
        var = s_dst * s_dst + F.pow(F.col("fwhm_nm") * SIGMA, F.lit(2.0))
        raw = F.when(F.col("bad"), 0.0).otherwise(F.exp(-0.5 * diff2 / var) / F.sqrt(2.0 * math.pi * var))
        rows = flat.withColumn("_o", raw).withColumn("_t", F.sum("_o").over(w))
        rows = rows.join(median_spacing(bands), "sensor_id")
        covered = F.col("_t") * F.col("median_spacing") >= min_coverage
    return rows.withColumn("covered", covered).select(
        "sensor_id", "dst", "dst_wl", "band", "wavelength_nm",
        F.when(F.col("covered"), F.col("_o") / F.col("_t")).otherwise(0.0).alias("weight"), "covered")


def brackets(bands: DataFrame, targets: Sequence[float]) -> DataFrame:
    """For each target the source bands around it and the clamped fraction (edges repeat)."""
    t = bands.groupBy("sensor_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("wavelength_nm").alias("wl"), F.col("band").alias("band")))).alias("src"))
    flat = t.select("sensor_id", "src", _targets(targets)).select("sensor_id", "src", "d.dst", "d.dst_wl")
    n = F.size("src")
    below = F.size(F.filter("src", lambda s: s.wl < F.col("dst_wl")))
    left = F.greatest(F.lit(0), F.least(below - 1, n - 2))
    lo, hi = F.get("src", left), F.get("src", left + 1)
    t = (F.col("dst_wl") - lo.wl) / F.greatest(hi.wl - lo.wl, F.lit(1e-12))
    half = K.CANONICAL_FWHM_NM_MEAN / 2
    first, last = F.get("src", F.lit(0)).wl, F.element_at("src", -1).wl
    near = F.array_min(F.transform("src", lambda s: F.abs(s.wl - F.col("dst_wl"))))
    return flat.filter(n >= 2).select(
        "sensor_id", "dst", "dst_wl", lo.band.alias("lo_band"), hi.band.alias("hi_band"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("t"),
        ((first - half <= F.col("dst_wl")) & (last + half >= F.col("dst_wl"))).alias("covered"),
        near.alias("nearest_nm"))


def nearest_band(bands: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Closest band per sensor and target wavelength; the lowest band wins a tie.

    Bands are dealt by sensor before they are blown up, so a task sorts only its own sensors' rows.
    """
    flat = deal(bands.select("sensor_id", "band", "wavelength_nm"), "sensor_id").select("*", F.explode(S.doubles(targets)).alias("nm"))
    rank = F.struct(F.abs(F.col("wavelength_nm") - F.col("nm")), F.col("band"))
    return flat.groupBy("sensor_id", "nm").agg(F.min_by("band", rank).alias("band"))


def merge_band_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Concatenate two detectors: linear 16-bit scale, wavelength 0 last and bad, sorted by wavelength.

    Inputs carry ``sensor_id, band, wavelength_nm, fwhm_nm, lo, hi``.
    """
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    used = F.col("wavelength_nm") > 0
    w = Window.partitionBy("sensor_id").orderBy(
        F.when(used, F.col("wavelength_nm")).otherwise(float("inf")), "_part", "band")
    return both.select(
        "sensor_id", (F.row_number().over(w) - 1).cast("int").alias("position"),
        F.col("_part").alias("detector"), "band", "wavelength_nm", "fwhm_nm",
        ((F.col("hi") - F.col("lo")) / 65535.0).alias("gain"), F.col("lo").alias("offset"), (~used).alias("sensor_bad"))


def reorder(spectrum: Column, order: Column) -> Column:
    """Spectrum values in the order of an index array."""
    return F.transform(order, lambda i: F.get(spectrum, i))


def remove_bands(bands: DataFrame, removed: DataFrame) -> DataFrame:
    """Band table minus removed bands."""
    return bands.join(removed, ["sensor_id", "band"], "left_anti")


def check_wavelengths(bands: DataFrame, expected: Sequence[float], tolerance: float = 0.05) -> DataFrame:
    """Bands whose wavelength is missing or off the expected grid: (sensor, band, issue)."""
    grid = bands.select("sensor_id").distinct().select(
        "sensor_id", F.explode(F.transform(S.doubles(expected), lambda w, i: F.struct(
            i.cast("int").alias("band"), w.alias("want")))).alias("g")).select("sensor_id", "g.band", "g.want")
    seen = bands.select("sensor_id", "band", F.col("wavelength_nm").alias("got"))
    both = grid.join(seen, ["sensor_id", "band"], "full_outer")
    issue = (
        F.when(F.col("want").isNull(), "unexpected")
        .when(F.col("got").isNull(), "missing")
        .when(F.abs(F.col("got") - F.col("want")) > tolerance, "off_grid")
    )
    return both.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select("sensor_id", "band", "issue")


def scene_info(scenes: DataFrame, bands: DataFrame) -> DataFrame:
    """Band counts and wavelength range next to each scene's size, day and sun angle."""
    b = bands.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_bands"), F.count_if("bad").alias("n_bad"),
        F.round(F.min("wavelength_nm"), 2).alias("wl_min"), F.round(F.max("wavelength_nm"), 2).alias("wl_max"))
    return scenes.join(b, "sensor_id")

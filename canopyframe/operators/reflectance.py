"""The scene chain: counts of a sensor to canonical, masked, optionally scaled reflectance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import spectral as S
from canopyframe.operators import resample as R
from canopyframe.operators import stats as ST


@dataclass
class Sensor:
    """Band table and calibration of the source; columns may vary by scene."""

    wavelengths: Sequence[float]
    fwhm: Sequence[float]
    bad: Sequence[bool]
    gain: Column | Sequence[float] | float = 1.0
    offset: Column | Sequence[float] | float = 0.0
    nodata: float | None = K.NODATA
    # Radiance is turned into top-of-atmosphere reflectance; reflectance passes.
    quantity: Column | None = None
    esun: Column | Sequence[float] | None = None
    sun_elevation: Column | None = None
    day_of_year: Column | None = None


@dataclass
class Steps:
    """Which optional steps run, and with what."""

    dark_fraction: float | None = None
    targets: Sequence[float] = field(default_factory=K.canonical_wavelengths)
    smooth: bool = False
    clouds: bool = True
    outside: Column | None = None  # true where a pixel lies outside the area of interest
    stats: DataFrame | None = None  # robust scaling with ``band_stats`` rows
    keys: Sequence[str] = ("scene_id",)


def to_reflectance(px: DataFrame, sensor: Sensor, steps: Steps | None = None) -> DataFrame:
    """``px`` with ``spectrum`` in canonical reflectance, NULL where nodata or masked.

    Validity, gain and offset, top-of-atmosphere conversion, dark-object subtraction, clip, resampling,
    smoothing, clip again, cloud, shadow and area masks, scaling. Only the dark values and the scaling
    look beyond one pixel; a scene without them passes unchanged.
    """
    steps = steps or Steps()
    kept = list(px.columns)
    good = [not b for b in sensor.bad]
    px = px.withColumn("_bad", S.all_bands_nodata("spectrum", sensor.nodata, good))
    px = px.withColumn("spectrum", S.radiance("spectrum", sensor.gain, sensor.offset))
    if sensor.quantity is not None:
        px = px.withColumn("spectrum", S.unit_dispatch("spectrum", sensor.quantity, sensor.esun, sensor.sun_elevation, sensor.day_of_year))
    if steps.dark_fraction is not None:
        whole = px.withColumn("spectrum", F.when(~F.col("_bad"), F.col("spectrum")))
        px = ST.subtract_dark_values(px, ST.dark_values(whole, steps.keys, steps.dark_fraction), steps.keys)
    px = px.withColumn("spectrum", S.clip_reflectance("spectrum", F.col("_bad"))).drop("_bad")
    targets = list(steps.targets)
    px = R.resample(px, list(sensor.wavelengths), list(sensor.fwhm), list(sensor.bad), dst_wl=targets)
    if steps.smooth:
        px = R.savgol(px, len(targets)).withColumn("spectrum", S.clip("spectrum"))
    masks = []
    if steps.clouds:
        px = ST.cloud_shadow(px, targets)
        masks += [F.col("cloud"), F.col("shadow")]
    if steps.outside is not None:
        masks.append(steps.outside)
    if masks:
        px = px.withColumn("spectrum", F.when(~ST.combine_masks(*masks), F.col("spectrum")))
    if steps.stats is not None:
        px = ST.apply_scaling(px, steps.stats, [k for k in steps.keys if k in steps.stats.columns])
    return px.select(*kept)

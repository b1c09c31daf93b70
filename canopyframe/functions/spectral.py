"""Per-pixel spectrum expressions: radiometry, validity, clipping and scaling.

Spectra are ``ARRAY<DOUBLE|FLOAT>``; a NULL spectrum means nodata everywhere inside the engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyframe.constants import NODATA


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(values: Sequence[float]) -> Column:
    """A per-band coefficient list as one constant array (a few hundred values at most)."""
    return F.array(*[F.lit(float(v)) for v in values])


def not_finite(x: Column) -> Column:
    x = x.cast("double")
    return F.isnan(x) | (F.abs(x) == float("inf"))


# Three different meanings of "invalid"; each caller names the one it needs.
def any_band_missing(spectrum: Column | str, nodata: float = NODATA) -> Column:
    """True when any band is nodata, NaN or infinite (or the spectrum is NULL)."""
    bad = F.exists(col(spectrum), lambda x: x.isNull() | not_finite(x) | (x.cast("double") == nodata))
    return F.coalesce(bad, F.lit(True))


def all_bands_nodata(spectrum: Column | str, nodata: float | None, good: Sequence[bool]) -> Column:
    """True when every good band equals the sensor's nodata, or any good band is not finite."""
    pairs = F.zip_with(
        col(spectrum), F.array(*[F.lit(bool(g)) for g in good]),
        lambda x, g: F.struct(x.cast("double").alias("x"), g.alias("g")),
    )
    bad = F.exists(pairs, lambda p: p.g & not_finite(p.x))
    if nodata is not None:
        bad = bad | F.forall(pairs, lambda p: ~p.g | (p.x == float(nodata)))
    return F.coalesce(bad, F.lit(True))


def used_band_missing(spectrum: Column | str, used: Sequence[bool], nodata: float = NODATA) -> Column:
    """True when a band the resampler uses is nodata or not finite."""
    pairs = F.zip_with(
        col(spectrum), F.array(*[F.lit(bool(u)) for u in used]),
        lambda x, u: F.struct(x.cast("double").alias("x"), u.alias("u")),
    )
    return F.coalesce(F.exists(pairs, lambda p: p.u & (not_finite(p.x) | (p.x == nodata))), F.lit(True))


def null_if_missing(spectrum: Column | str, nodata: float = NODATA) -> Column:
    """The source's nodata rule turned into a NULL spectrum, once, on read."""
    return F.when(~any_band_missing(spectrum, nodata), col(spectrum))


def radiance(dn: Column | str, gain: Column | Sequence[float] | float, offset: Column | Sequence[float] | float = 0.0) -> Column:
    """``gain * DN + offset`` with scalar, listed or column coefficients."""
    dn = col(dn)
    if isinstance(gain, (int, float)) and isinstance(offset, (int, float)):
        return F.transform(dn, lambda x: x.cast("double") * float(gain) + float(offset))

    def as_array(c: Column | Sequence[float] | float) -> Column:
        if isinstance(c, Column):
            return c
        return F.array_repeat(F.lit(float(c)), F.size(dn)) if isinstance(c, (int, float)) else doubles(c)

    scaled = F.zip_with(dn, as_array(gain), lambda x, g: x.cast("double") * g)
    return F.zip_with(scaled, as_array(offset), lambda x, o: x + o)


def earth_sun_distance(day_of_year: Column) -> Column:
    """Astronomical units from the day of the year; NULL day means 1 AU."""
    angle = F.radians(0.9856 * (day_of_year.cast("double") - 4.0))
    return F.coalesce(1.0 - 0.01672 * F.cos(angle), F.lit(1.0))


def toa_reflectance(rad: Column | str, esun: Column | Sequence[float], sun_elevation: Column, day_of_year: Column) -> Column:
    """Top-of-atmosphere reflectance; a sun elevation outside (0, 90] is an error."""
    ok = (sun_elevation > 0) & (sun_elevation <= 90)
    elevation = F.when(ok, sun_elevation.cast("double")).otherwise(
        F.raise_error(F.concat(F.lit("sun elevation must be in (0, 90], got "), F.coalesce(sun_elevation.cast("string"), F.lit("NULL")))).cast("double")
    )
    d = earth_sun_distance(day_of_year)
    scale = F.lit(3.141592653589793) * d * d / F.sin(F.radians(elevation))
    e = esun if isinstance(esun, Column) else doubles(esun)
    return F.zip_with(col(rad), e, lambda x, s: x * scale / s)


def clip(spectrum: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.transform(col(spectrum), lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x.cast("double"))))


def clip_reflectance(spectrum: Column | str, flagged: Column | None = None) -> Column:
    """Clip to [0, 1]; any non-finite band or a flagged pixel makes the whole spectrum NULL."""
    bad = F.exists(col(spectrum), not_finite)
    if flagged is not None:
        bad = bad | F.coalesce(flagged, F.lit(False))
    return F.when(~bad, clip(spectrum))


def subtract_dark(spectrum: Column | str, dark: Column | Sequence[float]) -> Column:
    """Dark-object subtraction with a floor at 0."""
    d = dark if isinstance(dark, Column) else doubles(dark)
    return F.zip_with(col(spectrum), d, lambda x, v: F.greatest(F.lit(0.0), x.cast("double") - v))


def robust_scale(spectrum: Column | str, low: Column | Sequence[float], high: Column | Sequence[float], clipped: bool = True) -> Column:
    """``(x - low) / (high - low)`` per band; a span of at most 1e-6 counts as 1."""
    lo = low if isinstance(low, Column) else doubles(low)
    hi = high if isinstance(high, Column) else doubles(high)
    spans = F.zip_with(lo, hi, lambda a, b: F.struct(
        a.alias("lo"), F.when(b - a > 1e-6, b - a).otherwise(F.lit(1.0)).alias("span")))
    out = F.zip_with(col(spectrum), spans, lambda x, s: (x.cast("double") - s.lo) / s.span)
    return clip(out) if clipped else out


def scaled_counts(spectrum: Column | str, scale: float) -> Column:
    """Integer reflectance counts to [0, 1]."""
    return F.transform(col(spectrum), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") / scale)))


def unit_dispatch(rad: Column | str, quantity: Column, esun: Column | Sequence[float], sun_elevation: Column, day_of_year: Column) -> Column:
    """Reflectance products pass through; radiance products are converted."""
    return F.when(quantity == "radiance", toa_reflectance(rad, esun, sun_elevation, day_of_year)).otherwise(col(rad))


def in_ranges(wl: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """True when the wavelength lies in any range, ends included."""
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | wl.between(F.lit(lo), F.lit(hi))
    return hit

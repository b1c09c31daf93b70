"""Spectral index expressions on an array column, in four dialects.

A dialect decides how a wavelength becomes a value (nearest band or interpolation), what a
zero denominator yields, and how the red-edge position is bounded:

* ``strict``  nearest band, zero denominator gives NULL, no bound
* ``interp``  linear interpolation, 1e-6 added to denominators, position kept in [670, 780]
* ``zonal``   nearest band, 1e-6 added to denominators, no bound
* ``probe``   nearest band, zero denominator replaced by 1e-5, position kept in [692, 738]

All expressions stay inside Catalyst: band positions are resolved while the plan is built from
the sensor's wavelength list (at most a few hundred values), so a row only does array lookups.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.constants import canonical_wavelengths

EPS = 1e-6
DIALECTS = ("strict", "interp", "zonal", "probe")
BandValue = Callable[[float], Column]


def nearest_index(wavelengths: Sequence[float], nm: float) -> int:
    """Position of the closest band; the lowest position wins a tie."""
    return min(range(len(wavelengths)), key=lambda i: (abs(wavelengths[i] - nm), i))


def bracket(wavelengths: Sequence[float], nm: float) -> tuple[int, float]:
    """Left neighbour and fraction towards the right one for interpolation at ``nm``."""
    left = min(max(bisect_left(wavelengths, nm) - 1, 0), len(wavelengths) - 2)
    span = wavelengths[left + 1] - wavelengths[left]
    return left, (nm - wavelengths[left]) / span


def nearest_value(spectrum: Column, wavelengths: Sequence[float]) -> BandValue:
    return lambda nm: F.get(spectrum, F.lit(nearest_index(wavelengths, nm))).cast("double")


def interpolated_value(spectrum: Column, wavelengths: Sequence[float]) -> BandValue:
    """``band_at``: value at any wavelength by linear interpolation."""

    def at(nm: float) -> Column:
        i, t = bracket(wavelengths, nm)
        a, b = (F.get(spectrum, F.lit(j)).cast("double") for j in (i, i + 1))
        return F.lit(1 - t) * a + F.lit(t) * b

    return at


def band_reader(spectrum: Column | str, wavelengths: Sequence[float] | None, dialect: str) -> BandValue:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; choose from {DIALECTS}")
    col = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    wl = wavelengths or canonical_wavelengths()
    return interpolated_value(col, wl) if dialect == "interp" else nearest_value(col, wl)


def ratio(num: Column, den: Column, dialect: str) -> Column:
    """``num / den`` under the dialect's rule for a zero denominator."""
    if dialect == "strict":
        return F.try_divide(num, den)
    if dialect == "probe":
        return num / F.when(den == 0, F.lit(1e-5)).otherwise(den)
    return F.try_divide(num, den + EPS)


def normalised_difference(a: Column, b: Column, dialect: str = "strict") -> Column:
    return ratio(a - b, a + b, dialect)


def ndvi(r: BandValue, dialect: str = "strict") -> Column:
    return normalised_difference(r(840 if dialect == "probe" else 800), r(670), dialect)


def ndre(r: BandValue, dialect: str = "strict") -> Column:
    return normalised_difference(r(790), r(720), dialect)


def pri(r: BandValue, dialect: str = "strict") -> Column:
    return normalised_difference(r(531), r(570), dialect)


def cci(r: BandValue, dialect: str = "strict") -> Column:
    return normalised_difference(r(531), r(645), dialect)


def ndwi(r: BandValue, dialect: str = "strict") -> Column:
    return normalised_difference(r(860), r(1240), dialect)


def red_edge_position(r: BandValue, dialect: str = "strict") -> Column:
    """Four-point linear red-edge position in nm."""
    rise = r(740) - r(700)
    lift = (r(670) + r(780)) / 2.0 - r(700)
    if dialect == "probe":
        bounded = F.greatest(F.lit(692.0), F.least(F.lit(738.0), 700.0 + 40.0 * F.try_divide(lift, rise)))
        return F.when(F.abs(rise) < 1e-5, F.lit(715.0)).otherwise(bounded)
    den = rise if dialect == "strict" else rise + EPS
    rep = 700.0 + F.try_divide(40.0 * lift, den)
    return F.least(F.lit(780.0), F.greatest(F.lit(670.0), rep)) if dialect == "interp" else rep


def mcari(r: BandValue, dialect: str = "strict") -> Column:
    depth = (r(700) - r(670)) - 0.2 * (r(700) - r(550))
    return depth * ratio(r(700), r(670), dialect)


def ci_red_edge(r: BandValue, dialect: str = "zonal") -> Column:
    return ratio(r(780), r(710), dialect) - 1.0


# Named index builders; extend with ``register_index`` (a Column builder, so it stays in Catalyst).
INDEX_BUILDERS: dict[str, Callable[[BandValue, str], Column]] = {
    "ndvi": ndvi, "ndre": ndre, "rep": red_edge_position, "pri": pri,
    "cci": cci, "mcari": mcari, "ndwi": ndwi, "ci_re": ci_red_edge,
}
# Layer names written with each index.
INDEX_FORMULAS = {
    "ndvi": "NDVI (R800-R670)/(R800+R670)",
    "ndre": "NDRE (R790-R720)/(R790+R720)",
    "rep": "Red-edge position, nm (linear four-point)",
    "pri": "PRI (R531-R570)/(R531+R570)",
    "cci": "CCI (R531-R645)/(R531+R645)",
    "mcari": "MCARI [(R700-R670)-0.2(R700-R550)](R700/R670)",
    "ndwi": "NDWI Gao (R860-R1240)/(R860+R1240)",
}
BUNDLE = tuple(INDEX_FORMULAS)


def register_index(name: str, builder: Callable[[BandValue, str], Column]) -> None:
    """Add a named index: ``builder(band_value, dialect) -> Column``."""
    if name in INDEX_BUILDERS:
        raise ValueError(f"index {name!r} exists")
    INDEX_BUILDERS[name] = builder


def with_indices(
    px: DataFrame,
    names: Sequence[str] = BUNDLE,
    dialect: str = "strict",
    wavelengths: Sequence[float] | None = None,
    spectrum: str = "spectrum",
) -> DataFrame:
    """Append the named indices; a NULL spectrum gives NULL indices. One projection, no shuffle."""
    unknown = [n for n in names if n not in INDEX_BUILDERS]
    if unknown:
        raise ValueError(f"unknown indices {unknown}; available: {sorted(INDEX_BUILDERS)}")
    r = band_reader(spectrum, wavelengths, dialect)
    digits = {"rep": 1}
    cols = {}
    for n in names:
        c = INDEX_BUILDERS[n](r, dialect)
        cols[n] = F.round(c, digits.get(n, 3)) if dialect == "probe" else c
    return px.withColumns(cols)


def zone_index_columns(r: BandValue) -> dict[str, Column]:
    """The four indices that decide a zone's dominant indicator, from band means or medians."""
    return {
        "reip": red_edge_position(r, "zonal"),
        "pri": pri(r, "zonal"),
        "ci_re": ci_red_edge(r, "zonal"),
        "ndwi": ndwi(r, "zonal"),
    }


ZONE_BANDS_NM = (531, 570, 670, 700, 710, 740, 780, 860, 1240)

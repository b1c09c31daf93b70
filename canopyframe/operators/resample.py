"""Spectral resampling of pixel spectra with a weight matrix.

Two physical forms of the same operator: ``apply_matrix`` multiplies Arrow batches with NumPy
(no shuffle, linear in pixels; the path for 200-band cubes) and ``apply_weights`` joins exploded
values with the weight table (plain SQL, used to check the first).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyframe import constants as K
from canopyframe.operators import bands as BD
from canopyframe.session import broadcast_if_small


def apply_matrix(px: DataFrame, matrix: np.ndarray, spectrum: str = "spectrum", out: str = "spectrum") -> DataFrame:
    """``out = matrix @ spectrum`` for every row, in place of a column of that name; NULL stays NULL. Narrow: one Arrow pass."""
    keep = [f for f in px.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in keep]
    weights = np.ascontiguousarray(matrix.T, dtype=np.float64)
    n_src, n_dst = weights.shape

    def run(batches):
        for batch in batches:
            arr = batch.column(batch.schema.get_field_index(spectrum))
            live = np.asarray(arr.is_valid())
            sizes = np.asarray(arr.value_lengths().fill_null(n_src))
            if (sizes != n_src).any():
                at = int(np.flatnonzero(sizes != n_src)[0])
                row = {n: batch.column(batch.schema.get_field_index(n))[at].as_py() for n in names}
                raise ValueError(f"a spectrum of {sizes[at]} values where {n_src} are needed, in row {row}")
            flat = np.asarray(arr.drop_null().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            res = flat.reshape(-1, n_src) @ weights
            ends = np.concatenate([[0], np.cumsum(np.where(live, n_dst, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends, mask=np.append(~live, False)), pa.array(res.ravel()))
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, lists], names=[*names, out])

    return px.select(*names, *([spectrum] if spectrum not in names else [])).mapInArrow(run, schema)


def apply_weights(px: DataFrame, weights: DataFrame, keys: Sequence[str], spectrum: str = "spectrum") -> DataFrame:
    """Long form: (keys, dst, value) = sum over source bands of weight * value."""
    long = px.select(*keys, F.posexplode(spectrum).alias("band", "_v"))
    side = broadcast_if_small(weights.filter(F.col("weight") != 0).select("dst", "band", "weight"))
    return long.join(side, "band").groupBy(*keys, "dst").agg(F.sum(F.col("weight") * F.col("_v").cast("double")).alias("value"))


def interpolation_plan(wavelengths: Sequence[float], bad: Sequence[bool]) -> list[tuple[int, int, float]]:
    """For every band (left, right, fraction): itself if good, else its nearest good neighbours."""
    good = [i for i, b in enumerate(bad) if not b]
    if not good:
        raise ValueError("cannot interpolate: every band is flagged bad")
    plan = []
    for i in range(len(bad)):
        if not bad[i]:
            plan.append((i, i, 0.0))
            continue
        left = max((g for g in good if g < i), default=None)
        right = min((g for g in good if g > i), default=None)
        if left is None or right is None:
            edge = right if left is None else left
            plan.append((edge, edge, 0.0))
        else:
            t = (wavelengths[i] - wavelengths[left]) / (wavelengths[right] - wavelengths[left])
            plan.append((left, right, t))
    return plan


def plan_matrix(plan: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """An interpolation plan as a matrix."""
    m = np.zeros((len(plan), len(plan)))
    for row, (left, right, t) in enumerate(plan):
        m[row, left] += 1.0 - t
        m[row, right] += t
    return m


def interpolate_bands(px: DataFrame, wavelengths: Sequence[float], bad: Sequence[bool], spectrum: str = "spectrum") -> DataFrame:
    """Fill bad bands between their nearest good neighbours, inside Catalyst."""
    plan = interpolation_plan(wavelengths, bad)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t")) for a, b, t in plan])
    src = F.col(spectrum)
    filled = F.transform(steps, lambda p: (1.0 - p.t) * F.get(src, p.a).cast("double") + p.t * F.get(src, p.b).cast("double"))
    return px.withColumn(spectrum, F.when(src.isNotNull(), filled))


def savgol_matrix(bands: int, window: int = 7, order: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing as a banded matrix; the ends use the fit of the end window."""
    if bands < window:
        return np.eye(bands)
    half = window // 2
    x = np.arange(window, dtype=float)
    design = np.vander(x, order + 1, increasing=True)
    hat = design @ np.linalg.pinv(design)
    m = np.zeros((bands, bands))
    for i in range(bands):
        start = min(max(i - half, 0), bands - window)
        m[i, start : start + window] = hat[i - start]
    return m


def savgol(px: DataFrame, bands: int, window: int = 7, order: int = 2, spectrum: str = "spectrum") -> DataFrame:
    """Savitzky-Golay smoothing along the bands; spectra shorter than the window are unchanged."""
    return px if bands < window else apply_matrix(px, savgol_matrix(bands, window, order), spectrum)


def _band_table(spark: SparkSession, wl: Sequence[float], fwhm: Sequence[float], bad: Sequence[bool]) -> DataFrame:
    rows = [(0, i, float(w), float(f), bool(b)) for i, (w, f, b) in enumerate(zip(wl, fwhm, bad))]
    return spark.createDataFrame(rows, "sensor_id int, band int, wavelength_nm double, fwhm_nm double, bad boolean")


KEPT = 64
_matrices: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def weight_matrix(
    spark: SparkSession, wl: Sequence[float], fwhm: Sequence[float], bad: Sequence[bool], targets: Sequence[float],
    target_fwhm: float = K.CANONICAL_FWHM_NM, mode: str = "overlap",
) -> tuple[np.ndarray, np.ndarray]:
    """``bands.response_weights`` of one sensor as a dense matrix, with its covered flags (bands x targets rows at most).

    The last ``KEPT`` matrices are kept, as plans of one sensor are built again and again.
    """
    key = (tuple(map(float, wl)), tuple(map(float, fwhm)), tuple(map(bool, bad)), tuple(map(float, targets)), target_fwhm, mode)
    if key in _matrices:
        return tuple(a.copy() for a in _matrices[key])
    m, covered = np.zeros((len(targets), len(wl))), np.zeros(len(targets), bool)
    for r in BD.response_weights(_band_table(spark, wl, fwhm, bad), targets, target_fwhm, mode).collect():
        m[r.dst, r.band], covered[r.dst] = r.weight, r.covered
    _matrices[key] = m.copy(), covered.copy()
    while len(_matrices) > KEPT:
        _matrices.pop(next(iter(_matrices)))
    return m, covered


def _in_water(wl: np.ndarray) -> np.ndarray:
    hit = np.zeros(wl.shape, bool)
    for lo, hi in K.WATER_WINDOWS_NM:
        hit |= (wl >= lo) & (wl <= hi)
    return hit


def resample(
    px: DataFrame, src_wl: Sequence[float], src_fwhm: Sequence[float], src_bad: Sequence[bool] | None = None,
    dst_wl: Sequence[float] | None = None, dst_fwhm: float = K.CANONICAL_FWHM_NM, spectrum: str = "spectrum",
) -> DataFrame:
    """Sensor spectra to the canonical grid: overlap weights, gap and water-window interpolation.

    A pixel is invalid (NULL) when a band with weight is nodata or not finite. Weights and
    interpolation are folded into one matrix while the plan is built, so a row sees one product.
    """
    from canopyframe.functions.spectral import used_band_missing

    dst = np.asarray(dst_wl if dst_wl is not None else K.canonical_wavelengths(), float)
    src = np.asarray(src_wl, float)
    lo, hi = K.USABLE_RANGE_NM
    bad = _in_water(src) | (src < lo) | (src > hi) | ~np.isfinite(src)
    if src_bad is not None:
        bad |= np.asarray(src_bad, bool)
    weights, covered = weight_matrix(px.sparkSession, src, src_fwhm, bad, dst, dst_fwhm)
    fill = ~covered | _in_water(dst)
    weights[fill] = 0.0
    matrix = plan_matrix(interpolation_plan(list(dst), list(fill))) @ weights
    used = weights.any(axis=0)
    clean = F.when(
        ~used_band_missing(spectrum, list(used)),
        F.zip_with(spectrum, F.array(*[F.lit(bool(u)) for u in used]), lambda x, u: F.when(u, x.cast("double")).otherwise(0.0)),
    )
    return apply_matrix(px.withColumn(spectrum, clean), matrix, spectrum)


def resample_canonical(
    px: DataFrame, src_wl: Sequence[float], method: str = "linear", fill: str = "edge",
    dst_wl: Sequence[float] | None = None, spectrum: str = "spectrum",
) -> tuple[DataFrame, list[bool]]:
    """Resampling by ``bands.brackets`` (linear) or point responses, as one matrix; returns pixels and coverage.

    With point responses, targets far from every source band are bridged linearly. Targets beyond the
    source's range take the nearest covered target's value, or zero.
    """
    if method not in ("linear", "gaussian") or fill not in ("edge", "zero"):
        raise ValueError(f"method is linear or gaussian and fill edge or zero, not {method!r} and {fill!r}")
    targets = [float(w) for w in (dst_wl if dst_wl is not None else K.canonical_wavelengths())]
    bands = len(src_wl)
    table = _band_table(px.sparkSession, src_wl, [1.0] * bands, [False] * bands)
    rows = sorted(BD.brackets(table, targets).collect(), key=lambda r: r.dst)
    bridge = np.zeros((len(targets), bands))
    for r in rows:
        bridge[r.dst, r.lo_band] += 1.0 - r.t
        bridge[r.dst, r.hi_band] += r.t
    covered = [bool(r.covered) for r in rows]
    matrix = bridge
    if method == "gaussian":
        matrix = weight_matrix(px.sparkSession, src_wl, [1.0] * bands, [False] * bands, targets, K.CANONICAL_FWHM_NM_MEAN, "point")[0]
        for r in rows:
            if r.covered and r.nearest_nm > K.CANONICAL_FWHM_NM_MEAN:
                matrix[r.dst] = bridge[r.dst]
    known = [i for i, c in enumerate(covered) if c]
    if fill == "zero":
        matrix[[i for i, c in enumerate(covered) if not c]] = 0.0
    elif known:
        matrix = matrix[np.clip(np.arange(len(targets)), known[0], known[-1])]
    return apply_matrix(px, matrix, spectrum), covered

"""Masks, robust statistics and proxy labels over pixel spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import bandmath, spectral
from canopyframe.operators.ordered import smallest
from canopyframe.operators.quantiles import exact_percentiles
from canopyframe.session import broadcast_if_small


def cloud_shadow(
    px: DataFrame, wavelengths: Sequence[float] | None = None, cloud_blue: float = 0.25, cloud_ndvi: float = 0.2,
    shadow_nir: float = 0.04, shadow_swir: float = 0.03,
) -> DataFrame:
    """Heuristic ``cloud`` and ``shadow`` flags; an undefined NDVI counts as 0. NULL stays NULL."""
    r = bandmath.band_reader("spectrum", wavelengths, "strict")
    blue, red, nir, swir = r(470), r(660), r(860), r(1650)
    flat = F.coalesce(F.nanvl(bandmath.normalised_difference(nir, red), F.lit(0.0)), F.lit(0.0))
    cloud = (blue > cloud_blue) & (flat < cloud_ndvi)
    shadow = (nir < shadow_nir) & (swir < shadow_swir) & (nir >= 0) & ~cloud
    return px.withColumns({"cloud": cloud, "shadow": shadow})


def combine_masks(*masks: Column) -> Column:
    """Union of masks; an unknown mask does not flag a pixel."""
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(m, F.lit(False))
    return out


def vegetation_mask(px: DataFrame, classes: Sequence[int], ndvi: Column, ndvi_min: float | None = None, label: str = "label") -> DataFrame:
    """Labelled vegetation classes, plus unlabelled (class 0) pixels of enough NDVI."""
    hit = F.col(label).isin(*classes)
    if ndvi_min is not None:
        hit = hit | (F.coalesce(ndvi >= ndvi_min, F.lit(False)) & (F.col(label) == 0))
    return px.withColumn("vegetation", F.coalesce(hit, F.lit(False)))


def valid_pixels(px: DataFrame, nodata: float = K.NODATA) -> DataFrame:
    """Pixels finite and not nodata in all bands."""
    return px.filter(~spectral.any_band_missing("spectrum", nodata))


def long_bands(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, band, v): one row per pixel and band of the non-NULL spectra."""
    return px.filter(F.col("spectrum").isNotNull()).select(*keys, F.posexplode("spectrum").alias("band", "_v")).select(
        *keys, "band", F.col("_v").cast("double").alias("v"))


def picked_bands(px: DataFrame, keys: Sequence[str], bands: Sequence[int]) -> DataFrame:
    """(keys, band, v) of a few bands only: they are picked before the spectrum is unpivoted."""
    cells = F.array(*[F.struct(F.lit(int(b)).alias("band"), F.get("spectrum", F.lit(int(b))).cast("double").alias("v")) for b in sorted(bands)])
    return px.filter(F.col("spectrum").isNotNull()).select(*keys, F.explode(cells).alias("_p")).select(*keys, "_p.band", "_p.v")


def band_stats(px: DataFrame, fractions: Sequence[float] = (0.02, 0.98), keys: Sequence[str] = ()) -> DataFrame:
    """Low and high percentile per band over the valid pixels, with the pixel count."""
    out = exact_percentiles(long_bands(valid_pixels(px), keys), [*keys, "band"], "v", list(fractions))
    return out.withColumnsRenamed({"q0": "low", "q1": "high", "n": "n_pixels"})


def collect_stats(stats: DataFrame, bands: int) -> tuple[list[float], list[float]]:
    """Low and high lists of one sensor for use as plan constants (one row per band)."""
    rows = sorted(stats.select("band", "low", "high").limit(bands + 1).collect(), key=lambda r: r.band)
    if len(rows) != bands:
        raise ValueError("no valid pixels to compute statistics from" if not rows else f"stats have {len(rows)} bands, expected {bands}")
    return [r.low for r in rows], [r.high for r in rows]


def stats_arrays(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Band statistics as arrays in band order (a few hundred values per key)."""
    g = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "low", "high"))).alias("_s"))
    return g.select(*keys, F.col("_s.low").alias("low"), F.col("_s.high").alias("high"))


def apply_scaling(px: DataFrame, stats: DataFrame, keys: Sequence[str] = (), clip: bool = True) -> DataFrame:
    """Robust scaling with per-key statistics; pixels whose key has none stay as they are."""
    ks = list(keys) or ["_all"]
    one = px if keys else px.withColumn("_all", F.lit(0))
    arrays = broadcast_if_small(stats_arrays(stats if keys else stats.withColumn("_all", F.lit(0)), ks), 20_000)
    j = one.join(arrays.withColumnsRenamed({"low": "_low", "high": "_high"}), ks, "left")
    scaled = spectral.robust_scale("spectrum", F.col("_low"), F.col("_high"), clip)
    return j.withColumn("spectrum", F.when(F.col("_low").isNull(), F.col("spectrum")).otherwise(scaled)).select(*px.columns)


def subtract_dark_values(px: DataFrame, dark: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Dark-object subtraction with the rows of ``dark_values``; keys without any are left unchanged."""
    rows = dark.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "dark")))["dark"].alias("_dark"))
    j = px.join(broadcast_if_small(rows, 20_000), list(keys), "left")
    lower = spectral.subtract_dark("spectrum", F.col("_dark"))
    return j.withColumn("spectrum", F.when(F.col("_dark").isNull(), F.col("spectrum")).otherwise(lower)).select(*px.columns)


def dark_values(px: DataFrame, keys: Sequence[str] = ("scene_id",), fraction: float = 0.005) -> DataFrame:
    """Per-band dark-object value; scenes without valid pixels yield no row."""
    return exact_percentiles(long_bands(valid_pixels(px), keys), [*keys, "band"], "v", [fraction]).withColumnRenamed("q0", "dark").drop("n")


def hash_rank(seed: int, key: Sequence[str]) -> Column:
    """A draw below 2 ** 60 from the key that any engine with MD5 repeats; NULL counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cap_sample(px: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) chosen by a hash of the key, without replacement."""
    return smallest(px, n, hash_rank(seed, key), list(key))


def scene_summary(px: DataFrame, block: int = 256) -> DataFrame:
    """Size, block count and valid fraction per scene."""
    g = px.groupBy("scene_id").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"),
        F.count_if(F.col("spectrum").isNotNull()).alias("n_valid"))
    up = lambda c: F.ceil(F.col(c) / F.lit(block))
    return g.select("scene_id", "height", "width", (up("height") * up("width")).alias("n_blocks"), "n_valid",
                    (F.col("n_valid") / (F.col("height") * F.col("width"))).alias("valid_fraction"))


def mean_spectrum(px: DataFrame, region: Sequence[str]) -> DataFrame:
    """Mean value per region and band; missing values are skipped."""
    return long_bands(px, region).groupBy(*region, "band").agg(F.avg("v").alias("mean"))


# Default thresholds and weights of the proxy-label rule.
PROXY = {
    "ndvi_min": 0.4, "baseline": 0.5, "visible_drop": 0.15, "min_score": 1.5,
    "votes": {
        "rep_shift_nm": (3.0, 8.0, 1.0), "ndre_drop": (0.03, 0.08, 1.0),
        "pri_drop": (0.02, 0.05, 0.5), "cci_drop": (0.03, 0.08, 0.5),
    },
    "onset": {0: 30.0, 1: 16.0, 2: 4.0, 3: 0.0},
}
DEFICIT_OF = {"rep_shift_nm": "rep", "ndre_drop": "ndre", "pri_drop": "pri", "cci_drop": "cci", "ndvi_drop": "ndvi"}


def index_baselines(px: DataFrame, keys: Sequence[str] = ("scene_id",), fraction: float = 0.5) -> DataFrame:
    """Percentile of every label index over the vegetation pixels of each key.

    ``px`` carries the index columns and ``vegetation``; the indices are unpivoted so that all
    five share one pass and one small shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("name"), F.col(i).alias("v")) for i in DEFICIT_OF.values()])
    rows = px.filter("vegetation").select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.name", "p.v")
    q = exact_percentiles(rows, [*keys, "name"], "v", [fraction])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == i, F.col("q0"))).alias(f"base_{i}") for i in DEFICIT_OF.values()])


def deficits(px: DataFrame, baselines: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Drop of each index below its baseline (0 baseline where a key has no vegetation)."""
    j = px.join(broadcast_if_small(baselines), list(keys), "left")
    cols = {d: F.coalesce(f"base_{i}", F.lit(0.0)) - F.col(i) for d, i in DEFICIT_OF.items()}
    return j.withColumns(cols).drop(*[f"base_{i}" for i in DEFICIT_OF.values()])


def vote_labels(px: DataFrame, cfg: dict = PROXY) -> DataFrame:
    """Class, confidence and nominal onset from deficits; NULL class outside vegetation.

    ``px`` carries ``valid``, ``vegetation`` and the deficit columns.
    """
    votes = cfg["votes"]
    total = sum(w for _, _, w in votes.values())

    def score(which: int) -> Column:
        out = F.lit(0.0)
        for name, rule in votes.items():
            out = out + F.when(F.col(name) >= rule[which], rule[2]).otherwise(0.0)
        return out

    early, high = score(0), score(1)
    visible = F.coalesce(F.col("ndvi_drop") >= cfg["visible_drop"], F.lit(False))
    cls = (
        F.when(visible, 3).when(high >= cfg["min_score"], 2).when(early >= cfg["min_score"], 1).otherwise(0)
    )
    agree = F.when(visible, F.lit(total)).when(high >= cfg["min_score"], high).when(
        early >= cfg["min_score"], early).otherwise(total - early)
    keep = F.col("vegetation") | (F.col("valid") & visible)
    onset = F.lit(30.0)
    for k, v in cfg["onset"].items():
        onset = F.when(cls == k, v).otherwise(onset)
    return px.withColumns({
        "cls": F.when(keep, cls), "confidence": F.when(keep, agree / total).otherwise(0.0),
        "onset": F.when(keep, onset).otherwise(30.0)})


def proxy_labels(
    px: DataFrame, wavelengths: Sequence[float] | None = None, dialect: str = "interp",
    keys: Sequence[str] = ("scene_id",), cfg: dict = PROXY, smooth_sigma: float = 1.0, block: int = 256,
) -> DataFrame:
    """Stress labels per pixel from indices against the scene's own vegetation baseline.

    With ``smooth_sigma`` above 0 the index maps are smoothed first, all in one halo-block shuffle.
    """
    ix = bandmath.with_indices(px, tuple(DEFICIT_OF.values()), dialect, wavelengths)
    ix = ix.withColumn("valid", F.col("spectrum").isNotNull())
    ix = ix.withColumn("vegetation", F.col("valid") & F.coalesce(F.col("ndvi") >= cfg["ndvi_min"], F.lit(False)))
    if smooth_sigma > 0:
        from canopyframe.operators.blocks import smooth
        from canopyframe.operators.grid import scene_sizes

        names = list(DEFICIT_OF.values())
        smoothed = smooth(ix.select("scene_id", "row", "col", *names), names, scene_sizes(px), smooth_sigma, block)
        ix = ix.drop(*names).join(smoothed, ["scene_id", "row", "col"])
    return vote_labels(deficits(ix, index_baselines(ix, keys, cfg["baseline"]), keys), cfg)

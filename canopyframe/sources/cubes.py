"""Cube tables: the three physical layouts, pruned reads, checked writes.

* ``pixels``      one row per pixel with ``spectrum``; partitioned by scene and block row
* ``bands_long``  one row per pixel and band; partitioned by band, for jobs that need few bands
* ``tiles64``     one row per overlapping window with its pixels, for model scoring
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyframe import constants as K
from canopyframe.functions import bandmath, spectral
from canopyframe.operators.bands import fwhm_from_tags

PIXEL_SCHEMA = T.StructType([
    T.StructField("scene_id", T.StringType()), T.StructField("block_r", T.IntegerType()), T.StructField("block_c", T.IntegerType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("spectrum", T.ArrayType(T.FloatType())),
])


def window_filter(px: DataFrame, row_off: int, col_off: int, h: int, w: int) -> DataFrame:
    """Keep one window; with block columns present the filter prunes blocks before rows."""
    inside = (F.col("row") >= row_off) & (F.col("row") < row_off + h) & (F.col("col") >= col_off) & (F.col("col") < col_off + w)
    if "block_r" in px.columns:
        b = K.BLOCK_SIZE
        inside = inside & F.col("block_r").between(row_off // b, (row_off + h - 1) // b) & F.col("block_c").between(col_off // b, (col_off + w - 1) // b)
    return px.filter(inside)


def band_filter(long: DataFrame, wavelengths: Sequence[float], nm: Sequence[float]) -> DataFrame:
    """Only the bands nearest to the wanted wavelengths (a partition filter on ``bands_long``)."""
    return long.filter(F.col("band").isin(sorted({bandmath.nearest_index(wavelengths, n) for n in nm})))


def read_pixels(spark: SparkSession, path: str, scene_id: str | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of a cube table, NULL spectrum for nodata, optionally one scene and window."""
    px = spark.read.schema(PIXEL_SCHEMA).parquet(path)
    if scene_id is not None:
        px = px.filter(F.col("scene_id") == scene_id)
    if window is not None:
        px = window_filter(px, *window)
    return px.withColumn("spectrum", spectral.null_if_missing("spectrum"))


def read_bands(spark: SparkSession, path: str, nm: Sequence[float], scene_id: str | None = None, wavelengths: Sequence[float] | None = None) -> DataFrame:
    """Diagnostic bands from the ``bands_long`` layout; the band list prunes partitions."""
    long = spark.read.parquet(path)
    if scene_id is not None:
        long = long.filter(F.col("scene_id") == scene_id)
    return band_filter(long, wavelengths or K.canonical_wavelengths(), nm)


def with_blocks(px: DataFrame, block: int = K.BLOCK_SIZE) -> DataFrame:
    return px.withColumns({"block_r": F.expr(f"row div {block}").cast("int"), "block_c": F.expr(f"col div {block}").cast("int")})


def write_cube(px: DataFrame, path: str, source: str, bands: int = K.N_BANDS, mode: str = "error") -> None:
    """Write the pixel layout, block by block; source and band count are checked on every row.

    Blocks (not scenes) are the shuffle key, so a scene that holds most pixels still spreads
    over all tasks. Rows are sorted by block inside a file, which gives row-group pruning.
    """
    if source not in K.VALID_SOURCES:
        raise ValueError(f"source must be one of {sorted(K.VALID_SOURCES)}, got {source!r}")
    wrong = F.concat(F.lit(f"expected {bands} bands, got "), F.size("spectrum").cast("string"))
    checked = F.when(F.col("spectrum").isNull() | (F.size("spectrum") == bands), F.col("spectrum")).otherwise(
        F.raise_error(wrong).cast("array<double>"))
    filled = F.coalesce(checked, F.array_repeat(F.lit(K.NODATA), bands)).cast("array<float>")
    out = with_blocks(px.withColumn("spectrum", filled)).select(*PIXEL_SCHEMA.names)
    (out.repartition("scene_id", "block_r", "block_c").sortWithinPartitions("scene_id", "block_r", "block_c", "row", "col")
     .write.mode(mode).partitionBy("scene_id").parquet(path))


def write_bands_long(px: DataFrame, path: str, mode: str = "error") -> None:
    """Write the band-partitioned layout; band and block spread the rows of a large scene."""
    long = with_blocks(px.filter("spectrum IS NOT NULL")).select(
        "scene_id", "block_r", "block_c", "row", "col", F.posexplode("spectrum").alias("band", "value"))
    long = long.withColumn("value", F.col("value").cast("float"))
    (long.repartition("band", "scene_id", "block_r").sortWithinPartitions("band", "scene_id", "row", "col")
     .write.mode(mode).partitionBy("band").parquet(path))


def load_labelled(raw: DataFrame, scale: float, spectrum: str = "spectrum") -> DataFrame:
    """Labelled pixels with counts scaled and clipped to [0, 1]; label columns pass through."""
    return raw.withColumn(spectrum, spectral.scaled_counts(spectrum, scale))


def bands_from_tags(tags: DataFrame) -> DataFrame:
    """Band table from per-band string tags; a band without wavelength is an error."""
    wl = F.element_at("tags", F.lit("wavelength_nm"))
    missing = F.concat(F.lit("band "), F.col("band").cast("string"), F.lit(" lacks a wavelength_nm tag"))
    bands = tags.select(
        "sensor_id", "band",
        F.when(wl.isNotNull(), wl.cast("double")).otherwise(F.raise_error(missing).cast("double")).alias("wavelength_nm"),
        F.try_element_at("tags", F.lit("fwhm_nm")).cast("double").alias("fwhm_tag"))
    return fwhm_from_tags(bands).select("sensor_id", "band", "wavelength_nm", "fwhm_nm")


def write_indices(ix: DataFrame, path: str, names: Sequence[str], nan_for_missing: bool = False, mode: str = "error") -> None:
    """Write index layers as FLOAT columns that carry their name and formula as metadata."""
    def layer(n: str) -> Column:
        c = F.col(n).cast("float")
        return F.coalesce(c, F.lit(float("nan")).cast("float")) if nan_for_missing else c

    out = ix.select("scene_id", "row", "col", *[layer(n).alias(n, metadata={"index": n, "formula": bandmath.INDEX_FORMULAS.get(n, n)}) for n in names])
    out.write.mode(mode).partitionBy("scene_id").parquet(path)


def read_windows(spark: SparkSession, *paths: str) -> DataFrame:
    """Pre-built labelled windows from several files, concatenated."""
    return spark.read.parquet(*paths)


def save_stats(stats: DataFrame, path: str, mode: str = "error") -> None:
    stats.write.mode(mode).json(path)


def load_stats(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    fields = [T.StructField(k, T.StringType()) for k in keys] + [
        T.StructField("band", T.IntegerType()), T.StructField("n_pixels", T.LongType()),
        T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    return spark.read.schema(T.StructType(fields)).json(path)

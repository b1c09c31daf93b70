"""Contract checks: every function returns violation rows ``(…, check, detail)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions.projection import is_utm
from canopyframe.functions.spectral import not_finite
from canopyframe.operators.bands import check_wavelengths


def _violations(df: DataFrame, key: str, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Evaluate all checks in one pass and emit one row per failed one."""
    rows = F.array(*[F.when(cond, F.struct(F.lit(name).alias("check"), detail.alias("detail"))) for name, cond, detail in checks])
    return df.select(key, F.explode(F.array_compact(rows)).alias("v")).select(key, "v.check", "v.detail")


def structure(scenes: DataFrame) -> DataFrame:
    """Band count, data type, nodata value, and a UTM reference system."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return _violations(scenes, "scene_id", [
        ("bands", F.col("bands") != K.N_BANDS, text("bands")),
        ("dtype", F.col("dtype") != "float32", text("dtype")),
        ("nodata", ~F.coalesce(F.abs(F.col("nodata") - K.NODATA) < 1e-6, F.lit(False)), text("nodata")),
        ("crs", F.col("epsg").isNull(), F.lit("no CRS")),
        ("utm", F.col("epsg").isNotNull() & ~is_utm(F.col("epsg")), text("epsg")),
    ])


def tags(scenes: DataFrame) -> DataFrame:
    """Contract version and source tag."""
    version = F.try_element_at("tags", F.lit("contract_version"))
    source = F.try_element_at("tags", F.lit("source"))
    none = lambda c: F.coalesce(c, F.lit("NULL"))
    return _violations(scenes, "scene_id", [
        ("contract_version", none(version) != K.CONTRACT_VERSION, none(version)),
        ("source", ~none(source).isin(*K.VALID_SOURCES), none(source)),
    ])


def wavelengths(bands: DataFrame, expected: Sequence[float], tolerance: float = 0.05) -> DataFrame:
    """Missing or off-grid wavelengths per scene, as counts."""
    w = check_wavelengths(bands.withColumnRenamed("scene_id", "sensor_id"), expected, tolerance)
    return w.groupBy(F.col("sensor_id").alias("scene_id"), F.concat(F.lit("wavelength_"), F.col("issue")).alias("check")).agg(
        F.count(F.lit(1)).cast("string").alias("detail"))


def values(px: DataFrame) -> DataFrame:
    """All nodata, NaN or infinite values, values outside [0, 1]; one aggregation over the values.

    ``px.spectrum`` is raw (nodata -1); decimate first for a sampled check.
    """
    v = px.select("scene_id", F.explode("spectrum").alias("_v")).withColumn("_v", F.col("_v").cast("double"))
    live = v.filter(F.isnan("_v") | (F.col("_v") != K.NODATA))
    fin = F.when(~not_finite(F.col("_v")), F.col("_v"))
    agg = live.groupBy("scene_id").agg(F.count_if(not_finite(F.col("_v"))).alias("bad"), F.min(fin).alias("lo"), F.max(fin).alias("hi"))
    allv = px.select("scene_id").distinct().join(agg, "scene_id", "left")
    return _violations(allv, "scene_id", [
        ("all_nodata", F.col("bad").isNull(), F.lit("sampled pixels are all nodata")),
        ("not_finite", F.col("bad") > 0, F.col("bad").cast("string")),
        ("range", (F.col("lo") < 0) | (F.col("hi") > 1), F.concat(F.lit("values outside [0, 1]"))),
    ])


def report(*parts: DataFrame) -> DataFrame:
    """Union of violation rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_violations(df: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Rows whose probabilities do not sum to 1 or whose onset leaves [0, 30]."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    off = F.abs(total - 1.0) > tolerance
    out = (F.col("onset") < 0) | (F.col("onset") > K.MAX_ONSET_DAYS)
    detail = F.when(off, "probabilities do not sum to 1").otherwise("onset outside [0, 30]")
    return df.filter(off | out).withColumn("detail", detail)


def zone_violations(zones: DataFrame) -> DataFrame:
    """Zone rows outside the contract's ranges and enumerations."""
    names = F.array(*[F.lit(n) for n in K.CLASS_NAMES])
    empty = lambda c: F.coalesce(F.length(F.col(c)) == 0, F.lit(True))
    return _violations(zones, "zone_id", [
        ("risk_class", ~F.coalesce(F.col("risk_class").between(0, 3), F.lit(False)), F.col("risk_class").cast("string")),
        ("risk_class_name", ~F.coalesce(F.array_contains(names, F.col("risk_class_name")), F.lit(False)), F.coalesce("risk_class_name", F.lit("NULL"))),
        ("risk_score", ~F.coalesce(F.col("risk_score").between(0, 1), F.lit(False)), F.lit("outside [0, 1]")),
        ("area_acres", ~F.coalesce(F.col("area_acres") >= 0, F.lit(False)), F.lit("negative")),
        ("days_to_onset", ~F.coalesce(F.col("days_to_onset").between(0, 30), F.lit(False)), F.lit("outside [0, 30]")),
        ("dominant_indicator", empty("dominant_indicator"), F.lit("empty")),
        ("recommended_action", empty("recommended_action"), F.lit("empty")),
    ])

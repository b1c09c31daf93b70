"""Blending of overlapping window predictions, overviews and re-chunking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stitch(preds: DataFrame, values: Sequence[str] = ("p0", "p1", "p2", "p3", "onset"), keys: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """Weighted mean per pixel, with ``covered``; NULL where no weight arrived.

    ``preds`` holds one row per (window, pixel) with ``weight`` and optionally ``valid``.
    A hash aggregation with map-side combine: memory is per pixel, never per scene.
    """
    w = F.col("weight") * (F.col("valid").cast("double") if "valid" in preds.columns else F.lit(1.0))
    total = F.sum(w)
    return preds.groupBy(*keys).agg(
        (total > 0).alias("covered"),
        *[F.try_divide(F.sum(w * F.col(v)), total).alias(v) for v in values])


def risk_layers(risk: DataFrame, nodata: float = -1.0) -> DataFrame:
    """The five risk layers with nodata filled in for the sink."""
    names = {"p0": "p_healthy", "p1": "p_early_stress", "p2": "p_high_blight_risk", "p3": "p_visible_disease", "onset": "days_to_onset"}
    return risk.select("scene_id", "row", "col", *[F.coalesce(F.col(k), F.lit(nodata)).alias(v) for k, v in names.items()])


def build_overviews(px: DataFrame, value: str, levels: int) -> DataFrame:
    """Average pyramid: level k halves level k-1; NULL pixels do not count."""
    level = px.select("scene_id", F.lit(0).alias("level"), "row", "col", F.col(value).alias("value"))
    out = None
    for k in range(1, levels + 1):
        level = level.groupBy("scene_id", F.expr("row div 2").cast("int").alias("row"), F.expr("col div 2").cast("int").alias("col")).agg(
            F.avg("value").alias("value")).select("scene_id", F.lit(k).alias("level"), "row", "col", "value")
        out = level if out is None else out.unionByName(level)
    return out


def rechunk(px: DataFrame, value: str, chunk: int = 256) -> DataFrame:
    """Pixels gathered into fixed-size chunks (at most chunk x chunk values per row)."""
    g = px.withColumns({"chunk_r": F.expr(f"row div {chunk}").cast("int"), "chunk_c": F.expr(f"col div {chunk}").cast("int")})
    return g.groupBy("scene_id", "chunk_r", "chunk_c").agg(
        F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("value")))).alias("cells"))

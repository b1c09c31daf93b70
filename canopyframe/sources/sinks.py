"""Sinks for zones, plans, probes and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.analytics import prescription

ZONE_PROPERTIES = ("zone_id", "risk_class", "risk_class_name", "risk_score", "area_acres", "days_to_onset", "dominant_indicator", "recommended_action")


def zone_features(zones: DataFrame, coordinates: str = "coordinates", keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """One GeoJSON feature text per zone."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col(coordinates).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*ZONE_PROPERTIES).alias("properties"))
    return zones.select(*keys, "zone_id", F.to_json(feature).alias("feature"))


def write_zones_geojson(zones: DataFrame, path: str, coordinates: str = "coordinates", mode: str = "error") -> None:
    """Newline-delimited GeoJSON features, partitioned by job; no job is gathered in one row."""
    zone_features(zones, coordinates).select("job_id", "feature").write.mode(mode).partitionBy("job_id").text(path)


def spray_plan(zones: DataFrame) -> DataFrame:
    """Columns of the spray plan; scores in percent with one decimal."""
    p = prescription(zones)
    one = lambda c: F.format_string("%.1f", F.round(c, 1))
    return p.select(
        "zone_id", "risk_class", "risk_class_name", one(F.col("risk_score") * 100).alias("risk_score_pct"), "area_acres",
        one(F.col("days_to_onset")).alias("days_to_onset"), "dominant_indicator", "recommended_action", "prescribed_compound", "vra_drone_dosage")


def spray_plan_csv(zones: DataFrame, path: str, mode: str = "error") -> None:
    spray_plan(zones).write.mode(mode).option("header", "true").option("escape", '"').option("quote", '"').csv(path)


def csv_line(cols: Sequence[str], quoted: Sequence[str]) -> Column:
    """One CSV line with quotes doubled inside the quoted columns."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if c in quoted else F.col(c).cast("string")
    return F.concat_ws(",", *[cell(c) for c in cols])


def probe_rows(probes: DataFrame, wavelengths: Sequence[float]) -> DataFrame:
    """One row per probe and band, bands numbered from 1."""
    wl = F.array(*[F.lit(float(w)) for w in wavelengths])
    return probes.select("probe_id", F.posexplode("spectrum").alias("_b", "reflectance")).select(
        "probe_id", (F.col("_b") + 1).alias("band_index"), F.get(wl, F.col("_b")).alias("wavelength_nm"), "reflectance")


def export_probes(probes: DataFrame, path: str, wavelengths: Sequence[float], fmt: str = "csv", mode: str = "error") -> None:
    """Per-band CSV rows or one nested JSON record per probe."""
    if fmt == "csv":
        probe_rows(probes, wavelengths).write.mode(mode).option("header", "true").csv(path)
    elif fmt == "json":
        probes.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_report(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Metrics as JSON; columns that start with an underscore are private and dropped."""
    metrics.select(*[c for c in metrics.columns if not c.startswith("_")]).write.mode(mode).json(path)

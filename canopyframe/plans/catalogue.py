"""All registered queries in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopyframe.plans import business, evaluation, geo, rasters, roundtrips, spectral, streams
from canopyframe.plans.registry import QUERIES, SQL, Tables

GROUPS = (spectral, rasters, evaluation, business, geo, streams, roundtrips)

__all__ = ["GROUPS", "QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return spectral.flagship(Tables(spark, folder))

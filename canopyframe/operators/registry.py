"""Scene and job registry: search, listing, state rules, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.session import cut

# Which job states allow which action.
ALLOWED = {
    "cancel": ("queued", "running"),
    "cancel_noop": ("cancelled",),
    "retry": ("failed", "cancelled"),
    "delete": ("succeeded", "failed", "cancelled"),
    "results": ("succeeded",),
}


def search_scenes(
    scenes: DataFrame, bbox: tuple[float, float, float, float], start: date | int, end: date | int,
    max_cloud: int | None = None, limit: int = 50, day: str = "day", order: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """Scenes whose footprint meets the box, inside the date range, below the cloud cover; first ``limit``."""
    west, south, east, north = bbox
    hit = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    out = scenes.filter(hit & F.col(day).between(start, end))
    if max_cloud is not None:
        out = out.filter(F.col("cloud_cover").between(0, max_cloud))
    return out.orderBy(*order).limit(limit)


def filter_jobs(jobs: DataFrame, status: str | None = None, scene_id: str | None = None, field_id: str | None = None) -> DataFrame:
    for name, value in (("status", status), ("scene_id", scene_id), ("field_id", field_id)):
        if value is not None:
            jobs = jobs.filter(F.col(name) == value)
    return jobs


def _page(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be in [1, 1000] and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def list_jobs(jobs: DataFrame, status: str | None = None, scene_id: str | None = None, field_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, equal dates by id descending."""
    return _page(filter_jobs(jobs, status, scene_id, field_id), [F.desc("created_on"), F.desc("job_id")], limit, offset)


def list_scenes(scenes: DataFrame, limit: int = 100, offset: int = 0, created: str = "day") -> DataFrame:
    """Newest first, equal dates by id ascending."""
    return _page(scenes, [F.desc(created), F.asc("scene_id")], limit, offset)


def allowed(jobs: DataFrame, action: str) -> DataFrame:
    """Adds ``allowed`` and ``noop`` for an action on every job."""
    noop = F.col("status").isin(*ALLOWED["cancel_noop"]) if action == "cancel" else F.lit(False)
    return jobs.withColumns({"allowed": F.col("status").isin(*ALLOWED[action]) | noop, "noop": noop})


def resolve_jobs(jobs: DataFrame, scenes: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with their scene and field, and the not-found errors of the others."""
    s = scenes.select("scene_id", F.col("name").alias("scene_name"))
    f = fields.select("field_id", F.col("name").alias("field_name"))
    j = jobs.join(s, "scene_id", "left").join(f, "field_id", "left")
    no_scene, no_field = F.col("scene_name").isNull(), F.col("field_name").isNull() & F.col("field_id").isNotNull()
    errors = j.filter(no_scene | no_field).select("job_id", F.when(no_scene, F.concat(F.lit("scene not found: "), "scene_id")).otherwise(
        F.concat(F.lit("field not found: "), "field_id")).alias("error"))
    return j.filter(~(no_scene | no_field)), errors


def job_counts(jobs: DataFrame, keys: Sequence[str] = ("status",)) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def register_scenes(inventory: DataFrame, registered_at: Column | None = None, acquired_at: Column | None = None) -> DataFrame:
    """Manifest rows for detected scenes (dir, sensor), with their time of acquisition where it is given."""
    when = registered_at if registered_at is not None else F.current_timestamp()
    rows = inventory.select("*", F.col("dir").alias("scene_dir"), F.element_at(F.split("dir", "/"), -1).alias("scene_id"), when.alias("registered_at"))
    if acquired_at is None:
        return rows.select("scene_dir", "scene_id", "sensor", "registered_at")
    return rows.select("scene_dir", "scene_id", "sensor", "registered_at", acquired_at.cast("timestamp").alias("acquired_at"))


CATALOGUE = "scene_dir string, scene_id string, sensor string, registered_at timestamp, acquired_at timestamp, content_hash string"


def _content(manifest: DataFrame) -> DataFrame:
    """A hash of what a manifest row says about its scene; the time of registration is no part of it."""
    told = F.to_json(F.struct("scene_dir", "scene_id", "sensor", F.unix_micros("acquired_at").alias("acquired_at")))
    return manifest.withColumn("content_hash", F.sha2(told, 256))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """All registrations; a catalogue that does not exist yet is empty."""
    try:
        return spark.read.schema(CATALOGUE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOGUE)


def append_scenes(manifest: DataFrame, path: str) -> int:
    """Insert the manifest rows whose scene and content the catalogue does not hold yet; returns their number.

    Insert-only, so a job that is run again (or was lost after its write) adds nothing twice. A scene whose
    content has changed gets a further row; ``current_scenes`` gives the last.
    """
    spark = manifest.sparkSession
    if "acquired_at" not in manifest.columns:
        manifest = manifest.withColumn("acquired_at", F.lit(None).cast("timestamp"))
    rows = _content(manifest).groupBy("scene_id", "content_hash").agg(*[F.min(c).alias(c) for c in ("scene_dir", "sensor", "registered_at", "acquired_at")])
    known = read_catalogue(spark, path).select("scene_id", "content_hash").distinct()
    # Materialised before the write, which changes what the anti-join would see.
    new = cut(rows.join(known, ["scene_id", "content_hash"], "left_anti").select("scene_dir", "scene_id", "sensor", "registered_at", "acquired_at", "content_hash"))
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def current_scenes(spark: SparkSession, path: str) -> DataFrame:
    """The last registration of every scene."""
    rows = read_catalogue(spark, path)
    last = F.max_by(F.struct("*"), F.struct("registered_at", "content_hash")).alias("r")
    return rows.groupBy("scene_id").agg(last).select("r.*")

"""Projections of the given tables onto the engine's data model, each with its SQL twin.

The Spark adapters take a ``Tables`` reader; the ``*_SQL`` texts are CTEs of the same content.
Every adapter covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.plans.registry import Tables

FX_WAVELENGTHS = [400.0 + 20.0 * i for i in range(64)]
FX_FWHM = 20.0
RASTER_COLS = 125
RASTER_ROWS = 400


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round as DOUBLE without negative zero, the way the checking SQL does."""
    return F.round(dbl(c), digits) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _grid(key: str = "vec_id") -> list[Column]:
    half = F.expr(f"{key} div 2")
    return [
        F.concat(F.lit("scn_"), (F.col(key) % 2).cast("string")).alias("scene_id"),
        F.expr(f"cast(({key} div 2) div 25 as int)").alias("row"),
        (half % 25).cast("int").alias("col"),
    ]


def pixels(t: Tables) -> DataFrame:
    """Canonical pixels: one row per pixel, NULL spectrum for nodata."""
    values = F.transform(
        "embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * x.cast("double") + 0.5))
    )
    return t("embeddings").select(
        *_grid(), F.when(F.col("vec_id") % 17 != 0, values).alias("spectrum"), "vec_id", "label"
    )


PX_SQL = """px AS (
  SELECT 'scn_' || (vec_id % 2) AS scene_id, CAST((vec_id // 2) // 25 AS INTEGER) AS "row",
         CAST((vec_id // 2) % 25 AS INTEGER) AS col, vec_id, label,
         CASE WHEN vec_id % 17 <> 0 THEN
           list_transform(embedding, lambda x: least(1.0, greatest(0.0, 2 * CAST(x AS DOUBLE) + 0.5)))
         END AS s
  FROM embeddings)"""


def faulty_pixels(t: Tables) -> DataFrame:
    """Pixels as a file would hold them: -1 for nodata, some NaN, infinite or -1 bands."""
    hit = lambda i: F.col("vec_id") % 64 == i

    def value(x: Column, i: Column) -> Column:
        v = 2 * x.cast("double") + 0.5
        return (
            F.when(F.col("vec_id") % 17 == 0, F.lit(-1.0))
            .when((F.col("vec_id") % 23 == 0) & hit(i), F.lit(float("nan")))
            .when((F.col("vec_id") % 29 == 0) & hit(i), F.lit(-1.0))
            .when((F.col("vec_id") % 31 == 0) & hit(i), F.lit(float("inf")))
            .otherwise(v)
        )

    return t("embeddings").select(*_grid(), F.transform("embedding", value).alias("spectrum"), "vec_id")


FAULTY_SQL = """faulty AS (
  SELECT 'scn_' || (vec_id % 2) AS scene_id, CAST((vec_id // 2) // 25 AS INTEGER) AS "row",
         CAST((vec_id // 2) % 25 AS INTEGER) AS col, vec_id,
         list_transform(embedding, lambda x, i:
           CASE WHEN vec_id % 17 = 0 THEN -1.0
                WHEN vec_id % 23 = 0 AND vec_id % 64 = i - 1 THEN CAST('nan' AS DOUBLE)
                WHEN vec_id % 29 = 0 AND vec_id % 64 = i - 1 THEN -1.0
                WHEN vec_id % 31 = 0 AND vec_id % 64 = i - 1 THEN CAST('inf' AS DOUBLE)
                ELSE 2 * CAST(x AS DOUBLE) + 0.5 END) AS s
  FROM embeddings)"""

# Long form of the canonical pixels, bands numbered from 0.
LONG_SQL = """long AS (
  SELECT scene_id, "row", col, vec_id, label, i - 1 AS band, 400.0 + 20.0 * (i - 1) AS wl, s[i] AS v
  FROM px, range(1, 65) AS g(i) WHERE s IS NOT NULL)"""


def sensor_bands(t: Tables) -> DataFrame:
    """Sensors with up to 64 bands each, one row of ``part`` per band."""
    return t("part").select(
        F.expr("p_partkey div 64").alias("sensor_id"),
        (F.col("p_partkey") % 64).cast("int").alias("band"),
        (400.0 + 31.0 * (F.col("p_partkey") % 64) + 0.25 * (F.col("p_size") % 10)).alias("wavelength_nm"),
        (8.0 + (F.col("p_size") % 20)).cast("double").alias("fwhm_nm"),
        (F.col("p_partkey") % 11 == 0).alias("sensor_bad"),
        "p_partkey", "p_size", "p_retailprice",
    )


SB_SQL = """sb AS (
  SELECT p_partkey // 64 AS sensor_id, CAST(p_partkey % 64 AS INTEGER) AS band,
         CAST(400.0 + 31.0 * (p_partkey % 64) + 0.25 * (p_size % 10) AS DOUBLE) AS wl,
         CAST(8.0 + (p_size % 20) AS DOUBLE) AS fwhm, p_partkey % 11 = 0 AS sensor_bad,
         p_partkey, p_size, p_retailprice
  FROM part)"""


def raster(t: Tables) -> DataFrame:
    """Scored pixels on a 125-column raster, scenes of 400 rows: class, p0..p3, onset, valid."""
    base = t("orders").select(
        F.expr(f"concat('r', (o_orderkey div {RASTER_COLS}) div {RASTER_ROWS})").alias("scene_id"),
        F.expr(f"cast((o_orderkey div {RASTER_COLS}) % {RASTER_ROWS} as int)").alias("row"),
        (F.col("o_orderkey") % RASTER_COLS).cast("int").alias("col"),
        F.col("o_orderkey").alias("k"),
    )
    cls = F.when(F.col("k") % 97 == 0, 2).otherwise(
        F.expr("((row div 8) * 3 + (col div 10) * 5) % 4")
    ).cast("int")
    cols = base.withColumn("cls", cls)
    return cols.select(
        "scene_id", "row", "col", "k", "cls",
        *[F.when(F.col("cls") == i, 0.85).otherwise(0.05).alias(f"p{i}") for i in range(4)],
        (F.col("k") % 31).cast("double").alias("onset"),
        (~((F.col("row") < 2) & (F.col("col") < 2))).alias("valid"),
    )


RASTER_SQL = """ra0 AS (
  SELECT 'r' || ((o_orderkey // 125) // 400) AS scene_id,
         CAST((o_orderkey // 125) % 400 AS INTEGER) AS "row",
         CAST(o_orderkey % 125 AS INTEGER) AS col, o_orderkey AS k FROM orders),
ra1 AS (
  SELECT *, CAST(CASE WHEN k % 97 = 0 THEN 2 ELSE (("row" // 8) * 3 + (col // 10) * 5) % 4 END AS INTEGER) AS cls
  FROM ra0),
ra AS (
  SELECT *, CASE WHEN cls = 0 THEN 0.85 ELSE 0.05 END AS p0, CASE WHEN cls = 1 THEN 0.85 ELSE 0.05 END AS p1,
         CASE WHEN cls = 2 THEN 0.85 ELSE 0.05 END AS p2, CASE WHEN cls = 3 THEN 0.85 ELSE 0.05 END AS p3,
         CAST(k % 31 AS DOUBLE) AS onset, NOT ("row" < 2 AND col < 2) AS valid FROM ra1)"""


def scored(t: Tables) -> DataFrame:
    """Per-pixel class scores: logits from the first embedding values, truth and onset."""
    z = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t("embeddings").select(
        *_grid(), "vec_id",
        F.array(*[10 * z(i) for i in range(4)]).alias("logits"),
        (30.0 * (z(4) + 1.0) / 2.0).alias("onset"),
        F.when(F.col("vec_id") % 19 != 0, F.col("label") % 4).cast("int").alias("truth"),
        F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label") % 4)
        .cast("int").alias("pred"),
        (F.col("label") * 3).cast("int").alias("day"),
    )


SCORED_SQL = """sc0 AS (
  SELECT 'scn_' || (vec_id % 2) AS scene_id, CAST((vec_id // 2) // 25 AS INTEGER) AS "row",
         CAST((vec_id // 2) % 25 AS INTEGER) AS col, vec_id,
         10 * CAST(embedding[1] AS DOUBLE) AS z0, 10 * CAST(embedding[2] AS DOUBLE) AS z1,
         10 * CAST(embedding[3] AS DOUBLE) AS z2, 10 * CAST(embedding[4] AS DOUBLE) AS z3,
         30.0 * (CAST(embedding[5] AS DOUBLE) + 1.0) / 2.0 AS onset,
         CASE WHEN vec_id % 19 <> 0 THEN label % 4 END AS truth,
         CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 4 ELSE label % 4 END AS pred, label * 3 AS day
  FROM embeddings),
sc AS (
  SELECT *, exp(z0) / (exp(z0) + exp(z1) + exp(z2) + exp(z3)) AS p0,
            exp(z1) / (exp(z0) + exp(z1) + exp(z2) + exp(z3)) AS p1,
            exp(z2) / (exp(z0) + exp(z1) + exp(z2) + exp(z3)) AS p2,
            exp(z3) / (exp(z0) + exp(z1) + exp(z2) + exp(z3)) AS p3 FROM sc0)"""


def zones(t: Tables) -> DataFrame:
    """One risk zone per supplier, in the zone contract's columns plus a 4-corner ring."""
    key = F.col("s_suppkey")
    x, y = F.col("s_nationkey") * 0.1, key % 100 * 0.01
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    # The same fixed names the contract uses, chosen by key.
    return t("supplier").select(
        F.concat(F.lit("zone-"), key.cast("string")).alias("zone_id"),
        key.alias("k"),
        F.concat(F.lit("job_"), (key % 3).cast("string")).alias("job_id"),
        (key % 4).cast("int").alias("risk_class"),
        F.element_at(F.array(*[F.lit(n) for n in ("healthy", "early_stress", "high_blight_risk", "visible_disease")]),
                     (key % 4 + 1).cast("int")).alias("risk_class_name"),
        (key % 100 / F.lit(100.0)).alias("risk_score"),
        (F.abs("s_acctbal") / 100.0).alias("area_acres"),
        (key % 31).cast("double").alias("days_to_onset"),
        F.element_at(F.array(*[F.lit(n) for n in ("red_edge_shift", "pri_decline", "chlorophyll_loss", "water_stress")]),
                     (F.expr("s_suppkey div 4") % 4 + 1).cast("int")).alias("dominant_indicator"),
        F.array(corner(0.0, 0.0), corner(0.004, 0.0), corner(0.004, 0.004), corner(0.0, 0.004), corner(0.0, 0.0))
        .alias("ring"),
    )


ZONES_SQL = """zn AS (
  SELECT 'zone-' || s_suppkey AS zone_id, s_suppkey AS k, 'job_' || (s_suppkey % 3) AS job_id,
         CAST(s_suppkey % 4 AS INTEGER) AS risk_class,
         (['healthy', 'early_stress', 'high_blight_risk', 'visible_disease'])[s_suppkey % 4 + 1] AS risk_class_name,
         (s_suppkey % 100) / 100.0::DOUBLE AS risk_score, abs(s_acctbal) / 100.0::DOUBLE AS area_acres,
         CAST(s_suppkey % 31 AS DOUBLE) AS days_to_onset,
         (['red_edge_shift', 'pri_decline', 'chlorophyll_loss', 'water_stress'])[(s_suppkey // 4) % 4 + 1] AS dominant_indicator,
         s_nationkey * 0.1::DOUBLE AS x0, (s_suppkey % 100) * 0.01::DOUBLE AS y0
  FROM supplier)"""


def fields(t: Tables) -> DataFrame:
    """One farm field per nation: centre, acres and a closed square boundary around the centre."""
    cx, cy = F.col("n_nationkey") * 0.1, F.col("n_nationkey") * 0.02
    corner = lambda dx, dy: F.array(cx + dx, cy + dy)
    return t("nation").select(
        F.concat(F.lit("field-"), F.col("n_nationkey").cast("string")).alias("field_id"),
        F.col("n_nationkey").cast("bigint").alias("fk"),
        F.col("n_name").alias("name"),
        cx.alias("cx"), cy.alias("cy"), F.lit(1000.0).alias("acres"),
        F.array(corner(-0.05, -0.05), corner(0.05, -0.05), corner(0.05, 0.05), corner(-0.05, 0.05),
                corner(-0.05, -0.05)).alias("boundary"),
    )


FIELDS_SQL = """fd AS (
  SELECT 'field-' || n_nationkey AS field_id, CAST(n_nationkey AS BIGINT) AS fk, n_name AS name,
         n_nationkey * 0.1::DOUBLE AS cx, n_nationkey * 0.02::DOUBLE AS cy, 1000.0::DOUBLE AS acres FROM nation)"""


def jobs(t: Tables) -> DataFrame:
    """Jobs from orders: status, scene, field, creation day number."""
    return t("orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("scene_id"),
        F.concat(F.lit("field-"), (F.col("o_custkey") % 30).cast("string")).alias("field_id"),
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("succeeded"))
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise(F.when(F.col("o_orderkey") % 7 == 0, "cancelled").otherwise("queued")).alias("status"),
        F.to_date("o_orderdate").alias("created_on"),
    )


JOBS_SQL = """jb AS (
  SELECT o_orderkey AS job_id, 's' || o_custkey AS scene_id, 'field-' || (o_custkey % 30) AS field_id,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END
              WHEN o_orderstatus = 'O' THEN 'running'
              ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'cancelled' ELSE 'queued' END END AS status,
         CAST(o_orderdate AS DATE) AS created_on FROM orders)"""


def scenes(t: Tables) -> DataFrame:
    """Scene catalogue from customers: footprint, day, cloud cover, grid and tags (some at fault)."""
    key = F.col("c_custkey")
    west, south = (key % 360 - 180).cast("double"), (F.expr("c_custkey div 3") % 170 - 85).cast("double")
    return t("customer").select(
        F.concat(F.lit("s"), key.cast("string")).alias("scene_id"), key.alias("k"),
        F.col("c_name").alias("name"),
        west.alias("west"), south.alias("south"), (west + 1.0).alias("east"), (south + 1.0).alias("north"),
        (key % 3650).cast("int").alias("day"), (key % 101).cast("int").alias("cloud_cover"),
        F.when(key % 13 == 0, 198).otherwise(200).cast("int").alias("bands"),
        F.when(key % 37 == 0, "float64").otherwise("float32").alias("dtype"),
        F.when(key % 41 == 0, F.lit(0.0)).otherwise(F.lit(-1.0)).alias("nodata"),
        F.when(key % 43 == 0, F.lit(None).cast("int")).when(key % 31 == 0, 4326)
        .otherwise((32601 + key % 60).cast("int")).alias("epsg"),
        F.create_map(
            F.lit("contract_version"), F.when(key % 17 == 0, "0.9.0").otherwise("1.0.0"),
            F.lit("source"), F.when(key % 19 == 0, "landsat").otherwise("enmap"),
        ).alias("tags"),
        (128 + key % 64).cast("int").alias("width"), (96 + key % 32).cast("int").alias("height"),
        (10 + key % 70).cast("double").alias("sun_elevation"),
    )


SCENES_SQL = """sn AS (
  SELECT 's' || c_custkey AS scene_id, c_custkey AS k, c_name AS name,
         CAST(c_custkey % 360 - 180 AS DOUBLE) AS west, CAST((c_custkey // 3) % 170 - 85 AS DOUBLE) AS south,
         CAST(c_custkey % 360 - 179 AS DOUBLE) AS east, CAST((c_custkey // 3) % 170 - 84 AS DOUBLE) AS north,
         CAST(c_custkey % 3650 AS INTEGER) AS day, CAST(c_custkey % 101 AS INTEGER) AS cloud_cover,
         CASE WHEN c_custkey % 13 = 0 THEN 198 ELSE 200 END AS bands,
         CASE WHEN c_custkey % 37 = 0 THEN 'float64' ELSE 'float32' END AS dtype,
         CASE WHEN c_custkey % 41 = 0 THEN 0.0 ELSE -1.0 END AS nodata,
         CAST(CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 4326 ELSE 32601 + c_custkey % 60 END AS INTEGER) AS epsg,
         CASE WHEN c_custkey % 17 = 0 THEN '0.9.0' ELSE '1.0.0' END AS contract_version,
         CASE WHEN c_custkey % 19 = 0 THEN 'landsat' ELSE 'enmap' END AS source,
         CAST(128 + c_custkey % 64 AS INTEGER) AS width, CAST(96 + c_custkey % 32 AS INTEGER) AS height,
         CAST(10 + c_custkey % 70 AS DOUBLE) AS sun_elevation
  FROM customer)"""


def events(t: Tables) -> DataFrame:
    """Job events: job, microseconds since 2024-01-01, type, status and progress."""
    ts = F.col("ts").cast("timestamp_ntz")
    kind = F.col("event_type")
    return t("events").select(
        "event_id", F.col("user_id").alias("job_id"),
        F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts).alias("us"),
        F.when(kind.isin("purchase"), "complete").when(kind == "error", "error").otherwise("progress").alias("kind"),
        F.when(kind == "signup", "queued").when(kind == "purchase", "succeeded").when(kind == "error", "failed")
        .otherwise("running").alias("status"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("progress"), "props",
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, user_id AS job_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us,
         CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END AS kind,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed'
              ELSE 'running' END AS status,
         least(value / 100.0::DOUBLE, 1.0) AS progress, props FROM events)"""

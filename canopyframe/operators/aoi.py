"""Areas of interest: point-in-polygon masks and clips of pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.session import broadcast_if_small


def row_spans(fields: DataFrame, grids: DataFrame) -> DataFrame:
    """Runs of pixels inside each field: (field_id, scene_id, row, col0, col1), columns inclusive.

    Every polygon side yields the raster rows it crosses and where; sorted crossings of one field
    part in one row pair up into runs (even-odd rule on pixel centres). The work grows with the
    outline and the covered rows, not with pixels times polygons.

    ``fields``: field_id, scene_id, polygons in map units. ``grids``: north-up grids with
    scene_id, a, c, e, f, height, width.
    """
    parts = fields.select("field_id", "scene_id", F.posexplode("polygons").alias("part", "rings"))
    ring = parts.select("field_id", "scene_id", "part", F.explode("rings").alias("ring"))
    sides = ring.select("field_id", "scene_id", "part", F.explode(F.arrays_zip(
        F.slice("ring", F.lit(1), F.size("ring") - 1).alias("p"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("q"))).alias("s"))
    at = lambda side, i: F.get(F.col(f"s.{side}"), F.lit(i))
    g = sides.join(broadcast_if_small(grids.select("scene_id", "a", "c", "e", "f", "height", "width")), "scene_id").select(
        "*", at("p", 0).alias("xi"), at("p", 1).alias("yi"), at("q", 0).alias("xj"), at("q", 1).alias("yj"))
    position = lambda y: (y - F.col("f")) / F.col("e") - 0.5
    top = F.greatest(F.lit(0), F.floor(F.least(position(F.col("yi")), position(F.col("yj")))))
    bottom = F.least(F.col("height") - 1, F.ceil(F.greatest(position(F.col("yi")), position(F.col("yj")))))
    g = g.filter(top <= bottom).withColumn("row", F.explode(F.sequence(top.cast("int"), bottom.cast("int"))))
    g = g.withColumn("y", F.col("f") + F.col("e") * (F.col("row") + 0.5)).filter((F.col("yi") > F.col("y")) != (F.col("yj") > F.col("y")))
    g = g.withColumn("x", (F.col("xj") - F.col("xi")) * (F.col("y") - F.col("yi")) / (F.col("yj") - F.col("yi")) + F.col("xi"))
    hits = g.groupBy("field_id", "scene_id", "part", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"), *[F.first(n).alias(n) for n in ("a", "c", "width")])
    pairs = F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)))
    runs = hits.filter(F.size("xs") >= 2).withColumn("_i", pairs)
    # First centre at or right of the entry, last centre left of the exit.
    edge = lambda i: F.ceil((F.get("xs", i) - F.col("c")) / F.col("a") - 0.5)
    runs = runs.select("field_id", "scene_id", "row", F.greatest(F.lit(0), edge(F.col("_i"))).cast("int").alias("col0"),
                       F.least(F.col("width"), edge(F.col("_i") + 1)).cast("int").alias("_end"))
    return runs.filter("col0 < _end").select("field_id", "scene_id", "row", "col0", (F.col("_end") - 1).alias("col1"))


def pixels_in_fields(px: DataFrame, fields: DataFrame, grids: DataFrame) -> DataFrame:
    """Pixels with the ``field_id`` that contains their centre: runs to pixels, then an equi-join."""
    runs = row_spans(fields, grids)
    cells = runs.select("field_id", "scene_id", "row", F.explode(F.sequence("col0", "col1")).alias("col")).distinct()
    return px.join(cells, ["scene_id", "row", "col"])


def mask_aoi(px: DataFrame, fields: DataFrame, grids: DataFrame, keys: tuple[str, ...] = ("scene_id", "row", "col")) -> DataFrame:
    """Every pixel with ``inside``; scenes no field touches are all outside."""
    hit = pixels_in_fields(px.select(*keys), fields, grids).select(*keys).distinct().withColumn("inside", F.lit(True))
    return px.join(hit, list(keys), "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def missing_aoi(fields: DataFrame, hits: DataFrame) -> DataFrame:
    """Fields that cover no pixel, as error rows."""
    return fields.join(hits.select("field_id").distinct(), "field_id", "left_anti").select(
        "field_id", F.lit("AOI does not cover any scene pixel").alias("error"))

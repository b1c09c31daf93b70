"""Tiles without holes at any zoom; geographic sources, default resolutions, polar scenes, missing scenes."""

import math

import pytest
from pyspark.sql import functions as F

from canopyframe.functions import projection as P
from canopyframe.operators import grid as GR
from canopyframe.operators import registry as RG
from canopyframe.operators import tiles as TL

GRID = "scene_id string, epsg int, a double, b double, c double, d double, e double, f double, width int, height int"


def pixels(spark, h, w, scene="s"):
    return spark.range(h * w).select(F.lit(scene).alias("scene_id"), F.expr(f"cast(id div {w} as int)").alias("row"), (F.col("id") % w).cast("int").alias("col"),
                                     (F.col("id") / (h * w)).alias("p0"), F.lit(True).alias("valid"), F.col("id").alias("k"))


@pytest.mark.parametrize("zoom", [11, 13, 15])
@pytest.mark.parametrize("grid", [("s", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 40, 30), ("s", 4326, 0.0003, 0.0, 75.0, 0.0, -0.0003, 31.0, 40, 30),
                                  ("s", 32643, 25.0, 15.0, 500000.0, -15.0, -25.0, 3420000.0, 40, 30)])
def test_every_tile_pixel_over_the_raster_is_filled(spark, zoom, grid):
    scenes = spark.createDataFrame([grid], GRID)
    got = {(r.x * 256 + r.px, r.y * 256 + r.py): r.p_healthy for r in TL.render_tiles(pixels(spark, 30, 40), scenes, [zoom]).collect()}
    (ranges,) = TL.covered_range(scenes, [zoom]).collect()
    cells = spark.range(ranges.u0 - 1, ranges.u1 + 2).crossJoin(spark.range(ranges.v0 - 1, ranges.v1 + 2).withColumnRenamed("id", "v"))
    lon, lat = TL.mercator_lonlat(F.col("id") + 0.5, F.col("v") + 0.5, F.lit(zoom))
    cells = P.with_grid_position(cells.withColumns({"lon": lon, "lat": lat, "epsg": F.lit(grid[1])}), F.col("lon"), F.col("lat"), F.col("epsg"))
    _, _, a, b, c, d, e, f, w, h = grid
    det = a * e - b * d
    inside = 0
    for r in cells.collect():
        col, row = (e * (r.x - c) - b * (r.y - f)) / det, (a * (r.y - f) - d * (r.x - c)) / det
        if 0 <= col < w and 0 <= row < h:
            inside += 1
            assert (r.id, r.v) in got
            if ranges.backward:
                assert got[r.id, r.v] == pytest.approx((int(row) * w + int(col)) / (w * h))
    assert inside > 10
    assert not ranges.backward or inside == len(got)


def test_mercator_inverse_and_index_range(spark):
    df = spark.createDataFrame([(75.0, 30.9), (-179.9, 84.0), (179.9, -84.9)], "lon double, lat double")
    u, v = TL.mercator_pixels(F.col("lon"), F.col("lat"), F.lit(17))
    back = TL.mercator_lonlat(F.col("u"), F.col("v"), F.lit(17))
    for r in df.withColumns({"u": u, "v": v}).withColumns({"lon2": back[0], "lat2": back[1]}).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 and 0 <= r.u < 256 * 2**17 and 0 <= r.v < 256 * 2**17
    with pytest.raises(ValueError, match="zoom"):
        TL.render_tiles(pixels(spark, 2, 2), spark.createDataFrame([], GRID), [23])


def test_invalid_pixels_are_transparent_and_overlaps_are_averaged(spark):
    scenes = spark.createDataFrame([("s", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 20, 20), ("t", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 20, 20)], GRID)
    risk = pixels(spark, 20, 20).withColumns({"p0": F.lit(0.2), "valid": F.col("col") >= 10}).unionByName(pixels(spark, 20, 20, "t").withColumns({"p0": F.lit(0.6), "valid": F.col("col") >= 15}))
    rows = TL.render_tiles(risk, scenes, [14]).collect()
    assert {None if r.p_healthy is None else round(r.p_healthy, 6) for r in rows} == {None, 0.2, 0.4}
    assert all((r.alpha == 0) == (r.p_healthy is None) for r in rows)
    assert TL.tile_index(TL.render_tiles(risk, scenes, [14])).agg(F.sum("n_pixels")).first()[0] == len(rows)


def test_geographic_source_to_utm(spark):
    """A geographic cube planned without a resolution, moved to its zone and looked up again."""
    g = spark.createDataFrame([("s", 4326, 0.0003, 0.0, 75.0, 0.0, -0.0003, 31.0, 32, 32)], GRID)
    plan = GR.plan_grid(g)
    p = plan.first()
    assert p.dst.epsg == 32643 and not p.unchanged and not p.no_utm
    diagonal = math.hypot((p.dst.width + 0.5) * p.dst.a, (p.dst.height + 0.5) * p.dst.a)
    assert abs(diagonal / p.dst.a - math.hypot(32, 32)) < 1.5 and 28 < p.dst.a < 33
    px = pixels(spark, 32, 32).select("scene_id", "row", "col", "k")
    out = GR.reproject(px, plan.select("scene_id", F.struct("epsg", *"abcdef", "width", "height").alias("src"), "dst"))
    assert out.count() == p.dst.width * p.dst.height
    at = out.filter("k is not null").withColumns({"x": F.lit(p.dst.c) + p.dst.a * (F.col("col") + 0.5), "y": F.lit(p.dst.f) - p.dst.a * (F.col("row") + 0.5)})
    at = P.with_lonlat(at, F.col("x"), F.col("y"), F.lit(32643))
    off = at.select(F.max(F.abs(F.col("lon") - (75.0 + 0.0003 * (F.col("k") % 32 + 0.5)))), F.max(F.abs(F.col("lat") - (31.0 - 0.0003 * (F.floor(F.col("k") / 32) + 0.5))))).first()
    assert max(off) <= 0.00015 + 1e-9
    # And from UTM to a geographic grid.
    utm = spark.createDataFrame([("s", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 32, 32)], GRID)
    back = GR.plan_grid(utm, epsg=4326).first()
    assert back.dst.epsg == 4326 and 0.0002 < back.dst.a < 0.0004 and abs(back.dst.c - 75.0) < 1e-6


def test_same_system_is_unchanged_and_polar_scenes_are_flagged(spark):
    g = spark.createDataFrame([("u", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 32, 32), ("n", 4326, 0.001, 0.0, 10.0, 0.0, -0.001, 86.0, 32, 32), ("p", 32701, 30.0, 0.0, 500000.0, 0.0, -30.0, 900000.0, 32, 32)], GRID)
    rows = {r.scene_id: r for r in GR.plan_grid(g).collect()}
    assert rows["u"].unchanged and rows["u"].dst.width == 32 and not rows["u"].no_utm
    assert rows["n"].no_utm and rows["p"].no_utm and rows["n"].dst.width > 0
    assert GR.plan_grid(g, epsg=4326).filter("scene_id = 'n'").first().unchanged


def test_scenes_that_do_not_exist(spark):
    jobs = spark.createDataFrame([(1, "a", "f"), (2, "lost", "f"), (3, "a", "gone"), (4, "a", None)], "job_id int, scene_id string, field_id string")
    ok, errors = RG.resolve_jobs(jobs, spark.createDataFrame([("a", "A")], "scene_id string, name string"), spark.createDataFrame([("f", "F")], "field_id string, name string"))
    assert {r.job_id for r in ok.collect()} == {1, 4}
    assert {r.job_id: r.error for r in errors.collect()} == {2: "scene not found: lost", 3: "field not found: gone"}

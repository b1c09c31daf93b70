"""Few rows that become very many: dealt to all tasks before, never broadcast after, summed without a sort."""

import pytest
from pyspark.sql import functions as F

from canopyframe.functions import projection as P
from canopyframe.operators import analytics as AN
from canopyframe.operators import bands as BD
from canopyframe.operators import grid as GR
from canopyframe.operators import tiles as TL
from canopyframe.plans.catalogue import QUERIES

GRID = "scene_id string, epsg int, a double, b double, c double, d double, e double, f double, width int, height int"
UTM = ("s", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 40, 30)
GEO = ("g", 4326, 0.0003, 0.0, 75.0, 0.0, -0.0003, 31.0, 40, 30)
GAP = ("n", 32643, 30.0, 0.0, None, 0.0, -30.0, 3420000.0, 40, 30)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_are_made_in_all_tasks_and_equal_grids_stay_apart(spark):
    g = spark.createDataFrame([UTM, UTM, GEO, GAP], GRID)
    out = GR.lonlat_bounds(g)
    assert "RoundRobinPartitioning" in plan_of(out) and "lambda p" not in plan_of(out)
    rows = sorted(out.collect(), key=lambda r: r.scene_id)
    assert [r.scene_id for r in rows] == ["g", "n", "s", "s"]
    assert rows[1].west is None and rows[1].no_utm is None
    assert (rows[0].west, rows[0].north) == (75.0, 31.0) and rows[0].east == pytest.approx(75.012)
    corners = spark.createDataFrame([(500000.0 + 1200 * i, 3420000.0 - 900 * j) for i in (0, 1) for j in (0, 1)], "x double, y double")
    at = corners.select(P.to_lonlat(F.col("x"), F.col("y"), F.lit(32643)).alias("p")).select("p.*").collect()
    assert rows[2][:] == rows[3][:] and rows[2].west == pytest.approx(min(p.lon for p in at), abs=1e-9)
    assert rows[2].east == pytest.approx(max(p.lon for p in at), abs=1e-9) and rows[2].south == pytest.approx(min(p.lat for p in at), abs=1e-9)


def test_plans_are_made_in_all_tasks_and_equal_grids_stay_apart(spark):
    g = spark.createDataFrame([UTM, UTM, GEO], GRID)
    out = GR.plan_grid(g, resolution=20.0)
    assert plan_of(out).count("RoundRobinPartitioning") >= 2
    rows = {}
    for r in out.collect():
        rows.setdefault(r.scene_id, []).append(r)
    assert len(rows["s"]) == 2 and rows["s"][0] == rows["s"][1] and len(rows["g"]) == 1
    d = rows["s"][0].dst
    assert (d.epsg, d.a, d.width, d.height) == (32643, 20.0, 60, 45) and d.c == pytest.approx(500000.0, abs=1e-4) and d.f == pytest.approx(3420000.0, abs=1e-4)


def test_tile_pixels_are_dealt_and_not_broadcast(spark):
    risk = spark.range(1200).select(F.expr("substr(concat('s', id), 1, 1)").alias("scene_id"), F.expr("cast(id div 40 as int)").alias("row"), (F.col("id") % 40).cast("int").alias("col"),
                                    F.lit(0.5).alias("p0"), F.lit(True).alias("valid"))
    out = TL.render_tiles(risk, spark.createDataFrame([UTM], GRID), [14])
    text = plan_of(out)
    keys = [line for line in text.splitlines() if "HashJoin [scene_id" in line and "row" in line]
    assert not keys and "SortMergeJoin [scene_id" in text
    assert any("REPARTITION_BY_NUM" in line and "scene_id" in line and "v#" in line for line in text.splitlines())
    assert out.count() > 1200


def test_bands_are_dealt_before_they_are_blown_up(spark, folder):
    b = spark.createDataFrame([(1, 0, 500.0, 10.0), (1, 0, 500.0, 10.0), (1, 1, 600.0, 0.0), (1, 1, 600.0, 0.0), (1, 2, None, 10.0), (2, 0, 505.0, None)],
                              "sensor_id int, band int, wavelength_nm double, fwhm_nm double")
    sun = BD.solar_irradiance(b)
    assert "RoundRobinPartitioning" in plan_of(sun)
    got = sorted(((r.band, r.esun) for r in sun.collect()), key=str)
    assert [k for k, _ in got] == [0, 1, 1, 2] and got[3][1] is None and 1500 < got[0][1] < 2500
    near = BD.nearest_band(b, [502.5, 590.0])
    assert "REPARTITION_BY_NUM" in plan_of(near)
    assert {(r.sensor_id, r.nm): r.band for r in near.filter("sensor_id = 2").collect()} == {(2, 502.5): 0, (2, 590.0): 0}
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES["j4_band_pairs"](spark, folder))


def square(x, y, w):
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]


def test_probes_reduce_pairs_without_sorting_them(spark):
    zone = "k bigint, zone_id string, risk_class int, risk_class_name string, risk_score double, days_to_onset double, dominant_indicator string, ring array<array<double>>"
    row = lambda k, x, y, w: (k, f"zone-{k}", 3, "visible_disease", 0.5, 3.0, "water_stress", square(x, y, w))
    zones = spark.createDataFrame([row(7, 10.0, 10.0, 0.003), row(5, 10.0, 10.0, 0.003), row(None, 10.0, 10.0, 0.003), row(5, 12.0, 12.0, 0.003), row(9, 10.004, 10.0, 0.001)], zone)
    fields = spark.createDataFrame([("f", "North", square(9.9, 9.9, 0.2))], "field_id string, name string, boundary array<array<double>>")
    points = spark.createDataFrame([(1, "f", 10.001, 10.001), (2, "f", 10.0041, 10.0015), (2, "f", 10.0041, 10.0015), (3, "f", 12.001, 12.001), (4, "f", 10.05, 10.05)],
                                   "probe_id int, field_id string, lon double, lat double")
    out = AN.probe(points, zones, fields)
    assert "SortAggregate" not in plan_of(out)
    got = sorted((r.probe_id, r.kind, r.zone_id) for r in out.select("probe_id", "kind", F.coalesce("zone_id", F.lit("-")).alias("zone_id")).collect())
    # Zone 5 and the smallest order win; the nearest zone of probe 2 is zone 9.
    assert got == [(1, "zone", "zone-5"), (2, "buffer", "zone-9"), (2, "buffer", "zone-9"), (3, "zone", "zone-5"), (4, "field", "-")]

"""Registered write-and-read-back queries for the table sinks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import bandmath as B
from canopyframe.operators import grid as GR
from canopyframe.operators import metrics as M
from canopyframe.operators import shaping as SH
from canopyframe.operators import stats as ST
from canopyframe.plans import adapters as A
from canopyframe.plans import evaluation as EVAL
from canopyframe.plans import spectral as SP
from canopyframe.plans.adapters import rnd
from canopyframe.plans.registry import query, r4, r6, with_ctes
from canopyframe.sources import chunk_store as CS
from canopyframe.sources import cubes, sinks
from canopyframe.sources import metadata as MD
from canopyframe.streaming.job_events import work_folder

PK = ["scene_id", "row", "col"]
PKQ = 'scene_id, "row", col'
WL = A.FX_WAVELENGTHS
SUM = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
FLOATS = "list_sum(list_transform(s, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)))"


@query("s15_cube_sink", with_ctes(A.PX_SQL, body=f'SELECT {PKQ}, {r4(FLOATS)} AS total FROM px WHERE scene_id = \'scn_0\''))
def _(t):
    """Pixels written block by block and one scene read back, nodata as NULL again."""
    path = work_folder(t.spark, "cube")
    cubes.write_cube(A.pixels(t), path, "enmap", bands=64)
    return cubes.read_pixels(t.spark, path, "scn_0").select(*PK, rnd(SUM("spectrum"), 4).alias("total"))


@query("s2_band_layout", with_ctes(A.PX_SQL, A.LONG_SQL, body=f'SELECT {PKQ}, CAST(band AS INTEGER) AS band, {r4("CAST(v AS FLOAT)")} AS value FROM long WHERE band IN (13, 15)'))
def _(t):
    """The band-partitioned layout: only the wanted bands' folders are read."""
    path = work_folder(t.spark, "bands")
    cubes.write_bands_long(A.pixels(t), path)
    return cubes.read_bands(t.spark, path, [670, 700], wavelengths=WL).select(*PK, F.col("band").cast("int").alias("band"), rnd("value", 4).alias("value"))


@query("s16_index_layer_sink", with_ctes(A.PX_SQL, body=f"SELECT {PKQ}, {r4('CAST(' + SP.STRICT['ndvi'] + ' AS FLOAT)')} AS ndvi, {r4('CAST(' + SP.STRICT['rep'] + ' AS FLOAT)')} AS rep FROM px"))
def _(t):
    """Index layers written with their formulas, missing values as NaN, and read back."""
    path = work_folder(t.spark, "layers")
    cubes.write_indices(B.with_indices(A.pixels(t), ("ndvi", "rep"), "strict", WL), path, ("ndvi", "rep"), nan_for_missing=True)
    back = t.spark.read.parquet(path)
    value = lambda c: F.when(~F.isnan(c), rnd(c, 4))
    return back.select(*PK, value("ndvi").alias("ndvi"), value("rep").alias("rep"))


@query("s14_labelled_windows", with_ctes(A.RASTER_SQL, "sz AS (SELECT 1)", body="SELECT scene_id, cls, count(*) * 2 AS n FROM ra GROUP BY scene_id, cls"))
def _(t):
    """Pre-built window tables from two files, read as one."""
    one, two = work_folder(t.spark, "win"), work_folder(t.spark, "win")
    px = A.raster(t).select(*PK, "cls", "onset")
    px.write.parquet(one)
    px.write.parquet(two)
    return cubes.read_windows(t.spark, one, two).groupBy("scene_id", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("s22_band_stats_round_trip", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"SELECT CAST(band AS INTEGER) AS band, {r6('quantile_cont(v, 0.02)')} AS low, {r6('quantile_cont(v, 0.98)')} AS high, count(*) AS n_pixels FROM long GROUP BY band"))
def _(t):
    path = work_folder(t.spark, "stats")
    cubes.save_stats(ST.band_stats(A.pixels(t)), path)
    return cubes.load_stats(t.spark, path).select("band", rnd("low").alias("low"), rnd("high").alias("high"), "n_pixels")


@query("s23_metrics_report", with_ctes(A.SCORED_SQL, EVAL.CM_SQL, body=f"SELECT {r6('sum(CASE WHEN truth = pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE)')} AS overall_accuracy FROM cm"))
def _(t):
    """Metrics report as JSON; private columns are dropped."""
    path = work_folder(t.spark, "report")
    sinks.write_report(M.class_metrics(M.confusion(A.scored(t))).withColumn("_private", F.lit(1)), path)
    back = t.spark.read.json(path)
    if "_private" in back.columns:
        raise AssertionError("private column written")
    return back.select(rnd("overall_accuracy").alias("overall_accuracy"))


@query("s12_geojson_file", "SELECT count(*) FILTER (WHERE s_suppkey % 5 IN (0, 1, 2)) + 2 * count(*) FILTER (WHERE s_suppkey % 5 = 3) AS n_features FROM supplier")
def _(t):
    """Polygon documents written as text files and read as features."""
    from canopyframe.plans.business import _geojson

    path = work_folder(t.spark, "geojson")
    _geojson(t).select("value").write.text(path)
    text = t.spark.read.text(path)
    g = MD.parse_geojson(text.withColumn("doc", F.xxhash64("value")).select("doc", "value"), "doc")
    return g.filter("error IS NULL").agg(F.count(F.lit(1)).alias("n_features"))


@query("tiles64_layout", with_ctes(A.RASTER_SQL, "sz AS (SELECT 1)", body="SELECT scene_id, sum(CASE WHEN valid THEN 1 ELSE 0 END) > 0 AS any_valid FROM ra GROUP BY scene_id"))
def _(t):
    """Overlapping windows materialised as tiles (bounded rows) cover every valid pixel."""
    px = A.raster(t).withColumn("spectrum", F.array("p0", "p1"))
    px = px.join(GR.scene_sizes(px), "scene_id")
    tiles = SH.window_tiles(px, 16, 4)
    return tiles.groupBy("scene_id").agg(F.bool_or(F.exists("cells", lambda c: c.valid)).alias("any_valid"))


def _written_chunks(t, chunk=8):
    path = work_folder(t.spark, "chunks")
    scenes = A.scenes(t).withColumns({"a": F.lit(30.0), "b": F.lit(0.0), "c": F.col("west") * 1000.0, "d": F.lit(0.0), "e": F.lit(-30.0), "f": F.col("north") * 1000.0})
    CS.export_chunks(A.pixels(t), path, bands=64, chunk=chunk, attributes=CS.cube_attributes(scenes, WL))
    return path


@query("x4_reader_registry", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, CAST("row" // 8 AS INTEGER) AS block_r, CAST(col // 8 AS INTEGER) AS block_c, {r4("CAST(s[14] AS FLOAT)")} AS red, {r4("CAST(s[21] AS FLOAT)")} AS nir
FROM px WHERE scene_id = 'scn_1' AND "row" >= 3 AND "row" < 14 AND col >= 6 AND col < 19"""))
def _(t):
    """A cube of chunks written, then opened by sensor name: scene, window and two bands are pushed into the data source."""
    path = _written_chunks(t)
    MD.register_source("chunked", CS.ChunkSource, t.spark, pattern=r"/runs/.*[.]f32$")
    px = MD.open_scene(t.spark, path, "chunked", scene_id="scn_1", window=(3, 6, 11, 13), bands=[13, 20])
    seen = F.get("spectrum", F.lit(0)) != -1
    value = lambda i: F.when(seen, rnd(F.get("spectrum", F.lit(i)), 4))
    return px.select(*PK, "block_r", "block_c", value(0).alias("red"), value(1).alias("nir"))


@query("s1_chunk_window_scan", with_ctes(A.PX_SQL, body=f"""
SELECT {PKQ}, {r4(FLOATS)} AS total FROM px WHERE scene_id = 'scn_0' AND "row" >= 5 AND "row" < 17 AND col >= 7 AND col < 16"""))
def _(t):
    """Window filters on a chunked cube reach the data source, which opens only the blocks they touch."""
    px = CS.read_chunks(t.spark, _written_chunks(t))
    inside = (F.col("row") >= 5) & (F.col("row") < 17) & (F.col("col") >= 7) & (F.col("col") < 16)
    return px.filter(inside & (F.col("scene_id") == "scn_0")).select(*PK, rnd(SUM("spectrum"), 4).alias("total"))


@query("s17_chunk_export", with_ctes(A.PX_SQL, body=f'SELECT {PKQ}, {r4(FLOATS)} AS total FROM px'))
def _(t):
    """All pixels exported in chunks by a committed write and read back."""
    return CS.read_chunks(t.spark, _written_chunks(t)).select(*PK, rnd(SUM("spectrum"), 4).alias("total"))


@query("s17_chunk_attributes", with_ctes(A.SCENES_SQL, body="""
SELECT scene_id, contract_version, source, 'EPSG:' || epsg AS crs, 30.0::DOUBLE AS a, west * 1000.0 AS c, north * 1000.0 AS f,
       -1.0::DOUBLE AS nodata, CAST(64 AS INTEGER) AS n_bands, 1660.0::DOUBLE AS last_nm FROM sn"""))
def _(t):
    """The scenes' attributes, written with the chunks and read back."""
    found = CS.read_attributes(t.spark, _written_chunks(t))
    kind = "tags map<string,string>, crs string, transform array<double>, nodata double, wavelength_nm array<double>"
    at = found.select("scene_id", F.from_json("attributes", kind).alias("j"))
    number = lambda i: F.get("j.transform", F.lit(i))
    return at.select("scene_id", F.element_at("j.tags", F.lit("contract_version")).alias("contract_version"), F.element_at("j.tags", F.lit("source")).alias("source"),
                     "j.crs", number(0).alias("a"), number(2).alias("c"), number(5).alias("f"), "j.nodata",
                     F.size("j.wavelength_nm").alias("n_bands"), F.element_at("j.wavelength_nm", -1).alias("last_nm"))

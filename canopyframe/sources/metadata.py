"""Metadata sources: scene inventory, key-value text, band XML, GeoJSON, reader registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File-name patterns of the sensors' products.
BAND_FILE = r"(?i)_B(\d{3})(?:_L1[A-Z0-9]*)?\.TIF{1,2}$"
MTL_FILE = r"(?i)MTL.*\.TXT$"
KEY_VALUE = r"^\s*([A-Z0-9_]+)\s*=\s*(.+?)\s*$"
DEFAULT_GAIN = 1e-4


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(dir, name) of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    return files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"))


def detect_sensors(files: DataFrame) -> DataFrame:
    """Sensor per directory from its file names; specific products before the generic one.

    One aggregation with map-side combine: a directory is never gathered.
    """
    n, u = F.col("name"), F.upper("name")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = files.groupBy("dir").agg(
        any_of(n.rlike(MTL_FILE)).alias("mtl"), any_of(n.rlike(BAND_FILE) & u.startswith("EO1H")).alias("band"),
        any_of(u.contains("SPECTRAL_IMAGE") & u.endswith(".TIF")).alias("image"), any_of(u.contains("METADATA") & u.endswith(".XML")).alias("xml"),
        any_of(n.startswith("PRS_") & (u.endswith(".HE5") | u.endswith(".H5"))).alias("he5"),
        any_of(u.endswith(".TIF") | u.endswith(".TIFF")).alias("tif"))
    sensor = (
        F.when(F.col("image") & F.col("xml"), "enmap").when(F.col("mtl") & F.col("band"), "hyperion")
        .when(F.col("he5"), "prisma").when(F.col("tif"), "generic"))
    return g.select("dir", sensor.alias("sensor"))


def scan_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(dir, sensor) of every directory below ``root``."""
    return detect_sensors(list_files(spark, root))


def band_numbers(files: DataFrame) -> DataFrame:
    """Band number of every band file (1..242)."""
    b = F.regexp_extract("name", BAND_FILE, 1)
    n = F.when(b != "", b.cast("int"))
    return files.select("dir", "name", n.alias("band")).filter(F.col("band").between(1, 242))


def parse_mtl(texts: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """(path, mtl MAP): ``KEY = VALUE`` lines, group lines ignored, quotes stripped, last key wins."""
    lines = texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    k, v = F.regexp_extract("line", KEY_VALUE, 1), F.regexp_extract("line", KEY_VALUE, 2)
    kv = lines.select(key, "pos", k.alias("k"), F.regexp_replace(v, '^"+|"+$', "").alias("v")).filter((F.col("k") != "") & ~F.col("k").isin("GROUP", "END_GROUP"))
    last = kv.groupBy(key, "k").agg(F.max_by("v", "pos").alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("mtl"))


def read_mtl(spark: SparkSession, *paths: str) -> DataFrame:
    t = spark.read.text(list(paths), wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_mtl(t)


def mtl_scene(mtl: DataFrame, key: str = "path") -> DataFrame:
    """Acquisition time, sun elevation, scales and id from parsed key-value metadata."""
    at = lambda *names: F.coalesce(*[F.try_element_at("mtl", F.lit(n)) for n in names])
    num = lambda c: c.try_cast("double")
    day = at("ACQUISITION_DATE", "DATE_ACQUIRED")
    clock = F.substring(F.coalesce(at("SCENE_CENTER_SCAN_TIME", "SCENE_CENTER_TIME"), F.lit("00:00:00")), 1, 8)
    number = lambda *names: F.coalesce(*[num(F.try_element_at("mtl", F.lit(n))) for n in names])
    return mtl.select(
        key, F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")).alias("acquired_at"),
        number("SUN_ELEVATION").alias("sun_elevation"),
        F.coalesce(number("SCALING_FACTOR_VNIR", "RADIANCE_SCALING_FACTOR_VNIR"), F.lit(40.0)).alias("vnir_scale"),
        F.coalesce(number("SCALING_FACTOR_SWIR", "RADIANCE_SCALING_FACTOR_SWIR"), F.lit(80.0)).alias("swir_scale"),
        F.coalesce(at("ENTITY_ID"), F.element_at(F.split(F.col(key).cast("string"), "/"), -1)).alias("scene_id"))


BAND_XML = T.StructType([
    T.StructField("_number", T.IntegerType()), T.StructField("wavelengthCenterOfBand", T.StringType()), T.StructField("FWHMOfBand", T.StringType()),
    T.StructField("GainOfBand", T.StringType()), T.StructField("OffsetOfBand", T.StringType()),
])


def _band_rows(rows: DataFrame, key: str) -> DataFrame:
    num = lambda c: F.trim(F.col(c)).try_cast("double")
    out = rows.select(key, F.col("_number").alias("number"), num("wavelengthCenterOfBand").alias("wavelength_nm"), num("FWHMOfBand").alias("fwhm_nm"),
                      F.coalesce(F.nullif(num("GainOfBand"), F.lit(0.0)), F.lit(DEFAULT_GAIN)).alias("gain"), F.coalesce(num("OffsetOfBand"), F.lit(0.0)).alias("offset"))
    return out.filter(F.col("wavelength_nm").isNotNull() & F.col("fwhm_nm").isNotNull())


def read_band_xml(spark: SparkSession, path: str) -> DataFrame:
    """Band rows of XML metadata files: incomplete bands skipped, empty gain and offset defaulted."""
    x = spark.read.format("xml").option("rowTag", "bandID").option("ignoreNamespace", "true").schema(BAND_XML).load(path)
    x = x.withColumn("path", F.col("_metadata.file_path"))
    return _band_rows(x, "path").orderBy("path", "number")


def parse_band_xml(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The same from an XML text column whose root holds ``bandID`` elements."""
    schema = T.StructType([T.StructField("bandID", T.ArrayType(BAND_XML))])
    rows = texts.select(key, F.explode(F.from_xml(F.col(text), schema.simpleString(), {"ignoreNamespace": "true"})["bandID"]).alias("b"))
    return _band_rows(rows.select(key, "b.*"), key)


RING = "array<array<array<double>>>"
POLYGON = f"type string, coordinates {RING}"
MULTI = f"type string, coordinates array<{RING}>"


def geojson_polygons(geometry):
    """A GeoJSON geometry text as an array of polygons; anything else is NULL."""
    kind = F.get_json_object(geometry, "$.type")
    one = F.from_json(geometry, POLYGON)["coordinates"]
    many = F.from_json(geometry, MULTI)["coordinates"]
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def parse_geojson(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """Features of GeoJSON documents: (key, position, polygons, properties MAP).

    Accepts FeatureCollection, Feature, Polygon and MultiPolygon; another type is an error row's
    ``error``; features without geometry are skipped.
    """
    kind = F.get_json_object(text, "$.type")
    feats = F.from_json(F.get_json_object(text, "$.features"), "array<struct<geometry:string,properties:string>>")
    one = F.array(F.struct(F.get_json_object(text, "$.geometry").alias("geometry"), F.get_json_object(text, "$.properties").alias("properties")))
    bare = F.array(F.struct(F.col(text).alias("geometry"), F.lit(None).cast("string").alias("properties")))
    rows = F.when(kind == "FeatureCollection", feats).when(kind == "Feature", one).when(kind.isin("Polygon", "MultiPolygon"), bare)
    flat = texts.select(key, kind.alias("_k"), F.posexplode_outer(rows).alias("position", "f"))
    polygons = geojson_polygons(F.col("f.geometry"))
    bad = F.coalesce(~F.col("_k").isin("FeatureCollection", "Feature", "Polygon", "MultiPolygon"), F.lit(True))
    out = flat.select(key, "position", polygons.alias("polygons"), F.from_json("f.properties", "map<string,string>").alias("properties"),
                      F.when(bad, F.concat(F.lit("unsupported AOI GeoJSON type: "), F.coalesce("_k", F.lit("NULL")))).alias("error"))
    return out.filter(F.col("polygons").isNotNull() | F.col("error").isNotNull())


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_geojson(t, "path")


# Reader registry: a site with a raster codec adds a function (spark, path) -> pixels DataFrame, or
# names a Python data source, which then gets scene, window and bands as options of its reads.
_READERS: dict[str, Callable[..., DataFrame]] = {}
_PATTERNS: dict[str, str] = {}


def register_source(name: str, reader: Callable[[SparkSession, str], DataFrame] | type, spark: SparkSession | None = None, pattern: str | None = None) -> None:
    """Add a reader by sensor name; ``pattern`` is a regular expression that a path of its products matches.

    A Python ``DataSource`` class is registered with the session, and reads get the options ``scene``,
    ``row_off``, ``col_off``, ``height``, ``width`` and ``bands``, so that it opens no more than is asked for.
    """
    if isinstance(reader, type):
        if spark is None:
            raise ValueError("a DataSource class needs the session")
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(reader)
        fmt = reader.name()

        def load(s: SparkSession, path: str, scene_id: str | None, window: Sequence[int] | None, bands: Sequence[int] | None) -> DataFrame:
            options = {} if scene_id is None else {"scene": scene_id}
            if window is not None:
                options |= dict(zip(("row_off", "col_off", "height", "width"), map(str, window)))
            if bands is not None:
                options["bands"] = ",".join(map(str, bands))
            return s.read.format(fmt).options(**options).load(path)
    else:
        def load(s: SparkSession, path: str, scene_id: str | None, window: Sequence[int] | None, bands: Sequence[int] | None) -> DataFrame:
            px = reader(s, path)
            if scene_id is not None:
                px = px.filter(F.col("scene_id") == scene_id)
            if window is not None:
                r, c, h, w = window
                px = px.filter((F.col("row") >= r) & (F.col("row") < r + h) & (F.col("col") >= c) & (F.col("col") < c + w))
            if bands is not None:
                px = px.withColumn("spectrum", F.when(F.col("spectrum").isNotNull(), F.array(*[F.get("spectrum", F.lit(b)) for b in bands])))
            return px
    _READERS[name] = load
    _PATTERNS.pop(name, None)
    if pattern is not None:
        _PATTERNS[name] = pattern


def available_sources() -> list[str]:
    """Registered names, the generic reader last."""
    return sorted(_READERS, key=lambda n: (n == "generic", n))


def detect_source(spark: SparkSession, path: str) -> str | None:
    """The first registered sensor whose pattern a file below ``path`` matches, the generic one last; no file is opened."""
    names = [n for n in available_sources() if n in _PATTERNS]
    if not names:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = files.agg(*[F.bool_or(F.col("path").rlike(_PATTERNS[n])).alias(n) for n in names]).first()
    return next((n for n in names if found[n]), None)


def open_scene(spark: SparkSession, path: str, sensor: str | None = None, scene_id: str | None = None,
               window: Sequence[int] | None = None, bands: Sequence[int] | None = None) -> DataFrame:
    """Pixels of ``path`` by the named reader, or the one its files tell; scene, window (row, col, height, width) and bands prune the read."""
    name = sensor or detect_source(spark, path)
    if name is None:
        raise ValueError(f"could not detect the sensor of {path}; pass sensor")
    if name not in _READERS:
        raise KeyError(f"unknown sensor {name!r}; available: {available_sources()}")
    return _READERS[name](spark, path, scene_id, window, bands)

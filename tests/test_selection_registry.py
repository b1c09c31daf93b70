"""Radix selection, the scene catalogue, onset regression, response weights over partitions."""

import datetime

from pyspark.sql import functions as F

from canopyframe.operators import bands as BD
from canopyframe.operators import ordered as O
from canopyframe.operators import registry as RG
from canopyframe.operators import score as SC


def test_selection_with_nearly_equal_ranks(spark, monkeypatch):
    """Nine of ten ranks agree in their high bits, a third are equal; small cuts go through every round."""
    monkeypatch.setattr(O, "EDGE", 50)
    base = 5 << 55
    rows = [(i, base + (i % 7 if i % 10 else i << 40) if i % 3 else base + 3) for i in range(3000)] + [(9001, None)]
    df = spark.createDataFrame(rows, "key int, r bigint").repartition(6)
    want = sorted((r, k) for k, r in rows if r is not None)
    for n in (0, 1, 40, 700, 1500, 2999, 3000, 5000):
        got = sorted((x.r, x.key) for x in O.smallest(df, n, F.col("r"), ["key"]).collect())
        assert got == want[:n]


def test_selection_of_equal_ranks_spreads_over_tasks(spark):
    df = spark.range(40_000).withColumn("r", F.lit(77).cast("bigint"))
    top = O.smallest(df, 15_000, F.col("r"), ["id"])
    assert sorted(x.id for x in top.collect()) == list(range(15_000))
    numbered = O.chunked(df.withColumn("_all", F.lit(0)), ["_all"], ["r", "id"], 8)
    assert numbered.groupBy(O.CHUNK).count().agg(F.max("count")).first()[0] < 10_000
    assert O.smallest(df.filter("false"), 5, F.col("r"), ["id"]).count() == 0


def test_catalogue_is_inserted_once(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    assert RG.read_catalogue(spark, path).count() == 0
    inventory = spark.createDataFrame([("/raw/a", "enmap"), ("/raw/b", None), ("/raw/a", "enmap")], "dir string, sensor string")

    def manifest(day, when):
        return RG.register_scenes(inventory, F.timestamp_seconds(F.lit(when)), F.timestamp_seconds(F.lit(day * 86400)))

    assert RG.append_scenes(manifest(1, 10), path) == 2
    assert RG.append_scenes(manifest(1, 20), path) == 0
    assert RG.read_catalogue(spark, path).count() == 2
    assert RG.append_scenes(manifest(2, 30), path) == 2
    now = {r.scene_id: r for r in RG.current_scenes(spark, path).collect()}
    assert set(now) == {"a", "b"} and now["a"].acquired_at == datetime.datetime(1970, 1, 3) and now["b"].sensor is None
    # Without a time of acquisition.
    assert RG.append_scenes(RG.register_scenes(inventory, F.timestamp_seconds(F.lit(40))), path) == 2
    assert RG.append_scenes(RG.register_scenes(inventory, F.timestamp_seconds(F.lit(50))), path) == 0


def test_onset_regression_shrugs_off_outliers(spark):
    rows = [(i, [i % 10 / 10, i % 7 / 7]) for i in range(400)]
    px = spark.createDataFrame(rows, "k int, spectrum array<double>")
    truth = 3.0 + 10.0 * F.get("spectrum", F.lit(0)) + 5.0 * F.get("spectrum", F.lit(1))
    px = px.withColumns({"truth": truth, "onset": F.when(F.col("k") % 17 == 0, 900.0).when(F.col("k") % 19 == 0, F.lit(None)).otherwise(truth)})
    px = px.unionByName(px.limit(1).withColumns({"k": F.lit(-1), "spectrum": F.lit(None).cast("array<double>")}))
    out = SC.apply_onset_model(SC.fit_onset_model(px), px)
    assert out.count() == 401 and out.filter("k = -1").first().onset_days is None
    assert out.filter("k >= 0").agg(F.max(F.abs(F.col("onset_days") - F.col("truth")))).first()[0] < 0.5


def test_response_weights_spread_over_partitions(spark):
    bands = spark.range(40 * 20).select((F.col("id") % 40).alias("sensor_id"), F.expr("cast(id div 40 as int)").alias("band"), (400.0 + 20.0 * F.expr("id div 40")).alias("wavelength_nm"),
                                        F.lit(10.0).alias("fwhm_nm"), F.lit(False).alias("bad"))
    w = BD.response_weights(bands, [400.0 + 10 * i for i in range(50)])
    counts = [r["count"] for r in w.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == 40 * 20 * 50 and len(counts) > 4 and max(counts) < sum(counts) / 2

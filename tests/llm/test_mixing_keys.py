"""NULL and repeated keys of the mixing operator."""

from pyspark.sql import functions as F

from canopyframe.llm import mixing


def test_null_keys_draw_by_their_text_and_spread(spark, request):
    # Small partitions stay apart, so that they can be counted.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for rate in (0.2, 0.5, 1.5):
        out = mixing.replicate(docs, spark.createDataFrame([("a", rate)], "source string, rate double"), copy="copy")
        lost = out.filter("doc_id is null")
        n = lost.count()
        assert abs(n - 6667 * rate) < 5 * (6667 * rate) ** 0.5
        sizes = [r["count"] for r in lost.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2.5 * n / len(sizes)
        # Every text draws for itself: some are gone, some are there twice.
        per = {r["count"] for r in lost.groupBy("text").count().collect()}
        assert rate < 1 or {1, 2, 3} <= per


def test_keys_decide_where_they_are(spark):
    docs = spark.createDataFrame([(5, "a", "x"), (5, "a", "y"), (None, "a", "same"), (None, "a", "same")], "doc_id bigint, source string, text string")
    rates = spark.createDataFrame([("a", 3.0)], "source string, rate double")
    counts = {(r.doc_id, r.text): r["count"] for r in mixing.replicate(docs, rates).groupBy("doc_id", "text").count().collect()}
    assert counts.get((5, "x")) == counts.get((5, "y"))
    assert counts.get((None, "same"), 0) % 2 == 0

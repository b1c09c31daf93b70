"""Zones in fields: split cells and partial sums give what every pair gives."""

import random

from pyspark.sql import functions as F

from canopyframe.operators import analytics as AN


def tables(spark):
    draw = random.Random(1)
    # A third of the zones stand at one point, some exactly on the edge of a field's reach.
    spots = [(10.1, 50.1)] * 400 + [(draw.uniform(9, 11), draw.uniform(49, 51)) for _ in range(700)] + [(10.25, 50.0), (10.5, 50.25), (9.75, 49.75), (10.0, 50.25)] * 10
    zones = [(f"z{i}", i, i % 4, float(i % 31), draw.choice([0.5, 1.25, 8.0]), [[x, y], [x + 1, y]]) for i, (x, y) in enumerate(spots)]
    fields = [(f"f{i}", x, y, 1000.0) for i, (x, y) in enumerate([(10.0, 50.0), (10.25, 50.25), (10.03125, 49.96875), (9.3, 49.4), (80.0, 10.0), (-0.1, 0.0)] + [(draw.uniform(9, 11), draw.uniform(49, 51)) for _ in range(12)])]
    return (spark.createDataFrame(zones, "zone_id string, k int, risk_class int, days_to_onset double, area_acres double, ring array<array<double>>").repartition(5),
            spark.createDataFrame(fields, "field_id string, cx double, cy double, acres double"), zones, fields)


def test_pairs_with_split_cells(spark, request):
    zt, ft, zones, fields = tables(spark)
    want = sorted((z[0], f[0]) for z in zones for f in fields if abs(z[5][0][0] - f[1]) < 0.25 and abs(z[5][0][1] - f[2]) < 0.25)
    for load in (1 << 30, 50):
        pairs = AN.zones_in_field(zt, ft, load)
        assert sorted((r.zone_id, r.field_id) for r in pairs.select("zone_id", "field_id").collect()) == want
    z, f = AN.split_by_load(zt.select("zone_id", F.lit(1).alias("c")), ft.select("field_id", F.lit(1).alias("c")), ["c"], 100)
    sizes = [r["count"] for r in z.groupBy("_part").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 150 and f.count() == 12 * len(fields)


def test_partial_sums_equal_sums_over_pairs(spark):
    zt, ft, _, _ = tables(spark)
    pairs = AN.zones_in_field(zt, ft)
    for load in (None, 50):
        got = {r.field_id: r for r in AN.field_sums(zt, ft, load).collect()}
        assert sum(r.n for r in got.values()) == pairs.count()
    one = {r.field_id: r.asDict() for r in AN.zone_kpis(pairs, ["field_id"], F.col("acres")).collect()}
    assert {r.field_id: r.asDict() for r in AN.field_kpis(zt, ft).select(*AN.zone_kpis(pairs, ["field_id"], F.col("acres")).columns).collect()} == one
    two = {r.field_id: r.asDict() for r in AN.zone_matrix(pairs, ["field_id"]).collect()}
    assert {r.field_id: r.asDict() for r in AN.field_matrix(zt, ft).collect()} == two


def test_no_zones(spark):
    zt, ft, _, _ = tables(spark)
    assert AN.field_sums(zt.filter("false"), ft).count() == 0 and AN.zones_in_field(zt.filter("false"), ft).count() == 0

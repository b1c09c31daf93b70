"""Operators against brute force on small, awkward inputs: hot keys, ties, borders, faults."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import bandmath as B
from canopyframe.functions import geometry as G
from canopyframe.functions import projection as P
from canopyframe.functions import rules
from canopyframe.functions import spectral as S
from canopyframe.operators import analytics as AN
from canopyframe.operators import aoi as AO
from canopyframe.operators import blocks as BL
from canopyframe.operators import events as EV
from canopyframe.operators import grid as GR
from canopyframe.operators import metrics as M
from canopyframe.operators import ordered as O
from canopyframe.operators import quantiles as Q
from canopyframe.operators import resample as R
from canopyframe.operators import shaping as SH
from canopyframe.operators import stats as ST
from canopyframe.operators import stitch as SW
from canopyframe.operators import zones as Z
from canopyframe.operators.components import connected

RNG = np.random.default_rng(7)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ ordered scans and percentiles


def hot_rows(n=600):
    keys = ["hot" if i % 3 == 0 else f"k{i % 40}" for i in range(n)]
    return [(keys[i], int(RNG.integers(0, 50)), i, float(RNG.normal())) for i in range(n)]


def test_ordinal_matches_row_number_on_a_hot_key(spark):
    rows = hot_rows()
    df = frame(spark, rows, "k string, o int, id int, v double")
    got = {(r.k, r.id): r.n for r in O.ordinal(df, ["k"], ["o", "id"]).collect()}
    for key in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            assert got[key, r[2]] == pos


def test_prefix_scans_match_a_loop(spark):
    rows = hot_rows()
    c = O.chunked(frame(spark, rows, "k string, o int, id int, v double"), ["k"], ["o", "id"])
    c = O.previous(c, ["k"], ["o", "id"], "v", "prev")
    c = O.prefix_sum(c, ["k"], ["o", "id"], F.col("id"), "total")
    c = O.prefix_max_before(c, ["k"], ["o", "id"], F.col("v"), "top")
    c = O.last_seen(c.withColumn("w", F.when(F.col("id") % 5 == 0, F.col("id"))), ["k"], ["o", "id"], "w", "seen")
    got = {(r.k, r.id): r for r in c.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        prev, total, top, seen = None, 0, None, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            g = got[key, r[2]]
            total += r[2]
            seen = r[2] if r[2] % 5 == 0 else seen
            assert (g.prev, g.total, g.top, g.seen) == (prev, total, top, seen)
            prev, top = r[3], r[3] if top is None else max(top, r[3])


@pytest.mark.parametrize("direct", [True, False])
def test_exact_percentiles_match_numpy(spark, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(Q, "SMALL_CELL", 0)
    data = {
        "hot": np.concatenate([RNG.normal(0, 3, 3000), np.full(500, 0.25), [0.0, -0.0]]),
        "tiny": np.array([5.0]), "two": np.array([-1.0, 2.0]), "same": np.full(50, 7.5), "wide": RNG.uniform(700, 740, 800),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None)]
    probs = [0.0, 0.02, 0.5, 0.98, 1.0]
    for r in Q.exact_percentiles(frame(spark, rows, "k string, v double"), ["k"], "v", probs).collect():
        np.testing.assert_allclose([r[f"q{i}"] for i in range(5)], np.quantile(data[r.k], probs), rtol=1e-12, atol=1e-15)
        assert r.n == data[r.k].size


def test_exact_sample_and_split(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    for n in (1, 137, 1000, 5000):
        s = ST.cap_sample(df, n, ["key"], seed=3)
        keys = [r.key for r in s.collect()]
        assert len(keys) == len(set(keys)) == min(n, 1000)
        assert sorted(keys) == sorted(r.key for r in ST.cap_sample(df, n, ["key"], seed=3).collect())
    assert SH.split(df, 30, F.xxhash64("key"), ["key"]).filter("is_val").count() == 30
    assert SH.split(spark.range(5).withColumnRenamed("id", "key"), 30, F.xxhash64("key"), ["key"]).filter("is_val").count() == 1


# ------------------------------------------------------------------ spectra


def random_px(spark, n, bands, faults=True):
    x = RNG.uniform(-0.1, 1.1, (n, bands))
    if faults:
        x[0, :] = -1.0
        x[1, 3] = np.nan
        x[2, 5] = np.inf
    return x, frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, spectrum array<double>")


def test_resampler_matches_dense_numpy(spark):
    wl = np.arange(420, 2450, 6.5)
    fwhm = np.full(wl.size, 1.1 * 6.5)
    bad = RNG.random(wl.size) < 0.05
    x = RNG.uniform(0, 1, (6, wl.size))
    x[0] = -1.0
    x[1, 40 if not bad[40] else 41] = np.nan
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, spectrum array<double>")
    got = {r.id: r.spectrum for r in R.resample(df, list(wl), list(fwhm), list(bad)).collect()}
    dst = np.array(K.canonical_wavelengths())
    water = lambda w: ((w >= 1340) & (w <= 1460)) | ((w >= 1790) & (w <= 1960))
    out = np.zeros((x.shape[0], 200))
    good = ~(bad | water(wl) | (wl < 380) | (wl > 2510))
    sig = 1 / (2 * np.sqrt(2 * np.log(2)))
    fill = np.zeros(200, bool)
    used = np.zeros(wl.size, bool)
    for d in range(200):
        var = (10.55 * sig) ** 2 + (fwhm * sig) ** 2
        o = np.where(good, np.exp(-0.5 * (dst[d] - wl) ** 2 / var) / np.sqrt(2 * np.pi * var), 0)
        fill[d] = o.sum() * 6.5 < 0.25 or water(dst[d : d + 1])[0]
        if not fill[d]:
            out[:, d] = np.nan_to_num(x) @ (o / o.sum())
            used |= o > 0
    for d in np.flatnonzero(fill):
        lo, hi = [i for i in range(d) if not fill[i]], [i for i in range(d, 200) if not fill[i]]
        if not lo or not hi:
            out[:, d] = out[:, hi[0] if not lo else lo[-1]]
        else:
            t = (dst[d] - dst[lo[-1]]) / (dst[hi[0]] - dst[lo[-1]])
            out[:, d] = (1 - t) * out[:, lo[-1]] + t * out[:, hi[0]]
    assert got[0] is None and got[1] is None
    for i in range(2, 6):
        np.testing.assert_allclose(got[i], out[i], atol=1e-6)


def test_smoothing_keeps_quadratics_and_ends(spark):
    x = np.arange(30.0)
    y = 0.3 * x * x - 2 * x + 1
    row = R.savgol(frame(spark, [(1, [float(v) for v in y])], "id int, spectrum array<double>"), 30).first()
    np.testing.assert_allclose(row.spectrum, y, atol=1e-9)
    short = frame(spark, [(1, [1.0, 5.0, 2.0])], "id int, spectrum array<double>")
    assert R.savgol(short, 3).first().spectrum == [1.0, 5.0, 2.0]


def test_null_spectra_survive_the_arrow_path(spark):
    df = frame(spark, [(1, None), (2, [1.0, 2.0]), (3, None), (4, [3.0, 4.0])], "id int, spectrum array<double>").coalesce(1)
    got = {r.id: r.spectrum for r in R.apply_matrix(df, np.array([[1.0, 1.0], [0.0, 2.0], [1.0, 0.0]])).collect()}
    assert got == {1: None, 2: [3.0, 4.0, 1.0], 3: None, 4: [7.0, 8.0, 3.0]}


def test_three_meanings_of_invalid(spark):
    rows = [(1, [-1.0, -1.0, 0.5]), (2, [0.1, -1.0, 0.2]), (3, [0.1, 0.2, float("nan")]), (4, None), (5, [0.1, 0.2, 0.3])]
    df = frame(spark, rows, "id int, spectrum array<double>")
    got = df.select("id", S.any_band_missing("spectrum").alias("a"), S.all_bands_nodata("spectrum", -1.0, [True, True, False]).alias("b"),
                    S.used_band_missing("spectrum", [True, False, False]).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(True, True, True), (True, False, False), (True, False, False), (True, True, True), (False, False, False)]


def test_sun_elevation_out_of_range_is_an_error(spark):
    df = frame(spark, [(1, [1.0])], "id int, r array<double>")
    for bad in (0, -5, 91):
        with pytest.raises(Exception, match="sun elevation"):
            df.select(S.toa_reflectance("r", [1000.0], F.lit(bad), F.lit(10))).collect()


def test_nearest_band_ties_and_unknown_index(spark):
    assert B.nearest_index([500.0, 520.0, 540.0], 510.0) == 0
    assert len(K.canonical_wavelengths()) == 200 and K.canonical_wavelengths()[-1] == 2500.0
    df = frame(spark, [(1, [0.0] * 200)], "id int, spectrum array<double>")
    row = B.with_indices(df, ("ndvi", "mcari", "rep")).first()
    assert row.ndvi is None and row.mcari is None and row.rep is None
    with pytest.raises(ValueError, match="unknown indices"):
        B.with_indices(df, ("nope",))


def test_proxy_labels_find_a_planted_patch(spark):
    wl = np.array(K.canonical_wavelengths())
    base = 0.05 + 0.45 / (1 + np.exp(-(wl - 715) / 12)) + 0.03 * np.exp(-((wl - 550) / 25) ** 2)
    sick = 0.05 + 0.40 / (1 + np.exp(-(wl - 700) / 14)) + 0.01 * np.exp(-((wl - 550) / 25) ** 2)
    rows = [("s", r, c, [float(v) for v in ((sick if 5 <= r < 9 and 5 <= c < 9 else base) + RNG.normal(0, 0.0005, 200))]) for r in range(20) for c in range(20)]
    df = frame(spark, rows, "scene_id string, row int, col int, spectrum array<double>")
    for sigma in (0.0, 1.0):
        lab = {(r.row, r.col): r.cls for r in ST.proxy_labels(df, smooth_sigma=sigma, block=8).collect()}
        patch = [lab[r, c] for r in range(5, 9) for c in range(5, 9)]
        rest = [v for k, v in lab.items() if not (4 <= k[0] < 10 and 4 <= k[1] < 10)]
        assert np.mean([v is not None and v > 0 for v in patch]) > 0.9
        assert np.mean([v == 0 for v in rest]) > 0.95


# ------------------------------------------------------------------ windows, blending, zones


@pytest.mark.parametrize("h,w,size,overlap", [(40, 33, 16, 4), (16, 16, 16, 4), (5, 70, 16, 8), (17, 9, 8, 0), (31, 64, 8, 6)])
def test_window_hits_equal_containment(spark, h, w, size, overlap):
    sizes = frame(spark, [("s", h, w)], "scene_id string, height int, width int")
    px = spark.range(h * w).select(F.lit("s").alias("scene_id"), F.expr(f"cast(id div {w} as int)").alias("row"), (F.col("id") % w).cast("int").alias("col"), F.lit(h).alias("height"), F.lit(w).alias("width"))
    wins = [(r.row_off, r.col_off, r.h, r.w) for r in GR.windows(sizes, size, overlap).collect()]
    assert len(wins) == len(set(wins))
    want = sorted((r, c, a, b) for a, b, hh, ww in wins for r in range(a, a + hh) for c in range(b, b + ww))
    tiles = GR.tile_pixels(px, size, overlap)
    assert sorted((r.row, r.col, r.row_off, r.col_off) for r in tiles.collect()) == want
    flat = SW.stitch(tiles.withColumn("p0", F.lit(0.37)), ("p0",))
    got = flat.agg(F.count(F.lit(1)).alias("n"), F.min("p0").alias("lo"), F.max("p0").alias("hi")).first()
    assert got.n == h * w and abs(got.lo - 0.37) < 1e-12 and abs(got.hi - 0.37) < 1e-12


def label_loop(mask):
    out, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask), strict=True):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        out[r, c] = n
        while todo:
            a, b = todo.pop()
            for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    todo.append((p, q))
    return out


def opening_loop(mask, n):
    m = np.pad(mask, n + 1)
    for fold, times in ((np.all, n), (np.any, n)):
        for _ in range(times):
            near = np.stack([np.roll(np.roll(m, a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)])
            m = fold(near, axis=0)
    return m[n + 1 : -n - 1, n + 1 : -n - 1]


@pytest.mark.parametrize("density,iterations,block", [(0.62, 0, 8), (0.9, 1, 8), (0.95, 2, 16), (0.55, 0, 5)])
def test_components_match_flood_fill(spark, density, iterations, block):
    mask = RNG.random((41, 37)) < density
    rows = [("s", 1, int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)]
    df = frame(spark, rows, "scene_id string, risk_class int, row int, col int")
    labelled, mapping = Z.label_zones(df, iterations, block)
    got = {(r.row, r.col): r.zone for r in Z.with_zone(labelled, mapping).collect()}
    opened = opening_loop(mask, iterations) if iterations else mask
    assert set(got) == {(int(r), int(c)) for r, c in zip(*np.nonzero(opened), strict=True)}
    want = label_loop(opened)
    for n in range(1, want.max() + 1):
        cells = list(zip(*np.nonzero(want == n), strict=True))
        assert {got[int(r), int(c)] for r, c in cells} == {min(int(r) * BL.KEY_BASE + int(c) for r, c in cells)}
    rings = Z.zone_rings(Z.zone_edges(labelled, mapping), 0.0).select("zone", G.polygon_area(F.col("rings")).alias("area")).collect()
    sizes = {min(int(r) * BL.KEY_BASE + int(c) for r, c in zip(*np.nonzero(want == n), strict=True)): int((want == n).sum()) for n in range(1, want.max() + 1)}
    assert {r.zone: r.area for r in rings} == {k: float(v) for k, v in sizes.items()}


@pytest.mark.parametrize("small", [100_000, 20, 0])
def test_connected_long_chain_and_star(spark, small):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001)]
    got = {r.node: r.root for r in connected(frame(spark, edges, "a long, b long"), small=small).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5001] == 5000


def hand_made(spark):
    cls = np.zeros((60, 60), int)
    cls[5:15, 5:15], cls[30:50, 30:40], cls[40:45, 5:10], cls[0, 59] = 2, 3, 1, 2
    rows = [("s", r, c, *[0.85 if cls[r, c] == k else 0.05 for k in range(4)], 10.0, True) for r in range(60) for c in range(60)]
    risk = frame(spark, rows, "scene_id string, row int, col int, p0 double, p1 double, p2 double, p3 double, onset double, valid boolean")
    scenes = frame(spark, [("s", 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 32643)], "scene_id string, a double, b double, c double, d double, e double, f double, epsg int")
    return risk, scenes


def test_hand_made_class_map_gives_exact_zones(spark):
    risk, scenes = hand_made(spark)
    acres = 900 / K.SQM_PER_ACRE
    z = Z.number_zones(Z.extract_zones(risk, scenes, min_acres=1.0, block=16)).orderBy("zone_id").collect()
    assert [(r.zone_id, r.risk_class, r.n_pixels) for r in z] == [("z-001", 3, 200), ("z-002", 2, 100), ("z-003", 1, 25)]
    for r in z:
        assert r.risk_score == 0.95 and r.days_to_onset == 10.0 and r.area_acres == round(r.n_pixels * acres, 3)
    assert z[1].recommended_action == "Apply targeted preventative fungicide within 7 days"
    p = {r.risk_class: r for r in Z.extract_zones(risk, scenes, block=16, area="polygon").collect()}
    assert {k: r.area_acres for k, r in p.items()} == {k.risk_class: k.area_acres for k in z}
    lon, lat = p[2].coordinates[0][0]
    assert abs(lon - 75.0) < 0.01 and abs(lat - 30.91) < 0.02
    s = Z.job_summary(risk, Z.extract_zones(risk, scenes, block=16), acres).first()
    assert (s.n_healthy, s.n_early_stress, s.n_high_blight_risk, s.n_visible_disease) == (0, 1, 1, 1)
    assert Z.extract_zones(risk, scenes, min_acres=30.0, block=16).count() == 1


def test_smoothing_matches_numpy(spark):
    a = RNG.normal(size=(23, 19))
    rows = [("s", r, c, float(a[r, c])) for r in range(23) for c in range(19)]
    px = frame(spark, rows, "scene_id string, row int, col int, v double")
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    w /= w.sum()
    pad = np.pad(a, 4, mode="edge")
    pad = sum(w[k] * pad[k : k + 23] for k in range(9))
    want = sum(w[k] * pad[:, k : k + 19] for k in range(9))
    for block in (6, 64):
        got = BL.smooth(px, "v", GR.scene_sizes(px), 1.0, block).collect()
        assert len(got) == 23 * 19
        for r in got:
            assert abs(r.smoothed - want[r.row, r.col]) < 1e-12


def test_field_runs_match_point_in_polygon(spark):
    ring = [(3.2, -2.1), (17.8, -4.4), (12.1, -9.7), (18.3, -15.2), (5.5, -17.9), (8.1, -9.1), (3.2, -2.1)]
    hole = [(9.3, -5.3), (12.2, -6.1), (10.4, -8.2), (9.3, -5.3)]
    f = frame(spark, [("f", "s", [[[list(p) for p in ring], [list(p) for p in hole]]])], "field_id string, scene_id string, polygons array<array<array<array<double>>>>")
    g = frame(spark, [("s", 1.0, 0.0, -1.0, 0.0, 16, 14)], "scene_id string, a double, c double, e double, f double, height int, width int")
    px = spark.range(16 * 14).select(F.lit("s").alias("scene_id"), F.expr("cast(id div 14 as int)").alias("row"), (F.col("id") % 14).cast("int").alias("col"))
    got = {(r.row, r.col) for r in AO.pixels_in_fields(px, f, g).collect()}
    want = px.withColumns({"x": F.col("col") + 0.5, "y": -(F.col("row") + 0.5)}).join(f.select("polygons")).filter(
        F.exists("polygons", lambda p: G.point_in_polygon(F.col("x"), F.col("y"), p))).collect()
    assert got == {(r.row, r.col) for r in want} and got


# ------------------------------------------------------------------ projection


def test_projection_known_points(spark):
    df = frame(spark, [(75.0, 0.0, 32643), (75.0, 30.9, 32643), (9.0, -45.0, 32732), (0.0, 60.0, 32631)], "lon double, lat double, epsg int")
    r = P.with_utm(df, F.col("lon"), F.col("lat"), F.col("epsg")).collect()
    assert abs(r[0].x - 500000) < 1e-6 and abs(r[0].y) < 1e-6
    # Meridian arc length from the equator by numerical integration of the radius of curvature.
    e2 = G.WGS84_F * (2 - G.WGS84_F)
    phi = np.linspace(0, np.radians(30.9), 200001)
    m = G.WGS84_A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = np.sum((m[1:] + m[:-1]) / 2 * np.diff(phi))
    assert abs(r[1].y - 0.9996 * arc) < 1e-3 and abs(r[1].x - 500000) < 1e-6
    assert abs(r[2].y - (1e7 - 0.9996 * np.interp(1, [0, 1], [0, 4984944.378]))) < 1 and abs(r[3].x - 332705.179) < 1e-2
    back = P.with_lonlat(P.with_utm(df, F.col("lon"), F.col("lat"), F.col("epsg")), F.col("x"), F.col("y"), F.col("epsg"), "lon2", "lat2").collect()
    assert all(abs(b.lon - b.lon2) < 1e-11 and abs(b.lat - b.lat2) < 1e-11 for b in back)


def test_grid_plan_bounds_and_tiles(spark):
    g = frame(spark, [("s", 32643, 30.0, 0.0, 500000.0, 0.0, -30.0, 3420000.0, 128, 128)],
              "scene_id string, epsg int, a double, b double, c double, d double, e double, f double, width int, height int")
    b = GR.lonlat_bounds(g).first()
    assert abs(b.west - 75.0) < 1e-6 and 30.87 < b.south < b.north < 30.92 and b.east > 75.03
    assert GR.plan_grid(g).first().unchanged
    other = GR.plan_grid(g, epsg=32644, resolution=30.0).first()
    assert not other.unchanged and other.dst.epsg == 32644 and 128 <= other.dst.width <= 140
    t = P.with_mercator_tile(frame(spark, [(75.0, 30.9)], "lon double, lat double"), F.col("lon"), F.col("lat"), F.lit(12)).first()
    n = 2**12
    assert t.x == int((75.0 + 180) / 360 * n)
    assert t.y == int((1 - math.log(math.tan(math.radians(30.9)) + 1 / math.cos(math.radians(30.9))) / math.pi) / 2 * n)


def test_reprojection_round_trip_is_near(spark):
    px = spark.range(40 * 30).select(F.lit("s").alias("scene_id"), F.expr("cast(id div 30 as int)").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.col("id").alias("k"))
    g = frame(spark, [("s", 32643, 30.0, 0.0, 700000.0, 0.0, -30.0, 3420000.0, 30, 40)],
              "scene_id string, epsg int, a double, b double, c double, d double, e double, f double, width int, height int")
    plan = GR.plan_grid(g, epsg=32644, resolution=30.0).select("scene_id", F.struct("epsg", "a", "b", "c", "d", "e", "f", "width", "height").alias("src"), "dst")
    out = GR.reproject(px, plan)
    d = plan.first().dst
    assert out.count() == d.width * d.height
    seen = {r.k for r in out.filter("k IS NOT NULL").collect()}
    assert len(seen) > 0.9 * 1200
    # Each fetched pixel's centre lies within one pixel of the target centre on the ground.
    chk = out.filter("k IS NOT NULL").withColumns({"x": F.lit(d.c) + 30 * (F.col("col") + 0.5), "y": F.lit(d.f) - 30 * (F.col("row") + 0.5)})
    chk = P.with_utm(P.with_lonlat(chk, F.col("x"), F.col("y"), F.lit(32644)), F.col("lon"), F.col("lat"), F.lit(32643), "sx", "sy")
    off = chk.select(F.max(F.abs(F.col("sx") - (700000 + 30 * (F.col("k") % 30 + 0.5)))).alias("dx"), F.max(F.abs(F.col("sy") - (3420000 - 30 * (F.floor(F.col("k") / 30) + 0.5)))).alias("dy")).first()
    assert off.dx <= 15.0 + 1e-6 and off.dy <= 15.0 + 1e-6


# ------------------------------------------------------------------ metrics, rules, shaping, analytics


def test_metrics_from_a_published_confusion_matrix(spark):
    cm = [[50, 2, 0, 0], [3, 20, 1, 0], [0, 4, 0, 0], [0, 0, 0, 0]]
    rows = [(t, p, cm[t][p]) for t in range(4) for p in range(4) if cm[t][p]]
    m = M.class_metrics(frame(spark, rows, "truth int, pred int, n long")).first()
    assert abs(m.overall_accuracy - 70 / 80) < 1e-12 and abs(m.f1_0 - 100 / 105) < 1e-12 and m.f1_2 == 0 and m.support_3 == 0
    assert abs(m.macro_f1 - (m.f1_0 + m.f1_1 + 0) / 3) < 1e-12 and abs(m.iou_1 - 20 / 30) < 1e-12


def test_temperature_recovers_a_known_scale(spark):
    z = RNG.normal(0, 1, (4000, 4))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(RNG.choice(4, p=q)) for q in p]
    rows = [([float(v) * 3 for v in r], t) for r, t in zip(z, y, strict=True)]
    fit = M.fit_temperature(frame(spark, rows, "logits array<double>, truth int")).first()
    assert abs(fit.temperature - 3.0) < 0.25


def test_label_rule_vector(spark):
    rows = list(zip([0, 3, 7, 8, 25, 26, 30, 0], [True] * 7 + [False], strict=True))
    df = frame(spark, rows, "d int, i boolean")
    assert [r[0] for r in df.select(rules.label_for_days(F.col("d"), F.col("i"))).collect()] == [3, 2, 2, 1, 1, 0, 0, 0]


def test_roi_case(spark):
    r = AN.roi(frame(spark, [(10.0, 100.0)], "at_risk_acres double, total_acres double")).first()
    assert (r.value_at_risk, r.blanket_cost, r.targeted_cost, r.savings, r.saved_pct) == (12500, 1450, 220, 1230, 85)


def test_augmentation_is_a_repeatable_permutation(spark):
    px = spark.range(30 * 30).select(F.lit("s").alias("scene_id"), F.expr("cast(id div 30 as int)").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.col("id").alias("k"), F.lit(30).alias("height"), F.lit(30).alias("width"))
    tiles = GR.tile_pixels(px, 8, 2)
    one, two = [sorted(map(tuple, SH.augment_geometry(tiles, 8, seed=1).select("row_off", "col_off", "i", "j", "k").collect())) for _ in range(2)]
    assert one == two
    seen = {}
    for r, c, i, j, _k in one:
        seen.setdefault((r, c), set()).add((i, j))
    assert all(v == {(i, j) for i in range(8) for j in range(8)} for v in seen.values())


def test_spectral_augmentation_bounds(spark):
    rows = [("s", 0, 0, i, 0, i % 4 != 0, [0.5] * 20) for i in range(12)]
    df = frame(spark, rows, "scene_id string, row_off int, col_off int, row int, col int, valid boolean, spectrum array<double>")
    one, two = [[r.spectrum for r in SH.augment_spectra(df, 20, seed=2).orderBy("row").collect()] for _ in range(2)]
    assert one == two
    assert all(v == [0.0] * 20 for v in one[::4]) and all(0 <= x <= 1 for v in one for x in v) and one[1] != one[2]


def test_window_draws_prefer_covered_windows(spark):
    px = spark.range(40 * 40).select(F.lit("s").alias("scene_id"), F.expr("cast(id div 40 as int)").alias("row"), (F.col("id") % 40).cast("int").alias("col"),
                                     (F.col("id") % 40 < 24).alias("labelled"), F.lit(True).alias("valid"))
    cover = SH.all_window_coverage(px, 8)
    draws = SH.sample_training_windows(GR.scene_sizes(px), cover, 60, 8, 0.9, seed=1).collect()
    assert len(draws) == 60 and all(0 <= r.row_off <= 32 and 0 <= r.col_off <= 32 for r in draws)
    assert np.mean([r.ok for r in draws]) > 0.95 and all(r.col_off <= 17 for r in draws if r.ok)


def test_padding_small_scenes(spark):
    px = frame(spark, [("s", 0, 0, 2, 1.0, True), ("s", 0, 1, 3, 2.0, True)], "scene_id string, row int, col int, cls int, onset double, valid boolean")
    out = SH.pad_scenes(px, GR.scene_sizes(px), 3).collect()
    assert len(out) == 9 and sum(r.cls == -1 and r.onset == 30.0 and not r.valid for r in out) == 7


def test_rate_limit_text():
    assert EV.parse_rate_limit("120/minute") == (120, 60) and EV.parse_rate_limit(" 5 / hours ") == (5, 3600)
    with pytest.raises(ValueError):
        EV.parse_rate_limit("fast")


def test_probe_finds_large_and_small_zones(spark):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    zs = [(0, "zone-big", 3, "visible_disease", 0.9, 1.0, "water_stress", square(10.0, 10.0, 3.0)),
          (1, "zone-small", 2, "high_blight_risk", 0.8, 5.0, "pri_decline", square(20.0, 20.0, 0.003)),
          (2, "zone-inner", 1, "early_stress", 0.4, 9.0, "pri_decline", square(11.0, 11.0, 0.5))]
    z = frame(spark, zs, "k long, zone_id string, risk_class int, risk_class_name string, risk_score double, days_to_onset double, dominant_indicator string, ring array<array<double>>")
    f = frame(spark, [("f", "North", square(19.9, 19.9, 0.2))], "field_id string, name string, boundary array<array<double>>")
    pts = frame(spark, [(1, "f", 12.9, 12.9), (2, "f", 20.001, 20.001), (3, "f", 20.004, 20.001), (4, "f", 20.05, 20.05), (5, "f", 50.0, 50.0), (6, "f", 11.2, 11.2)],
                "probe_id int, field_id string, lon double, lat double")
    got = {r.probe_id: (r.kind, r.zone_id, r.risk_class) for r in AN.probe(pts, z, f).collect()}
    assert got == {1: ("zone", "zone-big", 3), 2: ("zone", "zone-small", 2), 3: ("buffer", "zone-small", 1), 4: ("field", None, 0), 5: ("soil", None, 0), 6: ("zone", "zone-big", 3)}


def test_constant_spectrum_survives_the_whole_chain(spark):
    wl = [400.0 + 10.0 * i for i in range(211)]
    bad = [i % 17 == 3 for i in range(211)]
    df = frame(spark, [(1, [0.2] * 211), (2, [0.3] * 211), (3, [-1.0] * 211)], "id int, spectrum array<double>")
    px = df.withColumn("_bad", S.all_bands_nodata("spectrum", -1.0, [not b for b in bad]))
    px = px.withColumn("spectrum", S.clip_reflectance(S.radiance("spectrum", 1.0, 0.0), F.col("_bad")))
    px = R.savgol(R.resample(px, wl, [10.0] * 211, bad), 200).withColumn("spectrum", S.clip("spectrum"))
    got = {r.id: r for r in ST.cloud_shadow(px).collect()}
    np.testing.assert_allclose(got[1].spectrum, 0.2, atol=1e-12)
    assert not got[1].cloud and not got[1].shadow and got[2].cloud and got[3].spectrum is None


def test_cube_sink_checks_and_prunes(spark, tmp_path):
    from canopyframe.sources import cubes

    px = frame(spark, [("s", 300 * i, 10 * i, [0.1 * i, 0.2]) for i in range(4)] + [("t", 0, 0, None)], "scene_id string, row int, col int, spectrum array<double>")
    path = str(tmp_path / "cube")
    cubes.write_cube(px, path, "prisma", bands=2)
    back = cubes.read_pixels(spark, path)
    assert back.count() == 5 and back.filter("spectrum IS NULL").count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # show every pushed filter in the plan text
    win = cubes.read_pixels(spark, path, "s", (256, 0, 512, 64))
    assert sorted(r.row for r in win.collect()) == [300, 600]
    plan = win._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scene_id" in plan and "GreaterThanOrEqual(block_r,1)" in plan
    with pytest.raises(ValueError, match="source must be one of"):
        cubes.write_cube(px, path, "landsat", bands=2, mode="overwrite")
    with pytest.raises(Exception, match="expected 3 bands"):
        cubes.write_cube(px, str(tmp_path / "other"), "enmap", bands=3)
    cubes.write_bands_long(px, str(tmp_path / "long"))
    one = cubes.read_bands(spark, str(tmp_path / "long"), [500.0], wavelengths=[400.0, 500.0])
    assert {r.band for r in one.collect()} == {1} and "PartitionFilters" in one._jdf.queryExecution().toString()


def test_metadata_files(spark, tmp_path):
    from canopyframe.sources import metadata as MD

    (tmp_path / "a").mkdir()
    for name in ("EO1H_MTL_L1T.TXT", "EO1H_B010_L1T.TIF", "EO1H_B243_L1T.TIF"):
        (tmp_path / "a" / name).write_text("GROUP = X\n SUN_ELEVATION = 41.5\n ENTITY_ID = \"E1\"\n ACQUISITION_DATE = 2010-03-04\nEND_GROUP = X\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "P-METADATA.XML").write_text(
        '<root><bandID number="2"><wavelengthCenterOfBand>430.5</wavelengthCenterOfBand><FWHMOfBand>7</FWHMOfBand><GainOfBand>0</GainOfBand></bandID>'
        '<bandID number="1"><wavelengthCenterOfBand>423</wavelengthCenterOfBand><FWHMOfBand>6</FWHMOfBand><OffsetOfBand>0.1</OffsetOfBand></bandID>'
        '<bandID number="3"><FWHMOfBand>6</FWHMOfBand></bandID></root>')
    (tmp_path / "b" / "P-SPECTRAL_IMAGE.TIF").write_text("x")
    found = {r["dir"].rsplit("/", 1)[1]: r.sensor for r in MD.scan_inventory(spark, str(tmp_path)).collect()}
    assert found == {"a": "hyperion", "b": "enmap"}
    assert [r.band for r in MD.band_numbers(MD.list_files(spark, str(tmp_path))).collect()] == [10]
    m = MD.mtl_scene(MD.read_mtl(spark, str(tmp_path / "a" / "EO1H_MTL_L1T.TXT"))).first()
    assert m.sun_elevation == 41.5 and m.scene_id == "E1" and str(m.acquired_at) == "2010-03-04 00:00:00"
    x = MD.read_band_xml(spark, str(tmp_path / "b" / "P-METADATA.XML")).collect()
    assert [(r.number, r.wavelength_nm, r.gain, r.offset) for r in x] == [(1, 423.0, 1e-4, 0.1), (2, 430.5, 1e-4, 0.0)]
    (tmp_path / "f.geojson").write_text('{"type":"Feature","properties":{"name":"n"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}')
    g = MD.read_geojson(spark, str(tmp_path / "f.geojson")).first()
    assert g.properties == {"name": "n"} and g.polygons[0][0][1] == [1.0, 0.0] and g.error is None


def test_percentiles_ignore_nan_and_keep_infinity(spark):
    rows = [("a", float(v)) for v in range(1, 11)] + [("a", float("nan"))] * 4 + [("a", None)]
    rows += [("b", v) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("inf"))] + [("c", float("nan"))]
    got = {r.k: r for r in Q.exact_percentiles(frame(spark, rows, "k string, v double"), ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    assert (got["a"].n, got["a"].q1) == (10, 5.5) and set(got) == {"a", "b"}
    assert (got["b"].q0, got["b"].q1, got["b"].q2) == (float("-inf"), 2.0, float("inf"))


def test_missing_statistics_leave_pixels_unchanged(spark):
    px = frame(spark, [("s", 0, 0, [0.2, 0.4]), ("s", 0, 1, [0.6, 0.8]), ("t", 0, 0, [5.0, 7.0])], "scene_id string, row int, col int, spectrum array<double>")
    stats = ST.band_stats(px.filter("scene_id = 's'"), keys=["scene_id"])
    got = {(r.scene_id, r.col): r.spectrum for r in ST.apply_scaling(px, stats, ["scene_id"]).collect()}
    assert len(got) == 3 and got["t", 0] == [5.0, 7.0] and got["s", 0] == [0.0, 0.0]
    dark = ST.dark_values(px.filter("scene_id = 's'"), fraction=0.0)
    got = {(r.scene_id, r.col): r.spectrum for r in ST.subtract_dark_values(px, dark).collect()}
    assert got["t", 0] == [5.0, 7.0] and got["s", 0] == [0.0, 0.0]
    assert ST.apply_scaling(px, ST.band_stats(px)).count() == 3


def test_wide_halo_reaches_over_small_blocks(spark):
    a = RNG.random((40, 33))
    px = frame(spark, [("s", r, c, float(a[r, c])) for r in range(40) for c in range(33)], "scene_id string, row int, col int, v double")
    maps = {}
    for block in (16, 256):
        maps[block] = {(r.row, r.col): r.smoothed for r in BL.smooth(px, "v", GR.scene_sizes(px), 5.0, block).collect()}
    assert maps[16].keys() == maps[256].keys() and max(abs(maps[16][k] - maps[256][k]) for k in maps[16]) < 1e-12


def test_ragged_spectra_are_named(spark):
    px = frame(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "id int, spectrum array<double>")
    with pytest.raises(Exception, match="a spectrum of 1 values where 2 are needed"):
        R.apply_matrix(px.coalesce(1), np.eye(2)).collect()


def test_canonical_resampling_of_unsorted_bands(spark):
    wl = [700.0, 500.0, 900.0, 600.0]
    x = [0.7, 0.5, 0.9, 0.6]
    px = frame(spark, [(1, x)], "id int, spectrum array<double>")
    for fill, outer in (("edge", None), ("zero", 0.0)):
        out, covered = R.resample_canonical(px, wl, "linear", fill, [450.0, 500.0, 550.0, 800.0, 1000.0])
        v = out.first().spectrum
        assert covered == [False, True, True, True, False]
        assert v[1:4] == pytest.approx([0.5, 0.55, 0.8])
        assert (v[0], v[4]) == ((v[1], v[3]) if outer is None else (0.0, 0.0))
    bridged, _ = R.resample_canonical(px, wl, "gaussian", "edge", [500.0, 550.0])
    assert bridged.first().spectrum == pytest.approx([0.5, 0.55], abs=1e-3)

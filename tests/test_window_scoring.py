"""Window models over runs of sorted rows, and the linear scorer by matrix product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import score as SC

BANDS = 3


def scenes(spark):
    """Two scenes of 21 x 13 and 8 x 8 pixels with holes, and an 8 x 8 one without a valid pixel; one key is NULL."""
    rng = np.random.default_rng(4)
    rows = []
    for name, h, w in (("a", 21, 13), (None, 8, 8), ("empty", 8, 8)):
        for r in range(h):
            for c in range(w):
                ok = name != "empty" and (r * 5 + c) % 7 != 0
                rows.append((name, r, c, h, w, [float(v) for v in rng.random(BANDS)] if ok else None, ok))
    return rows, spark.createDataFrame(rows, "scene_id string, row int, col int, height int, width int, spectrum array<double>, valid boolean")


def neighbour_model():
    """Depends on the whole window, so a pixel in the wrong slot or place changes the result."""

    def factory():
        def model(x):
            total = x.sum(axis=(1, 2, 3), keepdims=True)
            probs = np.concatenate([x[:, :1] + total, x[:, 1:2] * 2, x[:, 2:3] - total, np.roll(x[:, :1], 1, axis=2)], axis=1)
            return probs, x[:, :1] * 0 + total

        return model

    return factory


def offsets(n, size, step):
    return sorted({*range(0, max(n - size, 0) + 1, step), max(n - size, 0)})


@pytest.mark.parametrize("batch", [1, 3, 32])
@pytest.mark.parametrize("arrow_rows", ["7", "10000"])
def test_windows_against_loops(spark, batch, arrow_rows):
    rows, px = scenes(spark)
    want = {}
    for name in ("a", None, "empty"):
        mine = [r for r in rows if r[0] == name]
        h, w = mine[0][3:5]
        for ro in offsets(h, 8, 6):
            for co in offsets(w, 8, 6):
                x = np.zeros((1, BANDS, 8, 8))
                inside = [r for r in mine if ro <= r[1] < ro + 8 and co <= r[2] < co + 8]
                for r in inside:
                    if r[6]:
                        x[0, :, r[1] - ro, r[2] - co] = r[5]
                if not any(r[6] for r in inside):
                    continue
                p, o = neighbour_model()()(x)
                for r in inside:
                    i, j = r[1] - ro, r[2] - co
                    want[name, ro, co, r[1], r[2]] = (i, j, r[6], *p[0, :, i, j], o[0, 0, i, j])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, arrow_rows)
    try:
        got = SC.score_windows(px, neighbour_model(), 8, 2, BANDS, batch).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(want)
    for g in got:
        assert (g.i, g.j, g.valid, g.p0, g.p1, g.p2, g.p3, g.onset) == pytest.approx(want[g.scene_id, g.row_off, g.col_off, g.row, g.col])


def test_windows_of_wrong_spectra_and_models(spark):
    _, px = scenes(spark)
    assert SC.score_windows(px.filter("false"), neighbour_model(), 8, 2, BANDS).count() == 0
    assert SC.score_windows(px.filter("scene_id = 'empty'"), neighbour_model(), 8, 2, BANDS).count() == 0
    with pytest.raises(Exception, match="other than 4 values"):
        SC.score_windows(px, neighbour_model(), 8, 2, BANDS + 1).collect()
    with pytest.raises(Exception, match="model returned"):
        SC.score_windows(px, lambda: lambda x: (x, x), 8, 2, BANDS).collect()


def test_linear_scores_keep_columns_and_nulls(spark):
    _, px = scenes(spark)
    w, b = [[0.5, -1.0, 2.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, -1.0]], [0.1, 0.2, 0.0, -0.3, 0.4]
    got = SC.score_linear(px, w, b)
    assert set(got.columns) == {*px.columns, "probs", "onset"}
    for r in got.collect():
        if r.spectrum is None:
            assert r.probs is None and r.onset is None
            continue
        z = np.array(w) @ r.spectrum + b
        e = np.exp(z[:4])
        assert r.probs == pytest.approx(list(e / e.sum())) and r.onset == pytest.approx(30 / (1 + np.exp(-z[4])))
    assert got.filter(F.col("spectrum").isNull()).count() > 0

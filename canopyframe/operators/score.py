"""Scoring: a per-pixel linear softmax model, any user model over windows, MLlib training."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions.rules import softmax
from canopyframe.operators.grid import tile_pixels
from canopyframe.operators.resample import apply_matrix


def score_linear(px: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> DataFrame:
    """Four class probabilities and onset days from a 5-output projection of the spectrum; NULL where there is none.

    The projection is one matrix product per Arrow batch.
    """
    n = len(K.CLASS_NAMES)
    raw = apply_matrix(px, np.asarray(weights, np.float64), out="_z")
    z = F.zip_with("_z", F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)
    out = raw.withColumn("_z", z)
    onset = K.MAX_ONSET_DAYS / (1.0 + F.exp(-F.get("_z", F.lit(n))))
    return out.withColumns({"probs": softmax(F.slice("_z", 1, n)), "onset": onset}).drop("_z")


Model = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _begins(*keys: pa.Array) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row always begins."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        code = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def score_windows(px: DataFrame, model_factory: Callable[[], Model], size: int, overlap: int, bands: int, batch: int = 32) -> DataFrame:
    """Run a window model on every non-empty window; one row per (window, pixel) comes back.

    ``model_factory`` builds the model once per task; the model maps an array
    ``[n, bands, size, size]`` to ``(probs [n, 4, size, size], onset [n, 1, size, size])``.
    ``px`` needs ``height, width, valid``; invalid pixels and NULL spectra reach the model as 0. The array
    has the precision of the spectrum column (float32 for stored cubes).

    Pixels are dealt and sorted by window, so a task meets each window as a run of rows and writes the
    runs straight into one array of ``batch`` windows: its memory does not grow with the scene.
    """
    dtype = np.float64 if "double" in dict(px.dtypes)["spectrum"] else np.float32
    window = ["scene_id", "row_off", "col_off"]
    cells = tile_pixels(px, size, overlap).select(
        F.col("scene_id").cast("string").alias("scene_id"), *[F.col(c).cast("int").alias(c) for c in ("row_off", "col_off", "i", "j")], "valid", "spectrum")
    dealt = cells.repartition(*window).sortWithinPartitions(*window)
    schema = "scene_id string, row int, col int, row_off int, col_off int, i int, j int, valid boolean, p0 double, p1 double, p2 double, p3 double, onset double"

    def fill(x: np.ndarray, rows: pa.RecordBatch, slot: np.ndarray) -> None:
        spectrum = rows.column(6)
        live = pc.and_(pc.fill_null(rows.column(5), False), spectrum.is_valid())
        known = spectrum.filter(live)
        if pc.any(pc.not_equal(pc.list_value_length(known), bands)).as_py():
            raise ValueError(f"a spectrum of other than {bands} values in scene {rows.column(0)[0]}")
        ok = live.to_numpy(zero_copy_only=False)
        i, j = (rows.column(k).to_numpy()[ok] for k in (3, 4))
        x[slot[ok], :, i, j] = known.flatten().to_numpy(zero_copy_only=False).reshape(-1, bands)

    def scored(model: Model, x: np.ndarray, parts: list[pa.RecordBatch], slots: list[np.ndarray]) -> pa.RecordBatch | None:
        rows, slot = pa.Table.from_batches(parts).combine_chunks(), np.concatenate(slots)
        valid = pc.fill_null(rows.column(5), False).to_numpy()
        used = np.bincount(slot, weights=valid) > 0
        if not used.any():
            return None
        live = x[: len(used)] if used.all() else x[: len(used)][used]
        probs, onset = model(live)
        if probs.shape != (len(live), 4, size, size) or onset.shape != (len(live), 1, size, size):
            raise ValueError(f"model returned {probs.shape} and {onset.shape}")
        kept = used[slot]
        rows, at = rows.filter(pa.array(kept)), (np.cumsum(used) - 1)[slot[kept]]
        r, c, i, j = (rows.column(k).to_numpy() for k in (1, 2, 3, 4))
        p = probs[at, :, i, j].astype(np.float64)
        return pa.RecordBatch.from_arrays([
            rows.column(0).combine_chunks(), pa.array(r + i), pa.array(c + j), *[pa.array(v) for v in (r, c, i, j)], pa.array(valid[kept]),
            *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(4)], pa.array(onset[at, 0, i, j].astype(np.float64))],
            ["scene_id", "row", "col", "row_off", "col_off", "i", "j", "valid", "p0", "p1", "p2", "p3", "onset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, x, last, begun = None, None, None, 0
        parts: list[pa.RecordBatch] = []
        slots: list[np.ndarray] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            if model is None:
                model, x = model_factory(), np.zeros((batch, bands, size, size), dtype)
            first, end = ([rows.column(k)[n].as_py() for k in range(3)] for n in (0, rows.num_rows - 1))
            begins = _begins(*[rows.column(k) for k in range(3)])
            begins[0] = first != last
            slot, last = np.cumsum(begins) - 1 + begun, end
            at = 0
            while at < len(slot):
                to = int(np.searchsorted(slot, batch))
                if to > at:
                    part = rows.slice(at, to - at)
                    fill(x, part, slot[at:to])
                    parts.append(part.select([0, 1, 2, 3, 4, 5]))
                    slots.append(slot[at:to])
                if to < len(slot):
                    out = scored(model, x, parts, slots)
                    if out is not None:
                        yield out
                    parts, slots = [], []
                    x[:] = 0
                    slot = slot - batch
                at = to
            begun = int(slot[-1]) + 1
        if parts:
            out = scored(model, x, parts, slots)
            if out is not None:
                yield out

    return dealt.mapInArrow(run, schema)


def linear_window_model(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Callable[[], Model]:
    """The linear scorer wrapped as a window model."""

    def factory() -> Model:
        w, b = np.asarray(weights, np.float64), np.asarray(bias, np.float64)

        def model(x: np.ndarray):
            z = np.einsum("ob,nbij->noij", w, x.astype(np.float64)) + b[None, :, None, None]
            e = np.exp(z[:, :-1] - z[:, :-1].max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True), K.MAX_ONSET_DAYS / (1.0 + np.exp(-z[:, -1:]))

        return model

    return factory


def fit_pixel_model(px: DataFrame, label: str = "truth", max_iter: int = 30):
    """Train a multinomial logistic regression on labelled pixel spectra with MLlib."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    lab = px.filter(F.col("spectrum").isNotNull() & F.col(label).isNotNull())
    data = lab.select(array_to_vector("spectrum").alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, family="multinomial").fit(data)


def apply_pixel_model(model, px: DataFrame) -> DataFrame:
    """Class probabilities of a fitted pixel model as an array column."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    live = px.filter(F.col("spectrum").isNotNull()).withColumn("features", array_to_vector("spectrum"))
    return model.transform(live).withColumn("probs", vector_to_array("probability")).drop("features", "rawPrediction", "probability")


def fit_onset_model(px: DataFrame, onset: str = "onset", max_iter: int = 100, epsilon: float = 1.35, reg: float = 0.0):
    """Fit days to onset on labelled pixel spectra by linear regression with Huber loss.

    Gradients are summed over partitions in a tree; outliers beyond ``epsilon`` deviations count linearly.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    known = px.filter(F.col("spectrum").isNotNull() & F.col(onset).isNotNull() & ~F.isnan(F.col(onset)))
    data = known.select(array_to_vector("spectrum").alias("features"), F.col(onset).cast("double").alias("label"))
    return LinearRegression(loss="huber", epsilon=epsilon, maxIter=max_iter, regParam=reg, aggregationDepth=3).fit(data)


def apply_onset_model(model, px: DataFrame, out: str = "onset_days") -> DataFrame:
    """Adds the fitted days to onset, clipped to the horizon; NULL where there is no spectrum."""
    from pyspark.ml.functions import array_to_vector

    live = px.filter(F.col("spectrum").isNotNull()).withColumn("features", array_to_vector("spectrum"))
    scored = model.transform(live).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(float(K.MAX_ONSET_DAYS)), F.col("prediction")))).drop("features", "prediction")
    rest = px.filter(F.col("spectrum").isNull()).withColumn(out, F.lit(None).cast("double"))
    return scored.unionByName(rest)

"""Evaluation: confusion, class metrics, calibration, losses, attribution summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import rules

CLASSES = range(len(K.CLASS_NAMES))


def align(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """Predictions next to their truth; pixels without truth or outside the mask drop out."""
    return pred.join(truth.filter(F.col("truth").isNotNull()), list(keys))


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by (truth, pred); rows without truth are ignored."""
    return df.filter(F.col("truth") >= 0).groupBy(*keys, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, per-class F1 and IoU, support, and macro means over present classes.

    Sixteen confusion cells at most, so this is one tiny aggregation into a single row.
    """
    cell = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    tr, pr = F.col("truth"), F.col("pred")
    aggs = [F.sum("n").alias("total"), cell(tr == pr).alias("hits")]
    for i in CLASSES:
        aggs += [cell((tr == i) & (pr == i)).alias(f"tp{i}"), cell((tr != i) & (pr == i)).alias(f"fp{i}"), cell((tr == i) & (pr != i)).alias(f"fn{i}")]
    row = cm.agg(*aggs)
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")), F.lit(0.0)) for i in CLASSES]
    iou = [F.coalesce(F.try_divide(F.col(f"tp{i}") * 1.0, F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")), F.lit(0.0)) for i in CLASSES]
    support = [F.col(f"tp{i}") + F.col(f"fn{i}") for i in CLASSES]

    def macro(vals: list[Column]) -> Column:
        top, n = F.lit(0.0), F.lit(0)
        for i in CLASSES:
            top, n = top + F.when(support[i] > 0, vals[i]).otherwise(0.0), n + F.when(support[i] > 0, 1).otherwise(0)
        return F.coalesce(F.try_divide(top, n), F.lit(0.0))

    return row.select(
        (F.col("hits") / F.greatest(F.lit(1), F.col("total"))).alias("overall_accuracy"), macro(f1).alias("macro_f1"), macro(iou).alias("miou"),
        *[f1[i].alias(f"f1_{i}") for i in CLASSES], *[iou[i].alias(f"iou_{i}") for i in CLASSES], *[support[i].alias(f"support_{i}") for i in CLASSES])


def onset_mae(df: DataFrame) -> DataFrame:
    """Mean absolute onset error over labelled pixels."""
    hit = df.filter(F.col("truth") >= 0)
    return hit.agg(F.coalesce(F.avg(F.abs(F.col("onset") - F.col("onset_truth"))), F.lit(0.0)).alias("onset_mae"), F.count(F.lit(1)).alias("n_pixels"))


def lead_time(df: DataFrame) -> DataFrame:
    """Detection, class accuracy, false alarms and onset error by days before symptoms.

    ``df``: day, infected, truth, pred, onset.
    """
    inf = F.col("infected")
    share = lambda cond, base: F.count_if(cond & base) / F.greatest(F.lit(1), F.count_if(base))
    return df.groupBy("day").agg(
        share(F.col("pred") != 0, inf).alias("detection_rate"), share(F.col("pred") == F.col("truth"), inf).alias("class_accuracy"),
        share(F.col("pred") != 0, ~inf).alias("false_alarm_rate"),
        F.coalesce(F.avg(F.when(inf, F.abs(F.col("onset") - F.col("day")))), F.lit(0.0)).alias("onset_mae"),
        F.count_if(inf).alias("n_infected"))


def calibration_error(df: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi] of the winning probability."""
    conf = F.array_max("probs")
    d = df.filter(F.col("truth").isNotNull()).select(conf.alias("conf"), (rules.first_max(F.col("probs")) == F.col("truth")).cast("double").alias("acc"))
    b = d.filter("conf > 0").withColumn("bin", F.ceil(F.col("conf") * bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("acc").alias("a"))
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def log_softmax_at(logits: Column, index: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp((z - top) / t))
    return (F.get(logits, index) - top) / t - F.log(total)


def temperature_losses(df: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Mean negative log-likelihood for every temperature of the grid, in one pass over the data."""
    lab = df.filter(F.col("truth").isNotNull())
    losses = lab.agg(*[F.avg(-log_softmax_at(F.col("logits"), F.col("truth"), t)).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])
    return losses.select(F.explode(rows).alias("r")).select("r.*")


def fit_temperature(df: DataFrame, lo: float = 0.05, hi: float = 20.0, points: int = 24, rounds: int = 4) -> DataFrame:
    """Temperature in [lo, hi] of least mean NLL: a log grid refined around its best point.

    The loss is smooth with one minimum, so each round narrows the bracket; a round reads the
    data once and returns ``points`` numbers.
    """
    a, b = math.log(lo), math.log(hi)
    best = None
    for _ in range(rounds):
        step = (b - a) / (points - 1)
        grid = [math.exp(a + step * i) for i in range(points)]
        rows = temperature_losses(df, grid).collect()  # ``points`` rows
        pick = min(range(points), key=lambda i: rows[i].nll)
        best = rows[pick]
        centre = a + step * pick
        a, b = max(math.log(lo), centre - step), min(math.log(hi), centre + step)
    return df.sparkSession.createDataFrame([(float(best.temperature), float(best.nll))], "temperature double, nll double")


def _focal(gamma: float, weights: Sequence[float] | None) -> Column:
    logp = log_softmax_at(F.col("logits"), F.col("truth"))
    loss = -logp if gamma == 0 else -F.pow(F.greatest(F.lit(0.0), 1.0 - F.exp(logp)), F.lit(float(gamma))) * logp
    w = F.lit(1.0) if weights is None else F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("truth"))
    return F.sum(loss * w) / F.greatest(F.sum(w), F.lit(1e-8))


def focal_loss(df: DataFrame, gamma: float = 2.0, weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean focal loss over labelled pixels (cross-entropy when gamma is 0)."""
    return df.filter(F.col("truth").isNotNull()).agg(_focal(gamma, weights).alias("focal"))


def huber(error: Column, delta: float = 2.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def _mean_huber(delta: float) -> Column:
    return F.coalesce(F.avg(huber(F.col("onset") - F.col("onset_truth"), delta)), F.lit(0.0))


def huber_loss(df: DataFrame, delta: float = 2.0) -> DataFrame:
    """Mean Huber loss of the onset over labelled pixels; 0 when there are none."""
    return df.filter(F.col("truth").isNotNull()).agg(_mean_huber(delta).alias("huber"))


def combined_loss(df: DataFrame, gamma: float = 2.0, onset_weight: float = 0.1, delta: float = 2.0, weights: Sequence[float] | None = None) -> DataFrame:
    """Class loss plus weighted onset loss, in one pass."""
    both = df.filter(F.col("truth").isNotNull()).agg(_focal(gamma, weights).alias("loss_cls"), _mean_huber(delta).alias("loss_onset"))
    return both.select((F.col("loss_cls") + onset_weight * F.col("loss_onset")).alias("total"), "loss_cls", "loss_onset")


def class_breakdown(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of pixels per class, and the mean onset of stressed pixels (all pixels if none)."""
    total = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.avg(F.when(F.col("cls").isin(1, 2), F.col("onset"))), F.avg("onset")).alias("mean_onset"))
    per = df.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("_c"))
    return per.join(total, list(keys)).withColumn("share_pct", 100.0 * F.col("_c") / F.col("_n")).drop("_c", "_n")


def band_importance(attr: DataFrame, bands: int) -> DataFrame:
    """Share of absolute attribution per band; uniform when everything is zero.

    ``attr``: (band, value) long. The window runs over one row per band, a few hundred at most.
    """
    s = attr.groupBy("band").agg(F.sum(F.abs("value")).alias("mass"))
    s = s.withColumn("total", F.sum("mass").over(Window.partitionBy(F.lit(0))))
    share = F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(1.0 / bands)
    return s.select("band", share.alias("importance"))


def indicator_scores(importance: DataFrame, wavelengths: Sequence[float]) -> DataFrame:
    """Mean importance per band inside each indicator's wavelength regions."""
    wl = F.get(F.array(*[F.lit(float(w)) for w in wavelengths]), F.col("band"))
    hit = []
    for i, (name, spans) in enumerate(K.INDICATOR_REGIONS_NM):
        inside = F.lit(False)
        for lo, hi in spans:
            inside = inside | wl.between(lo, hi)
        hit.append(F.when(inside, F.struct(F.lit(name).alias("indicator"), F.lit(i).alias("ord"))))
    rows = importance.select("importance", F.explode(F.array_compact(F.array(*hit))).alias("h"))
    return rows.groupBy("h.indicator", "h.ord").agg(F.avg("importance").alias("score"))


def dominant_region(scores: DataFrame) -> DataFrame:
    """Indicator of the highest score; the first in order wins a tie."""
    return scores.agg(F.max_by("indicator", F.struct("score", -F.col("ord"))).alias("indicator"))


def region_mean(df: DataFrame, value: str, region: str, keys: Sequence[str]) -> DataFrame:
    """Mean of a value over a region mask per key; an empty region counts as one pixel."""
    m = F.coalesce(F.col(region).cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("mean"))


def top_bands(importance: DataFrame, wavelengths: Sequence[float], k: int = 10) -> DataFrame:
    """The k most important bands with their wavelengths."""
    wl = F.get(F.array(*[F.lit(float(w)) for w in wavelengths]), F.col("band"))
    return importance.withColumn("wavelength_nm", wl).orderBy(F.desc("importance"), F.desc("band")).limit(k)

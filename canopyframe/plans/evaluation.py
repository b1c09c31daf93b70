"""Registered queries for scoring, evaluation and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.functions import rules
from canopyframe.operators import metrics as M
from canopyframe.operators import quality as Q
from canopyframe.operators import score as SC
from canopyframe.operators import stats as ST
from canopyframe.operators import stitch as SW
from canopyframe.operators.grid import scene_sizes
from canopyframe.plans import adapters as A
from canopyframe.plans.adapters import big, rnd
from canopyframe.plans.registry import query, r4, r6, with_ctes

PK = ["scene_id", "row", "col"]
PKQ = 'scene_id, "row", col'
WL = A.FX_WAVELENGTHS
# A fixed 5 x 64 projection for the linear scorer.
WEIGHTS = [[((i * 7 + o * 13) % 11 - 5) / 10.0 for i in range(64)] for o in range(5)]
BIAS = [0.1, -0.2, 0.05, 0.0, 0.3]


def dot(o: int) -> str:
    return f"({BIAS[o]} + list_sum(list_transform(s, lambda x, i: x * ((((i - 1) * 7 + {o * 13}) % 11 - 5) / 10.0::DOUBLE))))"


LIN_SQL = f"""
lz AS (SELECT {PKQ}, {', '.join(f'{dot(o)} AS z{o}' for o in range(5))} FROM px WHERE s IS NOT NULL),
lp AS (SELECT {PKQ}, {', '.join(f'exp(z{o}) / (exp(z0) + exp(z1) + exp(z2) + exp(z3)) AS p{o}' for o in range(4))}, 30.0 / (1.0 + exp(-z4)) AS onset FROM lz)"""


@query("p34_linear_scorer", with_ctes(A.PX_SQL, LIN_SQL, body=f"SELECT {PKQ}, {', '.join(f'{r6(f'p{o}')} AS p{o}' for o in range(4))}, {r6('onset')} AS onset FROM lp"))
def _(t):
    s = SC.score_linear(A.pixels(t).filter("spectrum IS NOT NULL"), WEIGHTS, BIAS)
    return s.select(*PK, *[rnd(F.get("probs", F.lit(o))).alias(f"p{o}") for o in range(4)], rnd("onset").alias("onset"))


@query("x2_window_model_scoring", with_ctes(A.PX_SQL, LIN_SQL, body=f"SELECT {PKQ}, {', '.join(f'{r4(f'p{o}')} AS p{o}' for o in range(4))} FROM lp"))
def _(t):
    """A user model over 8-pixel windows, blended; a per-pixel model must survive unchanged."""
    px = A.pixels(t).select(*PK, "spectrum", F.col("spectrum").isNotNull().alias("valid"))
    px = px.join(scene_sizes(px), "scene_id")
    w = SC.score_windows(px, SC.linear_window_model(WEIGHTS, BIAS), 8, 2, 64)
    from canopyframe.functions.geometry import feather

    w = w.withColumn("weight", feather(F.col("i"), 8, 2) * feather(F.col("j"), 8, 2))
    out = SW.stitch(w, ("p0", "p1", "p2", "p3")).filter("covered")
    return out.select(*PK, *[rnd(f"p{o}", 4).alias(f"p{o}") for o in range(4)])


@query("p35_temperature_softmax", with_ctes(A.SCORED_SQL, body=f"""
SELECT {PKQ}, {', '.join(f'{r6(f"exp(z{o} / 0.5) / (exp(z0 / 0.5) + exp(z1 / 0.5) + exp(z2 / 0.5) + exp(z3 / 0.5))")} AS p{o}' for o in range(4))}, {r6('greatest(0.0, least(30.0, onset))')} AS onset FROM sc"""))
def _(t):
    p = rules.softmax(F.col("logits"), 0.5)
    d = A.scored(t).withColumn("probs", p)
    return d.select(*PK, *[rnd(F.get("probs", F.lit(o))).alias(f"p{o}") for o in range(4)], rnd(rules.clip_onset(F.col("onset"))).alias("onset"))


@query("q5_score_contract", with_ctes(A.SCORED_SQL, body=f"""
, b AS (SELECT *, p0 + p1 + p2 + p3 + CASE WHEN vec_id % 21 = 0 THEN 0.01 ELSE 0 END AS total, onset - CASE WHEN vec_id % 33 = 0 THEN 40 ELSE 0 END AS o2 FROM sc)
SELECT {PKQ}, CASE WHEN abs(total - 1) > 1e-4 THEN 'probabilities do not sum to 1' ELSE 'onset outside [0, 30]' END AS detail FROM b WHERE abs(total - 1) > 1e-4 OR o2 < 0 OR o2 > 30"""))
def _(t):
    d = A.scored(t).withColumn("probs", rules.softmax(F.col("logits")))
    d = d.withColumn("probs", F.transform("probs", lambda p, i: p + F.when((F.col("vec_id") % 21 == 0) & (i == 0), 0.01).otherwise(0.0)))
    d = d.withColumn("onset", F.col("onset") - F.when(F.col("vec_id") % 33 == 0, 40).otherwise(0))
    return Q.score_violations(d).select(*PK, "detail")


@query("j13_truth_prediction_join", with_ctes(A.SCORED_SQL, body=f"SELECT {PKQ}, CAST(truth AS INTEGER) AS truth, CAST(pred AS INTEGER) AS pred FROM sc WHERE truth IS NOT NULL"))
def _(t):
    d = A.scored(t)
    return M.align(d.select(*PK, "pred"), d.select(*PK, "truth")).select(*PK, "truth", "pred")


CM_SQL = "cm AS (SELECT truth, pred, count(*) AS n FROM sc WHERE truth IS NOT NULL GROUP BY truth, pred)"


@query("a13_confusion_matrix", with_ctes(A.SCORED_SQL, CM_SQL, body="SELECT CAST(truth AS INTEGER) AS truth, CAST(pred AS INTEGER) AS pred, n FROM cm"))
def _(t):
    return M.confusion(A.scored(t))


def _cls(i: int, kind: str) -> str:
    tp, fp, fn = (f"sum(CASE WHEN {c} THEN n ELSE 0 END)" for c in (f"truth = {i} AND pred = {i}", f"truth <> {i} AND pred = {i}", f"truth = {i} AND pred <> {i}"))
    num, den = (f"2.0 * {tp}", f"(2 * {tp} + {fp} + {fn})") if kind == "f1" else (f"1.0 * {tp}", f"({tp} + {fp} + {fn})")
    return f"coalesce({num} / nullif({den}, 0), 0)"


def _macro(kind: str) -> str:
    top = " + ".join(f"CASE WHEN support_{i} > 0 THEN {kind}_{i} ELSE 0 END" for i in range(4))
    n = " + ".join(f"CASE WHEN support_{i} > 0 THEN 1 ELSE 0 END" for i in range(4))
    return f"({top}) / ({n})"


@query("a14_class_metrics", with_ctes(A.SCORED_SQL, CM_SQL, body=f"""
, m AS (SELECT sum(CASE WHEN truth = pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS oa,
  {', '.join(f"CAST({_cls(i, 'f1')} AS DOUBLE) AS f1_{i}, CAST({_cls(i, 'iou')} AS DOUBLE) AS iou_{i}, CAST(sum(CASE WHEN truth = {i} THEN n ELSE 0 END) AS BIGINT) AS support_{i}" for i in range(4))} FROM cm)
SELECT {r6('oa')} AS overall_accuracy, {r6(_macro('f1'))} AS macro_f1, {r6(_macro('iou'))} AS miou, {', '.join(f"{r6(f'f1_{i}')} AS f1_{i}, {r6(f'iou_{i}')} AS iou_{i}, support_{i}" for i in range(4))} FROM m"""))
def _(t):
    m = M.class_metrics(M.confusion(A.scored(t)))
    return m.select(*[c if c.startswith("support") else rnd(c).alias(c) for c in m.columns])


@query("a15_onset_mae", with_ctes(A.SCORED_SQL, body=f"SELECT {r6('avg(abs(onset - day))')} AS onset_mae, count(*) AS n_pixels FROM sc WHERE truth IS NOT NULL"))
def _(t):
    return M.onset_mae(A.scored(t).withColumn("onset_truth", F.col("day").cast("double"))).withColumn("onset_mae", rnd("onset_mae"))


@query("a16_lead_time_curve", with_ctes(A.SCORED_SQL, body=f"""
, d AS (SELECT *, vec_id % 3 <> 0 AS inf, coalesce(truth, 0) AS tr FROM sc)
SELECT CAST(day AS INTEGER) AS day, {r6('count(*) FILTER (WHERE inf AND pred <> 0) / greatest(1, count(*) FILTER (WHERE inf))')} AS detection_rate,
  {r6('count(*) FILTER (WHERE inf AND pred = tr) / greatest(1, count(*) FILTER (WHERE inf))')} AS class_accuracy,
  {r6('count(*) FILTER (WHERE NOT inf AND pred <> 0) / greatest(1, count(*) FILTER (WHERE NOT inf))')} AS false_alarm_rate,
  {r6('coalesce(avg(CASE WHEN inf THEN abs(onset - day) END), 0)')} AS onset_mae, count(*) FILTER (WHERE inf) AS n_infected FROM d GROUP BY day"""))
def _(t):
    d = A.scored(t).withColumn("infected", F.col("vec_id") % 3 != 0).withColumn("truth", F.coalesce("truth", F.lit(0)))
    m = M.lead_time(d)
    return m.select("day", *[rnd(c).alias(c) for c in ("detection_rate", "class_accuracy", "false_alarm_rate", "onset_mae")], "n_infected")


@query("a17_calibration_error", with_ctes(A.SCORED_SQL, body=f"""
, c AS (SELECT greatest(p0, p1, p2, p3) AS conf, CASE WHEN (CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END) = truth THEN 1.0 ELSE 0.0 END AS acc FROM sc WHERE truth IS NOT NULL),
b AS (SELECT ceil(conf * 15) AS bin, count(*) AS n, avg(conf) AS c, avg(acc) AS a FROM c GROUP BY 1)
SELECT {r6('sum(n * abs(c - a)) / sum(n)')} AS ece FROM b"""))
def _(t):
    d = A.scored(t).withColumn("probs", rules.softmax(F.col("logits")))
    return M.calibration_error(d).select(rnd("ece").alias("ece"))


TEMPS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
NLL = "-(CASE truth WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END / tau - ln(exp(z0 / tau) + exp(z1 / tau) + exp(z2 / tau) + exp(z3 / tau)))"


@query("a18_temperature_losses", with_ctes(A.SCORED_SQL, body=f"SELECT tau AS temperature, {r6(f'avg({NLL})')} AS nll FROM sc, (SELECT unnest({TEMPS}::DOUBLE[]) AS tau) WHERE truth IS NOT NULL GROUP BY tau"))
def _(t):
    return M.temperature_losses(A.scored(t), TEMPS).select("temperature", rnd("nll").alias("nll"))


@query("a18_temperature_fit")
def _(t):
    """Temperature of least negative log-likelihood by refined grids (one pass per round)."""
    return M.fit_temperature(A.scored(t)).select(rnd("temperature", 4).alias("temperature"), rnd("nll").alias("nll"))


LOGP = NLL.replace(" / tau", "")
FW = [1.0, 2.0, 3.0, 0.5]
FOCAL = f"""
fl AS (SELECT *, 0 - {LOGP} AS lp, ({FW}::DOUBLE[])[truth + 1] AS w, abs(onset - day) AS err FROM sc WHERE truth IS NOT NULL),
fo AS (SELECT sum(-pow(greatest(0, 1 - exp(lp)), 2) * lp * w) / sum(w) AS focal, avg(CASE WHEN err <= 2 THEN 0.5 * err * err ELSE 2 * (err - 1) END) AS huber FROM fl)"""


def _losses(t):
    return A.scored(t).withColumn("onset_truth", F.col("day").cast("double"))


@query("a19_focal_loss", with_ctes(A.SCORED_SQL, FOCAL, body=f"SELECT {r6('focal')} AS focal FROM fo"))
def _(t):
    return M.focal_loss(_losses(t), 2.0, FW).select(rnd("focal").alias("focal"))


@query("a20_huber_and_combined_loss", with_ctes(A.SCORED_SQL, FOCAL, body=f"SELECT {r6('focal + 0.1 * huber')} AS total, {r6('focal')} AS loss_cls, {r6('huber')} AS loss_onset FROM fo"))
def _(t):
    c = M.combined_loss(_losses(t), weights=FW)
    return c.select(*[rnd(n).alias(n) for n in c.columns])


# Attributions: centred pixel values stand in for model gradients.
ATTR_SQL = "atr AS (SELECT CAST(band AS INTEGER) AS band, v - 0.5 AS value FROM long), im AS (SELECT band, sum(abs(value)) / sum(sum(abs(value))) OVER () AS importance FROM atr GROUP BY band)"


def _importance(t):
    attr = ST.long_bands(A.pixels(t), PK).select("band", (F.col("v") - 0.5).alias("value"))
    return M.band_importance(attr, 64)


@query("a22_band_importance", with_ctes(A.PX_SQL, A.LONG_SQL, ATTR_SQL, body=f"SELECT band, {r6('importance')} AS importance FROM im"))
def _(t):
    return _importance(t).select("band", rnd("importance").alias("importance"))


REGIONS_SQL = """
rg(indicator, ord, lo, hi) AS (VALUES ('red_edge_shift', 0, 690.0, 760.0), ('pri_decline', 1, 520.0, 580.0), ('chlorophyll_loss', 2, 400.0, 515.0), ('chlorophyll_loss', 2, 585.0, 690.0),
  ('water_stress', 3, 940.0, 1000.0), ('water_stress', 3, 1150.0, 1250.0), ('water_stress', 3, 1350.0, 2500.0)),
rs AS (SELECT indicator, ord, avg(importance) AS score FROM im JOIN rg ON 400.0 + 20.0 * band BETWEEN lo AND hi GROUP BY indicator, ord)"""


@query("a23_indicator_scores", with_ctes(A.PX_SQL, A.LONG_SQL, ATTR_SQL, REGIONS_SQL, body=f"SELECT indicator, {r6('score')} AS score FROM rs"))
def _(t):
    return M.indicator_scores(_importance(t), WL).select("indicator", rnd("score").alias("score"))


@query("a23_dominant_region", with_ctes(A.PX_SQL, A.LONG_SQL, ATTR_SQL, REGIONS_SQL, body="SELECT indicator FROM rs ORDER BY score DESC, ord LIMIT 1"))
def _(t):
    return M.dominant_region(M.indicator_scores(_importance(t), WL))


@query("a24_region_mean", with_ctes(A.SCORED_SQL, body=f"SELECT scene_id, {r6('sum((1 - p0) * CASE WHEN pred > 0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN pred > 0 THEN 1 ELSE 0 END), 1)')} AS mean FROM sc GROUP BY scene_id"))
def _(t):
    d = A.scored(t).withColumn("risk", 1.0 - F.get(rules.softmax(F.col("logits")), F.lit(0))).withColumn("region", F.col("pred") > 0)
    return M.region_mean(d, "risk", "region", ["scene_id"]).withColumn("mean", rnd("mean"))


@query("t4_top_bands", with_ctes(A.PX_SQL, A.LONG_SQL, ATTR_SQL, body=f"SELECT band, {r6('importance')} AS importance, 400.0::DOUBLE + 20 * band AS wavelength_nm FROM im ORDER BY importance DESC, band DESC LIMIT 10"))
def _(t):
    return M.top_bands(_importance(t), WL, 10).select("band", rnd("importance").alias("importance"), "wavelength_nm")


@query("x5_pixel_model_training")
def _(t):
    """MLlib multinomial regression on labelled spectra: correct pixels per class."""
    px = A.pixels(t).withColumn("truth", (F.col("label") % 4).cast("int"))
    out = SC.apply_pixel_model(SC.fit_pixel_model(px), px)
    hit = rules.first_max(F.col("probs")) == F.col("truth")
    return out.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), big(F.count_if(hit)).alias("n_correct"))


@query("x5_onset_regression", with_ctes(A.PX_SQL, body="SELECT count(*) AS n_pixels, TRUE AS beats_mean, TRUE AS within_horizon FROM px"))
def _(t):
    """Days to onset by Huber regression on spectra, some labels far off: closer to the clean values than their mean."""
    clean = 30.0 * F.get("spectrum", F.lit(4))
    label = F.when(F.col("vec_id") % 10 == 3, 500.0).otherwise(clean)
    px = A.pixels(t).withColumns({"clean": clean, "label_days": label})
    out = SC.apply_onset_model(SC.fit_onset_model(px, "label_days"), px)
    middle = px.agg(F.avg("label_days").alias("m")).first()["m"]
    return out.withColumn("m", F.lit(middle)).agg(F.count(F.lit(1)).alias("n_pixels"), (F.avg(F.abs(F.col("onset_days") - F.col("clean"))) < F.avg(F.abs(F.col("m") - F.col("clean")))).alias("beats_mean"),
                   F.bool_and(F.col("onset_days").isNull() | F.col("onset_days").between(0.0, 30.0)).alias("within_horizon"))


@query("t7_exact_sample", with_ctes(A.PX_SQL, body="SELECT vec_id FROM px ORDER BY CAST('0x' || substr(md5('4:' || vec_id), 1, 15) AS BIGINT), vec_id LIMIT 200"))
def _(t):
    """Exactly 200 pixels drawn without replacement by hash."""
    return ST.cap_sample(A.pixels(t), 200, ["vec_id"], seed=4).select("vec_id")



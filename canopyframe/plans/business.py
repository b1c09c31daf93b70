"""Registered queries over zones, fields, jobs, scenes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe.constants import CLASS_NAMES
from canopyframe.functions import bandmath as B
from canopyframe.functions import rules
from canopyframe.operators import analytics as AN
from canopyframe.operators import events as EV
from canopyframe.operators import quality as Q
from canopyframe.operators import registry as RG
from canopyframe.plans import adapters as A
from canopyframe.plans.adapters import rnd
from canopyframe.plans.registry import query, r4, r6, with_ctes
from canopyframe.sources import metadata as MD
from canopyframe.sources import sinks as SK
from canopyframe.streaming.job_events import work_folder

# ------------------------------------------------------------------ zone rules and lookups

ACTION_SQL = f"""(CASE risk_class WHEN 3 THEN '{rules.ACTION_VISIBLE}' WHEN 2 THEN '{rules.ACTION_HIGH}' || CASE WHEN days_to_onset < 7 THEN '48 hours' ELSE '7 days' END
  WHEN 1 THEN '{rules.ACTION_EARLY}' ELSE '{rules.ACTION_NONE}' END || CASE WHEN dominant_indicator = 'water_stress' AND risk_class <> 0 THEN '{rules.ACTION_IRRIGATION}' ELSE '' END)"""


def case_sql(key: str, table: dict) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lit = lambda k: quote(k) if isinstance(k, str) else str(k)
    return f"(CASE {key} {' '.join(f'WHEN {lit(k)} THEN {quote(v)}' for k, v in table.items() if k is not None)} ELSE {quote(table[None])} END)"


def zones_with_action(t):
    z = A.zones(t)
    return z.withColumn("recommended_action", rules.recommended_action(F.col("risk_class"), F.col("days_to_onset"), F.col("dominant_indicator")))


ZA_SQL = f"za AS (SELECT *, {ACTION_SQL} AS recommended_action FROM zn)"


@query("p29_recommended_action", with_ctes(A.ZONES_SQL, body=f"SELECT zone_id, {ACTION_SQL} AS recommended_action FROM zn"))
def _(t):
    return zones_with_action(t).select("zone_id", "recommended_action")


@query("p30_prescription", with_ctes(A.ZONES_SQL, body=f"SELECT zone_id, {case_sql('risk_class', rules.COMPOUNDS)} AS prescribed_compound, {case_sql('risk_class', rules.DOSAGES)} AS vra_drone_dosage FROM zn"))
def _(t):
    return AN.prescription(A.zones(t)).select("zone_id", "prescribed_compound", "vra_drone_dosage")


@query("p31_indicator_text", with_ctes(A.ZONES_SQL, body=f"""
, i AS (SELECT zone_id, CASE WHEN k % 9 = 0 THEN 'other' ELSE dominant_indicator END AS ind FROM zn)
SELECT zone_id, {case_sql('ind', rules.INDICATOR_LABELS)} AS indicator_label, {case_sql('ind', rules.INDICATOR_ADVICE)} AS indicator_advice FROM i"""))
def _(t):
    """Labels and advice; the older spelling of the photochemical indicator is accepted."""
    ind = F.when(F.col("k") % 9 == 0, "other").when(F.col("dominant_indicator") == "pri_decline", "pri_drop").otherwise(F.col("dominant_indicator"))
    z = AN.indicator_text(A.zones(t).withColumn("dominant_indicator", ind))
    return z.select("zone_id", "indicator_label", "indicator_advice")


@query("p33_horizon_label", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity - 1 = 0 THEN 'Today (Visible Outbreak)' WHEN l_quantity - 1 <= 7 THEN 'Acute Blight Spread' ELSE 'Pre-Visual Incubation' END AS label FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.horizon_label(F.col("l_quantity") - 1).alias("label"))


# ------------------------------------------------------------------ zone filters, sorts, statistics


def _filter_query(mode, cond):
    @query(f"f5_zones_{mode}", with_ctes(A.ZONES_SQL, body=f"SELECT zone_id, risk_class FROM zn WHERE {cond}"))
    def _(t):
        return AN.filter_zones(A.zones(t), mode).select("zone_id", "risk_class")


_filter_query("all", "TRUE")
_filter_query("urgent", "risk_class > 0 AND days_to_onset <= 7")
_filter_query("high_risk", "risk_class >= 2")
_filter_query("early_stress", "risk_class = 1")
_filter_query("healthy", "risk_class = 0")


@query("f5_zones_with_horizon", with_ctes(A.ZONES_SQL, body="SELECT zone_id, risk_class FROM zn WHERE risk_class >= 2 AND (risk_class = 0 OR days_to_onset >= 30 - 20)"))
def _(t):
    return AN.filter_zones(A.zones(t), "high_risk", 20).select("zone_id", "risk_class")


@query("f6_zone_search", with_ctes(A.ZONES_SQL, ZA_SQL, body="SELECT zone_id FROM za WHERE contains(lower(zone_id), 'fungi') OR contains(lower(dominant_indicator), 'fungi') OR contains(lower(recommended_action), 'fungi') OR contains(lower(risk_class_name), 'fungi')"))
def _(t):
    return AN.search_zones(zones_with_action(t), "FUNGI").select("zone_id")


@query("f7_visible_at_horizon", with_ctes(A.ZONES_SQL, body="SELECT zone_id FROM zn WHERE risk_class = 0 OR days_to_onset >= 30 - 14"))
def _(t):
    return AN.visible_at(A.zones(t), 14).select("zone_id")


J11_SQL = "jz AS (SELECT zn.*, fd.field_id, fd.fk, fd.cx, fd.cy, fd.acres, fd.name FROM zn JOIN fd ON abs(x0 - cx) < 0.25 AND abs(y0 - cy) < 0.25)"


def in_fields(t):
    return AN.zones_in_field(A.zones(t), A.fields(t))


@query("j11_zone_field_band_join", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, J11_SQL, body="SELECT zone_id, field_id FROM jz"))
def _(t):
    return in_fields(t).select("zone_id", "field_id")


def _kpi_sql() -> str:
    # Exact sums: rounding at a half must not depend on the order of addition.
    acres = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN CAST(area_acres AS DECIMAL(28, 9)) END), 0) AS DOUBLE)"
    return f"""kp AS (SELECT field_id, {', '.join(f'{acres(f"risk_class = {i}")} AS {CLASS_NAMES[i]}_acres' for i in (1, 2, 3))}, {acres('risk_class IN (1, 2, 3)')} AS at_risk_acres,
  coalesce(min(CASE WHEN risk_class > 0 AND days_to_onset > 0 AND days_to_onset < 30 THEN days_to_onset END), 30.0) AS earliest_onset, any_value(acres) AS total_acres FROM jz GROUP BY field_id)"""


@query("a25_zone_kpis", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, J11_SQL, _kpi_sql(), body=f"""
SELECT field_id, {', '.join(f'{r4(f"{CLASS_NAMES[i]}_acres")} AS {CLASS_NAMES[i]}_acres' for i in (1, 2, 3))}, {r4('at_risk_acres')} AS at_risk_acres, {r4('earliest_onset')} AS earliest_onset,
  {r4('greatest(0, total_acres - at_risk_acres)')} AS healthy_acres FROM kp"""))
def _(t):
    k = AN.field_kpis(A.zones(t), A.fields(t))
    return k.select("field_id", *[rnd(c, 4).alias(c) for c in ("early_stress_acres", "high_blight_risk_acres", "visible_disease_acres", "at_risk_acres", "earliest_onset", "healthy_acres")])


@query("a26_zone_matrix", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, J11_SQL, body=f"""
, m AS (SELECT field_id, count(*) AS total, count(*) FILTER (WHERE risk_class > 0 AND days_to_onset <= 7) AS urgent_count, sum(area_acres) AS s,
  {', '.join(f'coalesce(sum(CASE WHEN risk_class = {i} THEN area_acres END), 0) AS a{i}' for i in range(4))} FROM jz GROUP BY field_id)
SELECT field_id, total, urgent_count, {r4('round(CASE WHEN s = 0 THEN 1 ELSE s END, 1)')} AS total_acres,
  {', '.join(f'CAST(floor(a{i} / CASE WHEN s = 0 THEN 1 ELSE s END * 100 + 0.5) AS BIGINT) AS {n}_pct' for i, n in enumerate(CLASS_NAMES))} FROM m"""))
def _(t):
    m = AN.field_matrix(A.zones(t), A.fields(t))
    return m.withColumn("total_acres", rnd("total_acres", 4))


@query("a27_return_on_investment", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, J11_SQL, _kpi_sql(), body="""
, c AS (SELECT field_id, CAST(floor(at_risk_acres * 1250 + 0.5) AS BIGINT) AS value_at_risk, CAST(floor(total_acres * 14.5 + 0.5) AS BIGINT) AS blanket_cost, CAST(floor(at_risk_acres * 22 + 0.5) AS BIGINT) AS targeted_cost FROM kp)
SELECT field_id, value_at_risk, blanket_cost, targeted_cost, greatest(0, blanket_cost - targeted_cost) AS savings,
  CAST(floor(greatest(0, blanket_cost - targeted_cost) / CAST(greatest(1, blanket_cost) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS saved_pct FROM c"""))
def _(t):
    k = AN.roi(AN.field_kpis(A.zones(t), A.fields(t)))
    return k.select("field_id", "value_at_risk", "blanket_cost", "targeted_cost", "savings", "saved_pct")


@query("a28_prevented_loss", with_ctes(A.ZONES_SQL, body=f"""
, g AS (SELECT job_id, sum(CASE WHEN risk_class > 0 THEN area_acres ELSE 0 END) AS risky, min(days_to_onset) AS first, sum(round_even(area_acres, 2)) AS listed, avg(round_even(days_to_onset, 1)) AS lead FROM zn GROUP BY job_id)
SELECT job_id, {r4('risky')} AS at_risk_acres, first AS earliest_onset, CAST(floor(risky * 680 * 0.85::DOUBLE + 0.5) AS BIGINT) AS loss_prevented, {r4('lead')} AS mean_lead_days, {r4('round_even(listed * 547.0, 2)')} AS estimated_savings FROM g"""))
def _(t):
    g = AN.prevented_loss(A.zones(t), ["job_id"])
    return g.select("job_id", rnd("at_risk_acres", 4).alias("at_risk_acres"), "earliest_onset", "loss_prevented", rnd("mean_lead_days", 4).alias("mean_lead_days"), rnd("estimated_savings", 4).alias("estimated_savings"))


def _sort_query(field, direction, sql_key):
    @query(f"t5_sort_by_{field}_{direction}", with_ctes(A.ZONES_SQL, body=f"SELECT zone_id, {field if field != 'zone_id' else 'k AS k'} FROM zn ORDER BY {sql_key} {direction}, zone_id"))
    def _(t):
        z = AN.sort_matrix(A.zones(t), field, direction)
        return z.select("zone_id", field if field != "zone_id" else "k")


_sort_query("days_to_onset", "asc", "days_to_onset")
_sort_query("risk_score", "desc", "risk_score")
_sort_query("area_acres", "desc", "area_acres")
_sort_query("zone_id", "asc", "lower(zone_id)")


@query("t8_focus_zone", with_ctes(A.ZONES_SQL, body="""
, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY risk_class <> 2, k) AS n FROM zn) SELECT job_id, zone_id, risk_class FROM r WHERE n = 1"""))
def _(t):
    return AN.focus_zone(A.zones(t), ["job_id"], "k")


@query("g27_survey_route", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, J11_SQL, body=f"""
, v AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY k) AS n FROM jz WHERE risk_class >= 1 AND days_to_onset >= 30 - 25),
e AS (SELECT field_id, count(*) AS n, any_value(cy) - 0.05 AS lat, any_value(cx) - 0.05 AS lon FROM v GROUP BY field_id)
SELECT field_id, n AS position, {r6('y0')} AS lat, {r6('x0')} AS lon FROM v
UNION ALL SELECT field_id, 0, {r6('lat')}, {r6('lon')} FROM e UNION ALL SELECT field_id, n + 1, {r6('lat')}, {r6('lon')} FROM e"""))
def _(t):
    r = AN.survey_route(A.zones(t), A.fields(t), "k", 25)
    return r.select("field_id", "position", rnd("lat").alias("lat"), rnd("lon").alias("lon"))


@query("q6_zone_contract", with_ctes(A.ZONES_SQL, ZA_SQL, body="""
, b AS (SELECT zone_id, risk_class + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS rc, CASE WHEN k % 13 = 0 THEN 'odd' ELSE risk_class_name END AS nm, risk_score + CASE WHEN k % 7 = 0 THEN 1.5 ELSE 0 END AS sc,
  days_to_onset + CASE WHEN k % 19 = 0 THEN 31 ELSE 0 END AS d, CASE WHEN k % 23 = 0 THEN '' ELSE dominant_indicator END AS ind FROM za)
SELECT zone_id, 'risk_class' AS "check", CAST(rc AS VARCHAR) AS detail FROM b WHERE rc NOT BETWEEN 0 AND 3
UNION ALL SELECT zone_id, 'risk_class_name', nm FROM b WHERE nm = 'odd'
UNION ALL SELECT zone_id, 'risk_score', 'outside [0, 1]' FROM b WHERE sc NOT BETWEEN 0 AND 1
UNION ALL SELECT zone_id, 'days_to_onset', 'outside [0, 30]' FROM b WHERE d NOT BETWEEN 0 AND 30
UNION ALL SELECT zone_id, 'dominant_indicator', 'empty' FROM b WHERE ind = ''"""))
def _(t):
    k = F.col("k")
    z = zones_with_action(t).withColumns({
        "risk_class_name": F.when(k % 13 == 0, "odd").otherwise(F.col("risk_class_name")), "risk_score": F.col("risk_score") + F.when(k % 7 == 0, 1.5).otherwise(0),
        "days_to_onset": F.col("days_to_onset") + F.when(k % 19 == 0, 31).otherwise(0), "dominant_indicator": F.when(k % 23 == 0, "").otherwise(F.col("dominant_indicator"))})
    return Q.zone_violations(z.withColumn("risk_class", F.col("risk_class") + F.when(k % 11 == 0, 5).otherwise(0)))


@query("s20_zone_features")
def _(t):
    """One GeoJSON feature text per zone."""
    z = zones_with_action(t).withColumn("coordinates", F.array("ring"))
    return SK.zone_features(z)


@query("s21_spray_plan", with_ctes(A.ZONES_SQL, ZA_SQL, body=f"""
SELECT zone_id, risk_class, risk_class_name, printf('%.1f', round(risk_score * 100, 1)) AS risk_score_pct, {r4('area_acres')} AS area_acres, printf('%.1f', round(days_to_onset, 1)) AS days_to_onset,
  dominant_indicator, recommended_action, {case_sql('risk_class', rules.COMPOUNDS)} AS prescribed_compound, {case_sql('risk_class', rules.DOSAGES)} AS vra_drone_dosage FROM za"""))
def _(t):
    return SK.spray_plan(zones_with_action(t)).withColumn("area_acres", rnd("area_acres", 4))


@query("s21_csv_quoting", with_ctes(A.ZONES_SQL, body="""SELECT zone_id, zone_id || ',' || CAST(risk_class AS VARCHAR) || ',"' || replace(risk_class_name || ' "' || dominant_indicator || '"', '"', '""') || '"' AS line FROM zn"""))
def _(t):
    z = A.zones(t).withColumn("note", F.concat("risk_class_name", F.lit(' "'), "dominant_indicator", F.lit('"')))
    return z.select("zone_id", SK.csv_line(["zone_id", "risk_class", "note"], ["note"]).alias("line"))


# ------------------------------------------------------------------ probes

POINTS_SQL = """pt AS (SELECT c_custkey AS probe_id, 'field-' || c_nationkey AS field_id, c_nationkey * 0.1::DOUBLE + (c_custkey % 41 - 20) * 0.0031::DOUBLE AS lon,
  c_nationkey * 0.02::DOUBLE + (c_custkey % 37 - 18) * 0.0033::DOUBLE AS lat FROM customer)"""
# Zones for probing: small squares around the fields so that all four cases occur.
PZ_SQL = """pz AS (SELECT zone_id, k, risk_class, risk_class_name, risk_score, days_to_onset, dominant_indicator,
  (k % 25) * 0.1::DOUBLE + (k % 7 - 3) * 0.01::DOUBLE AS zx, (k % 25) * 0.02::DOUBLE + (k % 5 - 2) * 0.012::DOUBLE AS zy FROM zn)"""
PROBE_SQL = """
hit AS (SELECT probe_id, min(k) AS hk FROM pt JOIN pz ON lon >= zx AND lon < zx + 0.003::DOUBLE AND lat >= zy AND lat < zy + 0.003::DOUBLE GROUP BY probe_id),
ctr AS (SELECT *, (zx + (zx + 0.003::DOUBLE) + (zx + 0.003::DOUBLE) + zx + zx) / 5 AS mx, (zy + zy + (zy + 0.003::DOUBLE) + (zy + 0.003::DOUBLE) + zy) / 5 AS my FROM pz),
dist AS (SELECT probe_id, k, sqrt((lon - mx) * (lon - mx) + (lat - my) * (lat - my)) AS d FROM pt JOIN ctr ON abs(lon - mx) < 0.01 AND abs(lat - my) < 0.01),
nr AS (SELECT probe_id, min_by(k, (d, k)) AS nk FROM dist WHERE d < 0.004 GROUP BY probe_id),
pb AS (SELECT pt.*, fd.name AS field_name, hk, nk, coalesce(lon >= cx - 0.05 AND lon < cx + 0.05 AND lat >= cy - 0.05 AND lat < cy + 0.05, FALSE) AS inf
  FROM pt LEFT JOIN fd USING (field_id) LEFT JOIN hit USING (probe_id) LEFT JOIN nr USING (probe_id)),
pk AS (SELECT pb.*, CASE WHEN hk IS NOT NULL THEN 'zone' WHEN inf AND nk IS NOT NULL THEN 'buffer' WHEN inf THEN 'field' ELSE 'soil' END AS kind FROM pb),
pr AS (SELECT pk.probe_id, kind, CASE kind WHEN 'zone' THEN h.zone_id WHEN 'buffer' THEN n.zone_id END AS zone_id,
  CAST(CASE kind WHEN 'zone' THEN h.risk_class WHEN 'buffer' THEN 1 ELSE 0 END AS INTEGER) AS risk_class,
  CASE kind WHEN 'zone' THEN h.risk_score WHEN 'buffer' THEN round(n.risk_score * 0.65::DOUBLE, 2) WHEN 'field' THEN 0.08 ELSE 0.02 END AS risk_score,
  CASE kind WHEN 'zone' THEN h.days_to_onset WHEN 'buffer' THEN round(n.days_to_onset + 4.5, 1) ELSE 30.0 END AS days_to_onset,
  CASE kind WHEN 'zone' THEN h.dominant_indicator WHEN 'buffer' THEN n.dominant_indicator ELSE 'baseline' END AS dominant_indicator,
  CASE kind WHEN 'zone' THEN 'Zone ' || upper(replace(h.zone_id, 'zone-', '')) WHEN 'buffer' THEN 'Zone ' || upper(replace(n.zone_id, 'zone-', '')) || ' Peripheral Buffer'
    WHEN 'field' THEN field_name || ' Baseline Parcel' ELSE 'External Field Boundary (Bare Soil / Fallow)' END AS zone_name
  FROM pk LEFT JOIN pz h ON h.k = hk LEFT JOIN pz n ON n.k = nk)"""


def _points(t):
    c = t("customer")
    return c.select(
        F.col("c_custkey").alias("probe_id"), F.concat(F.lit("field-"), F.col("c_nationkey").cast("string")).alias("field_id"),
        (F.col("c_nationkey") * 0.1 + (F.col("c_custkey") % 41 - 20) * 0.0031).alias("lon"), (F.col("c_nationkey") * 0.02 + (F.col("c_custkey") % 37 - 18) * 0.0033).alias("lat"))


def _probe_zones(t):
    k = F.col("k")
    x, y = k % 25 * 0.1 + (k % 7 - 3) * 0.01, k % 25 * 0.02 + (k % 5 - 2) * 0.012
    p = lambda a, b: F.array(x + a, y + b)
    return A.zones(t).withColumn("ring", F.array(p(0.0, 0.0), p(0.003, 0.0), p(0.003, 0.003), p(0.0, 0.003), p(0.0, 0.0)))


@query("j12_point_probe", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, POINTS_SQL, PZ_SQL, PROBE_SQL, body=f"""
SELECT probe_id, kind, zone_id, risk_class, {r6('risk_score')} AS risk_score, {r6('days_to_onset')} AS days_to_onset, dominant_indicator, zone_name FROM pr"""))
def _(t):
    p = AN.probe(_points(t), _probe_zones(t), A.fields(t))
    return p.select("probe_id", "kind", "zone_id", "risk_class", rnd("risk_score").alias("risk_score"), rnd("days_to_onset").alias("days_to_onset"), "dominant_indicator", "zone_name")


def _note_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    n = rules.PROBE_NOTES
    fmt = lambda s: "'" + quote(s).replace("%.1f", "' || printf('%.1f', days_to_onset) || '").replace("%s", "0.125") + "'"
    return f"(CASE WHEN kind = 'soil' THEN {fmt(n[-1])} WHEN risk_class = 2 THEN {fmt(n[2])} WHEN risk_class = 1 THEN {fmt(n[1])} WHEN risk_class = 3 THEN {fmt(n[3])} ELSE {fmt(n[None])} END)"


@query("p36_probe_text", with_ctes(A.ZONES_SQL, A.FIELDS_SQL, POINTS_SQL, PZ_SQL, PROBE_SQL, body=f"""
SELECT probe_id, {_note_sql()} AS diagnostic_notes, {case_sql("(CASE WHEN kind = 'soil' THEN -1 ELSE risk_class END)", rules.PROBE_INTERVENTIONS)} AS recommended_intervention FROM pr"""))
def _(t):
    p = AN.probe(_points(t), _probe_zones(t), A.fields(t)).withColumn("pri", F.lit(0.125))
    return AN.probe_text(p).select("probe_id", "diagnostic_notes", "recommended_intervention")


@query("s24_probe_export", with_ctes(A.PX_SQL, A.LONG_SQL, body=f"""
SELECT vec_id AS probe_id, CAST(band + 1 AS INTEGER) AS band_index, CAST(wl AS DOUBLE) AS wavelength_nm, {r6('v')} AS reflectance FROM long"""))
def _(t):
    """One export row per probe and band; the spectrum comes from the pixel table."""
    probes = t("embeddings").select(F.col("vec_id").alias("probe_id"), *A._grid())
    rows = SK.probe_rows(AN.probe_spectra(probes, A.pixels(t)), A.FX_WAVELENGTHS)
    return rows.select("probe_id", "band_index", "wavelength_nm", rnd("reflectance").alias("reflectance"))


@query("probe_indices", with_ctes(A.PX_SQL, body="SELECT vec_id AS probe_id, s IS NOT NULL AS measured FROM px"))
def _(t):
    """Measured spectrum and indices joined to probes by pixel."""
    probes = t("embeddings").select(F.col("vec_id").alias("probe_id"), *A._grid())
    p = AN.probe_spectra(probes, A.pixels(t))
    ix = B.with_indices(p, ("ndvi", "rep"), "probe", A.FX_WAVELENGTHS)
    return ix.select("probe_id", (F.col("spectrum").isNotNull() & F.col("ndvi").isNotNull()).alias("measured"))


# ------------------------------------------------------------------ jobs and scenes


@query("f4_job_filter", with_ctes(A.JOBS_SQL, body="SELECT job_id, scene_id, field_id FROM jb WHERE status = 'succeeded' AND field_id = 'field-7'"))
def _(t):
    return RG.filter_jobs(A.jobs(t), status="succeeded", field_id="field-7").select("job_id", "scene_id", "field_id")


@query("f9_job_state_rules", with_ctes(A.JOBS_SQL, body="""
SELECT job_id, status IN ('queued', 'running', 'cancelled') AS can_cancel, status = 'cancelled' AS cancel_noop, status IN ('failed', 'cancelled') AS can_retry,
  status NOT IN ('queued', 'running') AS can_delete, status = 'succeeded' AS has_results FROM jb"""))
def _(t):
    j = RG.allowed(A.jobs(t), "cancel").withColumnsRenamed({"allowed": "can_cancel", "noop": "cancel_noop"})
    for action, name in (("retry", "can_retry"), ("delete", "can_delete"), ("results", "has_results")):
        j = RG.allowed(j, action).withColumnRenamed("allowed", name).drop("noop")
    return j.select("job_id", "can_cancel", "cancel_noop", "can_retry", "can_delete", "has_results")


@query("t2_jobs_newest_first", with_ctes(A.JOBS_SQL, body="SELECT job_id, status, CAST(created_on AS VARCHAR) AS created_on FROM jb WHERE status = 'succeeded' ORDER BY jb.created_on DESC, job_id DESC LIMIT 200 OFFSET 50"))
def _(t):
    return RG.list_jobs(A.jobs(t), status="succeeded", limit=200, offset=50).select("job_id", "status", F.col("created_on").cast("string").alias("created_on"))


@query("t3_scenes_newest_first", with_ctes(A.SCENES_SQL, body="SELECT scene_id, day FROM sn ORDER BY day DESC, scene_id LIMIT 150 OFFSET 30"))
def _(t):
    return RG.list_scenes(A.scenes(t), 150, 30).select("scene_id", "day")


@query("s11_scene_search", with_ctes(A.SCENES_SQL, body="""SELECT scene_id, day, cloud_cover FROM sn WHERE west <= 60 AND east >= -60 AND south <= 40 AND north >= -40
 AND day BETWEEN 100 AND 1200 AND cloud_cover BETWEEN 0 AND 60 ORDER BY scene_id LIMIT 50"""))
def _(t):
    return RG.search_scenes(A.scenes(t), (-60, -40, 60, 40), 100, 1200, 60).select("scene_id", "day", "cloud_cover")


RES_SQL = "js AS (SELECT jb.*, sn.name AS scene_name, fd.name AS field_name FROM jb LEFT JOIN sn USING (scene_id) LEFT JOIN fd USING (field_id))"


@query("j9_resolve_jobs", with_ctes(A.JOBS_SQL, A.SCENES_SQL, A.FIELDS_SQL, RES_SQL, body="SELECT job_id, scene_name, field_name FROM js WHERE scene_name IS NOT NULL AND field_name IS NOT NULL"))
def _(t):
    ok, _ = RG.resolve_jobs(A.jobs(t), A.scenes(t), A.fields(t))
    return ok.select("job_id", "scene_name", "field_name")


@query("j9_unresolved_jobs", with_ctes(A.JOBS_SQL, A.SCENES_SQL, A.FIELDS_SQL, RES_SQL, body="""SELECT job_id, CASE WHEN scene_name IS NULL THEN 'scene not found: ' || scene_id ELSE 'field not found: ' || field_id END AS error
 FROM js WHERE scene_name IS NULL OR field_name IS NULL"""))
def _(t):
    return RG.resolve_jobs(A.jobs(t), A.scenes(t), A.fields(t))[1]


@query("a31_job_counts", with_ctes(A.JOBS_SQL, body="SELECT status, count(*) AS n FROM jb GROUP BY status"))
def _(t):
    return RG.job_counts(A.jobs(t))


Q1_SQL = """q1 AS (
SELECT scene_id, 'bands' AS "check", CAST(bands AS VARCHAR) AS detail FROM sn WHERE bands <> 200
UNION ALL SELECT scene_id, 'dtype', dtype FROM sn WHERE dtype <> 'float32'
UNION ALL SELECT scene_id, 'nodata', CAST(nodata AS VARCHAR) FROM sn WHERE abs(nodata + 1) >= 1e-6
UNION ALL SELECT scene_id, 'crs', 'no CRS' FROM sn WHERE epsg IS NULL
UNION ALL SELECT scene_id, 'utm', CAST(epsg AS VARCHAR) FROM sn WHERE epsg IS NOT NULL AND NOT (epsg BETWEEN 32601 AND 32660 OR epsg BETWEEN 32701 AND 32760))"""
Q2_SQL = """q2 AS (
SELECT scene_id, 'contract_version' AS "check", contract_version AS detail FROM sn WHERE contract_version <> '1.0.0'
UNION ALL SELECT scene_id, 'source', source FROM sn WHERE source NOT IN ('hyperion', 'enmap', 'prisma', 'synthetic'))"""
Q3_SQL = """fb AS (SELECT 's' || sensor_id AS scene_id, band, 400.0 + 31.0 * band + CASE WHEN p_partkey % 7 = 0 THEN 0.3 ELSE 0.01 END AS got FROM sb WHERE p_partkey % 9 <> 0),
q3 AS (SELECT coalesce(w.scene_id, fb.scene_id) AS scene_id, CASE WHEN want IS NULL THEN 'wavelength_unexpected' WHEN got IS NULL THEN 'wavelength_missing' ELSE 'wavelength_off_grid' END AS "check", CAST(count(*) AS VARCHAR) AS detail
 FROM (SELECT scene_id, CAST(range AS INTEGER) AS band, 400.0 + 31.0 * range AS want FROM (SELECT DISTINCT scene_id FROM fb), range(60)) w FULL JOIN fb ON w.scene_id = fb.scene_id AND w.band = fb.band
 WHERE want IS NULL OR got IS NULL OR abs(got - want) > 0.05 GROUP BY 1, 2)"""
Q4_SQL = """fv AS (SELECT scene_id || '_' || (vec_id % 40) AS scene_id, unnest(s) AS v FROM faulty),
q4v AS (SELECT scene_id, count(*) FILTER (WHERE isnan(v) OR isinf(v)) AS bad, count(*) AS n, min(CASE WHEN NOT isnan(v) AND NOT isinf(v) THEN v END) AS lo, max(CASE WHEN NOT isnan(v) AND NOT isinf(v) THEN v END) AS hi FROM fv WHERE isnan(v) OR v <> -1 GROUP BY 1),
q4 AS (SELECT scene_id, 'not_finite' AS "check", CAST(bad AS VARCHAR) AS detail FROM q4v WHERE bad > 0
UNION ALL SELECT scene_id, 'range', 'values outside [0, 1]' FROM q4v WHERE lo < 0 OR hi > 1
UNION ALL SELECT scene_id, 'all_nodata', 'sampled pixels are all nodata' FROM (SELECT DISTINCT scene_id FROM fv) WHERE scene_id NOT IN (SELECT scene_id FROM q4v))"""


@query("q1_structure_checks", with_ctes(A.SCENES_SQL, Q1_SQL, body="SELECT * FROM q1"))
def _(t):
    return Q.structure(A.scenes(t))


@query("q2_tag_checks", with_ctes(A.SCENES_SQL, Q2_SQL, body="SELECT * FROM q2"))
def _(t):
    return Q.tags(A.scenes(t))


def _q3(t):
    fb = A.sensor_bands(t).filter("p_partkey % 9 <> 0").select(
        F.concat(F.lit("s"), F.col("sensor_id").cast("string")).alias("scene_id"), "band",
        (400.0 + 31.0 * F.col("band") + F.when(F.col("p_partkey") % 7 == 0, 0.3).otherwise(0.01)).alias("wavelength_nm"))
    return Q.wavelengths(fb, [400.0 + 31.0 * i for i in range(60)])


def _q4(t):
    px = A.faulty_pixels(t).withColumn("scene_id", F.concat("scene_id", F.lit("_"), (F.col("vec_id") % 40).cast("string")))
    return Q.values(px)


@query("q3_wavelength_checks", with_ctes(A.SB_SQL, Q3_SQL, body="SELECT * FROM q3"))
def _(t):
    return _q3(t)


@query("q4_value_checks", with_ctes(A.FAULTY_SQL, Q4_SQL, body="SELECT * FROM q4"))
def _(t):
    return _q4(t)


@query("u4_quality_report", with_ctes(A.SCENES_SQL, A.SB_SQL, A.FAULTY_SQL, Q1_SQL, Q2_SQL, Q3_SQL, Q4_SQL, body="SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4"))
def _(t):
    s = A.scenes(t)
    return Q.report(Q.structure(s), Q.tags(s), _q3(t), _q4(t))


# ------------------------------------------------------------------ metadata sources


def _files(t):
    """File names per scene directory, in the naming of each sensor's product."""
    k, d = F.col("p_partkey"), F.expr("p_partkey div 8")
    n = (k % 242 + 1).cast("string")
    name = (
        F.when(d % 5 == 0, F.when(k % 8 == 0, F.concat(F.lit("EO1H1480_MTL_L1T.TXT"))).otherwise(F.concat(F.lit("EO1H1480_B"), F.lpad(n, 3, "0"), F.lit("_L1T.TIF"))))
        .when(d % 5 == 1, F.when(k % 8 == 0, "ENMAP01-METADATA.XML").when(k % 8 == 1, "ENMAP01-SPECTRAL_IMAGE.TIF").otherwise("ENMAP01-QL.TIF"))
        .when(d % 5 == 2, F.when(k % 8 == 0, "PRS_L2D_STD_2020.he5").otherwise("readme.txt"))
        .when(d % 5 == 3, F.when(k % 8 == 0, "cube.tif").otherwise("notes.md"))
        .otherwise("unknown.bin"))
    return t("part").select(F.concat(F.lit("/raw/scene_"), d.cast("string")).alias("dir"), name.alias("name"), k.alias("k"))


@query("s4_sensor_inventory", """
SELECT '/raw/scene_' || (p_partkey // 8) AS dir, any_value(CASE (p_partkey // 8) % 5 WHEN 0 THEN 'hyperion' WHEN 1 THEN 'enmap' WHEN 2 THEN 'prisma' WHEN 3 THEN 'generic' END) AS sensor FROM part GROUP BY 1""")
def _(t):
    """Sensor of every directory from its file names."""
    return MD.detect_sensors(_files(t))


@query("s4_band_files", """
SELECT '/raw/scene_' || (p_partkey // 8) AS dir, 'EO1H1480_B' || lpad(CAST(p_partkey % 242 + 1 AS VARCHAR), 3, '0') || '_L1T.TIF' AS name, CAST(p_partkey % 242 + 1 AS INTEGER) AS band
FROM part WHERE (p_partkey // 8) % 5 = 0 AND p_partkey % 8 <> 0""")
def _(t):
    return MD.band_numbers(_files(t))


@query("s10_scene_registration", """
SELECT '/raw/scene_' || d AS scene_dir, 'scene_' || d AS scene_id, CASE d % 5 WHEN 0 THEN 'hyperion' WHEN 1 THEN 'enmap' WHEN 2 THEN 'prisma' WHEN 3 THEN 'generic' END AS sensor, 0 AS registered_at
FROM (SELECT DISTINCT p_partkey // 8 AS d FROM part)""")
def _(t):
    return RG.register_scenes(MD.detect_sensors(_files(t)), F.lit(0))


@query("s10_scene_catalogue", """
SELECT '/raw/scene_' || d AS scene_dir, 'scene_' || d AS scene_id, CASE d % 5 WHEN 0 THEN 'hyperion' WHEN 1 THEN 'enmap' WHEN 2 THEN 'prisma' WHEN 3 THEN 'generic' END AS sensor,
  CAST(1577836800 + 86400 * d + CASE WHEN d % 3 = 0 THEN 3600 ELSE 0 END AS BIGINT) AS acquired_s, CAST(CASE WHEN d % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_rows
FROM (SELECT DISTINCT p_partkey // 8 AS d FROM part)""")
def _(t):
    """Scenes registered three times: the second adds nothing, the third only those whose time was put right."""
    path = work_folder(t.spark, "catalogue")
    day = F.regexp_extract("dir", "scene_([0-9]+)", 1).cast("bigint")
    found = MD.detect_sensors(_files(t))
    at = lambda late, when: RG.register_scenes(found, F.timestamp_seconds(F.lit(when)), F.timestamp_seconds(1577836800 + 86400 * day + F.when((day % 3 == 0) & F.lit(late), 3600).otherwise(0)))
    for late, when in ((False, 1), (False, 2), (True, 3)):
        RG.append_scenes(at(late, when), path)
    rows = RG.read_catalogue(t.spark, path).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_rows"))
    now = RG.current_scenes(t.spark, path).join(rows, "scene_id")
    return now.select("scene_dir", "scene_id", "sensor", F.unix_seconds("acquired_at").alias("acquired_s"), "n_rows")


@query("s5_mtl_metadata", f"""
SELECT c_custkey, {r6('CASE WHEN c_custkey % 9 <> 0 THEN 10.5 + c_custkey % 70 END')} AS sun_elevation, {r6('CASE WHEN c_custkey % 2 = 0 THEN 50.0 ELSE 40.0 END')} AS vnir_scale, 80.0::DOUBLE AS swir_scale,
  'EO1H' || c_custkey AS scene_id, CASE WHEN c_custkey % 11 <> 0 THEN '20' || lpad(CAST(10 + c_custkey % 9 AS VARCHAR), 2, '0') || '-03-0' || (1 + c_custkey % 8) || ' 05:1' || (c_custkey % 10) || ':07' END AS acquired_at FROM customer""")
def _(t):
    """Key-value text per customer parsed back: groups, quotes, repeated keys, bad dates and numbers."""
    k = F.col("c_custkey")
    s = k.cast("string")
    day = F.when(k % 11 == 0, F.lit("soon")).otherwise(F.concat(F.lit("20"), F.lpad((10 + k % 9).cast("string"), 2, "0"), F.lit("-03-0"), (1 + k % 8).cast("string")))
    lines = [
        F.lit("GROUP = L1_METADATA_FILE"), F.lit("  SUN_ELEVATION = 1.0"), F.concat(F.lit('  ENTITY_ID = "EO1H'), s, F.lit('"')),
        F.concat(F.lit("  ACQUISITION_DATE = "), day), F.concat(F.lit('  SCENE_CENTER_SCAN_TIME = "05:1'), (k % 10).cast("string"), F.lit(':07.123Z"')),
        F.when(k % 2 == 0, F.lit("  SCALING_FACTOR_VNIR = 50.0")).otherwise(F.lit("  not a pair")),
        F.concat(F.lit("SUN_ELEVATION = "), F.when(k % 9 == 0, F.lit("n/a")).otherwise((10.5 + k % 70).cast("string"))), F.lit("END_GROUP = L1_METADATA_FILE"), F.lit("END")]
    text = t("customer").select("c_custkey", F.concat_ws("\n", *lines).alias("value"))
    m = MD.mtl_scene(MD.parse_mtl(text, "c_custkey"), "c_custkey")
    return m.select("c_custkey", rnd("sun_elevation").alias("sun_elevation"), rnd("vnir_scale").alias("vnir_scale"), "swir_scale", "scene_id",
                    F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"))


@query("s6_band_xml", f"""
SELECT s_suppkey, CAST(n AS INTEGER) AS number, {r6('400.0 + 6.5 * n + s_suppkey % 10')} AS wavelength_nm, {r6('CASE WHEN n % 3 = 0 OR n % 4 = 0 THEN 0.0001 ELSE 0.0002 END')} AS gain, {r6('CASE WHEN n % 2 = 0 THEN 0.5 ELSE 0.0 END')} AS "offset"
FROM supplier, range(1, 13) AS g(n) WHERE n % 5 <> 0""")
def _(t):
    """Band tables in namespaced XML text per supplier, with missing and zero gains."""
    k = F.col("s_suppkey")

    def band(n):
        s = n.cast("string")
        wl = F.when(n % 5 != 0, F.concat(F.lit("<x:wavelengthCenterOfBand>"), (400.0 + 6.5 * n + k % 10).cast("string"), F.lit("</x:wavelengthCenterOfBand>"))).otherwise(F.lit(""))
        gain = F.when(n % 3 == 0, F.lit("")).when(n % 4 == 0, F.lit("<GainOfBand>0</GainOfBand>")).otherwise(F.lit("<GainOfBand>0.0002</GainOfBand>"))
        off = F.when(n % 2 == 0, F.lit("<OffsetOfBand>0.5</OffsetOfBand>")).otherwise(F.lit(""))
        return F.concat(F.lit('<bandID number="'), s, F.lit('">'), wl, F.lit("<FWHMOfBand>8.1</FWHMOfBand>"), gain, off, F.lit("</bandID>"))

    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), band), "")
    x = t("supplier").select("s_suppkey", F.concat(F.lit('<root xmlns:x="urn:x">'), body, F.lit("</root>")).alias("xml"))
    b = MD.parse_band_xml(x, "s_suppkey", "xml")
    return b.select("s_suppkey", "number", rnd("wavelength_nm").alias("wavelength_nm"), rnd("gain").alias("gain"), rnd("offset").alias("offset"))


def _geojson(t):
    k = F.col("s_suppkey")
    num = lambda c: c.cast("double").cast("string")

    def poly(dx):
        pts = [(0, 0), (1, 0), (1, 1), (0, 0)]
        return F.concat(F.lit("[["), F.concat_ws(",", *[F.concat(F.lit("["), num(k % 50 + a + dx), F.lit(","), num(k % 30 + b), F.lit("]")) for a, b in pts]), F.lit("]]"))

    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), poly(0), F.lit("}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), poly(0), F.lit(","), poly(5), F.lit("]}"))
    feat = lambda g, n: F.concat(F.lit('{"type":"Feature","properties":{"field_id":"'), F.lit(n), F.lit('"},"geometry":'), g, F.lit("}"))
    empty = F.lit('{"type":"Feature","properties":{},"geometry":null}')
    text = (
        F.when(k % 5 == 0, one).when(k % 5 == 1, multi).when(k % 5 == 2, feat(one, "a"))
        .when(k % 5 == 3, F.concat(F.lit('{"type":"FeatureCollection","features":['), feat(one, "b"), F.lit(","), empty, F.lit(","), feat(multi, "c"), F.lit("]}")))
        .otherwise(F.lit('{"type":"Point","coordinates":[1,2]}')))
    return t("supplier").select("s_suppkey", text.alias("value"))


GEO_SQL = """gj AS (
SELECT s_suppkey, p AS position, CASE WHEN m THEN 2 ELSE 1 END AS n_polygons, CAST(s_suppkey % 50 AS DOUBLE) AS minx, CAST(s_suppkey % 50 + CASE WHEN m THEN 6 ELSE 1 END AS DOUBLE) AS maxx,
  CAST(s_suppkey % 30 AS DOUBLE) AS miny, CAST(s_suppkey % 30 + 1 AS DOUBLE) AS maxy, f AS field_id, CAST(NULL AS VARCHAR) AS error
FROM supplier JOIN (VALUES (0, 0, FALSE, NULL), (1, 0, TRUE, NULL), (2, 0, FALSE, 'a'), (3, 0, FALSE, 'b'), (3, 2, TRUE, 'c')) v(r, p, m, f) ON s_suppkey % 5 = r
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unsupported AOI GeoJSON type: Point' FROM supplier WHERE s_suppkey % 5 = 4)"""


@query("s12_geojson_source", with_ctes(GEO_SQL, body="SELECT s_suppkey, CAST(position AS INTEGER) AS position, CAST(n_polygons AS INTEGER) AS n_polygons, field_id, error FROM gj"))
def _(t):
    g = MD.parse_geojson(_geojson(t), "s_suppkey")
    return g.select("s_suppkey", "position", F.when(F.col("polygons").isNotNull(), F.size("polygons")).alias("n_polygons"),
                    F.try_element_at("properties", F.lit("field_id")).alias("field_id"), "error")


@query("g9_geometry_bounds", with_ctes(GEO_SQL, body="SELECT s_suppkey, CAST(position AS INTEGER) AS position, minx, miny, maxx, maxy FROM gj WHERE error IS NULL"))
def _(t):
    from canopyframe.functions.geometry import polygons_bounds

    g = MD.parse_geojson(_geojson(t), "s_suppkey").filter("error IS NULL")
    return g.select("s_suppkey", "position", *[v.alias(k) for k, v in polygons_bounds(F.col("polygons")).items()])


# ------------------------------------------------------------------ events


@query("w6_progress_changes", with_ctes(A.EVENTS_SQL, body="""
, a AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY us, event_id) AS ps FROM ev),
b AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> status THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY us, event_id) AS run FROM a),
c AS (SELECT *, max(progress) OVER (PARTITION BY job_id, run ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b)
SELECT event_id, job_id, status FROM c WHERE top IS NULL OR progress > top"""))
def _(t):
    return EV.progress_changes(A.events(t)).select("event_id", "job_id", "status")


@query("w7_rate_limited_requests", with_ctes(A.EVENTS_SQL, body=f"""
, n AS (SELECT *, row_number() OVER (PARTITION BY job_id, us // 86400000000 ORDER BY us, event_id) AS n FROM ev)
SELECT event_id, job_id, {r6('((us // 86400000000 + 1) * 86400000000 - us) / 1000000.0::DOUBLE')} AS retry_after FROM n WHERE n > 2"""))
def _(t):
    return EV.rate_limited(A.events(t), 2, 86400).select("event_id", "job_id", rnd("retry_after").alias("retry_after"))


@query("st4_progress_model", with_ctes(A.EVENTS_SQL, body=f"""
SELECT event_id, {r6("CASE event_id % 6 WHEN 0 THEN 0.01 WHEN 1 THEN 0.05 WHEN 2 THEN 0.10 + 0.75 * (event_id % 40) / greatest(1, event_id % 80) WHEN 3 THEN 0.88 WHEN 4 THEN 0.95 ELSE 1.0 END")} AS progress FROM ev"""))
def _(t):
    steps = F.array(*[F.lit(s) for s in ("started", "loading", "scoring", "stitching", "zoning", "succeeded")])
    e = A.events(t)
    return e.select("event_id", rnd(rules.progress_of(F.get(steps, (F.col("event_id") % 6).cast("int")), F.col("event_id") % 40, F.col("event_id") % 80)).alias("progress"))


@query("st7_latest_job_state", with_ctes(A.EVENTS_SQL, body="SELECT job_id, arg_max(status, us) AS status, arg_max(kind, us) AS kind FROM ev GROUP BY job_id"))
def _(t):
    return EV.latest_state(A.events(t)).select("job_id", "status", "kind")


@query("st8_rate_windows", with_ctes(A.EVENTS_SQL, body='SELECT job_id, us // 86400000000 AS "window", count(*) AS n, greatest(0, count(*) - 2) AS rejected FROM ev GROUP BY 1, 2'))
def _(t):
    return EV.rate_counts(A.events(t), 2, 86400)

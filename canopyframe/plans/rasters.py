"""Registered queries over the scored raster: windows, blending, zones, outlines, shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import geometry as G
from canopyframe.functions import rules
from canopyframe.operators import blocks as BL
from canopyframe.operators import grid as GR
from canopyframe.operators import shaping as SH
from canopyframe.operators import stitch as SW
from canopyframe.operators import zones as Z
from canopyframe.plans import adapters as A
from canopyframe.plans import spectral as SP
from canopyframe.plans.adapters import big, rnd
from canopyframe.plans.registry import query, r4, r6, with_ctes

PK = ["scene_id", "row", "col"]
PKQ = 'scene_id, "row", col'
SIZE, OVER = 16, 4
STRIDE = SIZE - OVER
PX_ACRES = 900.0 / K.SQM_PER_ACRE

SIZES_SQL = 'sz AS (SELECT scene_id, CAST(max("row") + 1 AS INTEGER) AS h, CAST(max(col) + 1 AS INTEGER) AS w FROM ra GROUP BY scene_id)'
AXES_SQL = f"""
rw AS (SELECT DISTINCT scene_id, h, w, o AS ro FROM sz, LATERAL (SELECT unnest(range(0, greatest(h - {SIZE}, 0) + 1, {STRIDE}) || [CAST(greatest(h - {SIZE}, 0) AS BIGINT)]) AS o)),
cw AS (SELECT DISTINCT scene_id, o AS co FROM sz, LATERAL (SELECT unnest(range(0, greatest(w - {SIZE}, 0) + 1, {STRIDE}) || [CAST(greatest(w - {SIZE}, 0) AS BIGINT)]) AS o)),
win AS (SELECT rw.scene_id, CAST(ro AS INTEGER) AS ro, CAST(co AS INTEGER) AS co, least({SIZE}, h - ro) AS hh, least({SIZE}, w - co) AS ww FROM rw JOIN cw USING (scene_id))"""
TILE_SQL = f"""
tl AS (SELECT ra.*, ro, co, ra."row" - ro AS i, ra.col - co AS j FROM ra JOIN win ON win.scene_id = ra.scene_id
       AND ra."row" >= ro AND ra."row" < ro + {SIZE} AND ra.col >= co AND ra.col < co + {SIZE}),
tw AS (SELECT *, least(1.0, (i + 0.5) / {OVER}, ({SIZE} - i - 0.5) / {OVER}) * least(1.0, (j + 0.5) / {OVER}, ({SIZE} - j - 0.5) / {OVER}) AS wt FROM tl)"""


def sized(t):
    px = A.raster(t)
    return px.join(GR.scene_sizes(px), "scene_id")


@query("g1_window_grid", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, body="""
SELECT scene_id, ro AS row_off, co AS col_off, CAST(hh AS INTEGER) AS h, CAST(ww AS INTEGER) AS w FROM win"""))
def _(t):
    return GR.windows(GR.scene_sizes(A.raster(t)), SIZE, OVER)


@query("g2_block_grid", with_ctes(A.RASTER_SQL, SIZES_SQL, body="""
SELECT scene_id, CAST(a AS INTEGER) AS row_off, CAST(b AS INTEGER) AS col_off, CAST(least(48, h - a) AS INTEGER) AS h, CAST(least(48, w - b) AS INTEGER) AS w
FROM sz, LATERAL (SELECT unnest(range(0, h, 48)) AS a), LATERAL (SELECT unnest(range(0, w, 48)) AS b)"""))
def _(t):
    return GR.blocks(GR.scene_sizes(A.raster(t)), 48)


@query("g3_sample_windows")
def _(t):
    """Hash-drawn windows per scene (repeatable per seed)."""
    return GR.sample_windows(GR.scene_sizes(A.raster(t)), 32, 32, seed=7)


@query("g4_feather_weights", with_ctes(A.RASTER_SQL, body=f"""
SELECT {PKQ}, {r6('least(1.0, (("row" % 16) + 0.5) / 4, (16 - ("row" % 16) - 0.5) / 4) * least(1.0, ((col % 16) + 0.5) / 4, (16 - (col % 16) - 0.5) / 4)')} AS weight FROM ra"""))
def _(t):
    w = G.feather(F.col("row") % SIZE, SIZE, OVER) * G.feather(F.col("col") % SIZE, SIZE, OVER)
    return A.raster(t).select(*PK, rnd(w).alias("weight"))


@query("j1_pixel_window_containment", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, body=f"""
SELECT {PKQ}, ro AS row_off, co AS col_off, {r6('wt')} AS weight FROM tw"""))
def _(t):
    """Every pixel once per window that contains it, from computed window ids."""
    return GR.tile_pixels(sized(t), SIZE, OVER).select(*PK, "row_off", "col_off", rnd("weight").alias("weight"))


def _valid(t):
    return sized(t).filter(F.col("valid") & (F.col("cls") != 0))


@query("f1_drop_empty_windows", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, body="""
SELECT scene_id, ro AS row_off, co AS col_off, count(*) AS n_valid FROM tw WHERE valid AND cls <> 0 GROUP BY scene_id, ro, co"""))
def _(t):
    tiles = GR.tile_pixels(_valid(t), SIZE, OVER)
    return tiles.groupBy("scene_id", "row_off", "col_off").agg(F.count(F.lit(1)).alias("n_valid"))


@query("j8_nonempty_windows_semi", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, body="""
SELECT scene_id, ro AS row_off, co AS col_off FROM win
WHERE EXISTS (SELECT 1 FROM tw WHERE tw.scene_id = win.scene_id AND tw.ro = win.ro AND tw.co = win.co AND valid AND cls <> 0)"""))
def _(t):
    win = GR.windows(GR.scene_sizes(A.raster(t)), SIZE, OVER)
    return GR.nonempty_windows(win, _valid(t), SIZE, OVER).select("scene_id", "row_off", "col_off")


STITCH_SQL = """
pr AS (SELECT *, p0 * (1 + 0.0137931 * (ro % 7)) AS q0, onset + 0.1037931 * (co % 5) AS qo FROM tw),
st AS (SELECT scene_id, "row", col, sum(CASE WHEN valid THEN wt ELSE 0 END) AS tot, sum(CASE WHEN valid THEN wt * q0 ELSE 0 END) AS s0,
         sum(CASE WHEN valid THEN wt * qo ELSE 0 END) AS so FROM pr GROUP BY scene_id, "row", col)"""


def _preds(t):
    tiles = GR.tile_pixels(sized(t), SIZE, OVER)
    return tiles.withColumns({"p0": F.col("p0") * (1 + 0.0137931 * (F.col("row_off") % 7)), "onset": F.col("onset") + 0.1037931 * (F.col("col_off") % 5)})


@query("a3_weighted_blend", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, STITCH_SQL, body=f"""
SELECT {PKQ}, {r6('CASE WHEN tot > 0 THEN s0 / tot END')} AS p0, {r6('CASE WHEN tot > 0 THEN so / tot END')} AS onset FROM st"""))
def _(t):
    """Feathered blend of window predictions that differ per window."""
    return SW.stitch(_preds(t), ("p0", "onset")).select(*PK, rnd("p0").alias("p0"), rnd("onset").alias("onset"))


@query("a4_coverage", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, STITCH_SQL, body=f"SELECT {PKQ}, tot > 0 AS covered FROM st"))
def _(t):
    return SW.stitch(_preds(t), ("p0",)).select(*PK, "covered")


@query("s19_risk_layers", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, STITCH_SQL, body=f"""
SELECT {PKQ}, {r6('CASE WHEN tot > 0 THEN s0 / tot ELSE -1.0 END')} AS p_healthy, {r6('CASE WHEN valid THEN p1 ELSE -1.0 END')} AS p_early_stress,
  {r6('CASE WHEN valid THEN p2 ELSE -1.0 END')} AS p_high_blight_risk, {r6('CASE WHEN valid THEN p3 ELSE -1.0 END')} AS p_visible_disease,
  {r6('CASE WHEN tot > 0 THEN so / tot ELSE -1.0 END')} AS days_to_onset FROM st JOIN ra USING ({PKQ})"""))
def _(t):
    out = SW.risk_layers(SW.stitch(_preds(t)))
    return out.select(*PK, *[rnd(c).alias(c) for c in out.columns if c not in PK])


@query("s17_rechunk", with_ctes(A.RASTER_SQL, body="""
SELECT scene_id, CAST("row" // 32 AS INTEGER) AS chunk_r, CAST(col // 32 AS INTEGER) AS chunk_c, count(*) AS n_cells, CAST(sum(k) AS BIGINT) AS total,
       CAST(min_by(k, "row" * 100000 + col) AS BIGINT) AS first_k FROM ra GROUP BY 1, 2, 3"""))
def _(t):
    c = SW.rechunk(A.raster(t), "k", 32)
    return c.select("scene_id", "chunk_r", "chunk_c", big(F.size("cells")).alias("n_cells"),
                    F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, x: a + x.value).alias("total"), F.get("cells", F.lit(0)).value.alias("first_k"))


@query("s18_overview_pyramid", with_ctes(A.RASTER_SQL, body=f"""
, l1 AS (SELECT scene_id, "row" // 2 AS r, col // 2 AS c, avg(CASE WHEN valid THEN onset END) AS v FROM ra GROUP BY 1, 2, 3),
l2 AS (SELECT scene_id, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM l1 GROUP BY 1, 2, 3),
l3 AS (SELECT scene_id, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM l2 GROUP BY 1, 2, 3)
SELECT scene_id, CAST(1 AS INTEGER) AS level, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {r6('v')} AS value FROM l1
UNION ALL SELECT scene_id, 2, CAST(r AS INTEGER), CAST(c AS INTEGER), {r6('v')} FROM l2
UNION ALL SELECT scene_id, 3, CAST(r AS INTEGER), CAST(c AS INTEGER), {r6('v')} FROM l3"""))
def _(t):
    px = A.raster(t).withColumn("v", F.when(F.col("valid"), F.col("onset")))
    return SW.build_overviews(px, "v", 3).withColumn("value", rnd("value"))


# ------------------------------------------------------------------ classes and zones

ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END"


@query("p28_class_and_risk", with_ctes(A.RASTER_SQL, body=f"""
SELECT {PKQ}, CAST(CASE WHEN valid THEN {ARGMAX} ELSE -1 END AS INTEGER) AS cls, {r6('CASE WHEN valid THEN greatest(0.0, least(1.0, 1 - p0)) END')} AS risk FROM ra"""))
def _(t):
    c = Z.classify(A.raster(t))
    return c.select(*PK, F.coalesce("risk_class", F.lit(-1)).alias("cls"), rnd("risk").alias("risk"))


MASK_SQL = f"""
cm AS (SELECT *, CASE WHEN valid THEN {ARGMAX} END AS rc FROM ra),
mk AS (SELECT scene_id, "row", col, CAST(rc AS INTEGER) AS rc, onset, 1 - p0 AS risk FROM cm WHERE rc > 0 AND (CASE rc WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) >= 0.4)"""
OPEN_SQL = """
ero AS (SELECT m.scene_id, m.rc, m."row", m.col FROM mk m JOIN mk n ON n.scene_id = m.scene_id AND n.rc = m.rc
        AND n."row" BETWEEN m."row" - 1 AND m."row" + 1 AND n.col BETWEEN m.col - 1 AND m.col + 1
        GROUP BY 1, 2, 3, 4 HAVING count(*) = 9),
op AS (SELECT DISTINCT scene_id, rc, "row" + dr AS "row", col + dc AS col FROM ero, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc))"""
COMP_SQL = """
reach AS (
  SELECT scene_id, rc, "row", col, "row" AS r2, col AS c2 FROM op
  UNION
  SELECT a.scene_id, a.rc, a."row", a.col, n."row", n.col FROM reach a, op n
  WHERE n.scene_id = a.scene_id AND n.rc = a.rc AND abs(n."row" - a.r2) + abs(n.col - a.c2) = 1),
lab AS (SELECT scene_id, rc, "row", col, min(CAST(r2 AS BIGINT) * 4294967296 + c2) AS zone FROM reach GROUP BY 1, 2, 3, 4)"""


def zone_sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([A.RASTER_SQL, MASK_SQL, OPEN_SQL, COMP_SQL, *more]) + "\n" + body


BLOCK = 64


def _labelled(t, carry=("onset", "risk")):
    return Z.label_zones(Z.zone_candidates(A.raster(t)), 1, BLOCK, carry)


@query("f2_zone_candidates", with_ctes(A.RASTER_SQL, MASK_SQL, body=f"SELECT {PKQ}, rc AS risk_class FROM mk"))
def _(t):
    return Z.zone_candidates(A.raster(t)).select(*PK, "risk_class")


@query("g20_binary_opening", with_ctes(A.RASTER_SQL, MASK_SQL, OPEN_SQL, body=f"SELECT {PKQ}, rc AS risk_class FROM op"))
def _(t):
    """Opening by a 3x3 square in halo blocks of 64 pixels."""
    return BL.open_and_label(Z.zone_candidates(A.raster(t)), Z.KEYS, 1, BLOCK).select(*PK, "risk_class")


@query("j7_neighbour_counts", with_ctes(A.RASTER_SQL, MASK_SQL, body="""
SELECT m.scene_id, m."row", m.col, m.rc AS risk_class, count(*) AS n FROM mk m JOIN mk n ON n.scene_id = m.scene_id AND n.rc = m.rc
 AND n."row" BETWEEN m."row" - 1 AND m."row" + 1 AND n.col BETWEEN m.col - 1 AND m.col + 1 GROUP BY ALL"""))
def _(t):
    """Same-class pixels in the 3x3 neighbourhood, in halo blocks."""
    return BL.neighbour_counts(Z.zone_candidates(A.raster(t)), Z.KEYS, BLOCK).select(*PK, "risk_class", "n")


@query("g21_connected_components", zone_sql(f"SELECT {PKQ}, rc AS risk_class, zone FROM lab"))
def _(t):
    """4-connected components of the opened mask, blocks of 64 pixels joined across borders."""
    return Z.with_zone(*_labelled(t, ())).select(*PK, "risk_class", "zone")


ZS_SQL = """zs AS (SELECT lab.scene_id, lab.rc, zone, count(*) AS n_pixels, min(lab."row") AS min_row, max(lab."row") AS max_row, min(lab.col) AS min_col, max(lab.col) AS max_col,
  avg(onset) AS onset, avg(risk) AS risk FROM lab JOIN mk ON mk.scene_id = lab.scene_id AND mk."row" = lab."row" AND mk.col = lab.col GROUP BY 1, 2, 3)"""


@query("g22_component_boxes", zone_sql("SELECT scene_id, rc AS risk_class, zone, CAST(min_row AS INTEGER) AS min_row, CAST(max_row AS INTEGER) AS max_row, CAST(min_col AS INTEGER) AS min_col, CAST(max_col AS INTEGER) AS max_col FROM zs", ZS_SQL))
def _(t):
    return Z.zone_stats(*_labelled(t), ()).select("scene_id", "risk_class", "zone", "min_row", "max_row", "min_col", "max_col")


ACRES_SQL = repr(PX_ACRES)


@query("f3_minimum_zone_size", zone_sql(f"SELECT scene_id, rc AS risk_class, zone, CAST(n_pixels AS BIGINT) AS n_pixels FROM zs WHERE n_pixels >= greatest(1, ceil(12.0 / {ACRES_SQL}))", ZS_SQL))
def _(t):
    return Z.min_size(Z.zone_stats(*_labelled(t), ()), F.lit(PX_ACRES), 12.0).select("scene_id", "risk_class", "zone", "n_pixels")


@query("a6_zone_statistics", zone_sql(f"""SELECT scene_id, rc AS risk_class, zone, CAST(n_pixels AS BIGINT) AS n_pixels, {r6('greatest(0.0, least(30.0, onset))')} AS days_to_onset,
  {r6('greatest(0.0, least(1.0, risk))')} AS risk_score, {r6(f'n_pixels * {ACRES_SQL}')} AS acres FROM zs""", ZS_SQL))
def _(t):
    s = Z.zone_stats(*_labelled(t))
    return s.select("scene_id", "risk_class", "zone", "n_pixels", rnd(rules.clip_onset(F.col("onset"))).alias("days_to_onset"),
                    rnd("risk").alias("risk_score"), rnd(F.col("n_pixels") * PX_ACRES).alias("acres"))


def _grid(t):
    """The raster's scenes on a UTM grid of 30 m pixels."""
    return A.raster(t).select("scene_id").distinct().select(
        "scene_id", F.lit(30.0).alias("a"), F.lit(0.0).alias("b"), F.lit(500000.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-30.0).alias("e"),
        F.lit(3420000.0).alias("f"), F.lit(32643).alias("epsg"))


def _zones(t, area="pixels"):
    return Z.extract_zones(A.raster(t), _grid(t), block=BLOCK, area=area)


def spectra(t):
    """A spectrum for every raster cell: the embedding of the cell's key, counted round."""
    values = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * x.cast("double") + 0.5)))
    e = t("embeddings")
    return A.raster(t).withColumn("vec_id", F.col("k") % e.count()).join(e.select("vec_id", values.alias("spectrum")), "vec_id").select(*PK, "spectrum")


INDICATOR_SQL = f"""rx AS (SELECT ra.scene_id, ra."row", ra.col, list_transform(e.embedding, lambda x: least(1.0, greatest(0.0, 2 * CAST(x AS DOUBLE) + 0.5))) AS s
  FROM ra JOIN embeddings e ON e.vec_id = ra.k % (SELECT count(*) FROM embeddings)),
med AS (SELECT scene_id, {SP._bands_agg('quantile_cont({}, 0.5)')} FROM rx GROUP BY scene_id),
zm AS (SELECT lab.scene_id, lab.rc, lab.zone, {SP._bands_agg('avg({})')} FROM lab JOIN rx ON rx.scene_id = lab.scene_id AND rx."row" = lab."row" AND rx.col = lab.col GROUP BY lab.scene_id, lab.rc, lab.zone),
mr AS (SELECT scene_id, {', '.join(f'{e} AS m_{n}' for n, e in SP.ZCOL.items())} FROM med),
zr AS (SELECT scene_id, rc, zone, {', '.join(f'{e} AS z_{n}' for n, e in SP.ZCOL.items())} FROM zm),
zi AS (SELECT zr.scene_id, rc, zone, list_max([{SP.DROPS}]).n AS ind FROM zr JOIN mr USING (scene_id))"""


@query("zones_end_to_end", zone_sql(f"""SELECT zs.scene_id, zs.rc AS risk_class, zs.zone, CAST(n_pixels AS BIGINT) AS n_pixels, {r4('risk')} AS risk_score, {r6(f'round(n_pixels * {ACRES_SQL}, 3)')} AS area_acres,
  {r6('round_even(greatest(0.0, least(30.0, onset)), 2)')} AS days_to_onset, ind AS dominant_indicator,
  CASE zs.rc WHEN 3 THEN '{rules.ACTION_VISIBLE}' WHEN 2 THEN '{rules.ACTION_HIGH}' || CASE WHEN onset < 7 THEN '48 hours' ELSE '7 days' END ELSE '{rules.ACTION_EARLY}' END
    || CASE WHEN ind = 'water_stress' THEN '{rules.ACTION_IRRIGATION}' ELSE '' END AS recommended_action
  FROM zs JOIN zi ON zi.scene_id = zs.scene_id AND zi.rc = zs.rc AND zi.zone = zs.zone WHERE n_pixels >= greatest(1, ceil(1.0 / {ACRES_SQL}))""", ZS_SQL, INDICATOR_SQL))
def zones_end_to_end(t):
    """Scored raster and spectra to contract zones: candidates, opening, components, statistics, indicator, actions."""
    z = Z.extract_zones(A.raster(t), _grid(t), block=BLOCK, px=spectra(t), wavelengths=A.FX_WAVELENGTHS)
    return z.select("scene_id", "risk_class", "zone", "n_pixels", rnd("risk_score", 4).alias("risk_score"), rnd("area_acres").alias("area_acres"),
                    rnd("days_to_onset").alias("days_to_onset"), "dominant_indicator", "recommended_action")


@query("a7_job_summary", zone_sql(f"""
, g AS (SELECT scene_id, count(*) FILTER (WHERE valid) * {ACRES_SQL} AS acres FROM ra GROUP BY 1),
z AS (SELECT * FROM zs WHERE n_pixels >= greatest(1, ceil(1.0 / {ACRES_SQL})))
SELECT g.scene_id, {r4('round(any_value(acres), 3)')} AS acres_analyzed, {r4(f'coalesce(round(sum(n_pixels * {ACRES_SQL}), 3), 0)')} AS acres_at_risk,
  CAST(count(*) FILTER (WHERE rc = 0) AS BIGINT) AS n_healthy, count(*) FILTER (WHERE rc = 1) AS n_early_stress, count(*) FILTER (WHERE rc = 2) AS n_high_blight_risk, count(*) FILTER (WHERE rc = 3) AS n_visible_disease
FROM g LEFT JOIN z ON z.scene_id = g.scene_id GROUP BY g.scene_id""", ZS_SQL))
def _(t):
    s = Z.job_summary(A.raster(t), _zones(t), PX_ACRES)
    return s.withColumns({"acres_analyzed": rnd("acres_analyzed", 4), "acres_at_risk": rnd("acres_at_risk", 4)})


@query("w5_zone_numbering", zone_sql("""
, n AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY rc DESC, round(risk, 4) DESC, zone) AS n FROM zs)
SELECT scene_id, rc AS risk_class, zone, 'z-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS zone_id FROM n""", ZS_SQL))
def _(t):
    s = Z.zone_stats(*_labelled(t)).withColumn("risk_score", F.bround("risk", 4))
    return Z.number_zones(s).select("scene_id", "risk_class", "zone", "zone_id")


@query("t1_zones_sorted", zone_sql(f"SELECT scene_id, rc AS risk_class, {r4('risk')} AS risk_score, zone FROM zs ORDER BY rc DESC, round(risk, 4) DESC, zone", ZS_SQL))
def _(t):
    s = Z.zone_stats(*_labelled(t)).withColumn("risk_score", F.bround("risk", 4))
    return Z.sort_zones(s).select("scene_id", "risk_class", rnd("risk_score", 4).alias("risk_score"), "zone")


# Unit edges with the zone on the right hand, by direction 0 right, 1 down, 2 left, 3 up.
EDGES_SQL = """sd AS (SELECT lab.*, d FROM lab, (SELECT unnest([0, 1, 2, 3]) AS d)),
nb AS (SELECT *, "row" + CASE d WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS nr, col + CASE d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS nc FROM sd),
ed AS (
  SELECT scene_id, rc, zone, d, row_number() OVER () AS e, CASE d WHEN 0 THEN col WHEN 1 THEN col + 1 WHEN 2 THEN col + 1 ELSE col END AS x0,
    CASE d WHEN 0 THEN "row" WHEN 1 THEN "row" WHEN 2 THEN "row" + 1 ELSE "row" + 1 END AS y0,
    CASE d WHEN 0 THEN col + 1 WHEN 1 THEN col + 1 WHEN 2 THEN col ELSE col END AS x1,
    CASE d WHEN 0 THEN "row" WHEN 1 THEN "row" + 1 WHEN 2 THEN "row" + 1 ELSE "row" END AS y1
  FROM nb WHERE NOT EXISTS (SELECT 1 FROM lab o WHERE o.scene_id = nb.scene_id AND o.rc = nb.rc AND o."row" = nr AND o.col = nc))"""
# The edge after each edge (a right turn if there is one), and rings as all edges that one reaches.
RINGS_SQL = """nx AS (
  SELECT a.e, b.e AS f, row_number() OVER (PARTITION BY a.e ORDER BY b.d = (a.d + 1) % 4 DESC) AS pick
  FROM ed a JOIN ed b ON b.scene_id = a.scene_id AND b.rc = a.rc AND b.zone = a.zone AND b.x0 = a.x1 AND b.y0 = a.y1),
rch(e, f) AS (SELECT e, e FROM ed UNION SELECT rch.e, nx.f FROM rch JOIN nx ON nx.e = rch.f AND nx.pick = 1),
rg AS (SELECT e, min(f) AS ring FROM rch GROUP BY e),
ra2 AS (SELECT scene_id, rc, zone, ring, sum(x0 * y1 - x1 * y0) / 2.0 AS area, count(*) AS n FROM ed JOIN rg USING (e) GROUP BY ALL)"""


@query("g23_zone_edges", zone_sql("""SELECT scene_id, rc AS risk_class, zone, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1 FROM ed""", EDGES_SQL))
def _(t):
    return Z.zone_edges(*_labelled(t, ()))


@query("g23_zone_rings", zone_sql(f"SELECT scene_id, rc AS risk_class, zone, count(*) AS n_rings, {r6('sum(area)')} AS area_px FROM ra2 GROUP BY 1, 2, 3", EDGES_SQL, RINGS_SQL))
def _(t):
    """Outline rings per zone, unsimplified: ring count, corner count, exact area."""
    rings = Z.zone_rings(Z.zone_edges(*_labelled(t, ())), 0.0)
    return rings.select(*Z.KEYS, "zone", big(F.size("rings")).alias("n_rings"), rnd(G.polygon_area(F.col("rings"))).alias("area_px"))


@query("x6_ring_tracing", zone_sql("SELECT scene_id, rc AS risk_class, zone, CAST(n_pixels AS DOUBLE) AS area_px FROM zs", ZS_SQL))
def _(t):
    """Ring tracing as a table function: the traced outline encloses exactly the zone's pixels."""
    rings = Z.zone_rings(Z.zone_edges(*_labelled(t, ())), 0.0)
    return rings.select(*Z.KEYS, "zone", rnd(G.polygon_area(F.col("rings"))).alias("area_px"))


@query("g24_simplified_rings")
def _(t):
    """Rings simplified to half a pixel, with polygon acres and WGS84 outline."""
    z = _zones(t, "polygon")
    ring = F.get("coordinates", F.lit(0))
    return z.select(*Z.KEYS, "zone", "area_acres", big(F.size(ring)).alias("n_points"), F.get(F.get(ring, F.lit(0)), F.lit(0)).alias("lon"))


@query("t6_largest_part", zone_sql(f"SELECT scene_id, rc AS risk_class, zone, CAST(0 AS INTEGER) AS part, {r6('max(abs(area))')} AS area FROM ra2 GROUP BY 1, 2, 3", EDGES_SQL, RINGS_SQL))
def _(t):
    """Largest ring of every zone's outline."""
    rings = Z.zone_rings(Z.zone_edges(*_labelled(t, ())), 0.0)
    parts = rings.select(*Z.KEYS, "zone", F.posexplode("rings").alias("part", "ring"))
    parts = parts.withColumn("area", G.ring_area(F.col("ring")))
    return Z.largest_part(parts, [*Z.KEYS, "zone"], "area").select(*Z.KEYS, "zone", "part", rnd("area").alias("area"))


GAUSS = [2.718281828459045 ** (-0.5 * k * k) for k in range(-4, 5)]


@query("g25_gaussian_smoothing", with_ctes(A.RASTER_SQL, SIZES_SQL, body=f"""
, k(o, w) AS (VALUES {', '.join(f'({i - 4}, {g / sum(GAUSS)!r})' for i, g in enumerate(GAUSS))}),
v AS (SELECT {PKQ}, CASE WHEN valid THEN onset ELSE 0.0 END AS v FROM ra),
s1 AS (SELECT a.scene_id, a."row", a.col, sum(k.w * b.v) AS v FROM v a JOIN sz USING (scene_id), k, v b
       WHERE b.scene_id = a.scene_id AND b.col = a.col AND b."row" = greatest(0, least(h - 1, a."row" + o)) GROUP BY 1, 2, 3),
s2 AS (SELECT a.scene_id, a."row", a.col, sum(k.w * b.v) AS v FROM s1 a JOIN sz USING (scene_id), k, s1 b
       WHERE b.scene_id = a.scene_id AND b."row" = a."row" AND b.col = greatest(0, least(w0 - 1, a.col + o)) GROUP BY 1, 2, 3)
SELECT {PKQ}, {r6('v')} AS smoothed FROM s2""".replace("w0", "sz.w")))
def _(t):
    px = A.raster(t).withColumn("v", F.when(F.col("valid"), F.col("onset")))
    return BL.smooth(px, "v", GR.scene_sizes(px), 1.0, BLOCK).withColumn("smoothed", rnd("smoothed"))


@query("p32_risk_colours", with_ctes(A.RASTER_SQL, body=f"""
, r AS (SELECT *, greatest(0.0, least(1.0, (k % 1001) / 1000.0::DOUBLE)) AS x FROM ra)
SELECT {PKQ}, {', '.join(f"CAST(floor(CASE WHEN x <= 0.5 THEN {rules.RAMP[0][n]} + ({rules.RAMP[1][n]} - {rules.RAMP[0][n]}) * x / 0.5 ELSE {rules.RAMP[1][n]} + ({rules.RAMP[2][n]} - {rules.RAMP[1][n]}) * (x - 0.5) / 0.5 END) AS INTEGER) AS {c}" for n, c in ((1, 'red'), (2, 'green'), (3, 'blue')))},
  CAST(CASE WHEN valid THEN 210 ELSE 0 END AS INTEGER) AS alpha FROM r"""))
def _(t):
    c = rules.colorize(F.col("k") % 1001 / F.lit(1000.0), F.col("valid"))
    return A.raster(t).select(*PK, *[v.cast("int").alias(n) for n, v in c.items()])


# ------------------------------------------------------------------ shaping


@query("u3_window_intersection", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, body="""
, i AS (SELECT scene_id, ro, co, greatest(ro, 10) AS r, greatest(co, 20) AS c, least(ro + hh, 70) AS b, least(co + ww, 60) AS rt FROM win)
SELECT scene_id, ro AS row0, co AS col0, CAST(r AS INTEGER) AS row_off, CAST(c AS INTEGER) AS col_off, CAST(b - r AS INTEGER) AS h, CAST(rt - c AS INTEGER) AS w FROM i WHERE b > r AND rt > c"""))
def _(t):
    w = GR.windows(GR.scene_sizes(A.raster(t)), SIZE, OVER).select(
        "scene_id", F.col("row_off").alias("row0"), F.col("col_off").alias("col0"), F.col("h").alias("h0"), F.col("w").alias("w0"),
        F.lit(10).alias("r1"), F.lit(20).alias("c1"), F.lit(60).alias("h1"), F.lit(40).alias("w1"))
    i = GR.intersect_windows(("row0", "col0", "h0", "w0"), ("r1", "c1", "h1", "w1"))
    return w.select("scene_id", "row0", "col0", *[v.alias(k) for k, v in i.items()]).filter("h IS NOT NULL")


@query("u7_pad_scenes", with_ctes(A.RASTER_SQL, SIZES_SQL, body="""
SELECT scene_id, "row", col, cls, onset, valid FROM ra
UNION ALL
SELECT scene_id, CAST(r AS INTEGER), CAST(c AS INTEGER), -1, 30.0, FALSE FROM sz, LATERAL (SELECT unnest(range(0, greatest(h, 160))) AS r), LATERAL (SELECT unnest(range(0, greatest(w, 160))) AS c)
WHERE (h < 160 OR w < 160) AND (r >= h OR c >= w)"""))
def _(t):
    px = A.raster(t)
    return SH.pad_scenes(px.select(*PK, "cls", "onset", "valid"), GR.scene_sizes(px), 160)


@query("f10_label_coverage", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, body=f"""
, c AS (SELECT scene_id, ro, co, count(*) FILTER (WHERE cls <> 0 AND valid) / 256.0::DOUBLE AS cov FROM tw GROUP BY 1, 2, 3)
SELECT scene_id, ro AS row_off, co AS col_off, {r6('cov')} AS coverage FROM c WHERE cov >= 0.75"""))
def _(t):
    tiles = GR.tile_pixels(sized(t), SIZE, OVER).withColumn("labelled", F.col("cls") != 0)
    return SH.covered_windows(tiles, 0.75, SIZE).withColumn("coverage", rnd("coverage"))


@query("g28_flip_and_rotate", with_ctes(A.RASTER_SQL, SIZES_SQL, AXES_SQL, TILE_SQL, body="""
, f AS (SELECT scene_id, ro, co, k, cls, (ro // 12) % 4 AS turns, CASE WHEN (co // 12) % 2 = 1 THEN 15 - j ELSE j END AS j1, CASE WHEN (ro + co) % 3 = 0 THEN 15 - i ELSE i END AS i1 FROM tw)
SELECT scene_id, ro AS row_off, co AS col_off, k, cls,
  CAST(CASE turns WHEN 1 THEN 15 - j1 WHEN 2 THEN 15 - i1 WHEN 3 THEN j1 ELSE i1 END AS INTEGER) AS i,
  CAST(CASE turns WHEN 1 THEN i1 WHEN 2 THEN 15 - j1 WHEN 3 THEN 15 - i1 ELSE j1 END AS INTEGER) AS j FROM f"""))
def _(t):
    tiles = GR.tile_pixels(sized(t), SIZE, OVER)
    out = SH.flip_and_turn(tiles, SIZE, F.expr("(col_off div 12) % 2 = 1"), (F.col("row_off") + F.col("col_off")) % 3 == 0, F.expr("(row_off div 12) % 4"))
    return out.select("scene_id", "row_off", "col_off", "k", "cls", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))


@query("g28_random_augmentation")
def _(t):
    """Seeded flip and rotation per window; every window stays a permutation of its pixels."""
    tiles = SH.augment_geometry(GR.tile_pixels(sized(t), SIZE, OVER), SIZE, seed=3)
    return tiles.select("scene_id", "row_off", "col_off", "i", "j", "k", "cls")


@query("u1_union_of_windows", with_ctes(A.RASTER_SQL, body="""
SELECT scene_id, cls, count(*) AS n FROM (SELECT scene_id, cls FROM ra WHERE valid UNION ALL SELECT scene_id || 'b', cls FROM ra) GROUP BY 1, 2"""))
def _(t):
    px = A.raster(t)
    both = SH.concat_windows(px.filter("valid").select("scene_id", "cls"), px.select("cls", F.concat("scene_id", F.lit("b")).alias("scene_id")))
    return both.groupBy("scene_id", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("u9_train_validation_split", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, pos <= greatest(1, least(400, n // 10)) AS is_val FROM r""")
def _(t):
    """Exact-size validation set by a deterministic rank."""
    w = t("orders").select("o_orderkey")
    return SH.split(w, 400, (F.col("o_orderkey") * 2654435761) % 4294967296, ["o_orderkey"])


@query("u6_training_windows")
def _(t):
    """Area-weighted window draws with up to ten tries for label coverage."""
    px = A.raster(t).withColumn("labelled", F.col("cls") != 0)
    cover = SH.all_window_coverage(px, SIZE)
    return SH.sample_training_windows(GR.scene_sizes(px), cover, 500, SIZE, 0.75, seed=5)


@query("u8_spectral_augmentation")
def _(t):
    """Seeded brightness, wobble, noise and dropout on window pixels."""
    px = A.pixels(t).withColumns({"height": F.lit(10), "width": F.lit(25), "valid": F.col("spectrum").isNotNull()})
    tiles = GR.tile_pixels(px, 8, 2)
    out = SH.augment_spectra(tiles, 64, seed=11)
    return out.select(*PK, "row_off", "col_off", rnd(F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("a30_dataset_profile", with_ctes(A.RASTER_SQL, body=f"""
SELECT cls, count(*) AS n_pixels, {r6('avg(CASE WHEN cls > 0 THEN onset END)')} AS mean_onset_infected FROM ra GROUP BY cls"""))
def _(t):
    return A.raster(t).groupBy("cls").agg(F.count(F.lit(1)).alias("n_pixels"), rnd(F.avg(F.when(F.col("cls") > 0, F.col("onset")))).alias("mean_onset_infected"))


@query("a21_class_breakdown", with_ctes(A.RASTER_SQL, body=f"""
, n AS (SELECT scene_id, count(*) AS total, coalesce(avg(CASE WHEN cls IN (1, 2) THEN onset END), avg(onset)) AS mo FROM ra WHERE valid GROUP BY 1)
SELECT scene_id, cls, {r6('100.0 * count(*) / any_value(total)')} AS share_pct, {r6('any_value(mo)')} AS mean_onset FROM ra JOIN n USING (scene_id) WHERE valid GROUP BY scene_id, cls"""))
def _(t):
    from canopyframe.operators.metrics import class_breakdown

    b = class_breakdown(A.raster(t).filter("valid"), ["scene_id"])
    return b.select("scene_id", "cls", rnd("share_pct").alias("share_pct"), rnd("mean_onset").alias("mean_onset"))

"""Grower-facing queries over zones and fields: filters, statistics, economics, probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.constants import CLASS_NAMES
from canopyframe.functions import rules
from canopyframe.functions.geometry import point_in_ring, ring_bounds, ring_centroid
from canopyframe.operators.ordered import ordinal
from canopyframe.session import broadcast_if_small, cut, deal

FIELD_SPAN = 0.25
MATRIX_MODES = ("all", "urgent", "high_risk", "early_stress", "healthy")


def first_vertex(ring: Column) -> tuple[Column, Column]:
    p = F.get(ring, F.lit(0))
    return F.get(p, F.lit(0)), F.get(p, F.lit(1))


def _cell_of(v: Column, step: float) -> Column:
    return F.floor(v / step).cast("int")


def split_by_load(rows: DataFrame, fields: DataFrame, cell: Sequence[str], load: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``cell`` with a further key ``_part`` that splits cells of more than ``load`` rows.

    Rows of such a cell are dealt to as many parts as they need, by a hash of the row, and the other side
    is copied to each. There are at most (all rows / ``load``) such cells.
    """
    counted = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > load)
    hot = cut(counted.select(*cell, F.ceil(F.col("_n") / load).cast("int").alias("_parts")))
    if hot.isEmpty():
        return rows.withColumn("_part", F.lit(0)), fields.withColumn("_part", F.lit(0))
    hot = broadcast_if_small(hot)
    dealt = rows.join(hot, list(cell), "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))).drop("_parts")
    copied = fields.join(hot, list(cell), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt, copied


#: Zones of one cell that meet fields in one task, and the step of the finer cells whose zones are summed before they meet a field.
CELL_LOAD = 100_000
FINE = FIELD_SPAN / 8


def zones_in_field(zones: DataFrame, fields: DataFrame, load: int | None = None) -> DataFrame:
    """Zones whose first vertex lies within 0.25 degrees of a field centre on both axes.

    Both sides are bucketed to 0.25-degree cells; only the fields are copied to their nine cells, so the
    larger side keeps one row per zone and the join is an equi-join. A cell with more than ``load`` zones is
    split into parts.
    """
    x, y = first_vertex(F.col("ring"))
    z = zones.withColumns({"_x": x, "_y": y}).withColumns({"_cx": _cell_of(F.col("_x"), FIELD_SPAN), "_cy": _cell_of(F.col("_y"), FIELD_SPAN)})
    spread = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    f = fields.withColumn("_dx", F.explode(spread)).withColumn("_dy", F.explode(spread))
    f = f.withColumns({"_cx": _cell_of(F.col("cx"), FIELD_SPAN) + F.col("_dx"), "_cy": _cell_of(F.col("cy"), FIELD_SPAN) + F.col("_dy")}).drop("_dx", "_dy")
    near = (F.abs(F.col("_x") - F.col("cx")) < FIELD_SPAN) & (F.abs(F.col("_y") - F.col("cy")) < FIELD_SPAN)
    z, f = split_by_load(z, f, ["_cx", "_cy"], CELL_LOAD if load is None else load)
    return z.join(f, ["_cx", "_cy", "_part"]).filter(near).drop("_cx", "_cy", "_x", "_y", "_part")


def _measures() -> tuple[dict[str, Column], dict[str, Column]]:
    """Partial values of a group of zones, and how partial values are put together."""
    cls, days = F.col("risk_class"), F.col("days_to_onset")
    first = {
        "n": F.count(F.lit(1)), "urgent": F.count_if((cls > 0) & (days <= 7)),
        "onset": F.min(F.when((cls > 0) & (days > 0) & (days < 30), days)),
        # Sums of decimals do not depend on the order in which parts meet.
        **{f"a{i}": F.sum(F.when(cls == i, F.col("area_acres").cast("decimal(28,9)"))) for i in range(len(CLASS_NAMES))}}
    merge = {k: F.min(k) if k == "onset" else F.sum(k) for k in first}
    return first, merge


def field_sums(zones: DataFrame, fields: DataFrame, load: int | None = None) -> DataFrame:
    """(field_id, n, urgent, onset, a0..a3, risky) of the zones that ``zones_in_field`` gives each field.

    The zones of a fine cell (an eighth of 0.25 degrees) are summed once, whatever the number of fields
    around them. Cells that lie wholly within a field's reach give it their sums; only zones of the cells
    on the rim meet the field one by one, and are summed there before they meet by the field's key.
    """
    x, y = first_vertex(F.col("ring"))
    z = zones.select(x.alias("_x"), y.alias("_y"), "risk_class", "days_to_onset", "area_acres")
    z = z.withColumns({"_sx": _cell_of(F.col("_x"), FINE), "_sy": _cell_of(F.col("_y"), FINE)})
    first, merge = _measures()
    cells = z.groupBy("_sx", "_sy").agg(*[c.alias(k) for k, c in first.items()])
    f = fields.select("field_id", "cx", "cy")
    for axis, centre in (("_sx", "cx"), ("_sy", "cy")):
        low, high = _cell_of(F.col(centre) - FIELD_SPAN, FINE), _cell_of(F.col(centre) + FIELD_SPAN, FINE)
        f = f.withColumn(axis, F.explode(F.sequence(low, high)))
        # Differences grow with the position, so ends inside the reach prove the cell inside.
        f = f.withColumn(f"_in{axis}", (F.col(axis) * FINE - F.col(centre) > -FIELD_SPAN) & ((F.col(axis) + 1) * FINE - F.col(centre) < FIELD_SPAN))
    whole = F.col("_in_sx") & F.col("_in_sy")
    inner = f.filter(whole).join(cells, ["_sx", "_sy"]).select("field_id", *first)
    near = (F.abs(F.col("_x") - F.col("cx")) < FIELD_SPAN) & (F.abs(F.col("_y") - F.col("cy")) < FIELD_SPAN)
    zr, fr = split_by_load(z, f.filter(~whole), ["_sx", "_sy"], CELL_LOAD if load is None else load)
    rim = zr.join(fr, ["_sx", "_sy", "_part"]).filter(near).groupBy("field_id").agg(*[c.alias(k) for k, c in first.items()])
    out = inner.unionByName(rim).groupBy("field_id").agg(*[c.alias(k) for k, c in merge.items()])
    risky = [F.coalesce(f"a{i}", F.lit(0).cast("decimal(38,9)")) for i in (1, 2, 3)]
    out = out.withColumn("risky", (risky[0] + risky[1] + risky[2]).cast("double"))
    return out.withColumns({f"a{i}": F.col(f"a{i}").cast("double") for i in range(len(CLASS_NAMES))})


def field_kpis(zones: DataFrame, fields: DataFrame) -> DataFrame:
    """``zone_kpis`` of every field that has zones, from partial sums."""
    acres = [F.coalesce(f"a{i}", F.lit(0.0)) for i in range(len(CLASS_NAMES))]
    g = field_sums(zones, fields).join(fields.select("field_id", F.col("acres").alias("total_acres")), "field_id")
    g = g.select("field_id", *[acres[i].alias(f"{CLASS_NAMES[i]}_acres") for i in (1, 2, 3)], F.col("risky").alias("at_risk_acres"),
                 F.coalesce("onset", F.lit(30.0)).alias("earliest_onset"), "total_acres")
    return g.withColumn("healthy_acres", F.greatest(F.lit(0.0), F.col("total_acres") - F.col("at_risk_acres")))


def field_matrix(zones: DataFrame, fields: DataFrame) -> DataFrame:
    """``zone_matrix`` of every field that has zones, from partial sums."""
    acres = [F.coalesce(f"a{i}", F.lit(0.0)).alias(f"_a{i}") for i in range(len(CLASS_NAMES))]
    return _matrix(field_sums(zones, fields).select("field_id", F.col("n").alias("total"), F.col("urgent").alias("urgent_count"), *acres), ["field_id"])


def visible_at(zones: DataFrame, horizon: float) -> DataFrame:
    """Zones shown at a forecast horizon: healthy ones, or onset at least 30 - horizon days."""
    return zones.filter((F.col("risk_class") == 0) | (F.col("days_to_onset") >= 30 - horizon))


def filter_zones(zones: DataFrame, mode: str = "all", horizon: float | None = None) -> DataFrame:
    """Zone table filter by category, optionally by horizon."""
    if mode not in MATRIX_MODES:
        raise ValueError(f"mode must be one of {MATRIX_MODES}")
    cls = F.col("risk_class")
    keep = {
        "all": F.lit(True), "urgent": (cls > 0) & (F.col("days_to_onset") <= 7),
        "high_risk": cls >= 2, "early_stress": cls == 1, "healthy": cls == 0,
    }[mode]
    out = zones.filter(keep)
    return out if horizon is None else visible_at(out, horizon)


SEARCHED = ("zone_id", "dominant_indicator", "recommended_action", "risk_class_name")


def search_zones(zones: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over four columns; blank text keeps everything."""
    if not text.strip():
        return zones
    hit = F.lit(False)
    for c in SEARCHED:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return zones.filter(hit)


def sort_matrix(zones: DataFrame, field: str, direction: str = "asc", tie: str = "zone_id") -> DataFrame:
    """Zone table order by one column, text case-folded, with a stable tie-break."""
    c = F.lower(field) if dict(zones.dtypes)[field] == "string" else F.col(field)
    return zones.orderBy(c.asc() if direction == "asc" else c.desc(), tie)


def _acres(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("area_acres"))), F.lit(0.0))


def zone_kpis(zones: DataFrame, keys: Sequence[str], total_acres: Column) -> DataFrame:
    """Acres per stressed class, at-risk and healthy acres, earliest positive onset below 30."""
    cls, days = F.col("risk_class"), F.col("days_to_onset")
    g = zones.groupBy(*keys).agg(
        *[_acres(cls == i).alias(f"{CLASS_NAMES[i]}_acres") for i in (1, 2, 3)],
        _acres(cls.isin(1, 2, 3)).alias("at_risk_acres"),
        F.coalesce(F.min(F.when((cls > 0) & (days > 0) & (days < 30), days)), F.lit(30.0)).alias("earliest_onset"),
        F.first(total_acres).alias("total_acres"))
    return g.withColumn("healthy_acres", F.greatest(F.lit(0.0), F.col("total_acres") - F.col("at_risk_acres")))


def js_round(x: Column) -> Column:
    """Round half up, towards plus infinity."""
    return F.floor(x + 0.5)


def zone_matrix(zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zone count, urgent count, total acres and whole percent of acres per class."""
    cls = F.col("risk_class")
    g = zones.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if((cls > 0) & (F.col("days_to_onset") <= 7)).alias("urgent_count"),
        *[_acres(cls == i).alias(f"_a{i}") for i in range(4)])
    return _matrix(g, keys)


def _matrix(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = F.col("_a0") + F.col("_a1") + F.col("_a2") + F.col("_a3")
    g = g.withColumn("_t", F.when(s == 0, F.lit(1.0)).otherwise(s))
    return g.select(*keys, "total", "urgent_count", F.round("_t", 1).alias("total_acres"),
                    *[js_round(F.col(f"_a{i}") / F.col("_t") * 100).alias(f"{n}_pct") for i, n in enumerate(CLASS_NAMES)])


def roi(df: DataFrame, at_risk: str = "at_risk_acres", total: str = "total_acres", price: float = 1250.0) -> DataFrame:
    """Value at risk, blanket and targeted treatment cost, savings and percent saved."""
    a, t = F.col(at_risk), F.col(total)
    d = df.withColumns({
        "value_at_risk": js_round(a * price), "blanket_cost": js_round(t * 14.5), "targeted_cost": js_round(a * 22.0)})
    d = d.withColumn("savings", F.greatest(F.lit(0), F.col("blanket_cost") - F.col("targeted_cost")))
    return d.withColumn("saved_pct", js_round(F.col("savings") / F.greatest(F.lit(1), F.col("blanket_cost")) * 100))


def prevented_loss(zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report form (85 % of 680 per acre) and verifier form (per-acre savings on rounded acres)."""
    risky = F.col("risk_class") > 0
    per_acre = 1200.0 * 0.40 + (85.0 - 18.0)
    g = zones.groupBy(*keys).agg(
        _acres(risky).alias("at_risk_acres"), F.min("days_to_onset").alias("earliest_onset"),
        F.sum(F.bround("area_acres", 2)).alias("listed_acres"), F.avg(F.bround("days_to_onset", 1)).alias("mean_lead_days"))
    return g.withColumns({
        "loss_prevented": js_round(F.col("at_risk_acres") * 680 * 0.85),
        "estimated_savings": F.bround(F.col("listed_acres") * per_acre, 2)})


def prescription(zones: DataFrame) -> DataFrame:
    """Prescribed compound and application rate by class."""
    return zones.withColumns({
        "prescribed_compound": rules.lookup(F.col("risk_class"), rules.COMPOUNDS),
        "vra_drone_dosage": rules.lookup(F.col("risk_class"), rules.DOSAGES)})


def indicator_text(zones: DataFrame) -> DataFrame:
    """Display label and advice by indicator."""
    ind = rules.canonical_indicator(F.col("dominant_indicator"))
    return zones.withColumns({
        "indicator_label": rules.lookup(ind, rules.INDICATOR_LABELS), "indicator_advice": rules.lookup(ind, rules.INDICATOR_ADVICE)})


def focus_zone(zones: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First zone of class 2 per key, else the first zone."""
    rank = F.struct((F.col("risk_class") != 2).alias("other"), F.col(order))
    return zones.groupBy(*keys).agg(F.min_by(F.struct("zone_id", "risk_class"), rank).alias("z")).select(*keys, "z.zone_id", "z.risk_class")


def survey_route(zones: DataFrame, fields: DataFrame, order: str, horizon: float = 30.0) -> DataFrame:
    """Way-points per field: boundary corner, each stressed zone's first vertex, back to the corner.

    One row per way-point with its position, so a field with very many zones is never gathered
    into one array; positions come from chunk offsets. Points are (lat, lon).
    """
    vis = visible_at(zones_in_field(zones, fields), horizon).filter(F.col("risk_class") >= 1)
    x, y = first_vertex(F.col("ring"))
    hx, hy = first_vertex(F.col("boundary"))
    stops = ordinal(vis.select("field_id", F.col(order).alias("_o"), y.alias("lat"), x.alias("lon")), ["field_id"], ["_o"], "position")
    ends = vis.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), F.first(hy).alias("lat"), F.first(hx).alias("lon"))
    both = ends.select("field_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("n") + 1)).alias("position"), "lat", "lon")
    return stops.select("field_id", F.col("position").cast("bigint").alias("position"), "lat", "lon").unionByName(both)


CELL = 0.004


LEVELS = 18  # cell sizes double per level; the last one spans the globe


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / (CELL * F.pow(F.lit(2.0), level))).cast("bigint")


def probe(points: DataFrame, zones: DataFrame, fields: DataFrame, order: str = "k") -> DataFrame:
    """Diagnose points: first containing zone, else a nearby zone inside the field, else defaults.

    ``points``: probe_id, field_id, lon, lat. ``zones``: zone columns with ``ring`` and an order
    column. For containment a zone goes to the cell size that fits its extent, so it is copied to
    at most four cells however large it is, and a point goes to its cell of every size. For the
    nearest zone the centroids are copied to their neighbouring cells. Both lookups are equi-joins
    whose pairs are reduced, without sorting them, to a number per probe: the zones are numbered by
    ``order``, and of the nearest ones the least number is looked for once their distance is known.
    A zone without an order contains nothing.
    """
    zero = F.lit(0)
    points = cut(deal(points))
    zones = cut(ordinal(zones, [], [order], "_n"))
    own = points.withColumns({"_cx": _cell(F.col("lon"), zero), "_cy": _cell(F.col("lat"), zero)})
    keep = F.struct(order, "zone_id", "risk_class", "risk_class_name", "risk_score", "days_to_onset", "dominant_indicator")
    b = ring_bounds(F.col("ring"))
    extent = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"], F.lit(CELL))
    level = F.least(F.lit(LEVELS - 1), F.ceil(F.log2(extent / CELL)).cast("int"))
    named = zones.select("_n", keep.alias("z"))
    zb = zones.filter(F.col(order).isNotNull()).select("_n", "ring", level.alias("_lv"), *[v.alias(f"_{k}") for k, v in b.items()])
    for axis, lo, hi in (("_cx", "_minx", "_maxx"), ("_cy", "_miny", "_maxy")):
        zb = zb.withColumn(axis, F.explode(F.sequence(_cell(F.col(lo), F.col("_lv")), _cell(F.col(hi), F.col("_lv")))))
    spread = points.select("probe_id", "lon", "lat", F.explode(F.sequence(zero, F.lit(LEVELS - 1))).alias("_lv"))
    spread = spread.withColumns({"_cx": _cell(F.col("lon"), F.col("_lv")), "_cy": _cell(F.col("lat"), F.col("_lv"))})
    near_box = F.col("lon").between(F.col("_minx"), F.col("_maxx")) & F.col("lat").between(F.col("_miny"), F.col("_maxy"))
    hit = spread.join(zb, ["_lv", "_cx", "_cy"]).filter(near_box).filter(point_in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    inside = hit.groupBy("probe_id").agg(F.min("_n").alias("_n")).join(named, "_n").select("probe_id", F.col("z").alias("hit"))

    mx, my = ring_centroid(F.col("ring"))
    zc = zones.select("_n", mx.alias("mx"), my.alias("my"))
    around = F.array(*[F.lit(d).cast("bigint") for d in (-1, 0, 1)])
    zc = zc.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    zc = zc.withColumns({"_cx": F.floor(F.col("mx") / CELL) + F.col("_dx"), "_cy": F.floor(F.col("my") / CELL) + F.col("_dy")})
    gap = F.sqrt((F.col("lon") - F.col("mx")) * (F.col("lon") - F.col("mx")) + (F.col("lat") - F.col("my")) * (F.col("lat") - F.col("my")))
    least = own.join(zc, ["_cx", "_cy"]).withColumn("_d", gap).filter(F.col("_d") < 0.004).groupBy("probe_id").agg(F.min("_d").alias("_least"))
    near = own.join(least, "probe_id").join(zc, ["_cx", "_cy"]).filter(gap == F.col("_least"))
    nearest = near.groupBy("probe_id").agg(F.min("_n").alias("_n")).join(named, "_n").select("probe_id", F.col("z").alias("near"))

    f = fields.select("field_id", F.col("name").alias("field_name"), "boundary")
    d = points.join(f, "field_id", "left").join(inside, "probe_id", "left").join(nearest, "probe_id", "left")
    in_field = F.coalesce(point_in_ring(F.col("lon"), F.col("lat"), F.col("boundary")), F.lit(False))
    kind = F.when(F.col("hit").isNotNull(), "zone").when(in_field & F.col("near").isNotNull(), "buffer").when(in_field, "field").otherwise("soil")
    d = d.withColumn("kind", kind)
    pick = lambda zone, buf, field, soil: (
        F.when(F.col("kind") == "zone", zone).when(F.col("kind") == "buffer", buf).when(F.col("kind") == "field", field).otherwise(soil))
    z, n = F.col("hit"), F.col("near")
    label = lambda c: F.concat(F.lit("Zone "), F.upper(F.replace(c, F.lit("zone-"), F.lit(""))))
    return d.select(
        "probe_id", "field_id", "lon", "lat", "kind",
        pick(z.zone_id, n.zone_id, F.lit(None), F.lit(None)).alias("zone_id"),
        pick(z.risk_class, F.lit(1), F.lit(0), F.lit(0)).alias("risk_class"),
        pick(z.risk_class_name, F.lit("early_stress"), F.lit("healthy"), F.lit("healthy")).alias("risk_class_name"),
        pick(z.risk_score, F.round(n.risk_score * 0.65, 2), F.lit(0.08), F.lit(0.02)).alias("risk_score"),
        pick(z.days_to_onset, F.round(n.days_to_onset + 4.5, 1), F.lit(30.0), F.lit(30.0)).alias("days_to_onset"),
        pick(z.dominant_indicator, n.dominant_indicator, F.lit("baseline"), F.lit("baseline")).alias("dominant_indicator"),
        pick(label(z.zone_id), F.concat(label(n.zone_id), F.lit(" Peripheral Buffer")), F.concat(F.col("field_name"), F.lit(" Baseline Parcel")),
             F.lit("External Field Boundary (Bare Soil / Fallow)")).alias("zone_name"))


def probe_text(p: DataFrame) -> DataFrame:
    """Diagnostic note and intervention by class and soil flag; needs ``kind, risk_class, days_to_onset, pri``."""
    code = F.when(F.col("kind") == "soil", F.lit(-1)).otherwise(F.col("risk_class"))
    pri = F.col("pri").cast("string")

    def note(k):
        text = rules.PROBE_NOTES[k]
        return F.format_string(text, F.col("days_to_onset"), pri) if "%" in text else F.lit(text)

    notes = F.when(code == -1, note(-1)).when(code == 2, note(2)).when(code == 1, note(1)).when(code == 3, note(3)).otherwise(note(None))
    return p.withColumns({"diagnostic_notes": notes, "recommended_intervention": rules.lookup(code, rules.PROBE_INTERVENTIONS)})


def probe_spectra(probes: DataFrame, px: DataFrame) -> DataFrame:
    """Attach the measured spectrum to probes that carry (scene_id, row, col)."""
    return probes.join(px.select("scene_id", "row", "col", "spectrum"), ["scene_id", "row", "col"], "left")

"""Risk zones: classes, candidates, components, statistics, outlines and contract rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe import constants as K
from canopyframe.functions import bandmath, rules
from canopyframe.functions import projection as P
from canopyframe.functions.geometry import polygon_acres
from canopyframe.operators.blocks import border_pairs, open_and_label
from canopyframe.operators.components import connected
from canopyframe.operators.ordered import ordinal
from canopyframe.operators.outlines import zone_rings
from canopyframe.operators.quantiles import exact_percentiles
from canopyframe.session import broadcast_if_small, cut

KEYS = ("scene_id", "risk_class")
PROBS = ("p0", "p1", "p2", "p3")


def classify(risk: DataFrame) -> DataFrame:
    """Class of the largest probability (first wins) and clipped risk; NULL where not valid.

    Plain comparisons instead of array functions: they compile, and stay small when a filter on
    the class is pushed down into them.
    """
    p = [F.col(c) for c in PROBS]
    cls = F.when(p[0] >= F.greatest(*p[1:]), 0).when(p[1] >= F.greatest(p[2], p[3]), 1).when(p[2] >= p[3], 2).otherwise(3)
    return risk.withColumns({
        "risk_class": F.when(F.col("valid"), cls), "risk": F.when(F.col("valid"), rules.risk_score(F.col("p0")))})


def zone_candidates(risk: DataFrame, min_prob: float = 0.4) -> DataFrame:
    """Pixels of a stressed class whose own (that is, the largest) probability reaches ``min_prob``."""
    return classify(risk.filter(F.greatest(*PROBS) >= min_prob)).filter(F.col("risk_class") > 0)


def label_zones(mask: DataFrame, iterations: int = 1, block: int = 256, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Opened pixels with block-local labels, and the map from local labels to zone labels.

    The map holds only labels that touch a block border; all others are their own zone.
    """
    labelled = cut(open_and_label(mask, KEYS, iterations, block, tuple(carry)))
    pairs = border_pairs(labelled, KEYS, block)
    node = lambda c: F.struct(*KEYS, F.col(c).alias("label"))
    roots = connected(pairs.select(node("a").alias("a"), node("b").alias("b")))
    mapping = roots.select("node.scene_id", "node.risk_class", "node.label", F.col("root.label").alias("root"))
    return labelled, mapping


def components(mask: DataFrame, iterations: int = 0, block: int = 256) -> DataFrame:
    """Every pixel of the (opened) mask with the smallest pixel key of its component."""
    labelled, mapping = label_zones(mask, iterations, block)
    return with_zone(labelled, mapping)


def with_zone(labelled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace block-local labels by zone labels: column ``zone``."""
    side = broadcast_if_small(mapping)
    return labelled.join(side, [*KEYS, "label"], "left").withColumn("zone", F.coalesce("root", "label")).drop("root")


def zone_stats(labelled: DataFrame, mapping: DataFrame, means: Sequence[str] = ("onset", "risk")) -> DataFrame:
    """Pixel count, bounding box and means per zone, in two aggregation steps.

    The first step is per block-local label (bounded by the block), so a zone that holds a
    third of all pixels arrives at the second step as one row per block.
    """
    box = {"row": ("min_row", "max_row"), "col": ("min_col", "max_col")}
    first = labelled.groupBy(*KEYS, "label").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        *[f(x).alias(n) for x, (lo, hi) in box.items() for f, n in ((F.min, lo), (F.max, hi))],
        *[F.sum(m).alias(f"s_{m}") for m in means], *[F.count(m).alias(f"c_{m}") for m in means])
    merged = with_zone(first, mapping)
    return merged.groupBy(*KEYS, "zone").agg(
        F.sum("n_pixels").alias("n_pixels"), F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"),
        F.min("min_col").alias("min_col"), F.max("max_col").alias("max_col"),
        *[F.try_divide(F.sum(f"s_{m}"), F.sum(f"c_{m}")).alias(m) for m in means])


def min_size(stats: DataFrame, px_acres: Column, min_acres: float = 1.0) -> DataFrame:
    """Keep zones of at least ``ceil(min_acres / pixel acres)`` pixels (and at least one)."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(float(min_acres)) / px_acres))
    return stats.filter(F.col("n_pixels") >= F.when(px_acres > 0, need).otherwise(F.lit(1)))


def zone_edges(labelled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unit outline edges of every zone as directed steps with the zone on the right hand."""
    z = with_zone(labelled.filter(F.col("sides") > 0), mapping)
    x, y = F.col("col"), F.col("row")
    side = lambda bit, x0, y0, x1, y1: F.when(
        F.col("sides").bitwiseAND(bit) != 0, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    steps = F.array(side(1, x, y, x + 1, y), side(2, x + 1, y, x + 1, y + 1), side(4, x + 1, y + 1, x, y + 1), side(8, x, y + 1, x, y))
    flat = z.select(*KEYS, "zone", F.explode(F.array_compact(steps)).alias("s"))
    return flat.select(*KEYS, "zone", "s.x0", "s.y0", "s.x1", "s.y1")


def largest_part(parts: DataFrame, keys: Sequence[str], area: str) -> DataFrame:
    """The part with the largest area per key; smaller ``part`` wins a tie."""
    return parts.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(area, -F.col("part"))).alias("_b")).select("_b.*")


def to_map_coordinates(rings: DataFrame) -> DataFrame:
    """Pixel-corner rings to UTM metres by the scene's affine columns."""
    move = lambda p: F.array(
        F.col("a") * F.get(p, F.lit(0)) + F.col("b") * F.get(p, F.lit(1)) + F.col("c"),
        F.col("d") * F.get(p, F.lit(0)) + F.col("e") * F.get(p, F.lit(1)) + F.col("f"))
    return rings.withColumn("rings_utm", F.transform("rings", lambda r: F.transform(r, move)))


def scene_reference(px: DataFrame, wavelengths: Sequence[float], max_side: int | None = None) -> DataFrame:
    """Zone indices of the per-band medians over each scene's valid pixels (exact by default)."""
    src = px if max_side is None else decimate(px, max_side)
    picks = {nm: bandmath.nearest_index(wavelengths, nm) for nm in bandmath.ZONE_BANDS_NM}
    rows = src.filter(F.col("spectrum").isNotNull()).select("scene_id", F.explode(F.array(*[
        F.struct(F.lit(nm).alias("nm"), F.get("spectrum", F.lit(i)).cast("double").alias("v")) for nm, i in picks.items()])).alias("b"))
    med = exact_percentiles(rows.select("scene_id", "b.nm", "b.v"), ["scene_id", "nm"], "v", [0.5])
    wide = med.groupBy("scene_id").agg(*[F.max(F.when(F.col("nm") == nm, F.col("q0"))).alias(f"b{nm}") for nm in picks])
    cols = bandmath.zone_index_columns(lambda nm: F.col(f"b{int(nm)}"))
    return wide.select("scene_id", *[c.alias(f"ref_{n}") for n, c in cols.items()])


def decimate(px: DataFrame, max_side: int) -> DataFrame:
    """Regular coarse sample: every k-th row and column so that no side exceeds ``max_side``.

    Needs ``height`` and ``width`` columns.
    """
    k = F.greatest(F.lit(1), F.ceil(F.greatest("height", "width") / F.lit(max_side)).cast("int"))
    return px.filter((F.col("row") % k == 0) & (F.col("col") % k == 0))


def zone_indices(zone_px: DataFrame, wavelengths: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Zone indices of the mean bands over each zone's valid pixels (map-side combined means)."""
    picks = {nm: bandmath.nearest_index(wavelengths, nm) for nm in bandmath.ZONE_BANDS_NM}
    means = zone_px.groupBy(*keys).agg(*[F.avg(F.get("spectrum", F.lit(i)).cast("double")).alias(f"b{nm}") for nm, i in picks.items()])
    cols = bandmath.zone_index_columns(lambda nm: F.col(f"b{int(nm)}"))
    return means.select(*keys, *[c.alias(n) for n, c in cols.items()])


def dominant_indicator(zones: DataFrame, reference: DataFrame) -> DataFrame:
    """Indicator with the largest scaled drop against the scene; first in order wins a tie."""
    j = zones.join(broadcast_if_small(reference), "scene_id", "left")
    drops = F.array(*[
        F.struct(((F.col(f"ref_{n}") - F.col(n)) / scale).alias("drop"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (n, scale, name) in enumerate(K.INDICATOR_SCALES)])
    best = F.array_max(F.filter(drops, lambda s: s.drop.isNotNull()))
    return j.withColumn("dominant_indicator", F.coalesce(best["name"], F.lit("red_edge_shift")))


def label_indicators(px: DataFrame, wavelengths: Sequence[float], labelled: DataFrame, mapping: DataFrame) -> DataFrame:
    """(scene_id, risk_class, zone, dominant_indicator) of labelled pixels that have a spectrum in ``px``.

    Band sums are combined per block-local label first, so a giant zone reaches the second step as one
    row per block.
    """
    picks = {nm: bandmath.nearest_index(wavelengths, nm) for nm in bandmath.ZONE_BANDS_NM}
    bands = px.filter(F.col("spectrum").isNotNull()).select(
        "scene_id", "row", "col", *[F.get("spectrum", F.lit(i)).cast("double").alias(f"b{nm}") for nm, i in picks.items()])
    sums = labelled.select(*KEYS, "row", "col", "label").join(bands, ["scene_id", "row", "col"]).groupBy(*KEYS, "label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"b{nm}").alias(f"b{nm}") for nm in picks])
    means = with_zone(sums, mapping).groupBy(*KEYS, "zone").agg(*[(F.sum(f"b{nm}") / F.sum("n")).alias(f"b{nm}") for nm in picks])
    cols = bandmath.zone_index_columns(lambda nm: F.col(f"b{int(nm)}"))
    zones = means.select(*KEYS, "zone", *[c.alias(n) for n, c in cols.items()])
    return dominant_indicator(zones, scene_reference(px, wavelengths)).select(*KEYS, "zone", "dominant_indicator")


def extract_zones(
    risk: DataFrame, scenes: DataFrame, min_prob: float = 0.4, min_acres: float = 1.0, iterations: int = 1,
    area: str = "pixels", simplify_px: float = 0.5, block: int = 256, indicators: DataFrame | None = None,
    px: DataFrame | None = None, wavelengths: Sequence[float] | None = None,
) -> DataFrame:
    """Contract zones from a stitched risk table.

    ``risk``: scene_id, row, col, p0..p3, onset, valid. ``scenes``: scene_id, affine a..f, epsg.
    ``area="pixels"`` counts pixels; ``area="polygon"`` measures the simplified outline and adds
    its WGS84 ``coordinates``. ``px`` (with a ``spectrum`` per pixel)
    and its ``wavelengths`` give every zone its dominant indicator; ``indicators`` may bring ready names
    per (scene_id, risk_class, zone) instead. Without either it is the red-edge shift.
    """
    mask = zone_candidates(risk, min_prob).select(*KEYS, "row", "col", "onset", "risk")
    labelled, mapping = label_zones(mask, iterations, block, ("onset", "risk"))
    acres = F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d")) / K.SQM_PER_ACRE
    stats = zone_stats(labelled, mapping).join(broadcast_if_small(scenes.select("scene_id", *"abcdef", "epsg")), "scene_id")
    z = min_size(stats, acres, min_acres)
    if area == "polygon":
        rings = zone_rings(zone_edges(labelled, mapping), simplify_px, block)
        z = to_map_coordinates(z.join(rings, [*KEYS, "zone"]))
        z = z.withColumn("area", polygon_acres(F.col("rings_utm"))).withColumn("coordinates", P.to_wgs84(F.col("rings_utm"), F.col("epsg")))
    else:
        z = z.withColumn("area", F.col("n_pixels") * acres)
    if indicators is None and px is not None:
        indicators = label_indicators(px, wavelengths, labelled, mapping)
    if indicators is not None:
        z = z.join(indicators, [*KEYS, "zone"], "left")
    else:
        z = z.withColumn("dominant_indicator", F.lit(None).cast("string"))
    days = rules.clip_onset(F.col("onset"))
    ind = F.coalesce("dominant_indicator", F.lit("red_edge_shift"))
    tail = ["coordinates"] if area == "polygon" else []
    return z.select(
        *KEYS, "zone", rules.class_name(F.col("risk_class")).alias("risk_class_name"), "n_pixels",
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk"))), 4).alias("risk_score"),
        F.bround("area", 3).alias("area_acres"), F.col("area").alias("raw_acres"), F.bround(days, 2).alias("days_to_onset"),
        ind.alias("dominant_indicator"), rules.recommended_action(F.col("risk_class"), days, ind).alias("recommended_action"),
        "min_row", "max_row", "min_col", "max_col", *tail)


def sort_zones(zones: DataFrame) -> DataFrame:
    """Class descending, rounded score descending, then first pixel for a stable order."""
    return zones.orderBy(F.desc("risk_class"), F.desc("risk_score"), "zone")


def number_zones(zones: DataFrame, keys: Sequence[str] = ("scene_id",), tie: str = "zone") -> DataFrame:
    """Display ids ``z-001`` in sort order per key, without a single-task window."""
    n = ordinal(zones, list(keys), [F.desc("risk_class"), F.desc("risk_score"), F.col(tie)], "n")
    text = F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))
    return n.withColumn("zone_id", F.concat(F.lit("z-"), text))


def job_summary(risk: DataFrame, zones: DataFrame, px_acres: Column | float) -> DataFrame:
    """Acres analysed, acres at risk and zone counts per class (zero where a class is absent).

    Unrounded areas are summed, and the sum is rounded once.
    """
    acres = px_acres if isinstance(px_acres, Column) else F.lit(float(px_acres))
    seen = risk.groupBy("scene_id").agg(F.round(F.count_if("valid") * acres, 3).alias("acres_analyzed"))
    per = zones.groupBy("scene_id").agg(
        F.round(F.sum("raw_acres"), 3).alias("acres_at_risk"),
        *[F.count_if(F.col("risk_class") == i).alias(f"n_{n}") for i, n in enumerate(K.CLASS_NAMES)])
    out = seen.join(per, "scene_id", "left")
    return out.select(
        "scene_id", "acres_analyzed", F.coalesce("acres_at_risk", F.lit(0.0)).alias("acres_at_risk"),
        *[F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in K.CLASS_NAMES])

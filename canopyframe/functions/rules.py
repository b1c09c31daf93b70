"""Decision rules on classes, onset days and indicators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyframe.constants import CLASS_NAMES, MAX_ONSET_DAYS

# Wording of the recommended actions.
ACTION_VISIBLE = "Apply curative fungicide immediately and remove infected plants"
ACTION_HIGH = "Apply targeted preventative fungicide within "
ACTION_EARLY = "Scout zone within 3 days and increase monitoring frequency"
ACTION_NONE = "No action required"
ACTION_IRRIGATION = "; check irrigation"

# Prescribed compound and application rate by class (default last).
COMPOUNDS = {
    2: "Azoxystrobin 250 SC (0.8 L/ha) + Difenoconazole (0.5 L/ha)",
    1: "Bacillus subtilis QST 713 (2.0 L/ha) + Copper Hydroxide (1.5 kg/ha)",
    3: "Curative systemic triazole (Prothioconazole / Tebuconazole @ 1.0 L/ha)",
    None: "No chemical application. Maintain baseline multispectral monitoring.",
}
DOSAGES = {
    2: "UAV VRA: 22.0 L/ha carrier volume, 110-02 nozzles, coarse droplets, 3.0 m altitude",
    1: "UAV VRA: 18.0 L/ha carrier volume, 110-015 nozzles, medium droplets, 3.5 m altitude",
    3: "Ground Rig: 200 L/ha high-volume canopy drench, 3.5 bar",
    None: "Exclusion Zone (0 L/ha)",
}

# Display labels and demo advice by indicator (default last).
INDICATOR_LABELS = {
    "red_edge_shift": "Red-Edge Shift (705nm)",
    "pri_decline": "PRI Deficit (531nm)",
    "chlorophyll_loss": "Chlorophyll Decline (680nm)",
    "water_stress": "Water Band (970nm)",
    None: "Baseline Phenology",
}
INDICATOR_ADVICE = {
    "pri_decline": "Apply targeted bio-fungicide to North-East sector within 5 days to mitigate xanthophyll stress.",
    "red_edge_shift": "Early cellular structure breakdown observed. Initiate preventative copper spray.",
    "chlorophyll_loss": "Chlorophyll deficit detected. Schedule drone inspection and foliar nutrition.",
    "water_stress": "Canopy water absorption deficit. Optimize drip irrigation and check root pressure.",
    None: "Monitor field closely with next satellite pass.",
}

# Probe intervention text by class; -1 stands for bare soil.
PROBE_INTERVENTIONS = {
    -1: "No agronomic treatment required for boundary parcel.",
    2: "Schedule targeted Variable-Rate Application (VRA) preventative bio-fungicide (e.g. Serenade ASO / Bacillus amyloliquefaciens at 2.5 L/ha) within 72 hours.",
    1: "Deploy multispectral high-resolution scouting drone at 15m AGL. Re-image in 4 days to confirm whether stress resolves or advances.",
    3: "Emergency curative fungicide barrier application to ring-fence the focal infection and contain airborne spore release.",
    None: "Maintain routine baseline satellite monitoring. No treatment or intervention necessary.",
}
PROBE_NOTES = {
    -1: "Sampled pixel falls outside active vegetative canopy. Spectrum matches dry mineral soil / fallow border with flat absorption profile.",
    2: "High-confidence pre-symptomatic blight alert (~%.1f days to symptom expression). Severe 705nm red-edge inflection shift (-16nm blue-shift) with prominent xanthophyll cycle PRI depression (%s).",
    1: "Early physiological stress anomaly detected (~%.1f days before visible symptoms). Photochemical Reflectance Index is depressed (%s), indicating sub-visual light-use efficiency drop.",
    3: "Active necrotic lesion zone. Major chlorophyll breakdown, red absorption collapse at 670nm, and mesophyll cell wall disintegration.",
    None: "Canopy in prime photosynthetic health. High chlorophyll content, steep red-edge slope (REP 724.8nm), and optimal water retention.",
}


def lookup(key: Column, table: dict) -> Column:
    """A small fixed table as CASE branches; the ``None`` entry is the default."""
    out = None
    for k, v in table.items():
        if k is None:
            continue
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(table[None]))


def class_name(cls: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in CLASS_NAMES]), cls)


def canonical_indicator(name: Column) -> Column:
    """One spelling for the photochemical indicator."""
    return F.when(name == "pri_drop", "pri_decline").otherwise(name)


def label_for_days(days: Column, infected: Column, early_min: float = 7.0, infected_max: float = 25.0) -> Column:
    """Class from days to symptoms: none beyond ``infected_max``, visible at or below zero."""
    return (
        F.when(~infected | (days > infected_max), 0)
        .when(days > early_min, 1)
        .when(days > 0, 2)
        .otherwise(3)
    )


def onset_for_days(days: Column, infected: Column, infected_max: float = 25.0) -> Column:
    inside = infected & (days <= infected_max)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(MAX_ONSET_DAYS), days.cast("double")))
    return F.when(inside, clipped).otherwise(F.lit(MAX_ONSET_DAYS))


def first_max(probs: Column) -> Column:
    """Index of the largest score; the first one wins a tie."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def risk_score(p_healthy: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - p_healthy))


def recommended_action(cls: Column, days: Column, indicator: Column) -> Column:
    base = (
        F.when(cls == 3, F.lit(ACTION_VISIBLE))
        .when(cls == 2, F.concat(F.lit(ACTION_HIGH), F.when(days < 7, "48 hours").otherwise("7 days")))
        .when(cls == 1, F.lit(ACTION_EARLY))
        .otherwise(F.lit(ACTION_NONE))
    )
    dry = (indicator == "water_stress") & (cls != 0)
    return F.concat(base, F.when(dry, F.lit(ACTION_IRRIGATION)).otherwise(F.lit("")))


# Labels of the forecast horizon, and the last day of the middle one.
HORIZON_TODAY = "Today (Visible Outbreak)"
HORIZON_NEAR = "Acute Blight Spread"
HORIZON_FAR = "Pre-Visual Incubation"
HORIZON_NEAR_DAYS = 7


def horizon_label(days: Column) -> Column:
    return F.when(days == 0, HORIZON_TODAY).when(days <= HORIZON_NEAR_DAYS, HORIZON_NEAR).otherwise(HORIZON_FAR)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Temperature softmax, shifted by the maximum for stability."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp((z - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def clip_onset(days: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(MAX_ONSET_DAYS), days))


# Colour stops of the risk ramp (risk, red, green, blue) and opacity.
RAMP = ((0.0, 26.0, 152.0, 80.0), (0.5, 254.0, 224.0, 54.0), (1.0, 215.0, 48.0, 39.0))
ALPHA = 210


def colorize(risk: Column, valid: Column) -> dict[str, Column]:
    """Piecewise-linear ramp; channel values are truncated, invalid pixels transparent."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(risk, F.lit(0.0)), F.lit(0.0))))
    out = {}
    for n, name in enumerate(("red", "green", "blue"), start=1):
        lower = RAMP[0][n] + (RAMP[1][n] - RAMP[0][n]) * r / 0.5
        upper = RAMP[1][n] + (RAMP[2][n] - RAMP[1][n]) * (r - 0.5) / 0.5
        out[name] = F.floor(F.when(r <= 0.5, lower).otherwise(upper)).cast("int")
    out["alpha"] = F.when(valid, F.lit(ALPHA)).otherwise(F.lit(0))
    return out


# Progress of a job by step; scoring starts at the first value of its pair and adds up to the second.
PROGRESS = {"started": 0.01, "loading": 0.05, "stitching": 0.88, "zoning": 0.95, "succeeded": 1.0}
PROGRESS_SCORING = (0.10, 0.75)


def progress_of(step: Column, done: Column, total: Column) -> Column:
    """Progress fraction of a job by step name; scoring advances with the windows done."""
    start, span = PROGRESS_SCORING
    out = F.when(step == "scoring", start + span * done / F.greatest(F.lit(1), total))
    for name, value in PROGRESS.items():
        out = out.when(step == name, value)
    return out

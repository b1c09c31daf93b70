"""Values fixed by the data contract; results only match when these do."""

CONTRACT_VERSION = "1.0.0"
N_BANDS = 200
NODATA = -1.0
WINDOW_SIZE = 64
WINDOW_OVERLAP = 16
BLOCK_SIZE = 256
MAX_ONSET_DAYS = 30.0
SQM_PER_ACRE = 4046.8564224

# Class codes and names.
CLASS_NAMES = ("healthy", "early_stress", "high_blight_risk", "visible_disease")
VALID_SOURCES = ("hyperion", "enmap", "prisma", "synthetic")
JOB_STATES = ("queued", "running", "succeeded", "failed", "cancelled")

# Water-vapour windows and usable range, nm.
WATER_WINDOWS_NM = ((1340.0, 1460.0), (1790.0, 1960.0))
USABLE_RANGE_NM = (380.0, 2510.0)

# Spectral regions of each stress indicator, nm, in tie-break order.
INDICATOR_REGIONS_NM = (
    ("red_edge_shift", ((690.0, 760.0),)),
    ("pri_decline", ((520.0, 580.0),)),
    ("chlorophyll_loss", ((400.0, 515.0), (585.0, 690.0))),
    ("water_stress", ((940.0, 1000.0), (1150.0, 1250.0), (1350.0, 2500.0))),
)

# Zone index scales, in tie-break order (index, scale, indicator name).
INDICATOR_SCALES = (
    ("reip", 5.0, "red_edge_shift"),
    ("pri", 0.02, "pri_decline"),
    ("ci_re", 0.25, "chlorophyll_loss"),
    ("ndwi", 0.05, "water_stress"),
)

# Physical constants for the black-body sun.
SUN_RADIUS_M = 6.957e8
AU_M = 1.495978707e11
SUN_TEMP_K = 5778.0
PLANCK = 6.62607015e-34
LIGHT_SPEED = 2.99792458e8
BOLTZMANN = 1.380649e-23

CANONICAL_FWHM_NM = 10.55
CANONICAL_FWHM_NM_MEAN = 2100.0 / 199.0


def canonical_wavelengths() -> list[float]:
    """The contract grid: 200 evenly spaced centres from 400 to 2500 nm, two decimals."""
    return [round(400.0 + 2100.0 * i / (N_BANDS - 1), 2) for i in range(N_BANDS)]

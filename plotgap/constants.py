"""Physical constants, class edges and thresholds that the results depend on."""

# Geodesy
EARTH_RADIUS_M = 6_371_008.8
M_PER_DEG = 111_195.0
NM_M = 1852.0
KNOTS_TO_MPS = 0.514444

# Plausibility per domain: max speed m/s, max acceleration m/s2, nominal interval s, sigma m
PLAUSIBILITY = {
    "air": (340.0, 15.0, 1.0, 10.0),
    "sea": (26.0, 1.0, 180.0, 50.0),
}
TOLERANCE = 1.10

# Matching
K_SIGMA = 3.0
DEFAULT_LENGTH_M = 50.0
MAX_FIX_UNCERTAINTY_M = 2000.0
MATCH_WINDOW_S = 1800.0
SPLIT_GAP_S = 1800.0

# Reception
RECEPTION_CELL_DEG = 0.05
LONG_GAP_S = 180.0
MAX_GAP_S = 3600.0
MIN_VESSELS = 3
MIN_PRESENCE = 0.05
STALE_S = 60.0

# Searched water
LEVELS = 10
SEARCHED = 0.5

# Altitude bands: upper edges in metres
GROUND = "on ground"
ALTITUDE_BANDS = [(1000.0, "0-1 km"), (3000.0, "1-3 km"), (6000.0, "3-6 km"),
                  (9000.0, "6-9 km"), (12000.0, "9-12 km"), (None, "12+ km")]

# Distance bands in nautical miles
BAND_EDGES_NM = [0.0, 1.0, 2.0, 5.0, 10.0, 25.0]
BAND_NAMES = ["0-1 nm", "1-2 nm", "2-5 nm", "5-10 nm", "10-25 nm", "> 25 nm"]
SIGNED_EDGES_NM = [-25.0, -10.0, -5.0, -2.0, -1.0, 0.0, 1.0, 2.0, 5.0, 10.0, 25.0]
SIGNED_NAMES = ["landward > 25 nm", "-25 to -10 nm", "-10 to -5 nm", "-5 to -2 nm", "-2 to -1 nm",
                "-1 to 0 nm", "0 to 1 nm", "1 to 2 nm", "2 to 5 nm", "5 to 10 nm", "10 to 25 nm",
                "seaward > 25 nm"]
COMPANION_SEPARATION_NM = 12.0

# Persistence
SITE_RADIUS_M = 300.0
SITE_MIN_DATES = 3
SITE_MIN_FRACTION = 0.5

# Calibration
DETECTABLE_LENGTH_M = 25.0
MAX_CHANCE_MATCH = 0.05
LENGTH_CURVE = [(15.0, "0-15 m"), (25.0, "15-25 m"), (50.0, "25-50 m"), (100.0, "50-100 m"),
                (None, ">100 m")]
MISS_BUCKETS = [(25.0, "<25 m"), (50.0, "25-50 m"), (100.0, "50-100 m"), (200.0, "100-200 m"),
                (None, ">200 m")]
SNR_GATES = [6, 7, 8, 9, 10, 12, 15, 20]
PIXEL_GATES = [2, 3, 4, 6]
SIZE_BIN_EDGES = [6, 8, 12, 20, 35, 70]
SIZE_GATES = [8, 10, 12, 15, 20, 25, 35]

# Vessel type bands: low code, high code, category
VESSEL_TYPES = [
    (20, 29, "highspeed"), (30, 30, "fishing"), (31, 32, "tug"), (33, 34, "service"),
    (35, 35, "government"), (36, 37, "pleasure"), (40, 49, "highspeed"), (50, 51, "service"),
    (52, 53, "tug"), (54, 54, "service"), (55, 55, "government"), (58, 59, "service"),
    (60, 69, "passenger"), (70, 79, "cargo"), (80, 89, "tanker"),
]

# Air study
AIR_CELL_DEG = 0.05
VEIL_NM = 30.0
SPLIT_FT = 10_000
CONTINUITY_GAP_S = 360.0
INDEPENDENT_TYPES = ["mlat", "mode_s"]
TISB_TYPES = ["tisb_icao", "tisb_trackfile", "tisb_other"]
COOPERATIVE_TYPES = ["adsb_icao", "adsb_other", "adsr_icao", "adsr_other"]

# Land study
ROAD_CELL_DEG = 0.00225
MIN_DT_S = 15
MAX_DT_S = 120
MAX_ROAD_MPS = 60.0
ROAD_BIN_MPS = 0.5
ROAD_BINS = 121
PARKED_M = 5.0
FLUSH_LAG_H = 14

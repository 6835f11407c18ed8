"""Fixed values of the market feeds.

Everything in this module is a fixed value that must equal the published
behaviour of the feeds (dates, column names, flag codes, defaults), stated
plainly in natural order.
"""

from __future__ import annotations

from datetime import date

# ---------------------------------------------------------------------------
# FIXED VALUES — data availability and naming eras
# ---------------------------------------------------------------------------
SCADA_START_DATE = date(2025, 2, 28)       # first 4-second SCADA day
DISPATCH_START_DATE = date(2025, 2, 11)    # first dispatch day with storage columns
SCADA_CURRENT_CUTOVER = date(2026, 1, 11)  # on/after: "current", before: "archive"
ERA2_START = date(2025, 4, 29)             # publication-date naming, first half only
ERA3_START = date(2025, 9, 11)             # publication-date naming, both halves
PARTIAL_DAY_FIRST = date(2025, 4, 29)      # partial-data warning range (inclusive)
PARTIAL_DAY_LAST = date(2025, 9, 10)
PARTIAL_DAY_WARNING = "Half a market day: from 16:00 on nothing was published (29 Apr 2025 to 10 Sep 2025)."

# Market day: 04:00 to 04:00, naive local time (UTC+10, no daylight saving).
DAY_START_HOUR = 4

# ---------------------------------------------------------------------------
# FIXED VALUES — feed layouts
# ---------------------------------------------------------------------------
SCADA_COLUMNS = [
    "INTERVAL_DATETIME",
    "MEASUREMENT_DATETIME",
    "MEASURED_MW",
    "MW_QUALITY_FLAG",
]
SCADA_UNIT_COLUMNS = ["FPP_UNITID", "DUID"]  # first present wins per segment

DISPATCH_TABLE = "UNIT_SOLUTION"
DISPATCH_COLUMNS = [
    "SETTLEMENTDATE",
    "INITIALMW",
    "INITIAL_ENERGY_STORAGE",
    "ENERGY_STORAGE",
]
DISPATCH_UNIT_COLUMN = "DUID"

FEED_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"   # feed text
OUTPUT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"  # CSV / JSON output
JSON_ROW_CAP = 25_000                       # display cap of SCADA JSON records

# ---------------------------------------------------------------------------
# FIXED VALUES — quality flags (code, label, description, colour, strip order)
# ---------------------------------------------------------------------------
QUALITY_FLAGS = [
    (0, "Good", "Good quality measurement", "#22c55e", 0),
    (1, "Suspect", "Suspect quality — possible communication issue or manual override", "#f97316", 1),
    (2, "Bad", "Bad quality — sustained communication failure or substituted value", "#ef4444", 2),
    (-1, "N/A", "Not applicable", "#94a3b8", 3),
    (3, "Manual override", "Manual override", "#94a3b8", 4),
]
UNKNOWN_FLAG_COLOR = "#94a3b8"

# ---------------------------------------------------------------------------
# FIXED VALUES — unit registry
# ---------------------------------------------------------------------------
REGION_TO_STATE = [
    ("QLD1", "QLD"),
    ("NSW1", "NSW"),
    ("VIC1", "VIC"),
    ("SA1", "SA"),
    ("TAS1", "TAS"),
]
BATTERY_TECH = "Battery Storage"
IN_SERVICE = "In Service"
REGISTRY_COLUMNS = {
    "duid": "DUID",
    "name": "Unit Name",
    "tech": "Technology Type",
    "status": "Commitment Status",
    "region": "Region",
    "capacity_mw": "Agg Nameplate Capacity (MW AC)",
    "capacity_mwh": "Agg Nameplate Storage Capacity (MWh)",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — request log and wait estimates
# ---------------------------------------------------------------------------
LOG_ACTIONS = [
    "view",
    "download_csv",
    "download_parquet",
    "download_energy_csv",
    "download_energy_parquet",
]
SOURCE_TYPES = ["current", "archive", "dispatch_current", "dispatch_archive"]
TIMING_DEFAULT_SEC = {
    "current": 120,
    "archive": 480,
    "dispatch_current": 60,
    "dispatch_archive": 300,
}
TIMING_MIN_SAMPLES = 5
TIMING_WINDOW = 100       # last N successful views per source
TIMING_QUANTILE = 0.75    # lower-nearest rank: int(q * (n - 1))
LOG_TOP_UNITS = 20
LOG_TOP_CLIENTS = 50
LOG_RECENT = 100

# Wait-time text buckets: (upper bound in seconds, text); the last has no bound.
ESTIMATE_BUCKETS = [
    (60, "less than a minute"),
    (100, "about 1 minute"),
    (160, "about 2 minutes"),
    (220, "about 3 minutes"),
    (310, "about 4–5 minutes"),
    (420, "about 6–7 minutes"),
    (570, "about 8–10 minutes"),
    (None, "10 minutes or more"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — archive catalog naming
# ---------------------------------------------------------------------------
SCADA_PRODUCT = "FPPMW"
DISPATCH_PRODUCT = "DISPATCH"
SCADA_BUNDLE_PATTERN = r"(?i)FPPMW.*_\d{8}\.zip$"
DISPATCH_BUNDLE_PATTERN = r"(?i)DISPATCH.*_\d{8}\.zip$"
SECOND_HALF_PATTERN = r"(?i)FPPMW_2_"
# date after "_": 8 digits, or the first 8 of a 14-digit stamp, then "_" "." or end
NAME_DATE_PATTERN = r"_(\d{8})(?:\d{6})?(?:[_.]|$)"
NEWEST_DATES_SHOWN, OLDEST_DATES_SHOWN = 5, 10  # dates named when a SCADA / dispatch archive has no entry
BUNDLE_CANDIDATES = 3     # best bundles tried per format
SOURCE_ORDER = ["current", "archive"]

# ---------------------------------------------------------------------------
# FIXED VALUES — display names of the energy series and of the summary cards
# (label, column, decimals; None: a count)
# ---------------------------------------------------------------------------
ENERGY_SERIES = [
    ("initial_energy_storage", "Initial Energy (MWh)"),
    ("energy_storage", "End Energy (MWh)"),
    ("initialmw", "Dispatch MW"),
]
SCADA_CARDS = [
    ("Total Readings", "total_rows", None),
    ("Min MW", "min_mw", 2),
    ("Max MW", "max_mw", 2),
    ("Mean MW", "mean_mw", 2),
    ("Std Dev", "std_mw", 2),
]
DISPATCH_CARDS = [
    ("Total Intervals", "total_rows", None),
    ("Min Dispatch MW", "min_mw", 1),
    ("Max Dispatch MW", "max_mw", 1),
    ("Min Energy (MWh)", "min_init_mwh", 1),
    ("Max Energy (MWh)", "max_init_mwh", 1),
    ("Mean Energy (MWh)", "mean_init_mwh", 1),
]

"""Values fixed by the data formats and by the definition of the measurements."""

# --- Fixed values: the grid -------------------------------------------------
RESOLUTION_MS = 60_000
GRID_SECONDS = 60
PROXY_BAND_BINS = 10
PROXY_METHOD = "rolling_rmssd_60s"

# --- Fixed values: modalities and sources, in reporting order ---------------
MODALITIES = ("heart_rate", "hrv_proxy", "hrv", "stress", "sleep_stage")
SOURCES = ("mobile", "browser", "desktop", "journal", "other")
TIER_LABELS = {
    "heart_rate": "observational",
    "hrv_proxy": "inferred",
    "hrv": "observational",
    "stress": "observational",
    "sleep_stage": "observational",
}

# --- Fixed values: rollups --------------------------------------------------
SPAN_SECONDS = {"5m": 300, "30m": 1800, "1h": 3600, "1d": 86400}
DEFAULT_SPANS = ("5m", "1h", "1d")
MIN_COVERAGE = 0.5
TIER_HIGH = 0.67
TIER_MEDIUM = 0.34

# --- Fixed values: the record envelope --------------------------------------
ENVELOPE_KEYS = (
    "artifactId",
    "source",
    "payload",
    "createdAtEpochMs",
    "schemaVersion",
    "deviceAlias",
    "provenanceMetadataJson",
    "ingestedAtEpochMs",
    "ingestStatus",
)
LEGACY_KEYS = {
    "artifactId": "artifact_id",
    "createdAtEpochMs": "created_at",
    "schemaVersion": "schema_version",
}

# --- Fixed values: export layout --------------------------------------------
HR_DIR = "com.samsung.shealth.tracker.heart_rate/"
HRV_DIR = "com.samsung.health.hrv/"
HR_ALIAS_DIR = "hr_bins/"
HR_CSV = "hr.csv"
STRESS_CSV = "stress.csv"
SLEEP_CSV = "sleep.csv"
SLEEP_STAGE_CSV = "sleep_stage.csv"
SLEEP_PREFIX = "com.samsung.health.sleep."

# --- Fixed values: journal strokes ------------------------------------------
STROKE_RANGE_MS = (1_700_000_000_000, 2_200_000_000_000)
NOTE_ID_PREFIX = "boox"

# --- Fixed values: embedding gate -------------------------------------------
LOSS_MAX = 2.0
DIVERSITY_MAX = 0.9995
MODEL_DIMS = (17, 12, 8, 12, 17)
LATENT_INDEX = 2
REPORT_TYPE = "derived.embedding_evaluation_report"
EMBEDDING_TYPE = "derived.behavioral_embedding"

# --- Fixed values: browser words, first match wins for the category ---------
BROWSER_WORDS = (
    "browser",
    "bromite",
    "chromium",
    "chrome",
    "firefox",
    "brave",
    "opera",
    "duckduckgo",
    "adblock",
)
BROWSER_CATEGORY = (
    ("adblock", "privacy"),
    ("bromite", "privacy"),
    ("chrome", "search"),
    ("firefox", "general"),
    ("brave", "privacy"),
    ("duckduckgo", "search"),
    ("opera", "general"),
)
BROWSER_NAMES = (
    ("adblock", "Adblock Browser"),
    ("bromite", "Bromite"),
    ("chromium", "Chromium"),
    ("chrome", "Chrome"),
    ("firefox", "Firefox"),
    ("brave", "Brave"),
    ("opera", "Opera"),
)

# --- Fixed values: texts in records ------------------------------------------
ACCESS_NOTE = "metadata-only local browser signal; no raw page content, URLs, searches, or form values are retained"

"""The registries, lookup tables, patterns and thresholds that results depend on."""

# The company universe, in registry order (ties in rankings follow this order).
UNIVERSE = ["FANG", "EOG", "DVN", "CTRA", "OXY", "MTDR", "PR", "OVV", "SM", "CRGY"]
BENCHMARK_SYMBOLS = ["XLE", "BIL"]

# Retired tickers and the current ticker that continues their history; dropped tickers.
LEGACY_TICKERS = {"COG": "CTRA", "CDEV": "PR", "ECA": "OVV"}
DROPPED_TICKERS = ["AMR"]
CONTAMINATED = {"ticker": "CTRA", "name_part": "CONTURA"}

# Accepted company-name prefixes per ticker (guard against ticker reuse).
NAME_PREFIXES = {
    "FANG": ["diamondback"],
    "EOG": ["eog resources"],
    "DVN": ["devon energy"],
    "CTRA": ["coterra energy"],
    "OXY": ["occidental"],
    "MTDR": ["matador resource"],
    "PR": ["permian resource"],
    "OVV": ["ovintiv"],
    "SM": ["sm energy"],
    "CRGY": ["crescent energy"],
}

# Operator-name fragments per ticker, in matching order.
OPERATOR_PATTERNS = {
    "FANG": ["DIAMONDBACK"],
    "EOG": ["EOG RESOURCES"],
    "DVN": ["DEVON ENERGY"],
    "CTRA": ["COTERRA", "CIMAREX", "CABOT OIL"],
    "OXY": ["OCCIDENTAL", "OXY USA"],
    "MTDR": ["MATADOR"],
    "PR": ["PERMIAN RESOURCES", "CENTENNIAL", "COLGATE"],
    "OVV": ["OVINTIV", "ENCANA"],
    "SM": ["SM ENERGY", "ST. MARY"],
    "CRGY": ["CRESCENT ENERGY", "INDEPENDENCE ENERGY"],
}

# News search phrase per ticker and the words that must accompany it.
NEWS_PHRASES = {
    "FANG": "Diamondback Energy",
    "EOG": "EOG Resources",
    "DVN": "Devon Energy",
    "CTRA": "Coterra Energy",
    "OXY": "Occidental Petroleum",
    "MTDR": "Matador Resources",
    "PR": "Permian Resources",
    "OVV": "Ovintiv",
    "SM": "SM Energy",
    "CRGY": "Crescent Energy",
}
NEWS_KEYWORDS = ["oil", "drilling"]
NEWS_FETCH_LIMIT = 75
NEWS_USE_LIMIT = 30

# Per-company forecast constants.
WELLS_PER_PAD = {"FANG": 6.0, "EOG": 5.5, "DVN": 5.0, "CTRA": 4.5, "OXY": 5.5, "MTDR": 4.5, "PR": 5.0, "OVV": 4.0, "SM": 3.5, "CRGY": 3.0}
PRICE_DIFFERENTIAL = {"FANG": 0.93, "EOG": 0.95, "DVN": 0.91, "CTRA": 0.78, "OXY": 0.94, "MTDR": 0.92, "PR": 0.93, "OVV": 0.90, "SM": 0.88, "CRGY": 0.87}
REVENUE_SHARE = {"FANG": 1.00, "EOG": 0.45, "DVN": 0.55, "CTRA": 0.40, "OXY": 0.30, "MTDR": 1.00, "PR": 1.00, "OVV": 0.50, "SM": 0.55, "CRGY": 0.20}
BASE_PRODUCTION = {"FANG": 470_000, "EOG": 1_000_000, "DVN": 660_000, "CTRA": 670_000, "OXY": 1_300_000, "MTDR": 160_000, "PR": 320_000, "OVV": 600_000, "SM": 160_000, "CRGY": 220_000}
BASE_PRODUCTION_DEFAULT = 200_000
SHARES_MILLIONS = {"FANG": 290, "EOG": 580, "DVN": 660, "CTRA": 740, "OXY": 940, "MTDR": 125, "PR": 800, "OVV": 270, "SM": 115, "CRGY": 220}
SHARES_MILLIONS_DEFAULT = 200
NEW_WELL_RATE = 800.0
QUARTERLY_DECLINE = 0.92
QUARTER_DAYS = 91
DEFAULT_OIL_PRICE = 70.0
DEFAULT_RIG_COUNT = 300.0
ALPHA = 0.10

# Share of output in the basin when no table is supplied (fiscal years 2020-2025).
PURE_PLAY = ["FANG", "MTDR", "PR"]
MULTI_BASIN_SHARE = 0.40
SHARE_YEARS = (2020, 2025)

# Fixed value: the sentence pattern that states a basin share.
SHARE_PATTERN = r"Permian[^.]{0,200}?(\d{1,3}(?:\.\d+)?)\s*%[^.]{0,80}?(?:production|output|barrels|boe)"

# What is noted beside a share, by the way it was found; {} is the calendar year of the filing.
SHARE_NOTES = {
    "pure_play_default": "Pure-play Permian operator; assumed 100% Permian.",
    "manual": "No 10-K filed in CY {}.",
    "regex_table": "Regex match on '<X>% ... production'.",
    "llm_narrative": "Regex did not match; pass excerpt to LLM with `llm_extract_permian_fraction_prompt`.",
}

# Conviction tiers.
TIER_SIZE = {"high": 0.15, "medium": 0.10, "low": 0.05, "none": 0.0}
TIER_BELOW = {"high": "medium", "medium": "low", "low": "none", "none": "none"}
TIER_RANK = {"high": 1, "medium": 2, "low": 3, "none": 4}
TIER_SYNONYMS = {
    "strong": "high", "high_confidence": "high",
    "moderate": "medium", "modest": "medium", "med": "medium",
    "weak": "low", "low_confidence": "low",
}

# Label-noise rates, by setting and true state; the order is newly, continuously, idle.
STATES = ["newly_active", "continuously_active", "idle"]
CONFUSION = {
    "optimistic": {"newly_active": [0.90, 0.07, 0.03], "continuously_active": [0.05, 0.90, 0.05], "idle": [0.02, 0.05, 0.93]},
    "target": {"newly_active": [0.78, 0.12, 0.10], "continuously_active": [0.08, 0.80, 0.12], "idle": [0.05, 0.10, 0.85]},
    "pessimistic": {"newly_active": [0.55, 0.20, 0.25], "continuously_active": [0.15, 0.65, 0.20], "idle": [0.10, 0.20, 0.70]},
}

# Radar change thresholds in dB, and validation targets.
RISE_NEW_DB = 1.5
RISE_SUSTAINED_DB = 0.5
DROP_NEW_DB = -2.5
DROP_SUSTAINED_DB = -1.0
MATCH_WINDOW_DAYS = 30
TARGET_PRECISION = 0.70
TARGET_RECALL = 0.60

# Strategy numbers and names.
STRATEGIES = {
    1: "composite_full", 2: "composite_no_news", 3: "revision", 4: "macro_momentum", 5: "window_change",
    6: "equal_weight", 7: "buy_hold", 8: "momentum_12_1", 9: "value", 10: "quality",
}

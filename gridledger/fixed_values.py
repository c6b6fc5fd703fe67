"""Fixed values.

Everything in this file must equal the published behaviour being matched for
results to be right: word lists, code tables, thresholds, heading patterns and
the fixed sentences of flags and narratives.
"""

# --- fixed values: market thresholds and severities -------------------------
CRITICAL_BELOW = -100.0
HIGH_BELOW = -30.0
MEDIUM_BELOW = 0.0
LOW_BAND_BELOW = 20.0
OVERSUPPLY_SHARE = 0.70
SHORT_WINDOW_ROWS = 24
LONG_WINDOW_ROWS = 168
VOLATILITY_Z = 2.0
SESSION_GAP_SECONDS = 3700
CONGESTION_HIGH_MW = 100.0
CONGESTION_MEDIUM_MW = 50.0
DAYS_PER_YEAR = 365
EXPOSURE_WINDOW_DAYS = 90
DEFAULT_CONTRACT_MW = 10.0
CURTAILED_HOURS_SHARE = 0.3
CURTAILED_PRICE_SHARE = 0.5
FLAG_SEVERITY_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}
UNKNOWN_SEVERITY_ORDER = 9
EUR_SEVERITY_LOW_BELOW = 50_000.0
EUR_SEVERITY_MEDIUM_UPTO = 500_000.0
EUR_SEVERITY_HIGH_UPTO = 5_000_000.0
CAPACITY_FACTOR = 0.35
HOURS_PER_YEAR = 8760
PHYSICAL_FLOOR = -20.0
FINANCIAL_FLOOR = 0.0
SELLER_REDISPATCH_SHARE = 0.6
CPI_SHARE = 0.70
INDEX_CAP = 0.03
INDEX_FLOOR = -0.01
INDEX_FROM_CONTRACT_YEAR = 3
IMBALANCE_RATIO = 2.0
IMBALANCE_PERIODS = 3
NEGATIVE_HOURS_ALERT = 4
SPIKE_ABOVE = 200.0
CAPTURE_ALERT_BELOW = 0.75

# --- fixed values: quality rules --------------------------------------------
PRICE_RULES = {
    "valid_price_range": "price_eur_mwh BETWEEN -500 AND 4000",
    "valid_hour": "hour BETWEEN 0 AND 23",
    "non_null_timestamp": "delivery_ts IS NOT NULL",
    "non_null_market": "market IS NOT NULL",
}
GENERATION_RULES = {
    "non_null_timestamp": "delivery_ts IS NOT NULL",
    "valid_total_mw": "total_mw >= 0",
    "valid_renewable_pct": "renewable_pct BETWEEN 0 AND 1",
}
CONGESTION_RULES = {
    "non_null_zone": "dso_zone IS NOT NULL",
    "valid_direction": "direction IN ('upward', 'downward')",
    "positive_mw": "mw_needed > 0",
    "valid_time_window": "end_time > start_time",
}
IMBALANCE_RULES = {
    "non_null_timestamp": "delivery_ts IS NOT NULL",
    "non_null_market": "market IS NOT NULL",
    "non_null_price": "imbalance_price IS NOT NULL",
}
CHUNK_RULES = {
    "non_null_chunk_text": "chunk_text IS NOT NULL",
    "non_null_contract_id": "contract_id IS NOT NULL",
}

# --- fixed values: fuel codes, zones, congestion column names ----------------
FUEL_CODES = {
    "B01": "biomass",
    "B09": "geothermal",
    "B10": "hydro_pump_storage",
    "B11": "hydro_run_of_river",
    "B12": "hydro_reservoir",
    "B16": "solar",
    "B17": "waste",
    "B18": "wind_offshore",
    "B19": "wind_onshore",
    "B20": "other_renewable",
    "B02": "lignite",
    "B03": "fossil_gas",
    "B04": "fossil_hard_coal",
    "B05": "fossil_oil",
    "B14": "nuclear",
    "B06": "other",
}
RENEWABLE_FUELS = ["solar", "wind_offshore", "wind_onshore", "biomass", "hydro_run_of_river"]
DSO_ZONES = [
    "Liander-Noord",
    "Liander-Midden",
    "Liander-Zuid",
    "Enexis-Noord",
    "Enexis-Oost",
    "Enexis-Zuid",
    "Stedin-Rotterdam",
    "Stedin-Utrecht",
    "Stedin-Zeeland",
    "Westland-Infra",
    "TenneT-380kV",
    "TenneT-220kV",
]
CONGESTION_TABLE_COLUMNS = {
    "Zone": "dso_zone",
    "Direction": "direction",
    "Start": "start_time",
    "End": "end_time",
    "MW": "mw_needed",
    "Price (€/MWh)": "price_eur_mwh",
    "Status": "status",
}

# --- fixed values: chunking --------------------------------------------------
WORDS_PER_CHUNK = 393
WORDS_OVERLAP = 49
CHARS_PER_WORD = 5
MIN_BLOCK_CHARS = 5
PREAMBLE_CLAUSE = "PREAMBLE"
PREAMBLE_TITLE = "Preamble"
TITLE_TRIM = " —-:"
# Heading patterns in the order they are tried.  WS stands for one whitespace
# character and is filled in by functions.text.
HEADING_PATTERNS = [
    r"(?iu)^(ARTICLE{WS}+\p{Nd}+)",
    r"^(\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)?){WS}+(?=[A-Z])",
    r"(?iu)^(SCHEDULE{WS}+\p{Nd}+)",
    r"(?iu)^(ANNEX{WS}+[A-Z\p{Nd}]+)",
    r"^\(([ivxlcdmIVXLCDM]+)\){WS}",
]

# --- fixed values: risk taxonomy (priority order) ----------------------------
RISK_TAXONOMY = {
    "curtailment_risk": {
        "primary": [
            "curtailment", "curtail", "grid curtailment", "dso instruction", "redispatch",
            "constrained off", "dispatch instruction",
        ],
        "secondary": [
            "grid operator", "system operator", "congestion", "balancing responsibility",
            "output reduction", "deemed output", "compensation for curtailment", "no compensation",
        ],
    },
    "price_risk": {
        "primary": [
            "negative price", "price floor", "price cap", "settlement price", "reference price",
            "market price", "day-ahead price", "balancing price",
        ],
        "secondary": [
            "eur/mwh", "strike price", "contract price", "indexed price", "fixed price",
            "floating price",
        ],
    },
    "volume_risk": {
        "primary": [
            "minimum volume", "guaranteed output", "take-or-pay", "annual quantity",
            "capacity obligation", "output guarantee",
        ],
        "secondary": [
            "mwh per year", "annual generation", "contracted volume", "forecast output",
            "production shortfall", "p50", "p90",
        ],
    },
    "basis_risk": {
        "primary": [
            "delivery point", "location marginal price", "lmp", "basis differential",
            "interconnection point", "grid connection point",
        ],
        "secondary": [
            "transmission constraint", "grid losses", "settlement location", "delivery node",
            "hub price", "zonal price",
        ],
    },
    "counterparty_risk": {
        "primary": [
            "credit support", "collateral", "letter of credit", "parent guarantee",
            "termination event", "event of default", "insolvency",
        ],
        "secondary": [
            "credit rating", "performance bond", "security deposit", "credit threshold",
            "material adverse change", "early termination", "close-out",
        ],
    },
    "legal_regulatory": {
        "primary": [
            "change in law", "force majeure", "permitting", "regulatory change",
            "government authority", "legislative change",
        ],
        "secondary": [
            "applicable law", "environmental permit", "grid code", "subsidy",
            "renewable obligation", "ets", "emissions trading", "planning permission",
        ],
    },
}
SECONDARY_HITS_NEEDED = 2

# --- fixed values: phrases ---------------------------------------------------
FLOOR_PHRASES = [
    "floor shall apply", "floor applies", "not fall below zero", "deemed to be zero",
    "minimum price", "price floor of", "floor price of",
]
FLOOR_NEGATIONS = [
    "no price floor", "no floor", "floor shall not", "floor does not", "without a price floor",
    "no minimum price",
]
NO_COMPENSATION_PHRASES = [
    "no compensation", "without compensation", "no deemed output", "shall not be payable",
    "accepts full curtailment risk",
]
FLOOR_WORDS = ["floor", "collar", "minimum price", "floor price", "floor protection"]
STOPWORDS = [
    "the", "a", "an", "of", "in", "to", "and", "or", "is", "are", "be", "shall", "by", "at",
    "for", "on", "not", "any", "as", "with", "where", "than", "upon", "per", "that", "this",
    "from", "which", "all", "each", "no", "may", "up", "more", "such", "within", "either", "both",
]
KEYWORD_MIN_CHARS = 4

# --- fixed values: retrieval and evaluation ----------------------------------
SEARCH_TOP_K = 10
RETRIEVE_TOP_K = 15
RERANK_TOP_N = 6
IDENTITY_SCORE_STEP = 0.01
CONTEXT_CHARS = 400
PROMPT_CONTEXT_CHARS = 2000
EMPTY_CONTEXT_SCORE = 0.5
EVAL_THRESHOLDS = {"faithfulness": 0.85, "answer_relevancy": 0.85, "context_precision": 0.80}

# --- fixed values: flag sentences (%s takes already formatted numbers) --------
PRICE_HIGH = (
    "No negative price floor in contract. Market had %s negative price hours "
    "(avg %s EUR/MWh) in last 90 days."
)
PRICE_LOW = (
    "Contract has a price floor. Market had %s negative hours but exposure is mitigated."
)
PRICE_MEDIUM = (
    "No price floor detected. Current market is stable but negative price periods make this "
    "a latent risk."
)
PRICE_INFO = "Price floor present, market stable."
CURTAILMENT_HIGH = (
    "No curtailment compensation in contract. GOPACS grid congestion events detected."
)
CURTAILMENT_MEDIUM = (
    "No curtailment compensation clause. Grid congestion risk latent but no active GOPACS events."
)
CURTAILMENT_LOW = "Curtailment compensation provisions present."
VOLUME_MEDIUM = (
    "Volume/output guarantee clause identified. Review minimum quantity obligations against "
    "P90 forecasts."
)
COUNTERPARTY_MEDIUM = (
    "Credit support / collateral clause detected. Verify current credit thresholds and "
    "counterparty rating."
)
REVIEW_LOW = "%s clause identified for review."
OTHER_INFO = "No significant risk identified."

# --- fixed values: narrative and empty-state sentences -----------------------
NO_CLAUSES = "No relevant contract clauses found."
NO_FLAGS = "No significant risk flags identified."
NARRATIVE_EMPTY = (
    "Analysis complete. No material risk flags were identified in the reviewed contract clauses "
    "given current market conditions. Standard monitoring is recommended."
)
NARRATIVE_HIGH = (
    "The analysis identified %s HIGH severity risk flag(s) across %s contract(s)%s. %s"
)
NARRATIVE_EXPOSURE = " with estimated annual exposure of EUR %s"
NARRATIVE_CLAUSE = "In %s, %s was flagged: %s"
NARRATIVE_MEDIUM = (
    "Additionally, %s MEDIUM severity flag(s) were noted requiring attention during the next "
    "contract review cycle."
)
NARRATIVE_ACTION = (
    "Recommended action: review flagged clauses with legal counsel and consider hedging negative "
    "price exposure via financial PPA overlay or price floor amendment."
)
CONTEXT_HEADING = "## Retrieved Contract Clauses\n"
MARKET_HEADING = "## Market Context (last 90 days — %s day-ahead)"
MARKET_FOOTER = (
    "*Negative price exposure is concentrated 10:00–15:00 CET on high-wind, high-solar days.*"
)
SEVERITY_COLOURS = {"HIGH": "#c0392b", "MEDIUM": "#e67e22", "LOW": "#27ae60"}
OTHER_COLOUR = "#555"

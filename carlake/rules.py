"""Plain data: name variants, keyword lists, bands and limits used by the operators."""

# ---------------------------------------------------------------------------
# Fixed values. They decide results, so they are spelled out in natural order.
# ---------------------------------------------------------------------------

# maker name -> upper-case spellings that stand for it
MAKER_VARIANTS = {
    "Tesla": ["TESLA", "TESLA MOTORS", "TESLA, INC.", "TESLA INC."],
    "Ford": ["FORD", "FORD MOTOR COMPANY", "FORD MOTOR CO."],
    "Toyota": ["TOYOTA", "TOYOTA MOTOR CORPORATION", "TOYOTA MOTOR CORP", "TOYOTA MOTOR CORP."],
    "GMC": ["GMC", "GENERAL MOTORS", "GM", "GENERAL MOTORS LLC", "GENERAL MOTORS, LLC"],
    "Honda": ["HONDA", "HONDA MOTOR CO.", "HONDA (AMERICAN HONDA MOTOR CO.)", "AMERICAN HONDA MOTOR CO."],
    "Chevrolet": ["CHEVROLET", "CHEVY"],
    "Nissan": ["NISSAN", "NISSAN NORTH AMERICA, INC.", "NISSAN MOTOR COMPANY"],
    "BMW": ["BMW", "BMW OF NORTH AMERICA", "BAYERISCHE MOTOREN WERKE"],
    "Mercedes-Benz": ["MERCEDES-BENZ", "MERCEDES BENZ", "MERCEDES-BENZ USA, LLC", "DAIMLER", "DAIMLER AG"],
    "Volkswagen": ["VOLKSWAGEN", "VW"],
    "Hyundai": ["HYUNDAI", "HYUNDAI MOTOR AMERICA"],
    "Kia": ["KIA", "KIA AMERICA, INC.", "KIA MOTORS AMERICA"],
    "Subaru": ["SUBARU", "SUBARU OF AMERICA"],
    "Mazda": ["MAZDA"],
    "Jeep": ["JEEP", "FCA US LLC", "FCA US, LLC", "CHRYSLER (FCA US, LLC)", "STELLANTIS"],
}

MAKERS = [
    "Tesla", "Ford", "Toyota", "GMC", "Honda", "Chevrolet", "Nissan", "BMW", "Mercedes-Benz",
    "Volkswagen", "Hyundai", "Kia", "Subaru", "Mazda", "Jeep",
]

# extra spellings accepted when raw files are filtered
INGEST_VARIANTS = {
    "GENERAL MOTORS": ["GMC", "GM", "GENERAL MOTORS CORPORATION"],
    "MERCEDES-BENZ": ["MERCEDES BENZ", "DAIMLER", "DAIMLER AG"],
    "VOLKSWAGEN": ["VW", "VOLKSWAGEN GROUP"],
}
MAKE_COLUMNS = ["MAKETXT", "MAKE", "MFR_NAME", "MANUFACTURER"]
YEAR_COLUMNS = ["YEARTXT", "YEAR", "MODEL_YR", "MODELYEAR", "MODEL YEAR"]

# component words, first hit wins
COMPONENT_RULES = [
    ("BRAKE", "BRAKING_SYSTEM"),
    ("ENGINE", "ENGINE_SYSTEM"),
    ("POWERTRAIN", "ENGINE_SYSTEM"),
    ("FUEL", "ENGINE_SYSTEM"),
    ("AIRBAG", "RESTRAINT_SYSTEM"),
    ("AIR BAG", "RESTRAINT_SYSTEM"),
    ("SEAT BELT", "RESTRAINT_SYSTEM"),
    ("SRS", "RESTRAINT_SYSTEM"),
    ("ELECTRICAL", "ELECTRICAL_SYSTEM"),
    ("WIRING", "ELECTRICAL_SYSTEM"),
    ("BATTERY", "ELECTRICAL_SYSTEM"),
    ("STEERING", "STEERING_SYSTEM"),
    ("SUSPENSION", "STEERING_SYSTEM"),
    ("TIRE", "TIRE_SYSTEM"),
    ("WHEEL", "TIRE_SYSTEM"),
    ("FORWARD COLLISION", "ADAS_SYSTEM"),
    ("LANE DEPARTURE", "ADAS_SYSTEM"),
    ("ADAS", "ADAS_SYSTEM"),
    ("AUTOPILOT", "ADAS_SYSTEM"),
]
COMPONENT_OTHER = "OTHER"

# text that was decoded with the wrong charset, and what it stood for
MOJIBAKE = [("Ã¯Â¬", "fi"), ('â€"', "-"), ("â€™", "'")]

DATE_SENTINELS = ["99999999", "00000000", "", " "]
STAR_SENTINELS = ["NOT RATED", "N/A", "NA", "", "-"]
FEATURE_WORDS = ["STANDARD", "OPTIONAL", "YES"]

# (lowest value of the band, label), highest first
SAFETY_TIERS = [(4.5, "EXCELLENT"), (4.0, "GOOD"), (3.0, "ACCEPTABLE"), (2.0, "MARGINAL")]
SAFETY_TIER_REST = "POOR"
SAFETY_TIER_NULL = "NOT_RATED"
SENTIMENT_BANDS = [(0.5, "VERY_POSITIVE"), (0.2, "POSITIVE"), (-0.2, "NEUTRAL"), (-0.5, "NEGATIVE")]
SENTIMENT_BAND_REST = "VERY_NEGATIVE"

SERIES_NAMES = {
    "TOTALSA": "Total Vehicle Sales",
    "ALTSALES": "Light Truck Sales",
    "DAUTOSAAR": "Domestic Auto Sales",
}
SERIES_COLUMNS = {
    "TOTALSA": "total_vehicle_sales",
    "ALTSALES": "light_truck_sales",
    "DAUTOSAAR": "domestic_auto_sales",
}

# --- news ---
NEWS_CATEGORIES = [
    ("recalls", ["recall", "nhtsa", "safety defect", "investigation into"]),
    ("executive", ["ceo", "chief executive", "appoints", "hires", "leadership change", "steps down"]),
    ("financial", ["earnings", "quarterly results", "profit", "revenue", "stock", "shares", "investor"]),
    ("ev", ["electric vehicle", " ev ", "battery", "charging", "hybrid", "electrification", "zero emission"]),
    ("sales", ["sales", "deliveries", "sold", "market share", "inventory", "units sold"]),
    ("manufacturing", ["plant", "factory", "production", "assembly", "supplier", "manufacturing"]),
    ("technology", ["software", "autonomous", "self-driving", "artificial intelligence", " ai ", "connected"]),
]
POSITIVE_WORDS = [
    (3, ["record high", "breakthrough", "surge", "soar", "boom", "best ever"]),
    (2, ["growth", "success", "award", "expansion", "partnership", "profit", "gain", "increase"]),
    (1, ["new", "launch", "innovative", "improved", "positive"]),
]
NEGATIVE_WORDS = [
    (3, ["recall", "death", "fatal", "crash", "fire", "lawsuit", "bankruptcy", "fraud"]),
    (2, ["decline", "drop", "fall", "loss", "layoff", "cut", "slump", "crisis", "warning"]),
    (1, ["issue", "problem", "concern", "delay", "struggle"]),
]
WEIGHTY_CATEGORIES = ["recalls", "executive", "financial"]
URGENT_WORDS = ["breaking", "urgent", "major", "critical", "exclusive"]
IMPACT_WORDS = ["bankruptcy", "merger", "acquisition", "death", "injury"]
BREAKING_WORDS = ["breaking", "just in", "developing"]
SAFETY_CRITICAL_WORDS = ["death", "injury", "fire", "crash"]

MAKER_STOP_WORDS = [
    "The", "This", "That", "These", "They", "What", "When", "Where", "How", "Why", "Who", "Which",
    "Many", "Some", "Most", "New", "First", "Last", "Next", "Other", "Each", "Every", "Both",
    "Reuters", "Bloomberg", "Source", "Report", "Study", "Data",
]
ACRONYM_STOP_WORDS = ["CEO", "CFO", "COO", "USA", "THE", "AND", "FOR"]
MAKER_COMPANY = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:Motors?|Automotive|Auto(?:\s+Group)?)\b"
MAKER_VERB = r"\b([A-Z][A-Za-z]+)\s+(?:announced|said|reported|unveiled|recalled|launched|revealed|plans|will|is|has)\b"
MAKER_TITLE = r"(?:CEO|chief|president|chairman|head)\s+(?:of\s+)?([A-Z][A-Za-z]+)"
MAKER_PLACE = r"(?:at|from|by)\s+([A-Z][A-Za-z]+)(?:\s+(?:dealership|plant|factory|headquarters))?"
MAKER_OWNER = r"\b([A-Z][A-Za-z]+)'s\s+(?:new|latest|upcoming|CEO|chief|vehicle|car|truck|SUV|EV)"
MAKER_ACRONYM = r"\b([A-Z]{2,3})\b"
VEHICLE_CONTEXT = r"\b(?:vehicle|car|truck|SUV|EV|electric|sales|recall|plant|dealer)"
MODEL_PATTERNS = [
    r"\b([A-Z]{1,3}[-.]?\d{1,4}[A-Za-z]*)\b",
    r"\b(Model\s+[A-Z0-9])\b",
    r"\b([A-Z][a-z]+\s+\d+[A-Za-z]*)\b",
]
MODEL_HYPHEN = r"\b([A-Za-z]+-[A-Za-z0-9]+)\b"
MODEL_NOT_PREFIXES = ["self-", "all-", "full-", "high-", "low-", "non-", "pre-", "co-"]
PERSON_TITLED = r"(?:CEO|Chief\s+\w+\s+Officer|President|Chairman)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"
PERSON_APPOSITION = r"([A-Z][a-z]+\s+[A-Z][a-z]+),?\s+(?:the\s+)?(?:CEO|chief|president|chairman)"
PERSON_TITLE_WORD = r"CEO|chief|president|chairman"
PERSON_SPEAKS = r"([A-Z][a-z]+\s+[A-Z][a-z]+)\s+(?:said|announced|told|added|noted)"
PERSON_NOT_FIRST = ["The", "This", "That", "They"]
PLACE_PATTERNS = [
    r"in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?:,\s+[A-Z]{2,})?)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)-based",
    r"(?:at|from)\s+([A-Z][a-z]+(?:,\s+[A-Z]{2})?)",
]

# --- trade events ---
EVENT_PLACE_PATTERNS = [
    r"in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?:,\s*[A-Z]{2})?)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:Convention Center|Expo|Center)",
    r"held\s+(?:in|at)\s+([A-Z][a-z]+(?:,\s*[A-Z]{2})?)",
]
EVENT_TYPES = [
    ("auto_show", ["auto show", "motor show", "car show"]),
    ("conference", ["conference", "congress", "summit"]),
    ("webinar", ["webinar", "virtual", "online"]),
    ("trade_show", ["expo", "exhibition", "trade show"]),
    ("forum", ["forum", "roundtable", "workshop"]),
]
EVENT_TOPICS = [
    ("ev", ["electric", " ev ", "battery", "charging"]),
    ("autonomous", ["autonomous", "self-driving", "adas"]),
    ("technology", ["technology", "software", "digital", "ai "]),
    ("dealership", ["dealer", "retail"]),
    ("manufacturing", ["manufacturing", "production", "supply chain"]),
    ("executive", ["leadership", "women", "executive"]),
]
VIRTUAL_WORDS = ["virtual", "webinar", "online"]
DATE_PREFIX = r"^(?:Media days?|Press days?)\s*"
DATE_RANGE = r"(\w+)\.?\s+(\d{1,2})\s*[-–]\s*(\d{1,2}),?\s*(\d{4})"
DATE_SINGLE = r"(\w+)\.?\s+(\d{1,2}),?\s*(\d{4})"
DATE_YEAR = r"\b(20\d{2})\b"
# full month names and their first three letters count, in exactly this spelling
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]

# --- question and answer text ---
SCOPE_WORDS = [
    "car", "cars", "vehicle", "vehicles", "auto", "automotive", "automobile", "manufacturer", "make", "model",
    "brand", "recall", "recalls", "complaint", "complaints", "defect", "defects", "safety", "crash", "accident",
    "injury", "death", "fatality", "investigation", "nhtsa", "rating", "ratings", "stars", "airbag", "seatbelt",
    "brake", "brakes", "steering", "tire", "tires", "sentiment", "negative", "positive", "customer", "reputation",
    "fuel", "mpg", "economy", "efficiency", "emission", "emissions", "epa", "gas", "gasoline", "diesel", "electric",
    "ev", "hybrid", "mileage", "range", "battery", "charging", "sales", "sold", "market", "fred", "economic",
    "trend", "trends", "tesla", "ford", "toyota", "honda", "gm", "general motors", "chevrolet", "chevy", "bmw",
    "mercedes", "audi", "volkswagen", "vw", "hyundai", "kia", "nissan", "subaru", "mazda", "lexus", "acura",
    "infiniti", "chrysler", "dodge", "jeep", "ram", "buick", "cadillac", "lincoln", "volvo", "porsche", "jaguar",
    "land rover", "mini", "mitsubishi", "suzuki", "fiat", "alfa romeo", "genesis", "rivian", "lucid", "polestar",
    "ferrari", "lamborghini", "maserati", "engine", "transmission", "drivetrain", "suspension", "exhaust",
    "accelerator", "pedal", "wheel", "door", "window", "mirror", "headlight", "taillight", "wiper", "infotainment",
]
OUTSIDE_KNOWLEDGE = [
    r"typically (?:costs?|requires?)",
    r"industry (?:average|standard|benchmark)",
    r"according to (?:industry|research|studies|experts)",
    r"historical(?:ly)? (?:data shows|evidence)",
    r"experts? (?:say|believe|suggest|indicate)",
    r"studies? (?:show|indicate|suggest|reveal)",
    r"(?:it is|this is) (?:known|established|common)",
    r"in general(?:ly)?",
    r"usually|commonly|normally|traditionally",
    r"estimated? (?:cost|value|price) of \$\d+",
    r"likely|probably|possibly|potentially",
    r"suggests?|indicates?|implies?",
]
VIN_WORDS = ["vin", "vehicle identification"]
DETAIL_WORDS = ["complaint description", "complaint text", "component description", "recall summary"]

# --- access ---
ALL = "*"
ANALYST_COLUMNS = {
    "FACT_COMPLAINTS": [
        "complaint_id", "make", "model", "year", "sentiment_score", "sentiment_category", "sentiment_confidence",
        "crash_flag", "fire_flag", "injured", "deaths", "severity_level", "has_incident", "safety_keyword_count",
        "negation_count",
    ],
    "FACT_RECALLS": ["recall_id", "make", "model", "year", "document_type", "has_year_data"],
    "FACT_RATINGS": ALL,
    "FACT_FUEL_ECONOMY": ALL,
    "FACT_ECONOMIC_INDICATORS": ALL,
    "FACT_INVESTIGATIONS": [
        "investigation_id", "make", "model", "year", "component_name", "component_category",
        "investigation_status", "has_recall",
    ],
}
MANAGER_COLUMNS = {
    "FACT_COMPLAINTS": [
        "component_description", "fail_date", "date_added", "mileage", "fuel_type", "drive_train",
        "complaint_description", "vehicle_speed",
    ],
    "FACT_RECALLS": ["recall_summary", "primary_document"],
    "FACT_RATINGS": ALL,
    "FACT_FUEL_ECONOMY": ALL,
    "FACT_ECONOMIC_INDICATORS": ALL,
    "FACT_INVESTIGATIONS": ALL,
}
ANALYST_BLOCKED = {
    "FACT_COMPLAINTS": ["vin", "complaint_description", "component_description", "mileage", "vehicle_speed"],
    "FACT_RECALLS": ["recall_summary"],
}
MANAGER_BLOCKED = {"FACT_COMPLAINTS": ["vin"]}

# tier -> (highest cost, highest row estimate, highest table count)
APPROVAL_LIMITS = {"analyst": (5.0, 500000, 3), "manager": (20.0, 1000000, 5)}
SEVERE_WORDS = ["DROP", "DELETE", "TRUNCATE"]
ROLE_PHRASES = {
    "executive": ("strategic_updates", "merger acquisition partnership"),
    "analyst": ("market_analysis", "sales market share revenue"),
    "product_manager": ("product_news", "launch release technology innovation"),
}

# vehicle XML tag -> (column, default when the tag is missing or empty)
VEHICLE_TAGS = {
    "id": ("epa_id", None),
    "year": ("year", None),
    "make": ("make", None),
    "model": ("model", None),
    "VClass": ("vehicle_class", "Unknown"),
    "fuelType": ("fuel_type", "Unknown"),
    "fuelType1": ("fuel_type1", None),
    "fuelType2": ("fuel_type2", None),
    "range": ("electric_range", "0"),
    "city08U": ("mpge_city", "0"),
    "highway08U": ("mpge_highway", "0"),
    "comb08U": ("mpge_combined", "0"),
    "charge240": ("charge_time_240v_hours", None),
    "city08": ("mpg_city", "0"),
    "highway08": ("mpg_highway", "0"),
    "comb08": ("mpg_combined", "0"),
    "cityA08": ("mpg_city_a", "0"),
    "highwayA08": ("mpg_highway_a", "0"),
    "combA08": ("mpg_combined_a", "0"),
    "fuelCost08": ("annual_fuel_cost", "0"),
    "fuelCostA08": ("annual_fuel_cost_a", "0"),
    "youSaveSpend": ("five_year_savings", "0"),
    "co2": ("co2_emissions_gpm", "0"),
    "co2TailpipeGpm": ("co2_tailpipe_gpm", "0"),
    "ghgScore": ("greenhouse_gas_score", "0"),
    "cylinders": ("cylinders", "0"),
    "displ": ("displacement_liters", "0"),
    "engId": ("engine_descriptor", ""),
    "trany": ("transmission", "Unknown"),
    "drive": ("drive_type", "Unknown"),
    "feScore": ("epa_fuel_economy_score", "0"),
}

COMPLAINT_FIELDS = [
    "CMPLID", "ODINO", "MFR_NAME", "MAKETXT", "MODELTXT", "YEARTXT", "CRASH", "FAILDATE", "FIRE", "INJURED",
    "DEATHS", "COMPDESC", "CITY", "STATE", "VIN", "DATEA", "LDATE", "MILES", "OCCURENCES", "CDESCR", "CMPL_TYPE",
    "POLICE_RPT_YN", "PURCH_DT", "ORIG_OWNER_YN", "ANTI_BRAKES_YN", "CRUISE_CONT_YN", "NUM_CYLS", "DRIVE_TRAIN",
    "FUEL_SYS", "FUEL_TYPE", "TRANS_TYPE", "VEH_SPEED", "DOT", "TIRE_SIZE", "LOC_OF_TIRE", "TIRE_FAIL_TYPE",
    "ORIG_EQUIP_YN", "MANUF_DT", "SEAT_TYPE", "RESTRAINT_TYPE", "DEALER_NAME", "DEALER_TEL", "DEALER_CITY",
    "DEALER_STATE", "DEALER_ZIP", "PROD_TYPE", "REPAIRED_YN", "MEDICAL_ATTN", "VEHICLES_TOWED_YN",
]
INVESTIGATION_FIELDS = [
    "NHTSA_ACTION_NUMBER", "MAKE", "MODEL", "YEAR", "COMPNAME", "MFR_NAME", "ODATE", "CDATE", "CAMPNO", "SUBJECT",
    "SUMMARY",
]
RATING_FIELDS = [
    "MAKE", "MODEL", "MODEL_YR", "BODY_STYLE", "VEHICLE_TYPE", "VEHICLE_CLASS", "DRIVE_TRAIN", "NUM_OF_SEATING",
    "CURB_WEIGHT", "MIN_GROSS_WEIGHT", "MAX_GROSS_WEIGHT", "OVERALL_STARS", "OVERALL_FRNT_STARS",
    "OVERALL_SIDE_STARS", "ROLLOVER_STARS", "FRNT_DRIV_STARS", "FRNT_PASS_STARS", "SIDE_DRIV_STARS",
    "SIDE_PASS_STARS", "SIDE_BARRIER_STAR", "SIDE_POLE_STARS", "ABS", "NHTSA_ESC", "BLIND_SPOT_DETECTION",
    "NHTSA_BACKUP_CAMERA", "FRNT_COLLISION_WARNING", "LANE_DEPARTURE_WARNING", "CRASH_IMMINENT_BRAKE",
    "DYNAMIC_BRAKE_SUPPORT", "ADAPTIVE_CRUISE_CONTROL", "DAY_RUN_LIGHTS", "HEAD_SAB", "TORSO_SAB", "PELVIS_SAB",
    "FRNT_TEST_NO", "SIDE_TEST_NO", "POLE_TEST_NO", "PRODUCTION_RELEASE",
]
ADVANCED_FEATURES = [
    "FRNT_COLLISION_WARNING", "LANE_DEPARTURE_WARNING", "CRASH_IMMINENT_BRAKE", "BLIND_SPOT_DETECTION",
]

# ---------------------------------------------------------------------------
# Values of our own: the complaint sentiment lexicon.
# ---------------------------------------------------------------------------

NEGATORS = ["not", "no", "never", "didn't", "doesn't", "won't", "can't", "without"]
SAFETY_WORDS = [
    "brake", "brakes", "airbag", "airbags", "crash", "crashed", "collision", "accident", "fire", "smoke", "burning",
    "injury", "injured", "death", "fatal", "steering", "stall", "stalled", "failure", "failed", "fail", "defect",
    "dangerous", "unsafe", "hazard", "seatbelt", "rollover", "explode", "exploded", "leak", "leaked", "locked",
    "tire", "blowout",
]


def lexicon() -> dict[str, int]:
    """Word -> signed weight: the single news words keep their weight, other safety words count -1."""
    words: dict[str, int] = {}
    for weight, terms in POSITIVE_WORDS:
        words.update({t: weight for t in terms if " " not in t})
    for weight, terms in NEGATIVE_WORDS:
        words.update({t: -weight for t in terms if " " not in t})
    for term in SAFETY_WORDS:
        words.setdefault(term, -1)
    return words


# fixed values: statements with one of these get no limit of their own
UNLIMITED_SQL = ["LIMIT", "COUNT(", "SUM(", "AVG(", "MAX(", "MIN(", "GROUP BY"]

# fixed values: what the screen of statements finds, as (pattern over upper-cased text, name)
DANGEROUS_SQL = [
    (r"\bDROP\s+TABLE\b", "DROP TABLE"),
    (r"\bTRUNCATE\b", "TRUNCATE"),
    (r"\b(ALTER|CREATE)\s+(TABLE|DATABASE|SCHEMA)\b", "SCHEMA CHANGE"),
]
# fixed values: the same, where the statement has no WHERE
DANGEROUS_WITHOUT_WHERE = [
    (r"\bDELETE\s+FROM\b", "DELETE WITHOUT WHERE"),
    (r"\bUPDATE\b", "UPDATE WITHOUT WHERE"),
]
# fixed values: patterns of star columns, of a wildcard that leads, and of a table after FROM or JOIN
STAR_SQL = r"\bSELECT\s+\*"
LEADING_WILDCARD = r"LIKE\s+'%"
TABLE_REFERENCE = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){0,2})"

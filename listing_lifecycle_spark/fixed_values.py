"""Labels, limits and patterns that results depend on.

Everything here is data.  Change a value and results change; no logic lives here.
"""

# The ten per-animal counters of a listing, in report order.
PET_COUNT_COLUMNS = [
    "dogs_count",
    "cats_count",
    "fish_count",
    "birds_count",
    "rabbits_guinea_pigs_count",
    "chickens_ducks_geese_count",
    "farm_animals_count",
    "horses_count",
    "reptiles_count",
    "other_pets_count",
]

# Singular and plural names used in alert texts.
PET_NAMES = {
    "dogs_count": ("dog", "dogs"),
    "cats_count": ("cat", "cats"),
    "fish_count": ("fish", "fish"),
    "birds_count": ("bird", "birds"),
    "rabbits_guinea_pigs_count": ("rabbit/guinea pig", "rabbits/guinea pigs"),
    "chickens_ducks_geese_count": ("chicken/duck/goose", "chickens/ducks/geese"),
    "farm_animals_count": ("farm animal", "farm animals"),
    "horses_count": ("horse", "horses"),
    "reptiles_count": ("reptile", "reptiles"),
    "other_pets_count": ("other pet", "other pets"),
}

# Image alternative text on a listing card -> counter.
PET_ALT_TEXT = {
    "Dogs": "dogs_count",
    "Cats": "cats_count",
    "Fish": "fish_count",
    "Birds": "birds_count",
    "Rabbits/Guinea Pigs": "rabbits_guinea_pigs_count",
    "Chickens/Ducks/Geese": "chickens_ducks_geese_count",
    "Farm Animals": "farm_animals_count",
    "Horses": "horses_count",
    "Reptiles": "reptiles_count",
}

# Upper bound (inclusive) and label of each sit-length bucket.
DURATION_BUCKETS = [
    (7, "0-7 days"),
    (14, "8-14 days"),
    (30, "15-30 days"),
    (60, "31-60 days"),
    (None, "61+ days"),
]
LONG_SIT_DAYS = 31

# Search code -> inclusive day range (other cuts than the buckets above).
SIT_LENGTH_CODES = {
    "60": (0, 7),
    "61": (8, 14),
    "62": (15, 28),
    "63": (29, 60),
    "64": (61, None),
}

# Lifecycle vocabularies.
LISTING_STATUSES = ["active", "missing_once", "missing_confirmed", "expired_by_date"]
RUN_STATUSES = ["running", "success", "partial_failure", "failed", "suspicious"]
UNSUCCESSFUL_RUN_STATUSES = ["failed", "partial_failure", "suspicious"]
FIRST_SEEN_CONTEXTS = ["baseline", "observed"]
EVENT_TYPES = ["first_match", "became_match", "material_change", "confirmed_reappearance"]
ATTEMPT_STATUSES = ["sent", "failed"]
LEAF_STATUSES = ["pending", "success", "split"]
CAMPAIGN_STATUSES = ["running", "paused", "completed", "abandoned"]
ISLANDS = ["North Island", "South Island"]

# Operating limits.
DUE_GRACE_SECONDS = 60
SEARCH_RESULT_CAP = 200
HEALTH_WINDOW_HOURS = 24
HEALTH_OK_MAX_FAILURES = 4
HEALTH_WARN_MAX_FAILURES = 19
HEALTH_STALE_INTERVALS = 2
LOCAL_TIME_ZONE = "Pacific/Auckland"
QUIET_HOURS = ("00:00", "06:00")
ERROR_SNIPPET_LENGTH = 300

# Texts that identify a blocked (challenged) page fetch.
CHALLENGE_MARKER = "access_challenge"
LEGACY_CHALLENGE_FRAGMENTS = ["Unexpected status code: 202;", "awsWafCookieDomainList"]
CHALLENGE_BODY_MARKERS = ["awswafcookiedomainlist", "window.gokuprops"]

# Patterns and markers of the listing card markup.
EXTERNAL_ID_PATTERN = r"/house-sitting-pet-sitting-job/(\d+)/"
REPLY_RATING_PATTERN = r"Reply Rating\s+(\d+)"
DURATION_PATTERN = r"^(?:(\d+)\s+week[s]?)?\s*(?:(\d+)\s+night[s]?)?$"
RANGE_SEPARATOR = " - "
APPROXIMATE_SUFFIX = " (approx)"
CAP_NOTICE = "AND THERE'S MORE"
ICON_DATES = "date_range"
ICON_DURATION = "schedule"
ICON_HOUSE_TYPE = "cottage"
OPTION_COUNT_PATTERN = r"(?U)^(.+?)\s*\(([\d,]+)\)\s*$"
OPTION_COUNT_FIELDS = ["sitlengths", "housetype", "subregion", "region", "state"]
OPTION_TOTAL_FIELD = "housetype"
REFINE_ACTION_PATTERN = r"refineSearchAction\(this,'([^']+)','([^']+)'"

# Short subregion names that the site uses for one region.
SUBREGION_ALIASES = {
    "Auckland": {
        "Central": "Auckland - Central",
        "North": "Auckland - North",
        "South": "Auckland - South",
        "West": "Auckland - West",
    },
}

# The columns of a persisted listing with their types.
LISTING_SCHEMA = {
    "external_id": "string",
    "content_hash": "string",
    "island": "string",
    "region": "string",
    "subregion": "string",
    "city": "string",
    "duration_days": "int",
    "start_date": "date",
    "end_date": "date",
    "house_type": "string",
    "total_animals": "int",
    "dogs_count": "int",
    "cats_count": "int",
    "fish_count": "int",
    "birds_count": "int",
    "rabbits_guinea_pigs_count": "int",
    "chickens_ducks_geese_count": "int",
    "farm_animals_count": "int",
    "horses_count": "int",
    "reptiles_count": "int",
    "other_pets_count": "int",
    "no_pets": "boolean",
    "starts_soon": "boolean",
    "reply_rating_score": "int",
    "listing_tag": "string",
    "title": "string",
    "intro": "string",
    "url": "string",
}

# What the lifecycle adds to a listing.
LIFECYCLE_SCHEMA = {
    "first_seen_at": "timestamp_ntz",
    "last_seen_at": "timestamp_ntz",
    "first_seen_run_id": "bigint",
    "last_seen_run_id": "bigint",
    "first_seen_context": "string",
    "status": "string",
    "missing_count": "int",
    "missing_since": "timestamp_ntz",
    "closed_at": "timestamp_ntz",
    "appearance_sequence": "int",
    "created_at": "timestamp_ntz",
    "updated_at": "timestamp_ntz",
}

# Fields whose change makes a listing's content new.
NOT_IN_CONTENT_HASH = ["content_hash", "starts_soon", "url"]

# Fields whose change justifies a further alert.
FINGERPRINT_FIELDS = [
    "island",
    "region",
    "subregion",
    "city",
    "duration_days",
    "start_date",
    "end_date",
    "total_animals",
    *PET_COUNT_COLUMNS,
    "no_pets",
]

# Report projections.
EXPLORER_COLUMNS = [
    "external_id",
    "region",
    "subregion",
    "city",
    "start_date",
    "end_date",
    "duration_days",
    "pet_label",
    "dogs_count",
    "cats_count",
    "first_seen_at",
    "lead_time_days",
    "status",
    "url",
]
SUMMARY_COLUMNS = [
    "external_id",
    "island",
    "region",
    "subregion",
    "city",
    "duration_days",
    "start_date",
    "end_date",
    "total_animals",
    "dogs_count",
    "cats_count",
    "url",
]

# Alert rule defaults (null = no limit, null list = any).
RULE_SCHEMA = {
    "date_window_match": "string",
    "start_date_on_or_after": "date",
    "end_date_on_or_before": "date",
    "min_duration_days": "int",
    "max_duration_days": "int",
    "allowed_islands": "array<string>",
    "allowed_regions": "array<string>",
    "allowed_subregions": "array<string>",
    "max_total_animals": "int",
    "max_dogs": "int",
    "dogs_allowed": "boolean",
    "cats_allowed": "boolean",
    "fish_allowed": "boolean",
    "birds_allowed": "boolean",
    "rabbits_guinea_pigs_allowed": "boolean",
    "chickens_ducks_geese_allowed": "boolean",
    "farm_animals_allowed": "boolean",
    "horses_allowed": "boolean",
    "reptiles_allowed": "boolean",
    "other_pets_allowed": "boolean",
    "no_pets_allowed": "boolean",
    "min_reply_rating_score": "int",
    "allowed_house_types": "array<string>",
    "excluded_house_types": "array<string>",
    "include_keywords": "array<string>",
    "exclude_keywords": "array<string>",
}

# State, region, its site id, subregion, its site id.
# Slugs are not listed: they follow from the label by `text.slugify`.
LOCATIONS = [
    ("North Island", "Auckland", "33", "Auckland - Central", "178"),
    ("North Island", "Auckland", "33", "Auckland - North", "186"),
    ("North Island", "Auckland", "33", "Auckland - South", "222"),
    ("North Island", "Auckland", "33", "Manukau", "204"),
    ("North Island", "Auckland", "33", "North Shore City", "181"),
    ("North Island", "Auckland", "33", "Rodney", "180"),
    ("North Island", "Auckland", "33", "Waiheke Island", "203"),
    ("North Island", "Auckland", "33", "Waitakere", "179"),
    ("North Island", "Bay of Plenty", "34", "Opotiki", "247"),
    ("North Island", "Bay of Plenty", "34", "Rotorua", "231"),
    ("North Island", "Bay of Plenty", "34", "Tauranga", "243"),
    ("North Island", "Bay of Plenty", "34", "Western Bay of Plenty", "245"),
    ("North Island", "Bay of Plenty", "34", "Whakatane", "234"),
    ("North Island", "Gisborne", "36", "Gisborne", "352"),
    ("North Island", "Gisborne", "36", "Te Karaka", "355"),
    ("North Island", "Hawke's Bay", "37", "Central Hawke's Bay", "383"),
    ("North Island", "Hawke's Bay", "37", "Hastings", "368"),
    ("North Island", "Hawke's Bay", "37", "Napier", "369"),
    ("North Island", "Manawatū-Whanganui", "38", "Horowhenua", "438"),
    ("North Island", "Manawatū-Whanganui", "38", "Palmerston North", "416"),
    ("North Island", "Manawatū-Whanganui", "38", "Rangitikei", "431"),
    ("North Island", "Manawatū-Whanganui", "38", "Ruapehu", "421"),
    ("North Island", "Manawatū-Whanganui", "38", "Tararua", "417"),
    ("North Island", "Manawatū-Whanganui", "38", "Whanganui", "412"),
    ("North Island", "Northland", "32", "Far North", "138"),
    ("North Island", "Northland", "32", "Kaipara", "146"),
    ("North Island", "Northland", "32", "Whangarei", "128"),
    ("North Island", "Taranaki", "51", "Central Taranaki", "396"),
    ("North Island", "Taranaki", "51", "New Plymouth", "393"),
    ("North Island", "Taranaki", "51", "South Taranaki", "395"),
    ("North Island", "Waikato", "35", "Hamilton", "264"),
    ("North Island", "Waikato", "35", "Hauraki", "298"),
    ("North Island", "Waikato", "35", "Matamata-Piako", "276"),
    ("North Island", "Waikato", "35", "North Waikato", "320"),
    ("North Island", "Waikato", "35", "South Waikato", "286"),
    ("North Island", "Waikato", "35", "Taupo", "277"),
    ("North Island", "Waikato", "35", "Thames-Coromandel", "297"),
    ("North Island", "Waikato", "35", "Waipa", "267"),
    ("North Island", "Wairarapa", "510", "Masterton", "407"),
    ("North Island", "Wairarapa", "510", "South Wairarapa", "477"),
    ("North Island", "Wellington", "39", "Kapiti Coast", "466"),
    ("North Island", "Wellington", "39", "Lower Hutt", "462"),
    ("North Island", "Wellington", "39", "Porirua", "465"),
    ("North Island", "Wellington", "39", "Upper Hutt", "463"),
    ("North Island", "Wellington", "39", "Wellington", "409"),
    ("South Island", "Canterbury", "41", "Ashburton", "570"),
    ("South Island", "Canterbury", "41", "Banks Peninsula", "569"),
    ("South Island", "Canterbury", "41", "Christchurch", "544"),
    ("South Island", "Canterbury", "41", "Hurunui", "524"),
    ("South Island", "Canterbury", "41", "Mackenzie", "611"),
    ("South Island", "Canterbury", "41", "Selwyn", "543"),
    ("South Island", "Canterbury", "41", "Timaru", "612"),
    ("South Island", "Canterbury", "41", "Waimakariri", "532"),
    ("South Island", "Nelson / Marlborough", "40", "Marlborough", "506"),
    ("South Island", "Nelson / Marlborough", "40", "Nelson", "491"),
    ("South Island", "Nelson / Marlborough", "40", "Tasman", "489"),
    ("South Island", "Otago", "42", "Central Otago", "656"),
    ("South Island", "Otago", "42", "Clutha", "648"),
    ("South Island", "Otago", "42", "Dunedin", "637"),
    ("South Island", "Otago", "42", "Queenstown Lakes", "655"),
    ("South Island", "Otago", "42", "Waitaki", "675"),
    ("South Island", "Southland", "53", "Invercargill", "721"),
    ("South Island", "Southland", "53", "Southland", "677"),
    ("South Island", "West Coast", "52", "Buller", "1189"),
    ("South Island", "West Coast", "52", "Grey", "1190"),
    ("South Island", "West Coast", "52", "Westland", "1191"),
]

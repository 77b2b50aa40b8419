"""Results are only right when these equal the published semantics."""

# --- fixed values -----------------------------------------------------------------

# Administrative words dropped when a whole whitespace token equals one of them.
ADMIN_TOKENS = (
    "kabupaten", "kab.", "kab",
    "kota",
    "kecamatan", "kec.", "kec",
    "kelurahan", "kel.", "kel",
    "provinsi", "prov.", "prov",
    "administrasi",
    "kepulauan",
)

# Road prefixes never count as place evidence.
ROAD_PREFIXES = ("jl", "jalan", "gg", "gang")

# Level ids of the gazetteer.
LEVELS = ((1, "country"), (2, "province"), (3, "city"), (4, "district"), (5, "subdistrict"))
PROVINCE, CITY, DISTRICT, SUBDISTRICT = "PROVINCE", "CITY", "DISTRICT", "SUBDISTRICT"
ENTITY_LEVELS = {2: PROVINCE, 3: CITY, 4: DISTRICT, 5: SUBDISTRICT}

# Evidence types.
POSTAL_CODE, PLACE_NAME = "postal_code", "place_name"

# Statuses.
VALID, INCOMPLETE, AMBIGUOUS, CONFLICT, UNKNOWN = (
    "VALID", "INCOMPLETE", "AMBIGUOUS", "CONFLICT", "UNKNOWN",
)

# Components, in report order.
COMPONENTS = ("province", "city", "district", "sub_district", "postal_code")

# Discovery strategies tagged on every candidate.
STRATEGIES = ("top_down", "any_level")

ALIAS_STRATEGY = "alias"  # besides those, on a candidate that only an alias names

# Score weights.
W_EXACT = 0.10
W_HIERARCHY = 0.15
W_POSTAL = 0.05
W_LEVEL = {PROVINCE: 0.15, CITY: 0.12, DISTRICT: 0.08, SUBDISTRICT: 0.05}
W_MULTI = {PROVINCE: 0.20, CITY: 0.15, DISTRICT: 0.10, SUBDISTRICT: 0.05}
MAX_MULTI = 0.40
W_PREFIX = {5: 0.20, 4: 0.10, 3: 0.07}
AMBIGUITY_GAP = 0.1

# Reasons, in report order.
REASON_EXACT = "exact_match"
REASON_LEVEL = {
    PROVINCE: "match_province",
    CITY: "match_city",
    DISTRICT: "match_district",
    SUBDISTRICT: "match_subdistrict",
}
REASON_PREFIX = {
    5: "match_postal_code_exact",
    4: "match_postal_code_prefix4",
    3: "match_postal_code_prefix3",
}
REASON_LOOKUP = "postal_code_lookup"
REASON_INFERRED = "postal_code_inferred"

# Conflict types and messages.
HIERARCHY_CONFLICT = "hierarchy_conflict"
CITY_NOT_IN_PROVINCE = "city does not belong to province"
DISTRICT_NOT_IN_CITY = "district does not belong to city"
SUBDISTRICT_NOT_IN_DISTRICT = "sub-district does not belong to district"
POSTAL_MISMATCH = ("postal_code_mismatch", "postal code does not match sub-district")
ORPHAN_CITY = ("orphan_city", "city resolved without province")
MULTIPLE_CITY = ("multiple_city", "multiple city candidates: ")
DUPLICATE_LEVEL = ("duplicate_level", "duplicate ")

# Request defaults.
DEFAULT_SOURCE = "kemendagri"
MAX_ADDRESS_BYTES = 1000
ADDRESS_REQUIRED = "address is required"
ADDRESS_TOO_LONG = "address exceeds maximum length of %d characters"

# --- end of fixed values ----------------------------------------------------------

# Where a phrase of the dictionary comes from.
BY_NAME, BY_ALIAS = "name", "alias"

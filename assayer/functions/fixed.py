"""Fixed values. They decide results, so they are stated once here, as plain text."""

# Column-name keywords that flag a table as holding personal data.
PII_KEYWORDS = [
    "email", "phone", "ssn", "social_security",
    "credit_card", "card_number", "cvv",
    "address", "street", "zip", "postal",
    "name", "firstname", "lastname", "full_name",
    "dob", "date_of_birth", "birth_date",
    "ip_address", "ipaddress",
    "passport", "license", "drivers_license",
]

# Column-name keywords that flag a table as holding health data.
PHI_KEYWORDS = [
    "diagnosis", "medical", "health", "patient",
    "prescription", "treatment", "condition",
    "mrn", "medical_record",
]

# Column-name keywords that get a sensitive marker in reports.
REPORT_SENSITIVE_KEYWORDS = [
    "email", "phone", "ssn", "credit_card", "password",
    "address", "name", "dob", "birth", "salary", "account",
]

# Dataset names containing one of these are not scanned.
EXCLUDED_DATASET_PATTERNS = ["_staging", "temp_", "tmp_"]

# Dollars per GiB-month stored, dollars per TiB queried, queries per month.
STORAGE_USD_PER_GB = 0.020
QUERY_USD_PER_TB = 6.25
FULL_SCANS_PER_MONTH = 4

# Cache lifetime per volatility class.
CACHE_TTL = {"low": "7d", "medium": "24h", "high": "1h"}

# Quality status limits, in percent.
GOOD_FROM = 95
FAIR_FROM = 80

# Longest document text that may be stored, in characters.
MAX_CONTENT_CHARS = 100_000

# Ranking boosts as (condition, factor); the last two apply when the query has a trigger word.
BOOSTS = [
    ("last_modified >= timestamp'2024-01-01 00:00:00Z'", 1.5, []),
    ("environment = 'prod'", 1.3, []),
    ("completeness_score >= 0.95", 1.2, []),
    ("monthly_cost_usd > 100", 2.0, ["cost", "expensive"]),
    ("row_count > 1000000", 1.5, ["large", "big"]),
]

# Numeric filter keywords per catalog field, first match wins.
NUMERIC_FILTER_KEYWORDS = {
    "size_bytes": ["size", "bytes", "GB"],
    "monthly_cost_usd": ["cost", "expensive"],
    "row_count": ["rows", "records"],
}
UNIT_BYTES = {"KB": 1024.0, "MB": 1024.0**2, "GB": 1024.0**3}

# Page size default and the largest page a caller may ask for.
DEFAULT_PAGE_SIZE = 10
MAX_PAGE_SIZE = 100

# Info types found in cell values. The patterns stay inside what Java and RE2 share.
INFO_TYPES = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE_NUMBER": r"\b\+?[0-9]{0,2}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}\b",
    "US_SOCIAL_SECURITY_NUMBER": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "CREDIT_CARD_NUMBER": r"\b[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}

# A character every match of the info type holds; cells without it need no pattern test.
INFO_TYPE_MARKERS = {"EMAIL_ADDRESS": "@"}

"""The constants every result depends on, kept together and in plain form."""

# Scores and detector patterns, in RE2 syntax (ASCII \b, \d and \s).
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"\+?\d[\d\s\-]{7,}"
TOKEN_PATTERN = r"\b[A-Za-z0-9_\-]{20,}\b"
JWT_PATTERN = r"\b[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b"
EMAIL_SCORE = 0.99
PHONE_SCORE = 0.95
API_KEY_SCORE = 0.8
JWT_SCORE = 0.9
API_KEY_MIN_ENTROPY = 3.2

# Order in which detectors report; it breaks ties between equal spans.
DETECTOR_ORDER = ["email", "phone", "api_key", "jwt", "secret"]
SECRET_TYPES = [
    "aws_access_key",
    "aws_secret_key",
    "aws_session_token",
    "gcp_api_key",
    "gcp_service_account",
    "azure_connection_string",
    "azure_sas_token",
    "private_key",
    "db_url",
    "high_entropy",
    "hex_secret",
]

# JSON keys whose string values are user content, and keys never touched.
SANITIZE_KEYS = ["prompt", "input", "content", "text", "message", "parts"]
SKIP_KEYS = [
    "authorization",
    "access_token",
    "session_token",
    "token",
    "bearer",
    "id_token",
    "refresh_token",
    "api_key",
    "apikey",
    "x-api-key",
    "cookie",
    "set-cookie",
    "model",
    "role",
    "type",
    "id",
    "object",
    "created",
    "system_fingerprint",
]

# Limits.
PREVIEW_LENGTH = 512
TRACE_SAMPLE_RATE = 0.1
TOP_DOMAINS = 5
RECENT_REQUESTS = 20
FOLLOW_TAIL = 20
SHARE_STEPS = 20

# Entity model: gate, score, sequence limits, special pieces, label names.
NER_MIN_BYTES = 8
NER_LETTER_SHARE = 0.4
NER_SPACE_SHARE = 0.05
NER_MIN_SCORE = 0.70
UNKNOWN_PIECE = "[UNK]"
START_PIECE = "[CLS]"
END_PIECE = "[SEP]"
NER_TYPE_NAMES = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "LOC": "LOC", "GPE": "LOC", "MISC": "MISC"}

# Host categories, first match wins.
HOST_CATEGORIES = [("openai.com", "LLM_OPENAI"), ("anthropic.com", "LLM_ANTHROPIC")]
UNKNOWN_CATEGORY = "UNKNOWN"

# The rule used when none is given.
DEFAULT_RULES = [{"id": "allow_all", "action": "allow"}]

# Columns of the recent-requests report.
RECENT_COLUMNS = ["timestamp", "domain", "method", "status", "masked_types", "masked_count", "latency_ms"]

# Shape of a placeholder.
PLACEHOLDER_PATTERN = r"\[[A-Z0-9_]+_[0-9]+\]"

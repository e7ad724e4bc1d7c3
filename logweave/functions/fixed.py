"""Fixed values.

Everything in this module must stay equal to the behaviour being reproduced
(patterns, keyword lists, constants, texts, formats).  They are stated here
plainly, in their natural order, so the rest of the code can refer to them by
name.  Patterns are Java regular expressions, which is what Spark's
``regexp_*`` / ``rlike`` functions evaluate.
"""

# --- fixed values: plain-text line grammar --------------------------------
# "TIMESTAMP LEVEL SERVICE - MESSAGE", then "TIMESTAMP LEVEL MESSAGE".
# Full-line matches; ``\z`` (not ``$``) so a trailing line terminator fails.
PLAIN_WITH_SERVICE = (
    r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+([A-Z]+)\s+"
    r"([a-zA-Z0-9_-]+)\s+-\s+(.*)\z"
)
PLAIN_NO_SERVICE = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+([A-Z]+)\s+(.*)\z"
UNKNOWN_SERVICE = "unknown"

# --- fixed values: timestamp texts accepted (after 'T' -> ' ') --------------
# yyyy-MM-dd HH:mm:ss.SSS  and  yyyy-MM-dd HH:mm:ss
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{3})?\z"

# --- fixed values: log levels -----------------------------------------------
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN"]
LEVEL_ALIASES = {"WARNING": "WARN", "CRITICAL": "FATAL"}

# --- fixed values: JSON line field aliases (first name wins if present) -----
JSON_TS_KEYS = ("timestamp", "time")
JSON_LEVEL_KEYS = ("level", "severity")
JSON_SERVICE_KEYS = ("service", "logger")
JSON_MESSAGE_KEYS = ("message", "msg")

# --- fixed values: JSON scanning patterns -----------------------------------
# A quoted JSON string body is "any run of non-quote/non-backslash characters
# or backslash escapes".  It is written in the unrolled, possessive form
# [^\\"]*+(?:\\.[^\\"]*+)*+ which accepts exactly the same texts as
# (?:[^\\"]|\\.)* but does not recurse once per character in Java's regex
# engine (long values would otherwise overflow an executor thread's stack).
_QSTR = r'[^\\"]*+(?:\\.[^\\"]*+)*+'
# key : "quoted value"  |  key : bare-token   (any depth, every match)
JSON_KV = r'"([a-zA-Z0-9_-]+)"\s*:\s*(?:"(' + _QSTR + r')"|([^,}\s]+))'
# "field" : "string"      (the field name is quoted into the pattern)
JSON_STRING_FIELD = r'"{field}"\s*:\s*"(' + _QSTR + r')"'
# "field" : number
JSON_NUMBER_FIELD = r'"{field}"\s*:\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'
# "field" : [ ... ]  then each quoted element inside
JSON_ARRAY_FIELD = r'"{field}"\s*:\s*\[([^\]]*)\]'
JSON_QUOTED = r'"(' + _QSTR + r')"'

# --- fixed values: message template and hashed n-gram vector ----------------
HEX_RUN = r"0x[0-9a-f]+"
HEX_TOKEN = "<HEX>"
DIGIT_RUN = r"\d+"
NUM_TOKEN = "<NUM>"
NON_TEMPLATE_CHARS = r"[^a-z<>]+"
VECTOR_DIM = 128
BIGRAM_MULT = 31
BIGRAM_XOR = 17
BIGRAM_WEIGHT = 1.0
UNIGRAM_MULT = 13
UNIGRAM_WEIGHT = 0.5
SIMILARITY_THRESHOLD = 0.85
SMALL_CLUSTER_SIZE = 2

# --- fixed values: keyword rules, in priority order -------------------------
# (keywords, pattern, root cause, fix suggestion, confidence)
HEURISTIC_PREFIX = "[Heuristic] "
RULES = [
    (
        ["connection", "timeout", "refused"],
        "Network/Connection Error",
        "Connection refused, timeout, or network error.",
        "Check network connectivity, firewall rules, and downstream service health.",
        0.7,
    ),
    (
        ["nullpointer", "null pointer", "npe"],
        "NullPointerException",
        "An object reference was used before being initialized.",
        "Add null-checks or use Optional. Review the stack trace for the offending field.",
        0.7,
    ),
    (
        ["out of memory", "outofmemory", "heap"],
        "Out-of-Memory Error",
        "JVM heap exhausted - possible memory leak or under-provisioned heap.",
        "Increase max heap size, profile memory usage with VisualVM, and review object lifecycle.",
        0.7,
    ),
    (
        ["authentication", "unauthorized", "forbidden"],
        "Authentication/Authorization Failure",
        "Request rejected due to missing or invalid credentials.",
        "Verify API keys, token expiry, and RBAC policies.",
        0.6,
    ),
]
DEFAULT_RULE = (
    "Unclassified Error",
    "Pattern not recognized by heuristic analysis. Enable Anthropic API for full analysis.",
    "Review the full stack trace and correlated logs for surrounding context.",
    0.3,
)
EMPTY_CLUSTER = ("empty-cluster", "No entries to analyze.", "", "", 0.0)

# --- fixed values: prompt, request and reply handling -----------------------
DEFAULT_MODEL = "claude-3-5-sonnet-20241022"
MAX_TOKENS = 1024
MAX_LINES_PER_CLUSTER = 20
PROMPT_HEADER = (
    "You are an expert Site Reliability Engineer. Analyze the following cluster of "
    "similar log entries and identify the root cause.\n\n"
    "### LOG ENTRIES:\n"
)
PROMPT_MORE = "... and {n} more similar entries.\n"
PROMPT_FOOTER = (
    "\nRespond ONLY with a valid JSON object in this exact format (no markdown, no explanation):\n"
    "{\n"
    '  "errorPattern": "Short label for the recurring error pattern",\n'
    '  "rootCause": "Human-readable concise explanation of what caused the error",\n'
    '  "fixSuggestion": "Actionable remediation step",\n'
    '  "confidenceScore": <number between 0.0 and 1.0>\n'
    "}\n"
)
REPLY_DEFAULTS = {
    "errorPattern": "Unknown pattern",
    "rootCause": "Could not determine root cause",
    "fixSuggestion": "Review logs manually",
    "confidenceScore": 1.0,
}
EMPTY_REPLY = ("Empty reply", "Unable to parse response.", "", 0.0)
MALFORMED_REPLY = ("Malformed LLM response", "", 0.0)  # root cause = the reply text
CODE_FENCES = ("```json", "```")

# --- fixed values: alert severities (ours: worst level in the cluster) ------
SEVERITY_BY_LEVEL = [("FATAL", "CRITICAL"), ("ERROR", "HIGH"), ("WARN", "MEDIUM")]

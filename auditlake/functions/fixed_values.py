"""Fixed values. Results depend on these exact words, patterns and limits, so they are kept together
here, as plain text, and the rest of the package refers to them by name."""

# ---- Fixed values: operation types and the category labels that belong to each -----------------
OP_TYPES = ("read", "write", "metadata", "schema_change", "other")

CATEGORY_OP_TYPE = {
    "SELECT": "read",
    "SHOW": "metadata",
    "DESCRIBE": "metadata",
    "EXPLAIN": "metadata",
    "CREATE_ROUTINE_LOAD": "write",
    "SUBMIT": "write",
    "LOAD_LABEL": "write",
    "CREATE_PIPE": "write",
    "INSERT": "write",
    "UPDATE": "write",
    "DELETE": "write",
    "TRUNCATE": "write",
    "LOAD": "write",
    "ALTER": "schema_change",
    "CREATE": "schema_change",
    "DROP": "schema_change",
    "SET": "other",
    "ROLLBACK": "other",
    "COMMIT": "other",
    "BEGIN": "other",
    "USE": "other",
    "OTHER": "other",
}

# Statement openings of several words, tried before single words.
PHRASE_CATEGORY = {
    "CREATE ROUTINE LOAD": "CREATE_ROUTINE_LOAD",
    "LOAD LABEL": "LOAD_LABEL",
    "CREATE PIPE": "CREATE_PIPE",
}

# Single opening words.
WORD_CATEGORY = {
    "SELECT": "SELECT",
    "WITH": "SELECT",
    "SHOW": "SHOW",
    "DESCRIBE": "DESCRIBE",
    "DESC": "DESCRIBE",
    "EXPLAIN": "EXPLAIN",
    "SUBMIT": "SUBMIT",
    "INSERT": "INSERT",
    "UPDATE": "UPDATE",
    "DELETE": "DELETE",
    "TRUNCATE": "TRUNCATE",
    "ALTER": "ALTER",
    "CREATE": "CREATE",
    "DROP": "DROP",
    "SET": "SET",
    "ROLLBACK": "ROLLBACK",
    "COMMIT": "COMMIT",
    "BEGIN": "BEGIN",
    "USE": "USE",
}

# Pattern types of the single-file pattern report, and of the merged one, in test order.
PATTERN_TYPES_SINGLE = {
    "INSERT": "INSERT",
    "UPDATE": "UPDATE",
    "DELETE": "DELETE",
    "SUBMIT": "SUBMIT",
    "CREATE ROUTINE LOAD": "CREATE_ROUTINE_LOAD",
    "LOAD LABEL": "LOAD_LABEL",
    "CREATE PIPE": "CREATE_PIPE",
    "SELECT": "SELECT",
    "WITH": "SELECT",
    "SHOW": "SHOW",
    "ALTER": "ALTER",
    "CREATE": "CREATE",
    "DROP": "DROP",
}
PATTERN_TYPES_MERGED = {
    "INSERT": "INSERT",
    "UPDATE": "UPDATE",
    "DELETE": "DELETE",
    "SELECT": "SELECT",
    "WITH": "SELECT",
    "SHOW": "SHOW",
    "ALTER": "ALTER",
    "CREATE": "CREATE",
    "DROP": "DROP",
}

# ---- Fixed values: line fields -----------------------------------------------------------------
JSON_TIMESTAMP = r"\|Timestamp=(\d+)\|"
JSON_TIMESTAMP_OR_EMPTY = r"\|Timestamp=([0-9]*)\|"
TIMESTAMP_FIELD = r"\|Timestamp=([^|]*)\|"
TIMESTAMP_MARK = "|Timestamp="
STMT_MARK = "|Stmt="
# Everything after the first statement mark up to the next "|Name=". Possessive: one linear pass.
STMT_TO_NEXT_FIELD = r"\|Stmt=([^|]*+(?:\|(?![A-Za-z][A-Za-z0-9_]*=)[^|]*+)*+)"
STMT_TO_PIPE = r"Stmt=([^|]+)"
STMT_TO_PIPE_OR_EMPTY = r"Stmt=([^|]*)"
STMT_FIELD_TO_PIPE = r"\|Stmt=([^|]*)"
PLAIN_TIMESTAMP = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\+\d{2}:\d{2})"
JSON_TIME = r"\|Time=(\d+)\|"
PLAIN_TIME = r"Time=(\d+)"
TIME_FIELD = r"\|Time=([^|]*)\|"

# White space that a Unicode-aware strip removes.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# White space of the POSIX [:space:] class.
POSIX_SPACE = "\t\n\x0b\x0c\r "

# ---- Fixed values: fingerprints ----------------------------------------------------------------
QUOTED = r"'[^']*'"
DOUBLE_QUOTED = r'"[^"]*"'
NUMBER = r"(?U)\b\d+\b"
ASCII_NUMBER = r"\b[0-9]+\b"
DECIMAL_NUMBER = r"\b[0-9]+(\.[0-9]+)?\b"
UUID = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
TIMESTAMP_TEXT = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
DATE_TEXT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME_TEXT = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
# ``name = number`` before a space or at the end. The look-behind only skips starts inside a name
# (the start of the name matches first anyway), and nothing is given back: both save time only.
FIELD_EQUALS_NUMBER = r"(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_]*+\s*+=\s*+[0-9]++\s"
FIELD_EQUALS_LAST_NUMBER = r"(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_]*+\s*+=\s*+[0-9]++\z"
PARTITION_LIST = r"PARTITION *\([^)]*\)"
IN_LIST = r"IN\s*\([^)]*\)"
VALUES_LIST = r"VALUES\s*\([^)]*\)"

# ---- Fixed values: limits ----------------------------------------------------------------------
MAX_STATEMENT_CHARS = 6000
TOP_PATTERNS_PER_TYPE = 10
MIN_PATTERN_COUNT = 2
TOP_PATTERNS_BY_OP_TYPE = {"read": 10, "write": 100, "schema_change": 10}
REJECT_SAMPLE_ROWS = 10
MAX_EPOCH_SECOND = 253402300799  # 9999-12-31 23:59:59, the last second with a four-digit year

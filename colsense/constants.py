"""Fixed values that must equal the reference behaviour for identical results.

FIXED VALUES (kept verbatim, in natural order):
"""

# --- alignment / evaluation -------------------------------------------------
MISSING = "MISSING"                       # gap marker in padded / aligned lists
UNSPECIFIED = "unspecified"               # text for a null label in prompts
ADJUST_UP_TO = 2                          # default insertion cap for alignment
SPARSITY_DECIMALS = 1                     # sparsity bucket precision

# finish-reason keys (spelling kept as published, including the typo)
FAILED_API_REQUEST = "failed_api_request"
DELINEARIZATION_FAILED = "delinearizeation_failed"

# header flags in experiment names
WITH_HEADERS = "-with-headers"
WITHOUT_HEADERS = "-without-headers"

# report rows besides the per-label rows
AVG_ROWS = ("macro avg", "weighted avg", "micro avg", "accuracy")

# --- request accounting -----------------------------------------------------
TOKENS_PER_MESSAGE = 10                   # extra tokens per chat message
USAGE_FOR_FAILED = 0
COST_FOR_FAILED = 0.0
WAIT_WINDOW_SECONDS = 70.0
API_SHARE = 0.3
CACHE_SIZE = 100_000
MAX_TOKENS_OVER_TRUTH = 100

# model limits and prices:
# (model, chat_or_completion, max_rpm, max_tpm, cost/1k input, cost/1k output,
#  max_context, max_output_tokens)
MODELS = [
    ("gpt-3.5-turbo-1106", "chat", 10_000, 2_000_000, 0.001, 0.002, 16_385, 4_096),
    ("gpt-4-0613", "chat", 10_000, 300_000, 0.03, 0.06, 8_192, None),
]
MODEL_SCHEMA = ("model string, chat_or_completion string, max_rpm bigint, max_tpm bigint, "
                "cost_per_1k_input double, cost_per_1k_output double, max_context bigint, "
                "max_output_tokens bigint")

# --- prompt defaults --------------------------------------------------------
PROMPT_TEMPLATE = [
    {"role": "user", "content": (
        "Predict the column types of the following tables. Provide just the column types "
        "as a JSON list without any introduction or explanation.\n"
        "Column types are: {{all_column_types}}")},
    "{{examples}}",
    {"role": "user", "content": "{{table}}"},
]
EXAMPLE_TEMPLATE = [
    {"role": "user", "content": "{{table}}"},
    {"role": "assistant", "content": "{{column_types}}"},
]
TABLE_TEMPLATE = "{{table_name}}{{newline}}{{table}}"

# --- csv reading ------------------------------------------------------------
# default NA tokens of the pandas csv reader
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# numeric token rule (a cell parses as a number): optional sign, digits with an
# optional fraction or a bare fraction, optional exponent; or inf / nan words.
NUMERIC_PATTERN = (r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
                   r"|inf|Inf|INF|infinity|Infinity|INFINITY|nan|NaN|NAN)\s*$")

# token pieces: runs of letters/digits/underscore, or single other non-space chars
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

"""Column expressions shared by operators (all built from native Spark functions)."""

from colsense.functions.text import (  # noqa: F401
    csv_field, json_string, json_list, strip_ws, with_strict_json_array, token_count,
)
from colsense.functions.numeric import (  # noqa: F401
    is_na_token, is_numeric_token, sparsity_bucket, decimal_text,
)

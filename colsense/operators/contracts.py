"""Contracts that a plan checks while it runs, beside the audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """The same rows; a row where ``ok`` isn't true fails the query with
    ``message`` when the row is computed (no extra scan, nothing runs before)."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))

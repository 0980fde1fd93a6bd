"""Finish-reason counts over a growing folder of response files.

Same expressions as the batch operator (``parse.parse_predictions`` and
``parse.finish_reason_counts``); the aggregation state is one row per
finish reason, so ``complete`` output mode stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsense.operators import parse

RESPONSE_FILE_SCHEMA = "request_id bigint, body string"


def finish_reason_stream(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame of ``(finish_reason, n)`` over response files in ``folder``."""
    stream = spark.readStream.schema(RESPONSE_FILE_SCHEMA).format(fmt).load(folder)
    return parse.finish_reason_counts(parse.parse_predictions(stream))

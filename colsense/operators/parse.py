"""Response parsing: text extraction, list delinearization, finish-reason counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import DELINEARIZATION_FAILED, FAILED_API_REQUEST
from colsense.functions.text import strip_ws, with_strict_json_array


# only the fields evaluation reads; one parse of the body instead of one per path
_RESPONSE_SCHEMA = "choices array<struct<message: struct<content: string>, finish_reason: string>>"


def is_failed(body: Column) -> Column:
    """A response without ``choices`` is a failed request."""
    return F.get_json_object(body, "$.choices").isNull()


def extract_response_text(body: Column) -> Column:
    """``choices[0].message.content`` (``choices[0].text`` of a completion) or
    null for a failed request."""
    return F.when(~is_failed(body), F.coalesce(F.get_json_object(body, "$.choices[0].message.content"),
                                               F.get_json_object(body, "$.choices[0].text")))


def finish_reason(body: Column) -> Column:
    return F.get_json_object(body, "$.choices[0].finish_reason")


def delinearize_list_csv(s: Column, sep: str = ",", strip: bool = True) -> Column:
    parts = F.split(s, _quote_regex(sep), -1)
    return F.transform(parts, strip_ws) if strip else parts


def _quote_regex(sep: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)


def delinearize_list_json(df: DataFrame, src: str, out: str, strip: bool = True) -> DataFrame:
    """Adds the label list that a JSON text holds, after the published repairs."""
    return with_strict_json_array(df, src, out, strip)


def parse_predictions(responses: DataFrame, key: str = "request_id", body: str = "body",
                      mode: str = "json_list", sep: str = ",", strip: bool = True) -> DataFrame:
    """``(key, failed, finish_reason, parsed, pred_types)``.

    ``parsed`` is null when the request failed or the text could not be read;
    ``pred_types`` then falls back to the empty list.
    """
    doc = F.from_json(F.col(body), _RESPONSE_SCHEMA)
    first = F.get(doc["choices"], 0)
    staged = responses.select(
        F.col(key), doc["choices"].isNull().alias("failed"), first["finish_reason"].alias("finish_reason"),
        first["message"]["content"].alias("text"))
    if mode == "json_list":
        staged = delinearize_list_json(staged, "text", "parsed", strip)
    else:
        staged = staged.withColumn("parsed", delinearize_list_csv(F.col("text"), sep, strip))
    return (staged.drop("text")
                  .withColumn("pred_types", F.coalesce(F.col("parsed"), F.array().cast("array<string>"))))


def failed_response_count(responses: DataFrame, body: str = "body") -> DataFrame:
    """``(n_responses, n_failed)``."""
    return responses.agg(F.count(F.lit(1)).alias("n_responses"),
                         F.count_if(is_failed(F.col(body))).alias("n_failed"))


def finish_reason_counts(preds: DataFrame) -> DataFrame:
    """``(finish_reason, n)`` over parsed predictions.

    A failed request counts under ``failed_api_request``; an unreadable text
    counts under its finish reason *and* under the parse-failure key.
    """
    reasons = (F.when(F.col("failed"), F.array(F.lit(FAILED_API_REQUEST)))
                .when(F.col("parsed").isNull(), F.array(F.col("finish_reason"), F.lit(DELINEARIZATION_FAILED)))
                .otherwise(F.array(F.col("finish_reason"))))
    return (preds.select(F.explode(reasons).alias("finish_reason"))
                 .groupBy("finish_reason").agg(F.count(F.lit(1)).alias("n")))

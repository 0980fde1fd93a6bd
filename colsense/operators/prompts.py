"""Chat requests of a corpus: every table's prompt part is made once and staged;
requests, examples and vocabularies all read that frame.

A part holds a table's text, its text as an example for others (labelled
columns, at most ``example_columns`` of them, the same sampled rows) and its
labels.  Examples are found by index arithmetic on a light frame of annotated
tables, so texts move once for the example and once for the request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import MAX_TOKENS_OVER_TRUTH, MODELS, TABLE_TEMPLATE
from colsense.functions.text import json_list, token_count
from colsense.operators import linearize, sample
from colsense.operators.annotate import stringify_unspecified
from colsense.session import staged


@dataclass(frozen=True)
class PromptSettings:
    rows: int = 3
    examples: int = 1
    #: columns of an example at most (None: all)
    example_columns: int | None = 20
    #: drop columns without a label from examples
    labelled_only: bool = True
    #: size of a vocabulary drawn for each instance (None: the whole vocabulary)
    instance_vocabulary: int | None = None
    #: csv, key_value or markdown
    mode: str = "csv"
    tokens_over_truth: int | None = MAX_TOKENS_OVER_TRUTH
    model: str = MODELS[0][0]
    temperature: float = 0.0
    row_seed: int = 20260311
    order_seed: int = 20260312
    example_seed: int = 20260313
    column_seed: int = 20260314


def max_tokens_for_truth(true_types: Column, over: int | None) -> Column:
    """Tokens of the linearized truth plus an allowance; null without one."""
    if over is None:
        return F.lit(None).cast("bigint")
    return token_count(json_list(stringify_unspecified(true_types))) + over


def prompt_parts(rows: DataFrame, tables: DataFrame, s: PromptSettings) -> DataFrame:
    """Staged ``(table_id, true_types, table_text, ex_text, ex_types)`` of the
    annotated tables; ``tables`` has table_id, table_name, headers and true_types."""
    sampled = (sample.sample_rows(rows, s.rows, s.row_seed)
               .groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "cells"))),
                                                    lambda r: r["cells"]).alias("rows")))
    t = sampled.join(tables.where(F.exists("true_types", lambda x: x.isNotNull())), "table_id")
    known = F.filter(F.sequence(F.lit(0), F.size("true_types") - 1),
                     lambda i: F.get(F.col("true_types"), i).isNotNull() if s.labelled_only else F.lit(True))
    t = sample.sample_columns(t.withColumn("known", known), s.example_columns, s.column_seed, lists=("known",)).drop("kept_cols")
    at = lambda c: F.transform("known", lambda i: F.get(F.col(c), i))
    t = (t.withColumn("ex_headers", at("headers")).withColumn("ex_labels", at("true_types"))
          .withColumn("ex_rows", F.transform("rows", lambda r: F.transform("known", lambda i: F.get(r, i)))))
    t = linearize.with_table_text(t, s.mode, "headers", "rows", "text")
    t = linearize.with_table_text(t, s.mode, "ex_headers", "ex_rows", "ex")
    fill = lambda c: linearize.fill_table_template(TABLE_TEMPLATE, F.col("table_name"), F.col(c))
    return staged(t.select("table_id", "true_types", fill("text").alias("table_text"), fill("ex").alias("ex_text"),
                           json_list(stringify_unspecified(F.col("ex_labels"))).alias("ex_types")), "prompts")


def chat_requests(parts: DataFrame, vocabulary: Column, s: PromptSettings, open_only: bool = False) -> DataFrame:
    """Request rows (request_id, model, max_tokens, .., messages) of all parts;
    ``vocabulary`` is the sorted array of labels.  ``open_only``: just those
    with a ``{{`` in one of their texts, before any message is built."""
    index = staged(sample.shuffle_limit_reindex(parts.select("table_id"), s.order_seed, None), "index")
    pairs = sample.sample_examples(index, s.examples, s.example_seed)
    shown = pairs.join(parts.select(F.col("table_id").alias("example_id"), F.col("true_types").alias("labels"), "ex_text", "ex_types"), "example_id")
    found = shown.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("j", "ex_text", "ex_types", "labels"))).alias("found"))
    t = parts.select("table_id", "true_types", "table_text").join(found, "table_id", "left")
    t = t.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    if open_only:
        t = t.where(F.col("table_text").contains("{{") | F.exists("found", lambda e: e["ex_text"].contains("{{") | e["ex_types"].contains("{{")))
    if s.instance_vocabulary is None:
        t = t.withColumn("candidates", vocabulary)
    else:
        own = F.concat("true_types", F.flatten(F.transform("found", lambda e: e["labels"])))
        t = sample.walked_vocabulary(t.withColumn("labels", own), vocabulary, s.instance_vocabulary, s.column_seed)
    messages = F.flatten(F.transform("found", lambda e: linearize.example_messages(e["ex_text"], e["ex_types"])))
    return t.select(
        F.col("table_id").alias("request_id"), F.lit(s.model).alias("model"),
        max_tokens_for_truth(F.col("true_types"), s.tokens_over_truth).alias("max_tokens"),
        F.lit(s.temperature).alias("temperature"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("seed", "n", "best_of")],
        linearize.prompt_messages(json_list(F.col("candidates")), messages, F.col("table_text")).alias("messages"))

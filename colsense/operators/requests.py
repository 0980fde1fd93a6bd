"""Request accounting: token estimates, usage and cost, checks, hashes, cache,
usage totals and the rolling request budget.

Model limits and prices are a fixed table of a few rows, joined by broadcast.
The rolling budget is a stabbing count over request intervals computed as a
global running sum of +1/-1 events (no self join, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import API_SHARE, CACHE_SIZE, TOKENS_PER_MESSAGE, WAIT_WINDOW_SECONDS
from colsense.functions.text import json_string, token_count
from colsense.operators.sample import dense_index, prefix_sums


def estimate_tokens(messages: Column) -> Column:
    """Tokens of a chat request: pieces per message plus a fixed per-message allowance."""
    return F.aggregate(messages, F.lit(0).cast("bigint"),
                       lambda acc, m: acc + token_count(m["content"]) + TOKENS_PER_MESSAGE)


def token_count_of(text: Column) -> Column:
    return token_count(text)


def with_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    # the model table holds one row per supported model: a proven small side
    return requests.join(F.broadcast(models), "model", "left")


def estimate_max_output(max_tokens: Column, input_tokens: Column) -> Column:
    left = F.greatest(F.lit(0), F.col("max_context") - input_tokens)
    capped = F.when(F.col("max_output_tokens").isNotNull() & (F.col("max_output_tokens") < left),
                    F.col("max_output_tokens")).otherwise(left)
    return F.coalesce(max_tokens, capped)


def input_tokens(has_prompt: bool) -> Column:
    """Tokens of a request's messages, or of its prompt where the model (its
    ``chat_or_completion``) completes text; a request without the field that its
    model needs is an error when the plan runs."""
    def needed(field: str, tokens: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit(f"the request is missing the field {field}: "), F.col("request_id").cast("string")))
        return F.when(F.col(field).isNotNull(), tokens).otherwise(missing.cast("bigint"))
    chat = needed("messages", estimate_tokens(F.col("messages")))
    if not has_prompt:
        return chat
    return F.when(F.col("chat_or_completion") == "completion", needed("prompt", token_count(F.col("prompt")).cast("bigint"))).otherwise(chat)


def usage_and_cost(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Input tokens, max output, usage multiplied by ``best_of``/``n`` and the
    maximum cost; requests may have a ``prompt`` for completion models."""
    r = with_models(requests, models).withColumn("input_tokens", input_tokens("prompt" in requests.columns))
    mult = F.coalesce(F.col("best_of"), F.col("n"), F.lit(1))
    r = r.withColumn("max_output", estimate_max_output(F.col("max_tokens"), F.col("input_tokens")))
    r = r.withColumn("input_usage", mult * F.col("input_tokens")) \
         .withColumn("output_usage", mult * F.col("max_output"))
    return (r.withColumn("max_total_usage", F.col("input_usage") + F.col("output_usage"))
             .withColumn("max_cost", F.col("input_usage") * (F.col("cost_per_1k_input") / 1000)
                         + F.col("output_usage") * (F.col("cost_per_1k_output") / 1000)))


def request_checks(r: DataFrame) -> DataFrame:
    """Warnings per request as an array of codes (after :func:`usage_and_cost`)."""
    ctx, inp, mt = F.col("max_context"), F.col("input_tokens"), F.col("max_tokens")
    codes = F.array(
        F.when(ctx < inp, F.lit("input_exceeds_context")),
        F.when(ctx == inp, F.lit("no_room_for_output")),
        F.when(mt.isNotNull() & F.col("max_output_tokens").isNotNull() & (F.col("max_output_tokens") < mt),
               F.lit("max_tokens_exceeds_output_limit")),
        F.when(mt.isNotNull() & (ctx < inp + mt), F.lit("max_tokens_exceeds_context")),
        F.when(F.col("seed").isNull(), F.lit("seed_missing")),
        F.when(F.col("temperature").isNull() | (F.col("temperature") != 0), F.lit("temperature_not_zero")))
    return r.withColumn("violations", F.filter(codes, lambda x: x.isNotNull()))


def _num(c: Column) -> Column:
    """Integral numbers as integers, others as decimals (JSON number text)."""
    return F.when(c.isNull(), F.lit("null")).when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")) \
            .otherwise(c.cast("string"))


def request_json(r: DataFrame) -> Column:
    """The request document in the published key order and layout (``", "`` and
    ``": "`` separators, ASCII escapes); ``seed``, ``n`` and ``best_of`` only
    when present, ``prompt`` in place of absent messages."""
    msgs = F.concat(F.lit("["), F.array_join(F.transform("messages", lambda m: F.concat(
        F.lit('{"role": '), json_string(m["role"]), F.lit(', "content": '), json_string(m["content"]),
        F.lit("}"))), ", "), F.lit("]"))
    parts = [F.concat(F.lit('{"model": '), json_string(F.col("model"))),
             F.concat(F.lit(', "max_tokens": '), _num(F.col("max_tokens"))),
             F.concat(F.lit(', "temperature": '), _num(F.col("temperature"))),
             F.concat(F.lit(', "messages": '), msgs)]
    if "prompt" in r.columns:
        prompt = F.concat(F.lit(', "prompt": '), json_string(F.col("prompt")))
        parts[-1] = F.when(F.col("messages").isNull(), prompt).otherwise(parts[-1])
    for opt in ("seed", "n", "best_of"):
        parts.append(F.when(F.col(opt).isNotNull(), F.concat(F.lit(f', "{opt}": '), _num(F.col(opt))))
                      .otherwise(F.lit("")))
    return F.concat(*parts, F.lit("}"))


def request_hash(doc: Column) -> Column:
    return F.sha2(doc, 256)


def actual_usage_cost(responses: DataFrame, models: DataFrame, body: str = "body") -> DataFrame:
    """Total tokens and cost of executed responses; failures cost nothing."""
    b = F.col(body)
    ok = F.get_json_object(b, "$.choices").isNotNull()
    parsed = responses.select(
        "*", ok.alias("ok"), F.get_json_object(b, "$.model").alias("model"),
        F.get_json_object(b, "$.usage.total_tokens").cast("bigint").alias("total_tokens"),
        F.get_json_object(b, "$.usage.prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.get_json_object(b, "$.usage.completion_tokens").cast("bigint").alias("completion_tokens"))
    j = parsed.join(F.broadcast(models), "model", "left")
    cost = (F.coalesce(F.col("prompt_tokens") * (F.col("cost_per_1k_input") / 1000), F.lit(0.0))
            + F.coalesce(F.col("completion_tokens") * (F.col("cost_per_1k_output") / 1000), F.lit(0.0)))
    return j.select("*", F.when(F.col("ok"), F.col("total_tokens")).otherwise(F.lit(0)).alias("usage"),
                    F.when(F.col("ok"), cost).otherwise(F.lit(0.0)).alias("cost"))


def request_usage_totals(pending: DataFrame, executed: DataFrame, n_cached: Column,
                         force: float | None = None) -> DataFrame:
    """Maximum cost of pending requests, actual cost of executed ones, cached and
    failed counts, and the budget gate ``needs_confirmation``."""
    rows = pending.select(F.lit(True).alias("is_pending"), F.col("max_cost"),
                          F.lit(None).cast("double").alias("cost"), F.lit(None).cast("boolean").alias("ok"),
                          F.lit(None).cast("bigint").alias("usage")) \
        .unionByName(executed.select(F.lit(False).alias("is_pending"), F.lit(None).cast("double").alias("max_cost"),
                                     F.col("cost"), F.col("ok"), F.col("usage").cast("bigint")))
    totals = rows.agg(
        F.coalesce(F.sum("max_cost"), F.lit(0.0)).alias("max_cost_pending"),
        F.count_if(F.col("is_pending")).alias("n_pending"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("actual_cost"),
        F.count_if(~F.col("is_pending") & ~F.col("ok")).alias("n_failed"),
        F.coalesce(F.sum("usage"), F.lit(0)).alias("actual_usage"))
    gate = F.lit(True) if force is None else (F.col("max_cost_pending") >= F.lit(force))
    return totals.withColumn("n_cached", n_cached).withColumn("needs_confirmation", gate)


def largest_requests_first(r: DataFrame) -> DataFrame:
    """Execution order: descending estimated maximum usage (ties by id)."""
    return dense_index(r, [-F.col("max_total_usage"), F.col("request_id")], out="exec_order")


def cache_retention(cache: DataFrame, keep: int = CACHE_SIZE) -> DataFrame:
    """Rank entries newest first; those past ``keep`` are evicted."""
    ranked = dense_index(cache, [-F.unix_micros(F.col("cached_at")), F.col("request_hash"), F.col("entry_id")],
                         out="age_rank")
    return ranked.withColumn("evict", F.col("age_rank") >= keep)


def rolling_request_budget(log: DataFrame, models: DataFrame, window_s: float = WAIT_WINDOW_SECONDS,
                           share: float = API_SHARE) -> DataFrame:
    """For each request: requests that started before it and were running or
    finished within the window at its start, their token sum, and the flags
    against the model's per-minute limits.

    Counting intervals ``[start_q, finish_q + window]`` that contain a start
    time is a global running sum of +1 (start) and -1 (window end) events, and
    of their tokens in the same pass; a request that never finished has no -1
    event.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    start = F.struct(micros("started_at").alias("t"), F.lit(1).alias("kind"))
    end = F.struct((micros("finished_at") + int(window_s * 1_000_000)).alias("t"), F.lit(2).alias("kind"))
    events = F.filter(F.array(start, end), lambda e: e["t"].isNotNull() | (e["kind"] == 1))
    marks = log.select("request_id", "model", "started_at", "tokens", F.explode(events).alias("e"))
    sign = F.when(F.col("e.kind") == 1, 1).otherwise(-1).cast("bigint")
    counted = prefix_sums(marks, [F.col("e.t"), F.col("e.kind"), F.col("request_id")],
                          {"n_relevant": sign, "tokens_relevant": sign * F.col("tokens")})
    starts = counted.where(F.col("e.kind") == 1)
    j = starts.join(F.broadcast(models.select("model", "max_rpm", "max_tpm")), "model", "left")
    return j.select("request_id", "model", "started_at", "n_relevant", "tokens_relevant",
                    (F.col("n_relevant") > F.col("max_rpm") * share).alias("over_rpm"),
                    (F.col("tokens_relevant") > F.col("max_tpm") * share).alias("over_tpm"))
